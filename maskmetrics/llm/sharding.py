"""Byte-balanced shards of indivisible groups by Karmarkar-Karp differencing.

A partial partition is a vector of ``k`` sums.  Differencing takes the two with the largest
spread and adds them in opposite order, largest to smallest, until one is left.  Every
executor task differences its own groups into bundles of three scales, ``TOPS`` tasks difference the bundles of all tasks into as many bundles each, and the driver
differences those and the few groups that are large by themselves into the shards.
What the driver holds does not grow with the data: ``TOPS`` times the bundles of a task,
``shards * LARGE`` large groups and about ``DUST`` others that are placed by themselves; the finer even out what the coarser leave.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, released

#: A group of at least ``total / (shards * LARGE)`` bytes is placed by itself: at most ``shards * LARGE`` are.
LARGE = 400
#: Groups, about, that are placed by themselves whatever their size, chosen by their keys: they even out what the bundles leave.
DUST = 4000
#: Bundles of a task per scale; one group in 64 goes to the next finer scale.
BUNDLES = (96, 24, 24)
#: Tasks that difference the bundles of all tasks once more.
TOPS = 32
#: Groups differenced at once by a task.
CHUNK = 20_000
#: Rows that one task numbers within a shard, about.
ROWS_PER_BUCKET = 50_000


def difference(sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Difference partial partitions (each sorted downwards) into one.

    Returns its sums, sorted downwards, and for each input the slot of the result that each of its slots went to.
    """
    k, n = len(sums[0]), len(sums)
    nodes, children = list(sums), {}
    heap = [(int(s[-1] - s[0]), i) for i, s in enumerate(sums)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        both = nodes[a] + nodes[b][::-1]
        order = np.argsort(-both, kind="stable")
        place = np.empty(k, np.int64)
        place[order] = np.arange(k)
        children[len(nodes)] = (a, b, place)
        nodes[a] = nodes[b] = None
        both = both[order]
        heapq.heappush(heap, (int(both[-1] - both[0]), len(nodes)))
        nodes.append(both)
    root = heap[0][1]
    to: dict[int, np.ndarray] = {root: np.arange(k)}
    for node in range(len(nodes) - 1, n - 1, -1):
        a, b, place = children[node]
        own = to.pop(node)[place]
        to[a], to[b] = own, own[::-1]
    return nodes[root], [to[i] for i in range(n)]


def _leaf(size: int, k: int) -> np.ndarray:
    out = np.zeros(k, np.int64)
    out[0] = size
    return out


def partition(sizes: list[int], k: int) -> np.ndarray:
    """The slot, 0 to ``k - 1``, of each size; no sizes give no slots."""
    if not sizes:
        return np.zeros(0, np.int64)
    _, to = difference([_leaf(s, k) for s in sizes])
    return np.array([t[0] for t in to], np.int64)


class _Bundles:
    """A task's bundles of one scale; groups are differenced in chunks, and each chunk's partial partition meets the bundles oppositely ordered."""

    def __init__(self, k: int):
        self.held, self.keys, self.sizes = np.zeros(k, np.int64), [], []

    def add(self, key: object, size: int) -> bool:
        """Take a group; whether it is time to settle."""
        self.keys.append(key)
        self.sizes.append(size)
        return len(self.keys) >= CHUNK

    def settle(self) -> tuple[list, list[int], list[int]]:
        """The waiting groups, their sizes and the bundles that they went to."""
        sums, to = difference([_leaf(s, len(self.held)) for s in self.sizes])
        smallest_first = np.argsort(self.held, kind="stable")
        self.held[smallest_first] += sums
        out = self.keys, self.sizes, [int(smallest_first[t[0]]) for t in to]
        self.keys, self.sizes = [], []
        return out


def bundle_groups(groups: DataFrame, cutoff: int, dust: float) -> DataFrame:
    """``key, size, part, scale, slot``: the bundle of each group of ``groups(key, size)``.

    Scale 3 holds the groups of at least ``cutoff`` bytes and a share of ``dust`` of all, each a bundle of its own.
    """
    kind = pa.schema([("key", pa.binary()), ("size", pa.int64()), ("part", pa.int32()), ("scale", pa.int32()), ("slot", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, large = TaskContext.get().partitionId(), 0
        bundles = [_Bundles(k) for k in BUNDLES]

        def rows(scale: int, keys: list, sizes: list[int], slots: Iterable[int]) -> pa.RecordBatch:
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array([part] * n, pa.int32()), pa.array([scale] * n, pa.int32()), pa.array(slots, pa.int32())], schema=kind)

        for batch in batches:
            alone: list[tuple[bytes, int]] = []
            for key, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if size >= cutoff or int.from_bytes(key[2:6], "little") < dust * (1 << 32):
                    alone.append((key, size))
                    continue
                mark = int.from_bytes(key[:2], "little")
                scale = 0 if mark % 64 else 1 if mark // 64 % 64 else 2
                if bundles[scale].add(key, size):
                    yield rows(scale, *bundles[scale].settle())
            if alone:
                yield rows(3, *zip(*alone, strict=True), range(large, large + len(alone)))
                large += len(alone)
        for scale, own in enumerate(bundles):
            if own.keys:
                yield rows(scale, *own.settle())

    return groups.select("key", "size").mapInArrow(released(run), "key binary, size long, part int, scale int, slot int")


def merge_bundles(bundles: DataFrame) -> DataFrame:
    """``part, scale, slot, size, top, place``: the bundle of all tasks that each one of ``bundles(part, scale, slot, size)`` goes to; those of scale 3 stay as they are."""
    kind = pa.schema([("part", pa.int32()), ("scale", pa.int32()), ("slot", pa.int32()), ("size", pa.int64()), ("top", pa.int32()), ("place", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundles: dict[tuple[int, int], _Bundles] = {}

        def rows(scale: int, top: int, keys: list[tuple[int, int]], sizes: list[int], places: list[int]) -> pa.RecordBatch:
            parts, slots = zip(*keys, strict=True)
            n = len(keys)
            return pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip((parts, [scale] * n, slots, sizes, [top] * n, places), kind, strict=True)], schema=kind)

        for batch in batches:
            for part, scale, slot, size, top in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = bundles.setdefault((scale, top), _Bundles(BUNDLES[scale]))
                if own.add((part, slot), size):
                    yield rows(scale, top, *own.settle())
        for (scale, top), own in bundles.items():
            if own.keys:
                yield rows(scale, top, *own.settle())

    top = F.pmod(F.col("part"), F.lit(TOPS)).alias("top")
    merged = bundles.where("scale < 3").select("part", "scale", "slot", "size", top).repartition(TOPS, "top").sortWithinPartitions("top", "scale", F.desc("size"), "part", "slot")
    merged = merged.mapInArrow(released(run), "part int, scale int, slot int, size long, top int, place int")
    return merged.unionByName(bundles.where("scale = 3").select("part", "scale", "slot", "size", F.col("part").alias("top"), F.col("slot").alias("place")))


def shard_rows(rows: DataFrame, shards: int) -> DataFrame:
    """Add ``shard`` and ``slot`` to ``rows``, which has ``_row`` (any order key), ``_key`` (binary group, not null) and ``_size``.

    All rows of a key go to one shard; ``slot`` numbers a shard's rows from 0 without gaps.
    Rows are joined to their groups by key, so that a key with very many rows is split by
    adaptive execution.  No rows give no rows.
    """
    spark = rows.sparkSession
    groups = materialise(rows.groupBy(F.col("_key").alias("key")).agg(F.sum("_size").alias("size")), "groups")
    total, count = groups.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    cutoff = max(1, -(-total // (shards * LARGE)))
    bundled = materialise(bundle_groups(groups, cutoff, DUST / max(1, count)), "bundles")
    merged = materialise(merge_bundles(bundled.groupBy("part", "scale", "slot").agg(F.sum("size").alias("size"))), "merged-bundles")
    bundles = sorted(merged.groupBy("top", "scale", "place").agg(F.sum("size").alias("size")).collect())  # bounded, see above
    placed = [(*b[:3], int(s)) for b, s in zip(bundles, partition([b[3] for b in bundles], shards), strict=True)]
    where = merged.join(F.broadcast(spark.createDataFrame(placed, "top int, scale int, place int, shard int")), ["top", "scale", "place"]).select("part", "scale", "slot", "shard")
    by_key = bundled.join(where, ["part", "scale", "slot"]).select(F.col("key").alias("_key"), "shard")
    out = rows.join(by_key, "_key")

    n = rows.count()
    buckets = max(8, -(-n // (shards * ROWS_PER_BUCKET)))
    out = out.withColumn("_bucket", F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(buckets)).cast("int"))
    counts = out.groupBy("shard", "_bucket").count()
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_row"))
    out = out.withColumn("_own", own).join(counts, ["shard", "_bucket"])
    return out.withColumn("slot", (F.col("_before") + F.col("_own") - 1).cast("long")).drop("_bucket", "_own", "_before")


def shard_documents(docs: DataFrame, shards: int = 24) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row of ``docs(doc_id, text)``.

    The law is ``bytes``: sizes are the UTF-8 bytes of the text plus 8, and shards are near
    equal in bytes.  Rows with equal texts stay together; null texts (no bytes, checksum 0)
    form one group apart from the empty ones.  A null ``doc_id`` and repeated rows are placed
    like any other; further columns are ignored.
    """
    text = F.col("text")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("_row"),
        F.when(text.isNull(), F.lit(b"no text")).otherwise(F.unhex(F.sha2(text.cast("binary"), 256))).alias("_key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("_size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    out = shard_rows(materialise(rows, "rows"), shards)
    return out.select(
        F.col("_row").alias("doc_id"), F.col("_size").alias("size"), "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, placed: DataFrame, path: str) -> None:
    """Write ``docs`` as one folder ``shard=N`` per shard, in slot order within each file, by the places of :func:`shard_documents`.

    Rows are matched by id and text; rows with both equal take their places in turn.  Columns of ``docs`` may have any names but ``shard`` and ``slot``, which are
    those of the places; a table that has one of them is refused.
    """
    if clash := {c.lower() for c in docs.columns} & {"shard", "slot"}:
        raise ValueError(f"the table has columns of its own named {sorted(clash)}")
    # the row as one value, so that no name of the input can clash with one of ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("crc"))
    rows = rows.withColumn("copy", F.row_number().over(Window.partitionBy("id", "crc").orderBy("row.text")))
    places = placed.select(F.col("doc_id").alias("at_id"), F.col("text_crc32").alias("at_crc"), "shard", "slot")
    places = places.withColumn("at_copy", F.row_number().over(Window.partitionBy("at_id", "at_crc").orderBy("slot")))
    joined = rows.join(places, F.col("id").eqNullSafe(F.col("at_id")) & (F.col("crc") == F.col("at_crc")) & (F.col("copy") == F.col("at_copy")))
    out = joined.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], "shard", "slot")
    out.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
