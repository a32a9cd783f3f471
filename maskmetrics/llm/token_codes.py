"""Token-id output as directly addressable codes.

An id is split into chunks, lowest bits first.  Level ``k`` holds the ``k``-th chunk of
every id that has one, packed at its width, and a bitmap that says whether the id
continues on the next level.  A rank directory (set bits before every block of 512)
turns a position on one level into the position on the next, so any token is found by
reading a handful of words, without decoding what stands before it.

Layout of a segment's payload (little-endian): ``b"DAC1"``, number of levels (u4), number
of tokens (u8); per level its width in bits (u4) and length (u8); then per level the
chunks (u1, u2 or u4 each), the bitmap (``ceil(n / 8)`` bytes, lowest bit first) and the rank directory
(u4 per block, one more than there are blocks).

A file is a Parquet table with one segment per row, payloads as they are (not compressed), beside the ids of its documents and
where each starts; segments hold whole documents.  Rows are in ascending order of
``doc_id`` (nulls first), then text, within and across the parts of the table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded_batches, materialise, new_path, released
from .encoding import encoder

MAGIC = b"DAC1"
BLOCK = 512
#: Bits per level; an id needs the last level only if it has more bits than the first ones hold.
WIDTHS = (8, 8, 16)
#: A segment is closed once it has this many tokens; one document is never divided.
SEGMENT_TOKENS = 1 << 20

SEGMENT_SCHEMA = (
    "part int, segment int, n_tokens long, before long, first_id long, last_id long, doc_ids array<long>, starts array<long>, lengths array<long>, payload binary"
)
DIGEST_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _chunk_type(width: int) -> np.dtype:
    return np.dtype("<u1" if width <= 8 else "<u2" if width <= 16 else "<u4")


def pack(ids: np.ndarray, widths: tuple[int, ...] = WIDTHS) -> bytes:
    """Encode unsigned ids.  Ids of more bits than ``sum(widths)`` are an error."""
    if sum(widths) > 32 or any(w < 1 for w in widths):
        raise ValueError("widths must be positive and add up to 32 bits at most")
    rest = np.ascontiguousarray(ids, dtype=np.uint32)
    if len(rest) and int(rest.max()) >> sum(widths):
        raise ValueError("an id has more bits than the levels hold")
    heads, bodies = [], []
    for k, width in enumerate(widths):
        higher = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
        more = higher > 0
        bitmap = np.packbits(more, bitorder="little")
        sums = np.add.reduceat(np.append(more, False), np.arange(0, len(more) + 1, BLOCK)) if len(more) else np.zeros(1, int)
        directory = np.concatenate([[0], np.cumsum(sums)]).astype("<u4")
        chunks = (rest & np.uint32((1 << width) - 1)).astype(_chunk_type(width))
        heads.append(struct.pack("<IQ", width, len(rest)))
        bodies += [chunks.tobytes(), bitmap.tobytes(), directory.tobytes()]
        rest = higher[more]
        if not len(rest):
            break
    return b"".join([MAGIC, struct.pack("<IQ", len(heads), len(ids)), *heads, *bodies])


class Reader:
    """Random access to the ids of one payload."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("not a token segment")
        levels, self.n = struct.unpack_from("<IQ", payload, 4)
        shape = [struct.unpack_from("<IQ", payload, 16 + 12 * k) for k in range(levels)]
        at = 16 + 12 * levels
        self.levels = []
        for width, n in shape:
            kind = _chunk_type(width)
            chunks = np.frombuffer(payload, kind, n, at)
            at += n * kind.itemsize
            bitmap = np.frombuffer(payload, np.uint8, -(-n // 8), at)
            at += len(bitmap)
            directory = np.frombuffer(payload, "<u4", n // BLOCK + 2, at)
            at += 4 * len(directory)
            self.levels.append((width, chunks, bitmap, directory))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        """The ``i``-th id: one chunk, one bit and one rank per level."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for width, chunks, bitmap, directory in self.levels:
            value |= int(chunks[i]) << shift
            if not bitmap[i >> 3] >> (i & 7) & 1:
                break
            shift += width
            block = i // BLOCK
            inside = np.unpackbits(bitmap[block * BLOCK // 8 : (i >> 3) + 1], bitorder="little")
            i = int(directory[block]) + int(inside[: i - block * BLOCK].sum())
        return value

    def all(self) -> np.ndarray:
        """Every id, level by level."""
        values: np.ndarray | None = None
        for width, chunks, bitmap, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            if values is not None:
                more = np.unpackbits(bitmap, count=len(own), bitorder="little").view(bool)
                own[more] |= values << np.uint32(width)
            values = own
        return values if values is not None else np.zeros(0, np.uint32)


def write_codes(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, by_word: bool = True, widths: tuple[int, ...] = WIDTHS, segment_tokens: int = SEGMENT_TOKENS
) -> None:
    """Encode ``docs(doc_id, text)`` and write the file at ``path``.

    A null text counts as empty, so its document is the end id alone.  A null ``doc_id`` is
    written first.  Repeated rows are each written.  An empty table gives a file without rows.
    Other columns are ignored.  One shuffle carries the texts to their places; a task holds
    one Arrow batch and one segment at a time.
    """
    bounded_batches(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part = encoder(tokenizer, by_word), TaskContext.get().partitionId()
        end = np.array([end_id], enc.dtype).tobytes()
        keys, lengths, raw, total, segment, before = [], [], [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            starts = (before + np.cumsum([0, *lengths])[:-1]).tolist()
            ids = np.frombuffer(b"".join(raw), enc.dtype)
            row = {"part": [part], "segment": [segment], "n_tokens": [len(ids)], "before": [before], "first_id": [min((k for k in keys if k is not None), default=None)], "last_id": [max((k for k in keys if k is not None), default=None)], "doc_ids": [keys], "starts": [starts], "lengths": [lengths], "payload": [pack(ids, widths)]}
            return pa.RecordBatch.from_pydict(row, schema=SEGMENT_ARROW)

        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // enc.dtype.itemsize
                keys.append(key)
                lengths.append(n)
                raw.append(ids)
                total += n
                if total >= segment_tokens:
                    yield flush()
                    before += total
                    keys, lengths, raw, total, segment = [], [], [], 0, segment + 1
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id")).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(released(encode), SEGMENT_SCHEMA).write.option("compression", "none").parquet(path)


SEGMENT_ARROW = pa.schema(
    [("part", pa.int32()), ("segment", pa.int32()), ("n_tokens", pa.int64()), ("before", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())]
    + [(c, pa.list_(pa.int64())) for c in ("doc_ids", "starts", "lengths")]
    + [("payload", pa.binary())]
)


def read_codes(spark, path: str) -> DataFrame:
    """The segments of a file, with ``base``: the number of ids in all parts before the segment's.

    There is one part per writing task, so the table of their sizes has
    as many rows as that write had tasks; it is broadcast up to ``BROADCAST_IDS`` of them.
    """
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("base"))
    parts = materialise(parts, "part-sizes")
    return segments.join(F.broadcast(parts) if parts.count() <= BROADCAST_IDS else parts, "part")


def token_at(spark, path: str, doc_id: int, i: int) -> int:
    """The ``i``-th id of the first document with this id, read from the file at ``path``.

    The ids that a segment holds are told by two columns, so Parquet's statistics leave one segment, or as few as the document has rows; its chunk, bit and rank per level are then all that is looked at.
    """
    own = spark.read.schema(SEGMENT_SCHEMA).parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id))
    at = F.array_position("doc_ids", doc_id).cast("int")
    found = own.where(F.array_contains("doc_ids", doc_id)).orderBy("part", "segment").select((F.element_at("starts", at) - F.col("before")).alias("start"), F.element_at("lengths", at).alias("n"), "payload").first()
    if found is None:
        raise KeyError(doc_id)
    if not 0 <= i < found["n"]:
        raise IndexError(i)
    return Reader(found["payload"])[found["start"] + i]


def tokens_at(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """``position, id`` for every row of ``wanted(position)``: the ids at those places of the corpus, of ``segments`` from :func:`read_codes`.

    Each position is looked up by its chunk, bit and rank per level, and only segments that are asked for are opened; their payloads come by a join, whose scan
    passes over all segments (:func:`token_at` reads one).  Positions outside the corpus and nulls give no rows, repeated ones are each answered.
    """
    bounded_batches(segments.sparkSession)
    starts = segments.select("part", "segment", (F.col("base") + F.col("before")).alias("from"), (F.col("base") + F.col("before") + F.col("n_tokens")).alias("to"))
    # a position meets its segment by the million that both are in; a segment reaches over few of them
    own = starts.where("to > from").withColumn("bin", F.explode(F.sequence(F.floor(F.col("from") / SEGMENT_TOKENS), F.floor((F.col("to") - 1) / SEGMENT_TOKENS))))
    asked = wanted.select(F.col("position").cast("long").alias("position")).withColumn("bin", F.floor(F.col("position") / SEGMENT_TOKENS))
    met = asked.join(own, (asked["bin"] == own["bin"]) & (F.col("position") >= F.col("from")) & (F.col("position") < F.col("to")))
    places = met.select("part", "segment", "position", (F.col("position") - F.col("from")).alias("at"))
    lists = places.groupBy("part", "segment", F.pmod(F.xxhash64("position"), F.lit(16)).alias("salt")).agg(F.collect_list(F.struct("position", "at")).alias("places"))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                reader = Reader(batch.column(0)[k].as_py())
                asked = batch.column(1)[k].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([a["position"] for a in asked], pa.int64()), pa.array([reader[a["at"]] for a in asked], pa.int64())], names=["position", "id"])

    return segments.select("part", "segment", "payload").join(lists, ["part", "segment"]).select("payload", "places").mapInArrow(released(look), "position long, id long")


def digests(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, decoded from the segments."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                base, keys, starts, lengths, payload = (batch.column(c)[k].as_py() for c in range(5))
                raw = memoryview(Reader(payload).all().astype("<u4", copy=False)).cast("B")
                at, sums = 0, []
                for n in lengths:
                    sums.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    at += n
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return segments.select("base", "doc_ids", "starts", "lengths", "payload").mapInArrow(released(decode), DIGEST_SCHEMA)


def token_codes(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the corpus as directly addressable codes in the shared folder and digest what is read back."""
    path = new_path(docs.sparkSession, "token-codes")
    write_codes(docs, path, tokenizer, end_id)
    return digests(read_codes(docs.sparkSession, path))
