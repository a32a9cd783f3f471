"""SimHash fingerprints of word shingles and their links, by bit-sliced comparison.

Fingerprints that differ in at most ``radius`` bits agree on at least ``bands - radius`` of
``bands`` bands, so each is filed under every such choice of bands; only fingerprints of one
bucket are compared.  A bucket is cut into tiles, and pairs of tiles are compared by
separate tasks, so no task holds more than two tiles of a bucket.

Within tiles the fingerprints lie in bit planes: word ``w`` of plane ``b`` holds bit ``b`` of 64
neighbouring fingerprints.  For a shift ``d`` all distances between neighbours ``i`` and ``i + d``
are counted at once: every plane is xor-ed with itself shifted by ``d``, and the result is
added to bit-sliced counters with carry-save additions; blocks of 64 pairs that have all
passed the radius are abandoned.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded_batches, drop_files, materialise, released
from .components import components
from .passages import mix, word_hashes

#: Fingerprints in a tile of a bucket.
TILE = 1024
#: Fingerprints that a task compares at once, in whole groups.
ROUND = 32_768
#: Planes added between two tests of which blocks are still open.
STRIDE = 4


def fingerprint_of(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of one text.

    Words are maximal runs without ASCII white space, in the text with A-Z lower-cased; their
    shingles (the whole sequence if it is shorter) are hashed with XXH64, seed 42, repeats
    included; a bit is set if it is set in over half the hashes.  No words give 0.
    """
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both are ASCII-only on bytes
    if not words:
        return 0
    parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.array([xxh64_intdigest(p, 42) for p in parts], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 15):
        part = hashes[lo : lo + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.uint16 if len(part) < 1 << 16 else np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row of ``docs(doc_id, text)``."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint_of(t, shingle) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).mapInArrow(released(run), "doc_id long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """The planes (packed bits) of the rows of ``fps``, one for every bit of a row, with one empty word at the end."""
    n, words = -(-len(fps) // 64), fps.shape[1]
    bits = np.zeros((64 * words, (n + 1) * 64), np.uint8)
    bits[:, : len(fps)] = np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8 * words), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def near_at_shift(planes: np.ndarray, d: int, want: np.ndarray, radius: int) -> np.ndarray:
    """Positions ``i`` among the wanted bits (packed words) with at most ``radius`` bits between ``i`` and ``i + d``."""
    skip, inside = divmod(d, 64)
    blocks = np.flatnonzero(want)
    over = ~want[blocks]  # pairs not asked for count as passed
    counters = [np.zeros(len(blocks), np.uint64) for _ in range(radius.bit_length())]
    last = planes.shape[1] - 1
    for lo in range(0, len(planes), STRIDE):
        at, after = np.minimum(blocks + skip, last), np.minimum(blocks + skip + 1, last)
        for b in range(lo, lo + STRIDE):
            plane = planes[b]
            other = plane[at] if not inside else plane[at] >> np.uint64(inside) | plane[after] << np.uint64(64 - inside)
            carry = plane[blocks] ^ other
            for k, c in enumerate(counters):
                counters[k], carry = c ^ carry, c & carry
            over |= carry
        if radius + 1 & radius:  # the counters hold more than the radius before they overflow
            above, equal = np.zeros_like(over), ~np.zeros_like(over)
            for k in reversed(range(len(counters))):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    above |= equal & counters[k]
                    equal &= ~counters[k]
            over |= above
        open_ = np.flatnonzero(~over)
        if len(open_) < len(blocks):
            blocks, over, counters = blocks[open_], over[open_], [c[open_] for c in counters]
            if not len(blocks):
                return blocks
    found = np.unpackbits((~over).astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
    block, bit = np.nonzero(found)
    return blocks[block] * 64 + bit


def near_links(fps: np.ndarray, group: np.ndarray, radius: int, side: np.ndarray | None = None, wide: np.ndarray | None = None, bound: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links (positions) of the near pairs inside each group; ``group`` is sorted, and ``fps`` has a word, or a row of words, for each.

    With ``side`` (0: both, 1, 2) pairs within side 1 or within side 2 are not compared.  With ``wide`` (further bits, a row of words each) only pairs that
    also differ in at most ``bound`` of these count: links span that relation, not the cruder one of the fingerprints.
    """
    n, fps = len(fps), fps.reshape(len(fps), -1)
    starts = np.flatnonzero(np.diff(group, prepend=group[0] - 1)) if n else np.zeros(0, int)
    sizes = np.diff(np.append(starts, n))
    # groups from large to small: for every shift the pairs left to compare stand in front
    order = np.argsort(-sizes, kind="stable")
    perm = np.concatenate([np.arange(starts[g], starts[g] + sizes[g]) for g in order]) if n else np.zeros(0, int)
    fps, ends = fps[perm], np.repeat(np.cumsum(sizes[order]), sizes[order])
    room = ends - np.arange(n)  # how far a shift stays in the group
    side = None if side is None else side[perm]
    wide = None if wide is None else wide.view(np.uint64)[perm]
    planes, parent = _planes(fps), np.arange(n)
    own = np.repeat(np.arange(len(sizes)), sizes[order])
    left, right = [], []
    for d in range(1, int(sizes.max()) if n else 0):
        if d & (d - 1) == 0 and left:  # now and then, groups that hang together already are done with
            parts = np.bincount(own[parent == np.arange(n)], minlength=len(sizes))
            room[parts[own] == 1] = 0
        open_ = np.flatnonzero(room > d)
        if not len(open_):
            break
        reach = int(open_[-1]) + 1
        want = room[:reach] > d
        if side is not None:
            want &= (side[:reach] == 0) | (side[:reach] != side[d : d + reach])
        words = np.zeros(-(-reach // 64) * 64, np.uint8)
        words[:reach] = want
        found = near_at_shift(planes, d, np.packbits(words, bitorder="little").view("<u8"), radius)
        if not len(found):
            continue
        while True:  # every position points at its root
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
        found = found[parent[found] != parent[found + d]]
        if wide is not None:  # before anything is thinned
            apart = [np.bitwise_count(wide[i] ^ wide[i + d]).sum(axis=1, dtype=np.int64) for i in np.split(found, range(ROUND, len(found), ROUND))]
            found = found[np.concatenate(apart) <= bound]
        for i in found.tolist():
            a, b = i, i + d
            while parent[a] != a:
                a = parent[a]
            while parent[b] != b:
                b = parent[b]
            if a != b:
                parent[max(a, b)] = min(a, b)
                left.append(i)
                right.append(i + d)
    return perm[np.array(left, int)], perm[np.array(right, int)]


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of the same components as ``u, v``: each node with the smallest of its component, which many tasks find the same."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    least = np.arange(len(nodes))
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        for end in (a, b):
            np.minimum.at(new, least[end], low)
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, least):
            break
        least = new
    own = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[own], nodes[least[own]]


def fingerprint_links(fps: DataFrame, radius: int = 2, bands: int = 4) -> DataFrame:
    """Links ``u, v`` that connect every two distinct fingerprints of ``fps(fp)`` within ``radius`` bits, directly or over others.

    Within a pair of tiles the links are stars, so a bucket of
    ``m`` fingerprints gives links in proportion to ``m`` times its tiles, not its pairs.
    """
    if not 0 < radius < bands <= 64:
        raise ValueError("0 < radius < bands <= 64")
    cuts = [64 * k // bands for k in range(bands + 1)]
    masks = [sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in pick) for pick in combinations(range(bands), bands - radius)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = F.explode(F.array(*[F.struct(F.lit(k).alias("pick"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("bucket")) for k, m in enumerate(masks)]))
    filed = fps.select("fp", keyed.alias("at")).select("at.pick", "at.bucket", F.col("fp").alias("node"), "fp")
    return bucket_links(filed, radius)


def bucket_links(filed: DataFrame, radius: int, wides: DataFrame | None = None, bounds: tuple[int, ...] = (), nodes_only: bool = False) -> DataFrame:
    """Links ``u, v`` between nodes of ``filed(pick, bucket, node, fp..)`` that share a bucket and whose fingerprints (all columns after ``node``) differ in at most ``radius`` bits.

    They are stars: what hangs together within a pair of tiles is linked to its smallest node.  With ``wides(node, wide)`` the links are ``u, v, bound``: for each of
    ``bounds`` those that connect the pairs that also differ in at most so many wide bits.  ``nodes_only``: no links, only the nodes that have some.
    """
    full = filed.groupBy("pick", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    own = filed.join(full, ["pick", "bucket"]).withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = spread.select(
        "pick", "bucket", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).cast("byte").alias("side"), *filed.columns[2:]
    )
    last = len(pairs.columns)
    keys = ["pick", "bucket", "a", "b"]
    schema = "node long" if nodes_only else "u long, v long"
    if wides is not None:
        pairs, schema = pairs.join(wides, "node").select(*pairs.columns, "wide"), "u long, v long, bound int"

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def link(columns: list[np.ndarray]) -> pa.RecordBatch:
            *key, side, node = columns[:6]
            fp = np.column_stack(columns[6:last])
            change = np.zeros(len(fp), bool)
            for c in key:
                change[1:] |= c[1:] != c[:-1]
            if len(columns) == last:
                u, v = near_links(fp.view(np.uint64), np.cumsum(change), radius, side)
                if nodes_only:
                    return pa.RecordBatch.from_arrays([pa.array(np.unique(node[np.concatenate([u, v])]))], names=["node"])
                return pa.RecordBatch.from_arrays([pa.array(x) for x in stars(node[u], node[v])], names=["u", "v"])
            found = [near_links(fp.view(np.uint64), np.cumsum(change), radius, side, columns[last], bound) for bound in bounds]
            found = [stars(node[u], node[v]) for u, v in found]
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.array(np.repeat(np.array(bounds, np.int32), [len(x) for x, _ in found]))], names=["u", "v", "bound"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(tuple(c.to_numpy() if k < last else np.asarray(c.flatten()).reshape(batch.num_rows, -1) for k, c in enumerate(batch.columns)))
            if sum(len(h[0]) for h in held) >= ROUND:
                columns = [np.concatenate(c) for c in zip(*held, strict=True)]
                ends = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns[:4]], axis=0)) + 1
                end = int(ends[-1]) if len(ends) else 0  # the last group may go on
                if end:
                    yield link([c[:end] for c in columns])
                held = [tuple(c[end:] for c in columns)]
        if held and len(held[0][0]) + sum(len(h[0]) for h in held[1:]):
            yield link([np.concatenate(c) for c in zip(*held, strict=True)])

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(compare), schema)


def simhash_classes(docs: DataFrame, shingle: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs(doc_id, text)``.

    Two documents link if their fingerprints differ in at most ``radius`` bits; ``component_id`` is the smallest
    ``doc_id`` reachable by links.  A null or empty text has fingerprint 0 and links like any other; a null ``doc_id``
    keeps its row and is passed over as a component's name (null only if the component has no other); repeated rows are each
    returned; further columns are ignored; an empty table gives no rows.
    """
    own = materialise(fingerprints(docs, shingle), "fingerprints")
    classes = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    nodes = components(fingerprint_links(classes.select("fp"), radius))
    joined = classes.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    named = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = joined.select("fp", "component").join(named, "component").select("fp", "component_id")
    return own.join(by_fp, "fp").select("doc_id", "fp", "component_id")


#: Bits of the wide fingerprint that similarity is estimated from, and standard deviations of that estimate within which a link is checked exactly.
WIDE = 1024
SLACK = 3.0
#: Words of them that are compared bit-sliced first, and the standard deviations within which a pair passes: of pairs at the threshold all but one in 18,000, of any others hardly one in a million.
NARROW, NARROW_SLACK = 2, 4.3
#: Chance that a pair just at the threshold shares no bucket.
MISS = 0.01
#: Sets of up to so many shingles are compared exactly: theirs differ in more bits than the rate says.
FEW = 32
#: Shingles in a tile of sets that are compared exactly.
TILE_SHINGLES = 1 << 17


def bit_rate(similarity: float) -> float:
    """The share of bits in which SimHashes of two equally large sets of this Jaccard similarity differ."""
    return float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text's lower-case words (of all words as one if they are fewer), sorted."""
    words = word_hashes(text or "")
    own = words[: max(1, len(words) - shingle + 1)].copy()
    for k in range(1, min(shingle, len(words))):
        own = mix(own * np.uint64(0x9E3779B97F4A7C15) + words[k : k + len(own)])
    return np.unique(own)


def wide_bits(text: str | None, shingle: int) -> np.ndarray:
    """``WIDE`` bits of a text: majorities over the hashes of its distinct shingles; all 0 without words."""
    return set_bits(shingle_set(text, shingle))


def set_bits(own: np.ndarray) -> np.ndarray:
    """``WIDE`` bits of a set of shingles."""
    seeds = mix(np.arange(1, WIDE // 64 + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    ones = np.zeros((8, WIDE // 8), np.int64)
    for lo in range(0, len(own), 255):  # sums of up to 255 bits fit a byte
        hashes = mix(own[lo : lo + 255, None] ^ seeds[None, :]).view(np.uint8)
        for bit in range(8):
            ones[bit] += ((hashes >> bit) & 1).sum(axis=0, dtype=np.uint8)
    return (2 * ones.T.ravel() > len(own)).astype(np.uint8)


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, miss: float = MISS, width: int | None = None) -> DataFrame:
    """``doc_id, text_hash, component_id, component_hash`` for every row of ``docs(doc_id, text)`` with an id: near copies by their shingles' Jaccard similarity.

    Similarity is estimated from ``WIDE`` bits (standard deviation about 0.02 at 0.8); pairs that are surely similar are linked.  Those within ``SLACK``
    deviations of the threshold join documents into blocks, and inside a block all pairs that are not connected yet are checked on their shingles.  Candidates share a bucket: a choice of ``width`` bits of which there are so many that a pair at the
    threshold shares none with a chance of ``miss``, whatever the width; by default the width grows with the number of documents, so that buckets stay small.  In a bucket the first ``NARROW`` words are compared bit-sliced, within a radius that a pair at the threshold
    fails with a chance of about 5e-5, then all bits, and only pairs that
    pass are thinned to links.  Documents of at most ``FEW`` shingles are compared exactly with those they share a rare shingle with.  Documents with equal bits are one class.

    A document is an id with a text: ``text_hash`` tells texts with one id apart, and a component is named by its smallest id and, of those with that id, the smallest hash.
    Null and empty texts link with each other; rows with a null ``doc_id`` are left out; repeated rows are each returned.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_hash(docs).alias("text_hash"), F.col("text").cast("string")).where("doc_id is not null")
    rate = bit_rate(similarity)
    width = width or max(16, rows.count().bit_length() - 8)
    tables = int(np.ceil(np.log(miss) / np.log(1 - (1 - rate) ** width)))
    order = np.random.default_rng(0)
    picks = np.concatenate([order.permutation(WIDE) for _ in range(-(-tables * width // WIDE))])[: tables * width]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits, few = np.zeros((batch.num_rows, WIDE), np.uint8), []
            for k, text in enumerate(batch.column(2).to_pylist()):
                own = shingle_set(text, shingle)
                bits[k] = set_bits(own)
                few.append(own.view(np.int64) if similarity * len(own) <= FEW else None)
            wide = np.packbits(bits, axis=1, bitorder="little").view("<i8")
            lists = pa.FixedSizeListArray.from_arrays(pa.array(wide.ravel()), WIDE // 64).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists, pa.array(few, pa.list_(pa.int64()))], names=["doc_id", "text_hash", "wide", "few"])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = np.int64(1) << np.arange(width, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            wide = np.asarray(batch.column(1).flatten()).reshape(batch.num_rows, -1)
            bits = np.unpackbits(np.ascontiguousarray(wide).view(np.uint8), axis=1, bitorder="little")
            keys = bits[:, picks].reshape(len(wide), tables, width).astype(np.int64) @ powers
            node = np.asarray(batch.column(0))
            columns = [np.tile(np.arange(tables, dtype=np.int32), len(wide)), keys.ravel(), *(np.repeat(v, tables) for v in (node, *wide.T[:NARROW]))]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["pick", "bucket", "node", *(f"fp{k}" for k in range(NARROW))])

    own = materialise(rows.mapInArrow(released(run), "doc_id long, text_hash long, wide array<long>, few array<long>"), "wide")
    first = F.min(F.struct("doc_id", "text_hash"))
    # a class is named by a number of its own, as texts with one id may be in several
    classes = own.groupBy("wide").agg(first.alias("first"), F.min_by("few", F.struct("doc_id", "text_hash")).alias("few"))
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "wide-classes")
    some = classes.where(f"few is null or size(few) > {FEW}").select("node", "wide")
    filed = materialise(some.mapInArrow(released(file), "pick int, bucket long, node long, " + ", ".join(f"fp{k} long" for k in range(NARROW))), "filed")
    radius = int(64 * NARROW * rate + NARROW_SLACK * np.sqrt(64 * NARROW * rate * (1 - rate)))
    # what has no partner in the first words goes
    paired = materialise(bucket_links(filed, radius, nodes_only=True).distinct(), "wide-paired")
    deviation = SLACK * np.sqrt(WIDE * rate * (1 - rate))
    near, sure = int(WIDE * rate + deviation), int(WIDE * rate - deviation) - 1
    links = materialise(bucket_links(filed.join(paired, "node", "left_semi").select(filed.columns), radius, some.join(paired, "node", "left_semi"), (near, sure)).distinct(), "wide-links")
    drop_files(filed)
    real = links.where(F.col("bound") == sure).select("u", "v").union(few_links(classes.where("few is not null").select("node", "few"), similarity))
    real = materialise(real, "real-links")
    nodes = materialise(components(real), "wide-nodes")
    blocks = components(links.where(F.col("bound") == near).select("u", "v")).withColumnRenamed("component", "block")
    blocks = materialise(blocks.join(nodes, "node", "left").select("node", "block", F.coalesce("component", "node").alias("part")), "blocks")
    mixed = blocks.groupBy("block").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a <> b").select("block")
    unsure = materialise(blocks.join(mixed, "block").join(classes.select("node", "first.*"), "node"), "wide-unsure")
    if not unsure.isEmpty():
        nodes = components(real.union(set_links(shingle_sets(docs, unsure, shingle).select(F.col("block").alias("key"), "node", "part", "shingles"), similarity)))
    parts = classes.join(nodes, "node", "left").select("wide", "first", F.coalesce("component", "node").alias("component"))
    names = parts.groupBy("component").agg(F.min("first").alias("name"))
    named = parts.join(names, "component").select("wide", F.col("name.doc_id").alias("component_id"), F.col("name.text_hash").alias("component_hash"))
    return own.join(named, "wide").select("doc_id", "text_hash", "component_id", "component_hash")


def text_hash(docs: DataFrame) -> Column:
    return F.xxhash64(docs["text"].cast("string"))


def few_links(classes: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` that connect every two nodes of ``classes(node, few)`` whose sets have at least this Jaccard similarity.

    Similar sets share one of the first ``n - ceil(similarity * n) + 1`` elements of each in any order that holds for all; here the rarest come first.
    """
    single = classes.select("node", F.explode("few").alias("key"))
    often = single.groupBy("key").count()
    ranked = single.join(often, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("count", "key"))).alias("ranked"))
    first = F.slice("ranked", F.lit(1), F.size("ranked") - F.ceil(similarity * F.size("ranked") - 1e-9).cast("int") + 1)
    filed = ranked.select("node", F.explode(first).alias("at")).select("node", "at.key")
    return set_links(filed.join(classes, "node").select("key", "node", F.col("node").alias("part"), F.col("few").alias("shingles")), similarity).distinct()


def shingle_sets(docs: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """``nodes(node, block, part, doc_id, text_hash)`` with the ``shingles`` of their documents."""
    keys = nodes.select(F.col("doc_id").alias("key_id"), F.col("text_hash").alias("key_hash"), "node", "block", "part")
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), text_hash(docs).alias("hash"), F.col("text").cast("string").alias("text"))
    # rows with equal id and text are one document
    texts = rows.join(keys, (rows["id"] == keys["key_id"]) & (rows["hash"] == keys["key_hash"])).select("node", "block", "part", "text").dropDuplicates(["node"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(sets, pa.list_(pa.int64()))], names=["node", "block", "part", "shingles"])

    return materialise(texts.mapInArrow(released(run), "node long, block long, part long, shingles array<long>"), "shingle-sets")


def similar_sets(values: np.ndarray, sizes: np.ndarray, part: np.ndarray, side: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Links (positions) that connect all pairs of sets with at least this Jaccard similarity, where ``part`` does not connect them already.

    ``values`` holds the sets one after the other.  Pairs within side 1 or within side 2 are not compared.
    """
    n = len(sizes)
    ids, at = np.unique(values, return_inverse=True)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    part = np.unique(part, return_inverse=True)[1]
    members = np.bincount(part)
    # of two sets of different parts one at least is outside the largest
    left, right = [], []
    has = np.zeros(len(ids), np.int32)
    for i in np.flatnonzero(part != members.argmax()).tolist():
        other = np.flatnonzero((part != part[i]) & ((side == 0) | (side != side[i])) & (sizes >= similarity * sizes[i]) & (similarity * sizes <= sizes[i]))
        if not len(other):
            continue
        own = at[starts[i] : ends[i]]
        has[own] = 1
        if 4 * len(other) > n:
            both = np.add.reduceat(has[at], starts)[other]
        else:
            both = np.array([has[at[starts[j] : ends[j]]].sum() for j in other.tolist()])
        has[own] = 0
        for j in other[both >= similarity * (sizes[i] + sizes[other] - both)].tolist():
            if part[i] != part[j]:
                left.append(i)
                right.append(j)
                part[part == part[j]] = part[i]
    return left, right


def set_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links ``u, v`` of nodes of ``sets(key, node, part, shingles)`` that have a key in common and sets with at least this Jaccard similarity; they connect what ``part`` does not connect already.

    A key's sets are cut into tiles by their sizes, and pairs of tiles are compared by separate tasks, each pair of sets exactly; only links that connect something new are written.
    """
    n = F.size("shingles")
    full = sets.groupBy("key").agg(F.count("*").alias("n"), F.sum(n).alias("all")).where("n > 1")
    tiles = F.greatest(F.ceil(F.col("all") / TILE_SHINGLES), F.ceil(F.col("n") / TILE)).cast("int")
    own = sets.where(n > 0).join(full, "key").withColumn("tiles", tiles).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    side = F.when(F.col("tile") == F.col("other"), 0).when(F.col("tile") < F.col("other"), 1).otherwise(2).cast("byte")
    pairs = spread.select("key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), side.alias("side"), "node", "part", "shingles")
    keys = ["key", "a", "b"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, held = None, []

        def link() -> pa.RecordBatch:
            side, node, part = (np.array(x, np.int64) for x in list(zip(*held, strict=True))[:3])
            u, v = similar_sets(np.concatenate([x[3] for x in held]), np.array([len(x[3]) for x in held]), part, side, similarity)
            return pa.RecordBatch.from_arrays([pa.array(node[u], pa.int64()), pa.array(node[v], pa.int64())], names=["u", "v"])

        for batch in batches:
            values, ends = np.asarray(batch.column(6).flatten()), (np.asarray(batch.column(6).offsets) - batch.column(6).offsets[0].as_py()).tolist()
            for k, (key, a, b, side, node, part) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)):
                if (key, a, b) != known and held:
                    if len(held) > 1:
                        yield link()
                    held = []
                known = key, a, b
                held.append((side, node, part, values[ends[k] : ends[k + 1]].copy()))
        if len(held) > 1:
            yield link()

    return pairs.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(released(compare), "u long, v long")


def drop_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """``docs`` with one document of each component of near copies left, the one with the smallest ``doc_id``; all columns stay, whatever their names.

    Rows are told apart by id and text, so a row that shares its id with a copy stays if its own text has no copy before it; of rows with equal id and text one is left.
    Rows with a null ``doc_id`` cannot be named and stay.
    """
    found = materialise(near_copies(docs, similarity, shingle), "near-copies")
    first = (F.col("doc_id") == F.col("component_id")) & (F.col("text_hash") == F.col("component_hash"))
    kept = without_rows(docs, found.where(~first).select("doc_id", "text_hash"))
    twice = materialise(found.where(first).groupBy("doc_id", "text_hash").count().where("count > 1").select("doc_id", "text_hash"), "repeated")
    if twice.isEmpty():
        return kept
    return without_rows(kept, twice).unionByName(without_rows(kept, twice, "left_semi").dropDuplicates(["doc_id", "text"]))


def without_rows(docs: DataFrame, keys: DataFrame, how: str = "left_anti") -> DataFrame:
    """The rows of ``docs`` whose id and text are not (``left_semi``: are) those of a row of ``keys(doc_id, text_hash)``; rows with a null id are in no key.

    The keys are written first; as long as they are few they are broadcast and no text is shuffled.
    """
    keys = materialise(keys.distinct(), "keys")
    few = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
    return docs.join(few, (docs["doc_id"].cast("long") == few["doc_id"]) & (text_hash(docs) == few["text_hash"]), how)
