"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector ``x`` is stored as ``s * q + e`` with ``q`` in -127..127.  For two of them

    |x.y - s_x s_y q_x.q_y|  <=  |s_x q_x| |e_y| + |e_x| |y|

and the norms on the right are kept per vector, so a tile product of the ``q`` tells which pairs surely reach the threshold, which
surely do not, and which may; only the vectors of the last are fetched and computed in double precision.

Equal vectors of one label are one class with a count.  The classes of a label are cut into
tiles by hash; a tile holds the ``q`` (one byte a component) with scales and norms, and pairs of tiles are multiplied by separate tasks.  A task returns the
number of links of each vector and links that span what is connected, and the pairs to be computed, packed in one row for its pair of tiles.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, released
from .components import components

#: Vectors in a tile.
TILE = 1024
#: Candidate pairs recomputed at once.
PAIRS = 32_768
#: Dimensions multiplied at once: sums of 1024 products of int8 are exact in single precision.
WIDTH = 1024
#: Slack for the rounding of the bound itself.
SLACK = 1e-9

TILE_SCHEMA = "label string, dim int, tile int, tiles int, ids array<long>, counts array<long>, q binary, sizes array<double>"
LINK_SCHEMA = "label string, dim int, a_tile int, b_tile int, node long, links long, least_node long, pairs binary, nodes array<long>"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``q, scale, |scale * q|, |error|`` of the rows of ``x``."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1
    q = np.rint(x / scale[:, None]).astype(np.int8)
    near = q * scale[:, None]
    return q, scale, np.linalg.norm(near, axis=1), np.linalg.norm(x - near, axis=1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; the largest component is taken out first so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


class Tile:
    """The quantised rows of some unit vectors: ``q``, scales, norms of what they stand for and of what they leave out."""

    def __init__(self, q: np.ndarray, scale: np.ndarray, norm: np.ndarray, error: np.ndarray):
        self.q, self.scale, self.norm, self.error = q, scale, norm, error


def bounded_pairs(a: Tile, b: Tile, threshold: float, same: bool) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """Positions of the pairs whose cosine is surely at least ``threshold``, and of those of which the bounds leave it open; ``same``: each pair once."""
    product = np.zeros((len(a.q), len(b.q)), np.float64)
    for lo in range(0, a.q.shape[1], WIDTH):
        product += a.q[:, lo : lo + WIDTH].astype(np.float32) @ b.q[:, lo : lo + WIDTH].astype(np.float32).T
    product *= a.scale[:, None] * b.scale[None, :]
    bound = a.norm[:, None] * b.error[None, :] + a.error[:, None] * (1 + SLACK) + SLACK
    maybe, sure = product + bound >= threshold, product - bound >= threshold
    if same:
        maybe, sure = np.triu(maybe, 1), np.triu(sure, 1)
    return np.nonzero(sure), np.nonzero(maybe & ~sure)


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return int(i)


def links_of(ids: np.ndarray, counts: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Links of each position, and the smallest id that it is connected with, over pairs of positions."""
    n = len(ids)
    links, order = np.zeros(n, np.int64), np.argsort(ids, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    parent = np.arange(n)  # by rank, so that a root is the smallest
    for a, b in pairs:
        links += np.bincount(a, counts[b], n).astype(np.int64) + np.bincount(b, counts[a], n).astype(np.int64)
        ra, rb = rank[a], rank[b]
        while not np.array_equal(up := parent[parent], parent):
            parent = up
        for i in np.flatnonzero(parent[ra] != parent[rb]).tolist():
            u, v = _root(parent, ra[i]), _root(parent, rb[i])
            parent[max(u, v)] = min(u, v)
    while not np.array_equal(up := parent[parent], parent):
        parent = up
    return links, ids[order][parent[rank]]


def vector_classes(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Rows link if their labels are equal and not null, their vectors have one length, and their cosine in double
    precision is at least ``threshold``.  A vector that is null, empty, zero or has a null or non-finite component links
    with nothing and is its own component; repeated rows are links of each other and are each returned; a null
    ``vec_id`` keeps its row, links, and is passed over as a component's name.  Further columns are ignored.
    """
    bounded_batches(vectors.sparkSession)
    x = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    fit = F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad & F.exists("x", lambda v: v != 0)
    rows = rows.withColumn("fit", F.coalesce(fit, F.lit(False))).withColumn("dim", F.size("x"))
    rows = materialise(rows.withColumn("hash", F.xxhash64("x")).withColumn("hash2", F.xxhash64(F.lit(1), "x")), "vectors")
    fitting = rows.where("fit")
    # a class is told from others by two hashes, so that vectors are moved once
    same = ["label", "dim", "hash", "hash2"]
    classes = fitting.groupBy(*same).agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("x").alias("x"))
    # and named by a number of its own, as its rows may all lack an id
    classes = materialise(classes.withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    full = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / tile).cast("int").alias("tiles"))
    filed = classes.join(full, ["label", "dim"]).withColumn("tile", F.pmod("hash", F.col("tiles")).cast("int"))
    key = ["label", "dim", "tile", "tiles"]

    def pack(key: tuple, batch: pa.Table) -> pa.Table:
        flat = batch.column("x").combine_chunks()
        q, *sizes = quantise(unit(np.asarray(flat.flatten()).reshape(len(flat), -1)))
        label, dim, at, tiles = (k.as_py() for k in key)
        return pa.table({"label": [label], "dim": pa.array([dim], pa.int32()), "tile": pa.array([at], pa.int32()), "tiles": pa.array([tiles], pa.int32()), "ids": [batch.column("node").to_pylist()], "counts": [batch.column("copies").to_pylist()], "q": pa.array([q.tobytes()], pa.binary()), "sizes": [np.concatenate(sizes)]})

    packed = materialise(filed.select(*key, "node", "copies", "x").groupBy(*key).applyInArrow(pack, TILE_SCHEMA), "tiles")
    at = ["label", "dim", "a_tile", "b_tile"]
    a = packed.withColumn("b_tile", F.explode(F.sequence(F.col("tile"), F.col("tiles") - 1))).withColumnRenamed("tile", "a_tile")
    a = a.select(*at, *[F.col(c).alias(f"a_{c}") for c in ("ids", "counts", "q", "sizes")])
    b = packed.withColumn("a_tile", F.explode(F.sequence(F.lit(0), F.col("tile")))).withColumnRenamed("tile", "b_tile")
    b = b.select(*at, *[F.col(c).alias(f"b_{c}") for c in ("ids", "counts", "q", "sizes")])
    pairs = a.join(b, at)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                place, rest = [batch.column(c)[k].as_py() for c in range(4)], [batch.column(c)[k] for c in range(4, 12)]
                one = place[2] == place[3]
                (ids_a, n_a, tile_a), (ids_b, n_b, tile_b) = (_tile(*rest[i : i + 4], place[1]) for i in (0, 4))
                sure, maybe = bounded_pairs(tile_a, tile_b, threshold, one)
                yield _links(place, ids_a if one else np.concatenate([ids_a, ids_b]), n_a if one else np.concatenate([n_a, n_b]), [(sure[0], sure[1] if one else sure[1] + len(ids_a))], (ids_a[maybe[0]], ids_b[maybe[1]]))

    def recompute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                place = [batch.column(c)[k].as_py() for c in range(4)]
                u, v = np.frombuffer(batch.column(4)[k].as_buffer(), "<i8").reshape(2, -1)
                vectors = batch.column(5)[k].values
                ids = np.asarray(vectors.field("node"))
                order = np.argsort(ids)
                ids, counts = ids[order], np.asarray(vectors.field("copies"))[order]
                x = unit(np.asarray(vectors.field("x").flatten()).reshape(len(ids), -1)[order])
                u, v = np.searchsorted(ids, u), np.searchsorted(ids, v)
                yield _links(place, ids, counts, exact_pairs(x, u, v, threshold), None)

    first = materialise(pairs.mapInArrow(released(compare), LINK_SCHEMA), "vector-links")
    # the vectors of the pairs that the bounds leave open: of a pair of tiles at most those of both
    asked = first.where("pairs is not null")
    needed = asked.select(*at, F.explode("nodes").alias("node")).join(classes.select("node", "copies", "x"), "node")
    needed = needed.groupBy(*at).agg(F.collect_list(F.struct("node", "copies", "x")).alias("vectors"))
    second = materialise(asked.select(*at, "pairs").join(needed, at).select(*at, "pairs", "vectors").mapInArrow(released(recompute), LINK_SCHEMA), "vector-links")
    spans = first.where("node is not null").unionByName(second).select("node", "links", "least_node")
    nodes = components(spans.select(F.col("node").alias("u"), F.col("least_node").alias("v")))
    known = classes.select(*same, "node", "least", "copies").join(nodes, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = known.join(spans.groupBy("node").agg(F.sum("links").alias("links")), "node", "left")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    known = known.join(names, "component").select(*same, (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    linked = fitting.select(*same, "vec_id").join(known, same).select("vec_id", "n_links", "component_id")
    alone = rows.where("not fit").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _tile(ids: pa.Scalar, counts: pa.Scalar, q: pa.Scalar, sizes: pa.Scalar, dim: int) -> tuple[np.ndarray, np.ndarray, Tile]:
    return np.asarray(ids.values), np.asarray(counts.values), Tile(np.frombuffer(q.as_buffer(), np.int8).reshape(-1, dim), *np.asarray(sizes.values).reshape(3, -1))


def exact_pairs(x: np.ndarray, u: np.ndarray, v: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Those of the pairs ``u, v`` of unit rows with cosine at least ``threshold`` in double precision, in bounded portions."""
    for lo in range(0, len(u), PAIRS):
        a, b = u[lo : lo + PAIRS], v[lo : lo + PAIRS]
        near = np.einsum("ij,ij->i", x[a], x[b]) >= threshold
        yield a[near], b[near]


def _links(place: list, ids: np.ndarray, counts: np.ndarray, pairs: Iterable[tuple[np.ndarray, np.ndarray]], maybe: tuple[np.ndarray, np.ndarray] | None) -> pa.RecordBatch:
    """Rows of :data:`LINK_SCHEMA`: one for each vector with links, and one for the pairs of nodes that are to be computed."""
    links, least = links_of(ids, counts, pairs)
    at = np.flatnonzero(links)
    rows = [[*place, int(node), int(n), int(to), None, None] for node, n, to in zip(ids[at], links[at], least[at], strict=True)]
    if maybe is not None and len(maybe[0]):
        rows.append([*place, None, None, None, np.concatenate(maybe).astype("<i8").tobytes(), np.unique(np.concatenate(maybe)).tolist()])
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _LINK]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _LINK, strict=True)], schema=_LINK)


_LINK = pa.schema([("label", pa.string()), *((c, pa.int32()) for c in ("dim", "a_tile", "b_tile")), *((c, pa.int64()) for c in ("node", "links", "least_node")), ("pairs", pa.binary()), ("nodes", pa.list_(pa.int64()))])
