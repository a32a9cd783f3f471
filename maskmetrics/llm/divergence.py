"""How far the sources of a language are apart in their words: sketch-prefiltered counting.

1. A first reading merges the document frequencies of all tasks in a count-min sketch.  Its cells stop at the frequency asked for,
   so a merged cell is one bit: reached or not.  A cell never holds less than any of its terms, so a term with one cell short of
   the mark is impossible.
2. A second reading counts terms by language and source within each task and drops the impossible ones before anything is
   shuffled; the others are counted exactly, and those that the sketch let pass wrongly go then.
3. Two sources are compared by a sparse join: terms that neither has cost nothing, terms that one has are summed over its counts
   (not its terms), and only terms that both have are joined.

Results do not depend on the sketch; its size decides how many rows are shuffled.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import bounded_batches, materialise, released

#: Letters of a term: A-Z in lower case, and every byte of a character beyond ASCII; all others part terms.
TERM_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
#: Rows of the sketch, cells of one block, and the least and most cells of a row; the most need 32 MB as bits.
DEPTH, BLOCK, LEAST_WIDTH, MOST_WIDTH = 4, 1 << 16, 1 << 16, 1 << 26
#: Cells of a row for each document, within these bounds.
CELLS_PER_DOC = 32
#: Tasks whose sketches are added in the first of two rounds.
FAN = 64
#: Terms that a task holds before it hands on what it has.
HELD_TERMS = 500_000


def _texts(docs: DataFrame) -> DataFrame:
    bounded_batches(docs.sparkSession)
    empty = F.lit("")
    return docs.select(*[F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source")], F.coalesce("text", empty).cast("binary").alias("text"))


def _terms(raw: bytes) -> list[bytes]:
    return raw.translate(TERM_BYTES).split()


def cells_of(lang: str, terms: Iterable[bytes], width: int) -> np.ndarray:
    """The cells of a language's terms, one row of the result for each row of the sketch; ``width`` is a power of two."""
    h = np.fromiter(map(xxh64_intdigest, terms, repeat(crc32(lang.encode()))), np.uint64)
    first, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    return np.stack([((first + np.uint64(k) * step) & np.uint64(width - 1)).astype(np.int64) + k * width for k in range(DEPTH)])


def _added(into: np.ndarray, at: np.ndarray, values: np.ndarray, most: int) -> None:
    into[at] = np.minimum(into[at].astype(np.int64) + values, most).astype(into.dtype)


def reached(docs: DataFrame, least: int, width: int, held: int = HELD_TERMS) -> np.ndarray:
    """The merged sketch of ``docs(text, lang, source)`` as bits: which of its ``DEPTH * width`` cells reach ``least`` documents.

    Each task sends the cells that its terms set, by blocks; blocks are added for ``FAN`` tasks at a time, then for all.  What reaches
    the driver has a fixed size, an eighth of a byte a cell.
    """
    kind = pa.schema([("part", pa.int64()), ("block", pa.int32()), ("n", pa.int32()), ("cells", pa.binary())])
    dtype = np.min_scalar_type(least)

    def messages(part: int, at: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
        """Sorted cells by block: their places within it, then their values."""
        values = np.minimum(values, least).astype(dtype)
        blocks, cuts = np.unique(at // BLOCK, return_index=True)
        spans = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=True))
        raw = [(at[lo:hi] % BLOCK).astype("<u2").tobytes() + values[lo:hi].tobytes() for lo, hi in spans]
        return pa.RecordBatch.from_arrays([pa.array([part] * len(raw), pa.int64()), pa.array(blocks, pa.int32()), pa.array([hi - lo for lo, hi in spans], pa.int32()), pa.array(raw, pa.binary())], schema=kind)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, within = TaskContext.get().partitionId(), defaultdict(Counter)

        def summed() -> pa.RecordBatch:
            at = np.concatenate([cells_of(lang, counts, width).ravel() for lang, counts in within.items()])
            docs = np.concatenate([np.tile(np.fromiter(counts.values(), np.int64, len(counts)), DEPTH) for counts in within.values()])
            places, which = np.unique(at, return_inverse=True)
            return messages(part, places, np.bincount(which, docs, len(places)))

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                within[lang].update(set(_terms(raw)))
            if sum(map(len, within.values())) > held:
                yield summed()
                within.clear()
        if within:
            yield summed()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray]]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, block, n, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                cells = sums.get((part, block))
                if cells is None:
                    cells = sums[part, block] = np.zeros(BLOCK, dtype)
                _added(cells, np.frombuffer(raw, "<u2", n), np.frombuffer(raw, dtype, n, 2 * n), least)
        for (part, block), cells in sums.items():
            yield part, block, cells

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, cells in merged(batches):
            at = np.flatnonzero(cells)
            yield messages(part, at + block * BLOCK, cells[at])

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block, cells in merged(batches):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(cells >= least).tobytes()], pa.binary())], names=["block", "bits"])

    schema = "part long, block int, n int, cells binary"
    parts = _texts(docs).mapInArrow(released(own), schema)
    first = parts.withColumn("part", F.floor(F.col("part") / FAN)).repartition("part", "block").mapInArrow(released(some), schema)
    whole = first.withColumn("part", F.lit(0).cast("long")).repartition("block").mapInArrow(released(last), "block int, bits binary")
    bits = np.zeros(DEPTH * width // 8, np.uint8)
    for row in whole.collect():  # DEPTH * width / BLOCK rows
        bits[row["block"] * BLOCK // 8 : (row["block"] + 1) * BLOCK // 8] = np.frombuffer(row["bits"], np.uint8)
    return bits


def possible(lang: str, terms: Iterable[bytes], bits: np.ndarray, width: int) -> np.ndarray:
    """Which terms have all their cells set."""
    at = cells_of(lang, terms, width)
    return ((bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def term_counts(docs: DataFrame, bits: np.ndarray, width: int, held: int = HELD_TERMS) -> DataFrame:
    """``lang, source, term, count, docs``: what each task counts of the possible terms of ``docs(text, lang, source)``, in any number of rows a term.

    Nulls are empty.  Every language and source also gives rows with an empty term and no count.
    """
    kind = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("count", pa.int64()), ("docs", pa.int64())])
    Groups = dict[tuple[str, str], tuple[dict[bytes, int], dict[bytes, int]]]

    def survivors(groups: Groups) -> Groups:
        out = {}
        for (lang, source), both in groups.items():
            terms = list(both[0])
            passed = [t for t, ok in zip(terms, possible(lang, terms, bits, width).tolist(), strict=True) if ok]
            out[lang, source] = tuple(Counter({t: counts[t] for t in passed}) for counts in both)
        return out

    def handed(groups: Groups) -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, within) in groups.items():
            terms = [b"", *counts]
            n = len(terms)
            columns = [pa.repeat(pa.scalar(lang), n), pa.repeat(pa.scalar(source), n), pa.array(terms, pa.binary()), pa.array([0, *counts.values()], pa.int64()), pa.array([0, *map(within.__getitem__, counts)], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=kind)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: Groups = {}
        for batch in batches:
            for lang, source, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                counts, within = groups.setdefault((lang, source), (Counter(), Counter()))
                words = _terms(raw)
                counts.update(words)
                within.update(set(words))
            if sum(len(counts) + 1 for counts, _ in groups.values()) > held:
                groups = survivors(groups)
                if 2 * sum(len(counts) + 1 for counts, _ in groups.values()) > held:
                    yield from handed(groups)
                    groups = {}
        yield from handed(survivors(groups))

    found = _texts(docs).mapInArrow(released(count), "lang string, source string, term binary, count long, docs long")
    return found.withColumn("term", F.col("term").cast("string"))


def _p(count: str, n: str) -> Column:
    """One part in 10 ** 9 at least: the smoothed share of a term, rounded down exactly; 0 if the language keeps no term."""
    share = f"(cast(1000000000 as decimal(10,0)) * cast({count} + 5 as decimal(20,0))) div cast({n} + 5 * v as decimal(20,0))"
    return F.expr(f"if(v > 0, 1 + {share}, 0L)")


def kept_counts(docs: DataFrame, least: int = 30, width: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Exact counts of the terms that are in at least ``least`` documents of their language, and the groups.

    The first table is ``lang, source, term, count, total``, for sources that have the term (``total``: in the language); the
    second ``lang, source, n, v, lang_n`` for every language and source, with the counts of all kept terms in the source and the
    language, and the number of kept terms.  ``width`` is that of the sketch, a power of two from ``LEAST_WIDTH`` on; by default it
    follows the number of documents, within bounds.
    """
    if least < 1:
        raise ValueError("a term must be in one document at least")
    if width is None:
        width = max(LEAST_WIDTH, min(MOST_WIDTH, 1 << (CELLS_PER_DOC * docs.count()).bit_length()))
    found = term_counts(docs, reached(docs, least, width), width)
    exact = materialise(found.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs")), "counts")
    groups, exact = exact.where("term = ''").select("lang", "source"), exact.where("term <> ''")
    whole = exact.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("total")).where(F.col("docs") >= least).drop("docs")
    kept = materialise(exact.drop("docs").join(whole, ["lang", "term"]).select("lang", "source", "term", "count", "total"), "kept")
    sizes = kept.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    languages = whole.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("lang_n"))
    groups = groups.join(sizes, ["lang", "source"], "left").join(languages, "lang", "left")
    return kept, materialise(groups.na.fill(0, ["n", "v", "lang_n"]), "groups")


def divergence(docs: DataFrame, least: int = 30, top: int = 50, width: int | None = None) -> DataFrame:
    """``lang, source, part, item, value, rank`` for each language and source of ``docs(text, lang, source)``.

    Part ``pair`` has all other sources of the language by the sum of the differences of their terms' shares, part ``term`` the
    ``top`` terms whose share is furthest over the language's.  Shares are in parts of 10 ** 9, all arithmetic is exact; ranks go by
    descending value, then by the item's bytes.  Null text, lang and source count as empty; repeated rows count each; other
    columns are ignored; an empty table gives no rows, a language without kept terms pairs of value 0.
    """
    kept, groups = kept_counts(docs, least, width)
    shares = materialise(
        kept.join(groups, ["lang", "source"]).select("lang", "source", "term", "count", _p("count", "n").alias("p"), _p("total", "lang_n").alias("q"), _p("0", "n").alias("zero")),
        "shares",
    )
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    zeros = groups.select("lang", "source", "v", _p("0", "n").alias("zero"))
    other = zeros.select("lang", F.col("source").alias("other"), F.col("zero").alias("other_zero"))
    apart = F.abs(F.col("zero") - F.col("other_zero"))
    pairs = zeros.join(other, "lang").where("source < other").select("lang", "source", "other", (F.col("v") * apart).alias("value"))  # the result's own pairs
    ordered = [F.least("source", "other").alias("source"), F.greatest("source", "other").alias("other")]
    alike = shares.groupBy("lang", "source", "p", "zero").agg(F.count("*").alias("n"))
    one = alike.join(other, "lang").where("source <> other").select("lang", *ordered, (F.col("n") * (F.abs(F.col("p") - F.col("other_zero")) - apart)).alias("value"))
    right = shares.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("other_p"), F.col("zero").alias("other_zero"))
    both = shares.drop("count", "q").join(right, ["lang", "term"]).where("source < other")
    lone = F.abs(F.col("p") - F.col("other_zero")) + F.abs(F.col("zero") - F.col("other_p"))
    both = both.select("lang", "source", "other", (F.abs(F.col("p") - F.col("other_p")) - lone + apart).alias("value"))
    summed = pairs.unionByName(one).unionByName(both).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))).alias("way")
    ranked = summed.select("lang", ways, "value").select("lang", "way.source", F.lit("pair").alias("part"), "way.item", "value").withColumn("rank", F.row_number().over(best))
    return ranked.unionByName(terms)
