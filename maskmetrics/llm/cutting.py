"""Packing by cutting-stock column generation.

A sequence is a roll of ``capacity`` tokens, a document's length an order.  Lengths are gathered in a bounded number of classes, so
the linear program has a bounded size whatever the corpus:

1. a pattern says how many pieces of each class fill one sequence; the program asks for the fewest sequences that use up all pieces;
2. a knapsack over the program's prices finds the pattern that would improve it most, which enters the basis, until no pattern pays;
3. patterns are used whole as often as the program says, rounded down, and the few pieces left over get patterns of their own;
4. the pieces of each class are ranked on the executors, and their ranks are dealt to the patterns' places.

A pattern counts every piece as long as its class allows, so its sequences keep small gaps.  A stream of further documents, cut
freely, fills these exactly: documents that are longer than a sequence and are cut anyway, then others, as few as the gaps need.
What is left of the stream fills whole sequences and powers of two, so that nothing is padded.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .common import materialise, released
from .encoding import MEMO_WORDS
from .packing import token_pieces

#: Classes of lengths, and levels by which pieces join the stream: as many for cut documents as for whole ones.
CLASSES, LEVELS = 128, 32
#: Tokens of the stream that one window looks at.
STREAM_BLOCK = 1 << 16
#: The program may end within this part of its optimum, or after so many steps; either leaves a complete plan.
TOLERANCE, STEPS = 5e-4, 500


def class_tops(histogram: dict[int, int], most: int = CLASSES) -> list[int]:
    """The largest length of each of at most ``most`` classes: classes are split where that saves most tokens of roundup."""
    lengths = np.array(sorted(n for n, c in histogram.items() if c), np.int64)
    counts = np.array([histogram[int(n)] for n in lengths], np.int64)
    number, tokens = (np.concatenate([[0], np.cumsum(x)]) for x in (counts, counts * lengths))

    def best(lo: int, hi: int) -> tuple[int, int]:
        """What the best split of ``lengths[lo:hi]`` saves, and where it lies."""
        cuts = np.arange(lo + 1, hi)
        if not len(cuts):
            return 0, hi
        saved = (lengths[hi - 1] - lengths[cuts - 1]) * (number[cuts] - number[lo])
        k = int(saved.argmax())
        return int(saved[k]), int(cuts[k])

    spans = [(0, len(lengths), *best(0, len(lengths)))] if len(lengths) else []
    while len(spans) < most:
        k = max(range(len(spans)), key=lambda k: spans[k][2], default=None)
        if k is None or spans[k][2] <= 0:
            break
        lo, hi, _, cut = spans.pop(k)
        spans += [(lo, cut, *best(lo, cut)), (cut, hi, *best(cut, hi))]
    return sorted(int(lengths[hi - 1]) for _, hi, _, _ in spans)


def knapsack(sizes: Sequence[int], values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern of at most ``capacity``, any number of each size; values under 0 are not used."""
    worth = [np.zeros(capacity + 1)]
    for size, value in zip(sizes, values, strict=True):
        last = worth[-1]
        if value <= 0:
            worth.append(last)
            continue
        # down the columns of rows of ``size`` capacities, one more piece a row
        rows = -(-(capacity + 1) // size)
        table = np.full(rows * size, -np.inf)
        table[: capacity + 1] = last
        paid = value * np.arange(rows)[:, None]
        worth.append((np.maximum.accumulate(table.reshape(rows, size) - paid, axis=0) + paid).ravel()[: capacity + 1])
    pattern, left = np.zeros(len(sizes), np.int64), capacity
    for k in range(len(sizes) - 1, -1, -1):
        while left >= sizes[k] and worth[k + 1][left] > worth[k][left] + 1e-12:
            pattern[k] += 1
            left -= sizes[k]
    return float(worth[-1][capacity]), pattern


def inverse_of(matrix: np.ndarray) -> np.ndarray:
    """The inverse of a small matrix by elimination; not by the linear algebra library, whose threads can hang beside a JVM."""
    n = len(matrix)
    both = np.hstack([matrix, np.eye(n)])
    for k in range(n):
        pivot = k + int(np.abs(both[k:, k]).argmax())
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= factors[:, None] * both[k]
    return both[:, n:]


def patterns_for(sizes: Sequence[int], demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The linear program by column generation: patterns as columns, and how often each is used (a fraction)."""
    sizes, demand = np.asarray(sizes), np.asarray(demand, float)
    basis, uses, left = np.diag((capacity // sizes).astype(float)), np.zeros(len(sizes)), demand.copy()
    while left.any():  # to begin with, greedy patterns, each used until it has used up a class: together a triangle
        pattern, room = np.zeros(len(sizes)), capacity
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = room // sizes[k]
            room -= pattern[k] * sizes[k]
        ratio = np.where(pattern > 0, left / np.maximum(pattern, 1), np.inf)
        k = int(ratio.argmin())
        basis[:, k], uses[k] = pattern, ratio[k]
        left = left - ratio[k] * pattern
        left[(left < 1e-9 * demand) | (np.arange(len(left)) == k)] = 0
    inverse = inverse_of(basis)
    least = float((sizes * demand).sum()) / capacity
    for step in range(1, STEPS + 1):
        prices, total = inverse.sum(axis=0), uses.sum()
        if total <= least * (1 + TOLERANCE):
            break
        value, pattern = knapsack(sizes, prices, capacity)
        if value <= 1 + 1e-9 or total - total / value <= TOLERANCE * total:  # the prices over the value bound every solution
            break
        entering = (inverse * pattern).sum(axis=1)
        ratio = np.where(entering > 1e-9, uses / np.maximum(entering, 1e-9), np.inf)
        out = int(ratio.argmin())
        uses = np.maximum(uses - ratio[out] * entering, 0)
        uses[out] = ratio[out]
        basis[:, out] = pattern
        if step % 50:
            row = inverse[out] / entering[out]
            inverse -= np.outer(entering, row)
            inverse[out] = row
        else:
            inverse = inverse_of(basis)
            uses = np.maximum((inverse * demand).sum(axis=1), 0)
    return basis.astype(np.int64), uses


class Plan(NamedTuple):
    """Classes by their largest length, and the runs of each class: ``(first rank, times, first sequence)``, one for each place of a pattern."""

    tops: list[int]
    runs: list[list[tuple[int, int, int]]]
    sequences: int


def plan_cuts(histogram: dict[int, int], capacity: int, classes: int = CLASSES) -> Plan:
    """Whole patterns for all pieces of ``histogram`` (length -> pieces)."""
    tops = class_tops(histogram, classes)
    if not tops:
        return Plan([], [], 0)
    demand = np.zeros(len(tops), np.int64)
    for n, c in histogram.items():
        demand[np.searchsorted(tops, n)] += c
    columns, uses = patterns_for(tops, demand.astype(float), capacity)
    whole = np.floor(uses + 1e-9).astype(np.int64)
    for k in np.flatnonzero(columns @ whole > demand):  # by the last bits of very many uses
        while (columns[k] @ whole) > demand[k]:
            whole[np.flatnonzero((columns[k] > 0) & (whole > 0))[0]] -= 1
    chosen = [(columns[:, j], int(whole[j])) for j in np.flatnonzero(whole)]
    left = demand - columns @ whole
    while left.any():  # at most a pattern's worth for each class
        pattern, room = np.zeros(len(tops), np.int64), capacity
        for k in np.flatnonzero(left)[::-1]:
            pattern[k] = min(left[k], room // tops[k])
            room -= pattern[k] * tops[k]
        times = int((left[pattern > 0] // pattern[pattern > 0]).min())
        chosen.append((pattern, times))
        left = left - times * pattern
    runs: list[list[tuple[int, int, int]]] = [[] for _ in tops]
    rank, sequence = [0] * len(tops), 0
    for pattern, times in chosen:
        for k in np.flatnonzero(pattern):
            for _ in range(int(pattern[k])):
                runs[k].append((rank[k], times, sequence))
                rank[k] += times
        sequence += times
    return Plan(tops, runs, sequence)


def choose_stream(counts: dict[tuple[int, int], int], capacity: int, classes: int = CLASSES) -> tuple[int, Plan, int]:
    """The level under which pieces join the stream, the plan of the others, and the tokens of their gaps.

    ``counts`` has the pieces by length and level.  The stream takes as few levels as fill the gaps; pieces of full length need no plan.
    """
    stream = [0] * (2 * LEVELS + 1)
    for (length, level), n in counts.items():
        stream[level + 1] += length * n
    stream = np.cumsum(stream).tolist()
    below, ahead = 0, 1
    while True:
        histogram: dict[int, int] = defaultdict(int)
        for (length, level), n in counts.items():
            if level >= below and length < capacity:
                histogram[length] += n
        if not below:  # the roundup alone is a first guess
            tops = class_tops(histogram, classes)
            guess = sum(c * (tops[int(np.searchsorted(tops, n))] - n) for n, c in histogram.items())
            if guess:
                below = next(k for k, tokens in enumerate(stream) if tokens >= guess or k == 2 * LEVELS)
                continue
        plan = plan_cuts(histogram, capacity, classes)
        gaps = plan.sequences * capacity - sum(n * c for n, c in histogram.items())
        if gaps <= stream[below]:
            return below, plan, gaps
        enough = next(k for k, tokens in enumerate(stream) if tokens >= gaps or k == 2 * LEVELS)
        below, ahead = min(2 * LEVELS, max(enough, below + ahead)), 2 * ahead  # few plans even where each leaves more gaps


def running(rows: DataFrame, order: Sequence[str], group: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows of the same ``group`` that come before, as ``name``.

    The rows are range-sorted by ``order``, in which groups must not interleave.  Each task sums its own rows; a table of one row per
    task and group, bounded by tasks + groups, carries the sums on.
    """
    schema = StructType([*rows.schema.fields, StructField("_part", IntegerType()), StructField("_own", LongType())])
    kind = to_arrow_schema(schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            groups, values = batch.column(group).to_numpy(), batch.column(value).to_numpy().astype(np.int64)
            own = np.cumsum(values) - values
            cuts = [0, *(np.flatnonzero(np.diff(groups)) + 1).tolist(), len(groups)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    key, total = int(groups[lo]), int(own[hi - 1] + values[hi - 1] - own[lo])
                    own[lo:hi] += seen[key] - own[lo]
                    seen[key] += total
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(own), part, np.int32)), pa.array(own)], schema=kind)

    summed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(released(add), schema), "running")
    before: dict[int, int] = defaultdict(int)
    bases = []
    for key, part, total in sorted(summed.groupBy(group, "_part").agg(F.sum(value)).collect()):
        bases.append((key, part, before[key]))
        before[key] += total
    bases = rows.sparkSession.createDataFrame(bases, f"{group} {rows.schema[group].dataType.simpleString()}, _part int, _base long")
    return summed.join(F.broadcast(bases), [group, "_part"]).withColumn(name, F.col("_own") + F.col("_base")).select(*rows.columns, name)


def deal(pieces: DataFrame, plan: Plan, capacity: int) -> DataFrame:
    """``copy, start, length, sequence_id, offset, used`` of the pieces ``(copy, start, length)``: their places by the plan, and the sequence's tokens.

    Pieces of a class are ranked by length, then ``copy, start``; pieces of full length follow in sequences of their own.
    """
    tops = plan.tops
    narrow = pieces.select("copy", "start", "length")

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(2).to_numpy()
            own = np.where(lengths == capacity, len(tops), np.searchsorted(tops, lengths))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(np.ones(len(own), np.int64))], names=["copy", "start", "length", "class", "one"])

    filed = narrow.mapInArrow(released(classes), "copy long, start long, length int, class int, one long")
    ranked = running(filed, ["length", "copy", "start"], "class", "one", "rank")
    runs = [tuple(np.array(x, np.int64) for x in zip(*own, strict=True)) for own in [*plan.runs, [(0, 1 << 62, plan.sequences)]]]

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, ranks = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            sequence, place = np.empty(len(own), np.int64), np.empty(len(own), np.int32)
            for k in np.unique(own):
                at = np.flatnonzero(own == k)
                first, _, start = runs[int(k)]
                run = np.searchsorted(first, ranks[at], "right") - 1
                sequence[at], place[at] = start[run] + ranks[at] - first[run], run
            columns = [*(batch.column(c) for c in ("copy", "start", "length", "class")), pa.array(place), pa.array(sequence)]
            yield pa.RecordBatch.from_arrays(columns, names=["copy", "start", "length", "class", "place", "sequence_id"])

    placed = ranked.mapInArrow(released(put), "copy long, start long, length int, class int, place int, sequence_id long")
    within = Window.partitionBy("sequence_id")  # at most a sequence's tokens
    before = within.orderBy("class", "place").rowsBetween(Window.unboundedPreceding, 0)
    return placed.select("copy", "start", "length", "sequence_id", (F.sum("length").over(before) - F.col("length")).alias("offset"), F.sum("length").over(within).alias("used"))


def _filed(rows: DataFrame) -> DataFrame:
    """Stretches ``lo, hi`` of the stream under each block that they meet, with their first token there as ``at``."""
    block = F.explode(F.sequence(F.expr(f"lo div {STREAM_BLOCK}"), F.expr(f"(hi - 1) div {STREAM_BLOCK}"))).alias("block")
    return rows.select("*", block).withColumn("at", F.greatest("lo", F.col("block") * STREAM_BLOCK))


def pour(gaps: DataFrame, stream: DataFrame) -> DataFrame:
    """``copy, start, from, length, sequence_id, offset``: which part of which piece fills what.

    ``gaps(lo, hi, sequence_id, used)`` and ``stream(lo, hi, copy, start)`` both cover the stream's tokens without holes.  Their
    starts are put in order block by block, where each row knows the last gap and the last piece that began.
    """
    places = _filed(gaps).select("block", "at", F.struct("lo", "hi", "sequence_id", "used").alias("gap"))
    parts = _filed(stream).select("block", "at", F.struct("lo", "hi", "copy", "start").alias("own"))
    both = places.unionByName(parts, allowMissingColumns=True)
    order = Window.partitionBy("block").orderBy("at")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    until = F.coalesce(F.lead("at").over(order), (F.col("block") + 1) * STREAM_BLOCK)
    known = both.select("at", until.alias("until"), *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in ("gap", "own")])
    end = F.least("until", "gap.hi", "own.hi")
    cut = known.withColumn("length", (end - F.col("at")).cast("int")).where("length > 0 and gap is not null and own is not null")
    return cut.select("own.copy", "own.start", (F.col("at") - F.col("own.lo")).alias("from"), "length", "gap.sequence_id", (F.col("gap.used") + F.col("at") - F.col("gap.lo")).alias("offset"))


def _level(capacity: int) -> Column:
    """By chance from 0; documents that fit into a sequence come after all that are cut anyway."""
    return (F.pmod(F.xxhash64("copy", "start"), F.lit(LEVELS)) + F.when(F.col("doc_tokens") <= capacity, LEVELS).otherwise(0)).cast("int")


def place_pieces(pieces: DataFrame, capacity: int, classes: int = CLASSES) -> tuple[DataFrame, DataFrame, Column]:
    """Places of ``pieces(copy, start, length, doc_tokens)``: of those that stay whole, ``copy, start, length, sequence_id, offset``, and of parts
    of the others, with ``from``, the part's first token within its piece; and the condition by which a piece is one of the others."""
    spark = pieces.sparkSession
    leveled = pieces.withColumn("level", _level(capacity))
    counts = {(r["length"], r["level"]): r["count"] for r in leveled.groupBy("length", "level").count().collect()}  # lengths x levels at most
    below, plan, gaps = choose_stream(counts, capacity, classes)
    placed = materialise(deal(leveled.where(F.col("level") >= below), plan, capacity), "placed")
    whole = placed.drop("used")

    last = placed.where(f"offset + length = used and used < {capacity}").select("sequence_id", "used", (F.lit(capacity) - F.col("used")).alias("gap"), F.lit(0).alias("group"))
    open_ = running(last, ["sequence_id"], "group", "gap", "lo").select("lo", (F.col("lo") + F.col("gap")).alias("hi"), "sequence_id", "used")
    full = sum(n for (length, level), n in counts.items() if level >= below and length == capacity)
    tokens, first = sum(length * n for (length, level), n in counts.items() if level < below), plan.sequences + full
    spare = tokens - gaps
    rows = spark.range(spare // capacity).select((F.lit(gaps) + F.col("id") * capacity).alias("lo"), (F.lit(gaps) + (F.col("id") + 1) * capacity).alias("hi"), (F.lit(first) + F.col("id")).alias("sequence_id"), F.lit(0).cast("long").alias("used"))
    at, end, sizes = gaps + spare // capacity * capacity, first + spare // capacity, []
    for k in range(capacity.bit_length(), -1, -1):  # the rest in powers of two
        if spare % capacity >> k & 1:
            sizes.append((at, at + (1 << k), end + len(sizes), 0))
            at += 1 << k
    rest = spark.createDataFrame(sizes, "lo long, hi long, sequence_id long, used long")
    stream = leveled.where(F.col("level") < below).select("copy", "start", "length", F.lit(0).alias("group"))
    stream = running(stream, ["copy", "start"], "group", "length", "lo").select("lo", (F.col("lo") + F.col("length")).alias("hi"), "copy", "start")
    return whole, pour(open_.unionByName(rows).unionByName(rest), stream), _level(capacity) < below


def cut_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, classes: int = CLASSES, memo_words: int = MEMO_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pack ``docs(doc_id, text)``: the pieces with their ids, the places of those that stay whole and of parts of the others.

    A null text is empty (the end id alone), a null ``doc_id`` is kept, repeated rows are packed each, other columns are ignored,
    an empty table gives no rows.  ``capacity`` is a power of two.  The pieces ``doc_id, copy, start, length, doc_tokens, ids, cut``
    (little-endian unsigned 32-bit ids) are documents, or of longer ones parts of ``capacity`` and a shorter last one; ``cut`` ones
    are cut further.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError(f"the capacity must be a power of two, not {capacity}")
    tokens = token_pieces(docs, tokenizer, end_id, 1 << 40, memo_words=memo_words)
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length").cast("long") - 1, F.lit(capacity).cast("long"))).alias("start")
    cut = tokens.select("doc_id", "copy", F.col("length").cast("long").alias("doc_tokens"), "ids", starts)
    length = F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start")).cast("int").alias("length")
    pieces = cut.select("doc_id", "copy", "start", length, "doc_tokens", F.substring("ids", (4 * F.col("start") + 1).cast("int"), F.lit(4 * capacity)).alias("ids"))
    pieces = materialise(pieces, "pieces")
    whole, parts, cut = place_pieces(pieces.drop("ids"), capacity, classes)
    return pieces.withColumn("cut", cut), whole, parts


def cutting_digest(pieces: DataFrame, whole: DataFrame, parts: DataFrame) -> DataFrame:
    """One row per piece with its place and a checksum of its ids; only the ids of the pieces that are cut further are shuffled."""
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    narrow = pieces.where(~F.col("cut")).select("copy", "doc_id", "start", F.col("length").cast("long").alias("length"), "doc_tokens", F.crc32("ids").alias("ids_crc32"))
    first = narrow.join(whole.drop("length"), ["copy", "start"]).select(*columns)
    ids = pieces.where("cut").select("copy", "start", "doc_id", "doc_tokens", "ids")
    own = F.substring("ids", (4 * F.col("from") + 1).cast("int"), 4 * F.col("length"))
    second = ids.join(parts, ["copy", "start"]).select(
        "doc_id", (F.col("start") + F.col("from")).alias("start"), F.col("length").cast("long").alias("length"), F.crc32(own).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
    return first.unionByName(second)


def cut_sequences(pieces: DataFrame, whole: DataFrame, parts: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves."""
    own = F.substring("ids", (4 * F.col("from") + 1).cast("int"), 4 * F.col("length"))
    places = whole.withColumn("from", F.lit(0).cast("long")).unionByName(parts)
    rows = pieces.select("copy", "start", "ids").join(places, ["copy", "start"]).select("sequence_id", "offset", own.alias("ids"))
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # bounded by the capacity
    return rows.groupBy("sequence_id").agg(F.aggregate(F.transform(ordered, lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"))
