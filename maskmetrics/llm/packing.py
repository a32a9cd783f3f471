"""Bulk-synchronous best-fit packing of documents into sequences of bounded length.

Pieces of equal length are interchangeable, and so are sequences with equal gaps.  So the
pieces are range-sorted by length once, which gives every piece its rank within its length,
and a superstep works on *runs*: ``(length, ranks from..to)`` against ``(gap, sequences
from..to)``.  In each superstep

1. piece runs and gap runs are merged in descending order, gaps first at equal size;
2. a successor sweep goes down that order and gives every piece the smallest gap that is
   large enough and still free, the way a closing bracket meets the last open one;
3. where several pieces want one gap the lower rank gets it, and the others go to the next
   larger gap or wait;
4. the gaps are updated; pieces that found none wait for the next superstep, and when no
   waiting piece fits, the largest open as many new sequences as their volume needs.

There are at most ``capacity`` lengths and ``capacity`` gaps, so the sweep handles a table
bounded by the capacity, whatever the corpus; sorting, ranking and placing are done by row
on the executors.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, released
from .encoding import MEMO_WORDS, encoder

PIECE_SCHEMA = "doc_id long, copy long, piece int, start long, length int, ids binary"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, by_word: bool = True, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Cut each document's ids (``end_id`` last) into pieces of at most ``capacity``.

    ``docs(doc_id, text)``; a null text counts as empty.  ``ids`` holds little-endian unsigned
    32-bit ids, ``copy`` numbers the input rows so that rows with one ``doc_id`` stay apart.
    """
    bounded_batches(docs.sparkSession)
    kind = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, row = encoder(tokenizer, by_word, memo_words), TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[list] = [[] for _ in kind]
            for key, raw in zip(batch.column(0).to_pylist(), enc.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(np.frombuffer(raw, enc.dtype).astype("<u4"), np.uint32(end_id))
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    for values, x in zip(out, (key, row, piece, at, len(part), part.tobytes()), strict=True):
                        values.append(x)
                row += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, kind, strict=True)], schema=kind)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(released(cut), PIECE_SCHEMA)


def sweep(lengths: list[tuple[int, int]], gaps: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """One successor sweep: ``(length, gap, count)`` of the pieces placed, in order of rank.

    ``lengths`` and ``gaps`` are ``(size, count)`` with distinct sizes.  Pieces are taken from the
    longest to the shortest; each gets the smallest free gap of at least its length, and each gap takes one piece.
    """
    lengths, gaps = sorted(lengths, reverse=True), sorted(gaps, reverse=True)
    free: list[list[int]] = []
    out, k = [], 0
    for length, n in lengths:
        while k < len(gaps) and gaps[k][0] >= length:
            free.append(list(gaps[k]))
            k += 1
        while n and free:
            took = min(n, free[-1][1])
            out.append((length, free[-1][0], took))
            n -= took
            free[-1][1] -= took
            if not free[-1][1]:
                free.pop()
    return out


def plan_runs(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Place ``histogram`` (length -> pieces) in supersteps.

    Returns moves ``(length, rank, count, sequence, offset)``: the pieces of that length with ranks
    ``rank .. rank + count - 1`` go to the sequences ``sequence ..``, one each, at ``offset``.
    """
    waiting = {n: c for n, c in histogram.items() if c}
    rank: dict[int, int] = defaultdict(int)
    gaps: dict[int, list[list[int]]] = defaultdict(list)  # gap -> runs of [first sequence, count]
    moves, opened = [], 0
    for length in [n for n in waiting if n == capacity]:
        moves.append((length, 0, waiting.pop(length), opened, 0))
        opened += moves[-1][2]
    while waiting:
        # the class of this superstep: lengths over half of the longest waiting one
        longest = max(waiting)
        own = {n: c for n, c in waiting.items() if 2 * n > longest}
        placed = sweep(list(own.items()), [(g, sum(c for _, c in runs)) for g, runs in gaps.items() if 2 * g > longest])
        if not placed:
            # none of the class fits: its volume, largest pieces first, opens new sequences
            need = -(-sum(n * c for n, c in own.items()) // capacity)
            for length in sorted(own, reverse=True):
                take = min(need, own[length])
                if take:
                    gaps[capacity].append([opened, take])
                    opened += take
                    need -= take
                    placed.append((length, capacity, take))
        fresh: list[tuple[int, list[int]]] = []
        for length, gap, count in placed:
            waiting[length] -= count
            if not waiting[length]:
                del waiting[length]
            while count:
                run = gaps[gap][-1]
                take = min(count, run[1])
                moves.append((length, rank[length], take, run[0], capacity - gap))
                rank[length] += take
                if gap > length:
                    fresh.append((gap - length, [run[0], take]))
                run[0] += take
                run[1] -= take
                count -= take
                if not run[1]:
                    gaps[gap].pop()
            if not gaps[gap]:
                del gaps[gap]
        for gap, run in fresh:  # gaps change only between supersteps
            gaps[gap].append(run)
    return moves


def rank_pieces(pieces: DataFrame) -> tuple[DataFrame, dict[int, int]]:
    """``pieces`` range-sorted by length, with each one's rank within its length, and the number of pieces of each length.

    Each task numbers its own share; a table of one row per task and length, which the range
    sort bounds by tasks + lengths, carries the numbers on.
    """
    narrow = pieces.select("doc_id", "copy", "piece", "length")
    kind = pa.schema([("doc_id", pa.int64()), ("copy", pa.int64()), ("piece", pa.int32()), ("length", pa.int32()), ("part", pa.int32()), ("own_rank", pa.int64())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            n = batch.column(3).to_numpy()
            own = np.empty(len(n), np.int64)
            cuts = np.flatnonzero(np.diff(n)) + 1  # rows come sorted by length
            for lo, hi in zip([0, *cuts], [*cuts, len(n)], strict=True):
                if hi > lo:
                    own[lo:hi] = np.arange(hi - lo) + seen[int(n[lo])]
                    seen[int(n[lo])] += int(hi - lo)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(np.full(len(n), part, np.int32)), pa.array(own)], schema=kind)

    ordered = narrow.repartitionByRange("length", "doc_id", "copy", "piece").sortWithinPartitions("length", "doc_id", "copy", "piece")
    ranked = materialise(ordered.mapInArrow(released(number), "doc_id long, copy long, piece int, length int, part int, own_rank long"), "ranked")
    counts = sorted(ranked.groupBy("length", "part").count().collect())
    before: dict[int, int] = defaultdict(int)
    offsets = []
    for length, part, n in counts:
        offsets.append((length, part, before[length]))
        before[length] += n
    spark = pieces.sparkSession
    base = spark.createDataFrame(offsets, "length int, part int, base long")
    ranked = ranked.join(F.broadcast(base), ["length", "part"]).select("doc_id", "copy", "piece", "length", (F.col("own_rank") + F.col("base")).alias("rank"))
    return ranked, dict(before)


def place(pieces: DataFrame, capacity: int) -> DataFrame:
    """``doc_id, copy, piece, sequence_id, offset`` for every piece of ``pieces(doc_id, copy, piece, length)``.

    ``length`` is from 1 to ``capacity``.  Ties are broken by ``doc_id, copy, piece``.  An empty table gives no rows.
    """
    ranked, histogram = rank_pieces(pieces)
    moves = plan_runs(histogram, capacity)
    firsts: dict[int, list[tuple]] = defaultdict(list)
    for length, rank, count, sequence, offset in moves:
        firsts[length].append((rank, count, sequence, offset))
    table = {n: tuple(np.array(x, np.int64) for x in zip(*sorted(v), strict=True)) for n, v in firsts.items()}

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            seq, off = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                first, _, sequence, offset = table[int(n)]
                k = np.searchsorted(first, ranks[at], "right") - 1
                seq[at], off[at] = sequence[k] + ranks[at] - first[k], offset[k]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(3)), pa.array(seq), pa.array(off)], names=["doc_id", "copy", "piece", "sequence_id", "offset"])

    return ranked.mapInArrow(released(put), "doc_id long, copy long, piece int, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 4096, memo_words: int = MEMO_WORDS) -> tuple[DataFrame, DataFrame]:
    """Pack ``docs(doc_id, text)`` into sequences; returns the pieces with their ids, and their places.

    A null text is empty (the end id alone), a null ``doc_id`` is kept, repeated rows are packed
    each, other columns are ignored, an empty table gives no rows.  Only documents of more than
    ``capacity`` ids are cut.  ``memo_words`` bounds what a worker remembers of words.  Both tables share the key ``copy, piece``.
    """
    pieces = materialise(token_pieces(docs, tokenizer, end_id, capacity, memo_words=memo_words), "pieces")
    return pieces, place(pieces, capacity).drop("doc_id")


def sequences(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """``sequence_id, ids``: the packed sequences themselves, ids little-endian unsigned 32-bit."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # bounded by the capacity
    joined = F.aggregate(F.transform(parts, lambda x: x["ids"]), F.lit(b""), lambda a, x: F.concat(a, x))
    return pieces.join(places, ["copy", "piece"]).groupBy("sequence_id").agg(joined.alias("ids"))


def packing_digest(pieces: DataFrame, places: DataFrame) -> DataFrame:
    """One row per piece: its place and a checksum of its ids, taken before the join so that no ids are shuffled."""
    narrow = pieces.select("copy", "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), F.crc32("ids").alias("ids_crc32"))
    return narrow.join(places, ["copy", "piece"]).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
