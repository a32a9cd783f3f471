"""Benchmark passages in documents, found by the q-gram lemma and verified by banded alignment.

If a text holds an item of ``m`` characters with at most ``k`` edits, at least
``m - q + 1 - k * q`` of the item's q-grams stand in it on diagonals (place in the text minus
place in the item) that lie within ``k`` of each other.  Shared q-grams are counted in
overlapping bands of ``2 * (k + 1)`` diagonals, two neighbouring bands covering every such set;
only regions that reach the bound are aligned, in a band, with the item.

Texts are compared as letters and digits: lower case, every other run of characters one blank.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released

Q = 10
#: Edits allowed per character of the item.
EDITS = 0.08
#: Characters of items that one pass over the documents looks for; more items take more passes.
PASS_CHARS = 4_000_000
#: Characters that are looked up at once.
PORTION = 1 << 20
FILTER_BITS = 22
_FOLD = np.uint64(0x9E3779B97F4A7C15)  # odd multipliers that mix the bits of a q-gram
_FOLD2 = np.uint64(0xC2B2AE3D27D4EB4F)
_OTHER = re.compile(r"[\W_]+")


def plain(text: str | None) -> str:
    """Lower case, with one blank for every run of characters other than letters and digits, none at the ends."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def allowed_edits(m: int, q: int = Q, rate: float = EDITS) -> int:
    """The edit budget of an item of ``m`` characters: a share of its length, as far as the lemma asks for a shared q-gram at all."""
    return max(0, min(int(m * rate), (m - q) // q)) if m >= q else 0


def _bytes(text: str) -> np.ndarray:
    """One byte per character: itself below U+0100, else a hash above the ASCII letters; a filter only."""
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.where(code < 256, code, 128 + code % 127).astype(np.uint8)


def _codes(data: np.ndarray) -> np.ndarray:
    """A 64-bit code of every run of ``Q`` bytes."""
    n = len(data) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    eight = np.lib.stride_tricks.as_strided(data[:8].view("<u8"), (n,), (1,)) if n else data
    two = np.lib.stride_tricks.as_strided(data[8:10].view("<u2"), (n,), (1,))
    return eight * _FOLD ^ two.astype(np.uint64) * _FOLD2


class Items:
    """The q-grams of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids = [i for i, _ in items]
        self.texts = [t for _, t in items]
        m = np.array([len(t) for t in self.texts], np.int64)
        self.edits = np.array([allowed_edits(n) for n in m.tolist()], np.int64)
        self.bound = np.maximum(1, m - Q + 1 - self.edits * Q)
        self.width = self.edits + 1
        codes = [_codes(_bytes(t)) for t in self.texts]
        self.short = [k for k, t in enumerate(self.texts) if 0 < len(t) < Q]
        every = np.concatenate([*codes, np.zeros(0, np.uint64)])
        order = np.argsort(every, kind="stable")
        self.codes = every[order]
        self.item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])[order]
        self.offset = np.concatenate([*(np.arange(len(c)) for c in codes), np.zeros(0, int)]).astype(np.int64)[order]
        self.known, self.first = np.unique(self.codes, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.codes)))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self._slot(self.known)] = True

    @staticmethod
    def _slot(codes: np.ndarray) -> np.ndarray:
        return (codes * _FOLD >> np.uint64(64 - FILTER_BITS)).astype(np.int64)

    def regions(self, text: str) -> list[tuple[int, int]]:
        """``(item, diagonal)``: items, and middles of bands in which they reach the bound."""
        data = _bytes(text)
        at, which = [], []
        for lo in range(0, max(0, len(data) - Q + 1), PORTION):
            codes = _codes(data[lo : lo + PORTION + Q - 1])
            here = np.flatnonzero(self.filter[self._slot(codes)])
            if not len(here):
                continue
            k = np.minimum(np.searchsorted(self.known, codes[here]), len(self.known) - 1)
            sure = self.known[k] == codes[here]
            at.append(here[sure] + lo)
            which.append(k[sure])
        if not at:
            return []
        place, k = np.concatenate(at), np.concatenate(which)
        n = self.count[k]
        # every use of the q-gram in an item
        use = np.repeat(self.first[k] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())
        item, diagonal = self.item[use], np.repeat(place, n) - self.offset[use]
        band = (diagonal + (1 << 40)) // self.width[item]
        key = np.concatenate([band, band - 1]) * len(self.texts) + np.concatenate([item, item])
        key, hits = np.unique(key, return_counts=True)
        item = key % len(self.texts)
        full = hits >= self.bound[item]
        band, item = key[full] // len(self.texts), item[full]
        return list(zip(item.tolist(), ((band + 1) * self.width[item] - (1 << 40)).tolist(), strict=True))


def banded(item: str, text: str, budget: int) -> tuple[int, int, int] | None:
    """The best place of ``item`` inside ``text``: ``(edits, start, end)``, or None over ``budget``.

    Free ends in the text.  Rows are characters of the item.  A cell off the band, which is as wide as the text leaves room for the
    item, would need more edits than allowed and is ruled out; a row is computed at once, cells off the band too.
    """
    a, b = item, np.array([ord(c) for c in text], np.int64)
    n = len(b)
    reach = max(0, n - len(a)) + budget
    big = len(a) + 1
    cost, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    where = np.arange(n + 1)
    for i, ch in enumerate(map(ord, a), 1):
        diagonal = cost[:-1] + (b != ch)
        new, begin = cost + 1, start.copy()
        better = diagonal < new[1:]
        new[1:] = np.where(better, diagonal, new[1:])
        begin[1:] = np.where(better, start[:-1], begin[1:])
        new[(where < i - budget) | (where > i + reach)] = big
        # text characters skipped: the least of new[j'] + j - j' for j' <= j
        slid = new - where
        least = np.minimum.accumulate(slid)
        source = np.maximum.accumulate(np.where(slid == least, where, 0))
        cost, start = least + where, begin[source]
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), end) if cost[end] <= budget else None


def find_items(text: str, items: Items) -> list[tuple[int, int, int, int]]:
    """``(item position, edits, start, end)`` of the best match of each item in a plain text."""
    best: dict[int, tuple[int, int, int]] = {}
    for k, diagonal in items.regions(text):
        item, edits = items.texts[k], int(items.edits[k])
        if k in best and not best[k][0]:
            continue
        lo = max(0, diagonal - 2 * int(items.width[k]))
        region = text[lo : diagonal + len(item) + 2 * int(items.width[k])]
        at = region.find(item)  # an alignment without edits needs no table
        got = (0, at, at + len(item)) if at >= 0 else banded(item, region, edits)
        if got and (k not in best or got[0] < best[k][0]):
            best[k] = (got[0], lo + got[1], lo + got[2])
    padded = f" {text} " if items.short else ""
    for k in items.short:  # too short for a q-gram: only as whole words
        at = padded.find(f" {items.texts[k]} ")
        if at >= 0:
            best[k] = (0, at, at + len(items.texts[k]))
    return [(k, *v) for k, v in sorted(best.items())]


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, edits, start, end``: the items of ``benchmark(item_id, text)`` found in ``docs(doc_id, text)``.

    ``start`` and ``end`` are places in the text as :func:`plain` leaves it.  One row per document row and item, at its best place.
    Null and empty texts hold nothing, and items without letters or digits are found nowhere; items shorter than a q-gram are found as
    whole words only.  Null ids are returned as they are; repeated rows are each searched; further columns are ignored.  The items are read in
    blocks of bounded size and each block is looked for in all documents, so a benchmark of any size can be used.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).where("text is not null")
    found = None
    for block in item_blocks(benchmark):
        part = _search(rows, block)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else docs.sparkSession.createDataFrame([], FOUND)


FOUND = "doc_id long, item_id long, edits int, start long, end long"


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, plain and without the empty ones, in blocks of about ``PASS_CHARS`` characters; the driver holds one block at a time."""
    block, size = [], 0
    for item_id, text in benchmark.select("item_id", "text").toLocalIterator():
        text = plain(text)
        if not text:
            continue
        block.append((item_id, text))
        size += len(text)
        if size >= PASS_CHARS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(rows: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(block)  # PASS_CHARS characters, or one longer item

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value)
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, edits, start, end in find_items(plain(text), items):
                    for values, x in zip(out, (doc_id, items.ids[k], edits, start, end), strict=True):
                        values.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=["doc_id", "item_id", "edits", "start", "end"])

    return rows.mapInArrow(released(search), FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs(text)`` that hold no item of ``benchmark(item_id, text)``; all columns stay, null texts hold nothing."""
    bounded_batches(docs.sparkSession)
    for block in item_blocks(benchmark):
        docs = docs.mapInArrow(released(_clean_of(docs, block)), docs.schema)
    return docs


def _clean_of(docs: DataFrame, block: list[tuple[int, str]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    sent, at = docs.sparkSession.sparkContext.broadcast(block), docs.columns.index("text")

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(sent.value)
        for batch in batches:
            yield batch.filter(pa.array([not (t and find_items(plain(t), items)) for t in batch.column(at).to_pylist()], pa.bool_()))

    return clean
