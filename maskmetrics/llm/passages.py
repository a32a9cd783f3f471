"""Passages that repeat across documents, by compact windows of shingle min-hashes.

A document is a sequence of five-word shingles.  For each of several hash functions the
Cartesian tree over its hashes gives compact windows ``(lo, c, hi)``: every subsequence inside
``lo..hi`` that holds ``c`` has its minimum at ``c``.  Windows narrower than the shortest passage
are left out, which leaves about ``2 n / width`` of them: the top of the tree.

Exact repeats are found in full.  A run of ``min_words`` words has its minimum at one ``c``, at the same place
in every document that holds the run, so documents that share a run share a signature of more than half
its words, at ``c`` and to its right or left.  Windows of a signature that can hold the same runs in full are one
class, and the members of a class are linked to its first; of the classes of one signature the first
members' runs are compared run by run.

Near repeats meet by any of several functions: the signature is the minimum's shingle with the words next to it, to the
right for every other function and to the left for the rest, so that a shingle that is frequent by
itself does not throw unrelated windows together.  Windows of one signature are joined where the intervals that they have in
common, laid over each other at their minima, have room for a passage.  Pairs of documents are then verified word by word,
as far as exact repeats do not cover the windows that they met in.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, bounded_batches, drop_files, materialise, released

SHINGLE = 5
#: Words of the shortest passage, and the similarity of the bags of shingles from which passages are near-duplicates.
MIN_WORDS = 50
SIMILARITY = 0.8
HASHES = 4
#: Words beside the minimum that belong to a signature.
CONTEXT = 8
#: Words by which a near-duplicate may shift, and that it may miss in one place.
SHIFT = 8
#: Rows that a task combines before it sends them on.
CHUNK = 100_000
#: Bytes of text whose words are hashed at once.
PORTION = 1 << 18
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)  # odd multipliers of a hash
_LOW, _REPEATED = np.uint64((1 << 32) - 1), np.uint64(1 << 63)

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_tables: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``n`` powers of an odd number and of its inverse, modulo 2 ** 64."""
    if len(_tables[0]) < n:
        size = 1 << (n - 1).bit_length()
        for k, base in enumerate((int(_M3), pow(int(_M3), -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _tables[k] = np.multiply.accumulate(steps)
    return _tables[0][:n], _tables[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


class Runs:
    """Hashes of any runs of some values: differences of a sum, which start at one place by the inverse power."""

    def __init__(self, values: np.ndarray):
        powers, self.inverse = _powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers[:-1], out=self.sums[1:])

    def of(self, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[first]) * self.inverse[first])


def _plain(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def _words_at(buffer: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the first byte of each word (run without ASCII white space)."""
    raw = np.frombuffer(buffer, np.uint8)
    hashes, at, lo = [], [], 0
    while lo < len(raw):
        hi = min(len(raw), lo + PORTION)
        while hi < len(raw):  # to the end of a word
            ends = np.flatnonzero(_SPACE[raw[hi : hi + 4096]])
            hi = min(len(raw), hi + (int(ends[0]) if len(ends) else 4096))
            if len(ends):
                break
        piece = raw[lo:hi]
        edges = np.flatnonzero(np.diff(_SPACE[piece].view(np.int8), prepend=1, append=1))
        hashes.append(Runs(piece + np.uint64(1)).of(edges[::2], edges[1::2]))
        at.append(edges[::2] + lo)
        lo = hi
    return np.concatenate([np.zeros(0, np.uint64), *hashes]), np.concatenate([np.zeros(0, np.int64), *at])


def word_hashes(text: str) -> np.ndarray:
    """A hash of each word (run without ASCII white space, lower case) of a text."""
    return _words_at(_plain(text))[0]


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words of all texts, one after the other, and where each text begins (and the last ends)."""
    raw = [_plain(t) for t in texts]
    words, at = _words_at(b" ".join(raw))
    return words, np.searchsorted(at, np.cumsum([0, *(len(r) + 1 for r in raw)]))


def shingles(words: np.ndarray) -> np.ndarray:
    """The hash of every run of five words."""
    first = np.arange(max(0, len(words) - SHINGLE + 1))
    return Runs(words).of(first, first + SHINGLE)


def _spread(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``first[k], first[k] + 1, ..`` (``counts[k]`` of them), one after the other."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` neighbours."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    behind = np.minimum.accumulate(blocks, axis=1).ravel()
    return np.minimum(ahead[: n - width + 1], behind[width - 1 : n])


def compact_windows(order: np.ndarray, first: np.ndarray, end: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``lo, c, hi`` (``hi`` exclusive) of the nodes with at least ``width`` places of the Cartesian trees over the parts ``first..end`` of ``order``.

    Values within a part are distinct and hold their place in the low 32 bits.  A node is that wide if it is the least of some ``width`` neighbours; the nodes above it are as
    wide, so the tree is built over those nodes alone, in one pass with a stack.
    """
    counts = np.maximum(0, end - first - width + 1)
    start = _spread(first, counts)
    if not len(start):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    least = _sliding_least(order, width)[start]
    least = least[np.concatenate([[True], least[1:] != least[:-1]])]
    c = (least & _LOW).astype(np.int64)
    part = np.searchsorted(first, c, "right") - 1
    lo, hi = first[part].tolist(), end[part].tolist()
    places, values, parts = c.tolist(), least.tolist(), part.tolist()
    stack: list[int] = []
    for k, value in enumerate(values):
        if k and parts[k] != parts[k - 1]:
            stack = []
        while stack and values[stack[-1]] > value:
            hi[stack.pop()] = places[k]
        if stack:
            lo[k] = places[stack[-1]] + 1
        stack.append(k)
    return np.array(lo, np.int64), c, np.array(hi, np.int64)


def orders(words: np.ndarray, five: np.ndarray, function: int) -> np.ndarray:
    """The values that a hash function's Cartesian tree is built over.

    The hash of a shingle, then its place, so that the leftmost of equal ones is on top.  A shingle of one word five times comes after all others,
    by a hash of its place in the repetition: so one word said many times has few wide windows, like any text.
    """
    place = np.arange(len(five), dtype=np.uint64)
    value = mix(five + np.uint64(function + 1) * _M3)
    constant = np.ones(len(five), bool)
    for k in range(1, SHINGLE):
        constant &= words[k - 1 : k - 1 + len(five)] == words[k : k + len(five)]
    if constant.any():
        since = place - np.maximum.accumulate(np.where(constant, np.uint64(0), place))
        value = np.where(constant, mix((since + np.uint64(function + 1)) * _M2), value)
    out = (value >> np.uint64(1)) & ~_LOW | place
    out[constant] |= _REPEATED
    return out


#: Rows between the steps: ``what`` is the function of a near window, ``EXACT`` for a window of exact repeats.  ``sub`` orders the windows of a key before their documents do.
ROW = "key long, sub long, doc long, h int, c int, lo int, hi int, what int, ctx long"
_ROW = pa.schema([("key", pa.int64()), ("sub", pa.int64()), ("doc", pa.int64()), ("h", pa.int32()), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("what", pa.int32()), ("ctx", pa.int64())])
#: What is found: document ``x`` has words ``lo..hi`` in common with ``f``, ``delta`` words before (EXACT); is to be compared with it there (a function); or its runs
#: that begin in ``lo..hi`` are to be compared one by one (OPEN, without ``f``).
LINK = "what int, x long, xh int, f long, fh int, delta int, c int, lo int, hi int"
_LINK = pa.schema([("what", pa.int32()), ("x", pa.int64()), ("xh", pa.int32()), ("f", pa.int64()), ("fh", pa.int32()), ("delta", pa.int32()), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])
#: A GROUP row is a near window ``x, xh, c, lo, hi`` of the signature ``f`` with more than FEW windows, whose partners are not all linked.
EXACT, OPEN, LINKED, GROUP = 100, 101, 200, 300
FEW = 3
#: Windows of a signature that are compared with as many others at once, and the shingles before and after a minimum that are.
TILE, REACH = 1024, 64
#: Marks that a window's shingles leave on a sheet, windows whose cells are taken together, and pairs of them that are looked at at once.
MARKS, TOGETHER, PAIRS, FEW_PAIRS = 1024, 4096, 1 << 15, 1 << 10

Columns = tuple[np.ndarray, ...]


def _batch(columns: Columns, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v.astype(t.type.to_pandas_dtype(), copy=False)) for v, t in zip(columns, schema, strict=True)], schema=schema)


def _joined(parts: list[Columns], width: int) -> Columns:
    return tuple(np.concatenate(v) for v in zip(*parts, strict=True)) if parts else tuple(np.zeros(0, np.int64) for _ in range(width))


def window_rows(texts: list[str], doc: np.ndarray, h: np.ndarray, hashes: int, min_words: int) -> Columns:
    """The rows (:data:`ROW`) of all compact windows of some documents."""
    words, bounds = words_of(texts)
    width = min_words - SHINGLE + 1
    if len(words) < min_words:
        return _joined([], 9)
    runs = Runs(words)
    at = np.arange(len(words) - SHINGLE + 1)
    five = runs.of(at, at + SHINGLE)  # those across two texts are in no window
    first, end = bounds[:-1], np.maximum(bounds[:-1], bounds[1:] - SHINGLE + 1)
    some = end - first >= width
    first, end, text = first[some], end[some], np.flatnonzero(some)
    half = (min_words - SHINGLE) // 2
    out: list[Columns] = []

    def add(key: np.ndarray, sub: np.ndarray, own: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, what: int, ctx: np.ndarray) -> None:
        base, row = first[own], text[own]
        out.append((key.view(np.int64), sub.view(np.int64), doc[row], h[row], c - base, lo - base, hi - base, np.full(len(c), what), ctx.view(np.int64)))

    for j in range(hashes):
        order = orders(words, five, j)
        lo, c, hi = compact_windows(order, first, end, width)
        own = np.searchsorted(first, c, "right") - 1
        a, b = np.maximum(lo, c - width + 1), np.minimum(c, hi - width)  # where the runs of min_words words begin that have their minimum here
        none = np.zeros(len(c), np.uint64)
        if j % 2 == 0:
            beside = runs.of(c, np.minimum(c + SHINGLE + CONTEXT, end[own] + SHINGLE - 1))
        else:
            beside = runs.of(np.maximum(c - CONTEXT, first[own]), c + SHINGLE)
        add(mix(beside * _M2 + np.uint64(j) * _M3), none, own, c, lo, hi, j, mix(runs.of(a, b + min_words) + (c - a).astype(np.uint64) * _M2))
        if j:
            continue
        for side in (0, 1):  # more than half of such a run lies right, or left, of its minimum's first word
            s, e = (np.maximum(a, c - half), b) if side == 0 else (a, np.minimum(b, c - half - 1))
            has = s <= e
            s, e, m = s[has], e[has], c[has]
            sign = runs.of(m, m + min_words - half) if side == 0 else runs.of(m - half - 1, m + SHINGLE)
            if side:  # in one word said many times the minimum has no place of its own, so both sides are one signature
                sign = sign + np.where(order[m] >= _REPEATED, np.uint64(0), _M1)
            ctx = mix(runs.of(s, e + min_words) + (m - s).astype(np.uint64) * _M2)
            add(mix(sign * _M3), ctx, own[has], m, s, e + min_words, EXACT, none[has])
    return _joined(out, 9)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Whether a row differs from the one before in some column."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _firsts(*columns: np.ndarray) -> np.ndarray:
    """The position of the first of the rows that agree with a row in all columns and stand together."""
    return np.maximum.accumulate(np.where(_changes(*columns), np.arange(len(columns[0])), 0))


def _heads(rows: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Of exact rows, sorted: the position of the first of each class, and whether a row belongs to the same document as that."""
    key, sub, doc, h = rows[:4]
    head = _firsts(key, sub)
    return head, (doc == doc[head]) & (h == h[head])


def _ranks(rows: Columns) -> tuple[np.ndarray, np.ndarray]:
    """Of exact rows, sorted: how many places of its document in its class come before a row's, and whether it is the first row of its place."""
    new = _changes(*rows[:5])
    count = np.cumsum(new)
    return count - count[_firsts(*rows[:4])], new


def _exact_links(rows: Columns, own: np.ndarray, ranks: np.ndarray, places: np.ndarray, head: np.ndarray, counts: np.ndarray) -> Columns:
    """The links of the members of a class to its first document, of which ``places`` has the places of all classes and ``counts`` how many each has; ``head`` is the class's first row.

    The k-th place of a document is linked to the k-th of the first one, and again from its start where that has fewer: what repeats itself then agrees
    with what repeats itself by few shifts, and not by one for every repetition.
    """
    x = np.flatnonzero(~own)
    doc, h, c, lo, hi = rows[2:7]
    label = (np.cumsum(_changes(*rows[:2])) - 1)[x]
    at = places[(np.cumsum(counts) - counts)[label] + ranks[x] % counts[label]]
    return np.full(len(x), EXACT), doc[x], h[x], doc[head[x]], h[head[x]], c[x] - at, c[x], lo[x], hi[x]


def _near_links(rows: Columns, carried: int, room: int) -> Columns:
    """Links of near windows, sorted, to the first of their signature and to the one before, unless they hold the same runs; the ``carried`` ones in front have theirs."""
    doc, h, c, lo, hi, what, ctx = rows[2:9]
    place = np.arange(carried, len(doc))
    first = _firsts(rows[0])[carried:]
    own, at = np.concatenate([place, place]), np.concatenate([first, np.maximum(first, place - 1)])
    delta = c[own] - c[at]
    low, high = np.maximum(lo[own], lo[at] + delta), np.minimum(hi[own], hi[at] + delta)
    link = ((doc[own] != doc[at]) | (h[own] != h[at])) & (ctx[own] != ctx[at]) & (high - low >= room)
    link[len(place) :] &= at[len(place) :] != first
    x, f = own[link], at[link]
    return what[x], doc[x], h[x], doc[f], h[f], delta[link], c[x], low[link], high[link]


def _members(rows: Columns, carried: int) -> Columns:
    """Near windows, sorted, of signatures that have more than ``FEW``; the ``carried`` ones in front are told here only if there were no more of them before."""
    label = np.cumsum(_changes(rows[0])) - 1
    some = (np.bincount(label) > FEW)[label]
    if carried > FEW:
        some[:carried] = False
    key, _, doc, h, c, lo, hi, what, _ = (v[some] for v in rows)
    return np.full(len(key), GROUP), doc, h, key, what, np.zeros(len(key), np.int32), c, lo, hi


def _sorted(rows: Columns) -> Columns:
    order = np.lexsort(tuple(rows[k] for k in (4, 3, 2, 1, 0)))
    return tuple(v[order] for v in rows)


def _as_rows(links: Columns) -> Columns:
    """Links among the rows: a row's ``what`` is then ``LINKED``, its key any, so that a group of links is not in one place."""
    what, x, xh, f, fh, delta, c, lo, hi = links
    key = mix((x.view(np.uint64) * _M3 + lo.astype(np.uint64)) * _M2).view(np.int64)
    return key, f, x, xh, c, lo, hi, np.full(len(x), LINKED), delta.astype(np.int64) << 32 | fh.astype(np.int64) & 0xFFFFFFFF


def _from_rows(rows: Columns) -> Columns:
    key, f, x, xh, c, lo, hi, what, more = rows
    return np.full(len(x), EXACT), x, xh, f, more.astype(np.int32), more >> 32, c, lo, hi


def combined(rows: Columns) -> Columns:
    """A task's rows before they are sent: of near windows of a signature that hold the same runs the first; of the windows of an exact class those of its first document, links for the others."""
    exact = rows[7] == EXACT
    near, mine = tuple(v[~exact] for v in rows), tuple(v[exact] for v in rows)
    order = np.lexsort((near[4], near[3], near[2], near[8], near[0]))
    first = order[_changes(near[0][order], near[8][order])] if len(order) else order
    out = [tuple(v[first] for v in near)]
    if len(mine[0]):
        mine = _sorted(mine)
        head, own = _heads(mine)
        ranks, new = _ranks(mine)
        firsts = own & new
        counts = np.bincount((np.cumsum(_changes(*mine[:2])) - 1)[firsts])
        out += [tuple(v[own] for v in mine), _as_rows(_exact_links(mine, own, ranks, mine[4][firsts], head, counts))]
    return _joined(out, 9)


class _Signatures:
    """Exact rows in sorted batches: links of each class's members to its first, and which classes are not the only one of their signature."""

    def __init__(self) -> None:
        self.head: Columns | None = None  # the first row of the class that may go on
        self.places: list[np.ndarray] = []  # where else its document has it
        self.last = (0, 0, 0, 0)  # document, place and rank of the last row
        self.several = False  # its signature has more classes
        self.waiting: list[Columns] = []  # the rows of that signature's first class as long as it is the only one

    def links(self, rows: Columns) -> list[Columns]:
        carried = 0 if self.head is None else 1
        if carried:
            rows = _joined([self.head, rows], 9)
        key, sub = rows[:2]
        head, own = _heads(rows)
        ranks, new = _ranks(rows)
        label = np.cumsum(_changes(key, sub)) - 1
        if carried:
            doc, h, place, rank = self.last
            on = (label == 0) & (rows[2] == doc) & (rows[3] == h)
            if own[on].any():  # the document is the class's first
                new[1:2] &= ~(on[1:2] & (rows[4][1:2] == place))
            elif on.any():
                ranks[on] += rank + int(rows[4][on][0] != place)
        firsts = own & new
        counts = np.bincount(label[firsts])
        places = rows[4][firsts]
        if carried and self.places and (~own & (label == 0)).any():
            self.places = [np.concatenate([np.zeros(0, np.int64), *self.places])]
            places = np.concatenate([places[:1], *self.places, places[1:]])
            counts[0] += len(self.places[0])
        out = [_exact_links(rows, own, ranks, places, head, counts)]
        more = rows[4][firsts & (label == label[-1])]
        self.places = [*(self.places if carried and not label[-1] else []), more[1:].copy()]
        self.last = tuple(int(v[-1]) for v in (*rows[2:5], ranks))
        mine = own & (np.arange(len(key)) >= carried)
        signature = np.cumsum(_changes(key)) - 1
        several = np.zeros(signature[-1] + 1, bool)
        several[signature[1:][(key[1:] == key[:-1]) & (sub[1:] != sub[:-1])]] = True
        if carried:
            several[0] |= self.several
            if several[0]:
                out += map(_open_links, self.waiting)
        out.append(_open_links(tuple(v[several[signature] & mine] for v in rows)))
        if signature[-1] or several[0]:
            self.waiting = []
        self.several = bool(several[-1])
        if not self.several:
            self.waiting.append(tuple(v[(signature == signature[-1]) & mine].copy() for v in rows))
        self.head = tuple(v[head[-1] : head[-1] + 1].copy() for v in rows)
        return out


def _open_links(rows: Columns) -> Columns:
    """Runs to be compared one by one."""
    doc, h, c, lo, hi = rows[2:7]
    return np.full(len(doc), OPEN), doc, h, doc, h, np.zeros(len(doc), np.int32), c, lo, hi


def closed(batches: Iterator[pa.RecordBatch], room: int) -> Iterator[pa.RecordBatch]:
    """Links (:data:`LINK`) of rows that come sorted by key, sub and document."""
    near: Columns | None = None  # the first few windows and the last of the signature that may go on
    exact = _Signatures()
    for batch in batches:
        rows = tuple(v.to_numpy() for v in batch.columns)
        what = rows[7]
        links = [_from_rows(tuple(v[what == LINKED] for v in rows))]
        own = tuple(v[what < EXACT] for v in rows)
        if len(own[0]):
            carried = 0 if near is None else len(near[0])
            if carried:
                own = _joined([near, own], 9)
            links += [_near_links(own, carried, room), _members(own, carried)]
            first = _firsts(own[0])[-1]
            keep = np.unique(np.minimum([*range(first, first + FEW), len(own[0]) - 1], len(own[0]) - 1))
            near = tuple(v[keep] for v in own)
        own = tuple(v[what == EXACT] for v in rows)
        if len(own[0]):
            links += exact.links(own)
        yield _batch(_joined(links, 9), _LINK)


def _sent(found: Iterator[Columns]) -> Iterator[pa.RecordBatch]:
    """Rows, combined in portions of about ``CHUNK``."""
    held, size = [], 0
    for rows in found:
        held.append(rows)
        size += len(rows[0])
        if size >= CHUNK:
            yield _batch(combined(_joined(held, 9)), _ROW)
            held, size = [], 0
    if held:
        yield _batch(combined(_joined(held, 9)), _ROW)


def _linked(rows: DataFrame, room: int) -> DataFrame:
    ordered = rows.repartition("key").sortWithinPartitions("key", "sub", "doc", "h", "c")
    return ordered.mapInArrow(released(lambda batches: closed(batches, room)), LINK)


def text_numbers(rows: DataFrame, doc: str = "doc", text: str = "text") -> DataFrame:
    """``rows`` with ``h``, an integer that tells apart the texts of one ``doc``: a document is an id with a text.

    It is 31 bits of a 64-bit hash; texts of one id that agree in these but not in all 64 get negative numbers of their own, in the
    order of the hash.  Equal rows of the same table always get equal numbers.
    """
    whole = F.xxhash64(text)
    part = whole.bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")
    keys = rows.where(F.col(doc).isNotNull() & F.col(text).isNotNull()).select(F.col(doc).alias("_doc"), whole.alias("_whole"), part.alias("_part"))
    clash = keys.groupBy("_doc", "_part").agg(F.min("_whole").alias("lo"), F.max("_whole").alias("hi")).where("lo < hi").select("_doc", "_part")
    clash = materialise(keys.join(clash, ["_doc", "_part"]).select("_doc", "_whole").distinct(), "clashes")
    if clash.isEmpty():
        return rows.withColumn("h", part)
    own = clash.withColumn("_own", -F.row_number().over(Window.partitionBy("_doc").orderBy("_whole")))
    return rows.join(own, (F.col(doc) == own["_doc"]) & (whole == own["_whole"]), "left").withColumn("h", F.coalesce("_own", part)).select(*rows.columns, "h")


def texts_by_hash(docs: DataFrame) -> DataFrame:
    """``doc, h, text`` of the rows with an id and a text, with their :func:`text_numbers`."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.col("text").cast("string").alias("text")).where("doc is not null and text is not null")
    return text_numbers(rows).select("doc", "h", "text")


def window_links(texts: DataFrame, hashes: int = HASHES, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The links (:data:`LINK`) of ``texts(doc, h, text)`` by signatures of compact windows.

    One shuffle carries windows; of the exact windows of one class a task sends only those of the first document, and links for the others.
    """
    bounded_batches(texts.sparkSession)
    room = max(1, int(similarity * (min_words - SHINGLE + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(window_rows(b.column(2).to_pylist(), b.column(0).to_numpy(), b.column(1).to_numpy(), hashes, min_words) for b in batches if b.num_rows)

    return _linked(texts.mapInArrow(released(run), ROW), room)


def run_links(texts: DataFrame, opened: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Exact links of ``opened(x, xh, lo, hi)``: every run of ``min_words`` words inside ``lo..hi`` is linked to the first document that has it inside one of its own."""
    bounded_batches(texts.sparkSession)
    spans = opened.groupBy(F.col("x").alias("doc"), F.col("xh").alias("h")).agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))  # no more than the document has words

    def rows(batch: pa.RecordBatch) -> Columns:
        words, bounds = words_of(batch.column(2).to_pylist())
        spans = batch.column(3)
        ends = np.asarray(spans.offsets)
        lo, hi = (np.asarray(spans.values.field(k)).astype(np.int64) for k in range(2))
        lo, hi, own = lo[ends[0] : ends[-1]], hi[ends[0] : ends[-1]], np.repeat(np.arange(batch.num_rows), np.diff(ends))
        start = np.unique(_spread(lo + bounds[own], hi - lo - min_words + 1))
        own = np.searchsorted(bounds, start, "right") - 1
        key = mix(Runs(words).of(start, start + min_words) * _M2).view(np.int64)
        c, none = start - bounds[own], np.zeros(len(start), np.int64)
        return key, none, batch.column(0).to_numpy()[own], batch.column(1).to_numpy()[own], c, c, c + min_words, np.full(len(c), EXACT), none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _sent(rows(b) for b in batches if b.num_rows)

    return _linked(texts_with(texts, spans).select("doc", "h", "text", "spans").mapInArrow(released(run), ROW), 1)


def texts_with(texts: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows(doc, h, ..)``, whose keys are unique, with their texts, once each; rows are broadcast as long as they are few, so that only the texts asked for are moved."""
    keys = materialise(rows.select("doc", "h"), "ids")
    few = keys.count() <= BROADCAST_IDS
    own = texts.join(F.broadcast(keys) if few else keys, ["doc", "h"], "left_semi").groupBy("doc", "h").agg(F.first("text").alias("text"))
    return own.join(rows, ["doc", "h"])


def islands(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys.., lo, hi``: the spans of one key put together where they touch."""
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    before = F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.select(*keys, "lo", "hi", (before.isNull() | (F.col("lo") > before)).cast("long").alias("new"))
    return marked.withColumn("island", F.sum("new").over(order)).groupBy(*keys, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


class _Cell:
    """Windows of some signatures with the words around their minima, and what any two of them share."""

    def __init__(self, doc: np.ndarray, h: np.ndarray, c: np.ndarray, lo: np.ndarray, hi: np.ndarray, words: list[np.ndarray], at: np.ndarray):
        self.doc, self.h, self.c, self.lo, self.hi, self.words, self.at = doc, h, c, lo, hi, words, at
        n, middle = len(doc), REACH
        self.rank = np.empty(n, np.int64)  # of the document
        order = np.lexsort((h, doc))
        self.rank[order] = np.cumsum(_changes(doc[order], h[order]))
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = np.cumsum(np.concatenate([[0], sizes]))
        runs = Runs(np.concatenate(words).astype(np.uint64))
        counts = np.maximum(0, sizes - SHINGLE + 1)
        row, place = np.repeat(np.arange(n), counts), _spread(ends[:-1], counts)
        self.five, self.there = np.zeros((n, 2 * middle + 1), np.uint64), np.zeros((n, 2 * middle + 1), bool)
        column = place - (ends[:-1] + at)[row] + middle  # the minimum in the middle
        self.five[row, column] = values = runs.of(place, place + SHINGLE)
        self.there[row, column] = True
        self.mark = np.zeros(self.five.shape, np.int16)
        self.mark[row, column] = values % np.uint64(MARKS)
        self.marked = np.zeros((n, MARKS), bool)
        self.marked[row, self.mark[row, column]] = True
        self.marks = np.packbits(self.marked, axis=1).view(np.uint64)
        self.over = counts - self.marked.sum(axis=1)
        own = mix(runs.of(ends[:-1], ends[1:]) * _M2)  # windows that agree in it have the same words around them, and the same room
        for v in (at, lo - c, hi - c):
            own = mix(own + v.astype(np.uint64) * _M3)
        self.content = own

    @property
    def hits(self) -> np.ndarray:
        """How many shingles of each window are among those of each other."""
        return np.array([self.shared(x, np.arange(len(self.doc)))[0].sum(axis=1) for x in range(len(self.doc))])

    def may_meet(self, x: np.ndarray, others: np.ndarray, min_words: int, similarity: float) -> np.ndarray:
        """Which of the pairs may have a passage around the minimum of ``x``, by the marks of their shingles alone: what is shared has its mark with both."""
        size = min_words - SHINGLE + 1
        width = int(np.ceil(similarity * size))
        at = np.flatnonzero(np.bitwise_count(self.marks[x] & self.marks[others]).sum(axis=1, dtype=np.int64) + self.over[x] >= width)
        out = np.zeros(len(x), bool)
        for part in np.split(at, range(FEW_PAIRS, len(at), FEW_PAIRS)):
            a, b = x[part], others[part]
            own = self.marked[b[:, None], self.mark[a]] & self.there[a]
            enough = own.sum(axis=1) >= width
            a, b, own, part = a[enough], b[enough], own[enough], part[enough]
            theirs = self.marked[a[:, None], self.mark[b]] & self.there[b]
            out[part] = self._room(a, b, own, theirs, slice(None), size, width, similarity, None) >= -1e-6
        return out

    def shared(self, x: int, others: np.ndarray, part: slice = slice(None)) -> tuple[np.ndarray, np.ndarray]:
        """By place, which shingles of the window are among those of each other one in this part, and which of those in the part are among its own."""
        known, place = np.unique(self.five[x][self.there[x]], return_inverse=True)
        five = self.five[others, part]
        theirs = np.minimum(np.searchsorted(known, five), len(known) - 1)
        met = (known[theirs] == five) & self.there[others, part]
        row = np.nonzero(met)[0]
        has = np.zeros((len(others), len(known)), bool)
        has[row, theirs[met]] = True
        own = np.zeros((len(others), self.five.shape[1]), bool)
        own[:, self.there[x]] = has[:, place]
        return own, met

    def _room(self, x: int | np.ndarray, others: np.ndarray, own: np.ndarray, theirs: np.ndarray, part: slice, width: int, least: int, similarity: float, at: int | None) -> np.ndarray:
        """What a passage around the minimum of ``x`` and one of each other window, around ``at``, can sum up to at most: the shingles that are shared add, the others take, and two near passages do not sum up to less than zero."""
        mine = np.where(self.there[x], own * ((1 + similarity) / 2) - similarity, -1e6)
        other = most(np.where(self.there[others, part], theirs * ((1 + similarity) / 2) - similarity, -1e6), least, at)
        if at is None:
            return most(mine, width, REACH) + other
        # such a passage begins and ends with shared words, or it lies where they have no gap of more than SHIFT
        n, wide = own.shape[1], SHIFT + SHINGLE
        upto = np.zeros((len(own), n + 2 * SHINGLE), np.int32)
        np.cumsum(own, axis=1, out=upto[:, SHINGLE : SHINGLE + n])
        upto[:, SHINGLE + n :] = upto[:, SHINGLE + n - 1 : SHINGLE + n]
        place, upto = np.arange(n), upto[:, SHINGLE - 1 :]  # now upto[:, k] are shared before k
        first = upto[:, 1 : n + 1] > np.concatenate([np.zeros((len(own), SHINGLE - 1), np.int32), upto[:, : n - SHINGLE + 1]], axis=1)
        last = upto[:, SHINGLE : SHINGLE + n] > upto[:, :n]
        gap = upto[:, wide : n + 1] == upto[:, : n + 1 - wide]
        right = np.where(gap[:, REACH + 1 :].any(axis=1), gap[:, REACH + 1 :].argmax(axis=1) + REACH + 1, n)
        before = gap[:, : REACH - wide + 1][:, ::-1]
        left = np.where(before.any(axis=1), REACH - before.argmax(axis=1), 0)
        inside = np.where((place >= left[:, None]) & (place < right[:, None]), mine, -1e6)
        return np.maximum(most(mine, width, REACH, first, last), most(inside, width, REACH)) + other

    def partner(self, x: int, others: np.ndarray, room: int, min_words: int, similarity: float) -> tuple[int, int, int, int] | None:
        """Of the windows ``others``, and where to look, one that has a passage around the minimum of ``x``, those with most in common first; and how much that is."""
        size = min_words - SHINGLE + 1
        width = int(np.ceil(similarity * size))
        delta = self.c[x] - self.c[others]
        low, high = np.maximum(self.lo[x], self.lo[others] + delta), np.minimum(self.hi[x], self.hi[others] + delta)
        own, theirs = self.shared(x, others)
        hits = own.sum(axis=1)
        fit = np.flatnonzero((self.rank[others] < self.rank[x]) & (hits >= width) & (high - low >= room))
        fit = fit[np.lexsort((self.rank[others[fit]], -hits[fit]))]
        if not len(fit):
            return None
        others, low, high, hits, own, theirs = (v[fit] for v in (others, low, high, hits, own, theirs))
        # a passage of the other document lies around its minimum too, or it is all on one side of it
        room_for = self._room(x, others, own, theirs, slice(None), size, width, similarity, REACH)
        for part in (slice(0, REACH), slice(REACH + 1, None)):
            left = np.flatnonzero((room_for < -1e-6) & (theirs[:, part].sum(axis=1) >= width))
            if len(left):
                mine, other = self.shared(x, others[left], part)
                some = mine.sum(axis=1) >= width
                room_for[left[some]] = self._room(x, others[left[some]], mine[some], other[some], part, size, width, similarity, None)
        order = np.lexsort((-room_for, np.arange(len(others)) // 64))
        order = order[room_for[order] >= -1e-6]
        base, at, n = self.c[x] - self.at[x], int(self.at[x]), len(self.words[x]) - SHINGLE + 1
        tried = set()
        for k in order.tolist():
            f = int(others[k])
            if self.content[f] in tried:
                continue
            tried.add(self.content[f])
            where = [(at - int(self.at[f]), max(0, int(low[k] - base)), min(n, int(high[k] - base)))]
            if any(s <= at and e >= at + SHINGLE for s, e, *_ in matching_passages(self.words[x], self.words[f], where, min_words, similarity)):
                return f, int(low[k]), int(high[k]), int(hits[k])
        return None


def most(worth: np.ndarray, width: int, at: int | None = None, first: np.ndarray | None = None, last: np.ndarray | None = None) -> np.ndarray:
    """The largest sum over ``width`` or more neighbours of each row, the one at ``at`` among them, that begin and end where they may."""
    n = worth.shape[1]
    over = np.zeros((len(worth), n + 1))
    np.cumsum(worth, axis=1, out=over[:, 1:])
    least = np.minimum.accumulate(over[:, :n] if first is None else np.where(first, over[:, :n], np.inf), axis=1)
    end = np.arange(width if at is None else max(at + 1, width), n + 1)
    start = end - width if at is None else np.minimum(at, end - width)
    upto = over[:, end] if last is None else np.where(last[:, end - 1], over[:, end], -np.inf)
    return (upto - least[:, start]).max(axis=1, initial=-np.inf)


SURROUNDINGS = "key long, n long, open boolean, doc long, h int, c int, lo int, hi int, at int, words binary"
_SURROUNDINGS = pa.schema([("key", pa.int64()), ("n", pa.int64()), ("open", pa.bool_()), ("doc", pa.int64()), ("h", pa.int32()), ("c", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("at", pa.int32()), ("words", pa.binary())])
MET = "key long, x long, xh int, c int, hits int, f long, fh int, delta int, lo int, hi int"
_MET = pa.schema([("key", pa.int64()), ("x", pa.int64()), ("xh", pa.int32()), ("c", pa.int32()), ("hits", pa.int32()), ("f", pa.int64()), ("fh", pa.int32()), ("delta", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def met_in_cells(cells: pa.Table, room: int, min_words: int, similarity: float) -> Columns:
    """Rows (:data:`MET`) of the open windows of some cells that have a partner in theirs: the other windows of its tile or, in a cell of two tiles, those of the other one."""
    key, a, b, wanted = (cells.column(n).to_numpy() for n in ("key", "a", "b", "open"))
    new = np.flatnonzero(_changes(key, a, b))
    size = np.diff(np.append(new, len(key)))
    label = np.repeat(np.arange(len(new)), size)
    some = (np.bincount(label, wanted, len(new)) > 0) & (size > 1)
    cells = cells.filter(pa.array(some[label]))
    if not cells.num_rows:
        return _joined([], len(_MET))
    size = size[some]
    start = np.cumsum(size) - size
    key, wanted, at = (cells.column(n).to_numpy() for n in ("key", "open", "at"))
    doc, h, c, lo, hi, tile = (cells.column(n).to_numpy().astype(np.int64) for n in ("doc", "h", "c", "lo", "hi", "t"))
    own = _Cell(doc, h, c, lo, hi, [np.frombuffer(w, np.uint32) for w in cells.column("words").to_pylist()], at)
    label = np.repeat(np.arange(len(size)), size)
    two = (tile[start] != tile[start + size - 1])[label]
    windows, found = np.flatnonzero(wanted), []
    pairs = np.cumsum(size[label[windows]])
    for part in np.split(windows, np.unique(np.searchsorted(pairs, np.arange(PAIRS, int(pairs[-1]), PAIRS)))):
        counts = size[label[part]]
        x, others = np.repeat(part, counts), _spread(start[label[part]], counts)
        ahead = c[x] - c[others]
        fit = (own.rank[others] < own.rank[x]) & ~(two[x] & (tile[x] == tile[others]))
        fit &= np.minimum(hi[x], hi[others] + ahead) - np.maximum(lo[x], lo[others] + ahead) >= room
        x, others = x[fit], others[fit]
        fit = own.may_meet(x, others, min_words, similarity)
        x, others = x[fit], others[fit]
        for of in np.split(np.arange(len(x)), np.flatnonzero(np.diff(x)) + 1) if len(x) else []:
            w = int(x[of[0]])
            if (partner := own.partner(w, others[of], room, min_words, similarity)) is not None:
                f, low, high, hits = partner
                found.append((key[w], doc[w], h[w], c[w], hits, doc[f], h[f], c[w] - c[f], low, high))
    return tuple(np.array(v, np.int64) for v in zip(*found, strict=True)) if found else _joined([], len(_MET))


def further_links(texts: DataFrame, members: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """``x, xh, f, fh, delta, lo, hi``: for each open one of the near windows ``members(key, doc, h, c, lo, hi, open)``, an earlier document that has a passage around its minimum, if any window of its signature belongs to one.

    All windows of a signature are compared, in cells of two tiles of about ``TILE`` windows each, so a frequent signature is no one task's.  A window moves
    with the words up to ``REACH`` shingles before and after its minimum; of two windows the shingles in common are counted, and if they may do for a passage, it is looked for word by word,
    the partners with most in common first.
    """
    bounded_batches(texts.sparkSession)
    room = max(1, int(similarity * (min_words - SHINGLE + 1)))
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.max("open").alias("any")).where("any").select("key", "n")
    items = members.join(sizes, "key").groupBy("doc", "h").agg(F.collect_list(F.struct("key", "n", "open", "c", "lo", "hi")).alias("items"))  # no more than the document has words

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            words, bounds = words_of(batch.column(2).to_pylist())
            words = words.astype(np.uint32)
            items, ends = batch.column(3), np.asarray(batch.column(3).offsets)
            key, n, wanted, c, lo, hi = (items.values.field(k).slice(ends[0], ends[-1] - ends[0]) for k in range(6))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            at = np.asarray(c).astype(np.int64)
            first, end = np.maximum(0, at - REACH), np.minimum(np.diff(bounds)[row], at + REACH + SHINGLE)
            around = [words[b + s : b + e].tobytes() for b, s, e in zip(bounds[row].tolist(), first.tolist(), end.tolist(), strict=True)]
            doc, h = (pa.array(batch.column(k).to_numpy()[row]) for k in range(2))
            yield pa.RecordBatch.from_arrays([key, n, wanted, doc, h, c, lo, hi, pa.array(at - first, pa.int32()), pa.array(around, pa.binary())], schema=_SURROUNDINGS)

    rows = texts_with(texts, items).select("doc", "h", "text", "items").mapInArrow(released(surroundings), SURROUNDINGS)
    tiles = F.ceil(F.col("n") / TILE).cast("int")
    rows = rows.withColumn("t", F.pmod(F.xxhash64("doc", "h", "c"), tiles).cast("int")).withColumn("u", F.explode(F.sequence(F.lit(0), tiles - 1)))
    cells = rows.select("key", F.least("t", "u").alias("a"), F.greatest("t", "u").alias("b"), "t", "open", "doc", "h", "c", "lo", "hi", "at", "words")
    cells = cells.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "t")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < TOGETHER:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            last = int(np.flatnonzero(_changes(*(rows.column(k).to_numpy() for k in range(3))))[-1])  # this cell may go on
            if last:
                yield _batch(met_in_cells(rows.slice(0, last), room, min_words, similarity), _MET)
            held = rows.slice(last).to_batches()
        if sum(map(len, held)):
            yield _batch(met_in_cells(pa.Table.from_batches(held), room, min_words, similarity), _MET)

    met = cells.mapInArrow(released(compare), MET)
    best = met.groupBy("key", "x", "xh", "c").agg(F.max(F.struct("hits", (-F.col("f")).alias("_f"), "f", "fh", "delta", "lo", "hi")).alias("best"))
    return best.select("x", "xh", *[F.col("best")[n].alias(n) for n in ("f", "fh", "delta", "lo", "hi")])


class _Shared:
    """The shingles of two documents as small numbers: which of each the other has, and how near parts of them are."""

    def __init__(self, sx: np.ndarray, sf: np.ndarray):
        both = np.concatenate([sx, sf])
        order = np.argsort(both)
        ids = np.empty(len(both), np.int64)
        ids[order] = np.cumsum(_changes(both[order])) - 1
        self.x, self.f = ids[: len(sx)], ids[len(sx) :]
        self.size = int(ids[order[-1]]) + 1 if len(ids) else 0
        self.nx, self.nf = (np.bincount(v, minlength=self.size) for v in (self.x, self.f))
        self.met, self.met_other = self.nf[self.x] > 0, self.nx[self.f] > 0

    def similarity(self, start: int, end: int, first: int, last: int, least: float = 0.0) -> float:
        """The Jaccard similarity of the bags of two parts; 0 if their sizes alone keep it below ``least``."""
        a, b = self.x[start:end], self.f[first:last]
        if min(len(a), len(b)) < least * max(len(a), len(b)):
            return 0.0
        same = int(np.minimum(np.bincount(a, minlength=self.size), np.bincount(b, minlength=self.size)).sum())
        return same / max(1, len(a) + len(b) - same)


class _Alignment:
    """Words of one document laid over those of another: ``place`` holds the partner of every word, -1 without one."""

    def __init__(self, wx: np.ndarray, wf: np.ndarray, sx: np.ndarray, sf: np.ndarray, enough: int):
        self.wx, self.wf, self.sx, self.sf, self.enough = wx, wf, sx, sf, enough
        self.place = np.full(len(wx), -1, np.int64)
        self.whole: list[tuple[int, int, int]] = []  # start, end, delta of runs that are passages by themselves
        self.inside = np.zeros(len(wx), bool)  # one of those

    def mark(self, start: int, end: int, delta: int) -> None:
        if end - start >= self.enough:
            self.whole.append((start, end, delta))
            self.inside[start:end] = True
        own = self.place[start:end]
        free = own < 0
        own[free] = (np.arange(start, end) - delta)[free]

    def diagonal(self, delta: int, lo: int, hi: int) -> None:
        """Mark the shingles of ``lo..hi`` that agree at ``delta``, then follow both ends of every run to where the texts shift."""
        a, b = max(0, lo - SHIFT, delta), min(len(self.sx), hi + SHIFT, len(self.sf) + delta)
        if b <= a:
            return
        hit = np.zeros(b - a + 2, np.int8)
        hit[1:-1] = self.sx[a:b] == self.sf[a - delta : b - delta]
        edges = (np.flatnonzero(hit[1:] != hit[:-1]) + a).tolist()
        runs = [(s, e + SHINGLE - 1) for s, e in zip(edges[::2], edges[1::2], strict=True)]
        for s, e in runs:
            self.mark(s, e, delta)
        for s, e in runs:
            self.follow_right(e, delta)
            self.follow_left(s, delta)

    def _nearest(self, i0: int, i1: int, k0: int, k1: int, delta: int, last: bool) -> tuple[int, int] | None:
        """The first (or last) shingle of ``i0..i1`` that also stands in ``k0..k1``, with its partner nearest to ``delta``."""
        i0, k0, i1, k1 = max(0, i0), max(0, k0), min(i1, len(self.sx)), min(k1, len(self.sf))
        if i1 <= i0 or k1 <= k0:
            return None
        rows, columns = np.nonzero(self.sx[i0:i1, None] == self.sf[None, k0:k1])
        if not len(rows):
            return None
        row = rows[-1] if last else rows[0]
        i, ks = i0 + int(row), columns[rows == row] + k0
        return i, int(ks[np.abs(i - ks - delta).argmin()])

    def follow_right(self, pos: int, delta: int) -> None:
        while pos < len(self.wx) and not (self.place[pos : pos + SHIFT + 1] >= 0).any():
            found = self._nearest(pos, pos + SHIFT + 1, pos - delta - SHIFT, pos - delta + 2 * SHIFT + 1, delta, False)
            if found is None:
                return
            i, k = found
            n = min(len(self.wx) - i, len(self.wf) - k)
            differ = np.flatnonzero(self.wx[i : i + n] != self.wf[k : k + n])
            end = i + (int(differ[0]) if len(differ) else n)
            delta = i - k
            self.mark(i, end, delta)
            pos = end

    def follow_left(self, pos: int, delta: int) -> None:
        while pos > 0 and not (self.place[max(0, pos - SHIFT - 1) : pos] >= 0).any():
            top = pos - SHINGLE
            found = self._nearest(top - SHIFT, top + 1, top - delta - 2 * SHIFT, top - delta + SHIFT + 1, delta, True)
            if found is None:
                return
            i, k = (v + SHINGLE for v in found)  # the shingle's end
            n = min(i, k)
            differ = np.flatnonzero(self.wx[i - n : i] != self.wf[k - n : k])
            start = i - n + (int(differ[-1]) + 1 if len(differ) else 0)
            delta = i - k
            self.mark(start, i, delta)
            pos = start


def matching_passages(
    wx: np.ndarray, wf: np.ndarray, shifts: list[tuple[int, int, int]], min_words: int = MIN_WORDS, similarity: float = SIMILARITY, runs: tuple[np.ndarray, np.ndarray] | None = None
) -> list[tuple[int, int, int, int, float]]:
    """``start, end, other start, other end, similarity`` in words of the passages of ``wx`` that ``wf`` also has.

    ``shifts`` holds ``delta, lo, hi``: where to look, and by how much ``wx`` is behind ``wf``.  Words count as shared where at least five in a row agree, at
    ``delta`` or at shifts met from there; shared words with gaps of at most ``SHIFT`` make up a passage, which is near enough by the Jaccard similarity of its bag of shingles; and so is a run of at least ``min_words``
    that agrees word by word.  ``runs`` are the shingles of both, if known.
    """
    sx, sf = runs or (shingles(wx), shingles(wf))
    width = min_words - SHINGLE + 1
    if len(sx) < width or len(sf) < similarity * width:
        return []
    bags = _Shared(sx, sf)
    if not (dense(bags.met, similarity, width) and dense(bags.met_other, similarity, int(np.ceil(similarity * width)))):
        return []
    where: dict[int, tuple[int, int]] = {}
    for delta, lo, hi in shifts:
        was = where.get(delta, (lo, hi))
        where[delta] = min(lo, was[0]), max(hi, was[1])
    both = _Alignment(wx, wf, sx, sf, min_words)
    for delta, (lo, hi) in sorted(where.items(), key=lambda w: w[1][0] - w[1][1]):  # the widest first
        if not both.inside[lo : hi + SHINGLE - 1].all():
            both.diagonal(delta, lo, hi)
    out = joined_passages(_parts(both.place), both.place, bags, min_words, similarity)
    place = both.place
    at = np.flatnonzero(place >= 0)
    if len(at) < min_words * similarity:
        return out
    delta = at - place[at]
    follows = np.zeros(len(place), np.int64)
    follows[1:] = (place[1:] - place[:-1] == 1) & (place[:-1] >= 0)
    upto = np.cumsum(follows)
    shared = upto[SHINGLE - 1 :] - upto[: len(place) - SHINGLE + 1] == SHINGLE - 1  # shingles whose words follow each other in both
    cuts = np.flatnonzero((at[1:] - at[:-1] > SHIFT + 1) | (np.abs(delta[1:] - delta[:-1]) > SHIFT)) + 1
    parts = [at[a:b] for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(at)], strict=True)]
    while parts:
        part = parts.pop()
        if not len(part):
            continue
        start, end = int(part[0]), int(part[-1]) + 1
        if end - start < min_words or any(a <= start and end <= b for a, b, *_ in out):
            continue
        first, last = int(place[part].min()), int(place[part].max()) + 1
        if len(part) == end - start == last - first and np.array_equal(wx[start:end], wf[first:last]):
            out.append((start, end, first, last, 1.0))
            continue
        near = bags.similarity(start, end - SHINGLE + 1, first, last - SHINGLE + 1, similarity)
        if near >= similarity:
            out.append((start, end, first, last, near))
            continue
        # what is too far apart as a whole may hold a passage, with as many shared shingles for its length as can be
        span = densest(shared[start : end - SHINGLE + 1], width, similarity)
        if span is not None:
            lo, hi = start + span[0], start + span[1] + SHINGLE - 1
            inside = part[(part >= lo) & (part < hi)]
            first, last = int(place[inside].min()), int(place[inside].max()) + 1
            near = bags.similarity(lo, hi - SHINGLE + 1, first, max(first, last - SHINGLE + 1), similarity)
            if near >= similarity and not any(a <= lo and hi <= b for a, b, *_ in out):
                out.append((lo, hi, first, last, near))
            parts += [part[part < lo], part[part >= hi]]
    # runs that agree word by word count whatever became of what is around them, as in texts that repeat themselves
    for start, end, delta in sorted(both.whole, key=lambda r: (r[0] - r[1], r)):
        if not any(a <= start and end <= b for a, b, *_ in out):
            out.append((start, end, start - delta, end - delta, 1.0))
    return out


def densest(shared: np.ndarray, width: int, similarity: float) -> tuple[int, int] | None:
    """The ``width`` or more neighbours with the most shared shingles over what a passage asks for, if any have enough."""
    over = np.concatenate([[0.0], np.cumsum(shared * (1 + similarity) / 2 - similarity)])
    if len(over) <= width:
        return None
    least = np.minimum.accumulate(over[:-width])
    end = int(np.argmax(over[width:] - least)) + width
    start = int(np.argmin(over[: end - width + 1]))
    return (start, end) if over[end] - over[start] >= -1e-9 * len(over) else None


def dense(met: np.ndarray, share: float, width: int) -> bool:
    """Whether at least this share of some ``width`` or more neighbours are met, as any passage asks for."""
    if len(met) < width:
        return False
    over = np.zeros(len(met) + 1)
    np.cumsum(met - share, out=over[1:])
    return bool((over[width:] - np.minimum.accumulate(over[: len(over) - width])).max() >= -1e-9 * len(over))


def _parts(place: np.ndarray) -> list[tuple[int, int, int, int]]:
    """``start, end, other start, other end`` of the runs of words whose partners also follow each other."""
    at = np.flatnonzero(place >= 0)
    if not len(at):
        return []
    there = place[at]
    cuts = np.flatnonzero((at[1:] - at[:-1] > 1) | (there[1:] - there[:-1] != 1)) + 1
    first, last = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(at)]]) - 1
    return list(zip(at[first].tolist(), (at[last] + 1).tolist(), place[at[first]].tolist(), (place[at[last]] + 1).tolist(), strict=True))


def joined_passages(parts: list[tuple[int, int, int, int]], place: np.ndarray, bags: _Shared, min_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """Passages over gaps of more than ``SHIFT`` words, as wide as the similarity lets them be.

    Runs of shared shingles that the alignment did not meet count too.  A passage begins and ends with such runs; what lies between
    may be missing in either document as long as the shingles of the whole are near enough.
    """
    if min(len(bags.x), len(bags.f)) < similarity * (min_words - SHINGLE + 1):
        return []
    once = (bags.nx == 1) & (bags.nf == 1)
    i = np.flatnonzero(once[bags.x] & (place[: len(bags.x)] < 0))
    if len(i):
        at = np.empty(bags.size, np.int64)
        at[bags.f] = np.arange(len(bags.f))
        k = at[bags.x[i]]
        cuts = np.flatnonzero((i[1:] - i[:-1] > 1) | (k[1:] - k[:-1] != 1)) + 1
        lo, hi = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(i)]]) - 1
        parts = sorted({*parts, *zip(i[lo].tolist(), (i[hi] + SHINGLE).tolist(), k[lo].tolist(), (k[hi] + SHINGLE).tolist(), strict=True)})
    if len(parts) < 2:
        return []
    start, end, first, last = np.array(parts).T
    delta = start - first
    if not ((start[1:] - end[:-1] > SHIFT) | (np.abs(delta[1:] - delta[:-1]) > SHIFT)).any():
        return []  # the alignment has no such gap
    # shingles shared in order up to a part's end, and those that stand anywhere in the other document: what a span has in common lies between the two
    shared = np.concatenate([[0], np.cumsum(np.maximum(0, end - start - SHINGLE + 1))])
    least = similarity * (min_words - SHINGLE + 1)
    if shared[-1] < least:
        return []
    met, met_other = (np.concatenate([[0], np.cumsum(v)]) for v in (bags.met, bags.met_other))
    out: list[tuple[int, int, int, int, float]] = []
    done, n = -1, len(parts)
    rows = max(1, 4096 // n)
    for top in range(0, n, rows):
        if shared[-1] - shared[top] < least:
            break
        p, q = np.arange(top, min(n, top + rows))[:, None], np.arange(top + 1, n)[None, :]
        x, f = end[q] - start[p], last[q] - first[p]
        common = shared[q + 1] - shared[p]
        i, k = np.minimum(start[p], len(met) - 1), np.minimum(first[p], len(met_other) - 1)
        most = np.minimum(met[np.maximum(end[q] - SHINGLE + 1, i)] - met[i], met_other[np.maximum(last[q] - SHINGLE + 1, k)] - met_other[k])
        sizes = x + f - 2 * (SHINGLE - 1)
        fit = (q > p) & (x >= min_words) & (f >= 1) & (first[q] >= first[p]) & (common >= similarity * (np.maximum(x, f) - SHINGLE + 1)) & (most >= similarity * (sizes - most))
        for k in np.flatnonzero(fit.any(axis=1)).tolist():
            if top + k <= done:
                continue
            for r in (np.flatnonzero(fit[k])[::-1] + top + 1).tolist():
                span = int(start[top + k]), int(end[r]), int(first[top + k]), int(last[r])
                near = bags.similarity(span[0], span[1] - SHINGLE + 1, span[2], span[3] - SHINGLE + 1, similarity)
                if near >= similarity:
                    out.append((*span, near))
                    done = r
                    break
    return out


PASSAGES = "doc_id long, text_hash int, start long, end long, other_id long, other_hash int, other_start long, other_end long, similarity double"
_FOUND = pa.schema([("x", pa.int64()), ("xh", pa.int32()), ("lo", pa.int64()), ("hi", pa.int64()), ("f", pa.int64()), ("fh", pa.int32()), ("flo", pa.int64()), ("fhi", pa.int64()), ("similarity", pa.float64())])


def near_passages(texts: DataFrame, pairs: DataFrame, min_words: int, similarity: float) -> DataFrame:
    """Passages of the documents ``x`` and ``f`` of ``pairs(x, xh, f, fh, shifts)`` that are near but do not agree word by word."""
    both = pairs.select(F.col("x").alias("doc"), F.col("xh").alias("h")).union(pairs.select("f", "fh")).distinct()
    own = materialise(texts_with(texts, both), "texts")
    joined = pairs.join(own.select(F.col("doc").alias("x"), F.col("h").alias("xh"), F.col("text").alias("x_text")), ["x", "xh"])
    joined = joined.join(own.select(F.col("doc").alias("f"), F.col("h").alias("fh"), F.col("text").alias("f_text")), ["f", "fh"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            out: list[list] = [[] for _ in _FOUND]
            ends, flat = batch.column(4).offsets.to_pylist(), batch.column(4).values
            shifts = np.column_stack([np.asarray(flat.field(k)) for k in range(3)])
            ids = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            x_words, x_bounds = words_of(batch.column(5).to_pylist())
            own = [k for k in range(batch.num_rows) if not k or ids[k][2:] != ids[k - 1][2:]]  # rows mostly come sorted by f
            f_words, f_bounds = words_of(batch.column(6).take(pa.array(own)).to_pylist())
            at = -1
            for k, (x, xh, f, fh) in enumerate(ids):
                if at + 1 < len(own) and own[at + 1] == k:
                    at += 1
                    wf = f_words[f_bounds[at] : f_bounds[at + 1]]
                    sf = shingles(wf)
                wx = x_words[x_bounds[k] : x_bounds[k + 1]]
                where = shifts[ends[k] : ends[k + 1]].tolist()
                for start, end, first, last, near in matching_passages(wx, wf, where, min_words, similarity, (shingles(wx), sf)):
                    if near < 1 or not np.array_equal(wx[start:end], wf[first:last]):
                        for values, v in zip(out, (x, xh, start, end, f, fh, first, last, near), strict=True):
                            values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(out, _FOUND, strict=True)], schema=_FOUND)

    return joined.select("x", "xh", "f", "fh", "shifts", "x_text", "f_text").mapInArrow(released(verify), "x long, xh int, lo long, hi long, f long, fh int, flo long, fhi long, similarity double")


def repeated_passages(docs: DataFrame, hashes: int = HASHES, min_words: int = MIN_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """Passages of a document that an earlier one (smaller ``doc_id``) also has: ``doc_id, text_hash, start, end, other_id, other_hash, other_start, other_end, similarity``.

    Places are counted in words.  A passage has at least ``min_words`` words.  Exact repeats are complete: every run of ``min_words`` words that an earlier document has lies in a passage of similarity 1,
    beside an earlier document that has it all, mostly the first; not every document that has it is named.  Near repeats (Jaccard similarity of their bags of shingles from ``similarity``) are
    looked for where windows meet in a signature and the window is not inside exact repeats: with the first document of the signature and the one before.

    Rows with a null id or text are left alone.  A document is an id with a text: equal rows are one document, rows with one ``doc_id`` and different texts are several, in the order of ``text_hash`` (their :func:`text_numbers`), which tells them apart.
    Repeats inside one document are not looked for, further columns are ignored, an empty table gives no rows.
    """
    texts = texts_by_hash(docs)
    links = materialise(window_links(texts, hashes, min_words, similarity), "passage-links")
    opened = links.where(F.col("what") == OPEN).select("x", "xh", "lo", "hi")
    pair = ["x", "xh", "f", "fh"]
    runs = materialise(run_links(texts, opened, min_words).select(*pair, "delta", "lo", "hi"), "run-links")
    exact = links.where(F.col("what") == EXACT).select(*pair, "delta", "lo", "hi").unionByName(runs)
    exact = materialise(islands(exact, [*pair, "delta"]), "exact-passages")
    drop_files(runs)
    covered = islands(exact.select("x", "xh", "lo", "hi"), ["x", "xh"]).groupBy("x", "xh").agg(F.collect_list(F.struct("lo", "hi")).alias("covered"))
    # the words of x around the signature that both windows hold: a near passage goes on beyond exact repeats from there, or it has others
    first, end = F.greatest("lo", F.col("c") - 2 * CONTEXT), F.least(F.col("hi") + SHINGLE - 1, F.col("c") + SHINGLE + 2 * CONTEXT)
    near = links.where(F.col("what") < EXACT).join(covered, ["x", "xh"], "left")
    inside = F.exists("covered", lambda s: (s["lo"] <= first) & (s["hi"] >= end))
    near = near.where(F.col("covered").isNull() | ~inside)

    def shifted(found: DataFrame) -> DataFrame:
        return materialise(found.groupBy(*pair).agg(F.collect_set(F.struct("delta", "lo", "hi")).alias("shifts")), "passage-pairs")

    near = materialise(near_passages(texts, shifted(near), min_words, similarity), "near-passages")
    covered = islands(exact.select("x", "xh", "lo", "hi").unionByName(near.selectExpr("x", "xh", "cast(lo as int) lo", "cast(hi as int) hi")), ["x", "xh"]).groupBy("x", "xh").agg(F.collect_list(F.struct("lo", "hi")).alias("covered"))
    members = links.where(F.col("what") == GROUP).join(covered, ["x", "xh"], "left").withColumn("open", F.col("covered").isNull() | ~inside)
    members = materialise(members.select(F.col("f").alias("key"), F.col("x").alias("doc"), F.col("xh").alias("h"), "c", "lo", "hi", "open"), "passage-groups")
    drop_files(links)
    further = near_passages(texts, shifted(further_links(texts, members, min_words, similarity)), min_words, similarity)
    near = near.unionByName(further).distinct()
    same = exact.select("x", "xh", "lo", "hi", "f", "fh", (F.col("lo") - F.col("delta")).alias("flo"), (F.col("hi") - F.col("delta")).alias("fhi"), F.lit(1.0).alias("similarity"))
    found = same.unionByName(near)
    return found.toDF("doc_id", "text_hash", "start", "end", "other_id", "other_hash", "other_start", "other_end", "similarity").selectExpr("doc_id", "text_hash", "cast(start as long) start", "cast(end as long) end", "other_id", "other_hash", "cast(other_start as long) other_start", "cast(other_end as long) other_end", "similarity")


_WORD = re.compile("[^\x20\x09-\x0d]+")


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of the spans and the white space after each of them; the rest stays as it is."""
    gone: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if gone and start <= gone[-1][1]:
            gone[-1] = (gone[-1][0], max(end, gone[-1][1]))
        else:
            gone.append((start, end))
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    out, at = [], 0
    for start, end in gone:
        out.append(text[at : starts[min(start, len(starts) - 1)]])
        at = starts[min(end, len(starts) - 1)]
    return "".join([*out, text[at:]])


def cut_passages(docs: DataFrame, passages: DataFrame) -> DataFrame:
    """``docs`` with the passages of :func:`repeated_passages` cut out of their texts; documents of which no word is left go, all others stay with all their columns.

    ``docs`` is the table in which the passages were found.  A row is cut by the passages of its id and text: rows with one ``doc_id`` and other texts are left as they are, whatever their hashes.  ``n_chars``, if there, becomes the length of the text that is left where something was cut.
    The columns of ``docs`` may have any names; rows with a null id or text stay.
    """
    spark = docs.sparkSession
    spans = passages.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("start", "end")).alias("spans"))  # no more than a document has words
    spans = materialise(spans, "passage-spans")
    if spans.count() <= BROADCAST_IDS // 8:
        spans = F.broadcast(spans)
    bounded_batches(spark)
    names, at = docs.columns, docs.columns.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None
    # the row as one value, so that no name of the input can clash with one of ours
    rows = docs.select(F.struct(*[F.col(f"`{n}`") for n in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("own_text"))
    rows = text_numbers(rows, "id", "own_text").drop("own_text")
    marked = rows.join(spans, (rows["id"] == spans["doc_id"]) & (rows["h"] == spans["text_hash"]) & F.col("row.text").isNotNull(), "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *columns, spans = batch.columns
            texts = [without_words(t, [(x["start"], x["end"]) for x in s]) for t, s in zip(columns[at].to_pylist(), spans.to_pylist(), strict=True)]
            columns[at] = pa.array(texts, columns[at].type)
            if counted is not None:
                columns[counted] = pa.array(map(len, texts), columns[counted].type)
            left = pa.array([bool(t) and not t.isspace() for t in texts])
            yield pa.RecordBatch.from_arrays(columns, names=names).filter(left)

    fields = [F.col("row").getField(n).alias(n) for n in names]
    last = next(n for n in (f"spans{k}" for k in range(len(names) + 1)) if n not in names)
    touched = marked.where("spans is not null").select(*fields, F.col("spans").alias(last)).mapInArrow(released(cut), docs.schema)
    return marked.where("spans is null").select(*fields).unionByName(touched)
