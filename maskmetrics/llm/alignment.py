"""Tokens of two tokenizers over the same texts: which belong together, and which stand for each other.

The tokens of both sides are the nodes of a graph with an edge wherever two of them overlap in bytes.  Union-find gives its
connected components; those are the smallest groups of tokens that cover the same bytes, as a component ends where a token of
either side ends.  The members of a component are then expanded to links, pairs whose bytes end together, and links are counted
over all documents.

Both sides always end a token before a blank that follows something else, so a text's components are those of its words, and a
bounded memo of words saves most of the work; the new words of a batch are one graph.  A text of which a word does not come back byte by byte is aligned as a whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, materialise, released
from .encoding import _BYTE_LEVEL

#: Words that a worker remembers, links that a task holds before it hands their counts on, and counts that are broadcast at a time.
MEMO_WORDS, HELD_LINKS, BLOCK_PAIRS = 300_000, 1_000_000, 4_000_000
#: White space at either end or next to white space; other texts are cut at every blank.
_UNEVEN = re.compile(r"\s\s|^\s|\s$")
_WORDS = re.compile(r"(?<=\S)(?= )")


def union_find(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node of each of ``n`` nodes' components, by the edges ``u, v``: roots are hooked to smaller ones, then paths are halved."""
    parent = np.arange(n)
    while True:
        a, b = parent[u], parent[v]
        if (a == b).all():
            return parent
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (parent != (up := parent[parent])).any():
            parent = up


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens that share a byte; ``a`` and ``b`` are the tokens' ends, which rise to the same last one."""
    ends = np.union1d(a, b)  # each stretch between two ends lies in one token of either side
    return np.searchsorted(a, ends), np.searchsorted(b, ends)


def groups_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The component of every token of either side, numbered from 0 in order of the text."""
    i, j = overlaps(a, b)
    roots = union_find(len(a) + len(b), i, len(a) + j)
    _, numbers = np.unique(roots, return_inverse=True)  # a component's smallest node is its first token of the first side
    return numbers[: len(a)], numbers[len(a) :]


class Aligned(NamedTuple):
    """What is kept of a word or text: numbers of tokens and groups, the groups as ``a1,a2|b1;..``, and its links as packed pairs."""

    n_a: int
    n_b: int
    n_groups: int
    groups: str
    links: bytes


NOTHING = Aligned(0, 0, 0, "", b"")


class Aligner:
    """Align texts by a byte-level tokenizer, which gets a blank before the text, and a piece tokenizer, which adds it itself."""

    def __init__(self, byte_path: str, piece_path: str, memo_words: int = MEMO_WORDS):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=piece_path)
        alphabet = {chr(_BYTE_LEVEL.get(byte, byte)): byte for byte in range(256)}
        self.a_bytes = [b""] * self.a.get_vocab_size(with_added_tokens=True)
        for entry, k in self.a.get_vocab(with_added_tokens=True).items():
            self.a_bytes[k] = bytes(map(alphabet.__getitem__, entry)) if all(c in alphabet for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("the piece tokenizer joins words")
        self.base = len(pieces)
        self.dtype = np.dtype("<u4" if len(self.a_bytes) * self.base <= 1 << 32 else "<u8")
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in own], np.int64) for own in (self.a_bytes, self.b_bytes))
        # ids as text, with what follows them: another of the group, the other side, the next group
        self.shown = np.array([f"{k}{end}" for own, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for k in range(len(own))], object)
        self.memo_words, self.memo = memo_words, {}

    def several(self, texts: list[str]) -> list[Aligned | None]:
        """Texts aligned at once, each on its own; None for one of which a side does not give its bytes back."""
        a = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b = self.b.encode(texts, num_threads=1)
        out: list[Aligned | None] = [None] * len(texts)
        good = []
        for k, text in enumerate(texts):
            want = b" " + text.encode()
            if b"".join([self.a_bytes[x] for x in a[k]]) == want and b"".join([self.b_bytes[x] for x in b[k]]) == want:
                good.append(k)
        if not good:
            return out
        n_a, n_b = (np.array([len(own[k]) for k in good]) for own in (a, b))
        ids_a, ids_b = (np.array([x for k in good for x in own[k]], np.int64) for own in (a, b))
        ends_a, ends_b = np.cumsum(self.a_sizes[ids_a]), np.cumsum(self.b_sizes[ids_b])
        group_a, group_b = groups_of(ends_a, ends_b)  # a text ends a token of both sides, so none joins two texts
        # the members of each group, one side after the other, as text
        last_a, last_b = np.append(np.diff(group_a), 1), np.append(np.diff(group_b), 1)
        shown = np.concatenate([ids_a + last_a * len(self.a_bytes), 2 * len(self.a_bytes) + ids_b + last_b * len(self.b_bytes)])
        shown = self.shown[shown[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")]].tolist()
        # the members of each group that end together
        mate = np.searchsorted(ends_b, ends_a)
        linked = np.flatnonzero((ends_b[mate] == ends_a) & (group_b[mate] == group_a))
        links = (ids_a[linked] * self.base + ids_b[mate[linked]]).astype(self.dtype).tobytes()
        stop_a, stop_b = np.cumsum(n_a), np.cumsum(n_b)
        stop_links = np.searchsorted(linked, stop_a) * self.dtype.itemsize
        groups = np.diff(group_a[stop_a - 1], prepend=-1)
        lo = lo_links = 0
        for k, x, y, g, hi, hi_links in zip(good, n_a.tolist(), n_b.tolist(), groups.tolist(), (stop_a + stop_b).tolist(), stop_links.tolist(), strict=True):
            out[k] = Aligned(x, y, g, "".join(shown[lo:hi])[:-1], links[lo_links:hi_links])
            lo, lo_links = hi, hi_links
        return out

    def align(self, texts: list[str | None]) -> list[Aligned]:
        """Null, empty and texts that do not come back byte by byte have no tokens."""
        words = [None if not t else [w[1:] for w in _WORDS.split(" " + t)] if _UNEVEN.search(t) else t.split(" ") for t in texts]
        if len(self.memo) > self.memo_words:
            self.memo.clear()
        memo = self.memo
        new = list({w for own in words if own for w in own if w not in memo})
        memo.update(zip(new, self.several(new), strict=True))
        out = []
        for text, own in zip(texts, words, strict=True):
            if not own:
                out.append(NOTHING)
                continue
            parts = [memo[w] for w in own]
            if None in parts:
                out.append(self.several([text])[0] or NOTHING)
            else:
                n_a, n_b, n_groups, groups, links = zip(*parts, strict=True)
                out.append(Aligned(sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)))
        return out


@lru_cache(maxsize=2)
def aligner(byte_path: str, piece_path: str, memo_words: int = MEMO_WORDS) -> Aligner:
    """One aligner per Python worker and pair of tokenizers."""
    return Aligner(byte_path, piece_path, memo_words)


_ROW = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs binary, times binary, groups string"


def aligned(docs: DataFrame, byte_path: str, piece_path: str, groups: bool = False, memo_words: int = MEMO_WORDS) -> DataFrame:
    """Every row of ``docs(doc_id, text)`` with the numbers of its tokens, groups and links.

    ``pairs`` holds its different linked pairs of ids, packed as ``a * pieces + b`` and sorted, ``times`` how often each stands in
    it; ``groups`` its groups as text if asked for, ``groups_sha256`` their digest ('' without tokens).
    """
    bounded_batches(docs.sparkSession)
    names = [field.split()[0] for field in _ROW.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(byte_path, piece_path, memo_words)
        for batch in batches:
            out: list[tuple] = []
            for doc_id, own in zip(batch.column(0).to_pylist(), both.align(batch.column(1).to_pylist()), strict=True):
                pairs, times = np.unique(np.frombuffer(own.links, both.dtype), return_counts=True)
                digest = sha256(own.groups.encode()).hexdigest() if own.n_a else ""
                out.append((doc_id, own.n_a, own.n_b, own.n_groups, int(times.sum()), digest, pairs.tobytes(), times.astype("<u4").tobytes(), own.groups if groups else None))
            kinds = [pa.int64()] * 5 + [pa.string(), pa.binary(), pa.binary(), pa.string()]
            columns = zip(*out, strict=True) if out else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(released(run), _ROW)


def pair_counts(rows: DataFrame, base: int, wide: bool = False, held: int = HELD_LINKS) -> DataFrame:
    """``pair, n, best``: how many links of ``rows(pairs, times)`` hold each pair, and whether no other pair of its second id has more.

    Every task adds up its own rows first, so a frequent pair is one row a task at most for each ``held`` pairs that it has seen.
    """
    dtype = np.dtype("<u8" if wide else "<u4")

    def added(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        pairs, which = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.zeros(len(pairs), np.int64)
        np.add.at(sums, which, np.concatenate(times))
        return pairs, sums

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, sums = np.zeros(0, dtype), np.zeros(0, np.int64)
        for batch in batches:
            raw = [b"".join(batch.column(c).to_pylist()) for c in (0, 1)]
            pairs, sums = added([pairs, np.frombuffer(raw[0], dtype)], [sums, np.frombuffer(raw[1], "<u4").astype(np.int64)])
            if len(pairs) > held:
                yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(sums)], names=["pair", "n"])
                pairs, sums = pairs[:0], sums[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pairs.astype(np.int64)), pa.array(sums)], names=["pair", "n"])

    counts = rows.select("pairs", "times").mapInArrow(released(run), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "pairs").withColumn("second", F.col("pair") % base)
    most = counts.groupBy("second").agg(F.max("n").alias("most"))
    return counts.join(most, "second").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def scored(rows: DataFrame, counts: DataFrame, wide: bool = False, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """``rows`` with ``n_best`` and ``count_sum``: their links whose pair is best, and the sum of their links' counts.

    The counts, of which there are at most as many as pairs of ids, are broadcast in blocks of about ``block_pairs``; each block
    adds its part to all rows, and the rows of all but the last are written in between.
    """
    spark, dtype = rows.sparkSession, np.dtype("<u8" if wide else "<u4")
    counts = materialise(counts, "counts")
    blocks = max(1, -(-counts.count() // block_pairs))
    rows = rows.withColumn("n_best", F.lit(0).cast("long")).withColumn("count_sum", F.lit(0).cast("long"))
    block = F.pmod(F.xxhash64("pair"), F.lit(blocks))

    def adder(sent):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known, n, best = sent.value
            for batch in batches:
                keys, times = batch.column("pairs").to_pylist(), batch.column("times").to_pylist()
                ends = np.cumsum([0, *(len(k) // dtype.itemsize for k in keys)])
                pairs, times = np.frombuffer(b"".join(keys), dtype), np.frombuffer(b"".join(times), "<u4").astype(np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, pairs), len(known) - 1)
                    times = times * (known[at] == pairs)
                    sums = [np.cumsum(np.append(0, times * x[at])) for x in (best, n)]
                else:
                    sums = [np.zeros(len(pairs) + 1, np.int64)] * 2
                for name, x in zip(("n_best", "count_sum"), sums, strict=True):
                    place = batch.schema.get_field_index(name)
                    batch = batch.set_column(place, name, pa.array(batch.column(place).to_numpy() + x[ends[1:]] - x[ends[:-1]]))
                yield batch

        return released(run)

    for k in range(blocks):
        own = counts.where(block == k).toArrow()
        pairs = own["pair"].to_numpy().astype(dtype)
        order = np.argsort(pairs)
        sent = spark.sparkContext.broadcast((pairs[order], own["n"].to_numpy()[order], own["best"].to_numpy(zero_copy_only=False)[order].astype(np.int64)))
        rows = rows.mapInArrow(adder(sent), rows.schema)
        if k < blocks - 1:
            rows = materialise(rows, "scored")
    return rows


def align_documents(docs: DataFrame, byte_path: str, piece_path: str, groups: bool = False, memo_words: int = MEMO_WORDS, block_pairs: int = BLOCK_PAIRS) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with its alignment and what the corpus says of its links.

    ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` and, if asked for, ``groups``.  A null or empty text
    and one that a tokenizer does not give back byte by byte has no tokens.  Rows with a null or repeated ``doc_id`` stay apart and count
    each; other columns are ignored; an empty table gives no rows.
    """
    rows = materialise(aligned(docs, byte_path, piece_path, groups, memo_words), "aligned")
    both = aligner(byte_path, piece_path, memo_words)
    wide = both.dtype.itemsize == 8
    out = scored(rows, pair_counts(rows, both.base, wide), wide, block_pairs)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *["groups"] * groups)
