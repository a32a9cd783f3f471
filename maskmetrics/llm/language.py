"""Language mixtures of documents by expectation-maximisation over letter n-grams.

A document's n-grams are taken as drawn from a mixture of languages.  Starting with the
single most likely language, the language whose admission raises the likelihood fastest is
added, the proportions are estimated by expectation-maximisation, and the larger set is kept
if the log-likelihood grows by more than the penalty; else the search ends.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, released

#: Hashed n-grams that the model tells apart.
BUCKETS = 1 << 15
#: Labelled documents of each language that the model is fitted on, about; chosen by a hash of the id.
SAMPLE = 2000
#: Count added to every n-gram.
ALPHA = 0.2
#: Penalty of one more language: this many times the logarithm of the number of n-grams.
PENALTY = 3.0
#: A language's share below this is not worth a place in the set.
LEAST_SHARE = 0.02
ROUNDS = 40
UNKNOWN = "und"
_A, _B, _C = np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917)  # odd multipliers of a hash


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by 5.  A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point of the basic plane its lower-case letter, 32 if it is no letter."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def counts_of(text: str) -> np.ndarray | None:
    """Counts of the letter n-grams (a letter with its two neighbours, and with the one before it) by bucket; None without letters."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if len(code) and code.max() >= 1 << 16:
        high = code >= 1 << 16
        known = {int(c): (int(c) if chr(int(c)).isalpha() else 32) for c in np.unique(code[high])}
        low = _letters()[np.where(high, 32, code)]
        low[high] = [known[int(c)] for c in code[high]]
    else:
        low = _letters()[code]
    padded = np.empty(len(low) + 2, np.uint32)
    padded[0] = padded[-1] = 32
    padded[1:-1] = low
    at = np.flatnonzero(low != 32)
    if not len(at):
        return None
    before, own, after = padded[at], low[at], padded[at + 2]
    two = before * _A + own * _B
    three = (two ^ (two >> np.uint32(15))) + after * _C
    shift = np.uint32(17)  # 15 bits are left
    return np.bincount(two * _C >> shift, minlength=BUCKETS) + np.bincount(three * _A >> shift, minlength=BUCKETS)


@dataclass
class Model:
    """Languages in alphabetical order and the probability of every n-gram in each (n-grams in rows)."""

    languages: list[str]
    probability: np.ndarray

    def mixture(self, counts: np.ndarray) -> tuple[list[int], np.ndarray]:
        """The language set of a document and the share of each of its languages."""
        at = np.flatnonzero(counts)
        c, p = counts[at].astype(np.float64), self.probability[at]
        total = c.sum()
        likelihood = c @ np.log(p)
        chosen, shares = [int(likelihood.argmax())], np.ones(1)
        best, mixed = float(likelihood.max()), p[:, chosen[0]]
        price = PENALTY * np.log(total + 1)
        while len(chosen) < len(self.languages):
            slope = (c / mixed) @ p
            slope[chosen] = 0
            new = int(slope.argmax())
            if slope[new] <= total:  # the likelihood is concave in the shares: no gain to be had
                break
            own = p[:, [*chosen, new]]
            pi = np.append(shares * 0.9, 0.1)
            for _ in range(ROUNDS):
                mix = own @ pi
                step = pi * ((c / mix) @ own) / total
                settled = np.abs(step - pi).max() < 1e-3
                pi = step
                if settled:
                    break
            mix = own @ pi
            gain = float(c @ np.log(mix)) - best
            if gain <= price or pi[-1] < LEAST_SHARE:
                break
            chosen, shares, best, mixed = [*chosen, new], pi, best + gain, mix
        return chosen, shares


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn n-gram probabilities from ``labelled(doc_id, text, lang)``; rows with a null text or language are left out.

    About ``sample`` documents of each language are used, chosen by a hash of ``doc_id``; their counts are added up in at most 8 tasks, so the
    driver gets at most 8 count tables per language.  No labelled rows give a model without languages.
    """
    bounded_batches(labelled.sparkSession)
    rows = labelled.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    span = 1 << 30
    mark = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(span))
    bound = F.lit(0)
    for lang, n in sizes.items():
        bound = F.when(F.col("lang") == lang, int(span * min(1.0, sample / n)) + 1).otherwise(bound)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if (n := counts_of(text)) is not None:
                    sums[lang] = sums.get(lang, 0) + n
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.astype("<i8").tobytes() for v in sums.values()], pa.binary())], names=["lang", "counts"])

    chosen = rows.where(mark < bound).select("text", "lang").repartition(8)
    table = np.full((BUCKETS, len(languages)), ALPHA)
    for lang, raw in chosen.mapInArrow(released(add), "lang string, counts binary").collect():
        table[:, languages.index(lang)] += np.frombuffer(raw, "<i8")
    return Model(languages, table / table.sum(axis=0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, languages, shares`` for every row of ``docs(doc_id, text)``.

    ``languages`` is the chosen set, largest share first (ties by name), ``shares`` their shares, ``lang_pred`` the first and ``score`` its share.
    A text that is null or has no letter is ``und`` with score 0 and no languages.  Whole texts are used; a null ``doc_id`` keeps its
    row, repeated rows are each returned, further columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages times BUCKETS numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            first, score, names, shares = [], [], [], []
            for text in batch.column(1).to_pylist():
                counts = counts_of(text) if text and own.languages else None
                found: list[tuple[float, str]] = []
                if counts is not None:
                    found = sorted((-float(s), own.languages[k]) for k, s in zip(*own.mixture(counts), strict=True))
                first.append(found[0][1] if found else UNKNOWN)
                score.append(min(1.0, -found[0][0]) if found else 0.0)
                names.append([n for _, n in found])
                shares.append([-s for s, _ in found])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(first, pa.string()), pa.array(score, pa.float64()), pa.array(names, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))],
                names=["doc_id", "lang_pred", "score", "languages", "shares"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(released(run), "doc_id long, lang_pred string, score double, languages array<string>, shares array<double>")


#: A document is kept if one language has at least this share of it.
MIN_SHARE = 0.35


def with_a_language(docs: DataFrame, model: Model, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows of ``docs(text)`` with a predicted language, whose share is at least ``min_share``; all columns stay.

    Null texts and texts without letters go; a model without languages rejects nothing else.
    """
    bounded_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def accept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value

        def one(text: str | None) -> bool:
            counts = counts_of(text) if text else None
            return counts is not None and (not own.languages or float(max(own.mixture(counts)[1])) >= min_share)

        for batch in batches:
            yield batch.filter(pa.array(map(one, batch.column(at).to_pylist()), pa.bool_()))

    return docs.mapInArrow(released(accept), docs.schema)
