"""Sources against their language: exact sums, and a sketch that loses nothing."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import prose

from maskmetrics.llm.divergence import DEPTH, LEAST_WIDTH, divergence, kept_counts, possible, reached, term_counts


def plain(rows, least, top):
    """Rows are (text, lang, source)."""
    rows = [tuple(x or "" for x in r) for r in rows]
    words = [re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(c.lower() if c.isascii() else c for c in t)) for t, _, _ in rows]
    within, counts, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for (_, lang, source), own in zip(rows, words, strict=True):
        within[lang].update(set(own))
        counts[lang, source].update(own)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [w for w, n in within[lang].items() if n >= least]
        p = {}
        for s in sources:
            n = sum(counts[lang, s][w] for w in kept) + 5 * len(kept)
            p[s] = {w: 1 + 10**9 * (counts[lang, s][w] + 5) // n for w in kept}
        every = Counter()
        for s in sources:
            every.update({w: counts[lang, s][w] for w in kept})
        q = {w: 1 + 10**9 * (every[w] + 5) // (sum(every[x] for x in kept) + 5 * len(kept)) for w in kept}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources - {s}]
            terms = [(p[s][w] - q[w], w) for w in kept if counts[lang, s][w] and p[s][w] > q[w]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(found[:most], 1)]
    return sorted(out)


@pytest.fixture
def table(spark):
    def make(rows):
        full = [(k, *r, "clash", 7) for k, r in enumerate(rows)]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, term string, value int")

    return make


def corpus(seed, n, sources=6):
    r = random.Random(seed)
    own = {s: prose(100 + s, 12).split() for s in range(sources)}
    rows = []
    for k in range(n):
        s = 0 if r.random() < 0.4 else r.randrange(sources)
        words = prose(r.randrange(40), 30).split() + r.choices(own[s], k=10)
        rows.append((" ".join(words).title() if k % 3 else "-".join(words), r.choice(["aa", "aa", "bb", None]), f"s{s}" if s else None))
    return rows


ODD = [(None, "aa", "s1"), ("", None, None), (" \n 12 345 !!", "bb", "only"), ("ÄÖ äö Éİx a b", "aa", "s1"), ("x" * 30000 + " " + "the " * 5000, "bb", "s2"), ("alone", "zz", "s1"), ("alone", "zz", "s2"), ("word", "yy", "s1")]


@pytest.mark.parametrize("least, top", [(1, 3), (4, 50), (500, 50)])
def test_sums_are_exact(spark, table, least, top):
    rows = corpus(1, 150) + ODD * 2
    got = divergence(table(rows).repartition(7), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"] and dict(got.dtypes)["value"] == "bigint" and dict(got.dtypes)["rank"] == "int"
    assert sorted(map(tuple, got.collect())) == plain(rows, least, top)


def test_empty_table_and_bad_bounds(table):
    assert divergence(table([])).count() == 0
    with pytest.raises(ValueError):
        kept_counts(table([]), 0)


def test_counts_are_handed_on_when_many_are_held(table):
    rows = corpus(2, 60)
    every, want = np.full(DEPTH * LEAST_WIDTH // 8, 255, np.uint8), None
    for held in (50, 10**6):
        sums = defaultdict(int)
        for r in term_counts(table(rows).coalesce(1), every, LEAST_WIDTH, held).collect():
            sums[r["lang"], r["source"], r["term"], "n"] += r["count"]
            sums[r["lang"], r["source"], r["term"], "docs"] += r["docs"]
        want = want or sums
        assert sums == want


@pytest.mark.parametrize("least", [3, 300])  # the second needs cells of two bytes
def test_sketch_never_underestimates(table, least):
    r = random.Random(3)
    truth = {f"w{k:x}".translate(str.maketrans("0123456789", "ghijklmnop")): r.choice([1, 1, 1, 1, 1, 2, least - 1, least, least + 5]) for k in range(3000)}
    texts = [[] for _ in range(least + 5)]
    for word, n in truth.items():
        for k in r.sample(range(len(texts)), n):
            texts[k].append(word)
    rows = [(" ".join(t), "aa", "s") for t in texts] + [(" ".join(truth), "bb", "s")]
    bits = reached(table(rows).repartition(90), least, LEAST_WIDTH, held=500)
    assert len(bits) == DEPTH * LEAST_WIDTH // 8 and bits.dtype == np.uint8
    words = list(truth)
    ok = possible("aa", [w.encode() for w in words], bits, LEAST_WIDTH).tolist()
    passed, need = {w for w, o in zip(words, ok, strict=True) if o}, {w for w, n in truth.items() if n >= least}
    assert need <= passed and len(passed - need) < 0.05 * len(truth)
    assert possible("bb", [w.encode() for w in words], bits, LEAST_WIDTH).mean() < 0.05


def test_a_full_sketch_changes_nothing(table):
    rows = corpus(4, 400)
    small, large = (divergence(table(rows).repartition(3), 8, 50, width=w) for w in (LEAST_WIDTH, 1 << 20))
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, large.collect())) == plain(rows, 8, 50)
