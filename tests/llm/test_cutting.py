"""Cutting-stock packing: the program's parts, and whole packings token by token."""

import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import prose
from tokenizers import Tokenizer

from maskmetrics.llm.cutting import LEVELS, choose_stream, class_tops, cut_documents, cut_sequences, cutting_digest, knapsack, patterns_for, place_pieces, plan_cuts, running

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_classes_save_roundup():
    r = random.Random(1)
    histogram = Counter(r.choice([3, 7, 8, 90, 91, 400]) for _ in range(500))
    assert class_tops(histogram, 10) == [3, 7, 8, 90, 91, 400] and class_tops({}, 5) == [] and class_tops({5: 0, 6: 1}) == [6]
    for most in (1, 2, 3, 4):
        tops = class_tops(histogram, most)
        cost = lambda t: sum(c * (min(x for x in t if x >= n) - n) for n, c in histogram.items())
        best = min(cost(t) for t in itertools.combinations(sorted(histogram), most) if t[-1] == 400)
        assert len(tops) == most and tops[-1] == 400 and cost(tops) <= 1.5 * best + 1


def test_knapsack_is_best():
    r = random.Random(2)
    for _ in range(100):
        capacity = r.randint(1, 30)
        sizes = sorted(r.sample(range(1, 31), 4))
        values = np.array([r.uniform(-0.2, 1) for _ in sizes])
        value, pattern = knapsack(sizes, values, capacity)
        counts = itertools.product(*(range(capacity // s + 1) for s in sizes))
        best = max(float(values @ np.array(c)) for c in counts if sum(a * b for a, b in zip(c, sizes)) <= capacity)
        assert value == pytest.approx(best) and float(values @ pattern) == pytest.approx(value) and int(pattern @ np.array(sizes)) <= capacity


def test_program_reaches_known_optima():
    for sizes, demand, capacity, want in [([3, 5], [10, 10], 8, 10), ([4], [7], 10, 3.5), ([3, 4, 5], [30, 30, 30], 12, 30), ([45, 36, 31, 14], [97, 610, 395, 211], 100, 452.25)]:
        patterns, uses = patterns_for(sizes, np.array(demand, float), capacity)
        assert uses.sum() == pytest.approx(want, rel=1e-3)
        assert np.allclose(patterns @ uses, demand) and (np.array(sizes) @ patterns <= capacity).all()


def lengths_of(kind, n, capacity, seed):
    r = random.Random(seed)
    draw = {
        "uniform": lambda: r.randint(1, capacity - 1),
        "short": lambda: min(capacity - 1, 1 + int(r.expovariate(30 / capacity))),
        "middle": lambda: r.randint(int(0.29 * capacity), int(0.42 * capacity)),
        "humps": lambda: min(capacity - 1, max(1, int(r.gauss(*r.choice([(capacity / 3, 20), (capacity * 0.7, 30)]))))),
        "one": lambda: capacity // 2 + 1,
    }[kind]
    return [draw() for _ in range(n)]


def best_fit(lengths, capacity):
    gaps = Counter()
    n = 0
    for x in sorted(lengths, reverse=True):
        g = min((g for g in gaps if g >= x), default=None)
        if g is None:
            g, n = capacity, n + 1
        else:
            gaps[g] -= 1
            gaps += Counter()
        gaps[g - x] += 1
    return n


@pytest.mark.parametrize("kind", ["uniform", "short", "middle", "humps", "one"])
def test_plans_use_every_piece_once(kind):
    capacity = 512
    lengths = lengths_of(kind, 20000, capacity, 3)
    plan = plan_cuts(Counter(lengths), capacity)
    filled, seen = Counter(), Counter()
    by_class = defaultdict(list)
    for x in sorted(lengths):
        by_class[int(np.searchsorted(plan.tops, x))].append(x)
    for k, runs in enumerate(plan.runs):
        for rank, times, sequence in runs:
            assert rank == seen[k]
            seen[k] += times
            for j in range(times):
                filled[sequence + j] += by_class[k][rank + j]
    assert all(seen[k] == len(v) for k, v in by_class.items())
    assert max(filled.values()) <= capacity and len(filled) == plan.sequences
    assert plan.sequences <= 1.02 * best_fit(lengths, capacity) + 2  # classes of lengths cost little


def test_stream_takes_no_more_levels_than_needed():
    capacity = 512
    counts = Counter()
    r = random.Random(4)
    for x in lengths_of("uniform", 20000, capacity, 5):
        counts[x, LEVELS + r.randrange(LEVELS)] += 1
    for _ in range(400):
        counts[capacity, r.randrange(LEVELS)] += 1
    below, plan, gaps = choose_stream(counts, capacity)
    stream = sum(n * c for (n, level), c in counts.items() if level < below)
    assert gaps <= stream <= gaps + 0.1 * capacity * sum(counts.values()) and below < LEVELS  # documents that are cut anyway suffice
    assert choose_stream({}, capacity)[1].sequences == 0
    below, plan, gaps = choose_stream({(300, LEVELS + 5): 1}, capacity)
    assert below > LEVELS + 5 and plan.sequences == gaps == 0


def test_running_sums(spark):
    r = random.Random(5)
    rows = [(k, k // 40, r.randint(0, 9)) for k in range(400)]
    got = running(spark.createDataFrame(rows, "at long, kind int, n int").repartition(5), ["at"], "kind", "n", "before").collect()
    assert len(got) == 400
    for at, kind, _, before in got:
        assert before == sum(n for a, k, n in rows if k == kind and a < at)


def check_packing(rows, got, capacity, cut_share):
    """``rows`` are ``(doc_id, ids)``, ``got`` the digest; returns the documents that are cut although they would fit."""
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    pieces, places = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    cut = 0
    assert pieces.keys() == {d for d, _ in rows}
    for doc_id, ids in rows:
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        assert [r["start"] for r in own] == [0, *itertools.accumulate(r["length"] for r in own)][:-1]
        assert sum(r["length"] for r in own) == len(ids) and all(r["length"] > 0 and r["doc_tokens"] == len(ids) for r in own)
        assert all(r["ids_crc32"] == crc(ids[r["start"] : r["start"] + r["length"]]) for r in own)
        cut += len(own) > 1 and len(ids) <= capacity
    for own in places.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(own))]
        assert [at for at, _ in sorted(own)] == ends[:-1]
        assert ends[-1] <= capacity and ends[-1] & (ends[-1] - 1) == 0  # nothing is padded
    assert cut <= cut_share * len(rows) + 5
    return cut


def test_documents(spark, docs):
    tok = Tokenizer.from_file(PATH)
    ids_of = lambda t: [*tok.encode(t or "", add_special_tokens=False).ids, 2]
    texts = [None, "", "one", "x " * 900, *(prose(k, 3 + 5 * k % 61) for k in range(300))]
    rows = list(enumerate(texts))
    found = cut_documents(docs(rows).repartition(5), PATH, 2, 256)
    check_packing([(d, ids_of(t)) for d, t in rows], cutting_digest(*found).collect(), 256, 1)
    whole = [np.frombuffer(r["ids"], "<u4").tolist() for r in cut_sequences(*found).collect()]
    assert sorted(itertools.chain(*whole)) == sorted(itertools.chain(*(ids_of(t) for _, t in rows)))
    assert all(len(w) & (len(w) - 1) == 0 for w in whole)
    # repeated rows and null ids are packed each
    odd = [(None, "no id"), (1, "same"), (1, "same"), (2, None)]
    got = cutting_digest(*cut_documents(docs(odd), PATH, 2, 256)).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == Counter((d, len(ids_of(t))) for d, t in odd)
    assert cutting_digest(*cut_documents(docs([]), PATH, 2, 256)).count() == 0
    with pytest.raises(ValueError):
        cut_documents(docs([]), PATH, 2, 100)


@pytest.mark.parametrize("kind", ["uniform", "short", "middle"])
def test_few_documents_are_cut(spark, kind):
    capacity, n = 512, 20000
    lengths = lengths_of(kind, n, capacity, 6)
    rows = spark.createDataFrame([(k, 0, x, x) for k, x in enumerate(lengths)], "copy long, start long, length int, doc_tokens long").repartition(6)
    whole, parts = (df.collect() for df in place_pieces(rows, capacity)[:2])
    filled, own = Counter(), Counter()
    for r in [*whole, *parts]:
        filled[r["sequence_id"]] += r["length"]
        own[r["copy"]] += r["length"]
    assert own == Counter(dict(enumerate(lengths))) and all(x & (x - 1) == 0 and x <= capacity for x in filled.values())
    assert len({r["copy"] for r in parts}) <= (0.12 if kind != "middle" else 0.25) * n
