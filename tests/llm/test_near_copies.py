"""SimHash, vectors and components against brute force."""

import random

import numpy as np
import pytest
import xxhash
from brute import components, edited, pairs, prose, similar

from maskmetrics.llm.components import components as spark_components
from maskmetrics.llm.simhash import bit_rate, drop_copies, fingerprint_of, near_copies, near_links, simhash_classes, stars, wide_bits, WIDE
from maskmetrics.llm.vectors import quantise, unit, vector_classes


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    parts = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    for text in (None, "", " \t\x0b", "One", "One TWO", "É é x y", prose(1, 500), "a b c " * 100):
        assert fingerprint_of(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 4])
def test_bit_sliced_links(radius):
    r = random.Random(radius)
    for _ in range(20):
        n = r.randint(1, 300)
        seeds = [r.getrandbits(64) for _ in range(max(1, n // 8))]
        fps = [r.choice(seeds) for _ in range(n)]
        fps = np.array([f ^ sum(1 << b for b in r.sample(range(64), r.randint(0, radius + 1))) for f in fps], np.uint64)
        group = np.sort(np.array([r.randint(0, 6) for _ in range(n)]))
        left, right = near_links(fps, group, radius)
        near = lambda i, j: group[i] == group[j] and int(fps[i] ^ fps[j]).bit_count() <= radius
        assert all(near(i, j) for i, j in zip(left, right, strict=True))
        assert components(range(n), zip(left.tolist(), right.tolist())) == components(range(n), [p for p in pairs(range(n)) if near(*p)])
        # of two words
        two = np.column_stack([fps, np.roll(fps, 1)])
        left, right = near_links(two, group, 2 * radius)
        near = lambda i, j: group[i] == group[j] and sum(int(a ^ b).bit_count() for a, b in zip(two[i], two[j], strict=True)) <= 2 * radius
        assert components(range(n), zip(left.tolist(), right.tolist())) == components(range(n), [p for p in pairs(range(n)) if near(*p)])


def test_stars():
    r = random.Random(2)
    for _ in range(30):
        links = [(r.randint(0, 60), r.randint(0, 60)) for _ in range(r.randint(0, 60))] + [(k, k + 1) for k in range(100, 100 + r.randint(0, 90))]
        u, v = stars(*(np.array(x, np.int64) for x in (zip(*links, strict=True) if links else ((), ()))))
        nodes = {n for p in links for n in p}
        want = components(nodes, links)
        assert sorted(zip(u.tolist(), v.tolist())) == sorted((n, c) for n, c in want.items() if n != c)


def corpus():
    rows = []
    for k in range(12):
        text = prose(k, 120)
        rows += [(10 * k, text), (10 * k + 1, text), (10 * k + 2, text.upper() if k % 2 else text + " more"), (10 * k + 3, text.replace(" ", "\n", 3))]
    return [*rows, (900, None), (901, ""), (902, " "), (903, "one"), (904, "ONE"), (905, prose(77, 20_000)), (906, prose(77, 20_000) + " x")]


def test_simhash_classes(docs):
    rows = corpus()
    ids = [d for d, _ in rows]
    fps = {d: plain_fingerprint(t) for d, t in rows}
    want = components(ids, [(a, b) for a, b in pairs(ids) if (fps[a] ^ fps[b]).bit_count() <= 2])
    got = {r["doc_id"]: (r["fp"] % (1 << 64), r["component_id"]) for r in simhash_classes(docs(rows)).collect()}
    assert got == {d: (fps[d], want[d]) for d in ids}
    odd = simhash_classes(docs([(None, "a"), (None, "b c d"), (5, "a"), (5, "a")])).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in odd if r["doc_id"] is not None) == [(5, 5), (5, 5)]
    assert [r["component_id"] for r in odd if r["doc_id"] is None] in ([5, None], [None, 5])
    assert simhash_classes(docs([])).count() == 0


def near_corpus():
    rows = []
    for k in range(15):
        text = prose(k, 100 + 40 * k)
        rows += [(10 * k + e, edited(text, e, e * (2 + k) // 2)) for e in range(8)]
    return [*rows, (900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one  TWO"), (905, "one three"), (906, prose(77, 20_000)), (907, prose(77, 20_000) + " x"), (904, "one  TWO")]


def test_near_copies_are_those_of_brute_force(docs):
    rows = near_corpus()
    texts = dict(rows)
    want = components(texts, [(a, b) for a, b in pairs(texts) if similar(texts[a], texts[b])])
    assert len(set(want.values())) not in (1, len(want))
    got = near_copies(docs([*rows, (None, "x")])).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["component_id"] for r in got} == want
    assert near_copies(docs([])).count() == 0


def test_estimate_of_similarity():
    for seed in range(20):
        text = prose(seed, 400)
        other = edited(text, seed, 3 * seed)
        a, b = (set(zip(*[t.split()[k:] for k in range(5)])) for t in (text, other))
        rate = bit_rate(len(a & b) / len(a | b))
        assert abs(int((wide_bits(text, 5) != wide_bits(other, 5)).sum()) - WIDE * rate) <= 4.5 * (WIDE * rate * (1 - rate)) ** 0.5 + 1


def test_one_document_of_each_group_stays(docs):
    long = prose(1, 100)
    rows = [(1, "a b c d"), (2, "A b  c d"), (3, "other words stand here"), (3, "other words stand here"), (None, "a b c d"), (None, None), (4, long), (5, edited(long, 1, 1)), (6, edited(long, 2, 40))]
    kept = drop_copies(docs(rows))
    assert kept.columns == docs(rows).columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4], rows[5], rows[6], rows[8]], key=repr)


def test_unequal_texts_with_one_id(spark):
    a, b = prose(1, 60), prose(2, 60)
    rows = [(1, a), (3, a), (3, b), (3, b), (4, b + " x"), (3, None), (2, ""), (None, a)]
    table = spark.createDataFrame([(*r, 1, 2, "x", 3) for r in rows], "doc_id long, text string, _gone_id long, _twice_id long, text_hash string, component_id int")
    kept = drop_copies(table)
    assert kept.columns == table.columns
    assert sorted([tuple(r)[:2] for r in kept.collect()], key=repr) == sorted([(1, a), (3, b), (2, ""), (None, a)], key=repr)
    classes = {(r["doc_id"], r["text_hash"]): r["component_id"] for r in near_copies(table).collect()}
    assert sorted(classes.values()) == [1, 1, 2, 2, 3, 3]


def test_components(spark):
    r = random.Random(3)
    links = [(r.randint(-50, 400), r.randint(-50, 400)) for _ in range(150)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3)]
    got = {x["node"]: x["component"] for x in spark_components(spark.createDataFrame(links, "u long, v long")).collect()}
    real = [(a, b) for a, b in links if a is not None and a != b]
    want = components({n for p in real for n in p}, real)
    assert got == want
    assert spark_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_error_bound_holds():
    rng = np.random.default_rng(0)
    for d in (3, 64, 1500):
        x = unit(rng.standard_normal((60, d)) * rng.random((60, 1)))
        q, s, near, error = quantise(x)
        approx = (q.astype(int) @ q.T.astype(int)) * s[:, None] * s[None, :]
        bound = near[:, None] * error[None, :] + error[:, None] * np.linalg.norm(x, axis=1)[None, :]
        assert (np.abs(x @ x.T - approx) <= bound + 1e-12).all()


def test_vector_classes(spark):
    rng = np.random.default_rng(1)
    rows, base = [], rng.standard_normal((6, 16))
    for k in range(150):
        v = base[k % 6] + rng.standard_normal(16) * (0.02 * (k % 20))
        rows.append((k, [float(np.float32(c)) for c in v], k % 3))
    rows += [(200, rows[0][1], 0), (201, rows[0][1], 0), (202, None, 0), (203, [0.0] * 16, 0), (204, [float("nan")] + [1.0] * 15, 0), (205, [None] + [1.0] * 15, 0), (206, rows[0][1], None), (207, rows[0][1], 1), (208, [1.0, 2.0], 0), (209, [2.0, 4.0], 0), (210, [], 0), (211, [1e300] * 16, 0), (212, [1e-300] * 16, 0), (213, [float("inf")] * 16, 0)]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, least string")

    def cosine(a, b):
        a, b = np.array(a) / np.abs(a).max(), np.array(b) / np.abs(b).max()
        return a @ b / (np.linalg.norm(a) * np.linalg.norm(b))

    fit = {i: (v, g) for i, v, g in rows if g is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    links = [(a, b) for a, b in pairs(fit) if fit[a][1] == fit[b][1] and len(fit[a][0]) == len(fit[b][0]) and cosine(fit[a][0], fit[b][0]) >= 0.93]
    classes = components([r[0] for r in rows], links)
    counts = {i: sum(i in p for p in links) for i in classes}
    for tile in (8, 1024):  # with many tiles and with one
        got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in vector_classes(table, tile=tile).collect()}
        assert got == {i: (counts[i], c, i == c) for i, c in classes.items()}
    assert vector_classes(table.limit(0)).count() == 0
    same = spark.createDataFrame([(None, [1.0, 0.0], 0), (None, [1.0, 0.01], 0), (4, [0.0, 1.0], 0), (4, [0.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, vector_classes(same).collect()), key=repr) == sorted([(None, 1, None, True), (None, 1, None, True), (4, 1, 4, True), (4, 1, 4, True)], key=repr)


def test_star_of_edited_copies(docs):
    """Copies that are near to the original and not to one another: links that fail must not stand in for true ones."""
    r = random.Random(5)
    rows = []
    for star in range(3):
        words = prose(500 + star, 300).split()
        rows.append((1000 * star + 500, " ".join(words)))
        for k in range(250):
            own = list(words)
            for at in r.sample(range(0, 300, 8), 5):
                own[at] = f"new{star}x{k}x{at}"
            rows.append((1000 * star + k, " ".join(own)))
    texts = dict(rows)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in texts.items())}
    near = [(a, b) for a, b in pairs(texts) if a // 1000 == b // 1000 and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = components(texts, near)
    assert max(sum(c == w for c in want.values()) for w in set(want.values())) > 200
    got = {x["doc_id"]: x["component_id"] for x in near_copies(docs(rows)).collect()}
    assert got == want


def test_short_copies(docs):
    """Texts of 8 and 9 words: one without its first or last word is just near enough."""
    rows = []
    for k in range(300):
        words = prose(9000 + k, 9).split()
        words[4] = f"w{k}"
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join(words[1:] if k % 2 else words[:-1])), (10 * k + 2, " ".join([*words[:-1], "other"]))]
    texts = dict(rows)
    want = components(texts, [(a, b) for a, b in pairs(texts) if a // 10 == b // 10 and similar(texts[a], texts[b])])
    assert {x["doc_id"]: x["component_id"] for x in near_copies(docs(rows)).collect()} == want
