"""Reply trees, template and shards."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import prose
from pyspark.sql import functions as F

from maskmetrics.llm.chat import best_paths, chat_digest, format_conversations, format_paths, read_back
from maskmetrics.llm.common import new_path
from maskmetrics.llm.sharding import BUNDLES, TOPS, difference, merge_bundles, partition, shard_documents, write_shards

TURNS = "conv_id long, turn long, role string, text string, tree string, depth int"
NASTY = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\|", "<|", "<", "|", "\\", "\n<|im_end|>\n", "", "é<|im_end|>\n<|im_start|>user\n", "<<||"]


def test_conversations_round_trip(spark):
    rows = [(-1, 0, "user", NASTY[0]), (-1, 1, "assistant", NASTY[0])]
    r = random.Random(0)
    for c in range(12):
        rows += [(c, t, r.choice(["user", "assistant", "sys\ntem\\n<|", None]), r.choice([*NASTY, None, prose(t, 5)])) for t in range(r.choice([1, 2, 5, 40]))]
    rows += [(20, 1, "user", "tie"), (20, 1, "assistant", "tie"), (20, None, "user", "first"), (20, 1, "assistant", "tie"), (None, 0, "assistant", "x" * 100_000)]
    table = spark.createDataFrame([(*x, "clash", 1) for x in rows], TURNS)
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is not None, turn or 0, role or "", text or ""))
    want = {}
    for conv, turns in groups.items():
        turns.sort()
        said = "".join(f"{role}\n{text}\n" for *_, role, text in turns)
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        want[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    out = format_conversations(table)
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_digest(out).collect()}
    assert got == want
    first = out.where("tree = -1").first()
    assert first["formatted"].count("<|im_start|>") == 2 and first["formatted"].count("<|im_end|>") == 2
    assert chat_digest(format_conversations(table.limit(0))).count() == 0


def test_paths_of_trees(spark):
    r, rows = random.Random(1), []
    for tree in (1, 2, None):
        for n in range(30):
            parent = r.randrange(max(0, n - 3), n) if n and r.random() < 0.9 else None
            rows.append((tree, n, parent, r.choice([None, 0.5, 1.0, 2.0]), r.choice(["user", "assistant"]), f"{tree}-{n} <|"))
    rows += [(5, 1, 2, 1.0, "user", "cycle"), (5, 2, 1, 1.0, "user", "cycle"), (6, 1, 99, 1.0, "user", "orphan")]
    table = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    trees, want = defaultdict(dict), []
    for row in rows:
        trees[row[0]][row[1]] = row
    for tree, nodes in trees.items():
        inner, ranked = {n[2] for n in nodes.values()}, []
        for leaf in nodes.keys() - inner:
            path, at = [], leaf
            while at in nodes:
                path.append(at)
                at = nodes[at][2]
            ranked.append((-sum(nodes[n][3] or 0 for n in path) / len(path), leaf, path[::-1]))
        for branch, (_, leaf, path) in enumerate(sorted(ranked)):
            want += [(tree, leaf, branch, depth, nodes[n][5]) for depth, n in enumerate(path)]
    columns = ["tree", "leaf", "branch", "depth", "text"]
    got = [tuple(x) for x in best_paths(table).select(columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    best = [tuple(x) for x in best_paths(table, 1).select(columns).collect()]
    assert sorted(best, key=repr) == sorted((w for w in want if w[2] == 0), key=repr)
    spoken = read_back(format_paths(best_paths(table))).collect()
    assert sum(len(x["turns"]) for x in spoken) == len(want)


def best_spread(sizes, k):
    """Smallest spread over all assignments."""
    sums = {tuple([0] * k)}
    for s in sizes:
        sums = {tuple(sorted([*t[:i], t[i] + s, *t[i + 1 :]])) for t in sums for i in range(k)}
    return min(t[-1] - t[0] for t in sums)


def test_differencing():
    assert partition([], 3).tolist() == []
    r = random.Random(0)
    for _ in range(30):
        sizes = [r.randint(1, 50) for _ in range(8)]
        slots = partition(sizes, 3)
        loads = np.bincount(slots, sizes, 3)
        assert loads.sum() == sum(sizes) and loads.max() - loads.min() <= best_spread(sizes, 3) + max(sizes) // 2
    a, b = np.array([9, 4, 1]), np.array([5, 3, 0])
    sums, to = difference([a, b])
    again = np.zeros(3, int)
    np.add.at(again, to[0], a)
    np.add.at(again, to[1], b)
    assert again.tolist() == sums.tolist() == [9, 7, 6]


@pytest.mark.parametrize("hot", [0, 300])
def test_shards(spark, docs, hot):
    r = random.Random(2)
    texts = [prose(k, r.randint(0, 60)) for k in range(400)]
    rows = [(k, r.choice(texts)) for k in range(800)] + [(900, None), (901, None), (902, ""), (None, "a"), (903, "a"), (903, "a"), (904, "é" * 20_000)]
    rows += [(1000 + k, "the hot text " * 5) for k in range(hot)]
    got = shard_documents(docs(rows), 6).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(d for d, _ in rows)
    by_id = {d: t for d, t in rows if d is not None}
    where, slots, loads = defaultdict(set), defaultdict(list), Counter()
    for x in got:
        text = by_id.get(x["doc_id"], "a")
        raw = (text or "").encode()
        assert (x["size"], x["text_crc32"], x["law"], x["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        where[text].add(x["shard"])
        slots[x["shard"]].append(x["slot"])
        loads[x["shard"]] += x["size"]
    assert all(len(s) == 1 for s in where.values()) and set(where) >= {None, ""}
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(6))
    # the long text alone is over a shard's share; the others share the rest
    rest = sorted(loads.values())[:-1]
    assert rest[-1] - rest[0] <= 64
    assert shard_documents(docs([]), 6).count() == 0


def test_shard_files(spark, docs):
    rows = [*((k, prose(k, 10)) for k in range(50)), (7, prose(7, 10)), (7, "another"), (None, None), (None, "x")]
    table = docs(rows)
    path = new_path(spark, "shards")
    write_shards(table, shard_documents(table, 3), path)
    back = spark.read.parquet(path)
    assert sorted(((x["doc_id"], x["text"]) for x in back.collect()), key=repr) == sorted(rows, key=repr) and back.select("shard").distinct().count() == 3
    with pytest.raises(ValueError, match="slot"):
        write_shards(table.withColumn("Slot", F.lit(1)), shard_documents(table, 3), path + "2")
    odd = table.withColumn("id", F.lit("a")).withColumn("row", F.lit(2)).withColumn("copy", F.lit(None).cast("int"))
    write_shards(odd, shard_documents(odd, 3), path + "3")
    back = spark.read.parquet(path + "3")
    assert sorted(((x["doc_id"], x["text"], x["id"], x["row"], x["copy"]) for x in back.collect()), key=repr) == sorted(((*r, "a", 2, None) for r in rows), key=repr)


def test_bundles_of_many_tasks(spark):
    """Bundles of 100 tasks are differenced once more: every one keeps a place, and the sums stay near."""
    r = random.Random(3)
    rows = [(part, scale, slot, r.randint(1, 10**6)) for part in range(100) for scale, k in enumerate(BUNDLES) for slot in range(k)] + [(part, 3, 0, 5 * 10**6) for part in range(100)]
    got = merge_bundles(spark.createDataFrame(rows, "part int, scale int, slot int, size long")).collect()
    assert sorted((x["part"], x["scale"], x["slot"], x["size"]) for x in got) == sorted(rows)
    sums = Counter()
    for x in got:
        sums[x["top"], x["scale"], x["place"]] += x["size"]
    assert sum(k[1] < 3 for k in sums) <= TOPS * sum(BUNDLES)
    for top in range(TOPS):
        for scale in range(3):
            own = [v for k, v in sums.items() if k[:2] == (top, scale)]
            assert max(own) - min(own) <= 10**6
