"""The registered queries on the smallest tables against brute force."""

import html
import json
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from brute import components, pairs, repeated_windows
from sentencepiece import SentencePieceProcessor
from test_alignment import expected
from test_cutting import check_packing
from test_near_copies import plain_fingerprint
from tokenizers import Tokenizer

from maskmetrics.llm import queries
from maskmetrics.llm.decontamination import allowed_edits, plain

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def rows():
    return {r["doc_id"]: r for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def result(spark, name):
    return queries.QUERIES[name](spark, DATA).collect()


@pytest.fixture(scope="module")
def ids_of(rows):
    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return {d: [*tok.encode(r["text"] or "", add_special_tokens=False).ids, 1] for d, r in rows.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, rows, ids_of):
    got, start = {r["doc_id"]: tuple(r)[1:4] for r in result(spark, "op1_token_codes")}, 0
    assert len(got) == len(rows)
    for d in sorted(rows):
        assert got[d] == (start, len(ids_of[d]), crc(ids_of[d]))
        start += len(ids_of[d])


def test_op2(spark, rows):
    got = {r["doc_id"]: r for r in result(spark, "op2_language_mixture")}
    assert got.keys() == rows.keys()
    learned = {r["lang"] for d, r in rows.items() if zlib.crc32(str(d).encode()) % 5}
    right = held = 0
    for d, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in rows[d]["text"] or "")
        assert r["lang_pred"] in learned if letters else r["lang_pred"] == "und"
        if r["held_out"] and rows[d]["lang"] is not None and letters:
            held += 1
            right += r["lang_pred"] == rows[d]["lang"]
    assert held > 10 and right >= 0.95 * held


def test_op4(spark, rows):
    got = result(spark, "op4_byte_shards")
    assert sorted(r["doc_id"] for r in got) == sorted(rows)
    loads, slots, groups = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (rows[r["doc_id"]]["text"] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        loads[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        groups[raw].add(r["shard"])
    assert set(loads) <= set(range(24)) and all(len(g) == 1 for g in groups.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for r in rows.values():
        sizes[r["text"]] += len((r["text"] or "").encode()) + 8
    # no worse than giving each group, largest first, to the smallest shard
    greedy = [0] * 24
    for size in sorted(sizes.values(), reverse=True):
        greedy[greedy.index(min(greedy))] += size
    spread = lambda s: max(s) - min(s)
    assert spread([loads[k] for k in range(24)]) <= spread(greedy)


def test_op5(spark, rows, ids_of):
    got, places = defaultdict(dict), defaultdict(list)
    for r in result(spark, "op5_best_fit_packing"):
        got[r["doc_id"]][r["piece"]] = (r["start"], r["length"], r["ids_crc32"])
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for d, ids in ids_of.items():
        assert got[d] == {k: (at, len(part), crc(part)) for k, at in enumerate(range(0, len(ids), 4096)) for part in [ids[at : at + 4096]]}
    for own in places.values():
        ends = [0, *np.cumsum([n for _, n in sorted(own)]).tolist()]
        assert [at for at, _ in sorted(own)] == ends[:-1] and ends[-1] <= 4096
    total = sum(map(len, ids_of.values()))
    assert len(places) <= -(-total // 4096) * 1.02 + 1


def test_op7(spark, rows):
    got = result(spark, "op7_repeated_passages")
    covered = {(r["doc_id"], i) for r in got for i in range(r["start"], r["end"] - 49)}
    need = repeated_windows([(d, r["text"]) for d, r in rows.items()], 50)
    assert need and need <= covered
    assert got[0].asDict().keys() == {"doc_id", "start", "end", "other_id", "other_start", "other_end", "similarity"}
    assert all(r["other_id"] < r["doc_id"] for r in got)


def fewest_edits(item, text):
    """Edits of the best place of an item in a text, by the full table."""
    a, b = (np.frombuffer(t.encode("utf-32-le"), "<u4") for t in (item, text))
    where, cost = np.arange(len(b) + 1), np.zeros(len(b) + 1, np.int64)
    for i, c in enumerate(a, 1):
        new = np.minimum(cost + 1, np.concatenate([[i], cost[:-1] + (b != c)]))
        cost = np.minimum.accumulate(new - where) + where
    return int(cost.min())


def test_op8(spark, rows):
    items = {r["item_id"]: plain(r["text"]) for r in pq.read_table(f"{DATA}/benchmark.parquet").to_pylist()}
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in result(spark, "op8_benchmark_passages")}
    want = {}
    for d, r in rows.items():
        text = plain(r["text"])
        for i, item in items.items():
            if text and (edits := fewest_edits(item, text)) <= allowed_edits(len(item)):
                want[d, i] = edits
    assert want and got == want


def test_op9(spark, rows):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in result(spark, "op9_simhash")}
    fps = {d: plain_fingerprint(r["text"]) for d, r in rows.items()}
    want = components(rows, [(a, b) for a, b in pairs(rows) if (fps[a] ^ fps[b]).bit_count() <= 2])
    assert got == {d: (f"{fps[d]:016x}", want[d]) for d in rows}


def test_op10(spark):
    got = {r["page_id"]: r for r in result(spark, "op10_main_text")}
    pages = pq.read_table(f"{DATA}/pages.parquet").to_pylist()
    assert len(got) == len(pages)
    for page in pages:  # these pages keep their text in an article of headings and paragraphs
        article = re.search("<article>(.*)</article>", page["html"], re.S)[1]
        blocks = re.split(r"</?(?:p|h\d|div|li|ul|article|section)\b[^>]*>", re.sub(r"<(script|style)\b.*?</\1>|<!--.*?-->", "", article, flags=re.S))
        lines = [" ".join(html.unescape(re.sub(r"<br>", " ", b)).replace("<b>", "").replace("</b>", "").split()) for b in blocks]
        want = "\n".join(x for x in lines if x)
        r = got[page["page_id"]]
        assert (r["url"], r["text"], r["n_chars"]) == (page["url"], want, len(want)), json.dumps(page["html"][:300])


def test_op12(spark, rows):
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    both = a, SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    got = sorted(map(tuple, result(spark, "op12_token_alignment")))
    assert got == sorted(expected(both, [(d, r["text"]) for d, r in rows.items()]))
    assert sum(r[4] > 0 for r in got) > 0.9 * len(rows)


def test_op13(spark, rows, ids_of):
    check_packing([(d, [*ids[:-1], 2]) for d, ids in ids_of.items()], result(spark, "op13_cutting_stock"), 4096, 1)
