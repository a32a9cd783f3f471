"""Token codes and packing: exact round trips."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from brute import prose
from tokenizers import Tokenizer

from maskmetrics.llm import token_codes as codes
from maskmetrics.llm.common import new_path
from maskmetrics.llm.encoding import WordEncoder
from maskmetrics.llm.packing import pack_documents, packing_digest, plan_runs, sequences, sweep

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a\x1cb", "<|endoftext|>x <|endoftext|>", "don't 12ab ÉTÉ İstanbul ΑΣ ǅ", "é́ ́", "x" * 5000, "日本 語 テスト", "Words!!! and### more,", "😀 a b"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_words_encode_as_whole_texts(tokenizer):
    texts = [t or "" for t in ODD] + [prose(k, 200).title() + "." for k in range(20)]
    enc = WordEncoder(PATH, memo_words=50)  # the memo overflows
    for text, raw in zip(texts, enc.encode(texts), strict=True):
        assert np.frombuffer(raw, enc.dtype).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("widths", [(8, 8, 16), (4, 4, 8), (1, 3, 12, 16), (32,)])
def test_codes_round_trip_and_random_access(widths):
    r = random.Random(1)
    for n in (0, 1, 511, 512, 513, 2000):
        top = min(1 << sum(widths), 1 << 16) - 1
        ids = np.array([r.choice([0, 1, top, r.randint(0, top), r.randint(0, 300)]) & top for _ in range(n)], np.uint32)
        reader = codes.Reader(codes.pack(ids, widths))
        assert len(reader) == n and reader.all().tolist() == ids.tolist()
        for i in {0, n - 1, n // 2, *r.sample(range(n), min(n, 50))} & set(range(n)):
            assert reader[i] == ids[i]
    with pytest.raises(ValueError):
        codes.pack(np.array([1 << 20], np.uint32), (4, 4))
    with pytest.raises(IndexError):
        codes.Reader(codes.pack(np.array([1], np.uint32)))[1]


def test_file_round_trip(spark, docs, tokenizer):
    rows = [(7, "b c"), (None, "none"), (3, None), (7, "b c"), (5, "x" * 3000), *((k + 10, t) for k, t in enumerate(ODD)), *((k + 100, prose(k, 300)) for k in range(30))]
    path = new_path(spark, "codes")
    codes.write_codes(docs(rows).repartition(5), path, PATH, 1, segment_tokens=700)
    got = sorted(map(tuple, codes.digests(codes.read_codes(spark, path)).collect()), key=lambda r: r[1])
    want, at = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = ids_of(tokenizer, text)
        want.append((doc_id, at, len(ids), crc(ids)))
        at += len(ids)
    assert got == want
    assert codes.token_codes(docs([]), PATH, 1).count() == 0

    every = [i for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")) for i in ids_of(tokenizer, text)]
    asked = [0, len(every) - 1, 699, 700, 701, 5, 5, *random.Random(2).sample(range(len(every)), 200)]
    table = spark.createDataFrame([(p,) for p in [*asked, -1, len(every), None]], "position long")
    segments = codes.read_codes(spark, path)
    assert sorted(map(tuple, codes.tokens_at(segments, table).collect())) == sorted((p, every[p]) for p in asked)
    for doc_id, i in ((105, 3), (7, 1), (3, 0), (129, 100)):
        assert codes.token_at(spark, path, doc_id, i) == ids_of(tokenizer, dict(rows)[doc_id])[i]
    with pytest.raises(IndexError):
        codes.token_at(spark, path, 3, 1)
    with pytest.raises(KeyError):
        codes.token_at(spark, path, 4, 0)


def check_plan(histogram, capacity):
    spans, count = defaultdict(list), defaultdict(int)
    for length, rank, n, sequence, offset in plan_runs(histogram, capacity):
        assert rank == count[length]
        count[length] += n
        for k in range(n):
            spans[sequence + k].append((offset, length))
    assert dict(count) == {k: v for k, v in histogram.items() if v}
    for parts in spans.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(spans)


def test_plans_fit_and_are_tight():
    r = random.Random(0)
    for capacity, n in ((10, 7), (4096, 5000), (64, 300)):
        for _ in range(10):
            histogram = defaultdict(int)
            for _ in range(n):
                histogram[min(capacity, 1 + int(r.expovariate(4 / capacity)))] += 1
            total = sum(k * v for k, v in histogram.items())
            assert check_plan(histogram, capacity) <= -(-total // capacity) * 1.02 + 1
    assert check_plan({}, 8) == 0 and check_plan({8: 3}, 8) == 3 and check_plan({5: 4}, 8) == 4 and check_plan({5: 4, 3: 4}, 8) == 4


def test_sweep_gives_the_smallest_gap_that_fits():
    r = random.Random(2)
    for _ in range(200):
        lengths = {r.randint(1, 9): r.randint(1, 3) for _ in range(3)}
        gaps = {r.randint(1, 12): r.randint(1, 3) for _ in range(3)}
        free = sorted(g for g, n in gaps.items() for _ in range(n))
        want = []
        for length in sorted((k for k, n in lengths.items() for _ in range(n)), reverse=True):
            fit = [g for g in free if g >= length]
            if fit:
                free.remove(fit[0])
                want.append((length, fit[0]))
        got = [(length, gap) for length, gap, n in sweep(list(lengths.items()), list(gaps.items())) for _ in range(n)]
        assert sorted(got) == sorted(want)


def test_packing(spark, docs, tokenizer):
    rows = [(None, "none"), (1, None), (2, "a b c"), (2, "a b c"), (3, "x " * 500), *((k + 10, prose(k, 20 + 7 * k)) for k in range(40))]
    pieces, places = pack_documents(docs(rows), PATH, 1, 64)
    got = packing_digest(pieces, places).collect()
    want = defaultdict(int)
    for doc_id, text in rows:
        ids = ids_of(tokenizer, text)
        for piece, at in enumerate(range(0, len(ids), 64)):
            part = ids[at : at + 64]
            want[(doc_id, piece, at, len(part), crc(part))] += 1
    have = defaultdict(int)
    for g in got:
        have[tuple(g)[:5]] += 1
    assert have == want
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in sequences(pieces, places).collect()}
    for g in got:
        own = whole[g["sequence_id"]][g["offset"] : g["offset"] + g["length"]]
        assert crc(own) == g["ids_crc32"]
    assert sum(map(len, whole.values())) == sum(g["length"] for g in got) and max(map(len, whole.values())) <= 64
    assert packing_digest(*pack_documents(docs([]), PATH, 1, 64)).count() == 0
