"""Alignment of two tokenizers against plain bookkeeping of byte offsets."""

import random
from collections import Counter
from hashlib import sha256
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from brute import components, prose
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from maskmetrics.llm.alignment import align_documents, aligner, groups_of, overlaps, union_find

PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a   b   ", "a\nb", "a \n b\n", "\n\n", "tab\tx \t y", "<s> </s> <|endoftext|> <unk>", "under▁score", "ﬁne ﬁ", "日本 語テスト", "😀 a 👩‍👩‍👧 b", "don't we'll  I'M",
    "x" * 3000, "é́ ́", "a b 　 c", "\x00 \x1c x\x85y", "12345 678,90", "a\r\nb  \r\n", "ends with space ", "​ ﻿", "Ünïcödé ẞß", "<0x0A> [MASK]",
]


@pytest.fixture(scope="module")
def tokenizers():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, SentencePieceProcessor(model_file=PATHS[1])


def plain(tokenizers, text):
    """Groups of ids, and linked pairs, by walking over the bytes; nothing if the bytes do not come back."""
    a, b = tokenizers
    if not text:
        return [], []
    both = aligner(*PATHS)
    ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    raw = [[both.a_bytes[k] for k in ids[0]], [both.b_bytes[k] for k in ids[1]]]
    if any(b"".join(r) != b" " + text.encode() for r in raw):
        return [], []
    ends = [dict(zip(accumulate(map(len, r)), own, strict=True)) for r, own in zip(raw, ids, strict=True)]
    cuts = sorted(ends[0].keys() & ends[1].keys())
    groups = [tuple([k for at, k in own.items() if lo < at <= hi] for own in ends) for lo, hi in zip([0, *cuts], cuts)]
    return groups, [(ends[0][c], ends[1][c]) for c in cuts]


def expected(tokenizers, rows):
    parts = [plain(tokenizers, t) for _, t in rows]
    counts = Counter(x for _, links in parts for x in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (doc_id, _), (groups, links) in zip(rows, parts, strict=True):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        digest = sha256(text.encode()).hexdigest() if groups else ""
        n_a, n_b = (sum(len(g[k]) for g in groups) for k in (0, 1))
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == most[x[1]] for x in links), sum(counts[x] for x in links), digest))
    return sorted(out, key=repr)


def test_token_bytes(tokenizers):
    a, b = tokenizers
    both = aligner(*PATHS)
    assert both.a_bytes[a.token_to_id("Ġthe")] == b" the" and both.a_bytes[a.token_to_id("Ċ")] == b"\n"
    assert both.b_bytes[b.piece_to_id("▁the")] == b" the" and both.b_bytes[b.piece_to_id("<0x0A>")] == b"\n"


def test_components_are_the_groups_between_shared_ends():
    r = random.Random(1)
    for _ in range(300):
        last = r.randint(1, 40)
        a, b = (np.array(sorted({last, *(r.randint(1, last) for _ in range(r.randint(0, 12)))})) for _ in range(2))
        cuts = sorted(set(a.tolist()) & set(b.tolist()))
        assert [x.tolist() for x in groups_of(a, b)] == [[sum(c < e for c in cuts) for e in own] for own in (a, b)]
        near = {(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])}
        assert set(zip(*(x.tolist() for x in overlaps(a, b)), strict=True)) == near


def test_union_find():
    r = random.Random(2)
    for _ in range(100):
        n = r.randint(1, 30)
        edges = [(r.randrange(n), r.randrange(n)) for _ in range(r.randint(0, 30))]
        u, v = (np.array([e[k] for e in edges], int) for k in (0, 1))
        assert union_find(n, u, v).tolist() == list(components(range(n), edges).values())


@pytest.mark.parametrize("memo_words, block_pairs", [(5, 40), (10**6, 10**6)])
def test_rows_are_exact(spark, docs, tokenizers, memo_words, block_pairs):
    r = random.Random(3)
    rows = [(k, t) for k, t in enumerate(ODD)] + [(1, "same words here"), (1, "same words here"), (None, "no id")]
    rows += [(100 + k, prose(k % 7, r.randint(1, 80)).replace(" ", r.choice([" ", " ", "\n", "  ", ". "])).title()) for k in range(60)]
    rows += [(900, "longtext " * 4000 + prose(5, 2000))]
    got = align_documents(docs(rows).repartition(6), *PATHS, memo_words=memo_words, block_pairs=block_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == expected(tokenizers, rows)
    assert align_documents(docs([]), *PATHS).count() == 0


def test_groups_as_text(docs, tokenizers):
    rows = [(k, t) for k, t in enumerate(["The internationalisation of tokens", "", None, "a b"])]
    for r in align_documents(docs(rows), *PATHS, groups=True).collect():
        groups, _ = plain(tokenizers, dict(rows)[r["doc_id"]])
        assert r["groups"] == ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
