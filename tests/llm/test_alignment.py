"""Alignment against token loops in plain Python with the two libraries, and its parts by themselves."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quire.llm import alignment as A

WHICH = A.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
ODD = ["", None, " ", "a", "<|endoftext|> and <s> </s>", "▁▁x", "<0x41>", "ﬁnè ①", "日本語のテキスト 한국어", "a\x00b", "\t\n  x\r\n", "🙂🙃 é", "ẞtraße", "x" * 3000, "͸\U00031350 Ᲊ", "  two  spaces ", "1234567 3.14", "don't we'll", "﻿x"]


@pytest.fixture(scope="module")
def plain():
    a = Tokenizer.from_file(WHICH.a)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=WHICH.b)
    letters = A.alphabet()
    names = {i: s for s, i in a.get_vocab().items()}

    def tokens(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids
        ours = [(i, bytes(letters[c] for c in names[i])) for i in ids]
        theirs = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        whole = (" " + text).encode()
        return (ours, theirs) if all(b"".join(x for _, x in side) == whole for side in (ours, theirs)) else ([], [])

    return tokens


def spans(tokens):
    out, at = [], 0
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(texts, tokens):
    """What each text should give: all pairs of tokens are compared."""
    sides, links = [tuple(map(spans, tokens(t))) for t in texts], []
    for a, b in sides:
        links.append([(i, j) for i, s, e in a for j, u, v in b if s < v and u < e])
    count = Counter(x for doc in links for x in doc)
    highest = {}
    for (_, j), n in count.items():
        highest[j] = max(highest.get(j, 0), n)
    out = []
    for (a, b), mine in zip(sides, links, strict=True):
        groups, cuts = [], sorted({e for _, _, e in a} & {e for _, _, e in b})
        for lo, hi in zip([0, *cuts], cuts, strict=False):
            groups.append("|".join(",".join(str(i) for i, _, e in side if lo < e <= hi) for side in (a, b)))
        best = sum(count[x] == highest[x[1]] for x in mine)
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((len(a), len(b), len(groups), len(mine), best, sum(count[x] for x in mine), sha))
    return out


def some_texts(n):
    rng = random.Random(n)
    words = ["the", "Straße", "naïve", "running", "x1", "—", "…", "été", "foo_bar", "日本", "!!", "12,5", "\n", "🙂"]
    return [" ".join(rng.choices(words, k=rng.randint(1, 40))) for _ in range(n)]


@pytest.mark.parametrize("frequent", [1 << 20, 20, 1])
def test_whole_results(spark, plain, frequent):
    texts = ODD + some_texts(40) + ["same words again"] * 7
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t, "x", 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, pairs string, row int, n int").repartition(5)
    got = A.alignment(docs, WHICH, frequent=frequent)
    want = [(None if i == 3 else i // 2, *row) for i, row in enumerate(brute(texts, plain))]
    cols = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert got.columns == cols
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, want))
    assert sum(r[1] > 0 for r in want) > 50 and any(r[1] == 0 and t for r, t in zip(want, texts, strict=True))


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert A.alignment(docs, WHICH).count() == 0 and A.align(docs, WHICH).count() == 0
    only = spark.createDataFrame([(1, None), (None, "")], "doc_id long, text string")
    assert sorted(map(repr, (tuple(r) for r in A.alignment(only, WHICH).collect()))) == sorted(map(repr, [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")]))


def test_groups_of_one_document(spark, plain):
    text = "naïvely running Straßenbahnen 日本"
    row = A.align(spark.createDataFrame([(0, ""), (7, text)], "doc_id long, text string").coalesce(1), WHICH).where("doc_id = 7").first()
    a, b = plain(text)
    assert (row.a, row.b) == ([i for i, _ in a], [i for i, _ in b])
    for i, j in zip(row.group_a, row.group_b, strict=True):
        assert b"".join(x for _, x in a[:i]) == b"".join(x for _, x in b[:j])
    assert (row.group_a[-1], row.group_b[-1]) == (len(a), len(b))


def test_ranks_and_library_give_the_same_ids():
    with_ranks, alone = A.encoders(WHICH), A.encoders(A.Tokenizers(WHICH.a, WHICH.b))
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and A.SETTLED.fullmatch(chr(c))]
    assert len(settled) > 30_000
    texts = ["".join(f" a{c}b{c}{c} 1{c}{c} {c}\n" for c in settled[i : i + 50]) for i in range(0, len(settled), 50)]
    for t in [t for t in ODD if t] + texts:
        assert with_ranks.a_ids(" " + t) == alone.a_ids(" " + t)


def test_packing_and_sums():
    keys = np.array([3, 9, 1 << 45], np.int64)
    got = A.unpacked(A.packed(keys, np.array([1, 2, 3])))
    assert got[0].tolist() == keys.tolist() and got[1].tolist() == [1, 2, 3]
    sums, out = A.Sums(limit=10), Counter()
    rng = np.random.default_rng(0)
    rows = [np.unique(rng.integers(0, 30, 6)) for _ in range(50)]
    handed = [x for r in rows if (x := sums.add(r, np.ones(len(r), np.int64))) is not None] + ([sums.batch(*sums.merged())] if sums.held else [])
    for x in handed:
        for k, n in zip(*(c.to_pylist() for c in x.columns), strict=True):
            out[k] += n
    assert out == Counter(k for r in rows for k in r.tolist())


def test_threshold_keeps_the_bound(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([9, 9, 5, 5, 5, 2, 1, 1])], "pair long, n long")
    assert [A.least_count(counts, m) for m in (0, 1, 2, 4, 5, 7, 8, 100)] == [10, 10, 6, 6, 3, 2, 1, 1]
    assert A.least_count(counts.where(F.lit(False)), 5) == 1
