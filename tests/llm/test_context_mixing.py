"""Scores by context mixing: counts against plain Python, and that the model's numbers are probabilities."""

import math
import random
import zlib
from collections import Counter
from dataclasses import replace

import numpy as np
import pytest

from quire.llm import context_mixing as C

SMALL = {"dictionary": 60, "slots": 12, "tuning": 20}
SCHEMA = "doc_id long, text string, word string, n int, row string, tune boolean, held_out string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", True, "c") for i, t in rows], SCHEMA).repartition(3)


def some_rows(n=160, seed=1):
    rng = random.Random(seed)
    pairs = {w: rng.sample([f"w{i}" for i in range(40)], 3) for w in [f"w{i}" for i in range(40)]}
    rows = []
    for d in range(n):
        w, text = rng.choice(list(pairs)), []
        for _ in range(rng.randint(0, 60)):
            text.append(w if rng.random() < 0.9 else f"rare{rng.randint(0, 400)}")
            w = rng.choice(pairs[w])
        rows.append((d, " ".join(text)))
    return rows


def held_out(doc):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % 7 == 2


def brute(rows):
    split = lambda t: [w for w in "".join(c.lower() if c.isascii() else c for c in t or "").replace("\x0b", " ").replace("\x0c", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w] + [None]
    c = Counter(w for i, t in rows if not held_out(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    return [(i, held_out(i), len(split(t)), sum(c[w] > 0 for w in split(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in split(t))) for i, t in rows]


ODD = [(500, None), (501, ""), (502, " \t\x0b\n"), (503, "ÄÖ É\x85x \xa0y w1\x0bW2\x0cw3\x1cw4"), (None, "W1 w1"), (7, "w1 w2"), (7, "w1 w2"), (504, "z" * 70 + " " + "z" * 71), (505, "z" * 70), (506, "<s> \t|")]


@pytest.mark.parametrize("dictionary", [1, 25, 10_000])
def test_counts_and_base(spark, dictionary):
    rows = some_rows() + ODD
    got = C.scores(frame(spark, rows), **SMALL | {"dictionary": dictionary}).collect()
    key = lambda r: (str(r[0]), r[2], r[5])
    got = sorted([(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.n_bytes, r.bits_per_byte) for r in got], key=key)
    want = sorted(brute(rows), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5] for g in got], [w[5] for w in want], rtol=1e-12)
    assert all(math.isfinite(g[6]) and g[6] < 0 for g in got)
    assert all(g[8] is None if not g[7] else math.isclose(g[8], -g[6] * math.log2(10) / g[7]) for g in got)


def test_held_out_documents_score_above_the_base(spark):
    got = C.scores(frame(spark, some_rows(700)), **SMALL).where("held_out").collect()
    assert len(got) > 70
    assert sum(r.score for r in got) > 0.93 * sum(r.base_score for r in got)  # both negative
    assert sum(r.score > r.base_score for r in got) > 0.85 * len(got)


def test_no_training_documents_and_no_documents(spark):
    out = [(d, "a b") for d in range(200) if held_out(d)]
    got = C.scores(frame(spark, out), **SMALL).collect()
    assert len(got) == len(out) and all((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0, 0) for r in got)
    assert C.scores(frame(spark, [(1, "x")]).limit(0), **SMALL).count() == 0


@pytest.fixture(scope="module")
def model(spark):
    return C.train(frame(spark, some_rows()).select("text"), **SMALL)[0]


def log2s(model, rows):
    """log2 probability of each token of each text."""
    t = C.Tokens(model, rows)
    per = np.zeros(len(t.sym))
    for part in t.parts():
        out = C.mixed(C.Features(model, t, part), model.weights)
        sym = t.sym[part]
        step = np.argsort((t.at[part] % C.SEGMENT // C.STEP).astype(np.int16), kind="stable")
        per[part] = np.bincount(np.repeat(step, model.code.size[sym[step]]), out, minlength=len(sym))
    return np.split(per, np.cumsum(t.sizes)[:-1])


def test_next_tokens_have_probability_one_together(model):
    for before in ([], [b"w1"], [b"w3", b"w5"], [b"w1", b"w2", b"w4", b"w1", b"w2"], [b"unseen"] * 5, list(model.symbols)[1:40]):
        nexts = [*model.symbols, b"unknown"]
        got = log2s(model, [[*before, w] for w in nexts])
        assert math.isclose(sum(2.0 ** g[len(before)] for g in got), 1, rel_tol=1e-3)


def test_batches_do_not_matter(model, monkeypatch):
    rng = random.Random(3)
    words = [*model.symbols][1:] + [b"other"]
    rows = [rng.choices(words, k=n) for n in (0, 1, 15, 16, 17, 900, 1023, 1024, 1025, 3000)]
    together = log2s(model, rows)
    for row, got in zip(rows, together, strict=True):
        assert np.array_equal(log2s(model, [row])[0], got)
    monkeypatch.setattr(C, "PART", 1)  # nor do parts
    assert all(np.array_equal(a, b) for a, b in zip(log2s(model, rows), together, strict=True))


def test_order_zero_alone_is_the_base(model, monkeypatch):
    monkeypatch.setattr(C, "RATE", 0)
    monkeypatch.setattr(C, "DRIFT", 0)
    words = list(model.symbols)[1:]
    got = log2s(replace(model, weights=C.first_weights()), [words])[0]
    want = np.log2((model.counts[[model.symbols[w] for w in [*words, C.END]]] + 1) / (model.n + model.v + 1))
    assert np.allclose(got, want, atol=1e-3)


def test_weights_follow_the_document(model):
    rng = random.Random(5)
    row = [w for _ in range(60) for w in rng.sample([b"w1", b"w2"], 2)]  # pairs that training hardly has
    got = log2s(model, [row])[0][:-1]
    assert got[-40:].mean() > got[:40].mean()


def test_prefix_code():
    rng = np.random.default_rng(0)
    for weights in (np.array([5]), np.array([1, 1]), rng.integers(1, 10**9, 300), 2 ** np.arange(60)):
        code = C.Code(weights)
        paths = {tuple(code.bits[s : s + n]) for s, n in zip(code.start, code.size, strict=True)}
        assert len(paths) == len(weights) and code.size.max() <= 52
        assert sum(2.0 ** -len(p) for p in paths) == 1
        assert math.isclose((weights * code.size).sum() / weights.sum(), -(weights / weights.sum() * np.log2(weights / weights.sum())).sum(), abs_tol=1)


def test_long_words_have_digests():
    long, longer = C.words_of("z" * 200 + " " + "z" * 201)
    assert long != longer and len(long) == C.LONGEST + 1 and C.words_of("Z" * 64) == [b"z" * 64]
    assert max(map(len, C.words_of(("y" * 64 + " ") * 3 + "z" * 65))) == C.LONGEST + 1


def fit_alone(spark, rows, tuning):
    docs = frame(spark, rows).select("text")
    return C.train(docs, **SMALL | {"tuning": tuning})[0].weights


def test_weights_come_from_all_training_documents(spark):
    rows = some_rows(400, seed=4)
    few, more = fit_alone(spark, rows, 1), fit_alone(spark, rows, 100)  # where the steps start doesn't matter
    assert np.abs(few - more).max() < 0.02
    assert np.abs(few - C.first_weights()).max() > 0.1


def test_regression_sums(model):
    rng = random.Random(6)
    t = C.Tokens(model, [rng.choices([*model.symbols][1:] + [b"other"], k=n) for n in (0, 1, 40, 700, 1500)])
    f = C.Features(model, t, slice(0, len(t.sym)))
    weights = C.first_weights() + np.linspace(-0.2, 0.2, C.INPUTS)
    got, x = C.regression_sums(f, weights), f.x.astype(np.float64)
    p = 1 / (1 + np.exp(-(weights[f.gate].T * x).sum(0)))
    for g in range(C.GATES):
        at = f.gate == g
        curve = (x[:, at] * (p * (1 - p))[at]) @ x[:, at].T
        want = [*(x[:, at] @ (f.bit - p)[at]), *(curve[i, j] for i, j in C.UPPER), at.sum()]
        assert np.allclose(got[g], want, rtol=1e-4, atol=1e-3)


def test_texts_are_read_twice_however_many_steps_the_fit_takes(spark):
    rows, seen = some_rows(200, seed=7), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    docs = frame(spark, rows).select("doc_id", "text").mapInPandas(counted, "doc_id long, text string")
    assert C.scores(docs, **SMALL).count() == len(rows)
    assert seen.value == 2 * len(rows)  # once for the counts of words, once for symbols


def test_encoded_documents(spark):
    rows = some_rows(80) + ODD
    model, counts, cols = C.model_of(frame(spark, rows).selectExpr("doc_id", "false AS held_out", "text"), **SMALL)
    known, total = model.symbols, {r.word: r.n for r in counts.collect()}
    want = []
    for doc, text in rows:
        words = [*C.words_of(text or ""), C.END]
        rare = Counter(bytes(w) for w in words if w not in known)
        want.append((str(doc), [known.get(w, len(known)) for w in words], sorted(rare.items()), len((text or "").encode()), sum(math.log10(total[w] + 1) for w in words if w in known)))
    got = [(str(r.doc_id), C.Tokens.stored(model, C.pa.array([bytes(r.sym)]), np.ones(1, bool)).sym.tolist(), sorted(zip(map(bytes, r.rare), r.times, strict=True)), r.n_bytes, r.base) for r in cols.collect()]
    got, want = sorted(got), sorted(want)
    assert [g[:4] for g in got] == [w[:4] for w in want] and np.allclose([g[4] for g in got], [w[4] for w in want])
    assert len({r.row for r in cols.select("row").collect()}) == len(rows)


def test_words_of_slices():
    texts = [t for _, t in ODD] + ["\n a  b\t", "A b İ"]
    split = lambda t: [C.key_of(w) for w in (t or "").encode().lower().split()]
    for a, b in ((0, len(texts)), (1, 5), (3, 4), (2, 3)):
        words, sizes = C.words_in(C.pa.array(texts).slice(a, b - a))
        assert words.to_pylist() == [w for t in texts[a:b] for w in split(t)] and sizes.tolist() == [len(split(t)) for t in texts[a:b]]


def test_earlier_symbols(model):
    rng = random.Random(8)
    t = C.Tokens(model, [rng.choices([b"w1", b"w2", b"w3", b"other"], k=n) for n in (0, 1, 2, 30, 400)])
    last, want = {}, []
    for i, sym in enumerate(t.sym.tolist()):
        key = (t.doc[i], *t.sym[i - 2 : i].tolist())
        want.append(last.get(key, -1) if t.at[i] > 1 else -1)
        last[key] = sym if sym != t.esc else -1
    assert t.earlier.tolist() == want


def test_a_few_bits_of_a_token_lie_side_by_side(model):
    sym = np.repeat(np.arange(len(model.counts) + 1), 20).astype(np.int32)
    bits = C.Bits(model.code, sym)
    slot = bits.slot(np.random.default_rng(2).integers(0, 2**63, len(sym)).astype(np.uint64), 12)
    deep = np.arange(len(slot)) - np.repeat(np.cumsum(bits.size) - bits.size, bits.size)
    group = np.cumsum(deep % C.LEVELS == 0)
    assert (np.bincount(group, slot >> C.LEVELS)[1:] == (slot >> C.LEVELS)[deep % C.LEVELS == 0] * np.bincount(group)[1:]).all()
    assert len(set(zip(group, slot, strict=True))) == len(slot)
