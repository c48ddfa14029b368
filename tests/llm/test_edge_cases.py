"""Nulls, empty and very long texts, repeated rows, clashing names and empty tables, for each
operator and pipeline stage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import bpe, embedding_dedup, html_extract, media, packing, secret_scan, simhash, substring_dedup, token_files, toxicity
from quire.llm.queries import vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long, ids string, score double, node long, parts int, row int"
LONG = "The quick brown fox jumps over the lazy dog near the river bank. " * 4000


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", 0.5, 2, 3, 4) for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return documents(spark, [(1, None), (2, ""), (3, "  \n "), (4, LONG), (5, "one two three four five"), (5, "one two three four five"), (None, "no id here"), (6, "word " * 10), (7, "é😀 ½ x\x1cy 'll")]).cache()


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1), (6, None, None), (99, 1, 1)], LABELS).write.parquet(f"{path}/labels.parquet")
    return path


PER_ROW = {
    "bpe": lambda d: bpe.digest_column(d, vocabulary()),
    "encode": lambda d: bpe.encode_column(d, vocabulary()),
    "token_files": lambda d: token_files.read_digests(token_files.write_token_files(d, vocabulary(), end_id=2, length=64)),
    "media": media.text_media,
    "simhash": simhash.near_duplicates,
    "substring": substring_dedup.dedup,
    "toxicity": lambda d: toxicity.toxicity(d, d.sparkSession.createDataFrame([(4, 1, 1), (5, 0, 0), (None, 1, 1)], LABELS)),
    "redacted": secret_scan.redacted,
}


@pytest.mark.parametrize("name", PER_ROW)
def test_every_row_stays(docs, empty, name):
    rows = PER_ROW[name](docs).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == [(False, i) for i in (1, 2, 3, 4, 5, 5, 6, 7)] + [(True, 0)]
    assert PER_ROW[name](empty).count() == 0


def test_packing(docs, empty):
    rows = packing.pack(docs, vocabulary(), end_id=1, capacity=512).collect()
    whole = {r.doc_id: r.n_tokens for r in bpe.digest_column(docs, vocabulary()).collect()}
    assert {r.doc_id for r in rows} == set(whole)
    for i in (1, 2, 4, None):
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert sum(r.length for r in own) == whole[i] + 1 and [r.start for r in own] == [512 * k for k in range(len(own))]
    assert packing.pack(empty, vocabulary(), end_id=1).count() == 0
    assert packing.sequences(empty, vocabulary(), end_id=1).count() == 0


def test_scan(docs, empty):
    assert secret_scan.scan(docs).count() == 0 and secret_scan.scan(empty).count() == 0


def test_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (2, "u", "", "b"), (None, "u", "<p>" + "w " * 90000, "c"), (3, "u", "<article><p>x<", "d"), (3, "u", "<article><p>x<", "d")], "page_id long, url string, html string, text string")
    rows = html_extract.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in rows) == [(0, 179999), (1, 0), (2, 0), (3, 2), (3, 2)]
    assert html_extract.extract(pages.where("false")).count() == 0


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 2.0]), (8, [1.0, 2.0]), (9, [2.0, 4.0]), (None, [-1.0, 2.0]), (10, [1.0, 2.0, 0.0]), (11, [1e-30, 2e-30])]
    v = spark.createDataFrame([(i, x, 1, 2) for i, x in rows], "vec_id long, embedding array<float>, label int, cid long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(v).collect()}
    for i in range(1, 7):
        assert got[i] == (0, i, True)
    assert got[7] == (3, 7, True) and got[8] == (3, 7, False) and got[9] == (3, 7, False) and got[11] == (3, 7, False)
    assert got[10] == (0, 10, True) and got[None] == (0, None, False)
    assert embedding_dedup.near_duplicates(v.where("false")).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, docs, empty, sf, k):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    out = corpus_pipeline.STAGES[k][1](spark, docs, sf)
    assert out.columns == columns
    rows = [r.doc_id for r in out.collect()]
    kept = set(rows)
    assert rows.count(5) == 2 and len(rows) == len(kept) + 1  # repeated rows of an id go together
    clean = {1, 2, 3, 5, 6, 7, None} if k == 0 else {1, 4, 5, 6, 7, None} if k == 1 else {1, 2, 3, 4, 5, 6, 7, None}
    assert clean <= kept
    assert corpus_pipeline.STAGES[k][1](spark, empty, sf).count() == 0


def test_last_stage(spark, docs, empty, sf):
    assert corpus_pipeline.STAGES[4][1](spark, docs, sf).count() > 8
    assert corpus_pipeline.STAGES[4][1](spark, empty, sf).count() == 0


def test_equal_texts_equal_prints(docs):
    prints = simhash.near_duplicates(docs).where("doc_id in (1, 2, 3)").collect()
    assert {(r.fingerprint, r.component_id) for r in prints} == {("0" * 16, 1)}


def test_long_text_once(docs):
    """A sentence that a text repeats is kept once."""
    row = substring_dedup.dedup(docs).where("doc_id = 4").first()
    assert row.n_removed > 0.99 * row.n_units and len(row.text) < 400 and row.text == LONG[: len(row.text)]
    assert np.isclose(docs.where("doc_id = 4").select(F.length("text")).first()[0], len(LONG))
