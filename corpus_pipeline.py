"""A corpus pipeline over `documents`: toxic documents go, near-duplicates but one go, repeated
passages are cut out, secrets are masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which `run` writes as Parquet in
the shared folder and rereads for the next stage. All but the last return the columns of
`documents`, with n_chars of the text as it then is. No stage drops a row for another reason than
its decision: documents that substring dedup leaves empty stay, with an empty text.

Repeated rows: toxicity, the secret scan and packing judge each row by itself; for near-duplicates
and substring dedup rows of one id are one document, which stays or goes as a whole, with as many
rows as it had. Null texts count as empty; rows without an id are never dropped as duplicates and
lose no passages; other columns than those of `documents` are left out, whatever their names; an
empty table gives empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage, drop_folder, read, scratch_dir
from quire.llm.packing import pack
from quire.llm.queries import vocabulary
from quire.llm.secret_scan import redacted
from quire.llm.simhash import components_of, fingerprints
from quire.llm.substring_dedup import dedup
from quire.llm.toxicity import fit, score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def columns_of(docs: DataFrame) -> DataFrame:
    """The columns of `documents`, with n_chars of the present text."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score as toxic. Labels are read from the tables beside the documents."""
    model = fit(docs, read(spark, sf_dir, "labels"))
    # scores come with their own row's columns, so nothing is joined and ids needn't be unique
    return columns_of(score(docs, model, carry=COLUMNS[1:]).where("predicted = 0"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: the one with the smallest id. Rows
    without an id have no group that could be named, and stay."""
    prints = cut_lineage(fingerprints(docs))
    groups = components_of(prints)
    keep = prints.join(groups, "fp").where("doc_id = component_id").select("doc_id").distinct()
    return columns_of(docs.join(keep, "doc_id", "left_semi").unionByName(docs.where("doc_id is null")))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the sentences of spans that an earlier document has."""
    return columns_of(dedup(docs, run=2, min_words=15, carry=COLUMNS[2:]))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in the texts."""
    return columns_of(redacted(docs))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the texts into sequences of at most 4096 tokens; a row for each piece. The workers of
    the stages before are still there, so the encoder keeps few words."""
    return pack(docs, vocabulary(), end_id=1, capacity=4096, cache_words=30_000)


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("substring dedup", substring_stage),
    ("secret scan", secrets_stage),
    ("packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to `documents`, with each result written and read again; a result is deleted
    when the next one is written."""
    docs, last = read(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        path = scratch_dir(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            drop_folder(spark, last)
        last = path
    return docs
