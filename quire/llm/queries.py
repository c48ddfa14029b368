"""The queries of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.llm._common import read


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.html_extract import extract

    return extract(read(spark, sf_dir, "pages"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.bpe import digest_column

    return digest_column(read(spark, sf_dir, "documents"), vocabulary())


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.toxicity import toxicity

    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), threshold=0.7)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.substring_dedup import dedup

    return dedup(read(spark, sf_dir, "documents"), run=2, min_words=15)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.token_files import read_digests, write_token_files

    files = write_token_files(read(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return read_digests(files)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.packing import pack

    return pack(read(spark, sf_dir, "documents"), vocabulary(), end_id=1, capacity=4096)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.media import text_media

    return text_media(read(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.embedding_dedup import near_duplicates

    return near_duplicates(read(spark, sf_dir, "embeddings"), least=0.9)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"), words=4, radius=4, seed=42)


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.secret_scan import scan

    return scan(read(spark, sf_dir, "documents"))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.centroids import clusters

    return clusters(read(spark, sf_dir, "embeddings"), k=8, rounds=10, dims=64, scale=1024, seed="3")


def op12_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from quire.llm.context_mixing import scores

    return scores(read(spark, sf_dir, "documents"), dictionary=65_536, slots=21, tuning=512)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from quire.llm.alignment import Tokenizers, alignment

    which = Tokenizers(vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return alignment(read(spark, sf_dir, "documents"), which)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extract": op1_html_extract,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_token_files": op5_token_files,
    "op6_media": op6_media,
    "op7_embedding_dedup": op7_embedding_dedup,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_secret_scan": op10_secret_scan,
    "op11_centroids": op11_centroids,
    "op12_context_mixing": op12_context_mixing,
    "op13_alignment": op13_alignment,
}


def centroid_sql(k: int = 8, rounds: int = 10, dims: int = 64) -> str:
    """The rounds written out, one pair of tables each: components lie in rows, sums are HUGEINT."""
    far = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) ** 2))"
    floor = "(s - ((s % n) + n) % n) // n"
    ctes = [
        f"kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda e: floor(1024 * e::DOUBLE)::HUGEINT) AS x FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, x) - 1 AS c, x FROM (SELECT sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h, x FROM kept ORDER BY h, x LIMIT {k}))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"a{r} AS MATERIALIZED (SELECT row, vec_id, x, min(struct_pack(d := d, c := c)) AS best FROM (SELECT v.row, v.vec_id, v.x, c.c, {far}::HUGEINT AS d FROM kept v CROSS JOIN c{r} c) GROUP BY ALL)")
        if r < rounds:
            ctes.append(
                f"m{r} AS (SELECT c, list({floor} ORDER BY i) AS x FROM (SELECT best.c AS c, i, sum(x[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM (SELECT best, x, unnest(range(1, {dims + 1})) AS i FROM a{r}) GROUP BY 1, 2) GROUP BY 1),"
                f" c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.x, o.x) AS x FROM c{r} o LEFT JOIN m{r} m USING (c))"
            )
    return f"""WITH {", ".join(ctes)} SELECT a.vec_id, a.best.c::INTEGER AS cluster, a.best.d::BIGINT AS distance, (sum(a.best.d) OVER (PARTITION BY a.best.c))::BIGINT AS cluster_inertia,
 (sum(a.best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best.c"""


ORACLE_SQL: dict[str, str] = {"op11_centroids": centroid_sql()}
