"""Ingest that reads again only what has changed: new answers, new texts.

Each book has a digest of its files (names, order, contents) and of the answers about it. A run
compares the digests with those of the last runs, ingests the books that differ, and appends their
rows under its own number; a book's rows are those of its latest run. Nothing that other books have
is read, moved or rewritten, and no folder per book is made. The digests of a run are written last:
a run that fails before has none, and what it left counts for nothing. One run at a time writes.

Books whose files are gone get a digest of null in the run that misses them. `compact` writes the
present rows as one run and removes the others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.plans.folders import kept
from quire.plans.ingest import ingest_text

TABLES = {
    "status": "book_id long, status string",
    "books": "book_id long, title string, author string, legal_name string, address string, email string, phone string, language string",
    "chapters": "book_id long, chapter_no int, title string, part string, n_blocks long",
    "blocks": "book_id long, chapter_no int, block_no int, kind string, runs array<struct<text:string,italic:boolean,bold:boolean>>",
}
DIGESTS = "book_id long, digest string"


def digests(files: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
    """book_id, digest of files (book_id, file_ord, file_name, content) and of answers (book_id, id,
    is_title; null answers count as none). Contents are hashed before rows are shuffled."""
    rows = files.select(F.col("book_id").cast("long").alias("book_id"), F.struct("file_ord", "file_name", F.sha2(F.coalesce("content", F.lit("")), 256).alias("sha")).alias("f"))
    g = rows.groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_list("f"))).alias("files"))
    if decisions is None:
        return g.select("book_id", F.sha2("files", 256).alias("digest"))
    given = decisions.where("is_title is not null").groupBy("book_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("id", "is_title")))).alias("answers"))
    return g.join(given, "book_id", "left").select("book_id", F.sha2(F.concat_ws("\n", "files", "answers"), 256).alias("digest"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """book_id, digest of books whose digest isn't that of before; null for those that are gone."""
    b, a = before.select("book_id", F.col("digest").alias("_before")), after.select("book_id", "digest")
    return a.join(b, "book_id", "full").where(~F.col("digest").eqNullSafe(F.col("_before"))).select("book_id", "digest")


class Library:
    """Ingested books under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def runs(self) -> list[int]:
        """Numbers of the runs that are whole."""
        store, path = self._path(f"{self.folder}/digests")
        found = [s.getPath() for s in store.listStatus(path)] if store.exists(path) else []
        marked = [p for p in found if store.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(p.getName().removeprefix("run=")) for p in marked)

    def _read(self, table: str, schema: str) -> DataFrame:
        parts = [self.spark.read.schema(schema).parquet(f"{self.folder}/{table}/run={n}").withColumn("run", F.lit(n)) for n in self.runs()]
        out = self.spark.createDataFrame([], f"{schema}, run int")
        for p in parts:
            out = out.unionByName(p)
        return out

    def latest(self) -> DataFrame:
        """book_id, digest, run of each book that is there."""
        g = self._read("digests", DIGESTS).groupBy("book_id").agg(F.max(F.struct("run", "digest")).alias("x"))
        return g.select("book_id", "x.digest", "x.run").where("digest is not null")

    def table(self, name: str) -> DataFrame:
        """status, books, chapters or blocks of the books that are there."""
        return self._read(name, TABLES[name]).join(self.latest().select("book_id", "run"), ["book_id", "run"], "left_semi").drop("run")

    def update(self, files: DataFrame, decisions: DataFrame | None = None) -> DataFrame:
        """Ingests what has changed and returns it: book_id, digest (null: gone)."""
        changed = kept(changes(self.latest(), digests(files, decisions)))
        run = max(self.runs(), default=0) + 1
        if changed.isEmpty():
            return changed
        some = changed.where("digest is not null").select("book_id")
        only = lambda df: df.join(some, "book_id", "left_semi")
        got = ingest_text(only(files), None if decisions is None else only(decisions))
        for name, schema in TABLES.items():
            self._write(name, schema, run, getattr(got, name))
        self._write("digests", DIGESTS, run, changed)
        return changed

    def _write(self, name: str, schema: str, run: int, rows: DataFrame) -> None:
        casts = [F.col(c).cast(kind).alias(c) for c, kind in (x.split(" ", 1) for x in schema.split(", "))]
        rows.select(*casts).write.mode("overwrite").parquet(f"{self.folder}/{name}/run={run}")

    def compact(self) -> None:
        """Writes what is there as one run and removes the runs before."""
        old, run = self.runs(), max(self.runs(), default=0) + 1
        for name, schema in TABLES.items():
            self._write(name, schema, run, self.table(name))
        gone = self._read("digests", DIGESTS).select("book_id").distinct().join(self.latest(), "book_id", "left_anti").withColumn("digest", F.lit(None).cast("string"))
        self._write("digests", DIGESTS, run, self.latest().select("book_id", "digest").unionByName(gone.select("book_id", "digest")))
        for name in ("digests", *TABLES):  # digests first: without them a run's rows count for nothing
            for n in old:
                store, path = self._path(f"{self.folder}/{name}/run={n}")
                store.delete(path, True)
