"""Files as a data source, `quire-files`: folders of manuscripts and covers to rows, rows to files.

    register(spark)
    spark.read.format("quire-files").load(folder).where("kind = 'text'")
    rows.write.format("quire-files").mode("append").save(folder)

Reading: book_id (of the folder that a file lies in), folder, file_name, extension, kind ('text',
'docx', 'cover' or 'other'), size, content. Only the names are listed ahead; filters on the columns
before content reach the source, and files that they rule out are neither dealt to a task nor
opened. Files are dealt by size, `partition_bytes` (32 MB) to a task. `register` turns on
`spark.sql.python.filterPushdown.enabled` for the session, without which Spark refuses a source that
takes filters.

Writing: rows of folder, file_name and data become files. A job writes beside its target, under a
name of its own that readers pass over, and appears in it by one rename of a folder when all tasks
are done: all of its files or none. Tasks that failed and were run again leave folders that no
message names, which go before the rename; a job that fails takes everything with it. Overwriting
removes what other jobs left once the new files are there. The store's rename has to be atomic, as
that of a POSIX or HDFS folder is. Two rows of one name in a job are an error.

Null contents are empty files; null folders are the top; names can't leave their folder.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "book_id long, folder string, file_name string, extension string, kind string, size long, content binary"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
KINDS = {"md": "text", "markdown": "text", "mdown": "text", "txt": "text", "docx": "docx", "png": "cover", "jpg": "cover", "jpeg": "cover"}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = f"file://{uri}" if uri.startswith("/") else uri.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(uri)


def facts(top: str, info: fs.FileInfo) -> dict:
    """The columns of a file that its name gives."""
    folder, name = posixpath.split(info.path[len(top) :].lstrip("/"))
    extension = name.rpartition(".")[2].lower() if "." in name else ""
    number = int.from_bytes(hashlib.blake2b(folder.encode(), digest_size=8).digest(), "big", signed=True)
    return {"book_id": number, "folder": folder, "file_name": name, "extension": extension, "kind": KINDS.get(extension, "other"), "size": info.size}


def passes(rule: Filter, row: dict) -> bool | None:
    """Does a file pass? None: the rule is of a kind or column that only Spark can tell."""
    column = ".".join(getattr(rule, "attribute", ()))
    if column not in NAMES[:-1]:
        return None
    value = row[column]
    match rule:
        case EqualTo():
            return value == rule.value
        case In():
            return value in rule.value
        case StringStartsWith():
            return value.startswith(rule.value)
        case StringEndsWith():
            return value.endswith(rule.value)
        case StringContains():
            return rule.value in value
    return None


@dataclass
class Share(InputPartition):
    """Files that one task reads: their paths and columns."""

    files: list[tuple[str, dict]]


class FilesReader(DataSourceReader):
    def __init__(self, path: str, partition_bytes: int):
        self.path, self.partition_bytes, self.rules = path, partition_bytes, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        blank = dict.fromkeys(NAMES, "") | {"book_id": 0, "size": 0}
        for f in filters:
            if passes(f, blank) is None:
                yield f
            else:
                self.rules.append(f)

    def partitions(self) -> Sequence[Share]:
        where, top = opened(self.path)
        found = where.get_file_info(fs.FileSelector(top, recursive=True, allow_not_found=False))
        hidden = lambda p: any(x.startswith(("_", ".")) for x in p[len(top) :].split("/"))
        files = sorted((i.path, facts(top, i)) for i in found if i.type == fs.FileType.File and not hidden(i.path)) if found else []
        shares, held = [Share([])], 0
        for path, row in files:
            if all(passes(f, row) for f in self.rules):
                if held and held + row["size"] > self.partition_bytes:
                    shares.append(Share([]))
                    held = 0
                shares[-1].files.append((path, row))
                held += row["size"] + 4096  # an empty file is work too
        return shares

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        where, _ = opened(self.path)
        rows, held = [], 0
        for path, row in partition.files:
            with where.open_input_stream(path) as f:
                rows.append(row | {"content": f.read()})
            held += row["size"]
            if held >= 4 << 20:
                yield self.batch(rows)
                rows, held = [], 0
        if rows:
            yield self.batch(rows)

    @staticmethod
    def batch(rows: list[dict]) -> pa.RecordBatch:
        kinds = {"book_id": pa.int64(), "size": pa.int64(), "content": pa.binary()}
        return pa.RecordBatch.from_pylist(rows, pa.schema([(n, kinds.get(n, pa.string())) for n in NAMES]))


@dataclass
class Written(WriterCommitMessage):
    """The folder of a task that is done, and how many files it has."""

    part: str
    files: int


class FilesWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool, fields: Sequence[str]):
        if missing := {"file_name", "data"} - set(fields):
            raise ValueError(f"rows need {', '.join(sorted(missing))}")
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, f"job-{uuid.uuid4().hex}"

    @property
    def staging(self) -> str:
        return posixpath.join(self.path, f"_staging-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        where, top = opened(self.staging)
        part, n, made = f"part-{uuid.uuid4().hex}", 0, set()
        for batch in iterator:
            names = batch.schema.names
            folders = batch.column("folder").to_pylist() if "folder" in names else [None] * batch.num_rows
            for i, (folder, name) in enumerate(zip(folders, batch.column("file_name").to_pylist(), strict=True)):
                own = posixpath.normpath(posixpath.join(folder or "", name or ""))
                if not name or own.startswith(("/", "..")) or "/" in name:
                    raise ValueError(f"{folder!r}/{name!r} is no name of a file")
                target = posixpath.join(top, part, own)
                if (parent := posixpath.dirname(target)) not in made:
                    where.create_dir(parent, recursive=True)
                    made.add(parent)
                if where.get_file_info(target).type != fs.FileType.NotFound:
                    raise ValueError(f"{own} is written twice")
                with where.open_output_stream(target) as out:
                    out.write(batch.column("data")[i].as_py() or b"")
                n += 1
        return Written(part, n)

    def commit(self, messages: list[Written | None]) -> None:
        where, top = opened(self.path)
        _, staging = opened(self.staging)
        done = [m for m in messages if m is not None and m.files]
        where.create_dir(staging, recursive=True)
        self.check(where, staging, done)
        for info in where.get_file_info(fs.FileSelector(staging)):
            if info.base_name not in {m.part for m in done}:
                where.delete_dir(info.path)
        old = where.get_file_info(fs.FileSelector(top))
        where.move(staging, posixpath.join(top, self.job))  # the commit
        if self.overwrite:
            for info in old:
                if info.type == fs.FileType.Directory and info.base_name.startswith("job-"):
                    where.delete_dir(info.path)

    @staticmethod
    def check(where: fs.FileSystem, staging: str, done: list[Written]) -> None:
        """Names that two tasks wrote would be two files in two folders."""
        seen = set()
        for m in done:
            part = posixpath.join(staging, m.part)
            for info in where.get_file_info(fs.FileSelector(part, recursive=True)):
                own = info.path[len(part) :]
                if info.type == fs.FileType.File and own in seen:
                    raise ValueError(f"{own} is written twice")
                seen.add(own)

    def abort(self, messages: list[Written | None]) -> None:
        where, staging = opened(self.staging)
        if where.get_file_info(staging).type == fs.FileType.Directory:
            where.delete_dir(staging)


class Files(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quire-files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FilesReader:
        return FilesReader(self.options["path"], int(self.options.get("partition_bytes", 32 << 20)))

    def writer(self, schema: StructType, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"], overwrite, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Files)
    spark.conf.set(PUSHDOWN, "true")


def read_files(spark: SparkSession, folder: str, where: str = "true") -> DataFrame:
    """The files under a folder for which a condition on their columns holds. The names of folders
    that saving jobs made are left out of `folder`."""
    register(spark)
    rows = spark.read.format("quire-files").load(folder).where(where)
    return rows.withColumn("folder", F.regexp_replace("folder", r"\Ajob-[0-9a-f]{32}(/part-[0-9a-f]{32}(/|\z)|\z)", ""))


def manuscripts(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Text files (book_id, file_ord, file_name, content: text), Word files (book_id, file_name,
    content) and covers (book_id, cover: png or jpg, image) of the books under a folder, one folder a
    book. Of several covers the first by natural order counts."""
    from quire.functions.text import natural_key

    w = Window.partitionBy("book_id").orderBy(natural_key(F.col("file_name")), "file_name")
    text = read_files(spark, folder, "kind = 'text'").withColumn("file_ord", (F.row_number().over(w) - 1).cast("int"))
    text = text.select("book_id", "file_ord", "file_name", F.decode("content", "UTF-8").alias("content"))
    word = read_files(spark, folder, "kind = 'docx'").select("book_id", "file_name", "content")
    covers = read_files(spark, folder, "kind = 'cover'").withColumn("k", F.row_number().over(w)).where("k = 1")
    return text, word, covers.select("book_id", F.when(F.col("extension") == "png", "png").otherwise("jpg").alias("cover"), F.col("content").alias("image"))


def save_files(rows: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Saves file_name, data (and folder) of all rows under a folder, all or none."""
    register(rows.sparkSession)
    cols = [c for c in ("folder", "file_name", "data") if c in rows.columns]
    rows.select(*cols).write.format("quire-files").mode("overwrite" if overwrite else "append").save(folder)
