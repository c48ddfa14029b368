"""Word documents to paragraphs: the standard library reads the package, one file at a time.

Paragraph styles named or numbered Heading 1-6 give the heading depth, `w:jc` center without a
style gives the centered flag, bold and italic come from run properties, breaks and tabs become
white space. Tables' and lists' paragraphs count as body paragraphs, those of a text box come after
the paragraph that holds it. Tracked deletions, and of two alternatives the one for newer readers,
are left out.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sources.markdown import RUNS, merge, trim
from quire.plans.batches import parts

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
LEFT_OUT = {W + "del", W + "moveFrom", "{http://schemas.openxmlformats.org/markup-compatibility/2006}Choice"}


def below(root: ElementTree.Element, stop: str | None = None) -> Iterator[ElementTree.Element]:
    """Elements below root in document order, but for what is left out and for `stop` elements."""
    waiting = list(root)[::-1]
    while waiting:
        x = waiting.pop()
        if x.tag not in LEFT_OUT and x.tag != stop:
            yield x
            waiting.extend(list(x)[::-1])


def on(properties: ElementTree.Element | None, name: str) -> bool:
    x = properties.find(W + name) if properties is not None else None
    return x is not None and x.get(W + "val", "true") not in ("0", "false", "none", "off")


def heading_styles(archive: zipfile.ZipFile) -> dict[str, int]:
    found = {}
    if "word/styles.xml" in archive.namelist():
        for style in ElementTree.fromstring(archive.read("word/styles.xml")).iter(W + "style"):
            name = style.find(W + "name")
            if name is not None and (m := re.fullmatch(r"heading ([1-6])", name.get(W + "val", "").lower())):
                found[style.get(W + "styleId")] = int(m[1])
    return found


def paragraphs(data: bytes) -> list[dict]:
    """heading, centered, runs of each paragraph that isn't blank."""
    with zipfile.ZipFile(io.BytesIO(data)) as archive:
        styles = heading_styles(archive)
        root = ElementTree.fromstring(archive.read("word/document.xml"))
    out = []
    for p in (x for x in below(root) if x.tag == W + "p"):
        properties = p.find(W + "pPr")
        style = properties.find(W + "pStyle") if properties is not None else None
        name = style.get(W + "val", "") if style is not None else ""
        m = re.fullmatch(r"[Hh]eading ?([1-6])", name)
        heading = styles.get(name) or (int(m[1]) if m else None)
        jc = properties.find(W + "jc") if properties is not None else None
        runs = []
        for r in (x for x in below(p, stop=W + "p") if x.tag == W + "r"):
            look = r.find(W + "rPr")
            text = "".join(x.text or "" if x.tag == W + "t" else "\t" if x.tag == W + "tab" else " " if x.tag in (W + "br", W + "cr") and x.get(W + "type") != "page" else "" for x in r)
            runs.append((text, on(look, "i"), on(look, "b")))
        runs = merge(runs)
        if trim("".join(t for t, _, _ in runs)):
            centered = jc is not None and jc.get(W + "val") == "center" and not name
            out.append({"heading": heading, "centered": centered, "runs": [{"text": t, "italic": i, "bold": b} for t, i, b in runs]})
    return out


def read_docx(files: DataFrame) -> DataFrame:
    """From book_id, content (bytes) and, if there is one, file_name: book_id, file_name, items
    (paragraphs: heading, centered, runs), error. A file that is no Word document, or is broken, has
    no items but an error, the kind of failure; it ends neither its task nor other files."""
    para = pa.struct([("heading", pa.int32()), ("centered", pa.bool_()), ("runs", pa.list_(pa.struct([("text", pa.string()), ("italic", pa.bool_()), ("bold", pa.bool_())])))])

    def one(data: bytes | None) -> tuple[list, str | None]:
        try:
            return paragraphs(data or b""), None
        except Exception as e:  # archives of unknown origin fail in many ways
            return [], type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            items, error = zip(*[one(d) for d in batch.column("content").to_pylist()], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("book_id"), batch.column("file_name"), pa.array(items, pa.list_(para)), pa.array(error, pa.string())], names=["book_id", "file_name", "items", "error"])

    name = F.col("file_name") if "file_name" in files.columns else F.lit(None).cast("string")
    cols = files.select(F.col("book_id").cast("long").alias("book_id"), name.alias("file_name"), "content")
    return cols.mapInArrow(run, f"book_id long, file_name string, items array<struct<heading:int,centered:boolean,runs:{RUNS}>>, error string")


def explode_docx(read: DataFrame) -> DataFrame:
    """book_id, para_no, heading, centered, runs of what read_docx gives."""
    return read.select("book_id", F.posexplode("items").alias("para_no", "p")).select("book_id", "para_no", "p.*")


def parse_docx(files: DataFrame) -> DataFrame:
    """The paragraphs of Word files; files that can't be read give none."""
    return explode_docx(read_docx(files))


def read_docx_files(spark: SparkSession, path: str) -> DataFrame:
    """book_id (a hash of the path), file_name, content of the .docx files under a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").load(path)
    return files.select(F.xxhash64("path").alias("book_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """book_id (a hash of the folder), file_ord, file_name, content of text manuscripts under a path."""
    from pyspark.sql import Window

    from quire.functions.text import natural_key

    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))
    files = files.where(F.col("path").rlike(r"(?i)\.(md|markdown|mdown|txt)\z")).withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    files = files.withColumn("book_id", F.xxhash64(F.regexp_replace("path", r"/[^/]*\z", "")))
    w = Window.partitionBy("book_id").orderBy(natural_key(F.col("file_name")), "file_name")
    return files.select("book_id", (F.row_number().over(w) - 1).cast("int").alias("file_ord"), "file_name", "content")
