"""Manuscripts in standard format: a table of paragraphs in order, and a packer to Word files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from quire.functions import text as T
from quire.operators import outline as O
from quire.plans.batches import row_by_row

INCH = 1440  # twentieths of a point
DOUBLE, SINGLE = 480, 240
RUN = "array<struct<text:string,italic:boolean,bold:boolean>>"


def plain(text: Column) -> Column:
    return F.array(F.struct(text.alias("text"), F.lit(False).alias("italic"), F.lit(False).alias("bold")))


def contact_lines(books: DataFrame) -> DataFrame:
    """book_id, lines: the filled lines of the contact block."""
    c = lambda n: F.coalesce(n, F.lit(""))
    name = T.first_filled(F.col("legal_name"), F.col("author"), "")
    lines = F.concat(F.array(F.coalesce(name, F.lit(""))), F.split(c("address"), "\n"), F.array(c("email"), c("phone")))
    return books.select("book_id", F.filter(lines, lambda x: x != "").alias("lines"))


def running_header(books: DataFrame) -> DataFrame:
    """book_id, header: surname / SHORT TITLE / before the page number."""
    name = T.last_name(T.first_filled(F.col("legal_name"), F.col("author"), "Author"))
    return books.select("book_id", F.concat(name, F.lit(" / "), T.short_title(F.col("title")), F.lit(" / ")).alias("header"))


def row(role: str, text: Column | None = None, align: str = "left", page_break: bool = False, runs: Column | None = None) -> Column:
    content = runs if runs is not None else plain(text) if text is not None else F.array().cast(RUN)
    return F.struct(F.lit(role).alias("role"), F.lit(align).alias("align"), F.lit(page_break).alias("page_break_before"), content.alias("runs"))


def blanks(n: int) -> list[Column]:
    return [row("blank")] * n


def paragraphs(books: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, seq, role, align, page_break_before, runs: all paragraphs after the contact block."""
    c = O.part_starts(chapters).withColumn("n", F.count("*").over(Window.partitionBy("book_id")))
    title = [*blanks(8), row("title", T.first_filled(F.col("title"), "Untitled"), "center"), row("byline", F.concat(F.lit("by "), T.first_filled(F.col("author"), "Anonymous")), "center")]
    end = [row("end", F.lit("END"), "center")]
    part = F.array(row("break", None, page_break=True), *blanks(8), row("part", F.col("part"), "center"))
    label = T.first_filled(F.col("title"), F.concat(F.lit("Chapter "), (F.col("chapter_no") + 1).cast("string")))
    chapter = F.array(row("break", None, page_break=True), *blanks(5), row("chapter", label, "center"), row("blank"))
    none = F.array().cast(c.select(F.array(row("x")).alias("x")).schema["x"].dataType)
    heads = F.concat(F.when(F.col("new_part_print"), part).otherwise(none), F.when(F.col("n") > 1, chapter).when(F.col("chapter_no") == 0, F.array(row("blank"))).otherwise(none))
    body = F.when(F.col("kind") == "scene-break", row("scene-break", F.lit("#"), "center")).otherwise(row("body", runs=F.col("runs")))

    def numbered(df: DataFrame, group: Column, no: Column, rows: Column) -> DataFrame:
        return df.select("book_id", group.alias("a"), no.alias("b"), F.posexplode(rows).alias("c", "x")).select("book_id", "a", "b", "c", "x.*")

    first = F.lit(-1), F.lit(-1)
    found = numbered(books, *first, F.array(*title))
    found = found.unionByName(numbered(c, F.col("chapter_no"), F.lit(-1), heads))
    found = found.unionByName(numbered(blocks, F.col("chapter_no"), F.col("block_no"), F.array(body)))
    found = found.unionByName(numbered(books, F.lit(1 << 30), F.lit(0), F.array(*end)))
    w = Window.partitionBy("book_id").orderBy("a", "b", "c")
    return found.select("book_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), "role", "align", "page_break_before", "runs")


#: Parts of every Word package.
NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
WORD_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml"


def runs_xml(runs: Column, underline_italics: bool = False) -> Column:
    """Runs as Word's markup; italics can be set as underlines, as in typescripts."""
    slant = '<w:u w:val="single"/>' if underline_italics else "<w:i/>"

    def one(r: Column) -> Column:
        look = F.concat(F.when(r["bold"], "<w:b/>").otherwise(""), F.when(r["italic"], slant).otherwise(""))
        return F.concat(F.lit("<w:r>"), F.when(look == "", "").otherwise(F.concat(F.lit("<w:rPr>"), look, F.lit("</w:rPr>"))), F.lit('<w:t xml:space="preserve">'), T.escape_xml(r["text"]), F.lit("</w:t></w:r>"))

    return F.array_join(F.transform(runs, one), "")


def run_xml(text: str) -> str:
    return f"<w:r><w:t xml:space=\"preserve\">{escape(CONTROL.sub('', text))}</w:t></w:r>"


CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f]")


def para_xml(p: dict) -> str:
    look = ("<w:pageBreakBefore/>" if p["page_break_before"] else "") + (f'<w:spacing w:before="{DOUBLE}"/>' if p["role"] == "end" else "")
    if p["role"] != "body":
        look += '<w:ind w:firstLine="0"/>' if p["role"] != "break" else ""
    look += '<w:jc w:val="center"/>' if p["align"] == "center" else ""
    return f"<w:p>{f'<w:pPr>{look}</w:pPr>' if look else ''}{p['xml']}</w:p>"


def single_xml(text: str, align: str) -> str:
    return f'<w:p><w:pPr><w:spacing w:line="{SINGLE}"/><w:ind w:firstLine="0"/><w:jc w:val="{align}"/></w:pPr>{run_xml(text)}</w:p>'


def package(paras: list[dict], contact: list[str], words: int, header: str) -> bytes:
    cell = lambda inner: f'<w:tc><w:tcPr><w:tcW w:w="2500" w:type="pct"/></w:tcPr>{inner}</w:tc>'
    table = f'<w:tbl><w:tblPr><w:tblW w:w="5000" w:type="pct"/></w:tblPr><w:tr>{cell("".join(single_xml(x, "left") for x in contact or [""]))}{cell(single_xml(f"about {words:,} words", "right"))}</w:tr></w:tbl>'
    section = f'<w:sectPr><w:headerReference w:type="default" r:id="rId2"/><w:headerReference w:type="first" r:id="rId3"/><w:pgSz w:w="{INCH * 17 // 2}" w:h="{INCH * 11}"/><w:pgMar w:top="{INCH}" w:right="{INCH}" w:bottom="{INCH}" w:left="{INCH}" w:header="708" w:footer="708" w:gutter="0"/><w:titlePg/></w:sectPr>'
    page = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText>PAGE</w:instrText></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    override = lambda part, kind: f'<Override PartName="/word/{part}.xml" ContentType="{WORD_TYPE}.{kind}+xml"/>'
    relation = lambda n, kind, target: f'<Relationship Id="rId{n}" Type="{OFFICE}/{kind}" Target="{target}"/>'
    relations = lambda *x: f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(x)}</Relationships>'
    files = {
        "[Content_Types].xml": f'{HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{override("document", "document.main")}{override("styles", "styles")}{override("header1", "header")}{override("header2", "header")}</Types>',
        "_rels/.rels": relations(relation(1, "officeDocument", "word/document.xml")),
        "word/_rels/document.xml.rels": relations(relation(1, "styles", "styles.xml"), relation(2, "header", "header1.xml"), relation(3, "header", "header2.xml")),
        "word/styles.xml": f'{HEAD}<w:styles {NS}><w:docDefaults><w:rPrDefault><w:rPr><w:rFonts w:ascii="Times New Roman" w:hAnsi="Times New Roman" w:cs="Times New Roman"/><w:sz w:val="24"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:line="{DOUBLE}"/><w:ind w:firstLine="{INCH // 2}"/></w:pPr></w:pPrDefault></w:docDefaults></w:styles>',
        "word/header1.xml": f'{HEAD}<w:hdr {NS}><w:p><w:pPr><w:spacing w:line="{SINGLE}"/><w:ind w:firstLine="0"/><w:jc w:val="right"/></w:pPr>{run_xml(header)}{page}</w:p></w:hdr>',
        "word/header2.xml": f"{HEAD}<w:hdr {NS}><w:p/></w:hdr>",
        "word/document.xml": f"{HEAD}<w:document {NS}><w:body>{table}{''.join(para_xml(p) for p in paras)}{section}</w:body></w:document>",
    }
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in files.items():
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), content.encode())
    return buffer.getvalue()


def pack(books: DataFrame, paras: DataFrame, words: DataFrame, underline_italics: bool = False) -> DataFrame:
    """book_id, file_name, data: a Word file for each book. words: book_id, about_words."""
    marked = paras.withColumn("xml", runs_xml(F.col("runs"), underline_italics))
    listed = marked.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "role", "align", "page_break_before", "xml"))).alias("paras"))
    rows = listed.join(contact_lines(books), "book_id").join(running_header(books), "book_id").join(words.select("book_id", "about_words"), "book_id").join(books.select("book_id", T.safe_filename(F.col("title"), "-manuscript.docx").alias("file_name")), "book_id")

    make = lambda r: {"book_id": r["book_id"], "file_name": r["file_name"], "data": package(r["paras"], r["lines"], r["about_words"], r["header"])}
    return rows.mapInArrow(row_by_row(make, {"book_id": paras.schema["book_id"].dataType, "file_name": StringType(), "data": BinaryType()}), f"book_id {paras.schema['book_id'].dataType.simpleString()}, file_name string, data binary")
