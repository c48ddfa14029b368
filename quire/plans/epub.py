"""EPUB books: a table of archive entries in order, and a packer that zips it."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from quire.functions import text as T
from quire.operators import outline as O
from quire.plans.batches import row_by_row

XML = '<?xml version="1.0" encoding="UTF-8"?>\n'

#: The archive's static files.
CONTAINER = (
    XML + '<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">\n  <rootfiles>\n'
    '    <rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/>\n  </rootfiles>\n</container>\n'
)
STYLESHEET = """body {
  margin: 5% 6%;
  font-family: serif;
  line-height: 1.5;
}
h1.chapter-title {
  text-align: center;
  font-weight: normal;
  font-size: 1.6em;
  margin: 3em 0 2em 0;
}
p {
  margin: 0;
  text-indent: 1.25em;
  text-align: justify;
}
p.first {
  text-indent: 0;
}
p.scene-break {
  text-indent: 0;
  text-align: center;
  margin: 1em 0;
}
.titlepage {
  text-align: center;
  margin-top: 30%;
}
.partpage {
  text-align: center;
  margin-top: 35%;
}
.partpage h1 {
  font-weight: normal;
  font-size: 1.8em;
}
.titlepage h1 {
  font-weight: normal;
  font-size: 2em;
}
.titlepage p.author {
  text-indent: 0;
  text-align: center;
  font-size: 1.2em;
  margin-top: 2em;
}
img.cover {
  max-width: 100%;
  max-height: 100%;
}
"""


def cat(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def head(language: Column) -> Column:
    x = T.escape_xml(language)
    return cat(XML, '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" xml:lang="', x, '" lang="', x, '">\n')


def page(title: Column, body: Column, language: Column) -> Column:
    return cat(head(language), "<head>\n  <title>", T.escape_xml(title), '</title>\n  <link rel="stylesheet" type="text/css" href="../styles/style.css"/>\n</head>\n<body>\n', body, "\n</body>\n</html>\n")


def section(kind: str, body: Column, css: str = "") -> Column:
    return cat(f'  <section {css}epub:type="{kind}">\n', body, "\n  </section>")


def title_page(title: Column, author: Column, language: Column) -> Column:
    body = cat("    <h1>", T.escape_xml(title), '</h1>\n    <p class="author">', T.escape_xml(author), "</p>")
    return page(title, section("titlepage", body, 'class="titlepage" '), language)


def part_page(title: Column, language: Column) -> Column:
    return page(title, section("part", cat("    <h1>", T.escape_xml(title), "</h1>"), 'class="partpage" '), language)


def cover_page(ext: Column, language: Column) -> Column:
    body = cat('  <section epub:type="cover" style="text-align:center">\n    <img class="cover" src="../images/cover.', ext, '" alt="Cover"/>\n  </section>')
    return page(F.lit("Cover"), body, language)


def chapter_pages(blocks: DataFrame) -> DataFrame:
    """book_id, chapter_no, body: paragraphs of a chapter as lines, the first ones marked."""
    b = O.first_paragraphs(blocks)
    line = F.when(F.col("kind") == "scene-break", F.lit('    <p class="scene-break">* * *</p>')).otherwise(cat("    <p", F.when(F.col("is_first"), F.lit(' class="first"')).otherwise(F.lit("")), ">", T.runs_xhtml(F.col("runs")), "</p>"))
    rows = F.array_sort(F.collect_list(F.struct(F.col("block_no"), line.alias("line"))))
    return b.groupBy("book_id", "chapter_no").agg(F.array_join(rows["line"], "\n").alias("body"))


def documents(books: DataFrame, chapters: DataFrame) -> DataFrame:
    """book_id, ord, id, title, kind (part or chapter), chapter_no, nested: content documents in
    reading order. nested: the chapter goes below the part before it."""
    w = Window.partitionBy("book_id").orderBy("chapter_no")
    c = O.part_starts(chapters).join(books.select("book_id", T.first_filled(F.col("title"), "Untitled").alias("book_title")), "book_id")
    c = c.withColumn("n", F.count("*").over(Window.partitionBy("book_id"))).withColumn("part_no", F.sum(F.col("new_part_web").cast("int")).over(w))
    number = F.col("chapter_no") + 1
    label = T.first_filled(F.col("title"), F.when(F.col("n") > 1, cat("Chapter ", number.cast("string"))).otherwise(F.col("book_title")))
    named = F.coalesce(F.col("part"), F.lit("")) != ""
    chapter = F.struct(F.lit(1).alias("k"), T.numbered("chapter-", number).alias("id"), label.alias("label"), F.lit("chapter").alias("kind"), named.alias("nested"))
    part = F.struct(F.lit(0).alias("k"), T.numbered("part-", F.col("part_no")).alias("id"), F.col("part").alias("label"), F.lit("part").alias("kind"), F.lit(False).alias("nested"))
    rows = c.select("book_id", "chapter_no", F.explode(F.when(F.col("new_part_web"), F.array(part, chapter)).otherwise(F.array(chapter))).alias("x")).select("book_id", "chapter_no", "x.*")
    order = Window.partitionBy("book_id").orderBy("chapter_no", "k")
    return rows.select("book_id", (F.row_number().over(order) - 1).cast("int").alias("ord"), "id", F.col("label").alias("title"), "kind", "chapter_no", "nested")


def _joined(order: Column, line: Column, sep: str = "\n") -> Column:
    return F.array_join(F.array_sort(F.collect_list(F.struct(order.alias("o"), line.alias("l"))))["l"], sep)


def with_covers(books: DataFrame, covers: DataFrame) -> DataFrame:
    """Adds cover, the extension of each book's image or null, from covers (book_id, mime): anything
    but image/png counts as a JPEG."""
    kinds = covers.select("book_id", F.when(F.col("mime") == "image/png", "png").otherwise("jpg").alias("cover"))
    return books.drop("cover").join(kinds, "book_id", "left")


def if_cover(text: Column | str) -> Column:
    return F.when(F.col("b_cover").isNull(), F.lit("")).otherwise(F.lit(text) if isinstance(text, str) else text)


def defaults(books: DataFrame) -> DataFrame:
    """book_id, b_title, b_author, b_language, b_uuid, b_modified, b_cover: what a book prints.
    An identifier is derived from book_id, title and author where books has none, so that a task that
    runs again gives the same; the time is the query's. b_cover is null for books without one."""
    cover = F.col("cover") if "cover" in books.columns else F.lit(None).cast("string")
    now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return books.select(
        "book_id",
        T.first_filled(F.col("title"), "Untitled").alias("b_title"),
        T.first_filled(F.col("author"), "Anonymous").alias("b_author"),
        T.first_filled(F.col("language"), "en").alias("b_language"),
        F.coalesce("uuid", cat("urn:uuid:", T.named_uuid(F.concat_ws("\n", F.col("book_id").cast("string"), "title", "author")))).alias("b_uuid"),
        F.coalesce("modified", now).alias("b_modified"),
        cover.alias("b_cover"),
    )


def point(id_: Column | str, order: Column | str, title: Column | str) -> Column:
    return cat('    <navPoint id="', id_, '" playOrder="', order, '">\n      <navLabel><text>', title, '</text></navLabel>\n      <content src="text/', id_, '.xhtml"/>\n    </navPoint>')


def item(id_: Column | str, href: Column | str, kind: str, more: str = "") -> Column:
    return cat('    <item id="', id_, '" href="', href, f'" media-type="{kind}"{more}/>')


def listings(docs: DataFrame) -> DataFrame:
    """book_id and, of each book's documents in order, one text each: items (of the contents), points
    (of the flat table), manifest and spine. All come from one grouping by entries of the contents and
    one by books, which the order by book before them already deals out."""
    name, nested = F.col("id"), F.col("nested")
    link = cat('<a href="text/', name, '.xhtml">', T.escape_xml(F.col("title")), "</a>")
    lines = {
        "points": point(name, (F.col("ord") + 2).cast("string"), T.escape_xml(F.col("title"))),
        "manifest": item(name, cat("text/", name, ".xhtml"), "application/xhtml+xml"),
        "spine": cat('    <itemref idref="', name, '"/>'),
    }
    w = Window.partitionBy("book_id").orderBy("ord")
    d = docs.withColumn("entry", F.sum((~nested).cast("int")).over(w))
    e = d.groupBy("book_id", "entry").agg(
        F.max(F.when(~nested, link)).alias("top"),
        _joined(F.col("ord"), F.when(nested, cat("        <li>", link, "</li>"))).alias("below"),
        F.count_if(nested).alias("n"),
        *[_joined(F.col("ord"), line).alias(k) for k, line in lines.items()],
    )
    top = F.when(F.col("n") > 0, cat("    <li>", F.col("top"), "\n      <ol>\n", F.col("below"), "\n      </ol>\n    </li>")).otherwise(cat("    <li>", F.col("top"), "</li>"))
    return e.groupBy("book_id").agg(_joined(F.col("entry"), top).alias("items"), *[_joined(F.col("entry"), F.col(k)).alias(k) for k in lines])


def nav_text() -> Column:
    first = cat(if_cover('    <li><a href="text/cover.xhtml">Cover</a></li>\n'), '    <li><a href="text/titlepage.xhtml">Title Page</a></li>')
    return cat(head(F.col("b_language")), '<head><title>Contents</title></head>\n<body>\n  <nav epub:type="toc" id="toc">\n    <h1>Contents</h1>\n    <ol>\n', first, "\n", F.col("items"), "\n    </ol>\n  </nav>\n</body>\n</html>\n")


def ncx_text() -> Column:
    meta = lambda name, value: cat(f'    <meta name="dtb:{name}" content="', value, '"/>\n')
    return cat(
        XML, '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1">\n  <head>\n', meta("uid", T.escape_xml(F.col("b_uuid"))), meta("depth", "1"), meta("totalPageCount", "0"), meta("maxPageNumber", "0"),
        "  </head>\n  <docTitle><text>", T.escape_xml(F.col("b_title")), "</text></docTitle>\n  <navMap>\n", point("titlepage", "1", "Title Page"), "\n", F.col("points"), "\n  </navMap>\n</ncx>\n",
    )


def package_text() -> Column:
    uuid, modified, language, title, author = (F.col(f"b_{c}") for c in ("uuid", "modified", "language", "title", "author"))
    xhtml, x = "application/xhtml+xml", T.escape_xml
    fixed = [item("nav", "nav.xhtml", xhtml, ' properties="nav"'), item("ncx", "toc.ncx", "application/x-dtbncx+xml"), item("style", "styles/style.css", "text/css"), item("titlepage", "text/titlepage.xhtml", xhtml)]
    image = [item("cover-image", cat("images/cover.", kind), f"image/{mime}", ' properties="cover-image"') for kind, mime in (("png", "png"), ("jpg", "jpeg"))]
    images = if_cover(cat(F.when(F.col("b_cover") == "png", image[0]).otherwise(image[1]), "\n", item("cover", "text/cover.xhtml", xhtml), "\n"))
    return cat(
        XML, '<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="pub-id" xml:lang="', x(language), '">\n  <metadata xmlns:dc="http://purl.org/dc/elements/1.1/">\n',
        '    <dc:identifier id="pub-id">', x(uuid), "</dc:identifier>\n    <dc:title>", x(title), '</dc:title>\n    <dc:creator id="creator">', x(author), "</dc:creator>\n",
        '    <meta refines="#creator" property="role" scheme="marc:relators">aut</meta>\n    <dc:language>', x(language), '</dc:language>\n    <meta property="dcterms:modified">', x(modified), "</meta>\n",
        if_cover('    <meta name="cover" content="cover-image"/>\n'), "  </metadata>\n  <manifest>\n", *(p for f in fixed for p in (f, "\n")), images, F.col("manifest"),
        '\n  </manifest>\n  <spine toc="ncx">\n', if_cover('    <itemref idref="cover" linear="yes"/>\n'), '    <itemref idref="titlepage"/>\n', F.col("spine"), "\n  </spine>\n</package>\n",
    )


def nav(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """book_id, content of the navigation document. shown: what `defaults` gives."""
    return listings(docs).join(shown, "book_id").select("book_id", nav_text().alias("content"))


def ncx(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """book_id, content of the older, flat table of contents."""
    return listings(docs).join(shown, "book_id").select("book_id", ncx_text().alias("content"))


def package(docs: DataFrame, shown: DataFrame) -> DataFrame:
    """book_id, content of the package document."""
    return listings(docs).join(shown, "book_id").select("book_id", package_text().alias("content"))


def entries(books: DataFrame, chapters: DataFrame, blocks: DataFrame) -> DataFrame:
    """book_id, seq, path, stored, content: the archive's files in order. books has book_id, title,
    author, language, uuid, modified and, if any has one, cover (see `with_covers`). The image of a
    cover has no content here; `pack` takes its bytes."""
    b = defaults(books)
    docs = documents(books, chapters)
    at = lambda n, path, content, stored=False: F.struct(F.lit(n).alias("a"), (F.lit(path) if isinstance(path, str) else path).alias("path"), F.lit(stored).alias("stored"), (F.lit(content) if isinstance(content, str) else content).alias("content"))
    always = [at(0, "mimetype", "application/epub+zip", True), at(1, "META-INF/container.xml", CONTAINER), at(2, "OEBPS/styles/style.css", STYLESHEET), at(3, "OEBPS/text/titlepage.xhtml", title_page(F.col("b_title"), F.col("b_author"), F.col("b_language")))]
    tables = [F.when(F.col("items").isNotNull(), at(n, f"OEBPS/{path}", text)) for n, path, text in ((7, "nav.xhtml", nav_text()), (8, "toc.ncx", ncx_text()), (9, "package.opf", package_text()))]
    shown = [F.when(F.col("b_cover").isNotNull(), x) for x in (at(5, cat("OEBPS/images/cover.", F.col("b_cover")), F.lit(None).cast("string")), at(6, "OEBPS/text/cover.xhtml", cover_page(F.col("b_cover"), F.col("b_language"))))]
    own = b.join(listings(docs), "book_id", "left").select("book_id", F.explode(F.array_compact(F.array(*always, *tables, *shown))).alias("x")).select("book_id", "x.*", F.lit(0).alias("o"))
    d = docs.join(chapter_pages(blocks), ["book_id", "chapter_no"], "left").join(b, "book_id")
    body = page(F.col("title"), section("chapter", cat('    <h1 class="chapter-title">', T.escape_xml(F.col("title")), "</h1>\n", F.coalesce("body", F.lit("")))), F.col("b_language"))
    content = F.when(F.col("kind") == "part", part_page(F.col("title"), F.col("b_language"))).otherwise(body)
    pages = d.select("book_id", F.lit(4).alias("a"), cat("OEBPS/text/", F.col("id"), ".xhtml").alias("path"), F.lit(False).alias("stored"), content.alias("content"), F.col("ord").alias("o"))
    rows = own.unionByName(pages)
    w = Window.partitionBy("book_id").orderBy("a", "o")
    return rows.select("book_id", (F.row_number().over(w) - 1).cast("int").alias("seq"), "path", "stored", "content")


def pack(rows: DataFrame, covers: DataFrame | None = None, limit: int = 32 << 20) -> DataFrame:
    """book_id, data: the zipped archive of each book, its first entry stored. covers: book_id, image
    (bytes); a cover without bytes leaves its entry out. A batch of archives has about `limit` bytes."""
    listed = rows.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("seq", "path", "stored", "content"))).alias("files"))
    if covers is None:
        listed = listed.withColumn("image", F.lit(None).cast("binary"))
    else:
        listed = listed.join(covers.select("book_id", "image"), "book_id", "left")

    def zipped(row: dict) -> bytes:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
            for f in row["files"]:
                data = row["image"] if f["content"] is None else f["content"].encode()
                if data is not None:
                    info = zipfile.ZipInfo(f["path"], (1980, 1, 1, 0, 0, 0))
                    info.compress_type = zipfile.ZIP_STORED if f["stored"] or f["content"] is None else zipfile.ZIP_DEFLATED
                    z.writestr(info, data)
        return buffer.getvalue()

    return listed.mapInArrow(row_by_row(lambda r: {"book_id": r["book_id"], "data": zipped(r)}, {"book_id": rows.schema["book_id"].dataType, "data": BinaryType()}, limit), f"book_id {rows.schema['book_id'].dataType.simpleString()}, data binary")
