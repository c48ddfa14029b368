"""Fixtures with known results for the manuscript operators."""

import io
import time
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import books as B
from quire.operators import html as H
from quire.operators import lines as L
from quire.operators import outline as O
from quire.plans import docx as D
from quire.plans import epub as E
from quire.sources import markdown as M
from quire.sources.docx import paragraphs, parse_docx

RUNS = "array<struct<text:string,italic:boolean,bold:boolean>>"


def values(spark, rows, column, schema="s string"):
    df = spark.createDataFrame([(r,) for r in rows], schema).withColumn("i", F.monotonically_increasing_id())
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def outline_of(spark, text, name="book.md"):
    files = spark.createDataFrame([(1, 0, name, text)], "book_id long, file_ord int, file_name string, content string")
    parsed = M.parse_files(files)
    return parsed, M.outline(parsed)


def book_of(spark, text, name="book.md"):
    parsed, o = outline_of(spark, text, name)
    seg = O.segments(o, ["book_id"]).cache()
    found = O.chapters(seg, ["book_id"])
    return parsed, found, O.blocks(seg, ["book_id"])


def listed(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


CHAPTER_LINES = {
    "Chapter Twelve": 1, "CHAPTER 7": 1, "Chapter XII": 1, "PART TWO: THE RECKONING": 1, "Book 3": 1, "Prologue": 1, "Epilogue.": 1, "chapter twenty-one": 1, "Interlude - Rain": 1, "Part one — Home": 1,
    "Part of me wanted to go.": 0, "Book clubs were fun.": 0, "Chapter mid": 0, "Chapter": 0, "Chapter - foo": 0, "Chapter: foo": 0, "The prologue was long": 0, "Part did": 0, "Chapter Twelve was the longest of them all by far, she said": 0, "Chapters": 0,
}


def test_chapter_lines(spark):
    assert values(spark, list(CHAPTER_LINES), T.is_chapter_line) == [bool(v) for v in CHAPTER_LINES.values()]


def test_scene_breaks(spark):
    rows = ["#", "##", "***", "* * *", " ~~ ", "·", " # ", "# \n", "**", "a"]
    assert values(spark, rows, T.is_scene_break) == [True, False, True, True, True, True, True, True, False, False]


def test_words_and_rounding(spark):
    assert values(spark, ["", "  ", "a b", " a b\n c ", None], T.words) == [0, 0, 2, 3, 0]
    numbers = [0, 49, 50, 149, 150, 1234, 39_949, 39_950, 40_000, 81_499, 81_500]
    assert values(spark, numbers, T.manuscript_words, "s long") == [100, 100, 100, 100, 200, 1200, 39_900, 40_000, 40_000, 81_000, 82_000]


def test_strings(spark):
    assert values(spark, ["10-the_end.md", "2 x.tar.gz", "a", "-.md"], T.title_from_filename) == ["the end", "x.tar", "a", ""]
    assert values(spark, ["It’s Ñandú & Co!", "", None, "x" * 70, "--"], lambda s: T.safe_filename(s, ".epub")) == ["its-ñandú-co.epub", "untitled.epub", "untitled.epub", "x" * 60 + ".epub", "untitled.epub"]
    assert values(spark, ['a & <b> "c" \x00\x0b\x0c\t\n\'x'], T.escape_xml) == ["a &amp; &lt;b&gt; &quot;c&quot; \t\n'x"]
    assert values(spark, ["&#38;lt; &#x41;&#128512; &nbsp; &amp;amp; &#9999999;"], T.decode_entities) == ["< A😀 &nbsp; &amp; &#9999999;"]
    assert values(spark, ["Ann B. Writer ", "", " "], T.last_name) == ["Writer", "Author", "Author"]
    assert values(spark, ["one two three", "one two three four", "straße", ""], T.short_title) == ["ONE TWO THREE", "ONE TWO", "STRASSE", "UNTITLED"]
    assert [len(x) for x in values(spark, ["x" * 140, "x" * 141], T.clip)] == [140, 140]
    assert values(spark, [1, 37, 1234], lambda n: T.numbered("chapter-", n), "s long") == ["chapter-001", "chapter-037", "chapter-1234"]
    assert values(spark, ["\t a", "    \tb", "x"], T.leading_weight) == [5, 8, 0]


def test_natural_order(spark):
    files = spark.createDataFrame([(1, i, n) for i, n in enumerate(["10-a.md", "2-a.md", "1-a.md", "b10.md", "b2.md"])], "book_id long, file_ord int, file_name string")
    assert [r.file_name for r in B.natural_order(files).orderBy("file_ord").collect()] == ["1-a.md", "2-a.md", "10-a.md", "b2.md", "b10.md"]
    names = ["z1", "Z1", "é2", "e10", "E2", "e2", "é10", "a_1", "a-1", "a1", "A01b", "a1b", "a 1", "a1.10.2", "a1.9.11", "a1.9.2", "ß", "ss", "st", "12", "9", "09", "100"]
    rows = spark.createDataFrame([(1, i, n) for i, n in enumerate(names)], "book_id long, file_ord int, file_name string")
    want = ["9", "09", "12", "100", "a_1", "a-1", "a 1", "a1", "a1.9.2", "a1.9.11", "a1.10.2", "a1b", "A01b", "e2", "E2", "é2", "e10", "é10", "ss", "ß", "st", "z1", "Z1"]
    got = [r.file_name for r in B.natural_order(rows).orderBy("file_ord").collect()]
    assert [x for x in got if " " not in x] == [x for x in want if " " not in x] and got.index("a 1") < got.index("a_1")


def test_ingest_status(spark):
    rows = [(1, "a.md"), (1, "b.DOCX"), (1, "c.docx"), (2, "a.docx"), (2, "b.docx"), (3, "x.pdf"), (4, "x.pdf"), (4, "y.TXT")]
    files = spark.createDataFrame(rows, "book_id long, file_name string")
    assert dict(listed(B.ingest_status(files), "book_id", "status")) == {1: "mixed", 2: "multi_docx", 3: "unsupported", 4: "ok"}


def lines_of(spark, text):
    files = spark.createDataFrame([(1, 0, "f.md", text)], "book_id long, file_ord int, file_name string, content string")
    return files, L.lines(files)


CENTERED = "\t\tOne\n\nText of it.\n\n        Two\n\n\tonly one tab\n\n        poem a\n        poem b\n\n\t\t* * *\n\n        " + "x" * 61


def test_centered_lines(spark):
    files, rows = lines_of(spark, CENTERED)
    found = L.centered_lines(rows).orderBy("idx")
    assert listed(found, "idx", "text", "before", "after") == [(0, "One", None, "Text of it."), (4, "Two", "Text of it.", "only one tab")]
    answers = spark.createDataFrame([(1, 0, 0, True), (1, 0, 4, False)], "book_id long, file_ord int, idx int, is_title boolean")
    depths = spark.createDataFrame([(1, 0, 2)], "book_id long, file_ord int, depth int")
    text = L.apply_decisions(files, answers, depths).first().content
    assert text.split("\n")[0] == "## One" and text.split("\n")[4] == "Two" and text.split("\n")[6] == "\tonly one tab"


@pytest.mark.parametrize(
    ("text", "answers", "want"),
    [
        ("", [], ""),
        ("\ta\n\n\tb", [], "\ta\n\n\tb"),
        ("\ta\n\n\tb", [(0, True)], "# a\n\n\tb"),
        ("\ta\n\n\tb", [(2, True), (0, None)], "\ta\n\n# b"),
        ("\ta\n\n\tb\n", [(2, False), (0, True)], "# a\n\nb\n"),
        ("\ta\nx\n\tb\ny", [(0, False), (2, True), (2, False), (0, False)], "a\nx\n# b\ny"),
        ("\n\n", [(1, True)], "\n\n"),
    ],
)
def test_apply_decisions(spark, text, answers, want):
    files, _ = lines_of(spark, text)
    given = spark.createDataFrame([(1, 0, *a) for a in answers], "book_id long, file_ord int, idx int, is_title boolean")
    depths = spark.createDataFrame([(1, 0, 1)], "book_id long, file_ord int, depth int")
    assert L.apply_decisions(files, given, depths).first().content == want


@pytest.mark.parametrize(("n", "plain", "kept"), [(20, 0, 20), (21, 0, 0), (21, 84, 21), (21, 83, 0)])
def test_plausible(spark, n, plain, kept):
    _, rows = lines_of(spark, "\n\n".join(["        t"] * n + ["p"] * plain))
    assert L.centered_lines(rows).count() == kept


def test_review_in_the_row(spark):
    """What is found within a file's row is what sorted lines give."""
    import random

    rng = random.Random(8)
    parts = ["", "", "", "text", "\t\tSong", "        Two of them", "# A", "  ## B", "---", "* * *", "\t\t\u3000", " \t", "\t\t" + "x" * 61, "\r", "###### Z", "z" * 150]
    texts = ["\n".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(150)]
    texts += ["\n\n".join(["        t"] * 21 + ["p"] * n) for n in (83, 84)] + ["---\na\n---\n\n# T", "---\n# T", "\n\n---\n---\n# T", "# T", None]
    files = spark.createDataFrame([(i // 2, i % 2, f"f{i % 2}.md", t) for i, t in enumerate(texts)], "book_id long, file_ord int, file_name string, content string")
    rows, reviewed = L.lines(files.fillna("")), L.review(files).cache()
    assert "Exchange" not in reviewed._jdf.queryExecution().executedPlan().toString()
    cols = ["book_id", "file_ord", "idx", "text", "before", "after"]
    sorted_rows = lambda df: sorted(map(repr, df.select(cols).collect()))
    found = L.candidate_rows(reviewed)
    assert sorted_rows(found) == sorted_rows(L.centered_lines(rows)) and found.count() > 40
    assert sorted_rows(L.candidate_rows(L.review(files, check=False))) == sorted_rows(L.centered_lines(rows, check=False))
    depths = L.promotion_depth(L.headings(rows).withColumnRenamed("line_no", "ord"), L.opens_with_heading(rows))
    depth = lambda df: sorted(map(tuple, df.select("book_id", "file_ord", "depth").collect()))
    assert depth(reviewed) == depth(depths)
    # answers: some twice, some null, some about nothing
    given = found.where("idx % 4 < 3").select("book_id", "id", F.expr("CASE idx % 4 WHEN 0 THEN true WHEN 1 THEN false END").alias("is_title"))
    given = given.unionByName(found.where("idx % 4 = 1 and idx % 3 = 0").select("book_id", "id", F.lit(True).alias("is_title"))).unionByName(spark.createDataFrame([(0, "f0.md:9999", True), (999, "f0.md:0", True)], given.schema))
    new = L.apply_answers(L.with_answers(reviewed, given))
    want = L.apply_decisions(files, L.answered(found, given).select("book_id", "file_ord", "idx", "is_title"), depths)
    text = lambda df: sorted(map(repr, df.select("book_id", "file_ord", "content").collect()))
    assert text(new) == text(want) and new.columns == [*files.columns, "candidates"]


@pytest.mark.parametrize(("text", "depth"), [("", 1), ("# T\n\ntext", 2), ("---\na: b\n---\n\n# T", 2), ("x\n\n# T", 1), ("# A\n\n# B", 1), ("###### T", 6), ("---\n# T", 1)])
def test_promotion_depth(spark, text, depth):
    _, rows = lines_of(spark, text)
    heads = L.headings(rows).withColumnRenamed("line_no", "ord")
    assert listed(L.promotion_depth(heads, L.opens_with_heading(rows)), "depth") == [(depth,)]


def test_markdown_book(spark):
    text = "---\ntitle: The Book\nauthor: A. Writer\nyear: 2020\nlegal-name: 'Ann Writer'\n---\n\n# One\n\nSome *it* and **bold**.\n\nMore.\n\n***\n\nEnd.\n\n# Two\n\nLast.\n"
    parsed, found, blocks = book_of(spark, text)
    meta = M.metadata(parsed).first()
    assert (meta.title, meta.author, meta.legal_name, meta.email) == ("The Book", "A. Writer", "Ann Writer", None)
    assert listed(found.orderBy("chapter_no"), "title", "n_blocks") == [("One", 4), ("Two", 1)]
    assert [k for k, in listed(blocks.where("chapter_no = 0").orderBy("block_no"), "kind")] == ["paragraph", "paragraph", "scene-break", "paragraph"]
    first = blocks.where("chapter_no = 0 and block_no = 0").first().runs
    assert [(r.text, r.italic, r.bold) for r in first] == [("Some ", False, False), ("it", True, False), (" and ", False, False), ("bold", False, True), (".", False, False)]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("# T\n\n## C1\n\na\n\n## C2\n\nb", [("C1", None), ("C2", None)]),
        ("# P1\n\n## A\n\nx\n\n## B\n\nx\n\n# P2\n\n## C\n\nx", [("A", "P1"), ("B", "P1"), ("C", "P2")]),
        ("# A\n\nx\n\n## s\n\ny\n\n# B\n\nz", [("A", None), ("B", None)]),
        ("# A\n\n## d\n\nx\n\n# B\n\n## e\n\ny", [("A", None), ("B", None)]),
        ("intro\n\n# A\n\nx", [("", None), ("A", None)]),
        ("# P1\n\nforeword\n\n## A\n\nx\n\n## B\n\n# P2\n\n## C\n\ny", [("", "P1"), ("A", "P1"), ("B", "P1"), ("C", "P2")]),
    ],
)
def test_chapters(spark, text, expected):
    _, found, _ = book_of(spark, text)
    assert listed(found.orderBy("chapter_no"), "title", "part") == expected


def test_lone_title_and_empty_book(spark):
    _, o = outline_of(spark, "# T\n\n## C1\n\na\n\n## C2\n\nb")
    row = O.shapes(o, ["book_id"]).first()
    assert (row.title_no, row.book_title, row.titled.chapter_depth, row.plain.chapter_depth) == (0, "T", 2, 1)
    books = spark.createDataFrame([(1,), (2,)], "book_id long")
    _, found, _ = book_of(spark, "")
    assert listed(O.with_empty_books(found, books).orderBy("book_id"), "book_id", "chapter_no", "title", "n_blocks") == [(1, 0, "", 0), (2, 0, "", 0)]


def plain_text(t):
    return "|".join("".join(r["text"] for r in i["runs"]) for i in M.parse(t)[1] if i["runs"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("[a](x(y(z)w)v) b", "a b"),
        ("[a](x(y b", "[a](x(y b"),
        ("[a](x\\)y) b", "a b"),
        ("-\tone\n\n\ttwo", "one|two"),
        ("-\t\tcode\n\nx", "x"),
        ("- -\ta\n\n    b", "a|b"),
        (">\tquoted", "quoted"),
        ("text\n7.\tmore", "text\n7.\tmore"),
    ],
)
def test_markdown_destinations_and_tabs(text, want):
    assert plain_text(text) == want


@pytest.mark.parametrize("part", ["a* ", "*a ", "_a b* ", "`a ``b ", "* x", "[a](", "[a](b) ", "a**b", "("])
def test_long_paragraphs_take_time_in_proportion(part):
    start = time.process_time()
    M.Inline(set()).runs(part * 20_000)
    assert time.process_time() - start < 10


def test_text_boxes_and_deletions():
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    run = lambda t: f"<w:r><w:t>{t}</w:t></w:r>"
    box = f"<w:txbxContent><w:p>{run('boxed')}</w:p></w:txbxContent>"
    either = f"<mc:AlternateContent><mc:Choice>{box}</mc:Choice><mc:Fallback><w:pict>{box}</w:pict></mc:Fallback></mc:AlternateContent>"
    body = f"<w:p>{run('before ')}<w:r>{either}</w:r><w:del><w:r><w:tab/><w:delText>gone</w:delText></w:r></w:del>{run('after')}</w:p><w:p>{run('next')}</w:p>"
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"><w:body>{body}</w:body></w:document>')
    assert ["".join(r["text"] for r in p["runs"]) for p in paragraphs(data.getvalue())] == ["before after", "boxed", "next"]


def test_markdown_details(spark):
    runs = lambda t: "|".join("".join(r["text"] for r in i["runs"]) for i in M.parse(t)[1] if i["runs"])
    assert [i["kind"] for i in M.parse("One.\n\n#\n\nTwo.")[1]] == ["paragraph", "scene-break", "paragraph"]
    assert [i["kind"] for i in M.parse("a\n\n~~~\n\nb")[1]] == ["paragraph", "scene-break", "paragraph"]
    assert runs("a <!-- note --> b <span>c</span><br>d") == "a  b c d"
    assert runs("[text][1] and ![i](x) [l](u)\n\n[1]: http://x") == "text and  l"
    assert runs("> q\n\n- a\n- b\n\nend\n\n    code\n\n<div>\nx\n</div>\n\nlast") == "q|a|b|end|last"
    assert runs("~~x~~ `c` \\* &amp; http") == "~~x~~ c * & http"
    assert M.parse("Title\n===\n\nSub\n---\n")[1][0]["depth"] == 1


def test_multi_file(spark):
    texts = ["# P one\n\n## A\n\nx\n\n## B\n\ny", "# Alone\n\n## C\n\nz", "just text", ""]
    files = spark.createDataFrame([(1, i, f"{i + 1}-file_{i}.md", t) for i, t in enumerate(texts)], "book_id long, file_ord int, file_name string, content string")
    files = files.withColumn("n_files", F.lit(4))
    seg = B.file_segments(M.outline(M.parse_files(files)), files)
    found = B.file_chapters(seg, files)
    assert listed(B.file_blocks(seg, found).orderBy("chapter_no", "block_no").select("chapter_no", "block_no", T.run_text(F.col("runs")).alias("t")), "chapter_no", "block_no", "t") == [(0, 0, "x"), (1, 0, "y"), (2, 0, "C"), (2, 1, "z"), (3, 0, "just text")]
    assert listed(found.orderBy("chapter_no"), "title", "part", "n_blocks") == [("A", "P one", 1), ("B", "P one", 1), ("Alone", None, 2), ("file 2", None, 1), ("file 3", None, 0)]


def slow_shape(depths):
    """Sections walked one by one."""
    if not depths:
        return None, None, False
    d0 = min(depths)
    d1 = min((d for d in depths if d > d0), default=None)
    counts = []
    for d in depths:
        if d == d0:
            counts.append(0)
        elif d == d1 and counts:
            counts[-1] += 1
    return d0, d1, d1 is not None and len(counts) >= 2 and min(counts) >= 1 and max(counts) >= 2


def test_shapes(spark):
    import random

    rng = random.Random(2)
    books = {b: [rng.choice([None, 1, 1, 2, 2, 2, 3]) for _ in range(rng.randint(1, 9))] for b in range(300)}
    rows = [(b, i * 2, d, f"t{i}") for b, ds in books.items() for i, d in enumerate(ds)]
    rng.shuffle(rows)
    shapes = O.shapes(spark.createDataFrame(rows, "book_id long, item_no int, depth int, text string"), ["book_id"])
    assert "Window" not in shapes._jdf.queryExecution().executedPlan().toString()
    found = {r.book_id: r for r in shapes.collect()}
    for b, ds in books.items():
        heads = [d for d in ds if d]
        titled = ds[0] is not None and len(heads) >= 2 and ds[0] == min(heads) and heads.count(min(heads)) == 1
        r = found[b]
        assert (r.title_no, r.book_title) == ((0, "t0") if titled else (None, None))
        assert tuple(r.plain)[:3] == slow_shape(heads) and tuple(r.titled)[:3] == slow_shape(heads[1:] if titled else heads), (b, ds)
    assert sum(r.titled.part_shaped for r in found.values()) > 10


def test_html_paragraphs(spark):
    html = '<h1>Title</h1><p>A <em>b</em> <strong>c</p><p class="x is-centered">d</strong> e</p>out<p> </p><li>***<p>x<br>&amp;y'
    p = H.paragraphs(spark.createDataFrame([(1, html)], "book_id long, html string")).orderBy("para_no")
    got = listed(p.select("heading", "centered", T.runs_xhtml(F.col("runs")).alias("x")), "heading", "centered", "x")
    assert got == [(1, False, "Title"), (None, False, "A <em>b</em> <strong>c</strong>"), (None, True, "<strong>d</strong> e"), (None, False, "***"), (None, False, "x &amp;y")]


def test_trim_edges(spark):
    rows = [([("\t ", False, False), (" a", True, False), ("b \t", False, False), (" ", False, True)],), ([(" ", False, False)],), ([],)]
    df = spark.createDataFrame(rows, f"runs {RUNS}")
    got = [[(r.text, r.italic) for r in x[0]] for x in df.select(T.trim_edges(F.col("runs"))).collect()]
    assert got == [[("a", True), ("b", False)], [], []]


def parted(spark):
    return spark.createDataFrame([(1, i, p, "", 0) for i, p in enumerate(["P", None, "P", "Q", "Q", ""])], "book_id long, chapter_no int, part string, title string, n_blocks long")


def test_part_starts(spark):
    got = listed(O.part_starts(parted(spark)).orderBy("chapter_no"), "new_part_web", "new_part_print")
    assert got == [(True, True), (False, False), (True, False), (True, True), (False, False), (False, False)]


SAMPLE = "# One\n\nThe *sea* & \\<shore>.\n\n***\n\nMore text here.\n\n# Two\n\nEnd.\n"
META = "book_id long, title string, author string, legal_name string, address string, email string, phone string, language string, uuid string, modified string"


def meta(spark):
    return spark.createDataFrame([(1, "Salt & Sand", "A. Writer", None, "1 Road\n\nTown", "a@b.c", None, None, "urn:uuid:1", "2024-01-01T00:00:00Z")], META)


def test_epub(spark):
    _, found, blocks = book_of(spark, SAMPLE)
    data = E.pack(E.entries(meta(spark), found, blocks)).first().data
    assert bytes(data[30:58]) == b"mimetypeapplication/epub+zip"
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        assert z.namelist()[0] == "mimetype" and z.infolist()[0].compress_type == zipfile.ZIP_STORED
        page = z.read("OEBPS/text/chapter-001.xhtml").decode()
        assert '<p class="first">The <em>sea</em> &amp; &lt;shore&gt;.</p>' in page and '<p class="scene-break">* * *</p>' in page
        assert "Salt &amp; Sand" in z.read("OEBPS/package.opf").decode() and 'playOrder="3"' in z.read("OEBPS/toc.ncx").decode()
        assert {"OEBPS/nav.xhtml", "OEBPS/styles/style.css", "OEBPS/text/titlepage.xhtml", "META-INF/container.xml", "OEBPS/text/chapter-002.xhtml"} <= set(z.namelist())


def test_cover(spark):
    _, found, blocks = book_of(spark, SAMPLE)
    covers = spark.createDataFrame([(1, bytearray(b"png bytes"), "image/png")], "book_id long, image binary, mime string")
    data = E.pack(E.entries(E.with_covers(meta(spark), covers), found, blocks), covers).first().data
    with zipfile.ZipFile(io.BytesIO(bytes(data))) as z:
        assert z.read("OEBPS/images/cover.png") == b"png bytes" and "cover.png" in z.read("OEBPS/text/cover.xhtml").decode()
        assert 'properties="cover-image"' in z.read("OEBPS/package.opf").decode() and ">Cover</a>" in z.read("OEBPS/nav.xhtml").decode()


def test_docx_round_trip(spark):
    _, found, blocks = book_of(spark, SAMPLE)
    words = B.book_words(B.chapter_words(found, blocks))
    assert words.first().words == 8
    files = D.pack(meta(spark), D.paragraphs(meta(spark), found, blocks), words)
    row = files.first()
    assert row.file_name == "salt-sand-manuscript.docx"
    with zipfile.ZipFile(io.BytesIO(bytes(row.data))) as z:
        document, header = z.read("word/document.xml").decode(), z.read("word/header1.xml").decode()
    assert "about 100 words" in document and ">END<" in document and 'w:w="12240" w:h="15840"' in document and "Writer / SALT &amp; SAND / " in header
    paras = parse_docx(files.select("book_id", F.col("data").alias("content")))
    text = [x for x, in listed(paras.orderBy("para_no").select(T.run_text(F.col("runs")).alias("t")), "t")]
    assert text[text.index("One") :] == ["One", "The sea & <shore>.", "#", "More text here.", "Two", "End.", "END"]


def test_paragraph_decisions(spark):
    p = spark.createDataFrame([(1, 0, None, False, [("\t\tOne ", True, False)]), (1, 1, None, False, [("body", False, False)]), (1, 2, None, True, [("Two", False, False)])], f"book_id long, para_no int, heading int, centered boolean, runs {RUNS}")
    assert listed(L.centered_paragraphs(p).orderBy("idx"), "idx", "before", "after") == [(0, None, "body"), (2, "body", None)]
    answers = spark.createDataFrame([(1, 0, True), (1, 2, False)], "book_id long, para_no int, is_title boolean")
    got = listed(B.apply_paragraph_decisions(p, answers).orderBy("para_no").select("heading", T.runs_xhtml(F.col("runs")).alias("x")), "heading", "x")
    assert got == [(1, "One"), (None, "body"), (None, "Two")]


def test_patch_and_finish(spark):
    changes = spark.createDataFrame([(1, "title", "New"), (1, "email", "")], "book_id long, field string, value string")
    row = B.patch(meta(spark), changes).first()
    assert (row.title, row.email, row.author) == ("New", None, "A. Writer")
    b = spark.createDataFrame([(1, None, None, "01_my-book.md")], "book_id long, title string, author string, file_name string")
    assert listed(B.finish(b), "title", "author") == [("my book", "")]


def test_named_identifiers(spark):
    import uuid

    names = ["", "a", "7\nSalt & Sänd", "x" * 300]
    assert values(spark, names, T.named_uuid) == [str(uuid.uuid5(uuid.NAMESPACE_OID, n)) for n in names]
