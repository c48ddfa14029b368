"""One query for each operator, over the frames in `adapters`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import adapters as A
from quire.functions import text as T
from quire.operators import books as B
from quire.operators import html as H
from quire.operators import lines as L
from quire.operators import outline as O
from quire.operators import ranges as W
from quire.operators import reviews as R
from quire.plans import docx as D
from quire.plans import epub as E
from quire.plans.folders import kept

KEY = ["book_id"]
QUERIES: dict = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.select(*[F.col(c).cast("long").alias(c) if t in ("int", "smallint") else F.col(c) for c, t in df.dtypes])

    QUERIES[fn.__name__] = run
    return run


def segmented(s, d):
    return O.segments(A.outline(s, d), KEY)


def chapters(s, d):
    return O.chapters(segmented(s, d), KEY)


def built(s, d):
    seg = segmented(s, d)
    return O.chapters(seg, KEY), O.blocks(seg, KEY)


def written(s, d):
    """The same from segments that are written once: for what uses them many times."""
    seg = kept(segmented(s, d))
    return O.chapters(seg, KEY), O.blocks(seg, KEY)


def events_text(s, d):
    return A.table(s, d, "events").select("event_id", F.expr("event_type || ' ' || event_id || ' & <' || props || '>'").alias("s"))


@query
def manuscript_words(s, d):
    counted = A.table(s, d, "documents").select("doc_id", T.words(F.col("text")).alias("words"))
    return counted.withColumn("about_words", T.manuscript_words(F.col("words")))


@query
def source_words(s, d):
    return A.table(s, d, "documents").groupBy("source", "lang").agg(F.sum(T.words(F.col("text"))).alias("words")).withColumn("about_words", T.manuscript_words(F.col("words")))


@query
def lines(s, d):
    return L.lines(A.files(s, d)).select("book_id", "line_no", "line")


@query
def route_files(s, d):
    return B.route(A.named_files(s, d)).select("book_id", "file_ord", "file_name", "route")


@query
def ingest_status(s, d):
    return B.ingest_status(A.named_files(s, d))


@query
def natural_sort(s, d):
    return B.natural_order(A.named_files(s, d).withColumn("file_name", F.expr(A.VARIED))).select("book_id", "file_ord", "file_name")


@query
def neutralize_tildes(s, d):
    return A.files(s, d).select("book_id", T.neutralize_tildes(F.col("content")).alias("content"))


@query
def scene_breaks(s, d):
    return L.lines(A.files(s, d)).where(T.is_scene_break(F.col("line"))).select("book_id", "line_no")


@query
def centered_shaped(s, d):
    rows = L.lines(A.files(s, d)).withColumn("weight", T.leading_weight(F.col("line")))
    return rows.where(T.is_centered_shaped(F.col("line"))).select("book_id", "line_no", "weight")


@query
def atx_headings(s, d):
    return L.headings(L.lines(A.files(s, d))).select("book_id", "line_no", "depth")


@query
def heading_depths(s, d):
    h = L.headings(L.lines(A.files(s, d)))
    ordered = F.array_sort(F.collect_list(F.struct("line_no", "depth")))["depth"]
    return h.groupBy("book_id").agg(F.array_join(ordered.cast("array<string>"), ",").alias("depths"))


@query
def first_content_heading(s, d):
    return L.opens_with_heading(L.lines(A.files(s, d))).select("book_id", "opens")


def depths(s, d):
    rows = L.lines(A.files(s, d))
    return L.promotion_depth(L.headings(rows).withColumnRenamed("line_no", "ord"), L.opens_with_heading(rows))


@query
def promotion_depth(s, d):
    return depths(s, d).select("book_id", "depth")


@query
def standalone_centered(s, d):
    return L.centered_lines(L.lines(A.files(s, d)), check=False).drop("file_ord")


@query
def centered_lines(s, d):
    return L.centered_lines(L.lines(A.files(s, d))).drop("file_ord")


def decisions(s, d):
    found = L.candidate_rows(L.review(A.files(s, d)))
    return found, found.where("(book_id + idx) % 3 <> 0").select("book_id", "id", F.expr("(book_id + idx) % 3 = 1").alias("is_title"))


@query
def candidate_decisions(s, d):
    found, answers = decisions(s, d)
    return L.answered(found, answers).select("book_id", "id", "text", "is_title")


@query
def stored_decisions(s, d):
    from quire.plans.stored import store

    found, answers = (store(x, ["book_id", "id"], 8) for x in decisions(s, d))
    return L.answered(found, answers).select("book_id", "id", "text", "is_title")


@query
def bulk_decisions(s, d):
    found, answers = decisions(s, d)
    return L.bulk_answer(L.answered(found, answers), False, ["idx"]).select("book_id", "id", "is_title")


@query
def answer_log(s, d):
    return R.reduce_answers(A.review_log(s, d), A.review_candidates(s, d)).select("book_id", "place", "id", "is_title", "finished")


@query
def apply_decisions_text(s, d):
    reviewed = L.review(A.files(s, d))
    said = F.expr("transform(filter(candidates, c -> (book_id + c.idx) % 3 <> 0), c -> named_struct('no', c.idx, 'yes', (book_id + c.idx) % 3 = 1))")
    return L.apply_answers(reviewed.withColumn("answers", said)).select("book_id", "content")


@query
def joined_decisions_text(s, d):
    _, answers = decisions(s, d)
    return L.apply_answers(L.with_answers(L.review(A.files(s, d)), answers)).select("book_id", "content")


@query
def centered_paras(s, d):
    return L.centered_paragraphs(A.spoken(s, d))


@query
def plausible_candidates(s, d):
    rows = A.table(s, d, "events").select(F.col("user_id").alias("book_id"), "event_id", "event_type", "value")
    return L.plausible(rows, F.expr("event_type in ('signup', 'error') and value < 60 + book_id % 40"), F.lit(True), KEY).select("book_id", "event_id")


def para_decisions(s, d):
    return L.centered_paragraphs(A.spoken(s, d)).where("(book_id + idx) % 3 <> 0").select("book_id", F.col("idx").alias("para_no"), F.expr("(book_id + idx) % 3 = 1").alias("is_title"))


@query
def apply_decisions_paras(s, d):
    from quire.operators.books import apply_paragraph_decisions

    p = apply_paragraph_decisions(A.spoken(s, d), para_decisions(s, d))
    return p.select("book_id", "para_no", "heading", T.runs_xhtml(F.col("runs")).alias("runs"))


@query
def trim_edges(s, d):
    return A.spoken(s, d).select("book_id", "para_no", T.runs_xhtml(T.trim_edges(F.col("runs"))).alias("runs"))


@query
def chapter_lines(s, d):
    return A.spoken(s, d).where(T.is_chapter_line(T.run_text(F.col("runs")))).select("book_id", "para_no", T.trim(T.run_text(F.col("runs"))).alias("title"))


@query
def para_outline(s, d):
    return O.paragraph_outline(A.spoken(s, d)).select("book_id", "item_no", "kind", "depth", "text")


@query
def any_heading(s, d):
    return A.spoken(s, d).groupBy("book_id").agg(F.bool_or(F.col("heading").isNotNull()).alias("has_heading"))


@query
def line_chapters(s, d):
    seg = O.segments(O.line_outline(A.spoken(s, d)), KEY, detect=False)
    return O.chapters(seg, KEY).select("book_id", "chapter_no", "title", "n_blocks")


@query
def block_text(s, d):
    return A.spoken(s, d).select("book_id", "para_no", T.run_text(F.col("runs")).alias("text"))


@query
def html_tokens(s, d):
    return H.tokens(A.html(s, d))


@query
def html_tags(s, d):
    t = H.tags(H.tokens(A.html(s, d))).where("not is_text and tag <> ''")
    return t.groupBy("tag", "closing").count().withColumnRenamed("count", "n")


@query
def style_state(s, d):
    return H.styles(H.tags(H.tokens(A.html(s, d)))).select("book_id", "tok_no", "italic", "bold")


@query
def html_pieces(s, d):
    return H.pieces(H.styles(H.tags(H.tokens(A.html(s, d))))).select("book_id", "tok_no", "heading", "text", "bold")


@query
def html_to_paras(s, d):
    return H.paragraphs(A.html(s, d)).select("book_id", "para_no", "heading", T.runs_xhtml(F.col("runs")).alias("runs"))


@query
def merged_runs(s, d):
    w = A.table(s, d, "events").select(F.col("user_id").alias("book_id"), "event_id", F.expr("CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END").alias("text"), (F.col("value") > 60).alias("italic"), (F.col("event_id") % 4 == 0).alias("bold"))
    ordered = F.array_sort(F.collect_list(F.struct("event_id", "text", "italic", "bold")))
    runs = w.groupBy("book_id").agg(F.transform(ordered, lambda r: F.struct(r["text"].alias("text"), r["italic"].alias("italic"), r["bold"].alias("bold"))).alias("runs"))
    return runs.select("book_id", T.runs_xhtml(T.merge_runs(F.col("runs"))).alias("runs"))


@query
def depth_levels(s, d):
    return O.shapes(A.outline(s, d), KEY).select("book_id", "titled.d0", "titled.d1")


@query
def detect_title(s, d):
    return O.shapes(A.outline(s, d), KEY).where("title_no is not null").select("book_id", "book_title")


@query
def part_shaped(s, d):
    return O.shapes(A.outline(s, d), KEY).select("book_id", "titled.part_shaped")


@query
def book_chapters(s, d):
    return O.with_empty_books(chapters(s, d), A.books(s, d))


@query
def chapter_parts(s, d):
    return segmented(s, d).where("is_chapter").select("book_id", "item_no", "part")


@query
def ranged_segments(s, d):
    seg = W.segments(A.outline(s, d), KEY, width=16)
    return seg.where("chapter_no is not null").select("book_id", "item_no", "chapter_no", "part", "demoted")


@query
def ranged_styles(s, d):
    t = H.tags(H.tokens(A.html(s, d)))
    return W.clamped(t, KEY, "tok_no", H.style_steps(), width=8).select("book_id", "tok_no", "italic", "bold")


@query
def demoted_headings(s, d):
    return segmented(s, d).where("demoted").select("book_id", "item_no", T.runs_xhtml(F.col("runs")).alias("runs"))


@query
def part_breaks_epub(s, d):
    return O.part_starts(chapters(s, d)).where("new_part_web").select("book_id", "chapter_no", "part")


def patchy(s, d):
    """Chapters whose part is missing in every third one."""
    return chapters(s, d).withColumn("part", F.when(F.col("chapter_no") % 3 != 1, F.concat(F.lit("Part "), (F.col("chapter_no") / 5).cast("int"))))


@query
def part_breaks_docx(s, d):
    return O.part_starts(patchy(s, d)).where("new_part_print").select("book_id", "chapter_no", "part")


@query
def part_breaks_gaps(s, d):
    return O.part_starts(patchy(s, d)).where("new_part_web").select("book_id", "chapter_no", "part")


@query
def first_paragraphs(s, d):
    _, blocks = built(s, d)
    return O.first_paragraphs(blocks).where("is_first").select("book_id", "chapter_no", "block_no")


@query
def chapter_words(s, d):
    found, blocks = built(s, d)
    return B.chapter_words(found, blocks).select("book_id", "chapter_no", "title", "words")


@query
def book_summary(s, d):
    found, blocks = built(s, d)
    return B.book_words(B.chapter_words(found, blocks)).select("book_id", "words", "about_words", "summary")


@query
def chapter_list(s, d):
    found, blocks = built(s, d)
    return B.chapter_list(B.chapter_words(found, blocks))


@query
def ms_preview(s, d):
    found, blocks = built(s, d)
    return B.manuscript_preview(A.books(s, d), B.book_words(B.chapter_words(found, blocks)), blocks)


@query
def ebook_preview(s, d):
    found, blocks = built(s, d)
    return B.ebook_preview(A.books(s, d), found, blocks)


@query
def chapter_ids(s, d):
    c = chapters(s, d)
    return c.select("book_id", "chapter_no", T.numbered("chapter-", (F.col("chapter_no") + 1) * 37).alias("id"))


@query
def chapter_xhtml(s, d):
    return E.chapter_pages(built(s, d)[1])


@query
def epub_documents(s, d):
    return E.documents(A.books(s, d), chapters(s, d)).select("book_id", "ord", "id", "title", "kind")


@query
def book_identifiers(s, d):
    return E.defaults(A.books(s, d).withColumn("uuid", F.lit(None).cast("string"))).select("book_id", "b_uuid", "b_title", "b_author", "b_language")


@query
def epub_nav(s, d):
    return E.nav(E.documents(A.books(s, d), chapters(s, d)), E.defaults(A.books(s, d)))


@query
def epub_ncx(s, d):
    return E.ncx(E.documents(A.books(s, d), chapters(s, d)), E.defaults(A.books(s, d)))


@query
def epub_opf(s, d):
    return E.package(E.documents(A.books(s, d), chapters(s, d)), E.defaults(A.books(s, d)))


@query
def epub_entries(s, d):
    found, blocks = written(s, d)
    return E.entries(A.books(s, d), found, blocks).select("book_id", "seq", "path", "stored", F.md5("content").alias("digest"))


@query
def docx_layout(s, d):
    found, blocks = written(s, d)
    p = D.paragraphs(A.books(s, d), found, blocks)
    return p.select("book_id", "seq", "role", "align", "page_break_before", T.run_text(F.col("runs")).alias("text"))


@query
def docx_runs(s, d):
    b = built(s, d)[1].where("kind = 'paragraph'")
    return b.select("book_id", "chapter_no", "block_no", D.runs_xml(F.col("runs")).alias("slanted"), D.runs_xml(F.col("runs"), underline_italics=True).alias("underlined"))


@query
def patched_books(s, d):
    b = A.books(s, d)
    change = lambda test, field, value: F.when(F.expr(test), F.struct(F.lit(field).alias("field"), F.expr(value).alias("value")))
    made = F.array(change("book_id % 3 = 1", "title", "'New ' || book_id"), change("book_id % 2 = 0", "email", "''"), change("book_id % 5 = 0", "phone", "'555-0' || book_id"), change("book_id % 7 = 0", "author", "''"))
    changes = b.select("book_id", F.explode(F.filter(made, lambda c: c.isNotNull())).alias("c")).select("book_id", "c.*")
    return B.patch(b, changes).select("book_id", "title", "author", "email", "phone", "address")


@query
def centered_class(s, d):
    h = A.html(s, d).withColumn("html", F.expr("""replace(html, '<p><b>', '<p class="lead is-centered"><b>')"""))
    return H.tags(H.tokens(h)).where("is_center and not closing").select("book_id", "tok_no")


@query
def contact_block(s, d):
    return D.contact_lines(A.books(s, d)).select("book_id", F.array_join("lines", "|").alias("lines"))


@query
def running_header(s, d):
    return D.running_header(A.books(s, d))


@query
def multi_file_chapters(s, d):
    # five users and five names are the files of a book; files without events and users without a name stay
    keys = lambda n: [F.floor(F.col(n) / 5).alias("book_id"), (F.col(n) % 5).cast("int").alias("file_ord")]
    names = A.named_files(s, d).select(*keys("p_partkey"), "file_name")
    o = A.outline(s, d).withColumnRenamed("book_id", "user_id")
    o = o.select(*keys("user_id"), *[c for c in o.columns if c not in ("user_id", "file_ord")])
    users = A.books(s, d).select(*keys("book_id"))
    files = names.join(users, KEY + ["file_ord"], "full").withColumn("file_name", F.coalesce("file_name", F.expr("file_ord || '-part_' || book_id || '.md'")))
    files = files.withColumn("n_files", F.lit(5))
    return B.file_chapters(B.file_segments(o, files), files).drop("seg")


@query
def title_from_filename(s, d):
    f = A.named_files(s, d)
    return f.select("book_id", "file_ord", T.title_from_filename(F.col("file_name")).alias("title"), T.title_from_filename(F.col("file_name"), keep_number=True).alias("docx_title"))


@query
def safe_filename(s, d):
    return A.books(s, d).select("book_id", T.safe_filename(F.col("title"), ".epub").alias("file_name"))


@query
def saved_files(s, d):
    from quire.plans.folders import new_folder
    from quire.sources.files import read_files, save_files

    b = A.books(s, d)
    suffix = F.when(F.col("book_id") % 3 == 0, ".bin").otherwise(".txt")
    lines = F.concat_ws("\n", "title", "author", "address", F.col("book_id").cast("string"))
    target = new_folder(s, "saved")
    save_files(b.select(F.expr("'shelf-' || book_id % 7 || '/' || book_id").alias("folder"), F.concat(T.safe_filename(F.col("title"), ""), suffix).alias("file_name"), lines.cast("binary").alias("data")), target)
    return read_files(s, target, "kind = 'text'").select("folder", "file_name", "size", F.md5("content").alias("digest"))


@query
def escape_xml(s, d):
    return events_text(s, d).select("event_id", T.escape_xml(F.col("s")).alias("s"))


@query
def decode_entities(s, d):
    t = F.expr("s || ' &lt;b&gt; &amp;amp; &quot;x&apos; &nbsp; &#38;lt; &#x' || lower(hex(65 + event_id % 20)) || '; &#' || (97 + event_id % 26) || ';'")
    return events_text(s, d).select("event_id", T.decode_entities(t).alias("s"))


@query
def last_name(s, d):
    return A.table(s, d, "customer").select("c_custkey", T.last_name(F.expr("c_name || ' ' || c_mktsegment || '  '")).alias("name"))


@query
def short_title(s, d):
    return A.table(s, d, "documents").select("doc_id", T.short_title(F.col("text")).alias("title"))


@query
def clip(s, d):
    return A.table(s, d, "documents").select("doc_id", T.clip(F.col("text")).alias("text"))


@query
def finish_book(s, d):
    b = A.books(s, d).withColumn("title", F.nullif("title", F.lit(""))).withColumn("file_name", F.expr("'0' || book_id || ' my-book_' || book_id || '.md'"))
    return B.finish(b).select("book_id", "title", "author")


@query
def front_matter(s, d):
    from quire.sources.markdown import metadata, parse_files

    return metadata(parse_files(A.front_files(s, d))).select("book_id", "title", "author", "legal_name", "email", "language")


@query
def ingest_candidates(s, d):
    from quire.plans.ingest import ingest_text

    return ingest_text(A.files(s, d)).candidates


@query
def read_status(s, d):
    from quire.plans.ingest import ingest_text

    return ingest_text(A.hostile_files(s, d)).status


@query
def changed_books(s, d):
    from quire.plans.incremental import changes, digests

    files = A.files(s, d)
    _, answers = decisions(s, d)
    later = files.where("book_id % 50 <> 7").withColumn("content", F.expr("CASE WHEN book_id % 20 = 9 THEN content || ' more' ELSE content END"))
    other = answers.withColumn("is_title", F.expr("CASE WHEN book_id % 10 = 3 THEN NOT is_title ELSE is_title END"))
    return changes(digests(files, answers), digests(later, other)).select("book_id", F.col("digest").isNull().alias("gone"))


@query
def ingested_books(s, d):
    from quire.plans.ingest import ingest_text

    _, answers = decisions(s, d)
    got = ingest_text(A.files(s, d), answers)
    words = B.book_words(B.chapter_words(got.chapters, got.blocks)).select("book_id", "words", "about_words")
    counted = got.chapters.groupBy("book_id").agg(F.count("*").alias("n_chapters"))
    return got.books.select("book_id", "title").join(counted, "book_id", "left").join(words, "book_id", "left")


@query
def parsed_markdown(s, d):
    from quire.sources.markdown import outline, parse_files

    o = outline(parse_files(A.files(s, d)))
    return o.groupBy("kind", "depth").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("n_chars"))


@query
def packed_epub(s, d):
    found, blocks = written(s, d)
    return E.pack(E.entries(A.books(s, d), found, blocks)).select("book_id", F.length("data").alias("n_bytes"), F.hex(F.substring("data", 31, 28)).alias("head"))


@query
def packed_docx(s, d):
    found, blocks = written(s, d)
    words = B.book_words(B.chapter_words(found, blocks))
    books = A.books(s, d)
    return D.pack(books, D.paragraphs(books, found, blocks), words).select("book_id", "file_name", F.length("data").alias("n_bytes"))


@query
def docx_round_trip(s, d):
    from quire.sources.docx import parse_docx

    found, blocks = written(s, d)
    books = A.books(s, d)
    files = D.pack(books, D.paragraphs(books, found, blocks), B.book_words(B.chapter_words(found, blocks)))
    return parse_docx(files.select("book_id", F.col("data").alias("content"))).select("book_id", "para_no", "centered", T.runs_xhtml(F.col("runs")).alias("runs"))
