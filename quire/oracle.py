"""The queries in DuckDB's SQL, written apart from the DataFrame code: grouped joins where that has
windows, lists where that has explodes."""

from __future__ import annotations

import re

from quire.adapters import ACTION, FRONT, LINE, NAMED_BOOK, SHARED, SPOKEN_LINE, VARIED

#: Fixed values, written again here so that a slip in the engine's lists shows.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred"
).split()
NAMED_SECTIONS = "prologue epilogue interlude foreword preface afterword coda".split()

WS = r"\t\n\x0B\f\r \x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
NL = "chr(10)"
ORACLE_SQL: dict[str, str] = {}


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def words(x: str) -> str:
    return f"(CASE WHEN {trim(x)} = '' THEN 0 ELSE len(regexp_split_to_array({trim(x)}, '[{WS}]+')) END)::BIGINT"


def about(n: str) -> str:
    step = f"(CASE WHEN {n} >= 40000 THEN 1000 ELSE 100 END)"
    return f"greatest({step}, round({n} / {step}) * {step})::BIGINT"


def utf16(x: str) -> str:
    return rf"(length({x}) + length(regexp_replace({x}, '[^\x{{10000}}-\x{{10FFFF}}]', '', 'g')))"


def scene(x: str) -> str:
    return rf"regexp_full_match({x}, '[{WS}]*(#|\*[{WS}]*\*[{WS}]*\*|~+|·+)[{WS}]*')"


def title_shaped(x: str) -> str:
    return rf"({utf16(x)} BETWEEN 1 AND 60 AND regexp_matches({x}, '[\p{{L}}\p{{N}}]') AND NOT {scene(x)})"


def weight(x: str) -> str:
    lead = rf"regexp_extract({x}, '^[\t ]*')"
    return f"(length({lead}) + 3 * (length({lead}) - length(replace({lead}, chr(9), ''))))"


def clip(x: str) -> str:
    return f"(CASE WHEN {utf16(x)} > 140 THEN left({x}, 139) || '…' ELSE {x} END)"


def esc(x: str) -> str:
    x = rf"regexp_replace({x}, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')"
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


def chapter_line(x: str) -> str:
    """RE2 has no lookahead: the roman numeral may match nothing, which the second test rules out."""
    w = "|".join(NUMBER_WORDS)
    roman = "m{0,3}(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})"
    sub = rf"([{WS}]*[—–:.-][{WS}]*[A-Za-z0-9_][A-Za-z0-9_{WS}.,:''’-]{{0,38}})?"
    t = f"regexp_replace({trim(x)}, '[{WS}.!?:]+$', '')"
    whole = rf"(?i)((chapter|part|book)[{WS}]+([0-9]{{1,4}}|{roman}|({w})([-{WS}]({w}))*)|{'|'.join(NAMED_SECTIONS)}){sub}"
    return rf"({utf16(t)} <= 48 AND regexp_full_match({t}, '{whole}') AND NOT regexp_matches({t}, '(?i)^(chapter|part|book)[{WS}]+([—–:.-]|$)'))"


LINE_SQL = re.sub(r"\bn\b", "(i - 1)", re.sub(r"\bd\b", "doc_id", LINE))
FILES = f"""files AS (SELECT doc_id AS book_id, 'book-' || doc_id || '.md' AS file_name,
 CASE WHEN doc_id % 3 = 0 THEN '---' || {NL} || 'title: x' || {NL} || '---' || {NL} ELSE '' END ||
 array_to_string(list_transform(string_split(text, {NL}), lambda x, i: {LINE_SQL}), {NL} || {NL}) AS content FROM documents)"""
LINES = f"{FILES}, lines AS (SELECT book_id, unnest(range(len(l)))::BIGINT AS line_no, unnest(l) AS line FROM (SELECT book_id, string_split(content, {NL}) AS l FROM files))"
ATX = rf"nullif(length(regexp_extract(line, '^ {{0,3}}(#{{1,6}})[{WS}]+[^{WS}]', 1)), 0)"
CENTERED_ALL = f"""{LINES}, trimmed AS (SELECT *, {trim('line')} AS text FROM lines),
 around AS (SELECT *, lag(text, 1, '') OVER w AS prev, lead(text, 1, '') OVER w AS next FROM trimmed WINDOW w AS (PARTITION BY book_id ORDER BY line_no)),
 alone AS (SELECT book_id, line_no AS idx, text FROM around WHERE {weight('line')} >= 8 AND {title_shaped('text')} AND prev = '' AND next = ''),
 filled AS (SELECT book_id, line_no, text FROM trimmed WHERE text <> ''),
 before AS (SELECT a.book_id, a.idx, f.text FROM alone a ASOF JOIN filled f ON a.book_id = f.book_id AND a.idx > f.line_no),
 after AS (SELECT a.book_id, a.idx, f.text FROM alone a ASOF JOIN filled f ON a.book_id = f.book_id AND a.idx < f.line_no),
 everything AS (SELECT a.book_id, a.idx, a.text, {clip('b.text')} AS before, {clip('c.text')} AS after FROM alone a LEFT JOIN before b USING (book_id, idx) LEFT JOIN after c USING (book_id, idx)),
 found AS (SELECT e.* FROM everything e JOIN (SELECT book_id, count(*) AS n FROM everything GROUP BY 1) g USING (book_id) JOIN (SELECT book_id, count(*) AS pop FROM filled GROUP BY 1) p USING (book_id) WHERE NOT (n > 20 AND n * 5 > pop))"""
DECIDED = f"{CENTERED_ALL}, asked AS (SELECT f.*, 'book-' || book_id || '.md:' || idx AS id, CASE WHEN (book_id + idx) % 3 <> 0 THEN (book_id + idx) % 3 = 1 END AS is_title FROM found f)"
OPENS = f"""content_start AS (SELECT t.book_id, CASE WHEN t.text = '---' THEN (SELECT min(u.line_no) FROM trimmed u WHERE u.book_id = t.book_id AND u.text = '---' AND u.line_no > t.line_no) ELSE t.line_no - 1 END AS fence
   FROM trimmed t JOIN (SELECT book_id, min(line_no) AS line_no FROM filled GROUP BY 1) s USING (book_id, line_no)),
 first_line AS (SELECT f.book_id, min(f.line_no) AS line_no FROM filled f JOIN content_start c ON c.book_id = f.book_id AND f.line_no > c.fence GROUP BY 1),
 opens AS (SELECT b.book_id, coalesce({ATX} IS NOT NULL, false) AS opens FROM (SELECT book_id FROM files) b LEFT JOIN first_line USING (book_id) LEFT JOIN lines USING (book_id, line_no))"""
DEPTHS = f"""heads AS (SELECT book_id, line_no, {ATX} AS depth FROM lines WHERE {ATX} IS NOT NULL),
 depths AS (SELECT o.book_id, (CASE WHEN low IS NULL THEN 1 WHEN opens AND first = low AND n_low = 1 THEN least(low + 1, 6) ELSE low END)::BIGINT AS depth
   FROM opens o LEFT JOIN (SELECT h.book_id, min(low) AS low, min_by(h.depth, h.line_no) AS first, count(*) FILTER (h.depth = low) AS n_low FROM heads h JOIN (SELECT book_id, min(depth) AS low FROM heads GROUP BY 1) m USING (book_id) GROUP BY 1) s USING (book_id))"""

OUTLINE = """numbered AS (SELECT user_id AS book_id, event_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS item_no FROM events),
 ev AS (SELECT *, CASE WHEN book_id % 3 = 0 AND item_no = 0 OR event_type = 'signup' AND value < 10 THEN 1 WHEN event_type = 'purchase' THEN 2 END AS depth FROM numbered),
 outline AS (SELECT book_id, item_no, depth, event_id, CASE WHEN depth IS NOT NULL THEN 'heading' WHEN event_type = 'error' THEN 'scene-break' ELSE 'paragraph' END AS kind, event_type || ' ' || event_id || ' & <' || value || '>' AS text
   FROM ev)"""
TITLES = f"""{OUTLINE}, sizes AS (SELECT book_id, min(depth) AS low, count(depth) AS n_head, min(item_no) AS first_no FROM outline GROUP BY 1),
 lows AS (SELECT o.book_id, count(*) AS n_low FROM outline o JOIN sizes s ON o.book_id = s.book_id AND o.depth = s.low GROUP BY 1),
 titles AS (SELECT o.book_id, o.item_no, o.text AS book_title FROM outline o JOIN sizes s USING (book_id) JOIN lows USING (book_id) WHERE item_no = first_no AND depth = low AND n_head >= 2 AND n_low = 1),
 rest AS (SELECT * FROM outline o ANTI JOIN titles t ON o.book_id = t.book_id AND o.item_no = t.item_no)"""
LEVELS = f"""{TITLES}, first_level AS (SELECT book_id, min(depth) AS d0 FROM rest GROUP BY 1),
 levels AS (SELECT f.book_id, d0, (SELECT min(depth) FROM rest r WHERE r.book_id = f.book_id AND r.depth > d0) AS d1 FROM first_level f),
 sections AS (SELECT r.book_id, r.depth, d0, d1, count(*) FILTER (depth = d0) OVER (PARTITION BY r.book_id ORDER BY item_no) AS sec FROM rest r JOIN levels USING (book_id)),
 in_section AS (SELECT book_id, sec, count(*) FILTER (depth = d1) AS n FROM sections WHERE sec >= 1 GROUP BY 1, 2),
 shapes AS (SELECT l.book_id, d0, d1, coalesce((d1 IS NOT NULL) AND count(sec) >= 2 AND min(n) >= 1 AND max(n) >= 2, false) AS part_shaped FROM levels l LEFT JOIN in_section USING (book_id) GROUP BY l.book_id, d0, d1)"""
SEGMENTS = f"""{LEVELS}, roles AS (SELECT r.*, coalesce(part_shaped AND depth = d0, false) AS is_part, coalesce(depth = CASE WHEN part_shaped THEN d1 ELSE d0 END, false) AS is_chapter FROM rest r JOIN shapes USING (book_id)),
 segs AS (SELECT *, count(*) FILTER (is_part OR is_chapter) OVER w AS seg, last_value(CASE WHEN is_part THEN text END IGNORE NULLS) OVER w AS part FROM roles WINDOW w AS (PARTITION BY book_id ORDER BY item_no ROWS UNBOUNDED PRECEDING)),
 kept AS (SELECT book_id, seg, coalesce(max(CASE WHEN is_chapter THEN text END), '') AS title, max(part) AS part, count(*) FILTER (NOT is_part AND NOT is_chapter) AS n_blocks FROM segs GROUP BY 1, 2 HAVING title <> '' OR n_blocks > 0),
 chapters AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY seg) - 1 AS chapter_no FROM kept)"""
RUN_TEXT = f"(CASE WHEN event_id % 5 = 0 THEN '<em>' ELSE '' END || CASE WHEN event_id % 7 = 0 THEN '<strong>' ELSE '' END || {esc('s.text')} || CASE WHEN event_id % 7 = 0 THEN '</strong>' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '</em>' ELSE '' END || ' end')"
BLOCKS = f"""{SEGMENTS}, blocks AS (SELECT s.book_id, chapter_no, row_number() OVER (PARTITION BY s.book_id, seg ORDER BY item_no) - 1 AS block_no, CASE WHEN kind = 'heading' THEN 'paragraph' ELSE kind END AS kind,
   CASE kind WHEN 'heading' THEN s.text WHEN 'paragraph' THEN s.text || ' end' END AS plain, CASE kind WHEN 'heading' THEN '<strong>' || {esc('s.text')} || '</strong>' WHEN 'paragraph' THEN {RUN_TEXT} END AS styled
   FROM segs s JOIN chapters c USING (book_id, seg) WHERE NOT is_part AND NOT is_chapter)"""
COUNTED = f"{BLOCKS}, counted AS (SELECT c.book_id, chapter_no, title, part, coalesce(w, 0)::BIGINT AS words FROM chapters c LEFT JOIN (SELECT book_id, chapter_no, sum({words('plain')}) AS w FROM blocks WHERE kind = 'paragraph' GROUP BY 1, 2) USING (book_id, chapter_no))"
BOOKS = f"books AS (SELECT book_id, {', '.join(f'{v} AS {k}' for k, v in SHARED.items())} FROM (SELECT DISTINCT user_id AS book_id FROM events))"
FALLBACK = "coalesce(nullif(title, ''), 'Untitled')"
PARTED = "starts AS (SELECT *, coalesce(part, '') <> '' AND part IS DISTINCT FROM lag(part) OVER (PARTITION BY book_id ORDER BY chapter_no) AS new_part FROM chapters)"
DOCS = f"""{BLOCKS}, {BOOKS}, {PARTED}, counted_parts AS (SELECT s.*, count(*) FILTER (new_part) OVER (PARTITION BY book_id ORDER BY chapter_no) AS part_no, count(*) OVER (PARTITION BY book_id) AS n FROM starts s),
 both_kinds AS (SELECT book_id, chapter_no, 0 AS k, 'part-' || CASE WHEN part_no < 1000 THEN lpad(part_no::VARCHAR, 3, '0') ELSE part_no::VARCHAR END AS id, part AS title, 'part' AS kind, false AS nested FROM counted_parts WHERE new_part
   UNION ALL SELECT c.book_id, chapter_no, 1, 'chapter-' || CASE WHEN chapter_no < 999 THEN lpad((chapter_no + 1)::VARCHAR, 3, '0') ELSE (chapter_no + 1)::VARCHAR END, coalesce(nullif(c.title, ''), CASE WHEN n > 1 THEN 'Chapter ' || (chapter_no + 1) ELSE {FALLBACK.replace('title', 'b.title')} END), 'chapter', coalesce(part, '') <> '' FROM counted_parts c JOIN books b USING (book_id)),
 docs AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no, k) - 1 AS ord FROM both_kinds)"""
SHOWN = f"shown AS (SELECT book_id, {FALLBACK} AS b_title, coalesce(nullif(author, ''), 'Anonymous') AS b_author, coalesce(nullif(language, ''), 'en') AS b_language, uuid AS b_uuid, modified AS b_modified, cover AS b_cover FROM books)"
XML = '<?xml version="1.0" encoding="UTF-8"?>\n'

SPOKEN = f"""sl AS (SELECT conv_id, turn, conv_id // 4 AS book_id, 0 AS k, {SPOKEN_LINE} AS raw FROM conversations UNION ALL SELECT conv_id, turn, conv_id // 4, 1, text FROM conversations),
 sp AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY conv_id, turn, k) - 1 AS para_no, CASE WHEN book_id % 2 = 1 AND turn = 0 AND k = 1 AND conv_id % 5 = 0 THEN 1 + conv_id % 2 END AS heading, conv_id % 6 = 0 AND turn = 3 AS centered, raw FROM sl WHERE k = 1 OR raw IS NOT NULL)"""
PARAS = f"{SPOKEN}, spt AS (SELECT *, {trim('raw')} AS text FROM sp)"
PARA_FOUND = f"""{PARAS}, spx AS (SELECT *, lag(text) OVER w AS b, lead(text) OVER w AS a, count(*) OVER (PARTITION BY book_id) AS pop FROM spt WINDOW w AS (PARTITION BY book_id ORDER BY para_no)),
 hits AS (SELECT *, count(*) OVER (PARTITION BY book_id) AS n FROM spx WHERE heading IS NULL AND (({weight('raw')} >= 8 AND {title_shaped('text')}) OR (centered AND {title_shaped('text')}))),
 found AS (SELECT book_id, para_no AS idx, text, {clip('b')} AS before, {clip('a')} AS after FROM hits WHERE NOT (n > 20 AND n * 5 > pop))"""
_L = r"(CASE WHEN regexp_replace(substring(raw, 4), '[\t ]+', '', 'g') = '' THEN regexp_replace(regexp_replace(left(raw, 3), '^[\t ]+', ''), '[\t ]+$', '') ELSE regexp_replace(left(raw, 3), '^[\t ]+', '') END)"
_R = r"(CASE WHEN regexp_replace(left(raw, 3), '[\t ]+', '', 'g') = '' THEN regexp_replace(regexp_replace(substring(raw, 4), '^[\t ]+', ''), '[\t ]+$', '') ELSE regexp_replace(substring(raw, 4), '[\t ]+$', '') END)"
EDGED = rf"CASE WHEN regexp_replace(raw, '[\t ]+', '', 'g') = '' THEN '' ELSE (CASE WHEN {_L} <> '' THEN '<em>' || {esc(_L)} || '</em>' ELSE '' END) || {esc(_R)} END"
PARA_DEPTHS = """tops AS (SELECT book_id, min(heading) AS low, min_by(heading, para_no) FILTER (heading IS NOT NULL) AS first, min_by(heading IS NOT NULL, para_no) AS opens FROM spt GROUP BY 1),
 depths AS (SELECT book_id, CASE WHEN low IS NULL THEN 1 WHEN opens AND first = low AND (SELECT count(*) FROM spt s WHERE s.book_id = t.book_id AND s.heading = t.low) = 1 THEN least(low + 1, 6) ELSE low END AS depth FROM tops t)"""

TOKENS = r"toks AS (SELECT page_id AS book_id, unnest(range(len(l)))::BIGINT AS tok_no, unnest(l) AS token FROM (SELECT page_id, string_split(regexp_replace(html, '(<[^>]+>)', chr(1) || '\1' || chr(1), 'g'), chr(1)) AS l FROM pages)), tokens AS (SELECT * FROM toks WHERE token <> '')"
TAGS = rf"{TOKENS}, tags AS (SELECT *, NOT starts_with(token, '<') AS is_text, lower(regexp_extract(token, '^<[{WS}]*(/?)[{WS}]*([a-zA-Z0-9]+)', 2)) AS tag, regexp_extract(token, '^<[{WS}]*(/?)[{WS}]*([a-zA-Z0-9]+)', 1) = '/' AS closing FROM tokens)"


def counter(name: str, kinds: str) -> str:
    return f"sum(CASE WHEN NOT is_text AND tag IN ({kinds}) THEN CASE WHEN closing THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY book_id ORDER BY tok_no) AS {name}"


def clamped(name: str) -> str:
    return f"({name} - least(0, min({name}) OVER (PARTITION BY book_id ORDER BY tok_no)))::BIGINT"


STYLED = f"{TAGS}, sums AS (SELECT *, {counter('si', repr('em') + ', ' + repr('i'))}, {counter('sb', repr('strong') + ', ' + repr('b'))} FROM tags), styled AS (SELECT *, {clamped('si')} AS italic, {clamped('sb')} AS bold FROM sums)"
DECODED = "token"
for _a, _b in (("&quot;", '"'), ("&apos;", "''"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
    DECODED = f"replace({DECODED}, '{_a}', '{_b}')"
PIECES = rf"""{STYLED}, edges AS (SELECT *, NOT is_text AND (tag IN ('p', 'li') OR regexp_full_match(tag, 'h[1-6]')) AS edge FROM styled),
 segsx AS (SELECT *, count(*) FILTER (edge) OVER (PARTITION BY book_id ORDER BY tok_no) AS seg FROM edges),
 starts AS (SELECT book_id, seg, CASE WHEN starts_with(tag, 'h') THEN substring(tag, 2, 1)::BIGINT END AS heading FROM segsx WHERE edge AND NOT closing),
 pieces AS (SELECT book_id, seg, tok_no, heading, CASE WHEN is_text THEN {DECODED} WHEN tag = 'br' THEN ' ' END AS text, italic > 0 AS italic, bold > 0 AS bold FROM segsx JOIN starts USING (book_id, seg))"""
MERGED = f"""changes AS (SELECT *, CASE WHEN italic IS NOT DISTINCT FROM lag(italic) OVER w AND bold IS NOT DISTINCT FROM lag(bold) OVER w THEN 0 ELSE 1 END AS c FROM src WINDOW w AS (PARTITION BY grp ORDER BY o)),
 islands AS (SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY o) AS g FROM changes),
 runs AS (SELECT grp, g, italic, bold, string_agg(text, '' ORDER BY o) AS t FROM islands GROUP BY ALL),
 merged AS (SELECT grp, string_agg(CASE WHEN italic THEN '<em>' ELSE '' END || CASE WHEN bold THEN '<strong>' ELSE '' END || {esc('t')} || CASE WHEN bold THEN '</strong>' ELSE '' END || CASE WHEN italic THEN '</em>' ELSE '' END, '' ORDER BY g) AS runs, string_agg(t, '' ORDER BY g) AS raw FROM runs WHERE t <> '' GROUP BY 1)"""
NAME_SQL = "p_partkey % 113 || CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '_' END || replace(p_name, ' ', '_') || CASE p_partkey % 11 WHEN 0 THEN '.docx' WHEN 1 THEN '.TXT' WHEN 2 THEN '.pdf' WHEN 3 THEN '.markdown' ELSE '.md' END"
NAMES = f"names AS (SELECT {NAMED_BOOK} AS book_id, row_number() OVER (PARTITION BY {NAMED_BOOK} ORDER BY p_partkey) - 1 AS file_ord, {NAME_SQL} AS file_name, p_partkey FROM part)"
ROUTED = rf"{NAMES}, routed AS (SELECT *, CASE WHEN regexp_matches(file_name, '(?i)\.(md|markdown|mdown|txt)$') THEN 'text' WHEN regexp_matches(file_name, '(?i)\.docx$') THEN 'docx' ELSE 'other' END AS route FROM names)"


def link(x: str = "") -> str:
    return f"'<a href=\"text/' || id || '.xhtml\">' || {esc('title')} || '</a>'"


def if_cover(line: str) -> str:
    return f"CASE WHEN b_cover IS NULL THEN '' ELSE '{line}' || chr(10) END"


def add(name: str, ctes: str, select: str) -> None:
    ORACLE_SQL[name] = f"WITH {ctes} {select}" if ctes else select


add("manuscript_words", "", f"SELECT doc_id, {words('text')} AS words, {about(words('text'))} AS about_words FROM documents")
add("source_words", f"c AS (SELECT source, lang, sum({words('text')})::BIGINT AS words FROM documents GROUP BY 1, 2)", f"SELECT *, {about('words')} AS about_words FROM c")
add("lines", LINES, "SELECT * FROM lines")
add("route_files", ROUTED, "SELECT book_id, file_ord, file_name, route FROM routed")
add("ingest_status", ROUTED, "SELECT book_id, CASE WHEN count(*) FILTER (route = 'text') > 0 AND count(*) FILTER (route = 'docx') > 0 THEN 'mixed' WHEN count(*) FILTER (route = 'docx') > 1 THEN 'multi_docx' WHEN count(*) FILTER (route <> 'other') = 0 THEN 'unsupported' ELSE 'ok' END AS status FROM routed GROUP BY 1")
add("read_status", "", "SELECT doc_id AS book_id, CASE WHEN doc_id % 13 = 0 THEN 'unsupported' WHEN doc_id % 11 = 0 THEN 'unreadable' ELSE 'ok' END AS status FROM documents")
_RUNS = "regexp_extract_all(file_name, '[0-9]+|[^0-9]+')"
_PADDED = f"array_to_string(list_transform({_RUNS}, lambda r: CASE WHEN regexp_full_match(r, '[0-9]+') THEN lpad(regexp_replace(r, '^0+(.)', '\\1'), 40, '0') ELSE r END), '')"
add("natural_sort", f"{NAMES}, varied AS (SELECT book_id, file_ord, {VARIED} AS file_name FROM names)", f"SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY {_PADDED} COLLATE en, file_ord) - 1 AS file_ord, file_name FROM varied")
add("neutralize_tildes", FILES, r"SELECT book_id, regexp_replace(content, '(?m)^[ \t]{0,3}~{3,}[ \t]*$', '* * *', 'g') AS content FROM files")
add("scene_breaks", LINES, f"SELECT book_id, line_no FROM lines WHERE {scene('line')}")
add("centered_shaped", LINES, f"SELECT book_id, line_no, {weight('line')} AS weight FROM lines WHERE {weight('line')} >= 8 AND {title_shaped(trim('line'))}")
add("atx_headings", LINES, f"SELECT book_id, line_no, {ATX} AS depth FROM lines WHERE {ATX} IS NOT NULL")
add("heading_depths", LINES, f"SELECT book_id, string_agg(({ATX})::VARCHAR, ',' ORDER BY line_no) AS depths FROM lines WHERE {ATX} IS NOT NULL GROUP BY 1")
add("first_content_heading", f"{CENTERED_ALL}, {OPENS}", "SELECT * FROM opens")
add("promotion_depth", f"{CENTERED_ALL}, {OPENS}, {DEPTHS}", "SELECT * FROM depths")
add("standalone_centered", CENTERED_ALL, "SELECT * FROM everything")
add("centered_lines", CENTERED_ALL, "SELECT * FROM found")
add("candidate_decisions", DECIDED, "SELECT book_id, id, text, is_title FROM asked")
ORACLE_SQL["stored_decisions"] = ORACLE_SQL["candidate_decisions"]
add("bulk_decisions", DECIDED, "SELECT book_id, id, coalesce(is_title, CASE WHEN idx >= (SELECT min(b.idx) FROM asked b WHERE b.book_id = a.book_id AND b.is_title IS NULL) THEN false END) AS is_title FROM asked a")
add(
    "answer_log",
    f"""RECURSIVE asked AS (SELECT user_id AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS place, 'e:' || event_id AS id, count(*) OVER (PARTITION BY user_id) AS n FROM events WHERE event_type = 'purchase' AND value > 20),
 log AS (SELECT user_id AS book_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {ACTION} AS action FROM events WHERE {ACTION} <> 'pause'),
 walk AS (SELECT book_id, n, 0 AS k, 0 AS pos, false AS over, NULL::BIGINT AS lo, NULL::BIGINT AS hi, NULL::BOOLEAN AS yes FROM (SELECT DISTINCT book_id, n FROM asked)
   UNION ALL SELECT w.book_id, n, w.k + 1, CASE action WHEN 'back' THEN greatest(pos - 1, 0) ELSE pos + 1 END, action IN ('all', 'none') OR action <> 'back' AND pos + 1 = n, CASE WHEN action <> 'back' THEN pos END, CASE WHEN action IN ('all', 'none') THEN n - 1 WHEN action <> 'back' THEN pos END, action IN ('yes', 'all')
   FROM walk w JOIN log l ON l.book_id = w.book_id AND l.k = w.k + 1 WHERE NOT over)""",
    "SELECT a.book_id, a.place, a.id, (SELECT arg_max(w.yes, w.k) FROM walk w WHERE w.book_id = a.book_id AND a.place BETWEEN w.lo AND w.hi) AS is_title, (SELECT bool_or(w.over) FROM walk w WHERE w.book_id = a.book_id) AS finished FROM asked a",
)
add("changed_books", DECIDED, "SELECT book_id, book_id % 50 = 7 AS gone FROM files WHERE book_id % 50 = 7 OR book_id % 20 = 9 OR book_id % 10 = 3 AND book_id IN (SELECT book_id FROM asked WHERE is_title IS NOT NULL)")
add("apply_decisions_text", f"{DECIDED}, {OPENS}, {DEPTHS}", f"SELECT l.book_id, string_agg(CASE WHEN is_title IS NULL THEN line WHEN is_title THEN repeat('#', depth) || ' ' || {trim('line')} ELSE {trim('line')} END, {NL} ORDER BY line_no) AS content FROM lines l JOIN depths USING (book_id) LEFT JOIN asked a ON a.book_id = l.book_id AND a.idx = l.line_no GROUP BY 1")
ORACLE_SQL["joined_decisions_text"] = ORACLE_SQL["apply_decisions_text"]
add("centered_paras", PARA_FOUND, "SELECT * FROM found")
add("plausible_candidates", "e AS (SELECT user_id AS book_id, event_id, event_type IN ('signup', 'error') AND value < 60 + user_id % 40 AS hit FROM events), g AS (SELECT book_id, count(*) FILTER (hit) AS n, count(*) AS pop FROM e GROUP BY 1)", "SELECT book_id, event_id FROM e JOIN g USING (book_id) WHERE hit AND NOT (n > 20 AND n * 5 > pop)")
add("apply_decisions_paras", f"{PARA_FOUND}, {PARA_DEPTHS}, asked AS (SELECT book_id, idx AS para_no, (book_id + idx) % 3 = 1 AS is_title FROM found WHERE (book_id + idx) % 3 <> 0)", f"SELECT s.book_id, s.para_no, CASE WHEN heading IS NULL AND is_title THEN depth ELSE heading END AS heading, CASE WHEN heading IS NULL AND is_title THEN {esc('text')} WHEN heading IS NULL AND is_title IS NOT NULL THEN {EDGED} ELSE '<em>' || {esc('left(raw, 3)')} || '</em>' || {esc('substring(raw, 4)')} END AS runs FROM spt s JOIN depths USING (book_id) LEFT JOIN asked USING (book_id, para_no)")
add("trim_edges", SPOKEN, f"SELECT book_id, para_no, {EDGED} AS runs FROM (SELECT book_id, para_no, raw FROM sp)")
add("chapter_lines", PARAS, f"SELECT book_id, para_no, text AS title FROM spt WHERE {chapter_line('raw')}")
add("para_outline", PARAS, f"SELECT book_id, para_no AS item_no, CASE WHEN {scene('raw')} THEN 'scene-break' WHEN heading IS NOT NULL THEN 'heading' ELSE 'paragraph' END AS kind, CASE WHEN NOT {scene('raw')} THEN heading END AS depth, CASE WHEN NOT {scene('raw')} AND heading IS NOT NULL THEN text ELSE raw END AS text FROM spt WHERE {scene('raw')} OR text <> ''")
add("any_heading", SPOKEN, "SELECT book_id, bool_or(heading IS NOT NULL) AS has_heading FROM sp GROUP BY 1")
add("line_chapters", f"{PARAS}, marked AS (SELECT *, {chapter_line('raw')} AS is_head FROM spt WHERE {chapter_line('raw')} OR {scene('raw')} OR text <> ''), cut AS (SELECT *, count(*) FILTER (is_head) OVER (PARTITION BY book_id ORDER BY para_no) AS seg FROM marked), ch AS (SELECT book_id, seg, coalesce(max(CASE WHEN is_head THEN text END), '') AS title, count(*) FILTER (NOT is_head) AS n_blocks FROM cut GROUP BY 1, 2)", "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY seg) - 1 AS chapter_no, title, n_blocks FROM ch")
add("block_text", SPOKEN, "SELECT book_id, para_no, raw AS text FROM sp")
add("html_tokens", TOKENS, "SELECT * FROM tokens")
add("html_tags", TAGS, "SELECT tag, closing, count(*) AS n FROM tags WHERE NOT is_text AND tag <> '' GROUP BY 1, 2")
add("style_state", STYLED, "SELECT book_id, tok_no, italic, bold FROM styled")
add("html_pieces", PIECES, "SELECT book_id, tok_no, heading, text, bold FROM pieces WHERE text <> ''")
add("html_to_paras", f"{PIECES}, src AS (SELECT {{'b': book_id, 's': seg}} AS grp, tok_no AS o, text, italic, bold FROM pieces WHERE text <> ''), {MERGED}, kept_p AS (SELECT grp.b AS book_id, grp.s AS seg, runs FROM merged WHERE {trim('raw')} <> '')", "SELECT k.book_id, row_number() OVER (PARTITION BY k.book_id ORDER BY k.seg) - 1 AS para_no, heading, runs FROM kept_p k JOIN starts USING (book_id, seg)")
add("merged_runs", f"src AS (SELECT user_id AS grp, event_id AS o, CASE WHEN event_id % 6 = 0 THEN '' ELSE event_type END AS text, value > 60 AS italic, event_id % 4 = 0 AS bold FROM events), {MERGED}", "SELECT u.book_id, coalesce(runs, '') AS runs FROM (SELECT DISTINCT user_id AS book_id FROM events) u LEFT JOIN merged ON grp = u.book_id")
add("depth_levels", LEVELS, "SELECT o.book_id, d0::BIGINT AS d0, d1::BIGINT AS d1 FROM (SELECT DISTINCT book_id FROM outline) o LEFT JOIN levels USING (book_id)")
add("detect_title", TITLES, "SELECT book_id, book_title FROM titles")
add("part_shaped", LEVELS, "SELECT book_id, part_shaped FROM shapes")
add("book_chapters", f"{SEGMENTS}, {BOOKS}", "SELECT b.book_id, coalesce(chapter_no, 0) AS chapter_no, coalesce(c.title, '') AS title, part, coalesce(n_blocks, 0) AS n_blocks FROM books b LEFT JOIN chapters c USING (book_id)")
add("chapter_parts", SEGMENTS, "SELECT book_id, item_no, part FROM segs WHERE is_chapter")
add("ranged_segments", SEGMENTS, "SELECT s.book_id, item_no, chapter_no, s.part, kind = 'heading' AND NOT is_chapter AS demoted FROM segs s JOIN chapters c USING (book_id, seg) WHERE NOT is_part")
ORACLE_SQL["ranged_styles"] = ORACLE_SQL["style_state"]
add("demoted_headings", SEGMENTS, f"SELECT book_id, item_no, '<strong>' || {esc('text')} || '</strong>' AS runs FROM segs WHERE kind = 'heading' AND NOT is_part AND NOT is_chapter")
add("part_breaks_epub", f"{SEGMENTS}, {PARTED}", "SELECT book_id, chapter_no, part FROM starts WHERE new_part")
GAPS = f"{SEGMENTS.replace('chapters AS (SELECT *,', 'whole AS (SELECT *,')}, chapters AS (SELECT book_id, chapter_no, CASE WHEN chapter_no % 3 <> 1 THEN 'Part ' || (chapter_no // 5) END AS part FROM whole)"
add("part_breaks_gaps", f"{GAPS}, {PARTED}", "SELECT book_id, chapter_no, part FROM starts WHERE new_part")
add("part_breaks_docx", GAPS, "SELECT book_id, chapter_no, part FROM (SELECT *, lag(part) OVER (PARTITION BY book_id ORDER BY chapter_no) AS last FROM chapters WHERE part <> '') WHERE part IS DISTINCT FROM last")
FIRST = "firsts AS (SELECT *, kind = 'paragraph' AND coalesce(lag(kind) OVER (PARTITION BY book_id, chapter_no ORDER BY block_no) = 'scene-break', true) AS is_first FROM blocks)"
add("first_paragraphs", f"{BLOCKS}, {FIRST}", "SELECT book_id, chapter_no, block_no FROM firsts WHERE is_first")
add("chapter_words", COUNTED, "SELECT book_id, chapter_no, title, words FROM counted")
ABOUT_TEXT = "'about ' || format('{:,}', about_words) || ' words'"
add("book_summary", f"{COUNTED}, g AS (SELECT book_id, sum(words)::BIGINT AS words, count(*) AS n FROM counted GROUP BY 1), a AS (SELECT *, {about('words')} AS about_words FROM g)", f"SELECT book_id, words, about_words, CASE WHEN n > 1 THEN format('{{:,}}', n) || ' chapters, ' ELSE '' END || {ABOUT_TEXT} AS summary FROM a")
add("chapter_list", f"{COUNTED}, {PARTED}, r AS (SELECT book_id, chapter_no, 0 AS k, 'part' AS kind, part AS label, NULL::BIGINT AS words FROM starts WHERE new_part UNION ALL SELECT book_id, chapter_no, 1, 'chapter', coalesce(nullif(title, ''), 'Chapter ' || (chapter_no + 1)), words FROM counted)", "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_no, k) - 1 AS seq, kind, label, words FROM r")
_OPENING = "opening AS (SELECT * FROM (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY block_no) AS o, plain, styled FROM blocks WHERE chapter_no = 0 AND kind = 'paragraph'))"
_PREVIEW = "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY o) - 1 AS seq, role, text FROM l WHERE text IS NOT NULL"
add("ms_preview", f"""{COUNTED}, {BOOKS}, {_OPENING}, g AS (SELECT book_id, sum(words)::BIGINT AS words FROM counted GROUP BY 1), a AS (SELECT b.*, {about('coalesce(words, 0)')} AS about_words FROM books b LEFT JOIN g USING (book_id)),
 l AS (SELECT book_id, -5 AS o, 'contact' AS role, coalesce(nullif(legal_name, ''), nullif(author, ''), 'Your Name') AS text FROM a UNION ALL SELECT book_id, -4, 'email', nullif(email, '') FROM a UNION ALL SELECT book_id, -3, 'count', {ABOUT_TEXT} FROM a
   UNION ALL SELECT book_id, -2, 'title', {FALLBACK} FROM a UNION ALL SELECT book_id, -1, 'byline', 'by ' || coalesce(nullif(author, ''), 'Anonymous') FROM a UNION ALL SELECT book_id, o, 'paragraph', plain FROM opening WHERE o <= 2)""", _PREVIEW)
add("ebook_preview", f"""{BLOCKS}, {BOOKS}, {_OPENING}, l AS (SELECT c.book_id, -1 AS o, 'title' AS role, coalesce(nullif(c.title, ''), nullif(b.title, ''), 'Chapter One') AS text FROM chapters c JOIN books b USING (book_id) WHERE chapter_no = 0
   UNION ALL SELECT book_id, o, CASE WHEN o = 1 THEN 'first' ELSE 'paragraph' END, styled FROM opening WHERE o <= 3)""", _PREVIEW)
add("chapter_ids", SEGMENTS, "SELECT book_id, chapter_no, 'chapter-' || CASE WHEN (chapter_no + 1) * 37 < 1000 THEN lpad(((chapter_no + 1) * 37)::VARCHAR, 3, '0') ELSE ((chapter_no + 1) * 37)::VARCHAR END AS id FROM chapters")
PARA_XML = "CASE WHEN kind = 'scene-break' THEN '    <p class=\"scene-break\">* * *</p>' ELSE '    <p' || CASE WHEN is_first THEN ' class=\"first\"' ELSE '' END || '>' || styled || '</p>' END"
add("chapter_xhtml", f"{BLOCKS}, {FIRST}", f"SELECT book_id, chapter_no, string_agg({PARA_XML}, {NL} ORDER BY block_no) AS body FROM firsts GROUP BY 1, 2")
add("epub_documents", DOCS, "SELECT book_id, ord, id, title, kind FROM docs")
NAV_ITEM = "CASE WHEN n > 0 THEN '    <li>' || top || chr(10) || '      <ol>' || chr(10) || below || chr(10) || '      </ol>' || chr(10) || '    </li>' ELSE '    <li>' || top || '</li>' END"
HEAD_XML = f"'{XML}<html xmlns=\"http://www.w3.org/1999/xhtml\" xmlns:epub=\"http://www.idpf.org/2007/ops\" xml:lang=\"' || {esc('b_language')} || '\" lang=\"' || {esc('b_language')} || '\">\n'"
add("epub_nav", f"{DOCS}, {SHOWN}, e AS (SELECT *, count(*) FILTER (NOT nested) OVER (PARTITION BY book_id ORDER BY ord) AS entry, {link()} AS a FROM docs), top AS (SELECT book_id, entry, max(a) FILTER (NOT nested) AS top, count(*) FILTER (nested) AS n, string_agg('        <li>' || a || '</li>', {NL} ORDER BY ord) FILTER (nested) AS below FROM e GROUP BY 1, 2), items AS (SELECT book_id, string_agg({NAV_ITEM}, {NL} ORDER BY entry) AS items FROM top GROUP BY 1)", f"SELECT book_id, {HEAD_XML} || '<head><title>Contents</title></head>\n<body>\n  <nav epub:type=\"toc\" id=\"toc\">\n    <h1>Contents</h1>\n    <ol>\n' || {if_cover('    <li><a href="text/cover.xhtml">Cover</a></li>')} || '    <li><a href=\"text/titlepage.xhtml\">Title Page</a></li>\n' || items || '\n    </ol>\n  </nav>\n</body>\n</html>\n' AS content FROM items JOIN shown USING (book_id)")
POINT = f"'    <navPoint id=\"' || id || '\" playOrder=\"' || (ord + 2) || '\">\n      <navLabel><text>' || {esc('title')} || '</text></navLabel>\n      <content src=\"text/' || id || '.xhtml\"/>\n    </navPoint>'"
add("epub_ncx", f"{DOCS}, {SHOWN}, p AS (SELECT book_id, string_agg({POINT}, {NL} ORDER BY ord) AS points FROM docs GROUP BY 1)", f"SELECT book_id, '{XML}<ncx xmlns=\"http://www.daisy.org/z3986/2005/ncx/\" version=\"2005-1\">\n  <head>\n    <meta name=\"dtb:uid\" content=\"' || {esc('b_uuid')} || '\"/>\n    <meta name=\"dtb:depth\" content=\"1\"/>\n    <meta name=\"dtb:totalPageCount\" content=\"0\"/>\n    <meta name=\"dtb:maxPageNumber\" content=\"0\"/>\n  </head>\n  <docTitle><text>' || {esc('b_title')} || '</text></docTitle>\n  <navMap>\n    <navPoint id=\"titlepage\" playOrder=\"1\">\n      <navLabel><text>Title Page</text></navLabel>\n      <content src=\"text/titlepage.xhtml\"/>\n    </navPoint>\n' || points || '\n  </navMap>\n</ncx>\n' AS content FROM p JOIN shown USING (book_id)")
add("epub_opf", f"{DOCS}, {SHOWN}, p AS (SELECT book_id, string_agg('    <item id=\"' || id || '\" href=\"text/' || id || '.xhtml\" media-type=\"application/xhtml+xml\"/>', {NL} ORDER BY ord) AS manifest, string_agg('    <itemref idref=\"' || id || '\"/>', {NL} ORDER BY ord) AS spine FROM docs GROUP BY 1)", f"SELECT book_id, '{XML}<package xmlns=\"http://www.idpf.org/2007/opf\" version=\"3.0\" unique-identifier=\"pub-id\" xml:lang=\"' || {esc('b_language')} || '\">\n  <metadata xmlns:dc=\"http://purl.org/dc/elements/1.1/\">\n    <dc:identifier id=\"pub-id\">' || {esc('b_uuid')} || '</dc:identifier>\n    <dc:title>' || {esc('b_title')} || '</dc:title>\n    <dc:creator id=\"creator\">' || {esc('b_author')} || '</dc:creator>\n    <meta refines=\"#creator\" property=\"role\" scheme=\"marc:relators\">aut</meta>\n    <dc:language>' || {esc('b_language')} || '</dc:language>\n    <meta property=\"dcterms:modified\">' || {esc('b_modified')} || '</meta>\n' || {if_cover('    <meta name="cover" content="cover-image"/>')} || '  </metadata>\n  <manifest>\n    <item id=\"nav\" href=\"nav.xhtml\" media-type=\"application/xhtml+xml\" properties=\"nav\"/>\n    <item id=\"ncx\" href=\"toc.ncx\" media-type=\"application/x-dtbncx+xml\"/>\n    <item id=\"style\" href=\"styles/style.css\" media-type=\"text/css\"/>\n    <item id=\"titlepage\" href=\"text/titlepage.xhtml\" media-type=\"application/xhtml+xml\"/>\n' || coalesce('    <item id=\"cover-image\" href=\"images/cover.' || b_cover || '\" media-type=\"image/' || replace(b_cover, 'jpg', 'jpeg') || '\" properties=\"cover-image\"/>\n', '') || {if_cover('    <item id="cover" href="text/cover.xhtml" media-type="application/xhtml+xml"/>')} || manifest || '\n  </manifest>\n  <spine toc=\"ncx\">\n' || {if_cover('    <itemref idref="cover" linear="yes"/>')} || '    <itemref idref=\"titlepage\"/>\n' || spine || '\n  </spine>\n</package>\n' AS content FROM p JOIN shown USING (book_id)")


def rows(*items: tuple[str, str, str, str]) -> str:
    return "[" + ", ".join(f"{{'role': '{r}', 'align': '{a}', 'pb': {p}, 'text': {t}}}" for r, a, p, t in items) + "]"


_blank, _break = ("blank", "left", "false", "''"), ("break", "left", "true", "''")
LAYOUT = f"""{BLOCKS}, {BOOKS}, prints AS (SELECT book_id, chapter_no FROM (SELECT *, lag(part) OVER (PARTITION BY book_id ORDER BY chapter_no) AS last FROM chapters WHERE part <> '') WHERE part IS DISTINCT FROM last),
 heads AS (SELECT c.*, p.chapter_no IS NOT NULL AS new_part, count(*) OVER (PARTITION BY c.book_id) AS n FROM chapters c LEFT JOIN prints p USING (book_id, chapter_no)),
 parts AS (SELECT book_id, -1 AS a, -1 AS b, {rows(*[_blank] * 8, ("title", "center", "false", FALLBACK), ("byline", "center", "false", "'by ' || coalesce(nullif(author, ''), 'Anonymous')"))} AS l FROM books
   UNION ALL SELECT book_id, chapter_no, -2, {rows(_break, *[_blank] * 8, ("part", "center", "false", "part"))} FROM heads WHERE new_part
   UNION ALL SELECT book_id, chapter_no, -1, {rows(_break, *[_blank] * 5, ("chapter", "center", "false", "coalesce(nullif(title, ''), 'Chapter ' || (chapter_no + 1))"), _blank)} FROM heads WHERE n > 1
   UNION ALL SELECT book_id, chapter_no, -1, {rows(_blank)} FROM heads WHERE n = 1
   UNION ALL SELECT book_id, chapter_no, block_no, CASE WHEN kind = 'scene-break' THEN {rows(("scene-break", "center", "false", "'#'"))} ELSE {rows(("body", "left", "false", "plain"))} END FROM blocks
   UNION ALL SELECT book_id, 1000000000, 0, {rows(("end", "center", "false", "'END'"))} FROM books),
 flat AS (SELECT book_id, a, b, unnest(range(len(l))) AS c, unnest(l) AS x FROM parts)"""
add("docx_layout", LAYOUT, "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY a, b, c) - 1 AS seq, x.role AS role, x.align AS align, x.pb AS page_break_before, x.text AS text FROM flat")
add("contact_block", BOOKS, f"SELECT book_id, array_to_string(list_filter(list_concat([coalesce(nullif(legal_name, ''), nullif(author, ''), '')], string_split(coalesce(address, ''), {NL}), [coalesce(email, ''), coalesce(phone, '')]), lambda x: x <> ''), '|') AS lines FROM books")
_SHORT = "upper(replace(array_to_string(CASE WHEN len(w) > 3 THEN w[1:2] ELSE w END, ' '), 'ß', 'ss'))"
add("running_header", f"{BOOKS}, t AS (SELECT book_id, regexp_split_to_array({trim(FALLBACK.replace('Untitled', 'UNTITLED'))}, '[{WS}]+') AS w, regexp_split_to_array({trim('coalesce(nullif(legal_name, ' + repr('') + '), nullif(author, ' + repr('') + '), ' + repr('Author') + ')')}, '[{WS}]+') AS n FROM books)", f"SELECT book_id, n[-1] || ' / ' || {_SHORT} || ' / ' AS header FROM t")
_BASE = r"regexp_replace(regexp_replace(file_name, '\.[^.]+$', ''), '[-_]+', ' ', 'g')"
add("title_from_filename", NAMES, f"SELECT book_id, file_ord, {trim(f'regexp_replace({_BASE}, {chr(39)}^[0-9]+[{WS}]*{chr(39)}, {chr(39)}{chr(39)})')} AS title, {trim(_BASE)} AS docx_title FROM names")
_SAFE = r"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(nullif(title, ''), 'untitled')), '[''’]', '', 'g'), '[^\p{L}\p{N}]+', '-', 'g'), '^-+|-+$', '', 'g')"
add("safe_filename", BOOKS, f"SELECT book_id, coalesce(nullif(left({_SAFE}, 60), ''), 'untitled') || '.epub' AS file_name FROM books")
add("saved_files", f"{BOOKS}, named AS (SELECT *, coalesce(nullif(left({_SAFE}, 60), ''), 'untitled') || '.txt' AS file_name, concat_ws(chr(10), title, author, address, book_id::VARCHAR) AS content FROM books WHERE book_id % 3 <> 0)", "SELECT 'shelf-' || book_id % 7 || '/' || book_id AS folder, file_name, strlen(content) AS size, md5(content) AS digest FROM named")
_EVENT = "event_type || ' ' || event_id || ' & <' || props || '>'"
add("escape_xml", "", f"SELECT event_id, {esc(_EVENT)} AS s FROM events")
_CODED = f"{_EVENT} || ' &lt;b&gt; &amp;amp; &quot;x&apos; &nbsp; &#38;lt; &#x' || lower(hex(65 + event_id % 20)) || '; &#' || (97 + event_id % 26) || ';'"
_POINT = "CASE WHEN i = 1 THEN p WHEN regexp_matches(p, '^[xX][0-9a-fA-F]+;') THEN chr(try_cast('0x' || regexp_extract(p, '^[xX]([0-9a-fA-F]+);', 1) AS INT)) || regexp_replace(p, '^[^;]*;', '') WHEN regexp_matches(p, '^[0-9]+;') THEN chr(try_cast(regexp_extract(p, '^[0-9]+', 0) AS INT)) || regexp_replace(p, '^[^;]*;', '') ELSE '&#' || p END"
add("decode_entities", f"coded AS (SELECT event_id, array_to_string(list_transform(string_split({_CODED}, '&#'), lambda p, i: {_POINT}), '') AS token FROM events)", f"SELECT event_id, {DECODED} AS s FROM coded")
add("last_name", "", f"SELECT c_custkey, regexp_extract({trim(repr('') + ' || c_name || ' + repr(' ') + ' || c_mktsegment || ' + repr('  '))}, '[^{WS}]+$') AS name FROM customer")
add("short_title", f"t AS (SELECT doc_id, regexp_split_to_array({trim('text')}, '[{WS}]+') AS w FROM documents)", f"SELECT doc_id, {_SHORT} AS title FROM t")
add("clip", "", f"SELECT doc_id, {clip('text')} AS text FROM documents")
_FROM_NAME = trim(f"regexp_replace({_BASE}, '^[0-9]+[{WS}]*', '')")
add("finish_book", f"{BOOKS}, saved AS (SELECT *, '0' || book_id || ' my-book_' || book_id || '.md' AS file_name FROM books)", f"SELECT book_id, coalesce(nullif(title, ''), {_FROM_NAME}, '') AS title, coalesce(author, '') AS author FROM saved")

_NAMES = "numbered ev outline sizes lows titles rest first_level levels sections in_section shapes roles segs kept chapters".split()
#: The same tables where no heading is taken for a file's title.
UNTITLED = re.sub(rf"\b({'|'.join(_NAMES)})\b", r"\1_2", SEGMENTS.replace("AND n_low = 1)", "AND false)"))
add("multi_file_chapters", f"""{SEGMENTS}, {UNTITLED}, {NAMES}, titled AS (SELECT c.*, book_title, count(*) OVER (PARTITION BY book_id) AS n FROM chapters c LEFT JOIN titles USING (book_id)),
 lone AS (SELECT book_id FROM titled WHERE book_title IS NOT NULL AND n = 1),
 by_user AS (SELECT book_id AS u, seg, title, coalesce(part, book_title) AS part, n_blocks, n FROM titled ANTI JOIN lone USING (book_id)
   UNION ALL SELECT book_id, seg, title, part, n_blocks, count(*) OVER (PARTITION BY book_id) FROM chapters_2 SEMI JOIN lone USING (book_id)),
 all_files AS (SELECT coalesce(p_partkey, u) AS u, coalesce(file_name, (u % 5) || '-part_' || (u // 5) || '.md') AS file_name FROM names FULL JOIN (SELECT DISTINCT user_id AS u FROM events) e ON p_partkey = e.u),
 together AS (SELECT u // 5 AS book_id, u % 5 AS file_ord, coalesce(seg, 0) AS seg, CASE WHEN coalesce(n, 1) = 1 AND coalesce(title, '') = '' THEN {_FROM_NAME} ELSE title END AS title, part, coalesce(n_blocks, 0) AS n_blocks FROM all_files LEFT JOIN by_user USING (u))""",
    "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY file_ord, seg) - 1 AS chapter_no, file_ord, title, part, n_blocks FROM together WHERE title <> '' OR n_blocks > 0")

_RUN = lambda text, look: f"'<w:r>' || CASE WHEN {look} = '' THEN '' ELSE '<w:rPr>' || {look} || '</w:rPr>' END || '<w:t xml:space=\"preserve\">' || {text} || '</w:t></w:r>'"
_LOOK = lambda slant: f"(CASE WHEN event_id % 7 = 0 THEN '<w:b/>' ELSE '' END || CASE WHEN event_id % 5 = 0 THEN '{slant}' ELSE '' END)"
_WORD = lambda slant: f"CASE kind WHEN 'heading' THEN {_RUN(esc('s.text'), repr('<w:b/>'))} ELSE {_RUN(esc('s.text'), _LOOK(slant))} || {_RUN(repr(' end'), repr(''))} END"
add("docx_runs", SEGMENTS, f"SELECT s.book_id, chapter_no, block_no, slanted, underlined FROM (SELECT s.*, row_number() OVER (PARTITION BY s.book_id, seg ORDER BY item_no) - 1 AS block_no, {_WORD('<w:i/>')} AS slanted, {_WORD('<w:u w:val=' + chr(34) + 'single' + chr(34) + '/>')} AS underlined FROM segs s WHERE NOT is_part AND NOT is_chapter) s JOIN chapters c USING (book_id, seg) WHERE kind <> 'scene-break'")
add("patched_books", BOOKS, "SELECT book_id, CASE WHEN book_id % 3 = 1 THEN 'New ' || book_id ELSE title END AS title, CASE WHEN book_id % 7 = 0 THEN '' ELSE author END AS author, CASE WHEN book_id % 2 <> 0 THEN email END AS email, CASE WHEN book_id % 5 = 0 THEN '555-0' || book_id ELSE phone END AS phone, address FROM books")
add("centered_class", TAGS.replace("regexp_replace(html,", """regexp_replace(replace(html, '<p><b>', '<p class="lead is-centered"><b>'),"""), r"""SELECT book_id, tok_no FROM tags WHERE tag IN ('p', 'li') AND NOT closing AND regexp_matches(token, 'class="[^"]*\bis-centered\b')""")


def page(title: str, body: str) -> str:
    return f"{HEAD_XML} || '<head>\n  <title>' || {esc(title)} || '</title>\n  <link rel=\"stylesheet\" type=\"text/css\" href=\"../styles/style.css\"/>\n</head>\n<body>\n  <section ' || {body} || '\n  </section>\n</body>\n</html>\n'"


def entry(a: int, path: str, content: str, source: str = "shown", order: str = "0") -> str:
    return f"SELECT book_id, {a} AS a, {order} AS o, {path} AS path, {content} AS content FROM {source}"


#: Fixed values, written apart from the engine's: the container file, and the digest of the stylesheet.
_CONTAINER = """<?xml version="1.0" encoding="UTF-8"?>
<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container">
  <rootfiles>
    <rootfile full-path="OEBPS/package.opf" media-type="application/oebps-package+xml"/>
  </rootfiles>
</container>
"""
_STYLE_MD5 = "52e9208f3b953e21964063745a9adb51"
_PARTS = [
    entry(0, "'mimetype'", "'application/epub+zip'"),
    entry(1, "'META-INF/container.xml'", repr(_CONTAINER).replace("\\n", "' || chr(10) || '")),
    entry(2, "'OEBPS/styles/style.css'", "'style'"),
    entry(3, "'OEBPS/text/titlepage.xhtml'", page("b_title", f"""'class="titlepage" epub:type="titlepage">\n    <h1>' || {esc('b_title')} || '</h1>\n    <p class="author">' || {esc('b_author')} || '</p>'""")),
    entry(4, "'OEBPS/text/' || id || '.xhtml'", f"""CASE WHEN kind = 'part' THEN {page('title', f"'class=" + '"partpage" epub:type="part">' + f"\n    <h1>' || {esc('title')} || '</h1>'")} ELSE {page('title', f"'epub:type=" + '"chapter">' + f"\n    <h1 class=" + '"chapter-title">' + f"' || {esc('title')} || '</h1>\n' || coalesce(body, '')")} END""", "docs JOIN shown USING (book_id) LEFT JOIN bodies USING (book_id, chapter_no)", "ord"),
    entry(5, "'OEBPS/images/cover.' || b_cover", "NULL", "shown WHERE b_cover IS NOT NULL"),
    entry(6, "'OEBPS/text/cover.xhtml'", page("'Cover'", """'epub:type="cover" style="text-align:center">\n    <img class="cover" src="../images/cover.' || b_cover || '" alt="Cover"/>'"""), "shown WHERE b_cover IS NOT NULL"),
    *[entry(a, f"'OEBPS/{path}'", "content", f"({ORACLE_SQL[made]})") for a, path, made in ((7, "nav.xhtml", "epub_nav"), (8, "toc.ncx", "epub_ncx"), (9, "package.opf", "epub_opf"))],
]
add("epub_entries", f"{DOCS}, {SHOWN}, {FIRST}, bodies AS (SELECT book_id, chapter_no, string_agg({PARA_XML}, {NL} ORDER BY block_no) AS body FROM firsts GROUP BY 1, 2), files AS ({' UNION ALL '.join(_PARTS)})", "SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY a, o) - 1 AS seq, path, path = 'mimetype' AS stored, CASE WHEN a = 2 THEN '{_STYLE_MD5}' ELSE md5(content) END AS digest FROM files".replace("{_STYLE_MD5}", _STYLE_MD5))


def _field(*names: str) -> str:
    """The first of some fields that is a string: quoted, or neither a number nor true or false."""
    raw = [f"regexp_extract(block, '(?m)^{n}: (.*)$', 1)" for n in names]
    return f"coalesce({', '.join(f"""CASE WHEN NOT regexp_full_match({r}, '[0-9]*|true|false') THEN trim({r}, '"') END""" for r in raw)})"


add(
    "front_matter",
    f"fronts AS (SELECT doc_id, regexp_extract({FRONT} || {NL} || text, '^---\\n((?s:.*?)\\n)---\\n', 1) AS block FROM documents)",
    f"SELECT doc_id AS book_id, {_field('title')} AS title, {_field('author')} AS author, {_field('legal-name', 'legalName', 'name')} AS legal_name, {_field('email')} AS email, {_field('language', 'lang')} AS language FROM fronts",
)
add("ingest_candidates", CENTERED_ALL, "SELECT book_id, file_name || ':' || idx AS id, text, before, after FROM found JOIN files USING (book_id)")


_SHA = "sha1(from_hex('6ba7b8129dad11d180b400c04fd430c8') || encode(concat_ws(chr(10), book_id::VARCHAR, title, author)))"
add(
    "book_identifiers",
    f"{BOOKS}, hashed AS (SELECT *, {_SHA} AS h FROM books), {SHOWN}",
    "SELECT h.book_id, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substring('89ab89ab89ab89ab', strpos('0123456789abcdef', h[17:17])::BIGINT, 1) || h[18:20] || '-' || h[21:32] AS b_uuid, b_title, b_author, b_language FROM hashed h JOIN shown USING (book_id)",
)
