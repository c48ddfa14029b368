"""Markdown manuscripts to outlines, one Arrow batch at a time.

The parser covers ATX and setext headings, paragraphs with lazy lines, thematic breaks, block
quotes, lists, fenced and indented code, HTML blocks, link reference definitions, front matter,
and inline emphasis, code spans, links, images, line breaks, references, escapes and raw HTML.
It keeps what prose needs: code, HTML blocks and images vanish, links keep their text, quotes and
lists are flattened, headings inside them turn into bold paragraphs.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from quire.plans.batches import parts

RUNS = "array<struct<text:string,italic:boolean,bold:boolean>>"
ITEM = f"struct<item_no:int,kind:string,depth:int,text:string,runs:{RUNS}>"

#: Fixed value: elements whose tags open a block of raw HTML.
HTML_BLOCKS = frozenset(
    "address article aside base basefont blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frame frameset h1 h2 h3 h4 h5 h6 "
    "head header hr html iframe legend li link main menu menuitem nav noframes ol optgroup option p param search section summary table tbody td tfoot th thead title tr track ul".split()
)
WS = "\t\n\x0b\f\r \xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
SCENE = re.compile(rf"[{WS}]*(?:#|\*[{WS}]*\*[{WS}]*\*|~+|·+)[{WS}]*\Z")
TILDES = re.compile(r"^[ \t]{0,3}~{3,}[ \t]*(?=\r?$)", re.M)
RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*)$")
BULLET = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)(?=\S)|[ \t]*$)")
PREFIX = re.compile(r"[ \t]*(?:(?:>[ \t]*|(?:[-+*]|\d{1,9}[.)])[ \t]+))*")
QUOTE = re.compile(r" {0,3}> ?")
DEFINITION = re.compile(r" {0,3}\[((?:\\.|[^\[\]\\])+)\]:[ \t]*\n?[ \t]*(<[^<>\n]*>|\S+)(?:[ \t]+(?:\n[ \t]*)?(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*(?:\n|\Z)")
TAG = re.compile(r"<(?:[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w:.-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?|/[A-Za-z][A-Za-z0-9-]*\s*)>|<!--.*?-->|<\?.*?\?>|<![A-Za-z][^>]*>|<!\[CDATA\[.*?\]\]>", re.S)
AUTO = re.compile(r"<([A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.!#$%&'*+/=?^`{|}~-]+@[\w-]+(?:\.[\w-]+)*)>")
ANGLE = re.compile(r"<[^<>\n]*>")
TARGET_END = re.compile(r"(?:\s+(?:\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|\((?:[^()\\]|\\.)*\)))?\s*\)")
MARKS = {c: re.compile(f"[{c}]+") for c in "`*_"}
PUNCTUATION = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def expand(line: str) -> str:
    """Tabs in the indent and after the marks of quotes and list items to the next multiple of four
    columns of the whole line, so that what is inside a mark needs no columns of its own."""
    out, width = [], 0
    end = PREFIX.match(line).end() if "\t" in line else 0
    for c in line[:end]:
        n = 4 - width % 4 if c == "\t" else 1
        out.append(" " * n if c == "\t" else c)
        width += n
    return "".join(out) + line[end:]


class Blocks:
    """Lines to nodes: (kind, ...) with kind paragraph, heading, rule, code, html, quote, list."""

    def __init__(self) -> None:
        self.refs: set[str] = set()

    def parse(self, lines: list[str]) -> list[tuple]:
        out: list[tuple] = []
        para: list[str] = []

        def close() -> None:
            if para:
                text = "\n".join(x.strip(" \t") if i else x.lstrip(" \t") for i, x in enumerate(para))
                para.clear()
                while m := DEFINITION.match(text):
                    self.refs.add(label(m[1]))
                    text = text[m.end() :]
                if text.strip():
                    out.append(("paragraph", text.rstrip(" \t")))

        i = 0
        while i < len(lines):
            line = expand(lines[i])
            indent = len(line) - len(line.lstrip(" "))
            if not line.strip():
                close()
                i += 1
            elif indent >= 4 and not para:
                i += 1
                while i < len(lines) and (not lines[i].strip() or len(expand(lines[i])) - len(expand(lines[i]).lstrip(" ")) >= 4):
                    i += 1
                out.append(("code",))
            elif indent < 4 and (m := FENCE.match(line)) and not (m[2][0] == "`" and "`" in m[3]):
                close()
                i += 1
                while i < len(lines) and not re.match(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", expand(lines[i])):
                    i += 1
                i += 1
                out.append(("code",))
            elif para and indent < 4 and (m := re.match(r" {0,3}(=+|-+)[ \t]*$", line)):
                before = len(out)
                close()
                if len(out) > before:
                    out[-1] = ("heading", 1 if m[1][0] == "=" else 2, out[-1][1])
                elif m[1][0] == "-" and RULE.match(line):
                    out.append(("rule",))
                else:
                    para.append(lines[i])
                i += 1
            elif indent < 4 and RULE.match(line):
                close()
                out.append(("rule",))
                i += 1
            elif indent < 4 and (m := ATX.match(line)):
                close()
                text = m[2] or ""
                out.append(("heading", len(m[1]), "" if re.fullmatch(r"#+", text) else text.strip(" \t")))
                i += 1
            elif indent < 4 and QUOTE.match(line):
                close()
                inner, lazy = [], False
                while i < len(lines):
                    x = expand(lines[i])
                    if q := QUOTE.match(x):
                        inner.append(x[q.end() :])
                        lazy = bool(inner[-1].strip()) and not re.match(r" {4}| {0,3}(#{1,6}([ \t]|$)|`{3}|~{3})", inner[-1])
                    elif lazy and x.strip() and not self.starts_block(x):
                        inner.append(x)
                    else:
                        break
                    i += 1
                out.append(("quote", self.parse(inner)))
            elif indent < 4 and (m := BULLET.match(line)) and not (para and (m[3] is None or m[2][0].isdigit() and m[2][:-1] != "1")):
                close()
                i = self.list_(lines, i, out)
            elif indent < 4 and line.lstrip(" ").startswith("<") and (end := self.html_end(line.lstrip(" "), bool(para))):
                close()
                while i < len(lines):
                    x = lines[i]
                    if end == "blank" and not x.strip():
                        break
                    i += 1
                    if end != "blank" and re.search(end, x, re.I):
                        break
                out.append(("html",))
            else:
                para.append(lines[i])
                i += 1
        close()
        return out

    @staticmethod
    def starts_block(line: str) -> bool:
        return bool(RULE.match(line) or ATX.match(line) or FENCE.match(line) or BULLET.match(line) and BULLET.match(line)[3] or QUOTE.match(line))

    @staticmethod
    def html_end(line: str, in_para: bool) -> str | None:
        for start, end in ((r"<(script|pre|style|textarea)(\s|>|$)", r"</(script|pre|style|textarea)>"), (r"<!--", r"-->"), (r"<\?", r"\?>"), (r"<![A-Za-z]", r">"), (r"<!\[CDATA\[", r"\]\]>")):
            if re.match(start, line, re.I):
                return end
        if (m := re.match(r"</?([A-Za-z][A-Za-z0-9]*)(\s|/?>|$)", line)) and m[1].lower() in HTML_BLOCKS:
            return "blank"
        if not in_para and (m := TAG.match(line)) and not line[m.end() :].strip() and re.match(r"</?[A-Za-z]", line):
            return "blank"
        return None

    def list_(self, lines: list[str], i: int, out: list[tuple]) -> int:
        first = BULLET.match(expand(lines[i]))
        mark = first[2][-1]
        items: list[list[tuple]] = []
        while i < len(lines):
            line = expand(lines[i])
            m = BULLET.match(line)
            if not m or m[2][-1] != mark or RULE.match(line):
                break
            pad = len(m[3]) if m[3] else 1
            width = len(m[1]) + len(m[2]) + (1 if pad > 4 else pad)
            inner, i, blank = [line[width:]], i + 1, False
            while i < len(lines):
                x = expand(lines[i])
                indent = len(x) - len(x.lstrip(" "))
                if not x.strip():
                    blank = True
                    inner.append("")
                elif indent >= width:
                    inner.append(x[width:])
                    blank = False
                elif not blank and inner[-1].strip() and not self.starts_block(x):
                    inner.append(x)
                else:
                    break
                i += 1
            items.append(self.parse(inner))
            while i < len(lines) and not lines[i].strip():
                i += 1
        out.append(("list", items))
        return i


def target_end(s: str, at: int) -> int | None:
    """Where the (destination "title") that opens at `at` ends; parentheses in a bare destination
    balance, at most 32 deep."""
    if not s.startswith("(", at):
        return None
    i, depth = at + 1, 0
    while i < len(s) and s[i].isspace():
        i += 1
    if s.startswith("<", i):
        m = ANGLE.match(s, i)
        if not m:
            return None
        i = m.end()
    else:
        while i < len(s) and not s[i].isspace() and (s[i] != ")" or depth) and depth <= 32:
            depth += (s[i] == "(") - (s[i] == ")")
            i += 2 if s[i] == "\\" and s[i + 1 : i + 2] in PUNCTUATION else 1
        if depth:
            return None
    m = TARGET_END.match(s, i)
    return m.end() if m else None


def label(text: str) -> str:
    return " ".join(text.split()).casefold()


class Inline:
    """Text of a paragraph to styled runs."""

    def __init__(self, refs: set[str]):
        self.refs = refs

    def runs(self, text: str) -> list[tuple[str, bool, bool]]:
        return merge([(t, bool(s & 1), bool(s & 2)) for t, s in self.styled(text)])

    def styled(self, s: str) -> list[tuple[str, int]]:
        nodes: list[list] = []  # [text, style] or ["", 0, delimiter fields]
        delims: list[int] = []
        brackets: list[tuple[int, bool, int]] = []  # node, image?, place in s
        ticks: dict[int, list[int]] = {}  # where backticks in a row stand, by their number
        for m in MARKS["`"].finditer(s):
            ticks.setdefault(len(m[0]), []).append(m.start())
        i = 0

        def text(t: str) -> None:
            if t:
                nodes.append([t, 0])

        while i < len(s):
            c = s[i]
            if c == "\\" and i + 1 < len(s):
                if s[i + 1] == "\n":
                    text(" ")
                    i += 2
                elif s[i + 1] in PUNCTUATION:
                    text(s[i + 1])
                    i += 2
                else:
                    text(c)
                    i += 1
            elif c == "`":
                n = MARKS[c].match(s, i).end() - i
                same = ticks.get(n, [])
                k = bisect_left(same, i + n)
                if k == len(same):
                    text("`" * n)
                    i += n
                else:
                    code = s[i + n : same[k]].replace("\n", " ")
                    text(code[1:-1] if code[:1] == code[-1:] == " " and code.strip() and len(code) > 1 else code)
                    i = same[k] + n
            elif c == "<" and (m := AUTO.match(s, i)):
                text(m[1])
                i = m.end()
            elif c == "<" and (m := TAG.match(s, i)):
                if re.fullmatch(r"<br\s*/?>", m[0].strip(), re.I):
                    text(" ")
                i = m.end()
            elif c == "&" and (m := re.compile(r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});").match(s, i)):
                text(html.unescape(m[0]))
                i = m.end()
            elif c in "*_":
                n = MARKS[c].match(s, i).end() - i
                before, after = s[i - 1] if i else "\n", s[i + n] if i + n < len(s) else "\n"
                left = not after.isspace() and (not self.mark(after) or before.isspace() or self.mark(before))
                right = not before.isspace() and (not self.mark(before) or after.isspace() or self.mark(after))
                opens = left and (c == "*" or not right or self.mark(before))
                closes = right and (c == "*" or not left or self.mark(after))
                delims.append(len(nodes))
                nodes.append([c * n, 0, c, n, n, opens, closes])
                i += n
            elif c == "!" and s[i + 1 : i + 2] == "[":
                brackets.append((len(nodes), True, i + 2))
                nodes.append(["![", 0])
                i += 2
            elif c == "[":
                brackets.append((len(nodes), False, i + 1))
                nodes.append(["[", 0])
                i += 1
            elif c == "]" and brackets:
                at, image, start = brackets.pop()
                end = self.link_end(s, start, i)
                if end is None:
                    text("]")
                    i += 1
                else:
                    k = bisect_left(delims, at)
                    self.emphasis(nodes, delims[k:])
                    del delims[k:]
                    nodes[at][0] = ""
                    if image:
                        del nodes[at:]
                    else:
                        brackets[:] = [b for b in brackets if b[1]]
                    i = end
            elif c == "\n":
                if nodes and len(nodes[-1]) == 2 and nodes[-1][0].endswith("  "):
                    nodes[-1][0] = nodes[-1][0].rstrip(" ")
                    text(" ")
                else:
                    if nodes and len(nodes[-1]) == 2:
                        nodes[-1][0] = nodes[-1][0].rstrip(" ")
                    text("\n")
                i += 1
            else:
                m = re.compile(r"[^\\`<&*_!\[\]\n]+").match(s, i)
                text(m[0] if m else c)
                i = m.end() if m else i + 1
        self.emphasis(nodes, delims)
        return [(n[0], n[1]) for n in nodes if n[0]]

    @staticmethod
    def mark(c: str) -> bool:
        return c in PUNCTUATION or not (c.isalnum() or c.isspace() or c == "_" or ord(c) < 128) and not c.isalpha()

    def link_end(self, s: str, start: int, close: int) -> int | None:
        if end := target_end(s, close + 1):
            return end
        if (m := re.compile(r"\[((?:\\.|[^\[\]\\])*)\]").match(s, close + 1)) and label(m[1] or s[start:close]) in self.refs:
            return m.end()
        return close + 1 if label(s[start:close]) in self.refs else None

    @staticmethod
    def emphasis(nodes: list[list], delims: list[int]) -> None:
        """Pairs delimiters with the nearest openers of their kind and styles what is between them.
        Openers that a kind of closer looked at in vain aren't looked at again for that kind, and
        styles are added up at the end, so that long paragraphs take time in proportion."""
        openers: list[int] = []
        seen: dict[tuple, int] = {}
        changes: dict[int, list[int]] = {}
        for d in delims:
            closer = nodes[d]
            kind = (closer[2], closer[5], closer[4] % 3)
            while closer[6] and closer[3]:
                for j in range(len(openers) - 1, seen.get(kind, 0) - 1, -1):
                    opener = nodes[openers[j]]
                    odd = (opener[6] or closer[5]) and (opener[4] + closer[4]) % 3 == 0 and (opener[4] % 3 or closer[4] % 3)
                    if opener[2] == closer[2] and not odd:
                        break
                else:
                    seen[kind] = len(openers)
                    break
                n = 2 if opener[3] >= 2 and closer[3] >= 2 else 1
                changes.setdefault(openers[j] + 1, [0, 0])[n - 1] += 1
                changes.setdefault(d, [0, 0])[n - 1] -= 1
                for x in (opener, closer):
                    x[3] -= n
                    x[0] = x[2] * x[3]
                del openers[j + (opener[3] > 0) :]
                seen = {k: min(v, len(openers)) for k, v in seen.items()}
            if closer[5] and closer[3]:
                openers.append(d)
        italic = bold = 0
        for i in range(delims[0], delims[-1] + 1) if changes else ():
            if i in changes:
                italic, bold = italic + changes[i][0], bold + changes[i][1]
            nodes[i][1] |= (italic > 0) + 2 * (bold > 0)


def merge(runs: list[tuple[str, bool, bool]]) -> list[tuple[str, bool, bool]]:
    out: list[tuple[str, bool, bool]] = []
    for t, i, b in runs:
        if out and out[-1][1:] == (i, b):
            out[-1] = (out[-1][0] + t, i, b)
        else:
            out.append((t, i, b))
    return [r for r in out if r[0]]  # empty runs part others until they are merged


def trim(s: str) -> str:
    return re.sub(rf"\A[{WS}]+|[{WS}]+\Z", "", s)


def front_matter(lines: list[str]) -> tuple[dict[str, str], list[str]]:
    """The string values of a YAML block that opens the text, and the lines after it."""
    if not lines or lines[0].rstrip(" \t\r") != "---":
        return {}, lines
    end = next((i for i, x in enumerate(lines[1:], 1) if x.rstrip(" \t\r") == "---"), None)
    if end is None:
        return {}, lines
    import yaml

    try:
        data = yaml.load("\n".join(lines[1:end]), yaml.BaseLoader)
        nodes = yaml.compose("\n".join(lines[1:end]), yaml.BaseLoader)
    except yaml.YAMLError:
        return {}, lines[end + 1 :]
    if not isinstance(data, dict):
        return {}, lines[end + 1 :]
    found = {}
    for key, value in nodes.value:
        plain = value.id == "scalar" and value.style is None
        # unquoted scalars that the core schema reads as null, booleans or numbers aren't strings
        if value.id == "scalar" and not (plain and re.fullmatch(r"|~|null|Null|NULL|true|True|TRUE|false|False|FALSE|[-+]?[0-9]+|0o[0-7]+|0x[0-9a-fA-F]+|[-+]?(\.[0-9]+|[0-9]+(\.[0-9]*)?)([eE][-+]?[0-9]+)?|[-+]?\.(inf|Inf|INF)|\.(nan|NaN|NAN)", value.value)):
            found[key.value] = value.value
    return found, lines[end + 1 :]


def parse(content: str) -> tuple[dict[str, str], list[dict]]:
    """Front matter and outline items of a text."""
    content = TILDES.sub("* * *", content).replace("\r\n", "\n").replace("\r", "\n")
    meta, lines = front_matter(content.removeprefix("\ufeff").split("\n"))
    parser = Blocks()
    nodes = parser.parse(lines)
    inline = Inline(parser.refs)
    items: list[dict] = []

    def add(kind: str, depth: int | None = None, text: str | None = None, runs: list | None = None) -> None:
        items.append({"item_no": len(items), "kind": kind, "depth": depth, "text": text, "runs": runs and [{"text": t, "italic": i, "bold": b} for t, i, b in runs]})

    def plain(text: str) -> str:
        return trim("".join(t for t, _, _ in inline.runs(text)))

    def walk(nodes: list[tuple], top: bool) -> None:
        for node in nodes:
            if node[0] == "rule":
                add("scene-break")
            elif node[0] == "heading":
                t = plain(node[2])
                if top and t:
                    add("heading", node[1], t)
                elif top:
                    add("scene-break")
                else:
                    add("paragraph", None, t, [(t, False, True)])
            elif node[0] == "paragraph":
                runs = inline.runs(node[1])
                t = "".join(r[0] for r in runs)
                if SCENE.match(t):
                    add("scene-break")
                elif trim(t):
                    add("paragraph", None, t, runs)
            elif node[0] == "quote":
                walk(node[1], False)
            elif node[0] == "list":
                for item in node[1]:
                    walk(item, False)

    walk(nodes, True)
    return meta, items


def parse_files(files: DataFrame) -> DataFrame:
    """book_id, file_ord, file_name, meta (map of front matter strings), items (outline items), error.
    A text that can't be parsed (quotes or lists nested deeper than Python's stack, say) has no items
    but an error, the kind of failure; it ends neither its task nor other files."""
    item = pa.struct([("item_no", pa.int32()), ("kind", pa.string()), ("depth", pa.int32()), ("text", pa.string()), ("runs", pa.list_(pa.struct([("text", pa.string()), ("italic", pa.bool_()), ("bold", pa.bool_())])))])

    def one(text: str) -> tuple[list, list, str | None]:
        try:
            meta, items = parse(text)
            return list(meta.items()), items, None
        except Exception as e:  # whatever a text of unknown origin does to the parser
            return [], [], type(e).__name__

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            meta, items, error = zip(*[one(c or "") for c in batch.column("content").to_pylist()], strict=True)
            cols = [batch.column("book_id"), batch.column("file_ord"), batch.column("file_name"), pa.array(meta, pa.map_(pa.string(), pa.string())), pa.array(items, pa.list_(item)), pa.array(error, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["book_id", "file_ord", "file_name", "meta", "items", "error"])

    cols = files.select(F.col("book_id").cast("long").alias("book_id"), F.col("file_ord").cast("int").alias("file_ord"), "file_name", "content")
    return cols.mapInArrow(run, f"book_id long, file_ord int, file_name string, meta map<string,string>, items array<{ITEM}>, error string")


def outline(parsed: DataFrame) -> DataFrame:
    return parsed.select("book_id", "file_ord", F.explode("items").alias("x")).select("book_id", "file_ord", "x.*")


def metadata(parsed: DataFrame) -> DataFrame:
    """book_id and, for each field, the first file's value that has it."""
    m = lambda *names: F.coalesce(*[F.col("meta")[n] for n in names])
    fields = {"title": m("title"), "author": m("author"), "legal_name": m("legal-name", "legalName", "name"), "address": m("address"), "email": m("email"), "phone": m("phone"), "language": m("language", "lang")}
    return parsed.groupBy("book_id").agg(*[F.min_by(v, F.when(v.isNotNull(), F.col("file_ord"))).alias(k) for k, v in fields.items()])
