"""String functions as Columns, with the white space and null rules of the documents' own world:
trimming takes Unicode white space and the byte order mark, `first_of` (like coalesce) keeps empty
strings, `first_filled` skips them. All stay in generated JVM code."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space, and lines that mean a break between scenes.
WS = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
WS_CHARACTERS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
SCENE_BREAK = rf"\A[{WS}]*(?:#|\*[{WS}]*\*[{WS}]*\*|~+|·+)[{WS}]*\z"

#: Words that count in chapter lines.
NUMBER_WORDS = (
    "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred"
).split()
NAMED_SECTIONS = "prologue epilogue interlude foreword preface afterword coda".split()
ROMAN = "(?=[ivxlcdm])m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})"


def chapter_pattern() -> str:
    words = "|".join(NUMBER_WORDS)
    number = rf"(?:[0-9]{{1,4}}|{ROMAN}|(?:{words})(?:[-{WS}](?:{words}))*)"
    subtitle = rf"(?:[{WS}]*[—–:.-][{WS}]*[A-Za-z0-9_][A-Za-z0-9_{WS}.,:'’-]{{0,38}})?"
    return rf"\A(?i:(?:chapter|part|book)[{WS}]+{number}|{'|'.join(NAMED_SECTIONS)}){subtitle}\z"


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(WS_CHARACTERS))


def utf16_length(s: Column) -> Column:
    """Code units: letters beyond the basic plane count twice."""
    return F.length(s) + F.length(F.regexp_replace(s, "[^\\x{10000}-\\x{10FFFF}]+", ""))


def at_most(s: Column, n: int) -> Column:
    """Is utf16_length at most n? Letters are counted first, which decides long texts without a pattern."""
    return (F.length(s) <= n) & (utf16_length(s) <= n)


def first_of(*cols: Column) -> Column:
    return F.coalesce(*cols)


def first_filled(*cols: Column | str) -> Column:
    cols = [F.lit(c) if isinstance(c, str) else c for c in cols]
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols[:-1]], cols[-1])


def words(s: Column) -> Column:
    """Words between white space; 0 for blank text."""
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), f"[{WS}]+"), lambda w: w != "")).cast("long")


def manuscript_words(n: Column) -> Column:
    """To the nearest 100, or 1,000 from 40,000 on; never below one step. n is used several times:
    where it is costly, it should be a column of a projection of its own."""
    step = F.when(n >= 40_000, F.lit(1000)).otherwise(F.lit(100))
    return F.greatest(step, F.round(n / step).cast("long") * step).cast("long")


def is_scene_break(s: Column) -> Column:
    return s.rlike(SCENE_BREAK)


def leading_weight(line: Column) -> Column:
    lead = F.regexp_extract(line, r"\A[\t ]*", 0)
    return (F.length(lead) + 3 * (F.length(lead) - F.length(F.replace(lead, F.lit("\t"), F.lit(""))))).cast("long")


def is_title_shaped(s: Column) -> Column:
    return (s != "") & at_most(s, 60) & s.rlike(r"[\p{L}\p{N}]") & ~is_scene_break(s)


def is_centered_shaped(line: Column) -> Column:
    return (leading_weight(line) >= 8) & is_title_shaped(trim(line))


def is_chapter_line(s: Column) -> Column:
    t = F.regexp_replace(trim(s), rf"[{WS}.!?:]+\z", "")
    return at_most(t, 48) & t.rlike(chapter_pattern())


def atx_depth(line: Column) -> Column:
    """Depth of a # heading line, else null."""
    marks = F.regexp_extract(line, rf"\A {{0,3}}(#{{1,6}})[{WS}]+[^{WS}]", 1)
    return F.nullif(F.length(marks), F.lit(0)).cast("int")


def clip(s: Column) -> Column:
    return F.when(~at_most(s, 140), F.concat(F.substring(s, 1, 139), F.lit("…"))).otherwise(s)


def neutralize_tildes(s: Column) -> Column:
    return F.regexp_replace(s, r"(?m)^[ \t]{0,3}~{3,}[ \t]*$", "* * *")


def without_extension(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]+\z", "")


def title_from_filename(name: Column, keep_number: bool = False) -> Column:
    """keep_number: leading digits stay (the rule for Word files)."""
    s = F.regexp_replace(without_extension(name), "[-_]+", " ")
    return trim(s if keep_number else F.regexp_replace(s, rf"\A[0-9]+[{WS}]*", ""))


def safe_filename(title: Column, suffix: str) -> Column:
    s = F.regexp_replace(F.lower(first_filled(title, "untitled")), "['’]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^\p{L}\p{N}]+", "-"), r"\A-+|-+\z", "")
    return F.concat(first_filled(F.substring(s, 1, 60), "untitled"), F.lit(suffix))


def escape_xml(s: Column) -> Column:
    s = F.regexp_replace(s, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, s)


def decode_entities(s: Column) -> Column:
    """Decimal and hexadecimal references first, then the five names, & last. References beyond
    the last code point stay as they are."""

    def numeric(t: Column, pattern: str, base: int) -> Column:
        parts = F.split(t, f"(?={pattern})")

        def one(p: Column) -> Column:
            digits = F.regexp_extract(p, rf"\A{pattern}", 1)
            short = F.regexp_replace(digits, r"\A0+(?=.)", "")
            code = F.when(F.length(short) <= 8, F.conv(short, base, 10).cast("long"))
            # a character of any code point is decoded from its four bytes
            letter = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
            return F.when((digits != "") & (code <= 0x10FFFF), F.concat(letter, F.regexp_replace(p, rf"\A{pattern}", ""))).otherwise(p)

        return F.when(F.contains(t, F.lit("&#")), F.array_join(F.transform(parts, one), "")).otherwise(t)

    s = numeric(s, "&#([0-9]+);", 10)
    s = numeric(s, "&#x([0-9a-fA-F]+);", 16)
    pairs = (("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))
    return reduce(lambda t, p: F.replace(t, F.lit(p[0]), F.lit(p[1])), pairs, s)


def last_name(name: Column) -> Column:
    return first_filled(F.element_at(F.split(trim(name), f"[{WS}]+"), -1), "Author")


def short_title(title: Column) -> Column:
    w = F.split(trim(first_filled(title, "UNTITLED")), f"[{WS}]+")
    return F.upper(F.array_join(F.when(F.size(w) > 3, F.slice(w, 1, 2)).otherwise(w), " "))


def numbered(prefix: str, n: Column) -> Column:
    """chapter-001: three digits at least, never cut."""
    s = n.cast("string")
    return F.concat(F.lit(prefix), F.lpad(s, F.greatest(F.lit(3), F.length(s)), F.lit("0")))


def natural_key(name: Column) -> Column:
    """Sorts names with their numbers by value and their letters by the root collation: by letter,
    then accent, then case. Digit runs lose leading zeros and are padded to 40 places (longer ones
    sort as text). Names that differ in leading zeros only are ties; use the input's order for them."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), 1)
    bare = lambda r: F.regexp_replace(r, r"\A0+(?=.)", "")
    padded = F.array_join(F.transform(runs, lambda r: F.when(r.rlike(r"\A[0-9]+\z"), F.lpad(bare(r), F.greatest(F.lit(40), F.length(bare(r))), F.lit("0"))).otherwise(r)), "")
    return F.collate(padded, "UNICODE")


def named_uuid(name: Column, namespace: str = "6ba7b812-9dad-11d1-80b4-00c04fd430c8") -> Column:
    """The identifier of version 5 (by SHA-1) of a name: the same for the same name, in any task."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    part = lambda start, n: F.substring(h, start, n)
    variant = F.lower(F.hex(F.conv(part(17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8))))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def run_text(runs: Column) -> Column:
    return F.array_join(F.transform(runs, lambda r: r["text"]), "")


def merge_runs(runs: Column) -> Column:
    """Neighbouring runs of one style become one; then empty ones go. The places where the style
    changes are found first, so each run is copied once."""
    clean = F.transform(runs, lambda r: F.struct(F.coalesce(r["text"], F.lit("")).alias("text"), F.coalesce(r["italic"], F.lit(False)).alias("italic"), F.coalesce(r["bold"], F.lit(False)).alias("bold")))
    style = lambda r: F.struct(r["italic"], r["bold"])

    def merged(clean: Column) -> Column:
        n = F.size(clean)
        starts = F.filter(F.transform(clean, lambda r, i: F.when((i == 0) | (style(r) != style(F.get(clean, i - 1))), i)), lambda i: i.isNotNull())
        stretch = lambda i, k: F.slice(clean, i + 1, F.coalesce(F.get(starts, k + 1), n) - i)
        return F.transform(starts, lambda i, k: F.struct(F.array_join(F.transform(stretch(i, k), lambda r: r["text"]), "").alias("text"), F.get(clean, i)["italic"].alias("italic"), F.get(clean, i)["bold"].alias("bold")))

    # one bound variable, so that the cleaned runs are computed once
    return F.filter(F.element_at(F.transform(F.array(clean), merged), 1), lambda r: r["text"] != "")


def trim_edges(runs: Column) -> Column:
    """Tabs and spaces off the outer ends, through runs of nothing else; empty runs go."""
    blank = lambda r: F.regexp_replace(r["text"], "[\\t ]+", "") == ""
    styled = lambda r, t: F.struct(t.alias("text"), r["italic"].alias("italic"), r["bold"].alias("bold"))
    first = F.array_min(F.filter(F.transform(runs, lambda r, i: F.when(~blank(r), i)), lambda i: i.isNotNull()))
    last = F.array_max(F.transform(runs, lambda r, i: F.when(~blank(r), i)))
    lead = F.transform(runs, lambda r, i: styled(r, F.when(i <= F.coalesce(first, F.lit(1 << 30)), F.regexp_replace(r["text"], r"\A[\t ]+", "")).otherwise(r["text"])))
    tail = F.transform(lead, lambda r, i: styled(r, F.when(i >= F.coalesce(last, F.lit(0)), F.regexp_replace(r["text"], r"[\t ]+\z", "")).otherwise(r["text"])))
    return F.filter(tail, lambda r: r["text"] != "")


def runs_xhtml(runs: Column) -> Column:
    def one(r: Column) -> Column:
        t = escape_xml(r["text"])
        t = F.when(r["bold"], F.concat(F.lit("<strong>"), t, F.lit("</strong>"))).otherwise(t)
        return F.when(r["italic"], F.concat(F.lit("<em>"), t, F.lit("</em>"))).otherwise(t)

    return F.array_join(F.transform(runs, one), "")
