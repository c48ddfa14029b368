"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Patterns mark candidates in the whole text; each candidate gets features - its length, character
transitions, share of letters and digits, coverage by dictionary words, whether it looks like a
path, address or number, and what the neighbouring words name - and a random forest scores it. The
forest is trained by Spark's own library on labelled findings, which a rule makes from examples of
secrets and of look-alikes (hashes of commits, identifiers, placeholders, paths), and is then
written out as conditional expressions over arrays of candidates, which Spark's array functions
evaluate within the row: no Python, and no shuffle to put a text together again.

Defined results: null text counts as empty and has no findings; a candidate that occurs again is
a finding again, with its own neighbours; overlapping candidates are one, that which begins first
and of those the first pattern's; a secret of any length is masked whole; private-use characters
stay what they are; repeated rows give repeated findings; an empty table gives no row. Only the id
and text columns are read.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm._common import cut_lineage

#: Shapes of well-known keys, and names that stand before a secret. No length has an
#: upper bound, or what is beyond it would stay in the text; runs are possessive or begin where no
#: other run does, so that the time stays linear. A private key goes to its END line, and one
#: without such a line as far as its lines look like base64.
PEM_NAME = r"[A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
PEM = rf"-----BEGIN {PEM_NAME}(?:(?:(?!-----)[\s\S])*+-----END {PEM_NAME}|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{{20,}}+)*+)"
SHAPES = (
    PEM,
    r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    r"\bgh[pousr]_[A-Za-z0-9]{20,}",
    r"\bxox[abprs]-[A-Za-z0-9-]{10,}",
    r"\bAIza[0-9A-Za-z_-]{30,}",
    r"\b[spr]k[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{16,}",
    r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{4,}",
    r"""(?<=://)[^\s/:@"'<>]*+:[^\s/@"'<>]{3,}+(?=@)""",  # user and password in an address
)
VALUE = r"""[^\s"'<>]{6,}+"""
GIVES = r"""["']?(?:[ \t]++|\s{0,3})(?:=>|[:=])(?:[ \t]++|\s{0,3})["']?"""
#: A run of name characters is looked at from its start only (or from where the finding before it ended), and once more if a value follows.
PREFIX = rf"(?:(?<![A-Za-z0-9_.-])|\G)(?=[A-Za-z0-9_.-]++{GIVES}{VALUE})(?i:[a-z0-9_.-]*(?:password|passwd|passphrase|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|private[_-]?key|credential)(?:s?[_.-][a-z0-9_.-]*+|s|s?[0-9]++|key)?+){GIVES}"
NAMED = PREFIX + VALUE
GENERIC = r"\b[A-Za-z0-9+/_-]{20,}+={0,2}"
CANDIDATE = "|".join([*SHAPES, NAMED, GENERIC])
NAMES = r"(?i)(password|passwd|passphrase|pwd|secret|token|api.?key|access.?key|auth|private.?key|credential|bearer)"
HARMLESS = r"(?i)(commit|revision|sha-?\d*|md5|checksum|digest|hash|uuid|guid|example|sample|etag|build|version|isbn|tracking|order|ref|docs?|see|license)"
DICTIONARY = (
    "about access account admin after again application because before between change changed changeme client code config content create data default demo development document dummy "
    "environment example false field file first foobar function generic given here hello house insert introduction item key language letter library local login machine message name never "
    "number object order other package page parameter passphrase password path people placeholder please private process production project property public random release replace request "
    "required response result sample secret section server service session setting should simple something source string system table temporary test testing their there thing this through "
    "token training type under update user username value variable version welcome where which world would write your"
).split()

FEATURES = ("size", "moves", "letters", "digits", "uppers", "words", "shape", "named", "near", "harmless", "path", "number", "hexes")
MARK, END, ESCAPE = "\ue000", "\ue001", "\ue002"


def escaped(text: Column) -> Column:
    """The text with characters that serve as marks written as escapes."""
    for sign, letter in ((ESCAPE, "e"), (MARK, "m"), (END, "n")):
        text = F.replace(text, F.lit(sign), F.lit(ESCAPE + letter))
    return text


def restored(text: Column) -> Column:
    """What `escaped` was given."""
    for sign, letter in ((END, "n"), (MARK, "m"), (ESCAPE, "e")):
        text = F.replace(text, F.lit(ESCAPE + letter), F.lit(sign))
    return text


def marked_parts(text: Column) -> Column:
    """The text, escaped and cut before each candidate: the first part has none, each other begins
    with one, which END closes."""
    return F.split(F.regexp_replace(escaped(F.coalesce(text, F.lit(""))), f"({CANDIDATE})", f"{MARK}$1{END}"), MARK)


def candidates(parts: Column) -> Column:
    """struct(finding, before, after) of each candidate, in text order."""

    def one(i: Column) -> Column:
        part = F.get(parts, i)
        finding = F.substring_index(part, END, 1)
        before = F.regexp_extract(F.replace(F.get(parts, i - 1), F.lit(END), F.lit(" ")), r"((?:\S{1,40}\s+){0,2}\S{0,40}\s*)\z", 1)
        after = F.regexp_extract(F.substring_index(part, END, -1), r"\A(\s*\S{0,40})", 1)
        return F.struct(finding.alias("finding"), before.alias("before"), after.alias("after"))

    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), one)).otherwise(F.array().cast("array<struct<finding:string,before:string,after:string>>"))


def features(c: Column) -> Column:
    """The forest's features of a candidate."""
    finding, before, after = c["finding"], c["before"], c["after"]
    value = F.when(before.endswith("://"), F.regexp_replace(finding, r"\A[^:]*:", "")).otherwise(F.regexp_replace(finding, PREFIX, ""))
    named = F.length(value) < F.length(finding)
    n = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda kind: F.length(F.regexp_replace(value, f"[^{kind}]", "")) / n
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0"), "[^aA0]+", "-")
    rest = F.regexp_replace(F.lower(value), f"({'|'.join(sorted(DICTIONARY, key=len, reverse=True))})", "")
    flag = lambda x: F.when(x, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.struct(
        F.length(value).cast("double").alias("size"),
        ((F.length(kinds) - 1) / n).alias("moves"),
        share("A-Za-z").alias("letters"),
        share("0-9").alias("digits"),
        share("A-Z").alias("uppers"),
        (1 - F.length(rest) / n).alias("words"),
        flag(finding.rlike("|".join(SHAPES))).alias("shape"),
        flag(named).alias("named"),
        flag(before.rlike(NAMES)).alias("near"),
        flag(before.rlike(HARMLESS) | after.rlike(r"\A\s*\((?i:example|sample)")).alias("harmless"),
        flag(value.rlike(r"/[A-Za-z_.-]{2,}/|\.[a-z]{2,4}\z|\A(\.{0,2}|[a-z]+:)/|\A[$%{<]") | before.rlike(r"[/.]\z")).alias("path"),
        flag(value.rlike(r"\A[0-9 ()+.-]+\z")).alias("number"),
        flag(value.rlike(r"\A[0-9a-f-]+\z")).alias("hexes"),
    )


def labelled_findings(spark: SparkSession, rows: int = 60, first: int = 0) -> DataFrame:
    """finding, before, after, label: `rows` of each kind of secret and of look-alike, by a rule
    that gives others for each number from `first` on."""
    h = lambda salt: F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256)
    b64 = lambda salt: F.translate(F.base64(F.unhex(h(salt))), "+/=", "xyz")
    word = lambda salt: F.element_at(F.array(*map(F.lit, DICTIONARY)), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(DICTIONARY))) + 1).cast("int"))
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    pick = lambda salt, *x: F.element_at(F.array(*[F.lit(v) for v in x]), (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(len(x))) + 1).cast("int"))
    n = lambda salt, low, high: (F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(high - low + 1)) + low).cast("int")
    prose = cat(word("p1"), " ", word("p2"), " ")
    yes = [
        (cat("AKIA", F.upper(F.substr(b64("a"), F.lit(1), F.lit(16)))), prose),
        (cat("ghp_", F.substr(b64("b"), F.lit(1), F.lit(36))), prose),
        (cat("xoxb-", F.substr(b64("c"), F.lit(1), F.lit(30))), prose),
        (cat("sk-", F.substr(b64("d"), F.lit(1), F.lit(40))), prose),
        (cat("AIza", F.substr(b64("d2"), F.lit(1), F.lit(35))), prose),
        (cat("eyJ", F.substr(b64("d3"), F.lit(1), F.lit(20)), ".", F.substr(b64("d4"), F.lit(1), F.lit(30)), ".", F.substr(b64("d5"), F.lit(1), F.lit(22))), prose),
        (cat("-----BEGIN ", pick("q0", "RSA ", "EC ", "", "OPENSSH "), "PRIVATE KEY-----"), prose),
        (cat("password=", F.substr(h("e"), F.lit(1), n("e1", 10, 24))), prose),
        (cat("token = \"", F.substr(h("f"), F.lit(1), n("f1", 24, 40))), prose),
        (cat(pick("g0", "api_key: ", "secret=", "db_password: ", "auth_token='"), F.substr(b64("g"), F.lit(1), n("g1", 10, 40))), prose),
        (F.substr(b64("i"), F.lit(1), n("i1", 24, 40)), cat(word("p3"), " ", pick("i0", "bearer ", "secret ", "password ", "token "))),
        (cat(word("z1"), ":", F.substr(b64("z2"), F.lit(1), n("z3", 8, 20))), cat(word("p7"), " ", pick("z4", "https", "postgres", "amqp"), "://")),
        (F.substr(h("j"), F.lit(1), F.lit(40)), cat(word("p4"), " ", pick("j0", "key is secret ", "password ", "token "))),
    ]
    no = [
        (F.substr(h("k"), F.lit(1), F.lit(40)), cat(word("p5"), " ", pick("k0", "commit ", "revision ", "sha1 ", "checksum "))),
        (h("l"), cat(word("p6"), " ", pick("l0", "sha256 ", "digest ", "hash "))),
        (F.substr(h("l2"), F.lit(1), n("l3", 24, 40)), prose),
        (F.regexp_replace(F.substr(h("m"), F.lit(1), F.lit(32)), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), prose),
        (cat(pick("o0", "password=", "password: ", "token=", "secret: ", "api_key="), pick("o1", "changeme", "your_password", "example", "placeholder", "<password>", "xxxxxxxx", "required", "********")), prose),
        (cat(word("z5"), ":", pick("z6", "password", "changeme", "example", "$PASSWORD", "xxxxxxxx", "********", "placeholder")), cat(word("p8"), " ", pick("z7", "https", "postgres", "amqp"), "://")),
        (cat(pick("q", "password: ", "token: ", "secret: "), word("q1"), "_", word("q2")), prose),
        (cat(pick("r", "token=", "secret=", "password="), "$", F.upper(word("r1"))), prose),
        (cat("/", word("s1"), "/", word("s2"), "/", word("s3"), "/", word("s4")), prose),
        (cat(word("t1"), "-", word("t2"), "-", word("t3"), "-", word("t4")), prose),
        (cat(word("u1"), "_", word("u2"), "_", word("u3"), "_", F.col("id").cast("string")), prose),
        (F.repeat(word("v1"), 4), prose),
        (cat(F.translate(F.substr(h("w"), F.lit(1), n("w1", 20, 30)), "0123456789", "ghijklmnop")), prose),
        (F.translate(F.substr(h("x"), F.lit(1), n("x1", 20, 24)), "abcdef", "012345"), prose),
        (F.repeat(pick("y", "-", "_", "=", "ab", "-="), 15), prose),
    ]
    kinds = [F.struct(f.alias("finding"), b.alias("before"), F.lit(" ").alias("after"), F.lit(float(y)).alias("label")) for y, group in ((1, yes), (0, no)) for f, b in group]
    return spark.range(first, first + rows, 1, 1).select(F.explode(F.array(*kinds)).alias("x")).select("x.*")


def as_column(tree: str, f: Column) -> Column:
    """A tree of Spark's text form (If/Else lines) as a conditional expression."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in tree.splitlines() if x.strip()]

    def build(i: int) -> tuple[Column, int]:
        _, line = lines[i]
        if m := re.match(r"Predict: (\S+)", line):
            return F.lit(float(m[1])), i + 1
        m = re.match(r"If \(feature (\d+) (<=|>) (\S+)\)", line)
        low, i = build(i + 1)
        high, i = build(i + 1)  # after the Else line
        value = f[FEATURES[int(m[1])]]
        return F.when(value <= float(m[3]) if m[2] == "<=" else value > float(m[3]), low).otherwise(high), i

    return build(0)[0]


def forest(spark: SparkSession, trees: int = 24, depth: int = 6, seed: int = 17) -> list[str]:
    """The trees, in Spark's text form, of a random forest trained on the labelled findings."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    c = F.struct("finding", "before", "after")
    rows = labelled_findings(spark).select("label", features(c).alias("f")).select("label", "f.*")
    rows = cut_lineage(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows).select("label", "x"))
    model = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.8).fit(rows)
    return [t for t in re.split(r"\n\s*Tree \d+ \(weight [\d.]+\):\n", model.toDebugString)[1:]]


def score(trees: list[str], f: Column) -> Column:
    """The share of trees that call a candidate a secret."""
    return reduce(lambda a, b: a + b, [as_column(t, f) for t in trees]) / len(trees)


def scored(parts: Column, trees: list[str]) -> Column:
    """struct(finding, before, after, score) of each candidate."""
    with_features = F.transform(candidates(parts), lambda c: F.struct(c["finding"].alias("finding"), c["before"].alias("before"), c["after"].alias("after"), features(c).alias("f")))
    return F.transform(with_features, lambda c: F.struct(c["finding"].alias("finding"), c["before"].alias("before"), c["after"].alias("after"), score(trees, c["f"]).alias("score")))


def scan(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, occurrence (0, 1, ... among the text's candidates), finding, before, after, score
    and is_secret of each candidate."""
    trees = forest(docs.sparkSession)
    parts = docs.select("doc_id", marked_parts(F.col("text")).alias("parts")).where(F.size("parts") > 1)
    rows = parts.select("doc_id", F.posexplode(scored(F.col("parts"), trees)).alias("occurrence", "c"))
    return rows.select("doc_id", F.col("occurrence").cast("long").alias("occurrence"), *[restored(F.col(f"c.{c}")).alias(c) for c in ("finding", "before", "after")], "c.score", (F.col("c.score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, threshold: float = 0.5, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with secrets in text replaced by a mark. Texts without a secret
    stay exactly as they are."""
    trees = forest(docs.sparkSession)
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    both = docs.select(row, marked_parts(F.col("text")).alias("parts"))
    both = both.withColumn("found", F.when(F.size("parts") > 1, scored(F.col("parts"), trees)))
    one = lambda p, i: F.when(i == 0, p).when(F.get(F.col("found"), i - 1)["score"] >= threshold, F.concat(F.lit(mark), F.substring_index(p, END, -1))).otherwise(F.replace(p, F.lit(END), F.lit("")))
    text = F.when(F.exists(F.coalesce("found", F.array().cast("array<struct<finding:string,before:string,after:string,score:double>>")), lambda c: c["score"] >= threshold), restored(F.array_join(F.transform("parts", one), ""))).otherwise(F.col("row.text"))
    return both.select(*[text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in names])
