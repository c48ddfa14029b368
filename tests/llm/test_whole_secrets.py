"""Secrets are found and masked whole, whatever their length and name."""

import random
import string

from quire.llm import secret_scan

R = random.Random(3)


def letters(n):
    return "".join(R.choice(string.ascii_letters + string.digits) for _ in range(n))


def test_long_and_long_named_secrets(spark):
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join(letters(64) for _ in range(25)) + "\n" + letters(11) + "=\n-----END RSA PRIVATE KEY-----"
    secrets = [
        f"token: eyJ{letters(40)}.{letters(260)}.{letters(43)}",
        f"api_key={letters(400)}",
        "SPRING_DATASOURCE_REPLICA_PASSWORD=hunter22x",
        "SECRET_KEY=h4Gk29xq",
        f"password      =  {letters(14)}",
        pem,
        f"-----BEGIN PRIVATE KEY-----\n{letters(64)}\n{letters(64)}",
    ]
    docs = spark.createDataFrame([(i, f"see {x} and more") for i, x in enumerate(secrets)], "doc_id long, text string")
    assert [r.text for r in secret_scan.redacted(docs).orderBy("doc_id").collect()] == ["see [SECRET] and more"] * len(secrets)


def test_candidates_take_linear_time(spark):
    # runs that are no secret, over which a pattern with a square time would go for hours
    texts = ["password." * 100_000 + " q", "a." * 500_000 + " z", "-----BEGIN " + "A " * 300_000, "password" + " " * 500_000 + "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    assert [r[0] for r in docs.select(secret_scan.marked_parts(docs.text)).collect()] == [[t] for t in texts]


def test_marks_and_addresses(spark):
    texts = ["a \ue000 b \ue001 c \ue002n api_key=" + letters(5000) + " \ue002 z", "get postgres://admin:" + letters(14) + "@db.host/x now", "\ue000\ue001 plain", "see https://host:8080/a@b and mail me@host"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    clean = [r.text for r in secret_scan.redacted(docs).orderBy("doc_id").collect()]
    assert clean == ["a \ue000 b \ue001 c \ue002n [SECRET] \ue002 z", "get postgres://[SECRET]@db.host/x now", *texts[2:]]
    before = [r.before for r in secret_scan.scan(docs).where("doc_id = 0").collect()]
    assert before == ["\ue001 c \ue002n "]


def test_precision_and_recall_on_held_out_findings(spark):
    """Labelled findings of numbers that the forest wasn't trained on, within texts."""
    rows = [(i, f"{r.before}{r.finding}{'@' if r.before.endswith('://') else r.after}end", r.label) for i, r in enumerate(secret_scan.labelled_findings(spark, 40, first=10_000).collect())]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    found = {r.doc_id for r in secret_scan.scan(docs).where("is_secret").collect()}
    hit = sum(i in found for i, _, y in rows if y)
    assert hit >= 0.95 * sum(y for *_, y in rows) and hit >= 0.95 * len(found), (hit, len(found), sum(y for *_, y in rows))
