"""The data source of files: what is opened, how it is dealt, and that jobs save all or nothing."""

import os

import pytest
from pyspark.sql import functions as F

from quire.sources import files as S

OUT = "folder string, file_name string, data binary"


@pytest.fixture
def folder(tmp_path):
    for name, data in {"a/10.md": "ten", "a/9.TXT": "nine", "a/cover.png": "p", "a/cover2.jpg": "q", "b/x.docx": "word", "b/_tmp.md": "no", "c/y.pdf": "pdf", "c/none": "", "c/.z.md": "no", "top.md": "ü"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(data)
    return str(tmp_path)


def plan(df):
    from contextlib import redirect_stdout
    from io import StringIO

    with redirect_stdout(StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


def test_reading(spark, folder):
    rows = {f"{r.folder}/{r.file_name}": r for r in S.read_files(spark, folder).collect()}
    assert set(rows) == {"a/10.md", "a/9.TXT", "a/cover.png", "a/cover2.jpg", "b/x.docx", "c/y.pdf", "c/none", "/top.md"}
    assert (rows["a/9.TXT"].kind, rows["c/none"].kind, rows["a/cover.png"].kind, rows["b/x.docx"].kind) == ("text", "other", "cover", "docx")
    assert rows["/top.md"].content.decode() == "ü" and rows["/top.md"].size == 2
    assert len({r.book_id for r in rows.values()}) == 4


def test_filters_reach_the_source(spark, folder):
    os.chmod(f"{folder}/c/y.pdf", 0)
    os.symlink("/nowhere", f"{folder}/c/broken.pdf")  # reading it would fail the job
    for where, want in {"kind = 'text'": {"10.md", "9.TXT", "top.md"}, "extension in ('png', 'docx')": {"cover.png", "x.docx"}, "folder = 'a' and kind = 'cover' and file_name like 'cover2%'": {"cover2.jpg"}, "kind = 'text' and length(content) > 3": {"9.TXT"}}.items():
        got = S.read_files(spark, folder, where)
        assert {r.file_name for r in got.collect()} == want
        shown = plan(got)
        assert "PushedFilters: [" in shown and "PushedFilters: []" not in shown, shown
    reader = S.FilesReader(folder, 1 << 20)
    from pyspark.sql.datasource import EqualTo, IsNotNull

    left = list(reader.pushFilters([EqualTo(("kind",), "text"), IsNotNull(("kind",)), EqualTo(("content",), b"")]))
    assert len(left) == 2 and [p.files[0][1]["kind"] for p in reader.partitions()] == ["text"]


def test_files_are_dealt_by_size(spark, tmp_path):
    for i in range(20):
        (tmp_path / f"{i}.txt").write_bytes(b"x" * 100_000)
    shares = S.FilesReader(str(tmp_path), 310_000).partitions()
    assert len(shares) == 7 and sum(len(s.files) for s in shares) == 20
    assert S.read_files(spark, str(tmp_path)).agg(F.sum(F.length("content"))).first()[0] == 2_000_000
    (tmp_path / "empty").mkdir()
    assert S.read_files(spark, f"{tmp_path}/empty").count() == 0


def test_manuscripts_and_covers(spark, folder):
    text, word, covers = S.manuscripts(spark, folder)
    assert [(r.file_ord, r.file_name, r.content) for r in text.orderBy("book_id", "file_ord").collect() if r.file_name != "top.md"] == [(0, "9.TXT", "nine"), (1, "10.md", "ten")]
    assert [r.file_name for r in word.collect()] == ["x.docx"]
    assert [(r.cover, bytes(r.image)) for r in covers.collect()] == [("png", b"p")]


def listing(top):
    return sorted(f for _, _, names in os.walk(top) for f in names)


def test_saving_is_one_act(spark, tmp_path):
    top = f"{tmp_path}/out"
    S.save_files(spark.createDataFrame([("x", "1.txt", b"a"), ("x/y", "2.txt", None), (None, "3.txt", b"ccc")], OUT).repartition(3), top)
    assert {(r.folder, r.file_name, bytes(r.content)) for r in S.read_files(spark, top).collect()} == {("x", "1.txt", b"a"), ("x/y", "2.txt", b""), ("", "3.txt", b"ccc")}
    # a task that fails after others have written leaves nothing
    for bad in ([("a", "4.txt", b"d"), ("a", "../5.txt", b"e")], [("a", "4.txt", b"d"), ("a", "4.txt", b"e")]):
        for parts in (1, 4):
            with pytest.raises(Exception):
                S.save_files(spark.createDataFrame(bad, OUT).repartition(parts), top)
            assert listing(top) == ["1.txt", "2.txt", "3.txt"] and not [d for d in os.listdir(top) if d.startswith("_")]
    S.save_files(spark.createDataFrame([("z", "6.txt", b"f")], OUT), top)
    assert listing(top) == ["1.txt", "2.txt", "3.txt", "6.txt"]
    S.save_files(spark.createDataFrame([("z", "7.txt", b"g")], OUT), top, overwrite=True)
    assert listing(top) == ["7.txt"]
    S.save_files(spark.createDataFrame([], OUT), top)
    assert listing(top) == ["7.txt"]


def test_attempts_that_no_message_names_go(tmp_path):
    w = S.FilesWriter(str(tmp_path), False, ["file_name", "data"])
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"file_name": ["a"], "data": [b"x"]})
    lost, kept = w.write(iter([batch])), w.write(iter([batch]))
    w.commit([kept, None])
    assert listing(tmp_path) == ["a"] and lost.part not in str(list(os.walk(tmp_path)))
    with pytest.raises(ValueError):
        S.FilesWriter(str(tmp_path), False, ["data"])
