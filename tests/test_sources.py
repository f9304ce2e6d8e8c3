from datetime import datetime

import pytest
from pyspark.errors import AnalysisException

from mailsift.operators.identity import with_email_id
from mailsift.sources import emails as store

ROWS = [
    (1, 'line one\nline "two", with comma', "en", 1),
    (2, "простой текст", "ru", 0),
    (3, " padded ", "sw", 0),
    (4, None, "zh", 1),
]
SCHEMA = "email_id long, email_text string, language string, label int"


@pytest.fixture
def mails(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_csv_round_trip(spark, mails, tmp_path):
    path = store.write_emails(mails, str(tmp_path / "deep" / "mails"), "csv")
    back = store.read_emails(spark, path)
    assert back.dtypes == mails.dtypes
    assert sorted(back.collect()) == sorted(mails.collect())


def test_extra_and_corrupt_fields(spark, tmp_path):
    file = tmp_path / "x.csv"
    file.write_text('email_text,language,label,note\n"a ""b""",en,1,first\nc,en,spam,second\n')
    rows = store.read_emails(spark, str(file), keep_corrupt=True).collect()
    assert [r.note for r in rows] == ["first", "second"]
    assert [r.label for r in rows] == [1, None]
    assert rows[0].email_text == 'a "b"' and rows[0]._corrupt_record is None
    assert "spam" in rows[1]._corrupt_record


def test_missing_path(spark, tmp_path):
    with pytest.raises(AnalysisException):
        store.read_emails(spark, str(tmp_path / "none.csv"))


def test_raw_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("héllo\nworld".encode("utf-8"))
    (tmp_path / "b.txt").write_bytes("héllo".encode("latin-1"))
    rows = store.read_raw_text(spark, str(tmp_path)).orderBy("path").collect()
    assert [r.email_text for r in rows] == ["héllo\nworld", "héllo"]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_append(spark, mails, tmp_path, fmt):
    path = store.write_emails(mails, str(tmp_path / "t"), fmt)
    lines = []
    preview = store.append_single(spark, path, "new", 1, fmt=fmt, report=lines.append)
    assert preview.count() == 1 and store.read_emails(spark, path, fmt).count() == 4
    assert lines == ["4 rows are stored, 1 to be added"]
    store.append_single(
        spark, path, "new", 1, fmt=fmt, dry_run=False, backup=str(tmp_path / "kept"),
        report=lines.append,
    )
    rows = store.read_emails(spark, path, fmt).collect()
    assert len(rows) == 5
    added = [r for r in rows if r.email_text == "new"]
    assert (added[0].email_id, added[0].language, added[0].label) == (5, "en", 1)
    kept = list((tmp_path / "kept").iterdir())
    assert len(kept) == 1 and store.read_emails(spark, str(kept[0]), fmt).count() == 4


def test_append_csv_file(spark, mails, tmp_path):
    path = store.write_emails(mails, str(tmp_path / "t"))
    new = tmp_path / "new.csv"
    new.write_text("label,language,email_text\n0,en,hello\n")
    store.append_csv(spark, path, str(new), dry_run=False, report=lambda line: None)
    assert store.read_emails(spark, path, "parquet").where("email_text = 'hello'").count() == 1
    bad = tmp_path / "bad.csv"
    bad.write_text("label,text\n0,x\n")
    with pytest.raises(ValueError, match="email_text"):
        store.append_csv(spark, path, str(bad), dry_run=False)


def test_snapshot_manifest(spark, mails, tmp_path):
    path = store.write_emails(mails.coalesce(1), str(tmp_path / "t"))
    now = datetime(2025, 1, 2, 3, 4, 5)
    out = store.snapshot(spark, path, str(tmp_path / "s"), content="manifest", now=now)
    assert out.endswith("snapshot=20250102T030405Z")
    files = [r.file for r in spark.read.json(out).collect()]
    assert spark.read.parquet(*files).count() == 4
    store.append_single(spark, path, "later", 0, dry_run=False, report=lambda line: None)
    assert store.read_emails(spark, path, "parquet").count() == 5
    assert store.read_snapshot(spark, out).count() == 4
    copy = store.snapshot(spark, path, str(tmp_path / "s"), now=now)
    assert copy == f"{out}-2" and store.read_snapshot(spark, copy).count() == 5
    kept = list((tmp_path / "t-snapshots").iterdir())  # the append has kept the state before
    assert len(kept) == 1 and store.read_snapshot(spark, str(kept[0])).count() == 4


def test_union_by_name(mails):
    new = mails.select("label", "language", "email_text")
    both = store.union_emails(mails, new)
    assert both.count() == 8 and both.where("email_id is null").count() == 4


def test_create_corpus(spark, tmp_path):
    path = store.create_corpus(spark, str(tmp_path / "c"), samples_per_language=10)
    assert path == store.create_corpus(spark, path, samples_per_language=20)
    assert spark.read.parquet(path).count() == 80


def test_labels_that_are_no_numbers(spark):
    df = spark.createDataFrame([("1",), ("x",), (None,)], "label string")
    good, bad = store.cast_labels(df)
    assert sorted([r.label for r in good.collect()], key=str) == [1, None]
    assert [r.label for r in bad.collect()] == ["x"]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    folder = tmp_path / "in put [1]"
    folder.mkdir()
    (folder / "a.csv").write_text("email_text,language,label\nhabari,sw,1\n\"two\nlines\",en,0.0\n")
    (folder / "b.csv").write_text("label,email_text,note,language\n0,hello,x,en\nspam,bad,y,en\n1,short\n")
    (folder / "c.csv").write_text("\ufefflanguage,label,email_text\n")
    (folder / "d.csv").write_text("")
    path = str(folder).replace("[", "\\[").replace("]", "\\]")
    rows = {r.email_text: r for r in store.read_csv_with_reasons(spark, path).collect()}
    assert {t: (r.language, r.label, r.note, r.reason) for t, r in rows.items()} == {
        "habari": ("sw", 1, None, None),
        "two\nlines": ("en", 0, None, None),
        "hello": ("en", 0, "x", None),
        "bad": ("en", None, "y", "label is no number"),
        "short": (None, 1, None, "the fields do not fit the header"),
    }
    assert "spam" in rows["bad"]._corrupt_record and "short" in rows["short"]._corrupt_record
    with pytest.raises(Exception, match="label is no number|do not fit"):
        store.read_emails(spark, path).collect()
    out = str(tmp_path / "stored")
    assert store.ingest_csv(spark, path, out) == {"good": 3, "quarantine": 2}
    assert spark.read.parquet(f"{out}/status=good").count() == 3


def test_headers_that_cannot_be_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("label,label,email_text\n1,2,x\n")
    with pytest.raises(ValueError, match="twice"):
        store.read_emails(spark, str(tmp_path / "a.csv"))
    (tmp_path / "b.csv").write_text('label,"email\ntext"\n1,x\n')
    with pytest.raises(ValueError, match="one line"):
        store.read_emails(spark, str(tmp_path / "b.csv"))


def test_rows_without_ids_get_new_ones(spark, tmp_path):
    quiet = {"dry_run": False, "report": lambda line: None, "backup": False}
    path = store.write_emails(spark.createDataFrame(ROWS, SCHEMA), str(tmp_path / "n"))
    new = spark.createDataFrame([(f"t{i}", "en", 0) for i in range(50)], "email_text string, language string, label int")
    store.append_emails(spark, path, new.repartition(4), **quiet)
    found = [r.email_id for r in store.read_emails(spark, path, "parquet").collect()]
    assert sorted(found) == list(range(1, 55))
    named = with_email_id(new)
    with pytest.raises(ValueError, match="do not fit"):
        store.append_emails(spark, path, named, **quiet)
    texts = store.write_emails(named, str(tmp_path / "t"))
    store.append_emails(spark, texts, new, **quiet)
    ids = [r.email_id for r in store.read_emails(spark, texts, "parquet").collect()]
    assert len(set(ids)) == 100 and sorted({i.split("-")[1] for i in ids}) == ["1", "2"]


def test_a_corpus_is_whole_before_it_replaces_another(spark, tmp_path):
    path = store.create_corpus(spark, str(tmp_path / "c"), samples_per_language=10)
    before = spark.read.parquet(path).count()
    with pytest.raises(Exception):
        store.create_corpus(spark, path, samples_per_language="x")
    assert spark.read.parquet(path).count() == before
    assert [f.name for f in tmp_path.iterdir()] == ["c"]
