from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from mailsift.operators import corpus
from mailsift.plans import queries, scoring, training
from mailsift.sources import emails as store
from mailsift.sources import files, reports
from mailsift.sources.versions import VersionedMails

SCHEMA = "email_text string, language string, label int"


def rows(spark, texts):
    return spark.createDataFrame([(t, "en", i % 2) for i, t in enumerate(texts)], SCHEMA)


def test_versions_are_what_they_were(spark, tmp_path):
    table = VersionedMails(spark, str(tmp_path / "t"))
    assert table.latest() == 0 and table.versions().count() == 0
    with pytest.raises(ValueError, match="no version"):
        table.as_of()
    assert table.append(rows(spark, ["a", "b"]), "one") == 1
    between = datetime.now(timezone.utc)
    wider = rows(spark, ["c"]).withColumn("origin", F.lit("late"))
    assert table.append(wider, "two") == 2
    assert sorted(r.email_text for r in table.as_of(1).collect()) == ["a", "b"]
    assert "origin" not in table.as_of(1).columns
    assert sorted((r.email_text, r.origin) for r in table.as_of().collect()) == [("a", None), ("b", None), ("c", "late")]
    assert [r.email_text for r in table.added_in(2).collect()] == ["c"]
    assert table.version_at(between) == 1 and table.version_at(between - timedelta(days=1)) == 0
    assert [(r.version, r.append_id, r.n_rows) for r in table.versions().orderBy("version").collect()] == [(1, "one", 2), (2, "two", 1)]
    for bad in (0, 3):
        with pytest.raises(ValueError, match="no version"):
            table.as_of(bad)
    with pytest.raises(ValueError, match="language"):
        table.append(rows(spark, ["x"]).drop("language"), "three")


def test_the_same_append_adds_nothing(spark, tmp_path):
    table = VersionedMails(spark, str(tmp_path / "t"))
    first = rows(spark, ["a", "a", "b", "a", "b"])  # labels differ, so "a" is three rows of two kinds
    assert table.append(first, "one") == 1
    assert table.append(first, "one") == 1
    assert table.as_of().count() == 5
    assert table.append(first.repartition(3), "two") == 2
    ids = [r.email_id for r in table.as_of().collect()]
    assert len(ids) == len(set(ids)) == 10
    before = {r.email_id for r in table.as_of(1).collect()}
    assert before < set(ids)
    by_digest = {}
    for i in ids:
        digest, number = i.split("-")
        by_digest.setdefault(digest, []).append(int(number))
    assert all(sorted(n) == list(range(1, len(n) + 1)) for n in by_digest.values())


def test_a_lost_commit_is_tried_again(spark, tmp_path, monkeypatch):
    table, other = (VersionedMails(spark, str(tmp_path / "t")) for _ in range(2))
    table.append(rows(spark, ["a"]), "one")
    commit, raced = VersionedMails._commit, []

    def race(self, version, append_id, key, n_rows):
        if append_id == "mine" and not raced:
            raced.append(other.append(rows(spark, ["a"]), "theirs"))
        return commit(self, version, append_id, key, n_rows)

    monkeypatch.setattr(VersionedMails, "_commit", race)
    assert table.append(rows(spark, ["a"]), "mine") == 3 and raced == [2]
    numbers = sorted(r.email_id.split("-")[1] for r in table.as_of().collect())
    assert numbers == ["1", "2", "3"]  # numbered anew after the other append
    assert len(list((tmp_path / "t" / "data").iterdir())) == 4  # one folder has no commit


def test_damage_is_found(spark, tmp_path):
    table = VersionedMails(spark, str(tmp_path / "t"))
    table.append(rows(spark, ["a", "b", "c"]).repartition(2), "one")
    assert table.damaged().count() == 0
    assert table.files().agg(F.sum("n_rows")).first()[0] == 3
    for part in next((tmp_path / "t" / "data").iterdir()).glob("part-*"):
        part.unlink()
        break
    assert table.damaged().count() == 1


def test_given_ids_are_kept_beside_the_new_ones(spark, tmp_path):
    table = VersionedMails(spark, str(tmp_path / "t"))
    table.append(rows(spark, ["a", "b"]).withColumn("email_id", F.monotonically_increasing_id()), "one")
    found = table.as_of()
    assert dict(found.dtypes)["source_id"] == "bigint" and dict(found.dtypes)["email_id"] == "string"


def test_from_csv_to_audit(spark, tmp_path):
    """A table without ids: CSV, append, training on the newest version, scoring, audit, retraining."""
    made = corpus.sample_corpus(spark, 60).drop("email_id")
    csv = store.write_emails(made, str(tmp_path / "csv"), "csv")
    table = VersionedMails(spark, str(tmp_path / "t"))
    table.append(store.read_emails(spark, csv), "first")
    models = str(tmp_path / "models")
    options = {"reg_params": (0.1,), "vocab_size": 500, "max_iter": 5}
    number, model = training.retrain(table, models, **options)
    assert number == 1 and files.exists(spark, f"{models}/version=1/metrics/_SUCCESS")
    table.append(corpus.sample_corpus(spark, 10, seed=7).drop("email_id"), "second")
    again, newer = training.retrain(table, models, **options)
    assert again == 2
    old, same = training.retrain(table, models, version=1, **options)
    assert old == 1 and list(same.stages[-1].coefficients) == list(model.stages[-1].coefficients)
    scoring.score_job(spark, table.as_of(), newer, str(tmp_path / "out"), batch_id=0)
    audit = reports.read_audit(spark, f"{tmp_path}/out/audit", id_type="string")
    assert audit.count() == table.as_of().count() == 280
    assert audit.where("label is null or raw_score is null").count() == 0
    assert queries.quality.column_check(table.as_of()).where("not present").count() == 0
