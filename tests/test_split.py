import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from mailsift.operators import ordering, split
from mailsift.operators.metrics import roc_by_language


def key(i):
    return hashlib.md5(f"42:{i}".encode()).hexdigest()


@pytest.mark.parametrize("counts", [{0: 295, 1: 43}, {0: 1, 1: 3}, {0: 2000, 1: 2, None: 7}])
def test_split_is_exact(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        for _ in range(n):
            rows.append((i, label))
            i += 1
    df = spark.createDataFrame(rows, "email_id long, label int")
    got = split.stratified_split(df).collect()
    assert sorted(r.email_id for r in got) == list(range(i))
    found = {r.email_id: r.split for r in got}
    for label, n in counts.items():
        ids = sorted((e for e, l in rows if l == label), key=key)
        n_train = math.floor(n * 0.7)
        n_val = math.floor((n - n_train) * 0.5)
        expected = ["train"] * n_train + ["val"] * n_val + ["test"] * (n - n_train - n_val)
        assert [found[e] for e in ids] == expected


def test_split_sizes_are_scaled(spark):
    assert split.split_shares(7, 2, 1) == pytest.approx((0.7, 2 / 3))
    with pytest.raises(ValueError):
        split.split_shares(0, 0, 0)
    df = spark.range(100).select(F.col("id").alias("email_id"), F.lit(0).alias("label"))
    sizes = split.split_sizes(split.stratified_split(df, train=8, val=0, test=2)).collect()
    assert {r["split"]: r.n_rows for r in sizes} == {"train": 80, "test": 20}


def test_split_beyond_the_broadcast_bound(spark):
    df = spark.range(300).select(
        F.col("id").alias("email_id"), (F.col("id") % 30).cast("int").alias("label")
    )
    small = {r.email_id: r.split for r in split.stratified_split(df).collect()}
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "-1")
    try:
        assert {r.email_id: r.split for r in split.stratified_split(df).collect()} == small
    finally:
        spark.conf.set(threshold, before)


def test_split_never_shuffles_texts(spark):
    df = spark.range(50).select(
        F.col("id").alias("email_id"), (F.col("id") % 2).alias("label"),
        F.lit("x").alias("email_text"),
    )
    plan = split.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


@pytest.mark.parametrize("seed", [42, None])
def test_batches(spark, seed):
    ids = random.Random(1).sample(range(10**12), 1001)
    df = spark.createDataFrame([(i,) for i in ids], "email_id long")
    got = split.batch_rows(df, 32, seed).collect()
    ordered = sorted(ids) if seed is None else sorted(ids, key=key)
    assert {r.email_id: (r.batch_id, r.batch_pos) for r in got} == {
        e: divmod(n, 32) for n, e in enumerate(ordered)
    }


def test_shuffle_order(spark):
    df = spark.range(100).withColumnRenamed("id", "email_id")
    assert [r.email_id for r in split.shuffled(df).collect()] == sorted(range(100), key=key)


def test_flatten(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, ["c"])], "batch_id long, emails array<string>")
    got = split.flatten_batches(df).orderBy("batch_id", "pos").collect()
    assert [tuple(r) for r in got] == [(1, 0, "a"), (1, 1, "b"), (2, 0, "c")]


def test_percentiles_with_a_hot_value(spark):
    rng = random.Random(3)
    rows = [("a", 5.0)] * 700 + [("a", rng.random() * 10) for _ in range(800)]
    rows += [("b", float(x)) for x in range(7)] + [("b", None), (None, 1.5)]
    df = spark.createDataFrame(rows, "g string, v double")
    counts = ordering.value_counts(df, ["g"], "v")
    found = ordering.exact_percentiles(counts, ["g"], "v", {"p50": 0.5, "p95": 0.95})
    got = {r.g: r for r in found.collect()}

    def expected(group, share):
        values = sorted(v for g, v in rows if g == group and v is not None)
        at = (len(values) - 1) * share
        lo, hi = values[math.floor(at)], values[math.ceil(at)]
        return lo + (hi - lo) * (at - math.floor(at))

    assert set(got) == {"a", "b", None}
    for group in got:
        assert got[group].p50 == pytest.approx(expected(group, 0.5))
        assert got[group].p95 == pytest.approx(expected(group, 0.95))


def test_roc_with_one_dominant_language(spark):
    rng = random.Random(5)
    rows = [
        ("en" if rng.random() < 0.9 else "sw", rng.randint(0, 1), round(rng.random(), 2))
        for _ in range(2000)
    ] + [("zh", 1, 0.5)]
    df = spark.createDataFrame(rows, "language string, label int, raw_score double")
    got = {(r.language, r.score): (r.tpr, r.fpr) for r in roc_by_language(df).collect()}
    for (language, score), (tpr, fpr) in got.items():
        mine = [(l, s) for g, l, s in rows if g == language]
        pos, neg = sum(l for l, _ in mine), sum(1 - l for l, _ in mine)
        tp = sum(1 for l, s in mine if s >= score and l == 1)
        fp = sum(1 for l, s in mine if s >= score and l == 0)
        assert tpr == pytest.approx(tp / pos if pos else 0.0)
        assert fpr == pytest.approx(fp / neg if neg else 0.0)
    assert len(got) == len({(g, s) for g, _, s in rows})


def test_equal_texts_stay_together(spark):
    rng = random.Random(6)
    rows = []
    for i in range(400):
        text = None if i % 90 == 0 else f"text {rng.randrange(150)}"
        rows.append((text, rng.choice([0, 0, 1, None]) if rng.random() < 0.2 else i % 2))
    rows += [("everywhere", 1)] * 200  # a third of all rows
    df = spark.createDataFrame(rows, "email_text string, label int")
    found = split.grouped_split(df.repartition(5)).collect()
    assert sorted(map(str, [(r.email_text, r.label) for r in found])) == sorted(map(str, rows))
    of_text = {}
    for r in found:
        of_text.setdefault(r.email_text, set()).add(r.split)
    assert all(len(s) == 1 for s in of_text.values())
    again = split.grouped_split(df.repartition(2)).collect()
    assert {r.email_text: r.split for r in again} == {t: min(s) for t, s in of_text.items()}
    # Sizes of each class are exact but for the group on the cut.
    sizes, classes = Counter(t for t, _ in rows), {}
    for t in sizes:
        own = Counter(label for text, label in rows if text == t)
        classes[t] = max(own, key=lambda k: (own[k], k is not None, -(k or 0)))
    for kind in set(classes.values()):
        n = sum(s for t, s in sizes.items() if classes[t] == kind)
        largest = max(s for t, s in sizes.items() if classes[t] == kind)
        got = sum(s for t, s in sizes.items() if classes[t] == kind and of_text[t] == {"train"})
        assert math.floor(n * 0.7) <= got < math.floor(n * 0.7) + largest
    leak = split.split_leakage(split.grouped_split(df)).first()
    assert (leak.n_texts, leak.n_leaked, leak.n_rows) == (len(sizes), 0, 0)
    row = split.split_leakage(spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "email_text string, split string")).first()
    assert tuple(row) == (2, 1, 2)


def test_batches_in_the_order_of_text_ids(spark):
    ids = [f"{i:x}-é{i % 7}" for i in random.Random(3).sample(range(10**9), 700)]
    df = spark.createDataFrame([(i,) for i in ids], "email_id string")
    got = split.batch_rows(df.repartition(5), 32, None).collect()
    place = {v: k for k, v in enumerate(sorted(ids, key=lambda x: x.encode()))}
    assert all((r.batch_id, r.batch_pos) == divmod(place[r.email_id], 32) for r in got) and len(got) == 700
