"""Resampling, mixing and the Merkle manifest against brute force."""

import math
import random
import re
from collections import Counter
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from mailsift.llm import merkle, mixing, resampling

# Columns named like results and helpers must not get in the way.
NAMES = "score rank part idx size leaf root tree number start id pos n digest bucket hash".split()
SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def rows_of(n, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "été", "中文", "x1", "the", "of", "a" * 40]
    rows = []
    for i in range(n):
        size = rng.choice([0, 1, 5, 25, 60])
        text = " ".join(rng.choice(words) + rng.choice(["", "", ",", "\n", "\t-"]) for _ in range(size))
        source = rng.choice(["hot"] * 6 + ["b", "é", None, "", "Z"])
        rows.append((i, source, rng.choice(["en", None]), rng.choice([len(text), None]), text))
    rows += [(n, "one", "en", 1, "single source word"), (n + 1, None, None, None, None), (7, "b", "en", 3, "again 7")]
    rows += [(None, "hot", "en", 4, "no id here"), (3, "hot", "en", 5, "same row"), (3, "hot", "en", 5, "same row")]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in NAMES})


# --- resampling -------------------------------------------------------------------------------

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = WORD.findall(low)
    return words, [w.encode() for w in words] + [f"{a} {b}".encode() for a, b in zip(words, words[1:])]


def expected_draw(rows, target, percent=25, least=20):
    n = resampling.BUCKETS
    s, t = (Counter(crc32(f) % n for x in texts for f in features(x)[1]) for texts in ([r[4] for r in rows], target))
    s_all, t_all = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (s_all + n) / ((s[b] + 1) * (t_all + n))))

    out, drawn = [], []
    for r in rows:
        words, own = features(r[4])
        weight = sum(gain(crc32(f) % n) for f in own) // len(own) if own else 0
        score = None if r[0] is None else weight + resampling.noise(r[0])
        out.append([r[0], len(own), weight, score, None])
        if score is not None and len(words) >= least:
            drawn.append(out[-1])
    drawn.sort(key=lambda r: (-r[3], r[0]))
    for rank, r in enumerate(drawn[: percent * len(drawn) // 100], 1):
        r[4] = rank
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=lambda r: [str(v) for v in r])


def test_resampling_equals_brute_force(spark):
    rows = rows_of(200)
    target = ["Alpha beta été the of", None, "", "中文 x1 x1 unseen words"]
    items = spark.createDataFrame([(t,) for t in target], "text string")
    for parts in (1, 7):
        got = resampling.resample(table(spark, rows).repartition(parts), items)
        assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
        assert ordered(got.collect()) == ordered(expected_draw(rows, target))


def test_resampling_of_empty_tables(spark):
    none = table(spark, [])
    assert resampling.resample(none, none).count() == 0
    rows = rows_of(30)
    assert ordered(resampling.resample(table(spark, rows), none).collect()) == ordered(expected_draw(rows, []))


def test_head_has_no_effect_on_buckets(monkeypatch):
    texts = [r[4].encode() if r[4] else None for r in rows_of(60)]
    words = [w for own, _ in resampling.groups(texts) for w in own]
    pairs = list(zip(words, words[1:]))
    want = None
    for head in (resampling.Head([], []), resampling.Head(sorted(set(words))[::2], pairs), resampling.Head(sorted(set(words)), pairs)):
        got = Counter()
        for own, sizes in resampling.groups(texts):
            buckets, numbers = head.buckets_of(own, sizes)
            got.update(zip(numbers.tolist(), buckets.tolist()))
        want = want or got
        assert got == want
    expected = Counter((i, crc32(f) % resampling.BUCKETS) for i, t in enumerate(texts) for f in features(t.decode() if t else None)[1])
    assert want == expected


def test_long_texts_come_in_pieces(monkeypatch):
    text = ("Alpha beta-gamma " * 300 + "x" * 500 + " end").encode()
    whole = Counter(resampling.Head([], []).buckets_of(*next(resampling.groups([text])))[0].tolist())
    monkeypatch.setattr(resampling, "PIECE", 64)
    got = Counter()
    for words, sizes in resampling.groups([None, text, b"", text]):
        buckets, numbers = resampling.Head([], []).buckets_of(words, sizes)
        got.update(buckets[numbers == 3].tolist())
    assert got == whole
    assert sum(got.values()) == 2 * (300 * 3 + 2) - 1


def test_bounded_tables_keep_frequent_features(monkeypatch):
    monkeypatch.setattr(resampling, "COUNTED", 50)
    found = resampling._Frequent()
    rng = random.Random(3)
    for _ in range(40):
        found.add([b"the", b"of"] * 30 + [b"w%d" % rng.randrange(40) for _ in range(40)])
    rows = list(found.rows())
    assert max(rows, key=lambda r: r[2] if r[1] is None else 0)[0] in (b"the", b"of")
    assert (b"the", b"of") in [(a, b) for a, b, _ in rows]
    assert found.held <= resampling.COUNTED


# --- mixing -----------------------------------------------------------------------------------


def expected_mix(rows, seed=mixing.SEED):
    def size(text):
        return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))

    sources = sorted({r[1] for r in rows}, key=lambda s: (s is None, s))
    sizes = [sum(size(r[4]) for r in rows if r[1] == s) for s in sources]
    wanted = mixing.targets(sizes)
    out = []
    for source, total, target in zip(sources, sizes, wanted):
        own = [r for r in rows if r[1] == source]
        own.sort(key=lambda r: (
            sha256(f"{seed}:{'' if r[0] is None else r[0]}:{r[4] or ''}".encode()).hexdigest(), r[0] or 0))
        goal, at = int(target), 0
        for r in own:
            n = size(r[4])
            taken = 0
            if n:
                taken = goal // total * n + max(0, min(n, goal % total - at))
            at += n
            out.append((r[0], n, total, target, taken))
    return out


def test_targets_share_the_excess():
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([10]) == [10.0]
    # 5/8 of 110 is above 3 * 10; the excess goes to the others as 2 : 1.
    assert mixing.targets([10, 50, 50]) == [30.0, pytest.approx(160 / 3), pytest.approx(80 / 3)]
    rng = random.Random(2)
    for _ in range(200):
        sizes = [rng.choice([0, 1, 5, 100, 10_000]) for _ in range(rng.randint(1, 12))]
        got = mixing.targets(sizes)
        assert sum(got) == pytest.approx(sum(sizes))
        assert all(t <= 3 * s for t, s in zip(got, sizes))
        open_ = [i for i, s in enumerate(sizes) if got[i] < 3 * s]
        level = {round(got[i] / mixing.WEIGHTS[i % 3], 6) for i in open_}
        assert len(level) <= 1  # all that have no limit share by weight
        assert all(got[i] / mixing.WEIGHTS[i % 3] <= max(level, default=1e18) + 1e-6 for i in range(len(sizes)))


def test_mixing_equals_brute_force(spark):
    rows = rows_of(150)
    want = ordered(expected_mix(rows))
    for parts in (1, 5):
        got = mixing.mix_sources(table(spark, rows).repartition(parts))
        assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
        assert ordered(got.collect()) == want
    assert mixing.mix_sources(table(spark, [])).count() == 0
    none = mixing.mix_sources(table(spark, [(1, None, None, None, None), (2, "a", None, None, " ")])).collect()
    assert sorted((r.doc_id, r.size, r.target, r.taken) for r in none) == [(1, 0, 0.0, 0), (2, 0, 0.0, 0)]


def test_schedule_is_even_and_ranked(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_BITS", 6)
    wanted = [500.0, 200.0, 100.0, 0.0, 3.0]
    rows = mixing.schedule(spark, wanted, 803, str(tmp_path / "c")).orderBy("slot").collect()
    assert [r.slot for r in rows] == list(range(803))
    seen = Counter()
    for r in rows:
        assert r["rank"] == seen[r.number]
        seen[r.number] += 1
        if r.slot % 50 == 49:  # every beginning of the schedule is near the targets
            for i, w in enumerate(wanted):
                assert abs(seen[i] - (r.slot + 1) * w / 803) < 4
    assert seen[3] == 0


def test_mix_takes_each_block_once(spark):
    rows = [r for r in rows_of(60) if r[1] in ("hot", "b")]
    mix = mixing.Mix(table(spark, rows), block=7, least_slots=1)
    goal = {r.number: r.goal for r in mix.sources.collect()}
    block = {r.number: r.block for r in mix.sources.collect()}
    by_slot = {}
    for r in mix.mixed().collect():
        assert 0 <= r.from_word < r.to_word
        by_slot.setdefault((r.number, r.slot), 0)
        by_slot[r.number, r.slot] += r.to_word - r.from_word
    for number in goal:
        own = [n for (i, _), n in by_slot.items() if i == number]
        assert sum(own) == goal[number]
        assert sorted(own)[1:] == [block[number]] * (len(own) - 1)  # only the last may be shorter


# --- Merkle manifest --------------------------------------------------------------------------


def hashed(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row, lower=False):
    text = row[4]
    if lower and text is not None:
        text = text.translate({c: c + 32 for c in range(65, 91)})
    fields = [row[0], row[1], row[2], row[3], text]
    return hashed(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def tree(nodes):
    """The root, and for each leaf its siblings by level as (left, right)."""
    paths = [[] for _ in nodes]
    groups = [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        runs = [range(a, min(a + 16, len(nodes))) for a in range(0, len(nodes), 16)]
        for run in runs:
            for i in run:
                left = "".join(nodes[j] for j in run if j < i)
                right = "".join(nodes[j] for j in run if j > i)
                for k in groups[i]:
                    paths[k].append((left, right))
        groups = [[k for i in run for k in groups[i]] for run in runs]
        nodes = [hashed(*[nodes[i] for i in run]) for run in runs]
    return nodes[0], paths


def expected_manifest(rows):
    by_source = {}
    for r in rows:
        by_source.setdefault(r[1], []).append(r)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in by_source[s]])
    root, upper = tree([trees[s][0] for s in sources])
    out = []
    for number, s in enumerate(sources):
        for r, path in zip(by_source[s], trees[s][1]):
            steps = path + upper[number]
            value = leaf(r, r[0] is not None and crc32(str(r[0]).encode()) % 5 == 0)
            for left, right in steps:
                value = hashed(left, value, right)
            proof = hashed(*[a + b for a, b in steps])
            out.append((r[0], leaf(r), trees[s][0], root, proof, value, value == root))
    return out


def manifest(df, **options):
    tampered = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(df, F.when(changed, merkle.leaf_of(tampered)), **options)


@pytest.mark.parametrize("n", [0, 40, 400])
def test_manifest_equals_brute_force(spark, n):
    rows = rows_of(n)
    want = ordered(expected_manifest(rows))
    for parts in (1, 6):
        assert ordered(manifest(table(spark, rows).repartition(parts)).collect()) == want
    assert {w[-1] for w in want} == ({True, False} if n else {True})


def test_manifest_of_one_and_of_none(spark):
    assert manifest(table(spark, [])).count() == 0
    row = (5, None, None, None, None)
    got = manifest(table(spark, [row])).collect()
    assert [tuple(r) for r in got] == expected_manifest([row])
    many = [(i, f"s{i}", "en", 1, "A b") for i in range(300)]  # lone leaves, two levels of sources
    assert ordered(manifest(table(spark, many)).collect()) == ordered(expected_manifest(many))


def test_many_rounds_of_small_blocks(spark):
    rows = rows_of(700)  # blocks of 16 leaves: three rounds for the largest source
    many = rows + [(i, f"s{i}", "en", 1, "A b") for i in range(40)]
    assert ordered(manifest(table(spark, many), levels=1).collect()) == ordered(expected_manifest(many))


def test_sweeps_hold_a_run_per_level():
    rng = random.Random(1)
    for size in (1, 2, 16, 17, 255, 257, 4096):
        leaves = [b"%032x" % rng.getrandbits(128) for _ in range(size)]
        root, nodes = merkle.sweep(leaves, merkle.height(size))
        want, paths = tree([d.decode() for d in leaves])
        assert root.decode() == want
        labels = [(end, level) for end, level, _ in nodes]
        assert labels == sorted(labels)
        found = dict(merkle.reversed_sweep(size, nodes, merkle.height(size), None))
        assert len(found) == size
        for i in rng.sample(range(size), min(size, 40)):
            suffix = found[i]
            got = [(s.left.decode(), s.right.decode()) for s in suffix.path()] if suffix else []
            assert got == paths[i]
            assert merkle.fold(leaves[i], suffix) == root
