"""The pipeline's stages and the whole of it against plain Python, on a small table with edge rows."""

import random
import re
from hashlib import sha256

import public_tokenizers
import pytest
from test_operators import brute_components
from tokenizers import Tokenizer

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ENGLISH = "the house with a green door stands near our river and every morning people walk there slowly".split()
FRENCH = "la maison avec une porte verte est près de notre rivière où chaque matin les gens marchent".split()
SECRET = "token=abcdef123456"


def table(rng):
    """Rows, and the benchmark items."""
    items = [" ".join(rng.choice(ENGLISH) + str(rng.randrange(900)) for _ in range(25)) for _ in range(3)]
    texts = []
    for i in range(70):
        words = rng.choices(ENGLISH if i % 2 else FRENCH, k=rng.randint(12, 90))
        texts.append((" ".join(words), "en" if i % 2 else "fr"))
    for i in range(10):  # copies, and copies with one word changed
        words = texts[i][0].split()
        texts.append((" ".join(words), texts[i][1]))
        words[rng.randrange(len(words))] = "other"
        texts.append((" ".join(words), texts[i][1]))
    for item in items:
        texts.append((f"{texts[3][0][:60]} {item} {texts[5][0][:80]}", "en"))
    texts += [(f"{texts[20][0]} my {SECRET} is here", "fr"), (f"{texts[21][0]} so " + "".join(f"%{ord(c):02x}" for c in SECRET), "en")]
    texts += [("12 34 56", "en"), ("", "en"), (None, "fr"), (" \n", None), ("word", "en")]
    rows = [(i, t, lang, f"s{i % 3}", len(t or "")) for i, (t, lang) in enumerate(texts)]
    rows += [(None, texts[30][0], "fr", None, 3), (None, None, None, None, None)]
    rows += [(5, texts[40][0] + " again", "fr", "s1", 9), (31, texts[31][0], "en", "s1", rows[31][4])]
    return rows, items


def near_copies(rows):
    """The smallest id of each group stays; rows with equal ids are one document, null ids all stay."""
    known = [r for r in rows if r[0] is not None]
    found = brute_components([r[1] for r in known])
    # Join what equal ids join.
    group = {}
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for at, r in enumerate(known):
        group.setdefault(("id", r[0]), []).append(at)
        group.setdefault(("component", found[at][1]), []).append(at)
    for members in group.values():
        for at in members[1:]:
            parent[root(at)] = root(members[0])
    least = {}
    for at, r in enumerate(known):
        least[root(at)] = min(least.get(root(at), r[0]), r[0])
    kept = list({r[0]: r for at, r in enumerate(known) if r[0] == least[root(at)]}.values())
    return kept + [r for r in rows if r[0] is None]


def expected(rows, items):
    rows = [r for r in rows if r[1] and any(map(str.isalpha, r[1]))]
    rows = near_copies(rows)
    words = [re.findall(r"\w+", i) for i in items]
    held = lambda t: any(" ".join(w) in " ".join(re.findall(r"\w+", t)) for w in words)
    rows = [r for r in rows if not held(r[1])]
    hidden = "".join(f"%{ord(c):02x}" for c in SECRET)
    return [(r[0], r[1].replace(SECRET, "[SECRET]").replace(hidden, "[SECRET]")) for r in rows]


def digests(pairs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in pairs:
        ids = library.encode(text, add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        out.append((doc, len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, items = table(random.Random(12))
    path = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), rows, items


def test_run_equals_plain_python(spark, folder):
    path, rows, items = folder
    got = corpus_pipeline.run(spark, path).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    # Of the two rows with id 5 either text may stay; all others are determined by the plain version.
    want = digests(expected(rows, items))
    found = sorted([tuple(r) for r in got.collect() if r.doc_id != 5], key=str)
    assert found == [w for w in want if w[0] != 5]


def test_stages_keep_the_columns_of_documents(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns, name
        clean = [r[0] for r in rows[:1] + rows[41:60]]  # 40 is near one of the rows with id 5
        assert set(clean) <= {r.doc_id for r in kept.collect()}, name
    redacted = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.STAGES[3][1](spark, docs, path).collect()}
    assert all(t is None or (SECRET not in t and n == len(t)) for t, n in redacted.values())
    assert redacted[None][0] is None or redacted[None][1] == len(redacted[None][0])


def test_stages_on_an_empty_table(spark, folder):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, path).count() == 0, name


def test_near_copies_of_the_tables_own_columns(spark, folder):
    path, rows, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = corpus_pipeline.STAGES[1][1](spark, docs, path).collect()
    want = near_copies(rows)
    assert sorted([r.doc_id for r in kept], key=str) == sorted({w[0] for w in want if w[0] is not None}, key=str) + [None] * 2
    by_id = {r.doc_id: r.text for r in kept if r.doc_id is not None}
    assert all(by_id[w[0]] == w[1] for w in want if w[0] not in (5, None))
