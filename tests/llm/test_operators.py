"""Operators for training data against brute force, on edge rows and random texts."""

import base64
import bz2
import gzip
import lzma
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece
import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailsift.llm import (
    bpe, chat, decontaminate, jaccard_join, language_id, piece_counts, quality_rules, secret_scan,
    token_files, toxicity,
)

LETTERS = "aÀéß 0½²'sS\n\t\r\x0b\x1c\x85\xa0 　.,<|>µªﬁΣİ中文😀é_-%▁"
EDGES = [None, "", " ", "a", "<|endoftext|>", "x" * 5000, "ab " * 3000, "same text", "same text"]


def random_texts(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice(LETTERS) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def documents(spark, texts, **extra):
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    # Columns named like results and helpers must not get in the way.
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string").withColumns(
        {"ids": F.lit(1), "score": F.lit("s"), "key": F.lit(0), "lang": F.lit("en"), **extra}
    )


@pytest.fixture(scope="module")
def texts():
    return EDGES + random_texts(300)


def test_bpe_equals_library(spark, texts):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    encoded = bpe.bpe_encode(documents(spark, texts), path)
    want = {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in encoded.collect()} == want
    decoded = {r.doc_id: r.text for r in bpe.bpe_decode(encoded, path).collect()}
    assert decoded == {i: library.decode(v, skip_special_tokens=False) for i, v in want.items()}
    assert bpe.bpe_round_trip(documents(spark, []), path).count() == 0


def test_segment_tree_of_long_words():
    tool = bpe.ByteBpe(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for word in ("ab" * 700, "z" * 3001, "thequickbrown" * 50):
        assert tool.encode(word) == library.encode(word, add_special_tokens=False).ids


def test_piece_counts_equal_library(spark, texts):
    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = piece_counts.token_counts(documents(spark, texts), path, limit=100).collect()
    for r in rows:
        text = texts[r.doc_id] or ""
        n = len(library.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert len(rows) == len(texts)


def test_token_files_round_trip(spark, texts, tmp_path):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    shuffled = documents(spark, texts).orderBy(F.rand(3))
    token_files.write_token_files(shuffled, path, str(tmp_path))
    rows = token_files.read_token_files(spark, str(tmp_path), with_ids=True).collect()
    start = 0
    for r in sorted(rows, key=lambda r: r.doc_id):
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [2]
        assert (r.ids, r.start, r.n_tokens) == (ids, start, len(ids))
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert len(rows) == len(texts)


def test_value_coding():
    values = np.array([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1, 7, 9], dtype=np.uint32)
    for n in range(len(values) + 1):
        control, data = token_files.code_values(values[:n])
        keep = np.arange(4 * len(control)) < n
        back = token_files.decode_values(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), keep)
        assert back.tolist() == values[:n].tolist()


def library_ids(encoder, texts):
    return [encoder.packed(encoder.library.encode(t, add_special_tokens=False).ids) + encoder.end for t in texts]


def test_word_encoder_equals_library_on_odd_texts():
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    pieces = [
        "'s", "'re", "'ll", "'", "''", "s", "e", "LL", " ", "\n", "\x00", "\x1f", "\x85", "\xa0", "²", "½", "9", "É", "ß",
        "Ⱥ", "Ⱦ", "İ", "ı", "ª", "µ", "×", "ǅ", "!", "...", "<|", "<|endoftext|>", "Å", "ẞ", "漢", "\u0301", "the",
    ]
    draw = random.Random(5)
    mixed = ["".join(draw.choices(pieces[: draw.choice([24, 36])], k=draw.randrange(12))) for _ in range(3000)]
    # Lower-casing takes these two out of the range of characters that are split here.
    texts = ["", "'", "x'", "'r", "aȺb", "aȾb c", *mixed, "漢"]
    assert encoder.encode_all(texts) == library_ids(encoder, texts)
    assert encoder.encode_all([]) == []
    for text in ("'", "'l", "", "漢"):
        assert encoder.encode_all([text]) == library_ids(encoder, [text])


def test_word_encoder_learns_each_word_once(monkeypatch):
    encoder = token_files.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    learned = []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda words: learned.extend(words.to_pylist()) or learn(words))
    monkeypatch.setattr(token_files, "CHUNK_BYTES", 64)
    texts = [f"word{chr(97 + i % 7)} other{chr(97 + i % 5)}, it's {i % 10}" for i in range(400)]
    assert encoder.encode_all(texts) == library_ids(encoder, texts)
    assert len(learned) == len(set(learned)) == 7 + 5 + 10 + 3
    # With a smaller table, words are forgotten and learned again.
    monkeypatch.setattr(token_files, "TABLE_LIMIT", 8)
    assert encoder.encode_all(texts) == library_ids(encoder, texts)
    assert len(encoder.words) <= 8 + 7 + 5 + 10 + 3


def test_codes_of_many_documents_equal_those_of_each():
    draw = random.Random(6)
    for _ in range(100):
        counts = [draw.choice([0, 1, 2, 3, 4, 5, 9]) for _ in range(draw.randrange(8))]
        values = np.array(draw.choices([0, 255, 256, 65535, 65536, 1 << 24, (1 << 32) - 1], k=sum(counts)), np.uint32)
        each = [token_files.code_values(v) for v in np.split(values, np.cumsum(counts)[:-1])] if counts else []
        controls, datas = token_files.code_documents(values, counts)
        assert list(zip(controls, datas)) == each


def test_ids_are_coded_in_steps(monkeypatch):
    kind, draw = np.dtype("<u2"), random.Random(7)
    ranks = np.random.default_rng(7).permutation(1 << 16).astype(np.uint32)
    ids = [np.array([draw.randrange(1 << 16) for _ in range(n)], kind) for n in (3, 1, 9, 1, 1, 2, 5, 6, 1)]
    column = pa.array([b"left out", *(i.tobytes() for i in ids)], pa.binary())[1:]
    monkeypatch.setattr(token_files, "STEP_IDS", 5)
    controls, datas = token_files.code_column(column, ranks, kind)
    assert list(zip(controls, datas)) == [token_files.code_values(ranks[i]) for i in ids]
    assert token_files.code_column(column[:0], ranks, kind) == ([], [])


def test_secret_layers():
    secret = "token=abcdef123456"
    b64 = base64.b64encode(secret.encode()).decode()
    packed = base64.b64encode(gzip.compress(secret.encode())).decode()
    nested = base64.b64encode(f"see {b64} there".encode()).decode()
    for inner in (b64, packed, nested):
        text = f"é before {inner} after"
        base, spans, cut = secret_scan.all_spans(text)
        assert base == [] and cut == 0 and len(spans) == 1
        kind, a, b = spans[0]
        assert kind == "assign" and text.index(inner) <= a < b <= text.index(inner) + len(inner)
    escaped = "x " + "".join(f"%{ord(c):02X}" for c in secret) + " y"
    assert secret_scan.all_spans(escaped)[1] == [("assign", 2, 2 + 3 * len(secret))]
    escaped = "x " + "".join(f"\\u{ord(c):04x}" for c in secret)
    assert secret_scan.all_spans(escaped)[1] == [("assign", 2, 2 + 6 * len(secret))]
    twice = f"{b64} {b64}"
    assert len(secret_scan.all_spans(twice)[1]) == 2
    assert secret_scan.masked("a token=abcdef1 b", [("assign", 2, 15)]) == "a [SECRET] b"


PACKERS = [gzip.compress, zlib.compress, bz2.compress, lzma.compress, zstandard.ZstdCompressor().compress]


def test_secret_layers_packed_twice_and_in_later_members():
    secret = b"token=abcdef123456"

    def kinds(raw):
        inner = base64.b64encode(raw).decode()
        base, spans, cut = secret_scan.all_spans(f"see {inner} end")
        assert base == [] and cut == 0
        return [(k, a, b) for k, a, b in spans] == [("assign", 4, 4 + len(inner))]

    for outer in PACKERS:
        assert kinds(outer(b"first member ") + outer(secret))
        assert kinds(outer(b"token=abc") + outer(b"def123456"))
        text = base64.b64encode(outer(b"first") + b"\x00" * 3 + b" " + secret).decode()
        assert [s[0] for s in secret_scan.all_spans(text)[1]] == ["assign"]
        for inner in PACKERS:
            assert kinds(outer(inner(secret)))
            assert kinds(outer(b"first") + inner(secret))
            assert kinds(outer(inner(gzip.compress(b"x") + zlib.compress(secret))))


def test_secret_layers_in_glued_wrapped_and_binary_runs():
    secret = b"token=abcdef123456"

    def spans_in(text):
        base, spans, cut = secret_scan.all_spans(text)
        assert base == [] and cut == 0
        return spans

    plain = base64.b64encode(secret).decode()
    for before in ("https://h/dl/", "sess-", "key_", "x/", "abcd", "a", "\\n"):
        for after in ("", "/x", " y"):
            at = len(before)
            assert spans_in(f"{before}{plain}{after}") == [("assign", at, at + 24)]
            for pack in PACKERS:
                inner = base64.b64encode(pack(secret)).decode()
                (kind, a, b), *others = spans_in(f"{before}{inner}{after}")
                assert not others and kind == "assign" and a == at
                assert 0 <= b - at - len(inner.rstrip("=")) <= 2
    for raw in (b"\x00" + secret, b"\xff\xfe" + secret + b"\x01", "é\x07".encode() + secret):
        inner = base64.b64encode(raw).decode()
        (kind, a, b), = spans_in(f"é {inner} z")
        start = raw.index(secret)
        assert (kind, a, b) == ("assign", 2 + start * 8 // 6, 2 - (-(start + 18) * 8 // 6))
    rng = random.Random(7)
    noise = "".join(rng.choice("ghijk mnop") for _ in range(300)).encode()
    for stop in ("\n", "\r\n", "\n  ", "\n> ", "\\n"):
        for size in range(40, 60):
            for raw in (b" " * size + secret, gzip.compress(noise + secret)):
                inner = base64.b64encode(raw).decode()
                text = "Data:" + stop + stop.join(inner[i : i + 76] for i in range(0, len(inner), 76)) + stop
                (kind, a, b), = spans_in(text)
                got = text[a:b].replace(stop, "").replace("=", "")
                if raw[:1] == b" ":
                    assert got == inner[size * 8 // 6 : -(-(size + 18) * 8 // 6)].replace("=", "")
                else:
                    assert got == inner.replace("=", "")


def test_large_packed_parts_are_searched_in_windows(monkeypatch):
    monkeypatch.setattr(secret_scan, "WINDOW", 1 << 12)
    monkeypatch.setattr(secret_scan, "OVERLAP", 1 << 8)
    monkeypatch.setattr(secret_scan, "PIECE", 1 << 9)
    monkeypatch.setattr(secret_scan, "FEED_ZSTD", 1 << 4)
    raw = b"word " * (1 << 17) + b"token=abcdef123456" + b" word" * 1000
    for data in (gzip.compress(raw), bz2.compress(raw), b"x" + zlib.compress(raw), gzip.compress(gzip.compress(raw))):
        inner = base64.b64encode(data).decode()
        base, spans, n_cut = secret_scan.all_spans(f"é {inner} end")
        assert base == [] and n_cut and [k for k, _, _ in spans] == ["assign"]
        out = secret_scan.redacted(f"é {inner} end")
        assert out.startswith("é ") and out.endswith("[SECRET] end") and len(out) < 20
    for at in range(0, 4300, 97):  # wherever a window ends
        packed = base64.b64encode(zlib.compress(b"x" * at + b" token=abcdef123456 " + b"y" * 9000)).decode()
        assert [k for k, _, _ in secret_scan.all_spans(packed)[1]] == ["assign"]
    escaped = "".join(f"%{ord(c):02X}" for c in base64.b64encode(gzip.compress(raw)).decode())
    assert secret_scan.redacted(f"a {escaped} b") == "a [SECRET] b"


def percent(raw):
    return "".join(f"%{b:02x}" for b in raw)


def slash_x(raw):
    return "".join(f"\\x{b:02x}" for b in raw)


def slash_u(raw):
    return "".join(f"\\u{b:04x}" for b in raw)


def entity(raw):
    return "".join(f"&#{b};" for b in raw)


WRAPPERS = [percent, slash_x, slash_u, entity, lambda raw: base64.b64encode(raw).decode()]


def test_secrets_under_every_pair_of_wrappers():
    secret = b"token=abcdef123456"
    for outer in WRAPPERS:
        assert {k for k, _, _ in secret_scan.all_spans(f"a {outer(secret)} b")[1]} == {"assign"}
        for inner in WRAPPERS:
            text = f"a {outer(inner(secret).encode())} b"
            spans = [s for s in secret_scan.all_spans(text)[1] if s[0] == "assign"]
            assert spans and all(2 <= a < b <= len(text) - 2 for _, a, b in spans), (outer, inner)
    for pack in PACKERS:
        packed = pack(secret)
        for outer in (percent, slash_x):
            text = f"a {outer(packed)} b"
            spans = secret_scan.all_spans(text)[1]
            assert ("assign", 2, len(text) - 2) in spans, (pack, outer)
            again = f"a {outer(base64.b64encode(packed))} b"
            assert "assign" in [k for k, _, _ in secret_scan.all_spans(again)[1]]
        import urllib.parse

        quoted = f"x={urllib.parse.quote(packed)}&y"
        assert "assign" in [k for k, _, _ in secret_scan.all_spans(quoted)[1]]
        shown = f"data = {packed!r}"
        assert "assign" in [k for k, _, _ in secret_scan.all_spans(shown)[1]]


def test_escapes_of_escapes_take_linear_time():
    import time

    for levels, limit in ((4_000, 0.5), (50_000, 4.0)):
        for chain_, end in (("%" + "25" * levels, "74oken=abcdef123456"), ("\\" + "x5c" * levels, "x74oken=abcdef123456"),
                            ("\\" + "u005c" * levels, "u0074oken=abcdef123456"), ("&" + "#38;" * levels, "#116;oken=abcdef123456")):
            started = time.perf_counter()
            spans = [s for s in secret_scan.all_spans(f"a {chain_}{end} b")[1] if s[0] == "assign"]
            assert spans == [("assign", 2, 2 + len(chain_) + len(end))]
            assert time.perf_counter() - started < limit
    mixed = "%5cx25" * 300 + "41"  # signs in turn: one level at a time
    secret_scan.all_spans(mixed)


def test_base_spans_equal_plain_search():
    """On every document of the smallest table, against the patterns written out again."""
    import duckdb

    texts = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    assign = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
    found = 0
    for (text,) in texts:
        text = text or ""
        want = [("assign", *m.span()) for m in re.finditer(assign, text, re.ASCII) if len(m[1]) >= 6]
        want += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
        base, spans, _ = secret_scan.all_spans(text)
        assert sorted(base) == sorted(want) and set(base) <= set(spans)
        found += len(base)
    assert found


def test_secret_scan_rows(spark):
    texts = [None, "", "PassWord: 'hunter22'", "ſecret=abcdefgh", "token=abc", "AKIA" + "A" * 16, "f" * 24, "f" * 23]
    rows = {r.doc_id: r for r in secret_scan.scan_secrets(documents(spark, texts)).collect()}
    kinds = [[s.kind for s in rows[i].base] for i in range(len(texts))]
    assert kinds == [[], [], ["assign"], [], [], ["access"], ["hex"], []]
    redacted = {r.doc_id: r.text for r in secret_scan.redact_secrets(documents(spark, texts)).collect()}
    assert redacted[0] is None and redacted[6] == "[SECRET]" and redacted[7] == texts[7]


def test_chat_folds_events(spark):
    log = spark.createDataFrame(
        [
            (1, 1, 1, "message", "user", "hi <|im_end|> \\"), (1, 2, 2, "message", "assistant", "dr"),
            (1, 3, 2, "delta", None, "aft"), (1, 4, 2, "regenerate", None, None),
            (1, 5, 2, "delta", None, "new "), (1, 6, 2, "delta", None, "answer"),
            (1, 7, 1, "edit", None, "hello <|im_start|>"), (1, 8, 3, "regenerate", "assistant", None),
            (None, 1, 1, "message", None, None),
        ],
        "conv_id long, seq long, message long, kind string, role string, text string",
    )
    parsed = {r.conv_id: r for r in chat.read_formatted(chat.format_chats(log)).collect()}
    assert [(t.role, t.text) for t in parsed[1].turns] == [
        ("user", "hello <|im_start|>"), ("assistant", "new answer"),
    ]
    assert parsed[1].loss_texts == ["new answer"]
    assert [(t.role, t.text) for t in parsed[None].turns] == [("", "")]
    assert chat.format_chats(log.limit(0)).count() == 0


def test_quality_edges(spark):
    line = "This line has quite enough words to be a sentence of its own here."
    texts = [None, "", " \n ", line + "\n" + line, "\n".join(f"{i} {line}" for i in range(9)), "a | b | c | d"]
    rows = {r.doc_id: r for r in quality_rules.quality(documents(spark, texts)).collect()}
    assert [rows[i].n_words for i in (0, 1, 2)] == [0, 0, 0]
    assert all(rows[i].base_failed and not rows[i].kept for i in (0, 1, 2))
    assert rows[3].n_dup_lines == 1 and rows[3].n_repeat_words == 28
    assert rows[4].n_lines_kept == 9 and rows[5].n_lines_kept == 0


def test_language_id(spark):
    english, german = "the cat and the dog were there", "der hund und die katze waren nicht da"
    df = documents(spark, [english, german] * 20 + [None, "", "123 !!", "the dog", "die katze"])
    df = df.withColumn("lang", F.when(F.col("doc_id") < 40, F.when(F.col("doc_id") % 2 == 0, "en").otherwise("de")))
    model = language_id.learn(language_id.learned_rows(df))
    rows = {r.doc_id: r for r in language_id.identify(df, model).collect()}
    assert [rows[i].lang_pred for i in range(40, 45)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in rows.values()) and len(rows) == 45
    nothing = language_id.learn(df.where("lang = 'none'"))
    assert {r.lang_pred for r in language_id.identify(df, nothing).collect()} == {"und"}
    assert language_id.keep_identified(df, model).count() == 42


def test_decontamination(spark):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(3000)]
    items = [" ".join(rng.sample(words, n)) for n in (12, 30, 45, 70, 200)]
    noise = [" ".join(rng.choice(words) for _ in range(300)) for _ in range(20)]
    texts = [f"{noise[i]} {t.upper()} {noise[i + 5]}" for i, t in enumerate(items)] + noise + [None, ""]
    benchmark = spark.createDataFrame([*enumerate(items), (8, None), (9, "")], "item_id long, text string")
    parts = decontaminate.benchmark_parts(benchmark)
    found = decontaminate.find_contamination(documents(spark, texts), parts).collect()
    assert sorted((r.doc_id, r.item_id) for r in found) == [(i, i) for i in range(5)]
    kept = decontaminate.remove_contaminated(documents(spark, texts), parts)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(5, len(texts)))
    assert decontaminate.find_contamination(documents(spark, texts), []).count() == 0


def test_parts_of_a_benchmark_match_like_the_whole(spark, monkeypatch):
    rng = random.Random(21)
    words = [f"w{i}" for i in range(300)]
    items = [" ".join(rng.choices(words, k=rng.randint(3, 60))) for _ in range(40)]
    texts = []
    for i in items:
        own = i.split()
        for _ in range(rng.randint(0, len(own) // 3)):
            own[rng.randrange(len(own))] = "other"
        texts.append(" ".join(rng.choices(words, k=50) + own + rng.choices(words, k=50)))
    df = documents(spark, texts)
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")

    def found(parts):
        return sorted(map(tuple, decontaminate.find_contamination(df, parts).collect()))

    whole = found(decontaminate.benchmark_parts(benchmark))
    monkeypatch.setattr(decontaminate, "PART_WORDS", 200)
    parts = decontaminate.benchmark_parts(benchmark.repartition(7))
    assert len(parts) > 3 and found(parts) == whole and len(whole) > 10


def test_decontamination_of_short_items():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    items = [rng.sample(words[:200], n) for n in (1, 2, 3, 4, 5, 7)]
    rows = [(n, own, max(1, len(own) // 4)) for n, own in enumerate(items)]
    long = rng.sample(words[:200], 14)
    rows += [(10, long, 12), (11, long[:3], 2)]  # a question of two words; one of a single word
    index = decontaminate.Index(rows)
    noise = lambda: rng.choices(words[200:], k=rng.randint(0, 150))
    for number, own, _ in rows:
        text = " ".join([*noise(), *own, *noise()])
        want = {i for i, other, _ in rows if any(own[k : k + len(other)] == other for k in range(len(own)))}
        assert number in want and set(index.matches([text])[0]) == want
        if 1 < len(own) < decontaminate.SHORT_ITEM:
            broken = " ".join([*noise(), *own[:-1], words[-1], own[-1], *noise()])
            assert number not in index.matches([broken])[0]
    assert index.matches(["", " ".join(words[200:])]) == [{}, {}]


def test_toxicity(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=30)) + (" vileword" if i % 4 == 0 else "") for i in range(200)]
    df = documents(spark, texts + [None, "", "99 new1 new2"])
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    examples = toxicity.fit(df, labels)
    rows = {r.doc_id: r for r in toxicity.score_toxicity(df, examples).collect()}
    assert all(rows[i].predicted == int(i % 4 == 0) for i in range(200))
    assert rows[200].score == rows[201].score == rows[202].score == examples.prior
    learned = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    assert sorted(examples.ids) == learned  # both classes, whatever their words
    assert not set(rows[0].evidence) - set(learned)
    assert toxicity.fit(df, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_toxicity(df, None).collect()} == {0.0}


def test_toxicity_of_null_and_repeated_ids(spark):
    rows = [(i, "clean words here" if i % 2 else "vile words here") for i in range(40)]
    rows += [(None, "vile words"), (3, "another clean text"), (3, "clean words here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(i, 1 - i % 2) for i in range(40)] + [(3, 1)], "doc_id long, toxic int")
    examples = toxicity.fit(df, labels)
    found = toxicity.score_toxicity(df, examples).collect()
    assert len(found) == 43 and [r.predicted for r in found if r.doc_id is None] == [1]
    assert toxicity.score_toxicity(df.limit(0), examples).count() == 0


def brute_toxicity(train, texts):
    """Scores by plain dictionaries: cosine to every example, ties to the earlier one in index order."""
    bags = [(Counter(re.findall(r"\w+", t.lower())), label) for _, t, label in train]
    n = [sum(1 for _, label in bags if label == k) for k in (0, 1)]
    held = [Counter(w for bag, label in bags if label == k for w in bag) for k in (0, 1)]
    weight = {}
    for w in held[0] | held[1]:
        a, b = held[1][w], held[0][w]
        below = (a + b) * (sum(n) - a - b) * n[0] * n[1]
        chi2 = sum(n) * (a * (n[0] - b) - b * (n[1] - a)) ** 2 / below if below else 0
        weight[w] = math.log(1 + sum(n) / (a + b)) * math.sqrt(max(0, chi2 - toxicity.CHANCE))

    def vector(bag):
        v = {w: (1 + math.log(k)) * weight.get(w, 0) for w, k in bag.items()}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items() if x} if norm else {}

    vectors = [vector(bag) for bag, _ in bags]
    out = []
    for t in texts:
        own = vector(Counter(re.findall(r"\w+", (t or "").lower())))
        out.append([round(sum(x * v.get(w, 0) for w, x in own.items()), 9) for v in vectors])
    return out


def test_scores_equal_brute_force_on_documents(spark):
    sf = "/root/testdata/sf0.001"
    documents_, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    texts = {r.doc_id: r.text for r in documents_.collect()}
    toxic = {r.doc_id: r.toxic for r in labels.collect() if r.toxic is not None}
    train = [(i, texts[i] or "", toxic[i]) for i in sorted(toxic) if i in texts and zlib.crc32(str(i).encode()) % 5]
    examples = toxicity.fit(documents_, labels)
    assert sorted(examples.ids) == [i for i, _, _ in train]
    order = sorted(texts)[:80]
    for i, cosines in zip(order, brute_toxicity(train, [texts[i] for i in order])):
        found, at = examples.nearest(toxicity.words_of(texts[i] or ""))
        by_id = dict(zip([t[0] for t in train], cosines))
        want = sorted((c for c in cosines if c > 0), reverse=True)[: toxicity.NEIGHBOURS]
        assert list(found) == pytest.approx(want, abs=1e-7)
        assert [by_id[examples.ids[k]] for k in at] == pytest.approx(want, abs=1e-7)
        if want:
            label = np.array([toxic[examples.ids[k]] for k in at])
            square = found**2 * examples.stands_for[at]
            score = (square @ label + toxicity.PRIOR_WEIGHT * examples.prior) / (square.sum() + toxicity.PRIOR_WEIGHT)
            assert examples.score(texts[i])[0] == pytest.approx(min(1, max(0, score)))


def test_nearest_equals_brute_force_cosine():
    rng = random.Random(8)
    names = [f"t{i}" for i in range(60)]
    weight = np.array([rng.choice([0.0, rng.uniform(0.1, 5)]) for _ in names])
    pick = lambda: {w: rng.randint(1, 4) for w in rng.sample(names, rng.randint(1, 12))}
    bags = [pick() for _ in range(400)]
    bags += bags[:40]  # copies tie
    rows = [(i, rng.randint(0, 1)) for i in range(len(bags))]
    owner = np.array([i for i, bag in enumerate(bags) for _ in bag])
    word = np.array([names.index(w) for bag in bags for w in bag])
    tf = np.array([n for bag in bags for n in bag.values()], dtype=float)
    index = toxicity.Examples(names, weight, rows, owner, word, tf, {0: 2.0, 1: 1.0}, 0.1)

    def vector(bag):
        v = np.zeros(len(names))
        for w, n in bag.items():
            v[names.index(w)] = (1 + math.log(n)) * weight[names.index(w)]
        return v / (np.sqrt(v @ v) or 1)

    vectors = np.array([vector(bags[i]) for i in index.ids])
    for _ in range(200):
        query = pick()
        cosine = np.round(vectors @ vector(query), 9)
        want = np.lexsort((np.arange(len(cosine)), -cosine))[: toxicity.NEIGHBOURS]
        want = want[cosine[want] > 0]
        found, at = index.nearest(query)
        assert list(found) == pytest.approx(cosine[want], abs=1e-8)
        assert list(cosine[at]) == pytest.approx(cosine[want], abs=1e-8)


def brute_components(texts):
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= 75 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


def test_jaccard_components(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    passage = " ".join(rng.choices(words, k=60))
    texts = [None, "", " ", "a b", "a b", "a b c d e", "a b c d e f"]
    for _ in range(25):
        base = rng.choices(words, k=rng.randint(4, 120))
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    texts += [f"{passage} {' '.join(rng.choices(words, k=rng.randint(0, 30)))}" for _ in range(40)]
    texts += [texts[-1]] * 5
    found = jaccard_join.jaccard_components(documents(spark, texts))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts)


def test_keys_of_frequent_tokens_lose_no_link():
    rng = np.random.default_rng(4)
    pool = np.unique(rng.integers(0, 1 << 48, 4000).astype(np.uint64))
    for share in (0.0, 0.5, 0.9, 1.0):
        # Tokens that are frequent, and how many documents have the others.
        counts = np.where(rng.random(len(pool)) < share, jaccard_join.FREQUENT, rng.integers(2, 65, len(pool)))

        def keys(own, other):
            count = counts[np.searchsorted(pool, own)]
            alone = (count < jaccard_join.FREQUENT) & ~np.isin(own, other) & (own % 2 == 0)
            shared, count = own[~alone], count[~alone]
            order = np.lexsort((shared, count))
            found = jaccard_join.keys_of(shared[order], count[order], len(own))
            frequent = shared[count == jaccard_join.FREQUENT]
            assert found[2] is None or 100 * len(frequent) >= 75 * len(own)
            return found, len(own) - len(frequent), frequent

        def first_places(x, y, na, nb):
            """Whether some common key stands where the first one of a link of these sizes can."""
            needed = -(-75 * (na + nb) // 175)
            for kind in (0, 1):
                more = (0, na + nb - 2 * needed)[kind]
                at = [dict(zip(k[kind].tolist(), k[3][kind and len(k[0]):])) for k in (x, y)]
                if any(at[0][k] <= na - needed + more and at[1][k] <= nb - needed + more for k in set(at[0]) & set(at[1])):
                    return True
            return False

        for _ in range(400):
            a = np.unique(rng.choice(pool, rng.integers(1, 60), replace=False))
            b = np.union1d(a[rng.random(len(a)) > 0.12], rng.choice(pool, rng.integers(0, 8)))
            if jaccard_join.linked(a, b) and not np.array_equal(a, b):
                (x, r, f), (y, s, _) = keys(a, b), keys(b, a)
                common = first_places(x, y, len(a), len(b))
                assert common or (x[2] == y[2] and x[2] and len(f) >= 3 * (r + s))


def test_frequent_passages_do_not_join_texts(spark, monkeypatch):
    """A passage in a third of the texts: those that link by it alone, and those that do not."""
    monkeypatch.setattr(jaccard_join, "RARE", 4)
    monkeypatch.setattr(jaccard_join, "GROUP_TOKENS", 900)
    rng = random.Random(8)
    words = [f"w{i}" for i in range(3000)]
    passage = rng.choices(words, k=60)
    texts = []
    for i in range(60):
        texts.append(" ".join(passage + rng.choices(words, k=rng.choice([0, 1, 3, 5, 9, 12, 15, 60]))))
        texts.append(" ".join(passage[: rng.choice([40, 50, 55])] + rng.choices(words, k=rng.choice([0, 2, 8]))))
        texts.append(" ".join(rng.choices(words, k=70)))
        near = list(passage)
        near[rng.randrange(60)] = "x"
        texts.append(" ".join(near))
    found = jaccard_join.jaccard_components(documents(spark, texts).repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == brute_components(texts)


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 48, rng.integers(1, 300)).astype(np.uint64))
        b = np.union1d(a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 48, 20).astype(np.uint64))
        differ = np.unpackbits((jaccard_join.bitmap(a) ^ jaccard_join.bitmap(b)).view(np.uint8)).sum()
        assert differ <= len(np.setxor1d(a, b))


def test_slices_are_bounded():
    sizes = [5, jaccard_join.SLICE, jaccard_join.SLICE * 3, 1, 1, 0, jaccard_join.SLICE - 2, 9]
    found = list(jaccard_join.slices(sizes))
    assert [i for a, b in found for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= jaccard_join.SLICE or b - a == 1 for a, b in found)
    assert list(jaccard_join.slices([])) == []


def test_jaccard_null_and_repeated_ids_and_empty_tables(spark):
    assert jaccard_join.jaccard_components(documents(spark, [])).count() == 0
    rows = [(1, "a b c d e f g h"), (1, "q r s t u v w x y"), (2, "a b c d e f g h"), (None, "a b c d e f g h"),
            (3, "q r s t u v w x y"), (None, None), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("x"))
    found = sorted(map(tuple, jaccard_join.jaccard_components(df).collect()), key=str)
    want = [(1, 4, 1), (1, 5, 1), (2, 4, 1), (None, 4, None), (3, 5, 1), (None, 0, None), (4, 0, 4), (5, 0, 5)]
    assert found == sorted(want, key=str)
    kept = jaccard_join.one_of_each(df).collect()
    assert sorted([r.doc_id for r in kept], key=str) == sorted([1, 4, 5, None, None], key=str)
    again = jaccard_join.one_of_each(df.repartition(3)).collect()
    assert [r.text for r in kept if r.doc_id == 1] == [r.text for r in again if r.doc_id == 1]


def test_long_texts_are_hashed_in_pieces(spark):
    long = "lorem ipsum dolor " * 20_000 + "z" * 300_000 + " end of it"
    other = long + " more"
    found = jaccard_join.jaccard_components(documents(spark, [long, other, "short one here", long])).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == brute_components([long, other, "short one here", long])


def test_the_join_leaves_no_shuffle_files(spark):
    """Its rounds make some hundred shuffles; on many partitions their files filled the disk until a garbage collection."""
    import time

    texts = [" ".join(f"w{(i // 3) * 50 + k + (i % 3 == k)}" for k in range(40)) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, kept = files.getAllFiles().size(), spark.conf.get(setting)
    found = jaccard_join.jaccard_components(df)
    until = time.time() + 20
    while files.getAllFiles().size() > before + 20 and time.time() < until:  # they go in the background
        time.sleep(0.5)
    assert files.getAllFiles().size() <= before + 20
    assert spark.conf.get(setting) == kept
    assert found.count() == 60
