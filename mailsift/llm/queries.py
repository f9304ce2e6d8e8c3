"""The registered queries of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.llm import (
    bpe,
    chat,
    decontaminate,
    jaccard_join,
    language_id,
    merkle,
    mixing,
    piece_counts,
    quality_rules,
    resampling,
    secret_scan,
    token_files,
    toxicity,
)
from mailsift.llm.common import fold, table
from mailsift.session import shared_path


def op1_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    parts = decontaminate.benchmark_parts(table(spark, sf, "benchmark"))
    return decontaminate.find_contamination(table(spark, sf, "documents"), parts)


def op2_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf, "documents"))


def op3_token_files(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_path(spark, "token-files")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(table(spark, sf, "documents"), tokenizer, path)
    return token_files.read_token_files(spark, path)


def op4_secret_scans(spark: SparkSession, sf: str) -> DataFrame:
    found = secret_scan.scan_secrets(table(spark, sf, "documents"))

    def n(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select(
        "doc_id",
        *[n(k) for k in secret_scan.KINDS],
        F.sha2(secret_scan.span_list("base"), 256).alias("base_sha256"),
        secret_scan.span_list("spans").alias("spans"),
        "n_cut",
    )


def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    log = chat.events_of_turns(turns.unionByName(chat.marked_conversation(spark)))
    stored = chat.write_formatted(chat.format_chats(log), shared_path(spark, "chats"))
    return chat.digests(chat.read_formatted(stored))


def op6_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    return piece_counts.token_counts(table(spark, sf, "documents"), path)


def op7_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    examples = toxicity.fit(documents, table(spark, sf, "labels"))
    found = toxicity.score_toxicity(documents, examples)
    held_out = F.coalesce(fold("doc_id", 5) == 0, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted", "evidence")


def op8_language_id(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    model = language_id.learn(language_id.learned_rows(documents))
    found = language_id.identify(documents, model)
    return found.select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op9_bpe(spark: SparkSession, sf: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.bpe_round_trip(table(spark, sf, "documents"), path)


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality_rules.quality(table(spark, sf, "documents")).drop("clean_text")


def op11_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf, "documents"))


def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    tampered = [merkle.lowered(F.col(c)) if c == "text" else F.col(c) for c in merkle.FIELDS]
    altered = F.when(fold("doc_id", 5) == 0, merkle.leaf_of(tampered))
    return merkle.manifest(documents, altered)


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(own.items(), key=lambda x: int(x[0][2:].split("_")[0])))
