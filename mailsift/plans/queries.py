"""The registered queries: each operator over the given tables.

The tables hold no signal words, so mails are made from ``documents`` by putting a filled template
line in front of each text, chosen by arithmetic on the id. Every query runs over whole tables
and whole texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift import constants as C
from mailsift.functions import decide, text
from mailsift.functions.signals import (
    extract_urls,
    impersonation_cues,
    keyword_hits,
    social_signals,
    suspicious_urls,
    with_heuristic_score,
)
from mailsift.operators import augment, corpus, metrics, quality, split
from mailsift.operators.identity import with_email_id
from mailsift.operators.ordering import global_rank
from mailsift.plans import scoring, training
from mailsift.session import shared_path
from mailsift.sources import emails as store
from mailsift.sources import reports
from mailsift.sources.versions import VersionedMails
from mailsift.streaming import monitor as monitoring
from mailsift.streaming import score as stream

TEMPLATES = [
    *C.PHISHING_TEMPLATES["en"],
    *C.PHISHING_TEMPLATES["sw"],
    *C.LEGITIMATE_TEMPLATES["en"],
    *C.LEGITIMATE_TEMPLATES["sw"],
]
BATCH_SPAN = 150  # ids per four batch requests: of 1, 101, 48 and no mails
CORPUS_LANGUAGES = ["en", "sw", "zh", "ru", "fr"]  # the last one has no templates


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def injected(documents: DataFrame) -> DataFrame:
    """Mails from documents: ``email_id, email_text, language``; batch or streaming."""
    t, s = len(TEMPLATES), len(C.SERVICES)

    def index(divisor: int, size: int) -> Column:
        return F.expr(f"(doc_id div {divisor}) % {size}")

    line = corpus.fill(
        corpus.pick(corpus.strings(TEMPLATES), index(1, t)),
        corpus.pick(corpus.strings(C.SERVICES), index(t, s)),
        corpus.pick(corpus.strings(C.LURE_URLS), index(t * s, len(C.LURE_URLS))),
        corpus.pick(corpus.strings(C.MONTHS), index(t * s, len(C.MONTHS))),
    )
    return documents.select(
        F.col("doc_id").alias("email_id"),
        F.concat(line, F.lit("\n"), F.col("text")).alias("email_text"),
        F.col("lang").alias("language"),
    )


def mails(spark: SparkSession, sf: str) -> DataFrame:
    return injected(table(spark, sf, "documents"))


def with_labels(df: DataFrame, spark: SparkSession, sf: str, how: str = "left") -> DataFrame:
    labels = table(spark, sf, "labels").select(
        F.col("doc_id").alias("email_id"), F.col("toxic").alias("label")
    )
    return df.join(labels, "email_id", how)


def emails_view(spark: SparkSession, sf: str) -> DataFrame:
    return with_labels(mails(spark, sf), spark, sf)


def heuristic(spark: SparkSession, sf: str) -> DataFrame:
    """Ids, languages and heuristic scores; texts stop here and are not carried into joins."""
    return with_heuristic_score(mails(spark, sf)).select(
        "email_id", "language", "heuristic_score"
    )


def labelled_scores(spark: SparkSession, sf: str) -> DataFrame:
    scored = heuristic(spark, sf).withColumnRenamed("heuristic_score", "raw_score")
    return with_labels(scored, spark, sf, "inner")


def scores_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled scores of which one in 17 is missing."""
    score = F.when(F.col("email_id") % 17 != 0, F.col("raw_score"))
    return labelled_scores(spark, sf).withColumn("raw_score", score)


def heuristic_scorer(df: DataFrame) -> DataFrame:
    return with_heuristic_score(df).withColumnRenamed("heuristic_score", "raw_score")


def joined(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# --- signals ---------------------------------------------------------------------------------


def q_keyword_hits(spark, sf):
    low = F.col("low")
    lowered = mails(spark, sf).select("email_id", F.lower("email_text").alias("low"))
    return lowered.select(
        "email_id",
        F.array_join(keyword_hits(low, C.URGENCY_WORDS), "|").alias("urgency"),
        F.array_join(keyword_hits(low, C.CREDENTIAL_WORDS), "|").alias("credentials"),
        F.array_join(keyword_hits(low, C.SALUTATION_WORDS), "|").alias("salutation"),
        F.array_join(keyword_hits(low, C.ATTACHMENT_WORDS), "|").alias("attachments"),
    )


def q_extract_urls(spark, sf):
    found = mails(spark, sf).select("email_id", extract_urls(F.col("email_text")).alias("urls"))
    return found.select("email_id", joined("urls"), F.size("urls").alias("n_urls"))


def q_page_urls(spark, sf):
    pages = table(spark, sf, "pages")
    found = pages.select("page_id", extract_urls(F.col("html")).alias("urls"))
    return found.select("page_id", joined("urls"), F.size("urls").alias("n_urls"))


def q_suspicious_urls(spark, sf):
    found = mails(spark, sf).select("email_id", extract_urls(F.col("email_text")).alias("urls"))
    return found.select("email_id", suspicious_urls(F.col("urls")).alias("suspicious")).select(
        "email_id", joined("suspicious"), F.size("suspicious").alias("n_suspicious")
    )


def headed(spark, sf):
    """Mails of which two in three start with a pasted header, one of them with an address."""
    kind = F.col("email_id") % 3
    header = (
        F.when(kind == 0, F.concat(F.lit("From: "), F.col("language"), F.lit("@example.org\n")))
        .when(kind == 1, "FROM: nobody\n")
        .otherwise("")
    )
    return mails(spark, sf).select("email_id", F.concat(header, "email_text").alias("email_text"))


def q_impersonation_cue(spark, sf):
    return (
        headed(spark, sf)
        .withColumn("low", F.lower("email_text"))
        .select("email_id", impersonation_cues(F.col("email_text"), F.col("low")).alias("cues"))
        .select("email_id", joined("cues"))
    )


def q_heuristic_score(spark, sf):
    return heuristic(spark, sf).select("email_id", "heuristic_score")


def q_social_signals(spark, sf):
    return social_signals(headed(spark, sf)).select(
        "email_id", *[joined(c) for c in C.SIGNAL_ARRAYS], "heuristic_score"
    )


def q_verdict_by_language(spark, sf):
    """The flagship: share of risky mails and mean score per language, without a model."""
    risky = decide.is_risky(F.lit(None).cast("string"), F.col("heuristic_score"))
    return (
        heuristic(spark, sf)
        .groupBy("language")
        .agg(
            F.count("*").alias("n_emails"),
            F.count_if(risky).alias("n_risky"),
            F.round(F.avg("heuristic_score"), 9).alias("mean_score"),
        )
    )


def q_recommendation(spark, sf):
    scored = heuristic(spark, sf)
    label = decide.classify(F.col("heuristic_score"))
    return scored.withColumn(
        "is_risky", decide.is_risky(label, F.col("heuristic_score"))
    ).select(
        "email_id",
        "is_risky",
        decide.recommendation(F.col("is_risky")).alias("recommendation"),
        decide.next_steps(F.col("is_risky")).alias("next_steps"),
    )


# --- quality ---------------------------------------------------------------------------------


def gaps(spark, sf):
    """Labelled mails in which some texts and languages are null."""
    return emails_view(spark, sf).withColumns(
        {
            "email_text": F.when(F.col("email_id") % 11 != 0, F.col("email_text")),
            "language": F.when(F.col("email_id") % 13 != 0, F.col("language")),
        }
    )


def q_profile_nulls(spark, sf):
    return quality.null_counts(gaps(spark, sf))


def q_class_counts(spark, sf):
    return quality.class_counts(emails_view(spark, sf))


def q_class_slices(spark, sf):
    return quality.class_slices(emails_view(spark, sf))


def q_language_counts(spark, sf):
    return quality.language_counts(gaps(spark, sf))


def q_text_length_stats(spark, sf):
    return quality.text_length_stats(gaps(spark, sf))


def q_text_length_stats_strict(spark, sf):
    return quality.text_length_stats(gaps(spark, sf), mode="strict")


def q_dataset_valid(spark, sf):
    whole = quality.validity(emails_view(spark, sf)).withColumn("part", F.lit("all"))
    labelled = with_labels(mails(spark, sf), spark, sf, "inner")
    return whole.unionByName(quality.validity(labelled).withColumn("part", F.lit("labelled")))


def q_validation_report(spark, sf):
    report = quality.validation_report(gaps(spark, sf))
    return report.where("key <> 'mean'")


def q_report_file(spark, sf):
    """The report, written as a JSON file and read again."""
    path = reports.write_report(quality.validation_report(gaps(spark, sf)), shared_path(spark, "report"))
    stored = spark.read.schema("section string, key string, value string").json(path)
    mean = F.col("key") == "mean"
    value = F.when(mean, F.round(F.col("value").cast("double"), 6).cast("string")).otherwise(F.col("value"))
    return stored.withColumn("value", value)


def q_raw_text_files(spark, sf):
    """Whole raw files: the lines and characters of each language's mails, one file per language and task."""
    path = shared_path(spark, "raw")
    rows = mails(spark, sf).select(F.coalesce("language", F.lit("none")).alias("language"), "email_text")
    rows.where("email_text is not null").write.partitionBy("language").text(path)
    files = store.read_raw_text(spark, f"{path}/*/*.txt")
    language = F.regexp_extract("path", r"language=([^/]*)/", 1)
    return files.groupBy(language.alias("language")).agg(
        F.sum(F.length("email_text")).alias("n_chars"),
        F.sum(F.length("email_text") - F.length(F.replace("email_text", F.lit("\n")))).alias("n_lines"),
    )


def q_corpus_file(spark, sf):
    """A generated corpus of one mail per document, written twice to the same place."""
    n = table(spark, sf, "documents").count()
    path = shared_path(spark, "corpus")
    for _ in range(2):
        store.create_corpus(spark, path, n // len(C.LANGUAGES))
    rows = store.read_emails(spark, path, "parquet")
    return rows.groupBy("language", "label").agg(F.count("*").alias("n_rows"), F.countDistinct("email_id").alias("n_ids"))


def q_reject_blank(spark, sf):
    kind = F.col("email_id") % 5
    blanked = mails(spark, sf).withColumn(
        "email_text",
        F.when(kind == 0, "")
        .when(kind == 1, " \t　\n")
        .when(kind == 2, F.lit(None))
        .otherwise(F.col("email_text")),
    )
    good, bad = quality.reject_blank(blanked)
    kept = good.select("email_id", F.lit(None).cast("string").alias("reason"))
    return kept.unionByName(bad)


def batch_requests(spark, sf):
    """Batch requests ``batch_id, emails`` of 1, 101, 48 and no mails (see ``BATCH_SPAN``).

    A request holds at most 101 mails by construction, so no group grows with the table.
    """
    place = F.col("email_id") % BATCH_SPAN
    chunk = F.expr(f"email_id div {BATCH_SPAN}")
    part = F.when(place < 1, 0).when(place < 102, 1).otherwise(2)
    numbered = mails(spark, sf).withColumn("batch_id", chunk * 4 + part)
    full = numbered.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("email_id", "email_text"))).alias("items")
    )
    filled = full.select("batch_id", F.col("items.email_text").alias("emails"))
    empty = (
        table(spark, sf, "documents")
        .select((F.expr(f"doc_id div {BATCH_SPAN}") * 4 + 3).alias("batch_id"))
        .distinct()
        .withColumn("emails", F.array().cast("array<string>"))
    )
    return filled.unionByName(empty)


def q_guard_batches(spark, sf):
    return quality.batch_reason(batch_requests(spark, sf)).select(
        "batch_id", F.size("emails").alias("n_emails"), "reason"
    )


def q_text_preview(spark, sf):
    return mails(spark, sf).select("email_id", text.preview(F.col("email_text")).alias("preview"))


# --- decisions -------------------------------------------------------------------------------


def q_classify(spark, sf):
    scored = heuristic(spark, sf).withColumnRenamed("heuristic_score", "raw_score")
    label = decide.classify(F.col("raw_score"))
    return scored.withColumn("label", label).select(
        "email_id",
        "raw_score",
        "label",
        decide.confidence(F.col("raw_score"), F.col("label")).alias("confidence"),
        (F.col("label") == decide.PHISHING).alias("is_phishing"),
    )


def q_confidence_threshold(spark, sf):
    scored = heuristic(spark, sf).select("email_id", F.col("heuristic_score").alias("raw_score"))
    compat = decide.with_decision(scored, threshold=0.9)
    strict = decide.with_decision(scored, threshold=0.9, mode="strict")
    return compat.withColumn("mode", F.lit("compat")).unionByName(
        strict.withColumn("mode", F.lit("strict"))
    )


def q_display_scores(spark, sf):
    score = F.col("heuristic_score")
    return heuristic(spark, sf).select(
        "email_id",
        decide.clamp(score * 1.5 - 0.25).alias("clamped"),
        decide.display_score(score).alias("score_3"),
        decide.display_score(score, 4).alias("score_4"),
        decide.display_percent(score).alias("percent"),
    )


# --- split, order, append --------------------------------------------------------------------


def labelled(spark, sf):
    return with_labels(mails(spark, sf), spark, sf, "inner")


def q_stratified_split(spark, sf):
    return split.stratified_split(labelled(spark, sf)).select("email_id", "label", "split")


def text_copies(spark, sf):
    """Labelled documents, whose texts occur up to three times."""
    copies = F.explode(F.sequence(F.lit(0), F.expr("cast(doc_id % 3 as int)")))
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"), F.col("text").alias("email_text"))
    rows = with_labels(documents, spark, sf, "inner")
    return rows.withColumn("doc_id", F.col("email_id")).withColumn("copy", copies).drop("doc_id")


def q_grouped_split(spark, sf):
    """A split in which equal texts stay together."""
    return split.grouped_split(text_copies(spark, sf)).select("email_id", "copy", "label", "split")


def q_split_leakage(spark, sf):
    """Texts in more than one split: cut by row, and by text."""
    rows = text_copies(spark, sf).withColumn("row_id", F.concat_ws("-", "email_id", "copy"))
    by_row = split.split_leakage(split.stratified_split(rows, id_col="row_id"))
    by_text = split.split_leakage(split.grouped_split(rows))
    return by_row.withColumn("cut_by", F.lit("row")).unionByName(by_text.withColumn("cut_by", F.lit("text")))


def q_split_sizes(spark, sf):
    return split.split_sizes(split.stratified_split(labelled(spark, sf)))


def q_shuffle_order(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"))
    return global_rank(ids, "email_id", seed=42, rank="position")


def q_batch_rows(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"))
    return split.batch_rows(ids)


def q_batch_rows_in_order(spark, sf):
    ids = table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"))
    return split.batch_rows(ids, seed=None)


def parts(spark, sf):
    """A labelled table, and unlabelled mails (without the column) to be added to it."""
    everything = emails_view(spark, sf)
    existing = everything.where(F.col("label").isNotNull())
    return existing, everything.where(F.col("label").isNull())


def q_append_emails(spark, sf):
    existing, new = parts(spark, sf)
    extra = new.withColumn("origin", F.lit("added"))
    return store.union_emails(existing, extra)


def q_append_single(spark, sf):
    existing, _ = parts(spark, sf)
    return store.union_emails(
        existing, store.single_email(spark, "Please confirm your login", "en", 1)
    )


def q_preview_new_rows(spark, sf):
    return store.preview_rows(parts(spark, sf)[1], "email_id")


def q_stored_append_ids(spark, sf):
    """Rows without an id, appended to a table with numbers: ids go on after the largest."""
    existing, new = parts(spark, sf)
    path = shared_path(spark, "append")
    store.write_emails(existing, path)
    store.append_emails(spark, path, new.drop("email_id"), dry_run=False, report=lambda line: None)
    rows = store.read_emails(spark, path, "parquet")
    top = existing.agg(F.max("email_id")).first()[0]
    fresh = F.col("label").isNull()
    number = F.col("email_id") - F.when(fresh, top).otherwise(0)
    return rows.groupBy(fresh.alias("appended")).agg(
        F.count("*").alias("n_rows"), F.countDistinct("email_id").alias("n_ids"),
        F.min(number).alias("first_id"), F.max(number).alias("last_id"),
        F.sum(F.length("email_text")).alias("n_chars"),
    )


def q_stored_append(spark, sf):
    existing, new = parts(spark, sf)
    path = shared_path(spark, "append")
    store.write_emails(existing, path)
    store.append_emails(spark, path, new, dry_run=False, report=lambda line: None)
    return store.read_emails(spark, path, "parquet")


def q_csv_round_trip(spark, sf):
    path = shared_path(spark, "csv")
    store.write_emails(emails_view(spark, sf), path, "csv")
    return store.read_emails(spark, path)


# --- tokens ----------------------------------------------------------------------------------


def q_csv_by_header(spark, sf):
    """CSV files with two column orders, one with a column more, and labels that are no numbers."""
    path = shared_path(spark, "csv")
    raw = emails_view(spark, sf).withColumn(
        "label", F.when(F.col("email_id") % 6 == 0, "spam").otherwise(F.col("label").cast("string"))
    )
    first = raw.where("label is null").select("label", "email_text", "email_id", "language")
    second = raw.where("label is not null").withColumn("origin", F.lit("b"))
    store.write_emails(first, path, "csv")
    store.write_emails(second, path, "csv", mode="append")
    out = shared_path(spark, "ingested")
    store.ingest_csv(spark, path, out)
    return spark.read.parquet(out).select(
        "email_id", "language", "label", "origin", "status", "reason",
        F.length("email_text").cast("bigint").alias("n_chars"),
        F.col("_corrupt_record").contains("spam").alias("row_kept"),
    )


def q_append_with_ids(spark, sf):
    """Rows that occur up to three times, appended; then once more; then the second append again."""
    table_ = VersionedMails(spark, shared_path(spark, "mails"))
    copies = F.explode(F.sequence(F.lit(0), F.expr("cast(email_id % 3 as int)")))
    many = emails_view(spark, sf).withColumn("_copy", copies).drop("_copy", "email_id")
    table_.append(many, "many")
    for _ in range(2):
        table_.append(emails_view(spark, sf).drop("email_id"), "once more")
    return table_.as_of().select(
        "email_id", "language", "label", F.length("email_text").cast("bigint").alias("n_chars")
    )


def q_snapshot_as_of(spark, sf):
    """Every version of a table that grew by two appends."""
    table_ = VersionedMails(spark, shared_path(spark, "mails"))
    for number, rows in enumerate(parts(spark, sf)):
        table_.append(rows, f"append {number}")
    first, second = (table_.as_of(v).withColumn("version", F.lit(v)) for v in (1, 2))
    return first.unionByName(second).select(
        "version", "email_id", "source_id", "language", "label", F.length("email_text").cast("bigint").alias("n_chars")
    )


def q_table_versions(spark, sf):
    """The history of that table, with what the manifests say of each version's files."""
    table_ = VersionedMails(spark, shared_path(spark, "mails"))
    for number, rows in enumerate(parts(spark, sf)):
        table_.append(rows, f"append {number}")
    counts = [
        (v, table_.files(v).agg(F.sum("n_rows")).first()[0], table_.damaged(v).count()) for v in (1, 2)
    ]
    found = spark.createDataFrame(counts, "version bigint, listed_rows bigint, n_damaged bigint")
    return table_.versions().join(found, "version").select(
        "version", "append_id", "n_rows", "listed_rows", "n_damaged"
    )


def q_read_snapshot(spark, sf):
    """A table as its snapshot has it, after an append."""
    existing, new = parts(spark, sf)
    path = shared_path(spark, "append")
    store.write_emails(existing, path)
    kept = store.snapshot(spark, path, f"{path}-kept", content="manifest")
    store.append_emails(spark, path, new, dry_run=False, backup=False, report=lambda line: None)
    return store.read_snapshot(spark, kept)


def q_retrain_latest(spark, sf):
    """Test rows per language of a training on the newest version of a table with two."""
    table_ = VersionedMails(spark, shared_path(spark, "mails"))
    everything = labelled(spark, sf).drop("email_id")
    labelled_one = F.col("label") == 1
    table_.append(everything.where(labelled_one), "phishing")
    table_.append(everything.where(~labelled_one), "legitimate")
    models = shared_path(spark, "models")
    options = {"reg_params": (0.1,), "max_iter": 2, "vocab_size": 500}
    version, _ = training.retrain(table_, models, **options)
    assert training.retrain(table_, models, **options)[0] == version
    found = spark.read.json(f"{models}/version={version}/metrics")
    return found.select(F.lit(version).cast("bigint").alias("version"), "scope", "language", "n_rows")


def q_column_check(spark, sf):
    """Which required columns each of two tables has."""
    full = quality.column_check(emails_view(spark, sf)).withColumn("source", F.lit("labelled"))
    some = quality.column_check(table(spark, sf, "pages")).withColumn("source", F.lit("pages"))
    return full.unionByName(some)


def q_token_ids(spark, sf):
    ids = text.sequence_ids(F.col("email_text"))
    return mails(spark, sf).select("email_id", F.array_join(ids, ",").alias("ids"))


def q_document_frequencies(spark, sf):
    """In how many mails each token id occurs, over whole texts, and the weight that follows."""
    ids = mails(spark, sf).select(text.token_ids(text.tokens(F.col("email_text"))).alias("term_ids"))
    counted = training.document_frequencies(ids)
    idf = training.inverse_frequency(F.col("n_docs"), F.lit(ids.count()))
    return counted.select("term_id", "n_docs", F.round(idf, 9).alias("idf"))


def q_fold_ids(spark, sf):
    wide = text.sequence_ids(F.col("email_text"), vocab_size=50_000)
    return (
        mails(spark, sf)
        .select("email_id", wide.alias("wide"))
        .select("email_id", F.array_join(text.fold_ids(F.col("wide")), ",").alias("ids"))
    )


def q_padding_mask(spark, sf):
    mask = text.padding_mask(text.sequence_ids(F.col("email_text")))
    as_digits = F.transform(mask, lambda m: m.cast("int"))
    return mails(spark, sf).select("email_id", F.array_join(as_digits, "").alias("mask"))


def q_batch_explode(spark, sf):
    accepted, _ = quality.guard_batches(batch_requests(spark, sf))
    return split.flatten_batches(accepted)


def labels_as_text(spark, sf):
    raw = with_labels(mails(spark, sf).select("email_id"), spark, sf).withColumn(
        "label",
        F.when(F.col("email_id") % 4 == 0, "spam").otherwise(F.col("label").cast("string")),
    )
    return raw


def q_label_cast(spark, sf):
    """The rows with a number for a label, and the quarantine of the others."""
    good, bad = store.cast_labels(labels_as_text(spark, sf))
    bad = bad.select("email_id", F.lit(None).cast("int").alias("label"), F.col("label").alias("refused"))
    return good.withColumn("refused", F.lit(None).cast("string")).unionByName(bad)


def q_token_length_histogram(spark, sf):
    return quality.token_length_histogram(mails(spark, sf))


def q_token_length_summary(spark, sf):
    return quality.token_length_summary(mails(spark, sf))


def q_detect_language(spark, sf):
    mixed = q_generate_emails(spark, sf)
    return mixed.select(
        "email_id", text.detect_language(F.col("email_text")).alias("detected")
    )


# --- corpora ---------------------------------------------------------------------------------


def q_detect_mail_language(spark, sf):
    """The language guess for whole mails."""
    guess = text.detect_language(F.col("email_text"))
    return mails(spark, sf).select("email_id", guess.alias("guess"))


def q_expand_templates(spark, sf):
    return corpus.match_templates(mails(spark, sf))


def q_generate_emails(spark, sf):
    wanted = table(spark, sf, "documents").select(
        F.col("doc_id").alias("email_id"),
        corpus.pick(corpus.strings(CORPUS_LANGUAGES), F.col("doc_id") % 5).alias("language"),
        (F.col("doc_id") % 2).cast("int").alias("label"),
    )
    made = corpus.generate_email(
        F.col("language"), F.col("label"), corpus.seed_key(42, F.col("email_id"))
    )
    return wanted.withColumn("email_text", made)


def q_sample_corpus(spark, sf):
    return corpus.corpus_over(table(spark, sf, "documents"), "doc_id")


# --- metrics ---------------------------------------------------------------------------------


def q_class_metrics(spark, sf):
    return metrics.class_metrics(scores_with_gaps(spark, sf))


def q_log_loss(spark, sf):
    loss = metrics.log_loss(scores_with_gaps(spark, sf))
    return loss.select(F.round("log_loss", 9).alias("log_loss"), "n_unscored")


def q_metrics_by_language(spark, sf):
    return metrics.metrics_by_language(scores_with_gaps(spark, sf))


def q_confusion_by_language(spark, sf):
    return metrics.confusion_counts(scores_with_gaps(spark, sf), ["language"])


def q_roc_by_language(spark, sf):
    lengths = table(spark, sf, "documents").select(F.col("doc_id").alias("email_id"), "n_chars")
    fine = labelled_scores(spark, sf).join(lengths, "email_id")
    spread = F.col("raw_score") * 0.9 + (F.col("n_chars") % 1000).cast("double") / 10000.0
    return metrics.roc_by_language(fine.withColumn("raw_score", spread))


def q_class_weights(spark, sf):
    return metrics.class_weights(table(spark, sf, "labels").withColumnRenamed("toxic", "label"))


def q_latency_summary(spark, sf):
    found = metrics.latency_summary(table(spark, sf, "events"), ["event_type"], "value")
    return found.select(
        "event_type", "n_rows", *[F.round(c, 6).alias(c) for c in ("mean", "p95", "p99")]
    )


# --- training and scoring --------------------------------------------------------------------


_FITS: dict[tuple[str, str], training.Fit] = {}


def fitted(spark, sf):
    """One training per session and folder; the queries below read the same fit."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FITS:
        _FITS[key] = training.fit(labelled(spark, sf))
    return _FITS[key]


def q_train_and_score(spark, sf):
    model = fitted(spark, sf).best
    return scoring.score(mails(spark, sf), model).drop("email_text")


def q_training_history(spark, sf):
    return fitted(spark, sf).history


def q_model_selection(spark, sf):
    return fitted(spark, sf).selection


def q_test_metrics(spark, sf):
    return training.evaluate(fitted(spark, sf))


def q_model_round_trip(spark, sf):
    path = reports.save_model(fitted(spark, sf).best, shared_path(spark, "model"))
    return scoring.verdicts(scoring.score(mails(spark, sf), reports.load_model(path))).select(
        "email_id", "raw_score", "label", "heuristic_score", "is_risky"
    )


def q_top_terms(spark, sf):
    return scoring.top_terms(mails(spark, sf), fitted(spark, sf).best)


def some_blank(df: DataFrame) -> DataFrame:
    """The mails, of which one in five has a blank text of its own length."""
    blank = F.concat(F.lit(" "), F.repeat(F.lit("\n"), (F.col("email_id") % 7).cast("int")))
    kept = F.when(F.col("email_id") % 5 != 0, F.col("email_text")).otherwise(blank)
    return df.withColumn("email_text", kept)


AUDIT = ["email_id", "text_len", "label", "raw_score", "status"]


def q_score_job(spark, sf):
    out = shared_path(spark, "score-job")
    scoring.score_job(spark, some_blank(mails(spark, sf)), heuristic_scorer, out, batch_id=0)
    return reports.read_audit(spark, f"{out}/audit").select(*AUDIT, "batch_id")


def q_score_job_results(spark, sf):
    """What the job stores per mail, the refused ones included."""
    out = shared_path(spark, "score-job")
    scoring.score_job(spark, some_blank(mails(spark, sf)), heuristic_scorer, out, batch_id=0)
    return scoring.read_results(spark, out)


def q_score_batches(spark, sf):
    return scoring.score_batches(batch_requests(spark, sf), heuristic_scorer)[0].drop("email_text")


# --- streaming -------------------------------------------------------------------------------


def document_stream(spark, sf):
    """The documents as a stream; the table may be one file or a folder of part files.

    As a pattern, because a stream takes a plain path for a folder.
    """
    schema = table(spark, sf, "documents").schema
    return injected(stream.read_email_stream(spark, f"{sf}/document[s].parquet", schema=schema))


def q_stream_score(spark, sf):
    out, state = shared_path(spark, "stream"), shared_path(spark, "stream-state")
    stream.start_scoring(some_blank(document_stream(spark, sf)), out, state).awaitTermination()
    return spark.read.parquet(out).select(
        "email_id", "language", "heuristic_score", "is_risky", "text_len", "status"
    )


def q_stream_audit(spark, sf):
    out, state = shared_path(spark, "audit"), shared_path(spark, "audit-state")
    arriving = some_blank(document_stream(spark, sf))
    stream.start_audit(arriving, out, state, heuristic_scorer).awaitTermination()
    return reports.read_audit(spark, f"{out}/audit").select(*AUDIT)


def q_monitor_windows(spark, sf):
    found = monitoring.monitor(
        table(spark, sf, "events"), "ts", F.col("event_type") == "error", "value"
    )
    return found.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"),
        F.date_format("window_end", "yyyy-MM-dd HH:mm:ss").alias("window_end"),
        "n_rows",
        F.round("error_share", 9).alias("error_share"),
        F.round("mean_value", 6).alias("mean_value"),
    )


def q_monitor_percentiles(spark, sf):
    """Whether the rank of each window's sketched percentiles is within the stated error of theirs."""
    events = table(spark, sf, "events")
    found = monitoring.monitor(events, "ts", F.lit(False), "value", percentiles=(0.5, 0.95, 0.99))
    values = events.select(F.window("ts", "1 hour").getField("start").alias("window_start"), "value")
    shares = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    ranked = values.join(found, "window_start").groupBy("window_start", "n_rows").agg(
        *[F.count_if(F.col("value") < F.col(p)).alias(f"{p}_below") for p in shares],
        *[F.count_if(F.col("value") <= F.col(p)).alias(f"{p}_upto") for p in shares],
    )

    def within(p: str, share: float) -> Column:
        # Three times the error that 99 of 100 sketches keep, and one row for the ends of a step.
        slack = 3 * monitoring.RANK_ERROR * F.col("n_rows") + 1
        at = share * F.col("n_rows")
        return ((F.col(f"{p}_below") <= at + slack) & (F.col(f"{p}_upto") >= at - slack)).alias(p)

    return ranked.select(
        F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "n_rows",
        *[within(p, share) for p, share in shares.items()],
    )


# --- augmentation ----------------------------------------------------------------------------


def q_augment_urls(spark, sf):
    return augment.changed_copies(mails(spark, sf), "url")


def q_augment_page_urls(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", F.col("html").alias("email_text"))
    return augment.changed_copies(pages, "url")


def q_augment_synonyms(spark, sf):
    return augment.changed_copies(mails(spark, sf), "synonym")


def q_augment_digits(spark, sf):
    return augment.changed_copies(mails(spark, sf), "digit")


def q_augment_all(spark, sf):
    return augment.augment(mails(spark, sf), ("synonym", "url", "digit")).groupBy(
        F.coalesce("aug", F.lit("none")).alias("aug")
    ).agg(F.count("*").alias("n_rows"))


def q_assign_ids(spark, sf):
    """Ids for a table without any, whose rows occur once, twice or three times."""
    copies = F.explode(F.sequence(F.lit(0), F.expr("cast(doc_id % 3 as int)")))
    bare = table(spark, sf, "documents").select("text", "lang", copies.alias("_copy")).drop("_copy")
    named = with_email_id(bare)
    return named.select("email_id", "lang", F.length("text").cast("bigint").alias("n_chars"))


def registered() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries by name."""
    found = {
        name[2:]: function
        for name, function in globals().items()
        if name.startswith("q_") and callable(function)
    }
    return {"emails_view": emails_view, **found}
