"""mailsift: phishing analytics over mail tables, as plain PySpark.

Everything takes and returns DataFrames or Columns.
"""

from mailsift.functions.decide import (
    classify,
    confidence,
    confidence_at,
    is_risky,
    recommendation,
    with_decision,
)
from mailsift.functions.signals import (
    extract_urls,
    keyword_hits,
    social_signals,
    suspicious_urls,
    with_heuristic_score,
)
from mailsift.functions.text import (
    detect_language,
    fold_ids,
    pad_ids,
    padding_mask,
    sequence_ids,
    token_ids,
    tokens,
)
from mailsift.operators.augment import augment
from mailsift.operators.corpus import expand_templates, sample_corpus
from mailsift.operators.identity import with_email_id
from mailsift.operators.metrics import (
    class_metrics,
    class_weights,
    confusion_counts,
    latency_summary,
    log_loss,
    metrics_by_language,
    roc_by_language,
)
from mailsift.operators.quality import (
    guard_batches,
    reject_blank,
    validate_emails,
    validation_report,
)
from mailsift.operators.split import batch_rows, flatten_batches, shuffled, stratified_split
from mailsift.plans.scoring import read_results, score, score_batches, score_job, top_terms, verdicts
from mailsift.plans.training import evaluate, fit, retrain
from mailsift.sources.emails import (
    append_csv,
    append_emails,
    append_single,
    create_corpus,
    ingest_csv,
    read_csv_with_reasons,
    read_emails,
    read_raw_text,
    read_snapshot,
    snapshot,
    write_emails,
)
from mailsift.sources.reports import load_model, read_audit, save_model
from mailsift.sources.versions import VersionedMails
from mailsift.streaming.monitor import monitor
from mailsift.streaming.score import read_email_stream, start_audit, start_scoring

__all__ = [
    "append_csv", "append_emails", "append_single", "augment", "batch_rows", "class_metrics",
    "class_weights", "classify", "confidence", "confidence_at", "confusion_counts",
    "create_corpus", "detect_language", "evaluate", "expand_templates", "extract_urls", "fit",
    "flatten_batches", "fold_ids", "guard_batches", "ingest_csv", "is_risky", "keyword_hits",
    "latency_summary", "load_model", "log_loss", "metrics_by_language", "monitor", "pad_ids",
    "padding_mask", "read_audit", "read_csv_with_reasons", "read_email_stream", "read_emails",
    "read_raw_text", "read_results", "read_snapshot", "recommendation", "reject_blank",
    "retrain", "roc_by_language", "sample_corpus", "save_model", "score", "score_batches",
    "score_job", "sequence_ids", "shuffled", "snapshot", "social_signals", "start_audit",
    "start_scoring", "stratified_split", "suspicious_urls", "token_ids", "tokens", "top_terms",
    "validate_emails", "validation_report", "verdicts", "VersionedMails", "with_decision",
    "with_email_id", "with_heuristic_score", "write_emails",
]
