"""Shape of the physical plans: no row-wise Python, no pairing of tables, pruned scans."""

import re

import pytest

from mailsift.plans import queries

FOLDER = "/root/testdata/sf0.001"
# These write tables or fit models first, and are covered by the tests of those parts.
EAGER = {
    "stored_append", "csv_round_trip", "score_job", "stream_score", "stream_audit",
    "train_and_score", "training_history", "model_selection", "test_metrics",
    "model_round_trip", "top_terms", "append_with_ids", "csv_by_header", "read_snapshot",
    "retrain_latest", "score_job_results", "snapshot_as_of", "stored_append_ids", "table_versions",
    "report_file", "raw_text_files", "corpus_file",
}
REGISTERED = queries.registered()


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(REGISTERED) - EAGER))
def test_plan(spark, name):
    plan = plan_of(REGISTERED[name](spark, FOLDER))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan, name


@pytest.mark.parametrize("name", ["heuristic_score", "social_signals", "extract_urls", "token_ids"])
def test_signals_are_narrow(spark, name):
    plan = plan_of(REGISTERED[name](spark, FOLDER))
    assert "Exchange" not in plan
    schemas = set(re.findall(r"ReadSchema: struct<([^>]*)>", plan))
    assert all("source" not in s and "n_chars" not in s for s in schemas)


def test_keyword_tests_stay_in_generated_code(spark):
    plan = plan_of(REGISTERED["heuristic_score"](spark, FOLDER))
    line = next(x for x in plan.splitlines() if "Contains(" in x)
    assert "*(" in line


def test_report_reads_the_mails_once(spark):
    plan = plan_of(REGISTERED["validation_report"](spark, FOLDER))
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    assert sum("text" in s for s in scans) == 1


def test_texts_are_not_carried_into_metric_joins(spark):
    plan = plan_of(REGISTERED["metrics_by_language"](spark, FOLDER))
    for line in plan.splitlines():
        if "Exchange hashpartitioning" in line:
            assert "email_text" not in line
