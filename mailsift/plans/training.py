"""Training: features, model choice by validation loss, history, test metrics.

The task, the loss (binary cross-entropy) and the output (a sigmoid score) are fixed; the model is a
logistic regression over hashed word n-grams and signal counts.

Features are computed once for the whole split table and stored in the shared folder, by split;
every candidate of the grid and every later pass reads them from there, and all candidates are
compared in one pass over the validation split. Between the executors and the
driver only vectors of ``vocab_size`` coefficients travel.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import IDF, HashingTF, IDFModel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift import constants as C
from mailsift.functions import terms
from mailsift.functions.signals import signal_counts
from mailsift.functions.text import tokens
from mailsift.operators.metrics import class_weights, metrics_by_language, row_loss
from mailsift.operators.quality import validate_emails
from mailsift.operators.split import grouped_split, stratified_split
from mailsift.session import bound_batches, shared_path, ship_package, stored
from mailsift.sources import files
from mailsift.sources.reports import load_model, save_model, write_history, write_report
from mailsift.sources.versions import VersionedMails

SIGNALS = ["n_urgency", "n_creds", "n_attachments", "n_suspicious"]
REG_PARAMS = (0.1, 0.01, 0.001)


def with_terms(df: DataFrame, text: str = "email_text") -> DataFrame:
    """Add ``words`` (lower-cased tokens) and ``terms`` (one hash per run of 1 to 3 tokens).

    Hashes are chained over the tokens, so no n-gram text is ever built; ``terms`` holds all single
    tokens first, then all pairs, then all triples.
    """
    n = F.size("words")

    def from_token(start: int, width: int) -> Column:
        return F.slice("words", F.lit(start), F.greatest(n - (width - 1), F.lit(0)))

    pairs = F.zip_with(from_token(1, 2), from_token(2, 2), lambda a, b: F.xxhash64(a, b))
    leading = F.slice("_pairs", F.lit(1), F.greatest(n - 2, F.lit(0)))
    triples = F.zip_with(leading, from_token(3, 3), lambda ab, c: F.xxhash64(ab, c))
    return (
        df.withColumn("words", tokens(F.lower(F.col(text))))
        .withColumn("_pairs", pairs)
        .withColumn(
            "terms", F.concat(F.transform("words", lambda w: F.xxhash64(w)), "_pairs", triples)
        )
        .drop("_pairs")
    )


def term_index(term: Column, vocab_size: int = C.VOCAB_SIZE) -> Column:
    """Feature index of a term hash; SQL ``hash`` of a BIGINT is what ``HashingTF`` uses for it."""
    return F.pmod(F.hash(term), F.lit(vocab_size))


def signal_term(name: str) -> Column:
    """The hash that stands for a hit of a signal."""
    return F.xxhash64(F.lit(f"<{name}>"))


def counted(df: DataFrame) -> DataFrame:
    """The signal counts of mails whose terms are to be worked out; executors get this package."""
    ship_package(df.sparkSession)
    bound_batches(df.sparkSession)
    return signal_counts(df)


def featurize(df: DataFrame) -> DataFrame:
    """Add ``term_keys``: the hashes of all n-grams, and one hash per counted signal hit."""
    return counted(df).withColumn("term_keys", terms.term_keys("email_text", SIGNALS)).drop(*SIGNALS)


def vectors(vocab_size: int = C.VOCAB_SIZE) -> HashingTF:
    """The stage that turns term hashes into a sparse count vector."""
    return HashingTF(numFeatures=vocab_size, inputCol="term_keys", outputCol="features")


def document_frequencies(df: DataFrame, ids: str = "term_ids") -> DataFrame:
    """``term_id, n_docs``: in how many rows each feature index occurs; at most ``vocab_size`` rows."""
    once = df.select(F.explode(F.array_distinct(ids)).alias("term_id"))
    return once.groupBy("term_id").agg(F.count("*").alias("n_docs"))


def inverse_frequency(n_docs: Column, total: Column) -> Column:
    """ln((total + 1) / (n_docs + 1)), the weight that the ``IDF`` stage gives a feature."""
    return F.log((total + 1).cast("double") / (n_docs + 1).cast("double"))


def linear_weights(classifier: LogisticRegressionModel, idf: IDFModel | None = None) -> list[float]:
    """The weight of each feature index in the margin: its coefficient, times its idf where there is one."""
    weights = classifier.coefficients.toArray()
    return [float(w) for w in (weights if idf is None else weights * idf.idf.toArray())]


def weights_of(model: PipelineModel) -> list[float]:
    """:func:`linear_weights` of a fitted pipeline."""
    return linear_weights(model.stages[-1], model.stages[1] if len(model.stages) > 2 else None)


def constant(weights: list[float]) -> Column:
    """Numbers as a constant array of the plan."""
    return F.from_json(F.lit(json.dumps(weights)), "array<double>")


def probability(weights: list[float], intercept: float, term_ids: str) -> Column:
    """Probability of class 1 from the feature index of every term occurrence.

    The model is linear in the term counts, so its margin is the sum of one weight per occurrence:
    the same number that the fitted pipeline gives, without building vectors.
    """
    table = constant(weights)
    margin = F.aggregate(term_ids, F.lit(float(intercept)), lambda total, i: total + F.get(table, i))
    return 1.0 / (1.0 + F.exp(-margin))


def validation(
    rows: DataFrame, models: list[LogisticRegressionModel], idf: IDFModel | None = None
) -> list[tuple[float, float]]:
    """Loss and accuracy of every candidate on the same rows, in one pass over them."""
    scores = [probability(linear_weights(m, idf), m.intercept, "term_ids") for m in models]
    scored = rows.select("label", *[s.alias(f"p{i}") for i, s in enumerate(scores)])
    found = []
    for i in range(len(models)):
        hit = (F.col(f"p{i}") > C.DECISION_THRESHOLD) == (F.col("label") == 1)
        found += [F.avg(row_loss(F.col("label"), F.col(f"p{i}"))), F.avg(hit.cast("double"))]
    values = scored.agg(*found).first()
    return [(float(values[2 * i]), float(values[2 * i + 1])) for i in range(len(models))]


@dataclass
class Fit:
    """A finished training: models, tables of what happened, and the stored split."""

    best: PipelineModel
    final: PipelineModel
    history: DataFrame
    selection: DataFrame
    splits: DataFrame

    @property
    def test(self) -> DataFrame:
        """The features of the test split."""
        return self.splits.where("split = 'test'")


def fit(
    df: DataFrame,
    reg_params: tuple[float, ...] = REG_PARAMS,
    seed: int = 42,
    vocab_size: int = C.VOCAB_SIZE,
    max_iter: int = 20,
    balanced: bool = False,
    keep_texts_together: bool = False,
    min_docs: int | None = None,
) -> Fit:
    """Validate, split 70/15/15, fit each candidate on train, keep the lowest validation loss.

    With ``min_docs`` features are weighed by their idf over the train split, those in fewer texts by
    0; scoring stays the same plain expression, because the weights go into the coefficients. With
    ``keep_texts_together`` equal texts are in one split (:func:`grouped_split`), so that no
    text that a model has learned is in its test.
    An invalid table is an error. ``balanced`` weighs each class by ``n / (k * n_class)``.
    """
    valid, report = validate_emails(df)
    if not valid:
        reason = report.where("section = 'error'").first()["value"]
        raise ValueError(f"the table cannot be trained on: {reason}")
    spark = df.sparkSession
    path = shared_path(spark, "fit")
    hashing = vectors(vocab_size)
    split = grouped_split(df, seed=seed) if keep_texts_together else stratified_split(df, seed=seed)
    featured = (
        featurize(split)
        .withColumn("target", F.col("label").cast("double"))
        .withColumn("term_ids", terms.indexes("term_keys", vocab_size))
        .withColumn("features", terms.count_vectors("term_ids", vocab_size))
    )
    kept = [c for c in df.columns if c != "email_text"]
    found = featured.select(*kept, "split", "target", "features", "term_ids")
    # Read by split from here on; a split's files are all that a pass over it opens.
    found.write.partitionBy("split").parquet(f"{path}/splits")
    fields = [T.StructField("features", VectorUDT()) if f.name == "features" else f for f in found.schema]
    splits = spark.read.schema(T.StructType(fields)).parquet(f"{path}/splits")
    # Each optimizer step is a job over these files; small ones are read together in one task.
    train = splits.where("split = 'train'")
    val = splits.where("split = 'val'")
    idf = None
    if min_docs is not None:
        idf = IDF(inputCol="features", outputCol="weighted", minDocFreq=min_docs).fit(train)
        train = idf.transform(train)
    learner = LogisticRegression(
        featuresCol="features" if idf is None else "weighted", labelCol="target", maxIter=max_iter, aggregationDepth=2
    )
    if balanced:
        weights = stored(class_weights(train).select("label", "weight"))
        train = train.join(weights, "label")
        learner = learner.setWeightCol("weight")

    history: list[tuple[float, str, int, float]] = []
    models = []
    for reg in reg_params:  # a handful of candidates; each fit is a distributed job
        model = learner.copy({learner.regParam: reg}).fit(train)
        models.append(model)
        losses = model.summary.objectiveHistory
        history += [(reg, "loss", step, float(x)) for step, x in enumerate(losses)]
    selection = validation(val, models, idf)
    for (reg, model), (val_loss, val_accuracy) in zip(zip(reg_params, models), selection):
        last = len(model.summary.objectiveHistory) - 1
        history += [(reg, "val_loss", last, val_loss), (reg, "val_accuracy", last, val_accuracy)]
    best = min(range(len(models)), key=lambda i: selection[i][0])

    def pipeline(i: int) -> PipelineModel:
        # Stored and read again: a model without its training summary, which holds the table.
        return load_model(save_model(PipelineModel([hashing, *([idf] if idf else []), models[i]]), f"{path}/model-{i}"))

    return Fit(
        best=pipeline(best),
        final=pipeline(len(models) - 1),
        history=spark.createDataFrame(
            history, "reg_param double, metric string, step int, value double"
        ),
        selection=spark.createDataFrame(
            [(reg, *row, i == best) for i, (reg, row) in enumerate(zip(reg_params, selection))],
            "reg_param double, val_loss double, val_accuracy double, chosen boolean",
        ),
        splits=splits,
    )


def evaluate(fitted: Fit, model: PipelineModel | None = None, split: str = "test") -> DataFrame:
    """Metrics of a split, the test split by default, per language and overall."""
    used = model or fitted.best
    scores = probability(weights_of(used), used.stages[-1].intercept, "term_ids")
    return metrics_by_language(fitted.splits.where(F.col("split") == split).withColumn("raw_score", scores))


def retrain(table: VersionedMails, models: str, version: int | None = None, **options) -> tuple[int, PipelineModel]:
    """Train on a version of a mail table, the newest by default; returns its number and the model.

    The model, its history and its test metrics are stored under ``models/version=<number>``; where
    the metrics are there already, the stored model is loaded and nothing is trained. They are
    written last, so a training that broke off is done again. ``options`` go to :func:`fit`.
    """
    spark = table.spark
    number = table.latest() if version is None else version
    out = f"{models.rstrip('/')}/version={number}"
    if files.exists(spark, f"{out}/metrics/_SUCCESS"):
        return number, load_model(f"{out}/model")
    fitted = fit(table.as_of(number), **options)
    save_model(fitted.best, f"{out}/model")
    write_history(fitted.history, f"{out}/history", f"{out}/model")
    write_report(evaluate(fitted), f"{out}/metrics")
    return number, fitted.best
