"""Mail tables: read, write, append, snapshot.

CSV is supported because labelled mails are exchanged that way. A CSV file with line breaks inside
fields cannot be divided between tasks, so large tables belong in Parquet (the default when
writing): many CSV files are read in parallel, one huge file is not.
"""

from __future__ import annotations

import csv
import re
import uuid
from collections.abc import Callable
from datetime import datetime, timezone
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailsift import constants as C
from mailsift.operators.corpus import sample_corpus
from mailsift.operators.identity import DIGEST, identified, placed_rows
from mailsift.operators.quality import require_columns
from mailsift.session import shared_path
from mailsift.sources import files

ID_COL = "email_id"
KNOWN_TYPES = {
    "email_id": T.LongType(),
    "email_text": T.StringType(),
    "language": T.StringType(),
    "label": T.IntegerType(),
}
CORRUPT = "_corrupt_record"
REASON = "reason"
_CSV = {
    "header": "true",
    "multiLine": "true",
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, header``: the first line of each CSV file under a path; empty files have none.

    Lines are compared on the map side, so one line per file and task is shuffled.
    """
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        "value",
        F.monotonically_increasing_id().alias("at"),
    )
    return lines.groupBy("file").agg(F.min_by("value", F.struct("block", "at")).alias("header"))


def _names(header: str) -> list[str]:
    """Column names of a header line."""
    try:
        names = next(csv.reader([header.lstrip("\ufeff")], strict=True))
    except csv.Error as error:
        raise ValueError(f"a header must be one line: {header!r}") from error
    if len(set(names)) < len(names):
        raise ValueError(f"a header names a column twice: {header!r}")
    return names


def _literal_path(file: str) -> str:
    """A file's path as one that the reader takes for this file alone."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", unquote(file))


def _as_whole_number(name: str, kind: T.DataType) -> Column:
    """The field as a number, also where it is written like 1.0; null if it is none."""
    field = F.trim(F.col(f"`{name}`"))
    whole = F.when(field.rlike(r"^[+-]?[0-9]+\.0*$"), F.substring_index(field, ".", 1)).otherwise(field)
    return whole.try_cast(kind)


def read_csv_with_reasons(spark: SparkSession, path: str, id_type: str = "bigint") -> DataFrame:
    """All rows of CSV files, each file read by its own header, with ``reason`` and ``_corrupt_record``.

    Files are grouped by header; each group is one read and the groups are put together by name, so
    column orders may differ and columns may be absent (null). ``reason`` is null for a good row.
    Otherwise it says which field is no number, or that the fields do not fit the header, and
    ``_corrupt_record`` holds the row; nothing becomes null without a reason. Types are never
    inferred: the known columns have theirs (ids ``id_type``), all others are text.
    """
    groups = csv_headers(spark, path).groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files"))
    tables = []
    for header, files_of in sorted((r.header, r.files) for r in groups.collect()):
        names = _names(header)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, CORRUPT]])
        rows = (
            spark.read.options(**_CSV)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT)
            .option("enforceSchema", "true")
            .schema(schema)
            .csv([_literal_path(f) for f in files_of])
        )
        tables.append(rows)
    if not tables:
        kinds = [T.StructField(n, T.StringType()) for n in [*KNOWN_TYPES, CORRUPT]]
        tables.append(spark.createDataFrame([], T.StructType(kinds)))
    everything = tables[0]
    for other in tables[1:]:
        everything = everything.unionByName(other, allowMissingColumns=True)
    names = [c for c in everything.columns if c != CORRUPT]
    typed, reasons = {}, [F.when(F.col(CORRUPT).isNotNull(), "the fields do not fit the header")]
    for name in names:
        kind = KNOWN_TYPES.get(name, T.StringType()) if name != ID_COL else T._parse_datatype_string(id_type)
        if isinstance(kind, T.StringType):
            continue
        typed[name] = _as_whole_number(name, kind)
        reasons.append(F.when(F.col(f"`{name}`").isNotNull() & typed[name].isNull(), f"{name} is no number"))
    row = F.to_csv(F.struct(*[F.col(f"`{c}`") for c in names]))
    reason = F.coalesce(*reasons)
    return everything.select(
        *[typed.get(c, F.col(f"`{c}`")).alias(c) for c in names],
        F.coalesce(CORRUPT, F.when(reason.isNotNull(), row)).alias(CORRUPT),
        reason.alias(REASON),
    )


def read_emails(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    keep_corrupt: bool = False,
    merge_schema: bool = True,
    id_type: str = "bigint",
) -> DataFrame:
    """A labelled mail table with every column it has; a missing path is an error.

    CSV files are read as by :func:`read_csv_with_reasons`. A row that does not fit stops the job
    with its reason; with ``keep_corrupt`` it is kept, whole in ``_corrupt_record``, with null in
    the fields that do not fit. ``merge_schema`` shows columns that later appends have added to a
    Parquet table.
    """
    if fmt != "csv":
        return spark.read.format(fmt).option("mergeSchema", merge_schema).load(path)
    rows = read_csv_with_reasons(spark, path, id_type)
    if keep_corrupt:
        return rows.drop(REASON)
    message = F.concat(F.col(REASON), F.lit(": "), F.coalesce(CORRUPT, F.lit("")))
    fits = F.when(F.col(REASON).isNull(), F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))
    return rows.where(fits).drop(REASON, CORRUPT)


def ingest_csv(spark: SparkSession, path: str, out: str, id_type: str = "bigint") -> dict[str, int]:
    """Store CSV files as Parquet in one pass: ``out/status=good`` and ``out/status=quarantine``.

    Rows of the quarantine have their reason and the row as it was read; all rows are in one of the two.
    Returns the number of rows of each, counted while they are written.
    """
    rows = read_csv_with_reasons(spark, path, id_type)
    good = F.col(REASON).isNull()
    seen = Observation()
    rows = rows.withColumn("status", F.when(good, "good").otherwise("quarantine"))
    counted = rows.observe(seen, F.count_if(good).alias("good"), F.count_if(~good).alias("quarantine"))
    counted.write.partitionBy("status").parquet(out)
    return seen.get


def read_raw_text(spark: SparkSession, path: str) -> DataFrame:
    """Raw mail files, one mail each: ``path, email_text``.

    UTF-8 where the bytes are valid UTF-8, Latin-1 otherwise.
    """
    content = F.col("content")
    text = F.when(
        F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")
    ).otherwise(F.decode(content, "ISO-8859-1"))
    return spark.read.format("binaryFile").load(path).select("path", text.alias("email_text"))


def write_emails(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
) -> str:
    """Write a mail table (Parquet, or CSV with a header); returns the path."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)
    return path


def create_corpus(
    spark: SparkSession,
    path: str,
    samples_per_language: int = 250,
    languages: list[str] | None = None,
    seed: int = 42,
    fmt: str = "parquet",
) -> str:
    """Generate a balanced corpus and write it, replacing what is there; returns the path.

    The new files are complete before they take the place of the old ones.
    """
    corpus = sample_corpus(spark, samples_per_language, languages, seed)
    draft = write_emails(corpus, f"{path.rstrip('/')}.new-{uuid.uuid4().hex}", fmt)
    files.put_in_place(spark, draft, path)
    return path


def union_emails(existing: DataFrame, new: DataFrame) -> DataFrame:
    """All rows of both tables, by column name; columns missing on one side are null there."""
    return require_columns(existing).unionByName(require_columns(new), allowMissingColumns=True)


def preview_rows(df: DataFrame, order_by: str, n: int = C.PREVIEW_ROWS) -> DataFrame:
    """The first rows by a key."""
    return df.orderBy(order_by).limit(n)


def snapshot_name(now: datetime | None = None) -> str:
    """``snapshot=<UTC time>`` in the form ``yyyyMMddTHHmmssZ``."""
    moment = now or datetime.now(timezone.utc)
    return "snapshot=" + moment.strftime("%Y%m%dT%H%M%SZ")


def snapshot(
    spark: SparkSession,
    path: str,
    target: str,
    fmt: str = "parquet",
    content: str = "copy",
    now: datetime | None = None,
) -> str:
    """Keep the present state of a table under ``target/snapshot=<time>``; returns that path.

    ``copy`` stores the rows. ``manifest`` stores only the names of the data files, gathered by the
    executors: enough to read an append-only table as it was, without copying it. A snapshot
    never replaces another; :func:`read_snapshot` reads either kind.
    """
    first = out = f"{target.rstrip('/')}/{snapshot_name(now)}"
    number = 1
    while files.exists(spark, out):  # taken in the same second
        number += 1
        out = f"{first}-{number}"
    if content == "copy":
        write_emails(read_emails(spark, path, fmt), out, fmt)
    elif content == "manifest":
        raw = spark.read.format("text" if fmt == "csv" else fmt).load(path)
        names = raw.select(F.col("_metadata.file_path").alias("file")).distinct()
        names.withColumn("format", F.lit(fmt)).coalesce(1).write.json(out)
    else:
        raise ValueError(f"unknown snapshot content: {content}")
    return out


def read_snapshot(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The table as it was when the snapshot at ``path`` was taken.

    A data file that a manifest names and that is gone is an error.
    """
    if not files.any_match(spark, f"{path.rstrip('/')}/*.json"):
        return read_emails(spark, path, fmt)
    listed = spark.read.schema("file string, format string").json(path).collect()
    if not listed:
        raise ValueError(f"the snapshot {path} names no file")
    names = [_literal_path(r.file) for r in listed]
    if listed[0].format == "csv":
        return read_emails(spark, names, "csv")
    return spark.read.format(listed[0].format).option("mergeSchema", "true").load(names)


def _with_ids_like(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with ids that no stored row has, where the stored table has ids and ``new`` has none.

    Text ids are digests numbered on after the stored ones (:func:`identified`); numbers go on after
    the largest one, in the order of the rows' places. Ids of ``new`` are kept as they are; ids of
    another type than the stored ones are an error.
    """
    if ID_COL not in existing.columns:
        return new
    kind = existing.schema[ID_COL].dataType
    if ID_COL in new.columns:
        given = new.schema[ID_COL].dataType
        numbers = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
        if given != kind and not (isinstance(given, numbers) and isinstance(kind, numbers)):
            raise ValueError(f"ids of type {given.simpleString()} do not fit a table with {kind.simpleString()}")
        return new
    columns = list(new.columns)
    placed = placed_rows(new, columns, shared_path(new.sparkSession, "append"))
    if isinstance(kind, T.StringType):
        digest = F.substring_index(ID_COL, "-", 1).alias(DIGEST)
        number = F.substring_index(ID_COL, "-", -1).try_cast("bigint")
        stored = existing.select(digest, number.alias("_number")).join(placed.select(DIGEST).distinct(), DIGEST, "left_semi")
        taken = stored.groupBy(DIGEST).agg(F.coalesce(F.max("_number"), F.lit(0)).alias("_taken"))
        return identified(placed, ID_COL, taken).select(ID_COL, *[F.col(f"`{c}`") for c in columns])
    last = existing.agg(F.max(ID_COL)).first()[0] or 0
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()
    bases, total = [], last + 1
    for row in sizes:  # one row per task that wrote
        bases.append((row.part, total))
        total += row.n
    before = new.sparkSession.createDataFrame(bases, "part bigint, base bigint")
    numbered = placed.withColumn("part", part).join(F.broadcast(before), "part")
    own = (F.col("base") + F.col("_place").bitwiseAND((1 << 33) - 1)).cast(kind)
    return numbered.select(own.alias(ID_COL), *[F.col(f"`{c}`") for c in columns])


def append_emails(
    spark: SparkSession,
    path: str,
    new: DataFrame,
    fmt: str = "parquet",
    dry_run: bool = True,
    backup: str | bool = True,
    report: Callable[[str], None] = print,
) -> DataFrame:
    """Append rows to a stored table; returns what was (or would be) added.

    Both sides must hold the required columns. A dry run writes nothing and returns a preview.
    Existing files are never rewritten. Before writing, the state is kept: by default as a manifest
    under ``<path>-snapshots``, as a full copy in the folder that ``backup`` names, not at all with
    ``False``. Rows without an id get one where the table has ids. An append that must not be
    repeated by a second run belongs in ``VersionedMails``.
    """
    existing = require_columns(read_emails(spark, path, fmt))
    require_columns(new)
    report(f"{existing.count()} rows are stored, {new.count()} to be added")
    if dry_run:
        return preview_rows(new, "email_id" if "email_id" in new.columns else "email_text")
    new = _with_ids_like(new, existing)
    if backup:
        kept = (
            snapshot(spark, path, f"{path.rstrip('/')}-snapshots", fmt, "manifest")
            if backup is True else snapshot(spark, path, backup, fmt)
        )
        report(f"the state before is kept at {kept}")
    added = [c for c in new.columns if c not in existing.columns]
    if added and fmt == "csv":
        raise ValueError(f"columns unknown to the CSV table: {added}")
    # Same column order and types as the files already there; absent columns become null.
    aligned = [
        (F.col(f.name) if f.name in new.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in existing.schema
    ]
    write_emails(new.select(*aligned, *added), path, fmt, mode="append")
    return new


def append_csv(spark: SparkSession, path: str, new_csv: str, **options) -> DataFrame:
    """Append the rows of a CSV file to a stored table; options as in ``append_emails``."""
    return append_emails(spark, path, read_emails(spark, new_csv, "csv"), **options)


def single_email(spark: SparkSession, text: str, language: str, label: int) -> DataFrame:
    """A one-row mail table."""
    return spark.createDataFrame(
        [(text, language, int(label))], "email_text string, language string, label int"
    )


def append_single(
    spark: SparkSession, path: str, text: str, label: int, language: str = "en", **options
) -> DataFrame:
    """Append one labelled mail; options as in ``append_emails``."""
    return append_emails(spark, path, single_email(spark, text, language, label), **options)


def cast_labels(df: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Rows with ``label`` as INT, and a quarantine of the rows whose label is not a number."""
    cast = F.expr(f"try_cast(`{label}` as int)")
    bad = F.col(label).isNotNull() & cast.isNull()
    return df.where(~bad).withColumn(label, cast), df.where(bad)
