"""A mail table with versions: rows are only ever added, and every state can be read again.

Under the table's path:

* ``data/<key>``: the rows of one append, Parquet files that are never changed;
* ``ids/<key>``: the digests of these rows with the highest number of each;
* ``files/<key>``: the append's manifest, names and row counts of its files, written by executors;
* ``versions/<number>.json``: the commit of an append, a small file that appears by one rename.

A version is the appends up to its number. A commit never replaces one that is there: of two
writers for the same number one fails, reads the new state and starts again. Folders without a
commit (of an append that failed) are never read.
"""

from __future__ import annotations

import json
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailsift.operators.identity import DIGEST, identified, placed_rows
from mailsift.operators.quality import require_columns
from mailsift.session import shared_path
from mailsift.sources import files

VERSION_SCHEMA = "version bigint, append_id string, key string, n_rows bigint, committed_at timestamp"
ATTEMPTS = 20


class VersionedMails:
    """A versioned table of labelled mails at ``path``; ids are given when rows are appended."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "email_id"):
        self.spark, self.path, self.id_col = spark, path.rstrip("/"), id_col

    # --- versions -----------------------------------------------------------------------------

    def versions(self) -> DataFrame:
        """One row per version: ``version, append_id, key, n_rows, committed_at``."""
        if not files.exists(self.spark, f"{self.path}/versions"):
            return self.spark.createDataFrame([], VERSION_SCHEMA)
        return self.spark.read.schema(VERSION_SCHEMA).json(f"{self.path}/versions")

    def _commits(self) -> list:
        """The commits in order; there is one per append."""
        return sorted(self.versions().collect(), key=lambda r: r.version)

    def latest(self) -> int:
        """The number of the newest version; 0 for a table without any."""
        return max((r.version for r in self._commits()), default=0)

    def version_at(self, moment: datetime) -> int:
        """The newest version committed at ``moment`` (UTC where it has no zone) or before; 0 if none."""
        aware = moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)
        seen = self.versions().where(F.col("committed_at") <= F.lit(aware))
        return seen.agg(F.max("version")).first()[0] or 0

    def _upto(self, version: int | None) -> list:
        commits = self._commits()
        if version is None:
            version = max((r.version for r in commits), default=0)
        found = [r for r in commits if r.version <= version]
        if not found or found[-1].version != version:
            raise ValueError(f"no version {version} of {self.path}")
        return found

    def _read(self, folder: str, commits: list) -> DataFrame:
        paths = [f"{self.path}/{folder}/{r.key}" for r in commits]
        return self.spark.read.option("mergeSchema", "true").parquet(*paths)

    def as_of(self, version: int | None = None) -> DataFrame:
        """All rows of a version, of the newest one by default; an unknown version is an error.

        Columns that came with later appends are those of the version read: null in older rows.
        """
        return self._read("data", self._upto(version))

    def added_in(self, version: int) -> DataFrame:
        """The rows that one version added."""
        return self._read("data", self._upto(version)[-1:])

    def files(self, version: int | None = None) -> DataFrame:
        """The manifest of a version: ``file, n_rows`` of each data file."""
        return self._read("files", self._upto(version))

    def damaged(self, version: int | None = None) -> DataFrame:
        """Files of a version that are missing, unknown or hold another number of rows.

        ``file, n_rows`` (by the manifest), ``found_rows``; only row counts are read.
        """
        found = _row_counts(self.as_of(version)).withColumnRenamed("n_rows", "found_rows")
        both = self.files(version).join(found, "file", "full")
        return both.where(~F.col("n_rows").eqNullSafe(F.col("found_rows")))

    # --- appending ----------------------------------------------------------------------------

    def append(self, rows: DataFrame, append_id: str) -> int:
        """Add rows and commit; returns the version that holds them.

        ``append_id`` names the append: if it is committed already, nothing is added and its version
        is returned, so a job can be run again after any failure. Each row gets its id here, the
        digest of its fields and the number of its occurrence in the table; a column of that name
        is kept as ``source_id``. Rows equal to stored ones are added and numbered on.
        """
        require_columns(rows)
        columns = list(rows.columns)
        if self.id_col in columns:
            rows = rows.withColumnRenamed(self.id_col, "source_id")
            columns = list(rows.columns)
        placed = placed_rows(rows, columns, shared_path(self.spark, "append"))
        for _ in range(ATTEMPTS):
            commits = self._commits()
            done = [r.version for r in commits if r.append_id == append_id]
            if done:
                return done[0]
            key = uuid.uuid4().hex
            self._write(placed, columns, commits, key)
            version = (commits[-1].version if commits else 0) + 1
            n_rows = self.spark.read.parquet(f"{self.path}/files/{key}").agg(F.sum("n_rows")).first()[0] or 0
            if self._commit(version, append_id, key, n_rows):
                return version
        raise RuntimeError(f"{ATTEMPTS} other appends to {self.path} came first")

    def _write(self, placed: DataFrame, columns: list[str], commits: list, key: str) -> None:
        taken = None
        if commits:
            new = placed.select(DIGEST).distinct()
            stored = self._read("ids", commits).join(new, DIGEST, "left_semi")
            taken = stored.groupBy(DIGEST).agg(F.max("_number").alias("_taken"))
        named = identified(placed, self.id_col, taken)
        data = f"{self.path}/data/{key}"
        named.select(self.id_col, *[F.col(f"`{c}`") for c in columns]).write.parquet(data)
        written = self.spark.read.parquet(data)
        digest = F.substring_index(self.id_col, "-", 1).alias(DIGEST)
        number = F.substring_index(self.id_col, "-", -1).cast("bigint")
        highest = written.groupBy(digest).agg(F.max(number).alias("_number"))
        highest.write.parquet(f"{self.path}/ids/{key}")
        _row_counts(written).write.parquet(f"{self.path}/files/{key}")

    def _commit(self, version: int, append_id: str, key: str, n_rows: int) -> bool:
        """Make a version visible; False if its number is taken."""
        record = {
            "version": version, "append_id": append_id, "key": key, "n_rows": n_rows,
            "committed_at": datetime.now(timezone.utc).isoformat(),
        }
        draft = f"{self.path}/drafts/{key}.json"
        files.make_folder(self.spark, f"{self.path}/versions")
        files.write_small(self.spark, draft, json.dumps(record).encode())
        return files.move(self.spark, draft, f"{self.path}/versions/{version:010d}.json")


def _row_counts(table: DataFrame) -> DataFrame:
    """``file, n_rows`` of the files that a table is read from, counted by the executors."""
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    return table.select(name.alias("file")).groupBy("file").agg(F.count("*").alias("n_rows"))
