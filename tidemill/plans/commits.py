"""A new dataset version, its catalog row and its run row as one step that can be repeated.

Everything a commit writes lies under its own id: the version, the catalog row and the run row.  The marker in
``published`` is written last, by one rename, and readers look only at rows whose commit has a marker.  A job that dies
between the steps therefore leaves nothing visible, and running it again with the same id writes only what is missing.

    <root>/versions/<id>.parquet    the rows, or <id>.csv with its sidecar
    <root>/stored/commit=<id>       one row, once the version has been written and checked
    <root>/catalog/commit=<id>      one row of datasets.CATALOG
    <root>/runs/commit=<id>         one row of runs.RUNS
    <root>/published/commit=<id>    the marker
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field, replace
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.plans.cleaning import CleanSpec, clean
from tidemill.roles import data_columns
from tidemill.sources import csv, datasets, runs

#: Fixed value: the title of a cleaning run.
CLEANED = "Data cleaning result"
_STORED = "file_path string, row_count bigint"
_PUBLISHED = "file_path string, published_at timestamp_ntz"
_ID = re.compile(r"[A-Za-z0-9_-]+")


class CommitFailed(RuntimeError):
    """The stored version isn't what was to be stored."""


@dataclass
class Entry:
    """What the catalog and the run log say of a new version."""

    dataset_id: int
    project_id: int
    #: The file name of the version if None.
    name: str | None = None
    target_column: str | None = None
    run_type: str = "cleaning"
    title: str = CLEANED
    payload: dict = field(default_factory=dict)
    score: float | None = None
    #: Orders commits of one dataset; the time of the first try if None.
    created_at: datetime | None = None
    run_id: int = 0


def commit(df: DataFrame, root: str, commit_id: str, entry: Entry, preserve_types: bool = True, rows: int | None = None) -> str:
    """Store ``df``, check it, and publish it with its catalog and run rows; returns the path of the version.

    ``rows`` is the number of rows to find in the stored version, if it is known.  A published id is left as it is, so that a
    repeated call changes nothing; an unfinished one is completed, reusing a version that was written to its end.
    """
    if not _ID.fullmatch(commit_id):
        raise ValueError(f"a commit id has letters, digits, _ and - only: {commit_id!r}")
    spark, root = df.sparkSession, root.rstrip("/")
    path = version_path(root, commit_id, preserve_types)
    if _marked(spark, root, "published", commit_id):
        return path

    wanted = data_columns(df)
    if not _marked(spark, root, "stored", commit_id):
        if preserve_types:
            df.write.mode("overwrite").parquet(path)
        else:
            csv.write_csv(df, path, mode="overwrite")
            datasets.write_sidecar(df, path)
        stored = datasets.load_dataset(spark, path)
        found = stored.count()
        if rows is not None and found != rows or data_columns(stored) != wanted:
            raise CommitFailed(f"{path} holds {found} rows of {data_columns(stored)} and not {rows} of {wanted}")
        _write(spark, [(path, found)], _STORED, f"{root}/stored", commit_id)
    found = spark.read.schema(_STORED).parquet(f"{root}/stored/commit={commit_id}").first()["row_count"]

    at = entry.created_at or datetime.now(UTC).replace(tzinfo=None)
    file_name = path.rsplit("/", 1)[1]
    payload = json.dumps({**entry.payload, "saved_file": file_name})
    catalog = (entry.dataset_id, entry.project_id, entry.name or file_name, path, found, len(wanted), entry.target_column, at)
    run = (entry.run_id, entry.project_id, entry.dataset_id, entry.run_type, entry.title, payload, entry.score, at)
    _write(spark, [catalog], datasets.CATALOG, f"{root}/catalog", commit_id)
    _write(spark, [run], runs.RUNS, f"{root}/runs", commit_id)
    _write(spark, [(path, at)], _PUBLISHED, f"{root}/published", commit_id)
    return path


def clean_and_commit(
    df: DataFrame, spec: CleanSpec, root: str, commit_id: str, entry: Entry, order_by: str | None = None, preserve_types: bool = True
) -> str:
    """Clean a table and commit the result, with the summary as the payload of its run."""
    if _marked(df.sparkSession, root.rstrip("/"), "published", commit_id):
        return version_path(root, commit_id, preserve_types)
    result = clean(df, spec, order_by)
    entry = replace(entry, payload={**entry.payload, **result.summary}, target_column=result.target_column or entry.target_column)
    return commit(result.frame, root, commit_id, entry, preserve_types, result.summary["rows_after"])


def version_path(root: str, commit_id: str, preserve_types: bool = True) -> str:
    return f"{root.rstrip('/')}/versions/{commit_id}.{'parquet' if preserve_types else 'csv'}"


def catalog(spark: SparkSession, root: str) -> DataFrame:
    """The catalog: of each dataset the row of its newest published commit; equal times by commit id."""
    newest = Window.partitionBy("id").orderBy(F.desc("created_at"), F.desc("commit"))
    rows = _published(spark, root, "catalog", datasets.CATALOG).withColumn("place", F.row_number().over(newest))
    return rows.filter(c("place") == 1).drop("place", "commit")


def run_log(spark: SparkSession, root: str) -> DataFrame:
    """The runs of all published commits."""
    return _published(spark, root, "runs", runs.RUNS).drop("commit")


def load(spark: SparkSession, root: str, dataset_id: int) -> DataFrame:
    """The newest published version of a dataset."""
    row = catalog(spark, root).filter(c("id") == dataset_id).first()
    if row is None:
        raise KeyError(f"no published dataset {dataset_id}")
    return datasets.load_dataset(spark, row["file_path"])


def _published(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    base = root.rstrip("/")
    try:
        rows = spark.read.schema(schema + ", commit string").parquet(f"{base}/{kind}")
        marks = spark.read.schema(_PUBLISHED + ", commit string").parquet(f"{base}/published")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema + ", commit string")
    return rows.join(marks.select("commit"), "commit", "left_semi")


def _write(spark: SparkSession, rows: list[tuple], schema: str, folder: str, commit_id: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/commit={commit_id}")


def _marked(spark: SparkSession, root: str, kind: str, commit_id: str) -> bool:
    """Whether a commit has its row of this kind; a folder that a failed job left without rows doesn't count."""
    try:
        return bool(spark.read.schema("file_path string").parquet(f"{root}/{kind}/commit={commit_id}").head(1))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
