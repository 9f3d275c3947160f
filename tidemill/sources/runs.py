"""The log of analysis runs and the questions asked of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.jsonsafe import iso_text

# The kinds of run, and the length of a history page.
RUN_TYPES = ("cleaning", "eda", "visualization", "training")
HISTORY = 20

RUNS = (
    "id bigint, project_id bigint, dataset_id bigint, run_type string, title string, "
    "payload_json string, score double, created_at timestamp_ntz"
)


def append_runs(runs: DataFrame, path: str) -> None:
    """Add runs to the log; earlier rows are never rewritten."""
    names = [part.split()[0] for part in RUNS.split(", ")]
    runs.select(*names).write.mode("append").parquet(path)


def history(
    runs: DataFrame, datasets: DataFrame, project_id: int | None = None, limit: int = HISTORY
) -> DataFrame:
    """The newest runs of one project, or of every project, with their dataset's name.

    For one project this is a top-k; for all of them the per-project limit is
    applied in each task before the shuffle, so a busy project stays small.
    """
    names = datasets.select(c("id").alias("dataset_id"), c("name").alias("dataset_name"))
    if project_id is not None:
        runs = runs.filter(c("project_id") == project_id)
    joined = runs.select("id", "project_id", "run_type", "title", "dataset_id", "score", "created_at").join(
        names, "dataset_id"
    )
    newest = [F.desc("created_at"), F.desc("id")]
    if project_id is not None:
        page = joined.orderBy(*newest).limit(limit)
    else:
        place = F.row_number().over(Window.partitionBy("project_id").orderBy(*newest))
        page = joined.withColumn("place", place).filter(c("place") <= limit)
    return page.select(
        "project_id",
        "id",
        "run_type",
        "title",
        "dataset_id",
        "dataset_name",
        "score",
        iso_text(c("created_at")).alias("created_at"),
    )


def latest_runs(runs: DataFrame, project_id: int | None = None) -> DataFrame:
    """``project_id, run_type, id, created_at, payload_json`` of the newest run of each kind.

    Each task keeps only its own newest row per project and kind before the
    shuffle, so payloads of older runs never travel.
    """
    if project_id is not None:
        runs = runs.filter(c("project_id") == project_id)
    keys = ["project_id", "run_type"]
    newest = Window.partitionBy(*keys).orderBy(F.desc("created_at"), F.desc("id"))
    known = runs.filter(c("run_type").isin(*RUN_TYPES)).select(*keys, "id", "created_at", "payload_json")
    return known.withColumn("place", F.row_number().over(newest)).filter(c("place") == 1).drop("place")


def list_datasets(datasets: DataFrame, project_id: int | None = None) -> DataFrame:
    """Datasets of a project (or all, by project), newest first."""
    order: list[Column] = [F.desc("created_at"), F.desc("id")]
    if project_id is not None:
        return datasets.filter(c("project_id") == project_id).orderBy(*order)
    return datasets.orderBy("project_id", *order)
