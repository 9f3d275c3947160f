"""The dashboard of a project as one document in JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.jsonsafe import json_rows
from tidemill.sources.runs import latest_runs, list_datasets

# Dashboard section of each kind of run.
SECTIONS = {
    "cleaning": "latest_cleaning",
    "eda": "latest_eda",
    "visualization": "latest_visualizations",
    "training": "latest_training",
}
_LISTED = ("id", "name", "row_count", "column_count", "target_column", "created_at")


def snapshot(runs: DataFrame, datasets: DataFrame, project_id: int | None = None) -> DataFrame:
    """``project_id, section, payload``: one row per dataset and per newest run of each kind."""
    listed = list_datasets(datasets, project_id) if project_id is not None else datasets
    tables = listed.select(
        "project_id",
        F.lit("datasets").alias("section"),
        json_rows(listed.select(*_LISTED)).alias("payload"),
    )
    section = F.create_map(*[F.lit(x) for pair in SECTIONS.items() for x in pair])
    runs = latest_runs(runs, project_id).select(
        "project_id", F.element_at(section, c("run_type")).alias("section"), c("payload_json").alias("payload")
    )
    return tables.unionByName(runs)


def export(document: DataFrame, path: str) -> None:
    document.write.mode("overwrite").json(path)
