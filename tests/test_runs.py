import json
from datetime import datetime, timedelta

import pytest

from tidemill import CleanSpec, clean
from tidemill.plans.dashboard import export, snapshot
from tidemill.sources import runs
from tidemill.sources.datasets import CATALOG

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def log(spark):
    kinds = [*runs.RUN_TYPES, "other"]
    data = [
        (i, i % 2, i % 3, kinds[i % 5], f"run {i}", json.dumps({"i": i}), 0.5 if i % 4 == 0 else None, START + timedelta(hours=i // 3))
        for i in range(90)
    ]
    return spark.createDataFrame(data, runs.RUNS)


@pytest.fixture(scope="module")
def catalog(spark):
    data = [(i, i % 2, f"d{i}.csv", f"/d/{i}", 10 * i, 3, None if i else "y", START + timedelta(days=i % 2)) for i in range(2)]
    return spark.createDataFrame(data, CATALOG)


def test_history(log, catalog):
    want = sorted((r for r in log.collect() if r["project_id"] == 1 and r["dataset_id"] < 2), key=lambda r: (r["created_at"], r["id"]))
    page = runs.history(log, catalog, 1).collect()
    assert [r["id"] for r in page] == [r["id"] for r in reversed(want)][:20]
    assert page[0]["created_at"] == want[-1]["created_at"].isoformat() and page[0]["dataset_name"] in ("d0.csv", "d1.csv")
    every = runs.history(log, catalog).collect()
    assert {r["id"] for r in every if r["project_id"] == 1} == {r["id"] for r in page}


def test_latest_breaks_ties_by_id(log):
    found = {(r["project_id"], r["run_type"]): json.loads(r["payload_json"])["i"] for r in runs.latest_runs(log).collect()}
    want = {}
    for r in sorted(log.collect(), key=lambda r: (r["created_at"], r["id"])):
        if r["run_type"] in runs.RUN_TYPES:
            want[r["project_id"], r["run_type"]] = r["id"]
    assert found == want


def test_datasets_newest_first(spark, catalog):
    assert [r["id"] for r in runs.list_datasets(catalog, 0).collect()] == [0]
    assert [r["id"] for r in runs.list_datasets(catalog.selectExpr("id", "7 AS project_id", "created_at"), 7).collect()] == [1, 0]


def test_log_is_appended(spark, log, tmp_path):
    path = str(tmp_path / "runs")
    runs.append_runs(log.filter("id < 50"), path)
    runs.append_runs(log.filter("id >= 50"), path)
    assert spark.read.parquet(path).count() == 90


def test_snapshot(spark, log, catalog, tmp_path):
    document = snapshot(log, catalog, 1)
    sections = {}
    for r in document.collect():
        sections.setdefault(r["section"], []).append(json.loads(r["payload"]))
    assert set(sections) == {"datasets", "latest_cleaning", "latest_eda", "latest_visualizations", "latest_training"}
    assert sections["datasets"] == [
        {"id": 1, "name": "d1.csv", "row_count": 10, "column_count": 3, "target_column": None, "created_at": "2024-01-02T00:00:00"}
    ]
    export(document, str(tmp_path / "doc"))
    assert spark.read.json(str(tmp_path / "doc")).count() == document.count()


def test_summary_can_be_logged(spark):
    result = clean(spark.createDataFrame([(1, None), (2, 3.0)], "a int, b double"), CleanSpec(normalize_headers=True))
    row = result.summary_frame().first()
    assert json.loads(row["columns_after"]) == ["a", "b"] and row["rows_after"] == 2 and row["conversion"] is None
    assert json.loads(json.dumps(result.summary)) == result.summary
