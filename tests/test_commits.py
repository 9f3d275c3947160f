import json
from datetime import datetime, timedelta

import pytest

from tidemill import CleanSpec
from tidemill.plans import commits
from tidemill.plans.commits import Entry

START = datetime(2024, 1, 1)


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(0, " a ", 1.5), (1, "b", None), (2, " a ", 1.5), (3, None, 2.0)], "_row long, name string, x double")


def names(df):
    return {(r["name"], r["x"]) for r in df.collect()}


@pytest.mark.parametrize("preserve", [True, False])
def test_one_call_publishes_version_catalog_and_run(spark, df, tmp_path, preserve):
    entry = Entry(5, 1, target_column="x", created_at=START, run_id=9)
    spec = CleanSpec(trim_whitespace=True, fill_missing="zero", fill_categorical="unknown")
    path = commits.clean_and_commit(df, spec, str(tmp_path), "c1", entry, preserve_types=preserve)
    assert commits.clean_and_commit(df, spec, str(tmp_path), "c1", entry, preserve_types=preserve) == path
    row = commits.catalog(spark, str(tmp_path)).collect()
    assert [(r["id"], r["file_path"], r["row_count"], r["column_count"], r["target_column"]) for r in row] == [(5, path, 3, 2, "x")]
    assert row[0]["name"] == path.rsplit("/", 1)[1]
    (run,) = commits.run_log(spark, str(tmp_path)).collect()
    payload = json.loads(run["payload_json"])
    assert run["run_type"] == "cleaning" and payload["rows_after"] == 3 and payload["saved_file"] == row[0]["name"] and run["id"] == 9
    assert names(commits.load(spark, str(tmp_path), 5)) == {("a", 1.5), ("b", 0.0), ("Unknown", 2.0)}


@pytest.mark.parametrize("step", ["stored", "catalog", "runs", "published"])
def test_failure_between_the_steps_shows_nothing_and_can_be_repeated(spark, df, tmp_path, monkeypatch, step):
    root = str(tmp_path)
    commits.commit(df.limit(1), root, "old", Entry(5, 1, created_at=START))
    write = commits._write

    def failing(spark, rows, schema, folder, commit_id):
        if folder.endswith(f"/{step}"):
            raise OSError("lost")
        write(spark, rows, schema, folder, commit_id)

    monkeypatch.setattr(commits, "_write", failing)
    new = Entry(5, 1, created_at=START + timedelta(hours=1))
    with pytest.raises(OSError, match="lost"):
        commits.commit(df, root, "new", new, rows=4)
    assert commits.load(spark, root, 5).count() == 1 and commits.run_log(spark, root).count() == 1
    monkeypatch.setattr(commits, "_write", write)
    for _ in range(2):
        commits.commit(df, root, "new", new, rows=4)
    assert commits.load(spark, root, 5).count() == 4 and commits.run_log(spark, root).count() == 2
    assert commits.catalog(spark, root).count() == 1


def test_wrong_version_is_not_published(spark, df, tmp_path):
    with pytest.raises(commits.CommitFailed):
        commits.commit(df, str(tmp_path), "c1", Entry(5, 1), rows=5)
    assert commits.catalog(spark, str(tmp_path)).count() == 0 and commits.run_log(spark, str(tmp_path)).count() == 0
    with pytest.raises(KeyError):
        commits.load(spark, str(tmp_path), 5)
    with pytest.raises(ValueError, match="letters"):
        commits.commit(df, str(tmp_path), "../x", Entry(5, 1))


def test_empty_table(spark, df, tmp_path):
    commits.commit(df.limit(0), str(tmp_path), "c1", Entry(5, 1, created_at=START), rows=0)
    assert commits.load(spark, str(tmp_path), 5).count() == 0 and commits.catalog(spark, str(tmp_path)).first()["row_count"] == 0
