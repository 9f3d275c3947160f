import json
import math
import threading
from collections import Counter

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidemill import TrainSpec, train
from tidemill.learning import candidates, cells, dictionary, forests, frames, metrics, preprocessing, training, trees
from tidemill.learning.candidates import CANDIDATES, Sizes
from tidemill.roles import ROW

QUICK = Sizes(boosted_classifier=3, boosted_regressor=3, boosted_depth=2, forest=4, forest_depth=4)


@pytest.fixture(scope="module")
def iris(spark):
    """Three separable classes of unequal size."""
    rows = [
        (i, ["a", "b", "b", "c", "b", "b"][i % 6], float(i % 6) + (i % 10) / 100, None if i % 9 == 0 else i % 4, i % 5 == 0, None if i % 7 == 0 else "uv"[i % 2])
        for i in range(240)
    ]
    return spark.createDataFrame(rows, f"{ROW} bigint, kind string, size double, n int, flag boolean, tag string").cache()


def test_feature_choice(iris):
    assert frames.feature_columns(iris, "kind", ["size", "nope", "kind"]) == ["size"]
    assert frames.feature_columns(iris, "kind", ["nope"]) == ["size", "n", "flag", "tag"]
    with pytest.raises(ValueError):
        frames.feature_columns(iris, "nope")
    with pytest.raises(ValueError):
        frames.feature_columns(iris.select(ROW, "kind"), "kind")
    assert frames.model_frame(iris, "n").count() == 240 - 27


def test_problem_type(spark, iris):
    assert frames.is_classification(iris, "kind") and frames.is_classification(iris, "flag")
    assert frames.is_classification(iris, "n") and not frames.is_classification(iris, "size")
    late = spark.range(30_000).select(F.when(F.col("id") < 29_990, 0).otherwise(F.col("id")).alias("v"))
    assert frames.few_values(late, "v", 12) and not frames.few_values(late, "v", 10)


@pytest.mark.parametrize("label", [None, "kind"])
@pytest.mark.parametrize("share", [0.51, 0.8, 0.9])
def test_split_sizes(iris, label, share):
    rows = frames.split(iris, share, label).collect()
    assert sorted(r[ROW] for r in rows) == list(range(240))
    train_rows = [r for r in rows if r["is_train"]]
    assert len(train_rows) == math.floor(240 * share)
    if label:
        whole, part = Counter(r[label] for r in rows), Counter(r[label] for r in train_rows)
        assert all(abs(part[k] - n * share) < 1 for k, n in whole.items())


def test_split_does_not_depend_on_layout(iris):
    first = {r[ROW]: r["is_train"] for r in frames.split(iris, 0.8, "kind").collect()}
    second = {r[ROW]: r["is_train"] for r in frames.split(iris.repartition(7), 0.8, "kind").collect()}
    assert first == second


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_split_narrows_the_cut_bucket(iris, monkeypatch, most):
    """However many rows one task may rank, the same rows are train rows."""
    want = {r[ROW]: r["is_train"] for r in frames.split(iris, 0.8, "kind").collect()}
    monkeypatch.setattr(frames, "_BUCKET_HEX", 1)
    assert {r[ROW]: r["is_train"] for r in frames.split(iris, 0.8, "kind", ranked_rows=most).collect()} == want
    monkeypatch.setattr(frames, "_LOCAL_CLASSES", 1)
    assert {r[ROW]: r["is_train"] for r in frames.split(iris, 0.8, "kind", ranked_rows=most).collect()} == want


def test_split_with_many_classes(spark, monkeypatch):
    monkeypatch.setattr(frames, "_LOCAL_CLASSES", 5)
    df = spark.range(400).selectExpr(f"id AS {ROW}", "id % 40 AS k")
    part = frames.split(df, 0.75, "k").filter("is_train").groupBy("k").count().collect()
    assert sum(r["count"] for r in part) == 300 and {r["count"] for r in part} <= {7, 8}


def test_one_class_and_one_bucket(spark, monkeypatch):
    """All rows in one hash bucket are still split exactly."""
    monkeypatch.setattr(frames, "_BUCKET_HEX", 0)
    df = spark.range(50).selectExpr(f"id AS {ROW}")
    assert frames.split(df, 0.9).filter("is_train").count() == 45


def test_impute_and_scale(spark):
    df = spark.createDataFrame([(1.0, 5), (2.0, 5), (3.0, 5), (10.0, 5), (None, 5)], "x double, k int")
    stats = preprocessing.numeric_stats(df, ["x", "k"])
    assert (stats["x"].median, stats["x"].mean, stats["k"].scale) == (2.5, 3.7, 1.0)
    scaled = [r["x"] for r in preprocessing.impute_scale(df, stats).collect()]
    assert sum(scaled) == pytest.approx(0) and sum(v * v for v in scaled) / 5 == pytest.approx(1)


def encoded(spark, fitted, rows, schema):
    ready = PipelineModel(fitted.stages).transform(spark.createDataFrame(rows, schema))
    return [[round(v, 6) for v in r[0]] for r in ready.select(vector_to_array(preprocessing.FEATURES)).collect()]


@pytest.mark.parametrize("local, broadcast", [(10, 100), (1, 100), (0, 100), (0, 0)])
def test_one_hot(spark, monkeypatch, tmp_path, local, broadcast):
    """Local lists, joins of either kind, and both side by side."""
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", broadcast)
    train_df = spark.createDataFrame([("b", True), ("it's", None), ("b", True), (None, False)], "c string, o boolean").toDF("c", "odd 'x' `y`")
    fitted = preprocessing.fit_preprocessor(train_df, ["c", "odd 'x' `y`"], local)
    assert fitted.feature_names == ["cat__c_b", "cat__c_it's", "cat__odd 'x' `y`_False", "cat__odd 'x' `y`_True"]
    new = spark.createDataFrame([("it's", False), ("zzz", None), (None, True)], "c string, o boolean").toDF("c", "odd 'x' `y`")
    PipelineModel(fitted.stages).write().overwrite().save(str(tmp_path / "stages"))
    for stages in (PipelineModel(fitted.stages), PipelineModel.load(str(tmp_path / "stages"))):
        rows = [list(r[0]) for r in stages.transform(new).select(vector_to_array(preprocessing.FEATURES)).collect()]
        assert sorted(rows) == sorted([[0, 1, 1, 0], [0, 0, 0, 1], [1, 0, 0, 1]])


def test_positions_follow_the_sort_order(spark):
    rows = [(g, f"v{i * 7919 % 1000:04d}{'é' * (i % 2)}") for g in (0, 3) for i in range(1000)] + [(5, "alone")]
    df = spark.createDataFrame(rows, "which int, value string").repartition(6)
    found = {(r["which"], r["value"]): r["position"] for r in dictionary.with_positions(df, "which", "value").collect()}
    for g in (0, 3, 5):
        assert [found[g, v] for v in sorted(v for k, v in rows if k == g)] == list(range(sum(k == g for k, _ in rows)))


def test_wide_tables_train(spark, monkeypatch, tmp_path):
    """Every row has a name of its own, and there are more classes than are listed."""
    monkeypatch.setattr(dictionary, "BROADCAST_ROWS", 50)
    df = spark.range(300).selectExpr(f"id AS {ROW}", "concat('name ', id) AS name", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('c', id % 60) END AS city", "(id % 60) * 1.5 AS x", "id * 2.0 AS y")
    few, many = (train(df, TrainSpec("y", model_type="linear", local_values=n)) for n in (10_000, 10))
    assert few.summary["metrics"] == pytest.approx(many.summary["metrics"], abs=1e-3)
    assert few.predictions.select("seq", "actual").collect() == many.predictions.select("seq", "actual").collect()
    assert many.importance.count() == 15
    spec = {"feature_columns": ("x", "name"), "model_type": "random_forest", "sizes": QUICK}
    listed, joined = (train(df, TrainSpec("city", local_classes=n, local_values=n, **spec)) for n in (1000, 5))
    assert joined.summary["metrics"]["class_count"] == 41
    assert {k: v for k, v in listed.summary["metrics"].items() if k != "classes"} == pytest.approx({k: v for k, v in joined.summary["metrics"].items() if k != "class_count"})
    matrix = {(r["actual"], k): r[k] for r in listed.confusion.collect() for k in listed.confusion.columns[1:] if r[k]}
    assert {(r["actual"], r["predicted"]): r["n"] for r in joined.confusion.collect()} == matrix
    joined.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df.drop("city"))
    assert sorted(r.predicted_value for r in again.collect()) == sorted(r.predicted_value for r in joined.model.transform(df.drop("city")).collect())


def test_thousands_of_classes(spark):
    df = spark.range(15_000).selectExpr(f"id AS {ROW}", "concat('k', id % 5000) AS label", "id % 5000 AS x")
    result = train(df, TrainSpec("label", ("x",), "random_forest", sizes=Sizes(forest=1, forest_depth=3)))
    assert result.summary["metrics"]["class_count"] == 5000 and result.summary["train_rows"] == 12_000
    assert result.confusion.agg(F.sum("n")).first()[0] == 3000


def test_report_keeps_lists(iris):
    result = train(iris, TrainSpec("kind", ("size",), "random_forest", sizes=QUICK))
    row = result.summary_frame().first()
    assert json.loads(row["metrics"])["classes"] == ["a", "b", "c"] and json.loads(row["selected_feature_columns"]) == ["size"]
    assert json.loads(row["top_features"]) == [[r["name"], r["importance"]] for r in result.importance.collect()]
    assert [x[0] for x in json.loads(row["model_leaderboard"])] == ["random_forest"]


def test_classification_metrics(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] + [("c", "d")]
    df = spark.createDataFrame(pairs, "y string, p string")
    row = metrics.classification_metrics(df, "y", "p").first()
    # By hand: precision a 5/6, b 3/5, c 0; recall a 5/7, b 1, c 0.
    assert row["accuracy"] == round(8 / 12, 4)
    assert row["precision"] == round((7 * 5 / 6 + 3 * 3 / 5) / 12, 4)
    assert row["recall"] == round((7 * 5 / 7 + 3) / 12, 4)
    assert row["f1_score"] == round((7 * 10 / 13 + 3 * 6 / 8) / 12, 4)
    matrix = {r["actual"]: r.asDict() for r in metrics.confusion_matrix(df, "y", "p", list("abcd")).collect()}
    assert matrix["a"] == {"actual": "a", "a": 5, "b": 2, "c": 0, "d": 0}
    assert matrix["d"] == {"actual": "d", "a": 0, "b": 0, "c": 0, "d": 0}


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (6.0, 5.0)], "y double, p double")
    row = metrics.regression_metrics(df, "y", "p").first()
    assert row.asDict() == {"r2_score": round(1 - 2 / 14, 4), "rmse": round(math.sqrt(2 / 3), 4), "mae": round(2 / 3, 4)}
    flat = spark.createDataFrame([(2.0, 2.0), (2.0, 3.0)], "y double, p double")
    assert metrics.regression_metrics(flat, "y", "p").first()["r2_score"] == 0.0


def test_train_classes(spark, iris, tmp_path):
    result = train(iris, TrainSpec("kind", sizes=QUICK))
    s = result.summary
    assert [r["model"] for r in result.leaderboard.collect()] == list(CANDIDATES)
    assert (s["train_rows"], s["test_rows"], s["total_rows"]) == (192, 48, 240)
    assert (s["numeric_feature_count"], s["categorical_feature_count"]) == (2, 2)
    assert s["problem_type"] == "classification" and s["metrics"]["classes"] == ["a", "b", "c"]
    best = max(r["test_score"] for r in result.leaderboard.collect())
    assert s["test_score"] == best == s["score"] >= 0.9
    assert sum(r[k] for r in result.confusion.collect() for k in "abc") == 48
    assert result.predictions.count() == 10 and result.importance.count() <= 15
    assert result.importance.first()["name"] == "num__size"
    assert result.summary_frame().first()["selected_model_key"] == s["selected_model_key"]

    path = str(tmp_path / "model")
    result.save(path)
    result.save(path)
    again = PipelineModel.load(path).transform(iris.drop("kind"))
    assert again.filter(F.col("predicted_value").isin("a", "b", "c")).count() == 240


def test_train_numbers(spark):
    df = spark.range(200).selectExpr(f"id AS {ROW}", "id * 1.0 AS x", "id % 3 AS z", "id * 2.5 + 1 AS y")
    result = train(df, TrainSpec("y", ("x",), "linear"))
    assert result.summary["selected_model_key"] == "linear" and result.confusion is None
    assert result.summary["metrics"]["r2_score"] == 1.0 and result.summary["train_rows"] == 160
    assert result.importance.collect()[0]["name"] == "num__x"


def test_any_feature_name_is_safe(spark):
    df = spark.range(100).selectExpr("id AS label", "id % 3 AS features", "id % 2 AS is_train", "id % 5 = 0 AS actual", "id * 2.0 AS n")
    result = train(df, TrainSpec("n", model_type="linear"))
    assert result.summary["feature_count"] == 4 and result.summary["metrics"]["r2_score"] == 1.0


@pytest.mark.parametrize("name", ["xgboost", "extra_trees"])
def test_train_two_classes(iris, name):
    result = train(iris, TrainSpec("flag", ("size", "n"), name, sizes=QUICK))
    assert [r["model"] for r in result.leaderboard.collect()] == [name]
    assert result.summary["metrics"]["classes"] == ["False", "True"]


def test_spec_is_checked(iris):
    for share in (0.5, 0.95):
        with pytest.raises(ValueError):
            TrainSpec("kind", train_split=share)


@pytest.mark.parametrize("rows, cores, expected", [(5, 12, (1, 1)), (16_000, 12, (1, 1)), (900_000, 12, (12, 3)), (7_200_000, 12, (12, 8)), (50_000_000, 12, (50, 50))])
def test_tasks_stop_at_the_cores(rows, cores, expected):
    assert training._tasks(rows, cores) == expected


@pytest.mark.parametrize("target", ["kind", "size"])
def test_forest_in_parts(spark, iris, tmp_path, target):
    """All trees, in parts that differ; the whole is their mean or the sum of their votes, also after a reload."""
    result = train(iris, TrainSpec(target, ("n", "flag", "tag"), "random_forest", sizes=Sizes(forest=7, forest_depth=4)))
    model = result.model.stages[-2 if target == "kind" else -1]
    assert sorted(m.getNumTrees for m in model.parts) == [1, 2, 2, 2] and model.getNumTrees == 7
    assert len({m.toDebugString.split("\n", 1)[1] for m in model.parts}) > 1
    assert result.summary["model_type"] == ("RandomForestClassificationModel" if target == "kind" else "RandomForestRegressionModel")
    assert sum(model.featureImportances.toArray()) == pytest.approx(1)
    path = str(tmp_path / "model")
    result.save(path)
    for whole in (result.model, PipelineModel.load(path)):
        rows = whole.transform(iris).collect()
        for r in rows[::40]:
            features = r["__features"]
            if target == "kind":
                votes = sum(m.predictRaw(features).toArray() for m in model.parts)
                assert list(r["rawPrediction"]) == pytest.approx(list(votes)) and list(r["probability"]) == pytest.approx(list(votes / 7))
                assert r["prediction"] == votes.argmax() and r["predicted_value"] == "abc"[votes.argmax()]
            else:
                assert r["prediction"] == pytest.approx(sum(m.predict(features) * m.getNumTrees for m in model.parts) / 7)


def test_parts_of_a_forest():
    assert forests.part_sizes(220, 12) == [19] * 4 + [18] * 8 and forests.part_sizes(2, 12) == [1, 1] and forests.part_sizes(4, 1) == [4]


def test_each_candidate_predicts_once(iris, monkeypatch):
    """A model, which may be large, is sent for one pass over the rows; scores, metrics and previews read its stored result."""
    passes = []
    monkeypatch.setattr(training, "stage", lambda df, label, kept=training.stage: passes.append(label) or kept(df, label))
    result = train(iris, TrainSpec("kind", ("size",), "random_forest", sizes=QUICK))
    assert passes.count("predicted") == 1
    assert "__features" not in result.scored.columns and result.scored.count() == result.summary["test_rows"]


def test_forests_leave_a_core_to_other_candidates(iris, monkeypatch):
    """Both forests share the threads of their parts, one less than the cores if other candidates are fitted beside them."""
    cores, running, most, lock = iris.sparkSession.sparkContext.defaultParallelism, [0], [0], threading.Lock()

    def counted(learner):
        class Counted(learner):
            def fit(self, dataset, params=None):
                with lock:
                    running[0] += 1
                    most[0] = max(most[0], running[0])
                try:
                    return super().fit(dataset, params)
                finally:
                    with lock:
                        running[0] -= 1

        return Counted

    monkeypatch.setattr(candidates, "RandomForestRegressor", counted(candidates.RandomForestRegressor))
    result = train(iris, TrainSpec("size", ("n", "flag"), sizes=Sizes(boosted_regressor=2, boosted_depth=2, forest=8, forest_depth=3)))
    assert len(result.summary["model_leaderboard"]) == 4
    assert most[0] == max(1, cores - 1) and training._parts(cores, 1) == cores


def test_parts_are_stored_side_by_side(iris, tmp_path, monkeypatch):
    result = train(iris, TrainSpec("size", ("n", "flag"), "random_forest", sizes=Sizes(forest=4, forest_depth=3)))
    model = result.model.stages[-1]
    together = threading.Barrier(min(len(model.parts), forests._STORED_AT_ONCE), timeout=60)
    kind = type(model.parts[0])
    monkeypatch.setattr(kind, "save", lambda self, path, save=kind.save: together.wait() >= 0 and save(self, path))
    result.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).stages[-1]
    assert [m.toDebugString.split("\n", 1)[1] for m in again.parts] == [m.toDebugString.split("\n", 1)[1] for m in model.parts]


def test_like_rows_lie_together(iris, monkeypatch):
    """Learners get the rows of each task sorted by their features, categories first, so that neighbours take the same way down a tree."""
    kept = {}
    monkeypatch.setattr(training, "stage", lambda df, label, stored=training.stage: kept.setdefault(label, stored(df, label)))
    train(iris, TrainSpec("kind", ("size", "n", "tag"), "random_forest", sizes=QUICK))
    rows = kept["model-parts"]
    assert set(rows.columns) == {"__features", "__label", "__train", "__key"} and rows.count() == 240
    by_key = {r[ROW]: (r["tag"] or "", r["size"]) for r in iris.collect()}
    keys = rows.withColumn("file", F.input_file_name()).select("file", "__key").collect()
    for file in {r["file"] for r in keys}:
        own = [by_key[r["__key"]] for r in keys if r["file"] == file]
        assert own == sorted(own)


@pytest.mark.parametrize("classification", [False, True])
def test_boosted_trees_on_cells_are_those_on_rows(spark, classification):
    """Rows in the same bins and categories are one weighted row, which leads to the same trees."""
    label, sizes = candidates.LABEL, Sizes(boosted_classifier=4, boosted_regressor=4, boosted_depth=3)
    df = spark.range(3000).selectExpr("cast(id AS double) AS x", "pmod(hash(id), 4) AS n", "CASE pmod(hash(id, 1), 3) WHEN 0 THEN 'u' WHEN 1 THEN 'v' END AS tag", "pmod(hash(id, 2), 1000) / 7 AS noise")
    value = F.col("x") / 50 + F.col("n") * F.col("n") * 3 + F.when(F.col("tag") == "u", 40).otherwise(0) + F.col("noise") / 3
    df = df.withColumn(label, F.when(value > 90, 1.0).otherwise(0.0) if classification else value)
    prepare = preprocessing.fit_preprocessor(df, ["x", "n", "tag"])
    bins = cells.fit_bins(df, prepare, 8)
    rows = PipelineModel([*prepare.stages, *bins]).transform(df).withColumn(cells.WEIGHT, F.lit(1.0)).cache()
    few = cells.cells(rows, label, classification).cache()
    assert few.count() <= 8 * 4 * 2 * (2 if classification else 1) and few.agg(F.sum(cells.WEIGHT)).first()[0] == 3000
    models = [candidates.estimators(classification, 2, 3000, sizes)["xgboost"].fit(x) for x in (rows, few)]
    found = [[r["prediction"] for r in m.transform(rows).orderBy("x").select("prediction").collect()] for m in models]
    assert found[0] == pytest.approx(found[1], abs=1e-6) and len(set(found[0])) > 1
    assert candidates.importances(models[0]) == pytest.approx(candidates.importances(models[1]), abs=1e-6)


def test_boosted_trees_pass_over_cells(spark, monkeypatch, tmp_path):
    """What boosted trees pass over doesn't grow with the rows; numbers of few values keep them all, and a stored model reads raw rows."""
    kept = {}
    monkeypatch.setattr(training, "stage", lambda df, label, stored=training.stage: kept.setdefault(label, stored(df, label)))
    df = spark.range(12_000).selectExpr(f"id AS {ROW}", "id * 1.5 AS x", "if(id % 4000 = 7, 9, id % 3) AS z", "id * 0.01 + id % 3 AS y").cache()
    result = train(df, TrainSpec("y", ("x", "z"), "xgboost", sizes=Sizes(boosted_regressor=20, boosted_depth=4)))
    rows = kept["cell-parts"].collect()
    assert len(rows) <= 64 * 4 and sum(r[cells.WEIGHT] for r in rows) == result.summary["train_rows"] == 9600
    assert len({r[cells.BINNED][1] for r in rows}) == 4 and result.summary["test_score"] > 0.9
    result.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df.drop("y"))
    expected = {r["__key"]: r["prediction"] for r in result.scored.collect()}
    assert {r[ROW]: r["prediction"] for r in again.collect() if r[ROW] in expected} == expected


def _priced(spark, rows):
    noise = "pmod(hash(id, 2), 1000) / 90"
    return spark.range(rows).selectExpr(
        f"id AS {ROW}", "pmod(hash(id, 3), 5000) / 10 AS x", "pmod(hash(id), 7) AS n", "element_at(array('u', 'v', 'w', null), 1 + pmod(hash(id, 1), 4)) AS tag",
        f"pmod(hash(id, 3), 5000) / 300 + pmod(hash(id), 7) * 3 + pmod(hash(id, 1), 4) * pmod(hash(id), 7) + {noise} AS y",
    )


def _coded(spark, features):
    """Rows, their features, and what tasks make of them: a number for each feature and row."""
    df = _priced(spark, 1500).withColumnRenamed("y", candidates.LABEL).withColumn("x", F.expr("floor(x / 20)"))
    prepare = preprocessing.fit_preprocessor(df, features)
    rows = PipelineModel(prepare.stages).transform(df).orderBy(ROW).cache()
    found = trees.tree_features(prepare, [])
    columns = [np.array([r[0] for r in rows.select(f.column).collect()]) for f in found]
    for f, x in zip(found, columns, strict=True):
        f.cuts = [] if f.width else trees.cut_points(*map(np.ndarray.tolist, np.unique(x, return_counts=True)), 64)
    return prepare, rows, found, [f.coded(x) for f, x in zip(found, columns, strict=True)]


@pytest.mark.parametrize("depth, least", [(1, 1), (4, 1), (30, 1), (30, 40)])
def test_a_grown_tree_is_that_of_spark(spark, depth, least):
    prepare, rows, features, codes = _coded(spark, ["x", "n", "tag"])
    label = np.array([r[0] for r in rows.select(candidates.LABEL).collect()])
    learner = DecisionTreeRegressor(featuresCol=preprocessing.FEATURES, labelCol=candidates.LABEL, maxDepth=depth, minInstancesPerNode=least, maxBins=64)
    expected = learner.fit(rows)
    *nodes, gains = trees.grow(features, codes, np.ones(len(label)), label - label.mean(), depth, least, prepare.size, prepare.size, np.random.default_rng(1))
    predicted = trees.walk(features, np.stack(codes), nodes) + label.mean()
    assert predicted.tolist() == pytest.approx([r["prediction"] for r in expected.transform(rows).select("prediction").collect()])
    importances = expected.featureImportances.toArray()
    # Of equal splits either may win, as in nodes of two categories or cells.
    assert (gains / gains.sum())[:2].tolist() == pytest.approx(importances[:2].tolist(), abs=1e-4)
    assert (nodes[0] >= 0).sum() == expected.numNodes // 2 and len(nodes[3]) == expected.numNodes // 2 + 1


def test_a_grown_tree_with_weights_and_drawn_features(spark):
    """Counted cells are their rows, and a node only splits by features that were drawn for it."""
    prepare, rows, features, codes = _coded(spark, ["x", "n", "tag"])
    label = np.array([r[0] for r in rows.select(candidates.LABEL).collect()])
    cells, at, n = np.unique(np.stack(codes), axis=1, return_inverse=True, return_counts=True)
    total = np.bincount(at.ravel(), label)
    trees_of = [
        trees.grow(features, list(c), w, t, 6, 1, prepare.size, prepare.size, np.random.default_rng(1))
        for c, w, t in ((codes, np.ones(len(label)), label), (cells, n.astype(float), total))
    ]
    predicted = [trees.walk(features, cells, x[:4]) for x in trees_of]
    assert predicted[0].tolist() == pytest.approx(predicted[1].tolist())
    assert set(trees_of[0][0]) == set(range(-1, prepare.size))
    roots = {int(trees.grow(features, list(cells), n.astype(float), total, 1, 1, 1, prepare.size, np.random.default_rng(k))[0][0]) for k in range(60)}
    assert roots == set(range(prepare.size))
    same = trees.grow(features, list(cells), n.astype(float), n * 3.7, 30, 1, prepare.size, prepare.size, np.random.default_rng(1))
    assert same[0].tolist() == [-1] and same[3].tolist() == pytest.approx([3.7])


def test_cut_points():
    assert trees.cut_points([3.0, 1.0, 2.0], [1, 1, 9], 64) == [1.5, 2.5] and trees.cut_points([5.0], [3], 64) == []
    even = trees.cut_points([float(x) for x in range(100)], [1] * 100, 4)
    assert even == [24.5, 49.5, 74.5]
    assert len(trees.cut_points([float(x) for x in range(100)], [1000] + [1] * 99, 4)) <= 3
    wide = trees.Feature("a", 0, 9, [])
    assert trees.fits(1000, [wide], 9) and not trees.fits(10**8, [wide], 9) and not trees.fits(10, [wide], 1001)


@pytest.mark.parametrize("name", ["random_forest", "extra_trees"])
def test_large_forests_are_grown_by_tasks(spark, tmp_path, monkeypatch, name):
    """Forests whose nodes are more than the driver may hold aren't fitted by Spark's learner; scores and importances are like its own."""
    df, sizes = _priced(spark, 3000).cache(), Sizes(forest=230)
    fitted, fit = [], candidates.RandomForestRegressor.fit
    monkeypatch.setattr(candidates.RandomForestRegressor, "fit", lambda self, *a: fitted.append(1) or fit(self, *a))
    monkeypatch.setattr(trees, "_SENT_BYTES", 50_000)
    monkeypatch.setattr(trees, "_KEPT_CELLS", 100)
    result = train(df, TrainSpec("y", ("x", "n", "tag"), name, sizes=sizes))
    model = result.model.stages[-1]
    assert not fitted and model.getNumTrees == 230 and len(model._parts[0]) > 2
    assert result.summary["model_type"] == "RandomForestRegressionModel"
    result.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df.drop("y"))
    expected = {r["__key"]: r["prediction"] for r in result.scored.collect()}
    assert {r[ROW]: r["prediction"] for r in again.collect() if r[ROW] in expected} == pytest.approx(expected)
    few = train(df, TrainSpec("y", ("x", "n", "tag"), name, sizes=Sizes(forest=40)))
    assert fitted
    for k in ("train_score", "test_score"):
        assert result.summary[k] == pytest.approx(few.summary[k], abs=0.02)
    assert candidates.importances(model) == pytest.approx(candidates.importances(few.model.stages[-1]), abs=0.03)


def test_large_forests_beside_other_candidates(spark, tmp_path, monkeypatch):
    """Both forests are grown one after the other, on a core less than there are, and the best candidate is stored and read again."""
    cores, tasks, running, most = spark.sparkContext.defaultParallelism, [], [0], [0]

    def stored(df, label, kept=trees.stage):
        tasks.append(df.rdd.getNumPartitions())
        running[0] += 1
        most[0] = max(most[0], running[0])
        try:
            return kept(df, label)
        finally:
            running[0] -= 1

    monkeypatch.setattr(trees, "stage", stored)
    df = _priced(spark, 3000).withColumn("y", F.expr("abs(n - 3) * 5 + y / 10")).cache()
    result = train(df, TrainSpec("y", ("x", "n", "tag"), sizes=Sizes(boosted_regressor=2, boosted_depth=2, forest=230)))
    assert tasks == [max(1, cores - 1)] * 2 and most[0] == 1
    scores = {r["model"]: r["test_score"] for r in result.leaderboard.collect()}
    assert list(scores) == list(CANDIDATES) and result.summary["selected_model_key"] == max(scores, key=scores.get) in candidates.FORESTS
    result.save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df.drop("y"))
    expected = {r["__key"]: r["prediction"] for r in result.scored.collect()}
    assert {r[ROW]: r["prediction"] for r in again.collect() if r[ROW] in expected} == pytest.approx(expected)
