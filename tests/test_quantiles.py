"""Exact quantiles against numpy, with the narrowing forced on small data."""

import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.operators import quantiles
from tidemill.operators.quantiles import exact_quantiles, outlier_bounds

PROBS = [0.0, 0.01, 0.25, 1 / 3, 0.5, 0.75, 0.999, 1.0]


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    n = 60_000
    pdf = pd.DataFrame(
        {
            "uniform": rng.random(n),
            "third_equal": np.where(rng.random(n) < 0.34, 7.0, rng.normal(0, 1e6, n)),
            "few": rng.integers(0, 3, n).astype(float),
            "constant": 3.5,
            "wide": np.exp(rng.normal(0, 8, n)),
        }
    )
    pdf["gaps"] = pdf["uniform"].where(rng.random(n) < 0.5)
    path = str(tmp_path_factory.mktemp("q") / "skewed.parquet")
    pdf.to_parquet(path)
    return spark.read.parquet(path), pdf


@pytest.mark.parametrize("finish_rows", [quantiles.FINISH_ROWS, 500, 10])
def test_matches_numpy(skewed, finish_rows):
    df, pdf = skewed
    found = exact_quantiles(df, {n: c(n) for n in pdf}, PROBS, finish_rows=finish_rows)
    for name in pdf:
        np.testing.assert_allclose(found[name], pdf[name].quantile(PROBS), rtol=1e-12)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0]), st.floats(-1e9, 1e9)), min_size=1, max_size=40))
def test_any_list(spark, items):
    df = spark.createDataFrame([(v,) for v in items], "x double")
    expected = pd.Series(items, dtype=float).quantile(PROBS).tolist()
    for finish_rows in (100, 2):
        found = exact_quantiles(df, {"x": c("x")}, PROBS, finish_rows=finish_rows)["x"]
        if all(v is None for v in items):
            assert found == [None] * len(PROBS)
        else:
            np.testing.assert_allclose(found, expected, rtol=1e-9, atol=1e-6)


def test_unlucky_sample_only_costs_rounds(skewed, monkeypatch):
    """Cuts far off the wanted rank must not change the answer."""
    df, pdf = skewed
    monkeypatch.setattr(quantiles._Search, "shares", lambda self: (0.9, 0.95))
    found = exact_quantiles(df, {"x": c("wide")}, [0.25, 0.5], finish_rows=5000)["x"]
    np.testing.assert_allclose(found, pdf["wide"].quantile([0.25, 0.5]), rtol=1e-12)


def test_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (1, 2, 3, 10)], "x int")
    assert exact_quantiles(df, {"x": c("x")}, [0.25, 0.5, 0.75])["x"] == [1.75, 2.5, 4.75]
    assert outlier_bounds(df, c("x")) == (1.75 - 4.5, 4.75 + 4.5)
    assert outlier_bounds(df.select(F.lit(None).cast("int").alias("x")), c("x")) is None


def test_overlapping_intervals(skewed):
    """Intervals of a column may overlap, and columns have different numbers of them."""
    df, pdf = skewed
    searches = [
        quantiles._Search("x", 120, 200, 100, 10.0, 30.0),
        quantiles._Search("x", 130, 300, 100, 10.0, None),
        quantiles._Search("x", 5, 100, 0, None, 10.5),
        quantiles._Search("y", 7, 400),
        quantiles._Search("x", 121, 200, 100, 10.0, 30.0),
    ]
    values = df.sparkSession.range(400).selectExpr("id * 0.1 AS x", "CASE WHEN id > 0 THEN 400.0D - id END AS y")
    assert quantiles._sorted_values(values, searches) == pytest.approx([10.1 + 2.0, 10.1 + 3.0, 0.5, 8.0, 10.1 + 2.1])


def test_code_of_the_last_sort_stays_small(skewed, monkeypatch, capsys):
    """HotSpot interprets methods of more than 8,000 bytes: the generated code must not grow with columns times intervals."""
    df, pdf = skewed
    kept, finish, inside = type(df).collect, quantiles._finish, []

    def collect(self):
        rows = kept(self)
        if inside:  # the plan that was run
            self.explain("codegen")
        return rows

    def watched(narrow, searches):
        inside.append(True)
        finish(narrow, searches)
        inside.clear()

    monkeypatch.setattr(type(df), "collect", collect)
    monkeypatch.setattr(quantiles, "_finish", watched)
    exprs = {f"{n}{k}": F.when(c(n) % (k + 2) > 1, c(n) * k).otherwise(c(n)) for n in pdf for k in range(2)}
    exact_quantiles(df, exprs, [0.25, 0.5, 0.75], finish_rows=500)
    sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    assert sizes and max(sizes) < 8000
