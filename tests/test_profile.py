import numpy as np
import pandas as pd
import pytest

from tidemill import profile
from tidemill.columns import c
from tidemill.operators import counting, duplicates, heads, moments, profiling
from tidemill.roles import ROW, normalise_missing


@pytest.fixture(scope="module")
def mixed(spark):
    rng = np.random.default_rng(3)
    n = 500
    pdf = pd.DataFrame(
        {
            "a": rng.normal(1e6, 1, n),
            "b": rng.integers(0, 9, n).astype(float),
            "s": rng.choice(["x", "y", "nan"], n),
            "ok": rng.choice([True, False], n),
            "t": pd.Timestamp("2024-01-01") + pd.to_timedelta(rng.integers(0, 5, n), unit="D"),
            "k": 0.1,
        }
    )
    pdf["c"] = pdf["a"] * 3 + rng.normal(0, 1, n)
    pdf.loc[::7, "b"] = np.nan
    pdf.loc[::5, "c"] = np.nan
    pdf.loc[3, "c"] = np.inf
    pdf.loc[::11, "s"] = None
    pdf.loc[::13, "t"] = pd.NaT

    def plain(v):
        return None if pd.isna(v) else v.to_pydatetime() if isinstance(v, pd.Timestamp) else v

    rows = [(i, *map(plain, r)) for i, r in enumerate(pdf.astype(object).itertuples(index=False))]
    schema = f"{ROW} bigint, a double, b double, s string, ok boolean, t timestamp_ntz, k double, c double"
    return spark.createDataFrame(rows, schema).cache(), pdf


def table(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_describe(mixed):
    df, pdf = mixed
    found = table(profile(df).describe, "column")
    want = pdf.describe(include=[np.number]).replace([np.inf, -np.inf], np.nan).round(3)
    names = {"count": "count", "mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}
    assert set(found) == set(want.columns)
    for column, row in found.items():
        for ours, theirs in names.items():
            value = want.loc[theirs, column]
            assert row[ours] is None if pd.isna(value) else row[ours] == pytest.approx(value, abs=2e-3)


def test_describe_one_row(spark):
    row = profiling.describe(spark.createDataFrame([(1,)], "x int")).first()
    assert row["std"] is None and (row["min"], row["p50"], row["max"], row["mean"]) == (1, 1, 1, 1)


def test_describe_nothing(spark):
    assert profiling.describe(spark.createDataFrame([("a",)], "x string")).count() == 0
    empty = profiling.describe(spark.createDataFrame([(None,)], "x double")).first()
    assert empty["count"] == 0 and empty["mean"] is None


def test_correlation(mixed):
    df, pdf = mixed
    found = {(r["left"], r["right"]): r["correlation"] for r in profile(df).correlation.collect()}
    want = pdf.corr(numeric_only=True).drop(index="ok", columns="ok", errors="ignore").fillna(0)
    names = ["a", "b", "k", "c"]
    assert set(found) == {(x, y) for x in names for y in names}
    for (x, y), r in found.items():
        assert r == pytest.approx(want.loc[x, y], abs=6e-4)
    assert found["k", "k"] == 0


def test_correlation_of_constants_and_gaps(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (1, 3)], "a int, b int")
    assert moments.correlations(df, ["a", "b"]) == [("a", "a", 0.0), ("a", "b", 0.0), ("b", "b", 1.0)]
    df = spark.createDataFrame([(1, 1), (2, 3), (None, 9), (5, None), (7, 2)], "x int, y int")
    assert round(moments.correlations(df, ["x", "y"])[1][2], 3) == 0.156


def test_correlation_constant_where_the_other_has_values(spark):
    """x varies, but not on the rows it shares with y."""
    df = spark.createDataFrame([(0.1, 1.0), (0.1, 2.0), (0.1, 5.0), (1e9, None), (-1e9, None)], "x double, y double")
    assert dict(((a, b), r) for a, b, r in moments.correlations(df, ["x", "y"]))["x", "y"] == 0.0
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "x double, y double")
    assert moments.correlations(df, ["x", "y"])[1] == ("x", "y", 0.0)


def test_many_columns_are_batched(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(0, 1, (80, 26))
    pdf = pd.DataFrame(data, columns=[f"c{i}" for i in range(26)])
    pdf = pdf.mask(rng.random(pdf.shape) < 0.1)
    df = spark.createDataFrame([tuple(None if pd.isna(v) else float(v) for v in r) for r in pdf.values], ", ".join(f"{n} double" for n in pdf))
    want = pdf.corr()
    found = moments.correlations(df, list(pdf))
    assert len(found) == 26 * 27 // 2
    for x, y, r in found:
        assert r == pytest.approx(want.loc[x, y], abs=1e-9)


def test_strong_correlations(spark):
    pairs = spark.createDataFrame(
        [("b", "a", -0.9), ("a", "a", 1.0), ("a", "c", 0.6), ("c", "d", 0.599), ("d", "e", 0.9)],
        "left string, right string, correlation double",
    )
    found = [tuple(r) for r in profiling.strong_correlations(pairs).collect()]
    assert found == [("a vs b", -0.9), ("d vs e", 0.9), ("a vs c", 0.6)]


def test_counts(mixed):
    df, pdf = mixed
    p = profile(df)
    unique = {r["column"]: r["unique_count"] for r in p.unique_counts.collect()}
    assert unique == pdf.nunique(dropna=False).to_dict()
    missing = table(p.missing, "column")
    assert {k: v["missing_values"] for k, v in missing.items()} == pdf.isna().sum().to_dict()
    assert {k: v["missing_percent"] for k, v in missing.items()} == (pdf.isna().mean() * 100).round(2).to_dict()
    assert p.shape.first().asDict() == {"rows": 500, "columns": 7}
    approx = {r["column"]: r["unique_count"] for r in counting.unique_counts(df, approximate=True).collect()}
    assert approx["ok"] == 2 and approx["s"] == unique["s"]


def test_duplicates(spark):
    df = spark.createDataFrame([(0, "a", 1), (1, "a", 1), (2, None, 1), (3, None, 1), (4, "a", 2)], f"{ROW} bigint, s string, n int")
    assert profile(df).duplicates.first()[0] == 2
    keyed = df.withColumn("id", c(ROW))
    assert profile(keyed).duplicates.first()[0] == 0
    assert duplicates.duplicate_rows(keyed).first()[0] == 0


def test_categorical_summary(mixed):
    df, pdf = mixed
    found = {}
    for r in profile(df).categorical_summary.collect():
        found.setdefault(r["column"], {})[r["value"]] = r["count"]
    for name in ("s", "ok", "t"):
        labels = pdf[name].astype(object).where(pdf[name].notna(), "NaT" if name == "t" else "nan")
        if name == "t":
            labels = labels.map(lambda v: v if v == "NaT" else str(v)[:10])
        assert found[name] == labels.astype(str).value_counts().head(10).to_dict()


def test_top_values_break_ties_by_label(spark):
    df = spark.createDataFrame([(v,) for v in "b a d c e".split()], "x string")
    assert [(r["value"], r["rank"]) for r in counting.top_values(df, ["x"], 3).orderBy("rank").collect()] == [
        ("a", 1),
        ("b", 2),
        ("c", 3),
    ]


def test_payload_and_preview(mixed):
    df, _ = mixed
    sections = table(profile(df).payload(), "section")
    assert len(sections) == 11
    assert '"rows":500' in sections["shape"]["payload"]
    row = heads.preview_payload(df).first()
    assert len(row["rows"]) == 15 and row["row_count"] == 500 and row["column_count"] == 7
    assert row["rows"][0].startswith('{"a":') and '"b":null' in row["rows"][0]


def test_preview_needs_an_order(spark):
    with pytest.raises(ValueError):
        heads.preview(spark.range(3))


def test_facts_are_tidy(mixed):
    facts = profile(mixed[0]).facts()
    assert facts.columns == ["section", "item", "metric", "value"]
    assert facts.filter("section = 'describe' and item = 'a' and metric = 'count'").first()["value"] == 500


@pytest.mark.parametrize("block", [1_000, 14])
def test_forty_columns_with_gaps_correlate_like_pandas(spark, monkeypatch, block):
    """Every column has its own gaps, a constant, a huge offset or none; blocks give the same."""
    monkeypatch.setattr(moments, "_BLOCK", block)
    rng = np.random.default_rng(4)
    table = rng.normal(size=(500, 40)) @ rng.normal(size=(40, 40))
    table[:, 1] = table[:, 0] * 2 + 1e6
    table[:, 2] = 7.0
    table[:, 3] = np.where(rng.random(500) < 0.01, 1.0, 0.0)
    for j in range(4, 36):
        table[rng.random(500) < 0.02 * (j % 9), j] = np.nan
    table[:250, 36], table[250:, 37] = np.nan, np.nan
    names = [f"c {j}.x" for j in range(40)]
    df = spark.createDataFrame(pd.DataFrame(table, columns=names))
    expected = pd.DataFrame(table, columns=names).corr().fillna(0.0)
    found = moments.correlations(normalise_missing(df), names)
    assert len(found) == 40 * 41 // 2
    for x, y, r in found:
        assert r == pytest.approx(expected.loc[x, y], abs=1e-9), (x, y)


def test_gaps_that_all_columns_share(spark):
    rows = [(1.0, 2.0), (2.0, 1.0), (4.0, 5.0), (None, None), (None, None)]
    found = {(x, y): r for x, y, r in moments.correlations(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])}
    assert found["a", "b"] == pytest.approx(pd.DataFrame(rows).corr().loc[0, 1]) and found["a", "a"] == 1.0
