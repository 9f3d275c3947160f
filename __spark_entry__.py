"""Query registry: every operator on the given tables, with its SQL counterpart.

The tables hold no gaps, blanks or copies, so many queries first spoil their
input with plain SQL expressions.  The same expression texts build the input on
both sides; the operator under test is the library's on one side and hand-written
SQL on the other.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.jsonsafe import json_safe_frame
from tidemill.learning import frames, metrics, preprocessing
from tidemill.learning.training import TrainSpec, train
from tidemill.operators import charts, cleaning, counting, duplicates, heads, profiling, quantiles
from tidemill.plans.cleaning import CleanSpec, clean
from tidemill.plans import commits
from tidemill.plans.dashboard import snapshot
from tidemill.plans.profiling import profile
from tidemill.roles import ROW, normalise_missing
from tidemill.session import staging_root
from tidemill.sources import datasets, runs

try:  # the only place that knows whether the llm folder is there
    import corpus_pipeline
    from tidemill.llm import queries as llm_queries
except ModuleNotFoundError as missing:
    if missing.name not in ("corpus_pipeline", "tidemill.llm"):
        raise
    corpus_pipeline = llm_queries = None

Query = Callable[[SparkSession, str], DataFrame]

# --- inputs, as SQL texts that both engines run ------------------------------

EVENTS = {
    "_row": "event_id",
    "user_id": "user_id",
    "event_type": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END",
    "value": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END",
}
# Few columns, so that equal rows arise by themselves.
VISITS = {"_row": "event_id", "user_id": "user_id", "event_type": EVENTS["event_type"]}
# One row in ten is a copy of the row before.
COPIED = {
    "_row": "event_id",
    "origin": "CASE WHEN event_id % 10 = 9 THEN event_id - 1 ELSE event_id END",
    "half": "CASE WHEN event_id % 20 < 8 THEN NULL WHEN event_id % 10 = 9 THEN (event_id - 1) / CAST(2 AS DOUBLE) ELSE event_id / CAST(2 AS DOUBLE) END",
}
CUSTOMERS = {
    "_row": "c_custkey",
    "c_name": "CASE WHEN c_custkey % 9 = 0 THEN '   ' ELSE concat('  ', c_name, chr(9)) END",
    "c_nationkey": "c_nationkey",
    "c_acctbal": "CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END",
    "c_mktsegment": "CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_mktsegment END",
}
FLAGGED = {**EVENTS, "is_view": "CASE WHEN event_id % 4 = 0 THEN NULL ELSE event_type = 'view' END"}
SPACED = {
    "conv_id": "conv_id",
    "turn": "turn",
    "role": "CASE WHEN turn % 3 = 0 THEN concat(' ', chr(9)) ELSE concat(chr(160), role, '  ') END",
    "text": "concat(chr(160), chr(9), ' ', text, chr(10), ' ')",
}
TYPED = {
    "_row": "event_id",
    "digits": "CASE WHEN event_id % 13 = 0 THEN 'n/a' WHEN event_id % 17 = 0 THEN '1_000' WHEN event_id % 19 = 0 THEN '1d' "
    "ELSE concat(' ', substr(props, 7, length(props) - 7), ' ') END",
    "value": "value",
    "is_view": "event_type = 'view'",
}
ISO_DAY = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
DATED = {
    "_row": "o_orderkey",
    "iso": f"CASE WHEN o_orderkey % 8 = 3 THEN 'soon' WHEN o_orderkey % 8 = 5 THEN '2024-02-30' ELSE {ISO_DAY} END",
    "us": f"concat(substr({ISO_DAY}, 6, 2), '/', substr({ISO_DAY}, 9, 2), '/', substr({ISO_DAY}, 1, 4))",
}
_MONTH = "CAST(substr({day}, 6, 2) AS INT)".format(day=ISO_DAY)
DATE_FORMS = {
    "_row": "o_orderkey",
    "named": f"CASE WHEN o_orderkey % 8 = 3 THEN 'soon' ELSE concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', 3 * {_MONTH} - 2, 3), ' ', "
    f"CAST(CAST(substr({ISO_DAY}, 9, 2) AS INT) AS STRING), ', ', substr({ISO_DAY}, 1, 4)) END",
    "half": f"concat(substr({ISO_DAY}, 6, 2), '/', substr({ISO_DAY}, 9, 2), '/', substr({ISO_DAY}, 1, 4), "
    "CASE WHEN o_orderkey % 3 = 0 THEN ' 12:07 AM' WHEN o_orderkey % 3 = 1 THEN ' 12:30 PM' ELSE ' 03:04 PM' END)",
    "zoned": f"concat({ISO_DAY}, 'T0', CAST(o_orderkey % 10 AS STRING), ':30:59+02:00')",
    "month": f"substr({ISO_DAY}, 1, 7)",
}
ORDERS = {
    "_row": "o_orderkey",
    "o_custkey": "o_custkey",
    "o_orderstatus": "o_orderstatus",
    "o_totalprice": "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END",
    "o_orderdate": "o_orderdate",
    "o_orderpriority": "CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE o_orderpriority END",
}
LINES = {
    "l_quantity": "l_quantity",
    "l_extendedprice": "l_extendedprice",
    "l_discount": "CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END",
    "l_tax": "l_tax",
    "gross": "l_extendedprice * (1 + l_tax)",
    "net": "l_extendedprice * 2 - l_quantity",
    "k_const": "1",
}
PADDED = {**EVENTS, "k_const": "1", "k_empty": "CAST(NULL AS DOUBLE)", "k_gap": "CASE WHEN event_id % 2 = 0 THEN 5 END"}
RUN_KIND = (
    "CASE event_type WHEN 'click' THEN 'cleaning' WHEN 'view' THEN 'eda' "
    "WHEN 'purchase' THEN 'training' ELSE 'visualization' END"
)
RUNS = {
    "id": "event_id",
    "project_id": "user_id",
    "dataset_id": "event_id % 30",
    "run_type": RUN_KIND,
    "title": f"concat('Run of ', {RUN_KIND})",
    "payload_json": "props",
    "score": "CASE WHEN event_type = 'purchase' THEN value END",
    "created_at": "ts",
}
CATALOG = {
    "id": "CAST(c_custkey AS BIGINT)",
    "project_id": "CAST(c_nationkey AS BIGINT)",
    "name": "c_name",
    "row_count": "CAST(c_custkey * 10 AS BIGINT)",
    "column_count": "CAST(5 AS BIGINT)",
    "target_column": "CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END",
    "created_at": "CAST(concat('2024-01-', CASE WHEN c_custkey % 28 < 9 THEN '0' ELSE '' END, "
    "CAST(c_custkey % 28 + 1 AS STRING), ' 10:00:00') AS TIMESTAMP{ntz})",
}
VALUED = {
    "o_orderkey": "o_orderkey",
    "price": "CASE WHEN o_orderkey % 10 = 0 THEN CAST('Infinity' AS DOUBLE) "
    "WHEN o_orderkey % 10 = 1 THEN CAST('NaN' AS DOUBLE) ELSE o_totalprice END",
    "placed_at": "o_orderdate",
}
SIDECAR_TEXT = {
    "_row": "o_orderkey",
    "price": "CASE WHEN o_orderkey % 6 = 0 THEN 'unknown' ELSE CAST(o_orderkey AS STRING) END",
    "day": ISO_DAY,
    "code": "o_custkey",
}
SIDECAR = {"price": "float64", "day": "datetime64[ns]", "code": "string", "absent": "int64"}
SAVED = {"o_orderkey": "o_orderkey", "o_orderstatus": "o_orderstatus", "o_totalprice": "o_totalprice", "o_orderdate": "o_orderdate"}
CSV_RAW = {
    "c_custkey": "c_custkey",
    "name, full": 'concat(\'"\', c_name, \'", Ltd\')',
    "c_nationkey": "c_nationkey",
    "c_acctbal": "CASE WHEN c_custkey % 5 = 0 THEN 'NA' ELSE CAST(c_nationkey AS STRING) END",
    "flag": "CASE WHEN c_custkey % 2 = 0 THEN 'True' ELSE 'FALSE' END",
    "mixed": "CASE WHEN c_custkey % 3 = 0 THEN 'n/a' WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '' END",
}


def spoil(exprs: dict[str, str], table: str) -> str:
    """The DuckDB text of an input."""
    body = ", ".join(f'{e.replace("{ntz}", "")} AS "{n}"' for n, e in exprs.items())
    return f"SELECT {body} FROM {table}"


def table(spark: SparkSession, sf_dir: str, name: str, exprs: dict[str, str] | None = None) -> DataFrame:
    """The same input in Spark."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if exprs:
        df = df.selectExpr(*[f"{e.replace('{ntz}', '_NTZ')} AS `{n}`" for n, e in exprs.items()])
    return normalise_missing(df)


def on(name: str, exprs: dict[str, str] | None, apply: Callable[[DataFrame], DataFrame]) -> Query:
    """A query that applies one operator to one input."""
    return lambda spark, sf_dir: apply(table(spark, sf_dir, name, exprs))


def entry(spark: SparkSession) -> DataFrame:
    """Describe the numeric columns of the line items."""
    return profiling.describe(table(spark, "/root/testdata/sf0.001", "lineitem"))


# --- queries that need more than one line ----------------------------------


def _scratch(spark: SparkSession, label: str) -> str:
    return f"{staging_root(spark)}/tidemill/{label}-{uuid.uuid4().hex}"


def _load_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _scratch(spark, "raw") + ".csv"
    table(spark, sf_dir, "customer", CSV_RAW).write.options(quote='"', escape='"').csv(path, header=True)
    df = datasets.load_dataset(spark, path)
    return df.select(*[c(n) for n in CSV_RAW])


def _save_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders", SAVED)
    path = datasets.save_dataset(df, _scratch(spark, "saved"), preserve_types=False)
    return datasets.load_dataset(spark, path).select(*[c(n) for n in SAVED])


def _save_roundtrip_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in descending key order, written as several CSV files and read again; their place among each customer's."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", (-c("o_orderkey")).alias(ROW))
    path = datasets.save_dataset(df, _scratch(spark, "ordered"), preserve_types=False)
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(ROW)).cast("long").alias("place")
    return datasets.load_dataset(spark, path).select("o_orderkey", "o_custkey", place)


def _commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers cleaned and committed, twice under one id; the rows of the published version with what catalog and run log say of it."""
    root = _scratch(spark, "commits")
    at = datetime(2024, 1, 1)
    entry_of = commits.Entry(dataset_id=7, project_id=3, name="customers", created_at=at, run_id=11)
    for _ in range(2):
        commits.clean_and_commit(table(spark, sf_dir, "customer", CUSTOMERS), COMPOSED, root, "first", entry_of)
    listed = commits.catalog(spark, root).select(c("id").alias("dataset_id"), "name", "row_count", "column_count")
    logged = commits.run_log(spark, root)
    rows_after = F.get_json_object("payload_json", "$.rows_after").cast("long").alias("rows_after")
    logged = logged.select("dataset_id", c("id").alias("run_id"), "run_type", "title", rows_after)
    stored = commits.load(spark, root, 7).withColumn("dataset_id", F.lit(7).cast("long"))
    return stored.join(F.broadcast(listed), "dataset_id").join(F.broadcast(logged), "dataset_id")


_REGISTERED = {"customer": "c_mktsegment", "orders": None, "part": "p_retailprice", "lineitem": None, "events": "value"}


def _register(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = [(f"{n}.parquet", spark.read.parquet(f"{sf_dir}/{n}.parquet")) for n in _REGISTERED]
    return datasets.register(tables, {f"{n}.parquet": t for n, t in _REGISTERED.items() if t})


def _preview(df: DataFrame) -> DataFrame:
    rows = df.agg(F.count(F.lit(1))).scalar()
    return heads.preview(df, order_by="event_id").select(
        "*", rows.alias("row_count"), F.lit(len(df.columns)).alias("column_count")
    )


def _headers(df: DataFrame) -> DataFrame:
    return cleaning.normalise_headers(df)[0]


def _convert_all_dates(df: DataFrame) -> DataFrame:
    for name in DATE_FORMS:
        df = df if name == ROW else cleaning.convert_column(df, name, "date")
    return df


def _outlier_bounds(df: DataFrame) -> DataFrame:
    lower, upper = quantiles.outlier_bounds(df, c("value"))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c("value") < lower).alias("n_below"),
        F.count_if(c("value") > upper).alias("n_above"),
        F.round(F.lit(lower), 6).alias("lower_bound"),
        F.round(F.lit(upper), 6).alias("upper_bound"),
    )


def _remove_outliers(df: DataFrame) -> DataFrame:
    return cleaning.remove_outliers(df, "value", quantiles.outlier_bounds(df, c("value")))


def _cap_outliers(df: DataFrame) -> DataFrame:
    return cleaning.round_numeric(cleaning.cap_outliers(df, "value", quantiles.outlier_bounds(df, c("value"))), 4)


COMPOSED = CleanSpec(
    trim_whitespace=True,
    text_case="upper",
    drop_columns=("c_nationkey",),
    fill_missing="mean",
    fill_categorical="unknown",
    cap_outliers=True,
    outlier_column="c_acctbal",
    round_numeric=True,
)
SUMMARISED = CleanSpec(
    drop_empty_columns=True,
    drop_constant_columns=True,
    drop_columns=("k_gap", "value", "nothing"),
    fill_missing="zero",
    fill_categorical="none",
    remove_outliers=True,
    outlier_column="user_id",
    round_numeric=True,
    round_digits=3,
)
_SUMMARY = (
    "rows_before", "rows_after", "columns_before", "columns_after", "dropped_columns", "empty_columns_dropped",
    "constant_columns_dropped", "duplicates_removed", "missing_rows_dropped", "missing_after", "fill_missing",
    "outliers_removed", "outliers_capped", "round_digits",
)


def _document(df: DataFrame) -> DataFrame:
    """The composed document: a JSON text for each section."""
    return profile(df, order_by=ROW).payload()


def _pie(df: DataFrame) -> DataFrame:
    return charts.pie_slices(df, "event_type").withColumn("share", F.round("share", 6))


def _rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


def _chart(kind: str, x: str | None = None, y: str | None = None) -> Callable[[DataFrame], DataFrame]:
    return lambda df: _rounded(charts.chart_series(df, [kind], x, y).drop("x_value", "chart_id"), "y")


def _run_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "events", RUNS), table(spark, sf_dir, "customer", CATALOG)


def _run_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    log, catalog = _run_tables(spark, sf_dir)
    path = _scratch(spark, "runs")
    runs.append_runs(log, path)
    return runs.history(spark.read.parquet(path), catalog)


def _ml_split(df: DataFrame) -> DataFrame:
    return frames.split(df, 0.8, "quality", "doc_id")


def _impute_scale(df: DataFrame) -> DataFrame:
    names = ["c_nationkey", "c_acctbal"]
    return _rounded(preprocessing.impute_scale(df, preprocessing.numeric_stats(df, names)), *names)


def _onehot(df: DataFrame) -> DataFrame:
    fitted = preprocessing.fit_preprocessor(df, ["c_mktsegment"])
    ready = PipelineModel(fitted.stages).transform(df)
    slots = vector_to_array(preprocessing.FEATURES)
    pairs = [F.struct(F.lit(n).alias("feature"), slots[i].alias("value")) for i, n in enumerate(fitted.feature_names)]
    return ready.select("_row", F.inline(F.array(*pairs)))


def _reg_metrics(df: DataFrame) -> DataFrame:
    return metrics.regression_metrics(df.withColumn("guess", c("p_partkey") * 0.05 + 900.0), "p_retailprice", "guess")


def _ml_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TrainSpec("p_retailprice", ("p_partkey",), "linear", key="p_partkey")
    result = train(table(spark, sf_dir, "part"), spec)
    return result.metrics.select(
        F.lit(result.summary["train_rows"]).cast("bigint").alias("train_rows"),
        F.lit(result.summary["test_rows"]).cast("bigint").alias("test_rows"),
        *[F.round(n, 3).alias(n) for n in ("r2_score", "rmse", "mae")],
    )


def _linear(spark: SparkSession, sf_dir: str):
    return train(table(spark, sf_dir, "part"), TrainSpec("p_retailprice", ("p_partkey",), "linear", key="p_partkey"))


def _linear_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_linear(spark, sf_dir).importance, "importance", digits=3)


def _linear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = {n: F.round(F.col(n).cast("double"), 3) for n in ("actual", "predicted")}
    return _linear(spark, sf_dir).predictions.withColumns(numbers)


def _linear_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training report as one row, its scores to three digits and lists as JSON."""
    report = _linear(spark, sf_dir).summary_frame().select(*_REPORT)
    return _rounded(report, "score", "train_score", "test_score", digits=3)


def _model_reload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts' prices as predicted by a model that was stored and loaded again."""
    path = _scratch(spark, "model")
    _linear(spark, sf_dir).save(path)
    scored = PipelineModel.load(path).transform(table(spark, sf_dir, "part"))
    return scored.select("p_partkey", F.round("prediction", 3).alias("predicted"))


_REPORT = (
    "target_column", "selected_feature_columns", "requested_model_type", "selected_model_key", "train_split_percentage",
    "train_test_ratio", "train_rows", "test_rows", "total_rows", "feature_count", "numeric_feature_count",
    "categorical_feature_count", "problem_type", "score", "train_score", "test_score",
)


def _onehot_wide(df: DataFrame) -> DataFrame:
    """Every customer's name is a category: encoded by a join with the positions of the names."""
    fitted = preprocessing.fit_preprocessor(df, ["c_name"], local_values=5)
    ready = PipelineModel(fitted.stages).transform(df).select("_row", F.col("__idx_0").cast("bigint").alias("slot"))
    return ready.join(fitted.names, "slot").select("_row", "slot", F.col("name").alias("feature"))


def _trained(spark: SparkSession, sf_dir: str, model_type: str = "auto"):
    """Each learner at its full size; ``auto`` fits all of them."""
    spec = TrainSpec("p_retailprice", ("p_partkey", "p_size", "p_type"), model_type, key="p_partkey")
    return train(table(spark, sf_dir, "part"), spec)


def _train_auto(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _trained(spark, sf_dir)
    result.save(_scratch(spark, "model"))
    return result.leaderboard.crossJoin(F.broadcast(result.summary_frame().select("selected_model_key", "train_rows", "test_rows")))


def _train_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spec = TrainSpec("c_mktsegment", ("c_nationkey", "c_acctbal"), "random_forest", key="c_custkey")
    result = train(table(spark, sf_dir, "customer"), spec)
    return result.confusion


def queries() -> dict[str, Query]:
    fills = {how: CleanSpec(fill_missing=how, fill_categorical="none", remove_duplicates=False) for how in ("median", "mean", "zero", "mode")}
    q: dict[str, Query] = {
        # sources
        "load_csv": _load_csv,
        "apply_schema": on("orders", SIDECAR_TEXT, lambda df: datasets.apply_schema(df, SIDECAR)),
        "save_roundtrip": _save_roundtrip,
        "save_roundtrip_order": _save_roundtrip_order,
        "dataset_register": _register,
        "dataset_commit": _commit,
        "preview": on("events", None, _preview),
        "eda_preview": on("orders", None, lambda df: heads.preview(df, heads.PROFILE_PREVIEW, "o_orderkey")),
        "json_safe": lambda s, d: json_safe_frame(
            s.read.parquet(f"{d}/orders.parquet").selectExpr(*[f"{e} AS {n}" for n, e in VALUED.items()])
        ),
        # cleaning steps
        "clean_trim": on("conversations", SPACED, cleaning.trim_text),
        "clean_blank_to_null": on("conversations", SPACED, cleaning.blanks_to_null),
        "clean_headers": on("nation", {" N Key": "n_nationkey", "n_key": "n_regionkey", "!!": "n_name", "N-Name (x)": "n_name"}, _headers),
        "clean_case_lower": on("documents", None, lambda df: cleaning.change_case(df, "lower")),
        "clean_case_upper": on("documents", None, lambda df: cleaning.change_case(df, "upper")),
        "clean_case_title": on("documents", None, lambda df: cleaning.change_case(df, "title")),
        "clean_convert_number": on("events", TYPED, lambda df: cleaning.convert_column(df, "digits", "number")),
        "clean_convert_string": on(
            "events",
            TYPED,
            lambda df: cleaning.convert_column(cleaning.convert_column(df, "value", "string"), "is_view", "string"),
        ),
        "clean_convert_date": on("orders", DATED, lambda df: cleaning.convert_column(df, "iso", "date")),
        "clean_convert_date_us": on("orders", DATED, lambda df: cleaning.convert_column(df, "us", "date")),
        "clean_convert_date_forms": on("orders", DATE_FORMS, _convert_all_dates),
        "clean_drop_empty": on("events", PADDED, lambda df: cleaning.drop_columns(df, cleaning.empty_columns(df))),
        "clean_drop_constant": on("events", PADDED, lambda df: cleaning.drop_columns(df, cleaning.constant_columns(df))),
        "clean_drop_columns": on("events", PADDED, lambda df: cleaning.drop_columns(df, ["k_gap", "value", "nothing"])),
        "clean_drop_missing_rows": on("events", EVENTS, cleaning.drop_missing_rows),
        "clean_dedup": on("events", VISITS, lambda df: duplicates.drop_duplicates(df, "copies")),
        "clean_dedup_hashes": on("events", COPIED, lambda df: duplicates.drop_duplicates(df, "copies", df.count(), small_rows=0)),
        "clean_dedup_filter": on("events", COPIED, lambda df: duplicates.drop_duplicates(df, "copies", df.count(), small_rows=0, max_repeated=0)),
        "clean_remove_outliers": on("events", EVENTS, _remove_outliers),
        "clean_cap_outliers": on("events", EVENTS, _cap_outliers),
        "clean_round": on("lineitem", LINES, lambda df: cleaning.round_numeric(df, 1)),
        "clean_summary": on(
            "events", {k: v for k, v in PADDED.items() if k != "_row"}, lambda df: clean(df, SUMMARISED).summary_frame().select(*_SUMMARY)
        ),
        "clean_composed": on("customer", CUSTOMERS, lambda df: clean(df, COMPOSED).frame),
        "outlier_bounds": on("events", EVENTS, _outlier_bounds),
        # profile
        "eda_shape": on("events", EVENTS, profiling.shape),
        "eda_columns": on("orders", ORDERS, profiling.column_roles),
        "eda_document": on("lineitem", {"_row": "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber", **LINES}, _document),
        "eda_missing": on("customer", CUSTOMERS, lambda df: profiling.missing(cleaning.blanks_to_null(df))),
        "eda_unique": on("orders", ORDERS, counting.unique_counts),
        "eda_duplicates": on("events", VISITS, duplicates.duplicate_rows),
        "eda_size": on("orders", ORDERS, profiling.logical_size),
        "eda_describe": on("lineitem", LINES, profiling.describe),
        "eda_correlation": on("lineitem", LINES, lambda df: profiling.correlation(profiling.correlation_pairs(df))),
        "eda_strong_correlation": on("lineitem", LINES, lambda df: profiling.strong_correlations(profiling.correlation_pairs(df))),
        "eda_top_values": on("orders", ORDERS, profiling.categorical_summary),
        "eda_profile": on("events", EVENTS, lambda df: profile(df).facts()),
        # charts
        "chart_mean_by_x": on("events", EVENTS, lambda df: _rounded(charts.mean_by_x(df, "user_id", "value"), "y")),
        "chart_count_by_x": on("events", EVENTS, lambda df: charts.count_by_x(df, "user_id")),
        "chart_pie": on("events", EVENTS, _pie),
        "chart_line": on("events", EVENTS, _chart("line")),
        "chart_bar": on("orders", ORDERS, _chart("bar", "o_orderdate", "o_orderstatus")),
        "chart_scatter": on("events", EVENTS, lambda df: charts.scatter_points(df, "user_id", "value")),
        "chart_histogram": on("events", EVENTS, _chart("histogram", y="value")),
        "chart_box": on("orders", ORDERS, _chart("box", y="o_totalprice")),
        # models
        "ml_frame": on("customer", CUSTOMERS, lambda df: frames.model_frame(df, "c_mktsegment", ["c_acctbal", "c_nationkey", "absent"])),
        "ml_split": on("labels", None, _ml_split),
        "ml_problem_type": lambda s, d: frames.problem_type(table(s, d, "labels"), "toxic").unionByName(
            frames.problem_type(table(s, d, "part"), "p_retailprice")
        ),
        "ml_impute_scale": on("customer", CUSTOMERS, _impute_scale),
        "ml_onehot": on("customer", CUSTOMERS, _onehot),
        "ml_onehot_wide": on("customer", CUSTOMERS, _onehot_wide),
        "ml_class_metrics": on("labels", None, lambda df: metrics.classification_metrics(df, "quality", "toxic")),
        "ml_confusion": on("labels", None, lambda df: metrics.confusion_matrix(df, "quality", "toxic", [0, 1])),
        "ml_reg_metrics": on("part", None, _reg_metrics),
        "ml_train_linear": _ml_linear,
        "ml_linear_importance": _linear_importance,
        "ml_linear_predictions": _linear_predictions,
        "ml_linear_report": _linear_report,
        "ml_model_reload": _model_reload,
        "ml_train_auto": _train_auto,
        "ml_train_classes": _train_classes,
        "ml_importance": lambda s, d: _trained(s, d, "random_forest").importance,
        "ml_predictions": lambda s, d: _trained(s, d, "xgboost").predictions,
        # run log
        "run_history": _run_history,
        "run_latest": lambda s, d: runs.latest_runs(_run_tables(s, d)[0]),
        "dataset_list": lambda s, d: runs.list_datasets(_run_tables(s, d)[1]),
        "dashboard_snapshot": lambda s, d: snapshot(*_run_tables(s, d)),
    }
    for how, spec in fills.items():
        q[f"clean_fill_{how}"] = on("events", EVENTS, lambda df, spec=spec: cleaning.round_numeric(clean(df, spec).frame, 6))
    for how in ("mode", "unknown", "empty"):
        q[f"clean_fill_cat_{how}"] = on("events", FLAGGED, lambda df, how=how: cleaning.fill_categorical(df, how))
    if llm_queries:
        q |= llm_queries.queries()
        q["pipeline"] = corpus_pipeline.run
    return q


# --- the same in SQL ---------------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_TRIM = rf"^{_WS}+|{_WS}+$"
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def rnd(x: str, digits: int) -> str:
    return f"round_even(CAST({x} AS DOUBLE) * 1e{digits}, 0) / 1e{digits}"


def _with(exprs: dict[str, str], name: str, body: str) -> str:
    """A query on input ``d``; a body starting with a comma adds more named steps."""
    return f"WITH d AS ({spoil(exprs, name)}) {body}"


def _mode(col: str, src: str = "d") -> str:
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


def _bounds(col: str, src: str) -> str:
    q1, q3 = f"quantile_cont({col}, 0.25)", f"quantile_cont({col}, 0.75)"
    return f"SELECT {q1} - 1.5 * ({q3} - {q1}) AS lo, {q3} + 1.5 * ({q3} - {q1}) AS hi FROM {src}"


def _describe(cols: list[str], src: str) -> str:
    parts = []
    for n in cols:
        x = f"CAST({n} AS DOUBLE)"
        parts.append(
            f"SELECT '{n}' AS \"column\", count({n}) AS \"count\", {rnd(f'avg({x})', 3)} AS mean, "
            f"{rnd(f'stddev_samp({x})', 3)} AS std, {rnd(f'min({x})', 3)} AS \"min\", "
            f"{rnd(f'quantile_cont({x}, 0.25)', 3)} AS p25, {rnd(f'quantile_cont({x}, 0.5)', 3)} AS p50, "
            f"{rnd(f'quantile_cont({x}, 0.75)', 3)} AS p75, {rnd(f'max({x})', 3)} AS \"max\" FROM {src}"
        )
    return " UNION ALL ".join(parts)


def _corr(x: str, y: str) -> str:
    r = f"corr(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))"
    return f"CASE WHEN {r} IS NULL OR isnan({r}) THEN 0 ELSE {rnd(r, 3)} END"


def _matrix(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{x}' AS \"left\", '{y}' AS \"right\", {_corr(x, y)} AS correlation FROM {src}" for x in cols for y in cols
    )


def _unique(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", CAST(count(DISTINCT {n}) + max(CASE WHEN {n} IS NULL THEN 1 ELSE 0 END) AS BIGINT) "
        f"AS unique_count FROM {src}"
        for n in cols
    )


def _missing(cols: list[str], src: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", count(*) - count({n}) AS missing_values, "
        f"{rnd(f'100.0 * (count(*) - count({n})) / count(*)', 2)} AS missing_percent FROM {src}"
        for n in cols
    )


def _top(labels: dict[str, str], src: str, k: int) -> str:
    counts = " UNION ALL ".join(
        f"SELECT '{n}' AS \"column\", {e} AS value, count(*) AS \"count\" FROM {src} GROUP BY {e}" for n, e in labels.items()
    )
    return (
        f'SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY "column" ORDER BY "count" DESC, value) AS INTEGER) '
        f"AS rank FROM ({counts})) WHERE rank <= {k}"
    )


def _label(col: str, missing: str = "nan") -> str:
    return f"coalesce(CAST({col} AS VARCHAR), '{missing}')"


def _first_groups(x: str, agg: str, where: str, label: str) -> str:
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY o) AS INTEGER) AS seq, {label} AS x, y FROM "
        f"(SELECT {x} AS k, {agg} AS y, min(_row) AS o FROM d WHERE {where} GROUP BY {x} ORDER BY o LIMIT 30)"
    )


def _titled(kind: str, title: str, aggregation: str | None, body: str) -> str:
    agg = f"'{aggregation}'" if aggregation else "CAST(NULL AS VARCHAR)"
    return f"SELECT '{kind}' AS type, '{title}' AS title, seq, x, round(CAST(y AS DOUBLE), 6) AS y, {agg} AS aggregation FROM ({body})"


def _raw(y: str) -> str:
    return (
        f"SELECT CAST(row_number() OVER (ORDER BY _row) AS INTEGER) AS seq, CAST(row_number() OVER (ORDER BY _row) AS VARCHAR) AS x, "
        f"{y} AS y FROM (SELECT _row, {y} FROM d WHERE {y} IS NOT NULL ORDER BY _row LIMIT 200)"
    )


def _split(src: str, key: str, label: str, share: float) -> str:
    """Largest-remainder sizes per class, then the smallest hashes of each class."""
    return f"""
        h AS (SELECT *, md5(concat_ws('|', '42', CAST({key} AS VARCHAR))) AS hsh, {label} AS lab FROM {src}),
        n AS (SELECT lab, count(*) AS n FROM h GROUP BY lab),
        k AS (SELECT *, sum(n) OVER () AS total, CAST(floor(sum(n) OVER () * {share}::DOUBLE) AS HUGEINT) AS k FROM n),
        b AS (SELECT *, n * k // total AS base, n * k % total AS rest FROM k),
        z AS (SELECT lab, base + CASE WHEN row_number() OVER (ORDER BY rest DESC, CAST(lab AS VARCHAR)) <= k - sum(base) OVER ()
              THEN 1 ELSE 0 END AS n_train FROM b),
        split AS (SELECT h.*, row_number() OVER (PARTITION BY h.lab ORDER BY hsh) <= z.n_train AS is_train
                  FROM h JOIN z ON h.lab = z.lab)"""


_LATEST = (
    f"SELECT project_id, run_type, id, created_at, payload_json FROM (SELECT *, row_number() OVER "
    f"(PARTITION BY project_id, run_type ORDER BY created_at DESC, id DESC) AS rn FROM ({spoil(RUNS, 'events')})) WHERE rn = 1"
)


def _iso(col: str) -> str:
    return (
        f"CASE WHEN date_part('microseconds', {col}) % 1000000 = 0 THEN strftime({col}, '%Y-%m-%dT%H:%M:%S') "
        f"ELSE strftime({col}, '%Y-%m-%dT%H:%M:%S.%f') END"
    )


def _quoted(col: str) -> str:
    return f"CASE WHEN {col} IS NULL THEN 'null' ELSE concat('\"', {col}, '\"') END"


def _eda_profile() -> str:
    cols, nums = ["user_id", "event_type", "value"], ["user_id", "value"]

    def tidy(section: str, item: str, metrics_: dict[str, str], src: str) -> str:
        return " UNION ALL ".join(
            f"SELECT '{section}' AS section, {item} AS item, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM ({src})"
            for m, e in metrics_.items()
        )

    quoted = {m: f'"{m}"' for m in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")}
    size = f"SELECT {rnd('(count(*) * 16 + sum(coalesce(strlen(event_type), 0))) / 1048576.0', 3)} AS v FROM d"
    copies = "SELECT sum(n - 1) AS v FROM (SELECT count(*) AS n FROM d GROUP BY user_id, event_type, value)"
    parts = [
        tidy("shape", "'table'", {"rows": "n", "columns": "3"}, "SELECT count(*) AS n FROM d"),
        tidy("missing", '"column"', {m: m for m in ("missing_values", "missing_percent")}, _missing(cols, "d")),
        tidy("unique", '"column"', {"unique_count": "unique_count"}, _unique(cols, "d")),
        tidy("duplicates", "'table'", {"duplicate_rows": "v"}, copies),
        tidy("size", "'table'", {"memory_usage_mb": "v"}, size),
        tidy("describe", '"column"', quoted, _describe(nums, "d")),
        tidy("correlation", "concat(\"left\", ' vs ', \"right\")", {"pearson": "correlation"}, _matrix(nums, "d")),
        tidy("top_values", "concat(\"column\", '=', value)", {"count": '"count"'}, _top({"event_type": _label("event_type")}, "d", 10)),
    ]
    return _with(EVENTS, "events", " UNION ALL ".join(parts))


def _eda_document() -> str:
    names = list(LINES)

    def section(name: str, src: str, fields: list[str], order: str) -> str:
        row = ", ".join(f"'{f}': \"{f}\"" for f in fields)
        return f"SELECT '{name}' AS section, coalesce('[' || string_agg(CAST(to_json({{{row}}}) AS VARCHAR), ',' ORDER BY {order}) || ']', '[]') AS payload FROM ({src})"

    place = f"list_position([{', '.join(repr(n) for n in names)}], \"column\")"
    kinds = ", ".join(f"({i}, '{n}', 'numeric', '{'int' if n == 'k_const' else 'double'}')" for i, n in enumerate(names))
    pairs = " UNION ALL ".join(
        f"SELECT '{min(x, y)} vs {max(x, y)}' AS pair, {_corr(x, y)} AS correlation FROM d" for i, x in enumerate(names) for y in names[i + 1 :]
    )
    matrix = " UNION ALL ".join(
        f"SELECT {10 * (len(names) * min(i, j) + max(i, j)) + (i > j)} AS place, '{x}' AS \"left\", '{y}' AS \"right\", {_corr(x, y)} AS correlation FROM d"
        for i, x in enumerate(names)
        for j, y in enumerate(names)
    )
    widths = sum(4 if n == "k_const" else 8 for n in names)
    parts = [
        section("shape", f"SELECT count(*) AS rows, CAST({len(names)} AS BIGINT) AS columns FROM d", ["rows", "columns"], "rows"),
        section("columns", f'SELECT * FROM (VALUES {kinds}) t("position", "column", role, dtype)', ["position", "column", "role", "dtype"], '"position"'),
        section("missing", _missing(names, "d"), ["column", "missing_values", "missing_percent"], place),
        section("unique_counts", _unique(names, "d"), ["column", "unique_count"], place),
        section("duplicates", f"SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM d GROUP BY {', '.join(names)})", ["duplicate_rows"], "1"),
        section("size", f"SELECT {rnd(f'count(*) * {widths} / 1048576.0', 3)} AS memory_usage_mb FROM d", ["memory_usage_mb"], "1"),
        section("describe", _describe(names, "d"), ["column", "count", "mean", "std", "min", "p25", "p50", "p75", "max"], place),
        section("correlations", matrix, ["left", "right", "correlation"], "place"),
        section("strong_correlations", f"SELECT * FROM ({pairs}) WHERE abs(correlation) >= 0.6 ORDER BY abs(correlation) DESC, pair LIMIT 10", ["pair", "correlation"], "abs(correlation) DESC, pair"),
        "SELECT 'categorical_summary', '[]'",
        section("preview", "SELECT * FROM d ORDER BY _row LIMIT 10", names, "_row"),
    ]
    return _with({"_row": "l_orderkey * 10000000 + l_partkey * 10 + l_linenumber", **LINES}, "lineitem", " UNION ALL ".join(parts))


def _documents_case(change: Callable[[str], str]) -> str:
    return f"SELECT doc_id, {change('text')} AS text, {change('lang')} AS lang, {change('source')} AS source, n_chars FROM documents"


def _title(col: str) -> str:
    runs_ = f"regexp_extract_all({col}, '[{_CASED}]+|[^{_CASED}]+')"
    first = "CASE WHEN w[1] = 'ß' THEN 'Ss' ELSE upper(w[1]) END"
    return f"array_to_string(list_transform({runs_}, lambda w: concat({first}, lower(w[2:]))), '')"


def _trimmed(col: str) -> str:
    return f"regexp_replace({col}, '{_TRIM}', '', 'g')"


def oracle_sql() -> dict[str, str]:
    line_cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "gross", "net", "k_const"]
    digits = "trim(digits)"
    part_fit = """
        , tr AS (SELECT regr_slope(p_retailprice, p_partkey) AS a, regr_intercept(p_retailprice, p_partkey) AS b,
                 count(*) AS n FROM split WHERE is_train),
        te AS (SELECT p_retailprice AS y, a * p_partkey + b AS p, n FROM split, tr WHERE NOT is_train)
        SELECT max(n) AS train_rows, count(*) AS test_rows,
               round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 3) AS r2_score,
               round(sqrt(avg((y - p) * (y - p))), 3) AS rmse, round(avg(abs(y - p)), 3) AS mae FROM te"""
    price_fit = "tr AS (SELECT regr_slope(p_retailprice, p_partkey) AS a, regr_intercept(p_retailprice, p_partkey) AS b FROM split WHERE is_train)"
    events_cols = "_row, user_id, event_type"
    sql = {
        "eda_columns": "SELECT * FROM (VALUES (0, 'o_custkey', 'numeric', 'bigint'), (1, 'o_orderstatus', 'categorical', 'string'), "
        "(2, 'o_totalprice', 'numeric', 'double'), (3, 'o_orderdate', 'categorical', 'timestamp_ntz'), "
        "(4, 'o_orderpriority', 'categorical', 'string')) t(\"position\", \"column\", role, dtype)",
        "load_csv": 'SELECT CAST(c_custkey AS BIGINT) AS c_custkey, "name, full", CAST(c_nationkey AS BIGINT) AS c_nationkey, '
        "CAST(CASE WHEN c_acctbal <> 'NA' THEN c_acctbal END AS DOUBLE) AS c_acctbal, flag = 'True' AS flag, "
        f"CASE WHEN mixed NOT IN ('n/a', '') THEN mixed END AS mixed FROM ({spoil(CSV_RAW, 'customer')})",
        "apply_schema": "SELECT _row, try_cast(price AS DOUBLE) AS price, CAST(day AS TIMESTAMP) AS day, CAST(code AS VARCHAR) AS code "
        f"FROM ({spoil(SIDECAR_TEXT, 'orders')})",
        "save_roundtrip": spoil(SAVED, "orders"),
        "save_roundtrip_order": "SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS place FROM orders",
        "dataset_register": " UNION ALL ".join(
            f"SELECT '{n}.parquet' AS name, (SELECT count(*) FROM {n}) AS row_count, (SELECT count(*) FROM (DESCRIBE {n})) AS column_count, "
            f"{repr(t) if t else 'CAST(NULL AS VARCHAR)'} AS target_column"
            for n, t in _REGISTERED.items()
        ),
        "preview": "SELECT *, (SELECT count(*) FROM events) AS row_count, CAST(6 AS INTEGER) AS column_count FROM events ORDER BY event_id LIMIT 15",
        "eda_preview": "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10",
        "json_safe": f"SELECT o_orderkey, CASE WHEN isfinite(price) THEN price END AS price, {_iso('placed_at')} AS placed_at FROM ({spoil(VALUED, 'orders')})",
        "clean_trim": f"SELECT conv_id, turn, {_trimmed('role')} AS role, {_trimmed('text')} AS text FROM ({spoil(SPACED, 'conversations')})",
        "clean_blank_to_null": "SELECT conv_id, turn, "
        + ", ".join(f"CASE WHEN regexp_full_match({n}, '{_WS}*') THEN NULL ELSE {n} END AS {n}" for n in ("role", "text"))
        + f" FROM ({spoil(SPACED, 'conversations')})",
        "clean_headers": "SELECT n_nationkey AS n_key, n_regionkey AS n_key_2, n_name AS \"column\", n_name AS nname_x FROM nation",
        "clean_case_lower": _documents_case(lambda n: f"lower({n})"),
        "clean_case_upper": _documents_case(lambda n: f"upper(replace({n}, 'ß', 'ss'))"),
        "clean_case_title": _documents_case(_title),
        "clean_convert_number": _with(
            TYPED, "events", f"SELECT _row, CASE WHEN regexp_matches({digits}, '{_NUMBER}') THEN try_cast({digits} AS DOUBLE) END AS digits, value, is_view FROM d"
        ),
        "clean_convert_string": _with(
            TYPED, "events", "SELECT _row, digits, CAST(value AS VARCHAR) AS value, CASE WHEN is_view THEN 'True' ELSE 'False' END AS is_view FROM d"
        ),
        "clean_convert_date": _with(DATED, "orders", "SELECT _row, CAST(try_strptime(iso, '%Y-%m-%d') AS TIMESTAMP) AS iso, us FROM d"),
        "clean_convert_date_us": _with(DATED, "orders", "SELECT _row, iso, CAST(try_strptime(us, '%m/%d/%Y') AS TIMESTAMP) AS us FROM d"),
        "clean_convert_date_forms": _with(
            DATE_FORMS,
            "orders",
            "SELECT _row, CASE WHEN named <> 'soon' THEN CAST(strptime(named, '%b %d, %Y') AS TIMESTAMP) END AS named, "
            "CAST(strptime(half, '%m/%d/%Y %I:%M %p') AS TIMESTAMP) AS half, CAST(strptime(zoned[1:19], '%Y-%m-%dT%H:%M:%S') AS TIMESTAMP) AS zoned, "
            "CAST(strptime(month, '%Y-%m') AS TIMESTAMP) AS month FROM d",
        ),
        "clean_drop_empty": _with(PADDED, "events", f"SELECT {events_cols}, value, k_const, k_gap FROM d"),
        "clean_drop_constant": _with(PADDED, "events", f"SELECT {events_cols}, value, k_gap FROM d"),
        "clean_drop_columns": _with(PADDED, "events", f"SELECT {events_cols}, k_const, k_empty FROM d"),
        "clean_drop_missing_rows": _with(EVENTS, "events", "SELECT * FROM d WHERE event_type IS NOT NULL AND value IS NOT NULL"),
        "clean_dedup": _with(VISITS, "events", "SELECT user_id, event_type, min(_row) AS _row, count(*) AS copies FROM d GROUP BY user_id, event_type"),
        **dict.fromkeys(
            ("clean_dedup_hashes", "clean_dedup_filter"),
            _with(COPIED, "events", "SELECT min(_row) AS _row, origin, half, count(*) AS copies FROM d GROUP BY origin, half"),
        ),
        "clean_fill_median": _with(EVENTS, "events", f"SELECT {events_cols}, {rnd('coalesce(value, (SELECT median(value) FROM d))', 6)} AS value FROM d"),
        "clean_fill_mean": _with(EVENTS, "events", f"SELECT {events_cols}, {rnd('coalesce(value, (SELECT avg(value) FROM d))', 6)} AS value FROM d"),
        "clean_fill_zero": _with(EVENTS, "events", f"SELECT {events_cols}, {rnd('coalesce(value, 0)', 6)} AS value FROM d"),
        "clean_fill_mode": _with(EVENTS, "events", f"SELECT {events_cols}, {rnd('coalesce(value, ' + _mode('value') + ')', 6)} AS value FROM d"),
        "clean_fill_cat_mode": _with(
            FLAGGED, "events", f"SELECT _row, user_id, value, coalesce(event_type, {_mode('event_type')}) AS event_type, coalesce(is_view, {_mode('is_view')}) AS is_view FROM d"
        ),
        "clean_remove_outliers": _with(EVENTS, "events", f", b AS ({_bounds('value', 'd')}) SELECT d.* FROM d, b WHERE value BETWEEN lo AND hi"),
        "clean_cap_outliers": _with(
            EVENTS, "events", f", b AS ({_bounds('value', 'd')}) SELECT {events_cols}, {rnd('CASE WHEN value < lo THEN lo WHEN value > hi THEN hi ELSE value END', 4)} AS value FROM d, b"
        ),
        "clean_round": _with(LINES, "lineitem", "SELECT " + ", ".join(f"{rnd(n, 1)} AS {n}" for n in LINES if n != "k_const") + ", k_const FROM d"),
        "outlier_bounds": _with(
            EVENTS,
            "events",
            f", b AS ({_bounds('value', 'd')}) SELECT count(*) AS n_rows, CAST(sum(CASE WHEN value < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_below, "
            "CAST(sum(CASE WHEN value > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_above, round(max(lo), 6) AS lower_bound, round(max(hi), 6) AS upper_bound FROM d, b",
        ),
        "eda_shape": "SELECT count(*) AS rows, CAST(3 AS BIGINT) AS columns FROM events",
        "eda_missing": f"WITH d AS (SELECT * REPLACE (CASE WHEN trim(c_name) = '' THEN NULL ELSE c_name END AS c_name) FROM ({spoil(CUSTOMERS, 'customer')})) "
        + _missing(["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"], "d"),
        "eda_unique": _with(ORDERS, "orders", _unique([n for n in ORDERS if n != "_row"], "d")),
        "eda_duplicates": _with(VISITS, "events", "SELECT CAST(sum(n - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS n FROM d GROUP BY user_id, event_type)"),
        "eda_size": _with(
            ORDERS, "orders", f"SELECT {rnd('(count(*) * 24 + sum(strlen(o_orderstatus)) + sum(coalesce(strlen(o_orderpriority), 0))) / 1048576.0', 3)} AS memory_usage_mb FROM d"
        ),
        "eda_describe": _with(LINES, "lineitem", _describe(line_cols, "d")),
        "eda_correlation": _with(LINES, "lineitem", _matrix(line_cols, "d")),
        "eda_strong_correlation": _with(
            LINES,
            "lineitem",
            'SELECT concat("left", \' vs \', "right") AS pair, correlation FROM '
            f'({_matrix(line_cols, "d")}) WHERE "left" < "right" AND abs(correlation) >= 0.6 ORDER BY abs(correlation) DESC, pair LIMIT 10',
        ),
        "eda_top_values": _with(
            ORDERS,
            "orders",
            _top({"o_orderstatus": _label("o_orderstatus"), "o_orderdate": _label("CAST(o_orderdate AS DATE)", "NaT"), "o_orderpriority": _label("o_orderpriority")}, "d", 10),
        ),
        "eda_document": _eda_document(),
        "eda_profile": _eda_profile(),
        "chart_mean_by_x": _with(
            EVENTS, "events", "SELECT seq, x, round(y, 6) AS y FROM (" + _first_groups("user_id", "avg(value)", "value IS NOT NULL", "CAST(k AS VARCHAR)") + ")"
        ),
        "chart_count_by_x": _with(EVENTS, "events", _first_groups("user_id", "count(*)", "user_id IS NOT NULL", "CAST(k AS VARCHAR)")),
        "chart_pie": _with(
            EVENTS,
            "events",
            f"SELECT CAST(row_number() OVER (ORDER BY y DESC, x) AS INTEGER) AS seq, x, y, round(100.0 * y / sum(y) OVER (), 6) AS share FROM "
            f"(SELECT {_label('event_type')} AS x, count(*) AS y FROM d GROUP BY 1 ORDER BY y DESC, x LIMIT 8)",
        ),
        "chart_line": _with(
            EVENTS,
            "events",
            _titled("line", "Line of user_id by event_type", charts.MEAN, _first_groups("event_type", "avg(user_id)", "event_type IS NOT NULL", "k")),
        ),
        "chart_bar": _with(
            ORDERS,
            "orders",
            _titled("bar", "Bar count by o_orderdate", charts.COUNT, _first_groups("o_orderdate", "count(*)", "o_orderdate IS NOT NULL", "CAST(CAST(k AS DATE) AS VARCHAR)")),
        ),
        "chart_scatter": _with(
            EVENTS,
            "events",
            "SELECT CAST(row_number() OVER (ORDER BY _row) AS INTEGER) AS seq, CAST(user_id AS DOUBLE) AS x, value AS y FROM "
            "(SELECT * FROM d WHERE value IS NOT NULL ORDER BY _row LIMIT 200)",
        ),
        "chart_histogram": _with(EVENTS, "events", _titled("histogram", "Histogram of value", None, _raw("value"))),
        "chart_box": _with(ORDERS, "orders", _titled("box", "Box of o_totalprice", None, _raw("o_totalprice"))),
        "ml_frame": _with(CUSTOMERS, "customer", "SELECT c_acctbal, c_nationkey, c_mktsegment, _row FROM d WHERE c_mktsegment IS NOT NULL"),
        "ml_split": f"WITH {_split('labels', 'doc_id', 'quality', 0.8)} SELECT doc_id, quality, toxic, is_train FROM split",
        "ml_problem_type": "SELECT 'toxic' AS target_column, CASE WHEN count(DISTINCT toxic) <= 12 THEN 'classification' ELSE 'regression' END AS problem_type FROM labels "
        "UNION ALL SELECT 'p_retailprice', CASE WHEN count(DISTINCT p_retailprice) <= 12 THEN 'classification' ELSE 'regression' END FROM part",
        "ml_impute_scale": _with(
            CUSTOMERS,
            "customer",
            ", f AS (SELECT * REPLACE (coalesce(c_acctbal, (SELECT median(c_acctbal) FROM d)) AS c_acctbal) FROM d) SELECT _row, c_name, c_mktsegment, "
            "round((c_nationkey - avg(c_nationkey) OVER ()) / stddev_pop(c_nationkey) OVER (), 6) AS c_nationkey, "
            "round((c_acctbal - avg(c_acctbal) OVER ()) / stddev_pop(c_acctbal) OVER (), 6) AS c_acctbal FROM f",
        ),
        "ml_onehot": _with(
            CUSTOMERS,
            "customer",
            f", s AS (SELECT DISTINCT c_mktsegment AS v FROM d WHERE c_mktsegment IS NOT NULL) SELECT _row, concat('cat__c_mktsegment_', v) AS feature, "
            f"CASE WHEN coalesce(c_mktsegment, {_mode('c_mktsegment')}) = v THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM d, s",
        ),
        "ml_onehot_wide": _with(
            CUSTOMERS,
            "customer",
            "SELECT _row, dense_rank() OVER (ORDER BY c_name) - 1 AS slot, concat('cat__c_name_', c_name) AS feature FROM d",
        ),
        "ml_class_metrics": """
            WITH k AS (SELECT UNNEST([0, 1]) AS k),
            p AS (SELECT k, count(*) FILTER (quality = k) AS support, count(*) FILTER (toxic = k) AS named,
                  count(*) FILTER (quality = k AND toxic = k) AS hit FROM labels, k GROUP BY k)
            SELECT round_even(sum(hit) / sum(support) * 1e4, 0) / 1e4 AS accuracy,
              round_even(sum(support * CASE WHEN named = 0 THEN 0 ELSE hit / named END) / sum(support) * 1e4, 0) / 1e4 AS "precision",
              round_even(sum(support * CASE WHEN support = 0 THEN 0 ELSE hit / support END) / sum(support) * 1e4, 0) / 1e4 AS recall,
              round_even(sum(support * CASE WHEN named + support = 0 THEN 0 ELSE 2 * hit / (named + support) END) / sum(support) * 1e4, 0) / 1e4 AS f1_score
            FROM p""",
        "ml_confusion": 'SELECT quality AS actual, count(*) FILTER (toxic = 0) AS "0", count(*) FILTER (toxic = 1) AS "1" FROM labels GROUP BY quality',
        "ml_reg_metrics": "WITH e AS (SELECT p_retailprice AS y, p_partkey * 0.05::DOUBLE + 900 AS p FROM part) "
        f"SELECT {rnd('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 4)} AS r2_score, "
        f"{rnd('sqrt(avg((y - p) * (y - p)))', 4)} AS rmse, {rnd('avg(abs(y - p))', 4)} AS mae FROM e",
        "ml_train_linear": f"WITH {_split('part', 'p_partkey', '1', 0.8)} {part_fit}",
        "ml_linear_importance": f"WITH {_split('part', 'p_partkey', '1', 0.8)} SELECT 'num__p_partkey' AS name, "
        "round(abs(regr_slope(p_retailprice, p_partkey)) * stddev_pop(p_partkey), 3) AS importance FROM split WHERE is_train",
        "ml_linear_predictions": f"WITH {_split('part', 'p_partkey', '1', 0.8)}, {price_fit} SELECT CAST(row_number() OVER (ORDER BY p_partkey) AS INTEGER) AS seq, "
        "round(p_retailprice, 3) AS actual, round(a * p_partkey + b, 3) AS predicted FROM split, tr WHERE NOT is_train ORDER BY p_partkey LIMIT 10",
        "ml_model_reload": f"WITH {_split('part', 'p_partkey', '1', 0.8)}, {price_fit} SELECT p_partkey, round(a * p_partkey + b, 3) AS predicted FROM split, tr",
        "ml_linear_report": f"""WITH {_split('part', 'p_partkey', '1', 0.8)}, {price_fit},
            side AS (SELECT is_train, count(*) AS n, round(1 - sum((p_retailprice - a * p_partkey - b) ** 2) / (var_pop(p_retailprice) * count(*)), 3) AS r2
                     FROM split, tr GROUP BY is_train)
            SELECT 'p_retailprice' AS target_column, '["p_partkey"]' AS selected_feature_columns, 'linear' AS requested_model_type, 'linear' AS selected_model_key,
              CAST(80 AS DOUBLE) AS train_split_percentage, '0.8:0.2' AS train_test_ratio, x.n AS train_rows, y.n AS test_rows, x.n + y.n AS total_rows,
              CAST(1 AS BIGINT) AS feature_count, CAST(1 AS BIGINT) AS numeric_feature_count, CAST(0 AS BIGINT) AS categorical_feature_count,
              'regression' AS problem_type, y.r2 AS score, x.r2 AS train_score, y.r2 AS test_score
            FROM side x, side y WHERE x.is_train AND NOT y.is_train""",
        "run_history": f"WITH r AS ({spoil(RUNS, 'events')}), s AS ({spoil(CATALOG, 'customer')}) "
        f"SELECT project_id, id, run_type, title, dataset_id, dataset_name, score, {_iso('created_at')} AS created_at FROM "
        "(SELECT r.*, s.name AS dataset_name, row_number() OVER (PARTITION BY r.project_id ORDER BY r.created_at DESC, r.id DESC) AS rn "
        "FROM r JOIN s ON r.dataset_id = s.id) WHERE rn <= 20",
        "run_latest": _LATEST,
        "dataset_list": spoil(CATALOG, "customer"),
        "dashboard_snapshot": "SELECT project_id, 'datasets' AS section, concat('{\"id\":', id, ',\"name\":\"', name, '\",\"row_count\":', row_count, "
        "',\"column_count\":', column_count, ',\"target_column\":', " + _quoted("target_column") + ", ',\"created_at\":\"', " + _iso("created_at")
        + f", '\"}}') AS payload FROM ({spoil(CATALOG, 'customer')}) UNION ALL SELECT project_id, "
        "CASE run_type WHEN 'visualization' THEN 'latest_visualizations' ELSE concat('latest_', run_type) END, payload_json "
        f"FROM ({_LATEST})",
        "clean_summary": _with(
            {k: v for k, v in PADDED.items() if k != "_row"},
            "events",
            f""", u AS (SELECT DISTINCT user_id, event_type FROM d),
                b AS ({_bounds('user_id', 'u')}), o AS (SELECT u.* FROM u, b WHERE user_id BETWEEN lo AND hi)
                SELECT (SELECT count(*) FROM d) AS rows_before, (SELECT count(*) FROM o) AS rows_after,
                '["user_id", "event_type", "value", "k_const", "k_empty", "k_gap"]' AS columns_before,
                '["user_id", "event_type"]' AS columns_after, '["k_gap", "value"]' AS dropped_columns,
                '["k_empty"]' AS empty_columns_dropped, '["k_const"]' AS constant_columns_dropped,
                (SELECT count(*) FROM d) - (SELECT count(*) FROM u) AS duplicates_removed, CAST(0 AS BIGINT) AS missing_rows_dropped,
                (SELECT count(*) FROM o WHERE event_type IS NULL) AS missing_after, 'zero' AS fill_missing,
                (SELECT count(*) FROM u) - (SELECT count(*) FROM o) AS outliers_removed, CAST(0 AS BIGINT) AS outliers_capped,
                CAST(3 AS BIGINT) AS round_digits""",
        ),
        "clean_composed": f"""
            WITH t AS (SELECT _row, upper(CASE WHEN trim(c_name, chr(9) || ' ') = '' THEN NULL ELSE trim(c_name, chr(9) || ' ') END) AS c_name,
                       c_acctbal, upper(c_mktsegment) AS c_mktsegment FROM ({spoil(CUSTOMERS, 'customer')})),
            u AS (SELECT min(_row) AS _row, c_name, c_acctbal, c_mktsegment FROM t GROUP BY ALL),
            f AS (SELECT _row, coalesce(c_name, 'Unknown') AS c_name, coalesce(c_acctbal, (SELECT avg(c_acctbal) FROM u)) AS c_acctbal,
                  coalesce(c_mktsegment, 'Unknown') AS c_mktsegment FROM u),
            b AS ({_bounds('c_acctbal', 'f')})
            SELECT _row, c_name, {rnd('CASE WHEN c_acctbal < lo THEN lo WHEN c_acctbal > hi THEN hi ELSE c_acctbal END', 2)} AS c_acctbal,
                   c_mktsegment FROM f, b""",
    }
    sql["dataset_commit"] = (
        f"SELECT r.*, CAST(7 AS BIGINT) AS dataset_id, 'customers' AS name, count(*) OVER () AS row_count, CAST(3 AS BIGINT) AS column_count, "
        f"CAST(11 AS BIGINT) AS run_id, 'cleaning' AS run_type, 'Data cleaning result' AS title, count(*) OVER () AS rows_after FROM ({sql['clean_composed']}) r"
    )
    for how, text in (("unknown", "Unknown"), ("empty", "")):
        sql[f"clean_fill_cat_{how}"] = _with(
            FLAGGED,
            "events",
            f"SELECT _row, user_id, value, coalesce(event_type, '{text}') AS event_type, "
            f"CASE WHEN is_view THEN 'True' WHEN NOT is_view THEN 'False' ELSE '{text}' END AS is_view FROM d",
        )
    if llm_queries:
        sql |= llm_queries.oracle_sql()
        if corpus_pipeline.ORACLE_SQL:
            sql["pipeline"] = corpus_pipeline.ORACLE_SQL
    return sql
