"""Model input: features and target, problem type, train/test split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.functions.labels import value_text
from tidemill.roles import ROW, data_columns, dtype_of, is_numeric, order_column
from tidemill.session import stage

#: Fixed value: a target with at most this many values is treated as classes.
MAX_CLASS_VALUES = 12
#: Rows looked at first when asking whether a target has more values than that.
_WITNESS_ROWS = 10_000
_BUCKET_HEX = 4
#: Hex digits of a row's hash.
_HASH_HEX = 32
#: A class's bucket that holds the cut is narrowed until it has at most so many rows, which one task ranks.
RANKED_ROWS = 100_000
#: Up to this many classes, per-class tables are kept as local rows.
_LOCAL_CLASSES = 10_000
SEED = 42
TRAIN = "is_train"


def feature_columns(df: DataFrame, target: str, wanted: Sequence[str] = ()) -> list[str]:
    """The requested features that exist, or all columns but the target."""
    names = data_columns(df)
    if target not in names:
        raise ValueError(f"there is no column {target!r} to predict")
    features = [n for n in dict.fromkeys(wanted) if n in names and n != target]
    features = features or [n for n in names if n != target]
    if not features:
        raise ValueError(f"the table has no column besides {target!r} to learn from")
    return features


def model_frame(df: DataFrame, target: str, wanted: Sequence[str] = (), key: str | None = None) -> DataFrame:
    """Features and target (and a row key), without rows lacking a target."""
    features = feature_columns(df, target, wanted)
    keep = [n for n in (ROW, key) if n and n in df.columns and n not in features and n != target]
    return df.filter(c(target).isNotNull()).select(*[c(n) for n in [*features, target, *dict.fromkeys(keep)]])


def few_values(df: DataFrame, column: str, limit: int) -> bool:
    """Whether a column has at most ``limit`` distinct values.

    The first rows usually settle it: finding more than ``limit`` values in any
    part of the table proves the answer without shuffling a continuous column.
    Only otherwise is the whole column reduced to its distinct values, which is
    then cheap as each task keeps one row per value.
    """
    values = df.select(c(column).alias("v")).filter(F.col("v").isNotNull())
    for part in (values.limit(_WITNESS_ROWS), values):
        if part.distinct().limit(limit + 1).count() > limit:
            return False
    return True


def is_classification(df: DataFrame, target: str) -> bool:
    """Text and booleans are classes; numbers and times are if they have few values."""
    if isinstance(dtype_of(df, target), (T.StringType, T.BooleanType)):
        return True
    return few_values(df, target, MAX_CLASS_VALUES)


def problem_type(df: DataFrame, target: str) -> DataFrame:
    kind = "classification" if is_classification(df, target) else "regression"
    if kind == "regression" and not is_numeric(dtype_of(df, target)):
        raise TypeError(f"target {target!r} is neither a number nor a class")
    return df.sparkSession.createDataFrame([(target, kind)], "target_column string, problem_type string")


def shuffle_key(df: DataFrame, key: str, seed: int = SEED) -> Column:
    """A reproducible pseudo-random text per row, the same in any SQL engine."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), value_text(c(key), dtype_of(df, key))))


def train_sizes(buckets: DataFrame, label: str, share: float) -> DataFrame:
    """Train rows per class: in total ``floor(rows * share)``, spread by largest remainder.

    ``buckets`` holds counts ``m``; the final ranking looks at classes, not at rows.
    """
    classes = buckets.groupBy(c(label).alias("label")).agg(F.sum("m").alias("n"))
    wide = "decimal(38,0)"
    everything = Window.partitionBy()
    total = F.sum("n").over(everything)
    sized = classes.withColumn("total", total).withColumn("k", F.floor(F.col("total") * F.lit(float(share))).cast("bigint"))
    product = F.col("n").cast("decimal(19,0)") * F.col("k").cast("decimal(19,0)")
    parts = sized.select(
        "label",
        "n",
        "k",
        F.floor(product / F.col("total")).cast("bigint").alias("base"),
        (product.cast(wide) % F.col("total").cast(wide)).alias("rest"),
    )
    by_rest = Window.orderBy(F.desc("rest"), F.asc("label"))
    place = F.row_number().over(by_rest)
    spare = F.col("k") - F.sum("base").over(everything)
    return parts.select("label", "n", (F.col("base") + (place <= spare).cast("bigint")).alias("n_train"))


def _bounded(df: DataFrame) -> DataFrame:
    """A per-class table for broadcast if its rows, counted here, are few, so that joins need no shuffle; else a stored one."""
    rows = df.limit(_LOCAL_CLASSES + 1).collect()
    if len(rows) > _LOCAL_CLASSES:
        return stage(df, "classes")
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _cut(buckets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per class ``__s`` the bucket ``__b`` its cut lies in, the rows ``m`` in it, and how many of them, ``give``, are train rows.

    ``buckets`` holds counts ``m`` for each bucket, ``wanted`` the train rows ``give`` of each class in all its buckets.
    """
    upto = F.sum("m").over(Window.partitionBy("__s").orderBy("__b"))
    reached = F.col("upto") >= F.col("give")
    return _bounded(
        buckets.withColumn("upto", upto)
        .join(wanted, "__s")
        .groupBy("__s")
        .agg(
            F.min(F.when(reached, F.col("__b"))).alias("__b"),
            F.min_by("m", F.when(reached, F.col("__b"))).alias("m"),
            (F.max("give") - F.coalesce(F.max(F.when(~reached, F.col("upto"))), F.lit(0))).alias("give"),
        )
    )


def _narrowed(narrow: DataFrame, cuts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The cuts by longer hash prefixes, and the length of those.

    Each round counts, in one scan and with a row per bucket and task in the shuffle, only the rows below the present prefixes by
    the next digits.  Hashes of distinct keys differ, so this ends with buckets of at most ``most`` rows.
    """
    digits = _BUCKET_HEX
    while digits < _HASH_HEX and (cuts.agg(F.max("m")).first()[0] or 0) > most:
        longer = digits + _BUCKET_HEX
        inside = narrow.withColumn("__b", F.substring("__h", 1, digits)).join(cuts.select("__s", "__b"), ["__s", "__b"])
        buckets = inside.groupBy("__s", F.substring("__h", 1, longer).alias("__b")).agg(F.count(F.lit(1)).alias("m"))
        cuts, digits = _cut(buckets, cuts.select("__s", "give")), longer
    return cuts, digits


def split(
    df: DataFrame,
    share: float = 0.8,
    label: str | None = None,
    key: str | None = None,
    seed: int = SEED,
    flag: str = TRAIN,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Add a boolean ``flag`` for train rows: an exact-size, reproducible split, stratified by ``label`` if given.

    ``key`` must be unique per row (default: the row position).  Each class
    sends its rows with the smallest key hash to the train side.  The cut-off hash
    of a class is found from counts per leading hash digits; the one bucket holding
    the cut is counted by further digits until it has at most ``ranked_rows`` rows,
    and only those are ranked, whatever the size of the class.  Marking the rows is
    then a map-only step.
    """
    key = order_column(df, key)
    stratum = value_text(c(label), dtype_of(df, label)) if label else F.lit("")
    hashed = {"__h": shuffle_key(df, key, seed), "__s": F.coalesce(stratum, F.lit(""))}
    narrow = df.select(*[v.alias(k) for k, v in hashed.items()])
    buckets = narrow.groupBy("__s", F.substring("__h", 1, _BUCKET_HEX).alias("__b")).agg(F.count(F.lit(1)).alias("m"))
    sizes = train_sizes(buckets, "__s", share).select(c("label").alias("__s"), c("n_train").alias("give"))
    cuts, digits = _narrowed(narrow, _cut(buckets, sizes), ranked_rows)
    place = F.row_number().over(Window.partitionBy("__s").orderBy("__h"))
    last = _bounded(
        narrow.withColumn("__b", F.substring("__h", 1, digits))
        .join(cuts, ["__s", "__b"])
        .withColumn("place", place)
        .filter(F.col("place") == F.col("give"))
        .select("__s", F.col("__h").alias("__last"))
    )
    marked = df.withColumns(hashed).join(last, "__s", "left")
    return marked.select(
        *[c(n) for n in df.columns], F.coalesce(F.col("__h") <= F.col("__last"), F.lit(False)).alias(flag)
    )
