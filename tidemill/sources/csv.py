"""CSV tables: header handling, null tokens and narrow type inference."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.columns import c
from tidemill.functions.labels import value_text
from tidemill.functions.numbers import INFINITY, NUMBER, number_text, text_to_number
from tidemill.roles import ROW, data_columns, dtype_of
from tidemill.session import stage

# Field texts read as missing, besides the empty text.
NULL_TOKENS = (
    "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
# Field texts read as booleans.
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")

_INTEGER = r"^[+-]?\d+$"
_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_CORRUPT = "_corrupt"
_SPLIT = {"__path": "_metadata.file_path", "__start": "_metadata.file_block_start"}
#: Rows of one split are numbered below this; Spark numbers the rows of a task in the same way.
_SPLIT_ROWS = 1 << 33
#: File splits whose positions are broadcast (some 150 bytes each); beyond it they are joined.
_BROADCAST_SPLITS = 1_000_000
_GAP, _WHOLE, _HUGE, _NUMBER, _BOOLEAN, _TEXT, _UNSIGNED, _NEGATIVE = 1, 2, 4, 8, 16, 32, 64, 128
#: Holds whole numbers up to the greatest unsigned one of 64 bits.
_UNSIGNED_TYPE, _UNSIGNED_MAX = "decimal(20,0)", Decimal((1 << 64) - 1)


def unique_headers(names: Sequence[str | None]) -> list[str]:
    """Repeated headers become ``a``, ``a.1``, ``a.2``; empty ones ``Unnamed: 0``.

    Headers differing only in case count as repeated, since Spark's column names
    ignore case, and so does one that is the name of the row position.
    """
    named = [n if n else f"Unnamed: {i}" for i, n in enumerate(names)]
    taken = {n.lower() for n in named}
    seen = {ROW}
    result = []
    for name in named:
        header, n = name, 0
        while header.lower() in seen or (n and header.lower() in taken):
            n += 1
            header = f"{name}.{n}"
        seen.add(header.lower())
        result.append(header)
    return result


def _has_quoted_line_breaks(spark: SparkSession, path: str) -> bool:
    """Whether any physical line opens a quoted field without closing it (stops at the first).

    Quotes inside a field that doesn't start with one are plain characters.
    """
    inside = r'"(?:[^"]++|"")*+'
    open_field = rf'^(?:(?:{inside}"[^,]*+|[^",][^,]*+|),)*+{inside}$'
    return not spark.read.text(path).filter(F.col("value").contains('"') & F.col("value").rlike(open_field)).select(F.lit(1)).isEmpty()


def _reader(spark: SparkSession, multi_line: bool, path: str, fields: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in fields])
    reader = spark.read.options(**_OPTIONS, multiLine=multi_line, columnNameOfCorruptRecord=_CORRUPT)
    return reader.csv(path, header=True, schema=schema, enforceSchema=True)


def _headers(spark: SparkSession, path: str, multi_line: bool) -> list[str]:
    first = spark.read.options(**_OPTIONS, multiLine=multi_line).csv(path, header=False).first()
    if first is None:
        raise ValueError(f"no header row in {path}")
    return unique_headers(list(first))


def _known(col: Column) -> Column:
    return F.when(~col.isin("", *NULL_TOKENS), col)


def _refuse_wide_rows(spark: SparkSession, path: str, names: list[str], multi_line: bool) -> None:
    """Rows with more fields than the header are an error; missing fields are null."""
    wide = _reader(spark, multi_line, path, [*names, "_spare"])
    if not wide.filter(c("_spare").isNotNull()).select("_spare").isEmpty():
        raise ValueError(f"rows with more than {len(names)} fields in {path}")


def _kind(col: Column) -> Column:
    """What one field looks like, as bits; a column's bits are simply or-ed."""
    text = number_text(col)
    small, wide = text.try_cast("bigint"), text.try_cast(_UNSIGNED_TYPE)
    whole = F.when(small < 0, _WHOLE | _NEGATIVE).when(small >= 0, _WHOLE).when(wide.between(0, _UNSIGNED_MAX), _UNSIGNED).otherwise(_HUGE)
    return (
        F.when(col.isNull(), _GAP)
        .when(text.rlike(_INTEGER), whole)
        .when(text.rlike(NUMBER) | text.rlike(INFINITY), _NUMBER)
        .when(col.isin(*TRUE_TOKENS, *FALSE_TOKENS), _BOOLEAN)
        .otherwise(_TEXT)
    )


def _typed(col: Column, seen: int) -> Column:
    """The narrowest type that holds everything seen in a column."""
    if seen in (_UNSIGNED, _UNSIGNED | _WHOLE):
        return number_text(col).cast(_UNSIGNED_TYPE)
    if seen & _UNSIGNED:
        seen |= _HUGE
    seen &= ~(_UNSIGNED | _NEGATIVE)
    values = seen & ~_GAP
    if not values:
        return col.cast("double")
    if values == _BOOLEAN:
        return col.isin(*TRUE_TOKENS)
    if seen == _WHOLE:
        return number_text(col).cast("bigint")
    if not values & ~(_WHOLE | _NUMBER) or values & _NUMBER and not values & ~(_WHOLE | _NUMBER | _HUGE):
        return text_to_number(col)
    return col


def _with_position(df: DataFrame, splits: DataFrame) -> DataFrame:
    """Number rows by path, place in the file and line, however Spark packs files into tasks."""
    order = Window.orderBy(*_SPLIT)
    ranks = splits.select(*_SPLIT, F.row_number().over(order).cast("long").alias("__rank"))
    ranks = F.broadcast(ranks) if splits.count() <= _BROADCAST_SPLITS else ranks
    line = F.monotonically_increasing_id().bitwiseAND(F.lit(_SPLIT_ROWS - 1))
    rows = df.withColumn("__line", line).join(ranks, list(_SPLIT))
    return rows.withColumn(ROW, (F.col("__rank") - 1) * _SPLIT_ROWS + F.col("__line")).drop("__line", "__rank", *_SPLIT)


def read_csv(spark: SparkSession, path: str, multi_line: bool | None = None) -> DataFrame:
    """Read a CSV table with its row position.

    Columns are text narrowed to bigint, double or boolean where every value
    fits, or to decimal(20,0) where whole numbers need all 64 bits without a sign and there
    are no gaps; dates stay text, and whole numbers with gaps become double.  One aggregate
    scan decides all types, finds malformed rows and lists the file splits, whose
    order gives the row position.  Files are split for
    parallel reading unless some field spans lines, which is looked for when
    ``multi_line`` is left open.
    """
    if multi_line is None:
        multi_line = _has_quoted_line_breaks(spark, path)
    names = _headers(spark, path, multi_line)
    marked = _reader(spark, multi_line, path, [*names, _CORRUPT])
    facts = [F.bit_or(_kind(_known(c(n)))).alias(f"k{i}") for i, n in enumerate(names)]
    place = [F.col(source).alias(name) for name, source in _SPLIT.items()]
    marked = marked.select("*", *place).groupBy(*_SPLIT).agg(*facts, F.count(c(_CORRUPT)).alias("odd"))
    splits = stage(marked, "csv-splits")
    seen = splits.agg(*[F.bit_or(c(f"k{i}")).alias(f"k{i}") for i in range(len(names))], F.sum("odd").alias("odd")).first()
    if seen["odd"]:
        _refuse_wide_rows(spark, path, names, multi_line)
    text = _reader(spark, multi_line, path, names)
    typed = [_typed(_known(c(n)), seen[i] or 0).alias(n) for i, n in enumerate(names)]
    return _with_position(text.select(*typed, *place), splits)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write values in the text forms that :func:`read_csv` and other tools read back.

    Rows with a position are sorted by it, so that part files in name order hold
    them in row order; this is a range shuffle.
    """
    df = df.orderBy(c(ROW)) if ROW in df.columns else df
    texts = [value_text(c(n), dtype_of(df, n), "micro").alias(n) for n in data_columns(df)]
    df.select(*texts).write.mode(mode).options(**_OPTIONS, emptyValue='""', nullValue="").csv(path, header=True)
