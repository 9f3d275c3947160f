"""Line deduplication by distinct-site spread.

Each line's key (its md5) gathers the sites that carry it in a HyperLogLog sketch; sketches merge by aggregation, so a
line on a third of all rows costs one sketch per task.  Lines clearly above ``min_sites`` are boilerplate, lines
near it (``margin``) are settled by exact distinct counts, and all others are left.

Boilerplate is then removed from texts.  A text that has no other lines is no page with boilerplate but a copy of other
texts; it is left whole, for the near-duplicate stage.  With ``max_share`` below 1, texts with more than that share of
their characters in such lines are left whole too.
A null site counts as one site without a name.  Null texts stay null, empty lines are never boilerplate and stay.
Repeated rows are handled alike; extra columns stay as they are, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.llm.common import fresh, slices
from tidemill.session import stage

#: Keys of boilerplate lines that are sent to the executors (24 bytes each); beyond it they are joined.
BROADCAST_LINES = 500_000


@dataclass(frozen=True)
class Spread:
    min_sites: int = 10
    margin: float = 0.25
    lg_k: int = 12
    max_share: float = 1.0


def boilerplate(df: DataFrame, text_col: str = "text", site_col: str = "source", spread: Spread = Spread()) -> DataFrame:
    """The keys (``line_key``) of lines on at least ``min_sites`` distinct sites."""
    site = F.coalesce(c(site_col).cast("string"), F.lit("")).alias("site")
    lines = df.select(site, F.explode(F.split(c(text_col), "\n")).alias("line")).where("length(trim(line)) > 0")
    lines = lines.select("site", F.unhex(F.md5("line")).alias("line_key"))
    sketches = lines.groupBy("line_key").agg(F.hll_sketch_agg("site", spread.lg_k).alias("sketch"))
    low, high = spread.min_sites * (1 - spread.margin), spread.min_sites * (1 + spread.margin)
    estimate = F.hll_sketch_estimate("sketch").alias("sites")
    wide = stage(sketches.select("line_key", estimate).where(F.col("sites") >= low), "spread")
    near = lines.join(wide.where(F.col("sites") < high).select("line_key"), "line_key", "left_semi")
    exact = near.groupBy("line_key", "site").agg(F.lit(1).alias("one")).groupBy("line_key").agg(F.count("one").alias("sites"))
    clear = wide.where(F.col("sites") >= high).select("line_key")
    return clear.unionByName(exact.where(F.col("sites") >= spread.min_sites).select("line_key"))


def remove_boilerplate(
    df: DataFrame, text_col: str = "text", site_col: str = "source", spread: Spread = Spread(), broadcast_lines: int = BROADCAST_LINES,
    counts: bool = True,
) -> DataFrame:
    """The rows with cleaned texts.

    With ``counts``, ``n_lines`` and ``n_removed`` (lines) are added at the end, with underscores behind names that the table has already.
    """
    keys = stage(boilerplate(df, text_col, site_col, spread), "boilerplate")
    if keys.count() <= broadcast_lines:
        known = df.sparkSession.sparkContext.broadcast(frozenset(bytes(r.line_key) for r in keys.collect()))
        return _cleaned(df, text_col, None, spread.max_share, known, counts)
    text_key, drops_name, own_key = fresh(df, "text_key", "line_drops", "line_text_key")
    lines = df.select(F.md5(c(text_col)).alias("text_key"), F.posexplode(F.split(c(text_col), "\n")).alias("at", "line"))
    hits = lines.select("text_key", "at", F.unhex(F.md5("line")).alias("line_key")).join(keys, "line_key", "left_semi")
    drops = hits.groupBy("text_key").agg(F.collect_set("at").alias(drops_name)).withColumnRenamed("text_key", text_key)
    joined = df.withColumn(own_key, F.md5(c(text_col))).join(drops, c(own_key) == c(text_key), "left").drop(own_key, text_key)
    return _cleaned(joined, text_col, drops_name, spread.max_share, None, counts)


def _cleaned(df: DataFrame, text_col: str, drops_col: str | None, max_share: float, known, counts: bool) -> DataFrame:
    names = [n for n in df.columns if n != drops_col]
    own = df.select(*[c(n) for n in names])
    added = fresh(own, "n_lines", "n_removed") if counts else []
    schema = own.schema
    for name in added:
        schema = schema.add(name, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (x for b in batches for x in slices(b)):
            texts = batch.column(names.index(text_col)).to_pylist()
            drops = batch.column(len(names)).to_pylist() if drops_col else [None] * len(texts)
            done = [_clean(t, d, known.value if known else (), max_share) for t, d in zip(texts, drops, strict=True)]
            arrays = [batch.column(i) for i in range(len(names))]
            arrays[names.index(text_col)] = pa.array([x[0] for x in done], arrays[names.index(text_col)].type)
            arrays += [pa.array([x[i] for x in done], pa.int64()) for i in (1, 2)[: len(added)]]
            yield pa.RecordBatch.from_arrays(arrays, names=[*names, *added])

    order = [c(n) for n in names] + ([c(drops_col)] if drops_col else [])
    return df.select(*order).mapInArrow(run, schema)


def _clean(text: str | None, drops: list[int] | None, known, max_share: float) -> tuple[str | None, int, int]:
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if known:
        drops = [i for i, x in enumerate(lines) if x and hashlib.md5(x.encode("utf-8", "replace")).digest() in known]
    gone = set(drops or ())
    if not gone or sum(len(lines[i]) for i in gone) > max_share * sum(map(len, lines)):
        return text, len(lines), 0
    if max_share >= 1 and not any(x.strip(" ") for i, x in enumerate(lines) if i not in gone):
        return text, len(lines), 0
    return "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)
