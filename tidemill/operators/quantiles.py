"""Exact, linearly interpolated quantiles at any scale.

The built-in exact ``percentile`` keeps every distinct value of a column in the
final task.  Here, a wanted rank is first narrowed down: mergeable KLL sketches of all
columns, from one scan, *propose* a pair of cut points around it, exact counts below and at the
cut points *prove* which side the rank is on, and the interval shrinks by a factor of
about 100 per round until its counted rows fit one task and can be sorted.  The sketch
affects only the number of rounds, never the answer.  A value held by a large share
of the rows becomes a cut point itself and is settled by its own count.  Columns
that are few and small to begin with are sorted at once.

Sketching, proving and sorting are one scan each for all columns together: three scans for any number of columns
of up to some hundred million rows, and two more for every further factor of 100.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c

#: An interval with at most this many rows is sorted by one task...
FINISH_ROWS = 1_000_000
#: ...together with others, up to this many values per job.
_FINISH_CELLS = 8_000_000
#: Pairs of cut points counted per scan.
_CUTS_PER_SCAN = 512
#: Size of a sketch, whose ranks are off by about a thousandth, and what is left to either side of a wanted rank.
_SKETCH, _MARGIN = 4_096, 0.004


@dataclass
class _Search:
    """The value at one rank of one column, and what is proven about it."""

    name: str
    rank: int
    size: int  # rows strictly between low and high
    below: int = 0  # rows at or under low
    low: float | None = None
    high: float | None = None
    cuts: tuple[float, float] | None = None
    value: float | None = None

    @property
    def interval(self) -> tuple[str, float | None, float | None]:
        return self.name, self.low, self.high

    def shares(self) -> tuple[float, float]:
        """Where to cut the interval: a few errors of the sketched rank to either side."""
        share = round((self.rank - self.below + 0.5) / self.size, 3)  # alike for neighbouring ranks
        return max(0.0, share - _MARGIN), min(1.0, share + _MARGIN)

    def narrow(self, under_a: int, to_a: int, under_b: int, to_b: int) -> None:
        """Use the numbers of rows under and up to each cut point."""
        a, b = self.cuts
        above = self.below + self.size
        self.cuts = None
        if self.rank < under_a:
            self.high, self.size = a, under_a - self.below
        elif self.rank < to_a:
            self.value = a
        elif self.rank < under_b:
            self.low, self.high, self.below, self.size = a, b, to_a, under_b - to_a
        elif self.rank < to_b:
            self.value = b
        else:
            self.low, self.below, self.size = b, to_b, above - to_b


def _inside(name: str, low: float | None, high: float | None) -> Column:
    test = c(name).isNotNull()
    if low is not None:
        test &= c(name) > F.lit(low)
    if high is not None:
        test &= c(name) < F.lit(high)
    return test


def _first_row(df: DataFrame, aggs: Sequence[Column]) -> list:
    return list(df.agg(*[a.alias(f"a{i}") for i, a in enumerate(aggs)]).first())


def _any(tests: Sequence[Column]) -> Column:
    return reduce(lambda x, y: x | y, tests)


def _sketch(df: DataFrame, searches: Sequence[_Search]) -> None:
    """Propose cuts from a sketch of each open interval, all from one scan."""
    intervals = list(dict.fromkeys(s.interval for s in searches))
    wanted = {i: sorted({p for s in searches if s.interval == i for p in s.shares()}) for i in intervals}
    sketches = df.agg(*[F.kll_sketch_agg_double(F.when(_inside(*i), c(i[0])), _SKETCH).alias(f"k{j}") for j, i in enumerate(intervals)])
    picks = [F.kll_sketch_get_quantile_double(f"k{j}", F.array(*[F.lit(p) for p in wanted[i]])).alias(f"a{j}") for j, i in enumerate(intervals)]
    found = {i: dict(zip(wanted[i], got)) for i, got in zip(intervals, sketches.select(*picks).first())}
    for s in searches:
        s.cuts = tuple(found[s.interval][p] for p in s.shares())


def _prove(df: DataFrame, searches: Sequence[_Search]) -> None:
    """Exact row counts at the proposed cuts."""
    cut = [s for s in searches if s.cuts]
    pairs = list(dict.fromkeys((s.name, *s.cuts) for s in cut))
    found = {}
    for start in range(0, len(pairs), _CUTS_PER_SCAN):
        part = pairs[start : start + _CUTS_PER_SCAN]
        tests = [(x < F.lit(a), x <= F.lit(a), x < F.lit(b), x <= F.lit(b)) for n, a, b in part for x in (c(n),)]
        row = _first_row(df, [F.count_if(t) for four in tests for t in four])
        found.update({pair: row[4 * i : 4 * i + 4] for i, pair in enumerate(part)})
    for s in cut:
        s.narrow(*found[(s.name, *s.cuts)])


def _finish(df: DataFrame, searches: Sequence[_Search]) -> None:
    """Sort the rows left in each interval; their number has been counted."""
    sizes = {s.interval: s.size for s in searches}
    while sizes:
        batch, cells = [], 0
        for interval, size in list(sizes.items()):
            if not batch or cells + size <= _FINISH_CELLS:
                batch.append(interval)
                cells += sizes.pop(interval)
        here = [s for s in searches if s.interval in batch]
        for s, value in zip(here, _sorted_values(df, here), strict=True):
            s.value = value


def _sorted_values(df: DataFrame, searches: Sequence[_Search]) -> list[float]:
    """The value at each search's rank, from its sorted interval.

    Columns become rows of their place and value first, so that a row is tested against the bounds of its own column only.  A test
    of all columns in one expression makes a method too large for the JVM to compile, which it then interprets.
    """
    names = list(dict.fromkeys(s.name for s in searches))
    slots = {n: list(dict.fromkeys(s.interval for s in searches if s.name == n)) for n in names}
    wanted = {i: [s.rank - s.below + 1 for s in searches if s.interval == i] for own in slots.values() for i in own}
    place, value = F.col("place"), F.col("value")

    def by_place(slot: int, of: Callable[[tuple], object], none: object) -> Column:
        """What the interval in this slot has, by the place of its column."""
        return F.get(F.array(*[F.lit(of(slots[n][slot])) if slot < len(slots[n]) else F.lit(none) for n in names]), place)

    def inside(slot: int) -> Column:
        low, high = by_place(slot, lambda i: i[1], 0.0).cast("double"), by_place(slot, lambda i: i[2], 0.0).cast("double")
        return (low.isNull() | (value > low)) & (high.isNull() | (value < high))

    every = range(max(map(len, slots.values())))
    long = df.select(F.posexplode(F.array(*[c(n) for n in names])).alias("place", "value")).filter(value.isNotNull())
    left = long.filter(_any([inside(k) for k in every]))
    lists = left.groupBy("place").agg(*[F.sort_array(F.collect_list(F.when(inside(k), value))).alias(f"s{k}") for k in every])

    def picked(slot: int) -> Column:
        return F.transform(by_place(slot, lambda i: wanted[i], []).cast("array<int>"), lambda at: F.element_at(c(f"s{slot}"), at))

    lists = lists.select("place", *[picked(k).alias(f"a{k}") for k in every])
    rows = {names[r["place"]]: r for r in lists.collect()}  # a row for each column
    found = {i: iter(rows[n][f"a{k}"]) for n, own in slots.items() for k, i in enumerate(own)}
    return [next(found[s.interval]) for s in searches]


def _solve(df: DataFrame, searches: Sequence[_Search], finish_rows: int) -> None:
    # Many columns are narrowed too where sorting them whole would take several scans.
    sizes = {s.interval: s.size for s in searches}
    if sum(sizes.values()) > _FINISH_CELLS:
        finish_rows = min(finish_rows, _FINISH_CELLS // len(sizes))
    while wide := [s for s in searches if s.value is None and s.size > finish_rows]:
        _sketch(df, wide)
        _prove(df, wide)
    if short := [s for s in searches if s.value is None]:
        _finish(df, short)


def exact_quantiles(
    df: DataFrame,
    values: dict[str, Column],
    probs: Sequence[float],
    counts: dict[str, int] | None = None,
    finish_rows: int = FINISH_ROWS,
) -> dict[str, list[float | None]]:
    """Exact quantiles of several numeric expressions over their non-null values.

    ``counts`` may pass the number of non-null values per expression.
    """
    if not values:
        return {}
    keys = {name: f"q{i}" for i, name in enumerate(values)}
    narrow = df.select(*[values[name].cast("double").alias(key) for name, key in keys.items()])
    if counts is None:
        counts = dict(zip(keys, _first_row(narrow, [F.count(c(k)) for k in keys.values()])))
    places = {(n, p): (counts[n] - 1) * p for n in keys for p in probs if counts[n]}
    searches = {
        (n, rank): _Search(keys[n], rank, counts[n])
        for (n, _), place in places.items()
        for rank in (math.floor(place), math.ceil(place))
    }
    _solve(narrow, list(searches.values()), finish_rows)

    def at(name: str, p: float) -> float | None:
        if not counts[name]:
            return None
        place = places[name, p]
        low = searches[name, math.floor(place)].value
        high = searches[name, math.ceil(place)].value
        return low if low == high else low + (high - low) * (place - math.floor(place))

    return {name: [at(name, p) for p in probs] for name in keys}


def outlier_bounds(df: DataFrame, value: Column, count: int | None = None) -> tuple[float, float] | None:
    """Quartiles widened by one and a half interquartile ranges; None without values."""
    counts = None if count is None else {"x": count}
    q1, q3 = exact_quantiles(df, {"x": value}, [0.25, 0.75], counts)["x"]
    if q1 is None:
        return None
    reach = 1.5 * (q3 - q1)
    return q1 - reach, q3 + reach
