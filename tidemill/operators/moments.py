"""Per-column moments, and correlations of column pairs from exact sums."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations_with_replacement

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.columns import c
from tidemill.functions.numbers import finite_or_null

#: Columns of one Gram matrix: a task holds up to 4.5 times their square of numbers.
_BLOCK = 1_000
#: Share of the raw second moment below which a variance may be rounding noise.
_NOISE = 1e-9


@dataclass(frozen=True)
class Moments:
    count: int
    mean: float | None
    std: float | None  # sample deviation
    low: float | None
    high: float | None


def moments(df: DataFrame, values: dict[str, Column]) -> dict[str, Moments]:
    """Count, mean, deviation and range of numeric expressions in one pass."""
    return _counted_moments(df, values)[1] if values else {}


def _counted_moments(df: DataFrame, values: dict[str, Column]) -> tuple[int, dict[str, Moments]]:
    """The number of rows too."""
    narrow = df.select(*[v.cast("double").alias(f"x{i}") for i, v in enumerate(values.values())])
    aggs = []
    for i in range(len(values)):
        x = c(f"x{i}")
        parts = (F.count(x), F.avg(x), F.stddev_samp(x), F.min(x), F.max(x))
        aggs += [p.alias(f"a{i}_{j}") for j, p in enumerate(parts)]
    row = narrow.agg(*aggs, F.count(F.lit(1)).alias("rows")).first()
    return row["rows"], {n: Moments(*row[5 * i : 5 * i + 5]) for i, n in enumerate(values)}


def _finite(m: Moments) -> bool:
    return not m.count or (math.isfinite(m.low) and math.isfinite(m.high))


def _welford(x: Column, y: Column) -> Column:
    """Correlation from running moments, in which a constant has exactly no variance."""
    both = x.isNotNull() & y.isNotNull()
    spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
    return F.coalesce(finite_or_null(F.try_divide(F.covar_pop(x, y), spread)), F.lit(0.0))


@dataclass(frozen=True)
class _Sums:
    """The Gram matrix of rows ``[1, d..., p..., d²...]``: the last two only if there are gaps.

    ``d`` is a value less its column's mean, or 0 where it is missing; ``p`` says whether it is there.
    """

    matrix: list[list[float]]
    places: dict[str, int]
    gaps: dict[str, int]

    def pair(self, x: str, y: str) -> tuple[float, float, float, float, float, float]:
        """``n``, sums of x, y, x², y² and xy over the rows where both are there."""
        g, i, j = self.matrix, self.places[x], self.places[y]
        px, py = self._present(x), self._present(y)
        return g[px][py], g[i][py], g[j][px], self._square(x, y), self._square(y, x), g[i][j]

    def _present(self, x: str) -> int:
        return 1 + len(self.places) + self.gaps[x] if x in self.gaps else 0

    def _square(self, x: str, y: str) -> float:
        """The sum of x² where y is there."""
        if y not in self.gaps or x == y:
            return self.matrix[self.places[x]][self.places[x]]
        return self.matrix[self._present(x) + len(self.gaps)][self._present(y)]


def _gram(df: DataFrame, shifted: dict[str, Column], gaps: Sequence[str]) -> _Sums:
    """All sums of all pairs from one scan, added up by Spark's own linear algebra."""
    there = [F.col(f"d{i}").isNotNull().cast("double") for i, n in enumerate(shifted) if n in gaps]
    square = [F.col(f"d{i}") * F.col(f"d{i}") for i, n in enumerate(shifted) if n in gaps]
    narrow = df.select(*[v.alias(f"d{i}") for i, v in enumerate(shifted.values())])
    zero = F.lit(0.0)
    entries = [F.lit(1.0), *(F.col(f"d{i}") for i in range(len(shifted))), *there, *square]
    rows = narrow.select(array_to_vector(F.array(*[F.coalesce(e, zero) for e in entries])).alias("v"))
    matrix = RowMatrix(MLUtils.convertVectorColumnsFromML(rows, "v"), 0, len(entries)).computeGramianMatrix().toArray().tolist()
    return _Sums(matrix, {n: i + 1 for i, n in enumerate(shifted)}, {n: i for i, n in enumerate(n for n in shifted if n in gaps)})


def correlations(
    df: DataFrame, names: Sequence[str], known: dict[str, Moments] | None = None
) -> list[tuple[str, str, float]]:
    """Pearson correlation of every unordered pair, over rows where both are finite.

    A pair without variance, or without common rows, scores 0.  All sums of up to ``_BLOCK`` columns come from one scan, with
    or without gaps; more columns take a scan for each pair of blocks.  Pairs whose variance is close to rounding noise are
    settled by a second, slower aggregate.
    """
    names = list(names)
    value = {n: finite_or_null(c(n).cast("double")) for n in names}
    stats = {n: m for n, m in (known or {}).items() if n in value and _finite(m)}
    if missing := [n for n in names if n not in stats]:
        stats |= moments(df, {n: value[n] for n in missing})
    live = [n for n in names if stats[n].count and stats[n].low < stats[n].high]
    # Without a count of the rows, a column with the most values may still have gaps: one that has fewer surely does.
    most = max((stats[n].count for n in names), default=0)
    scored: dict[tuple[str, str], float] = {}
    doubtful: list[tuple[str, str]] = []
    blocks = _batches(live, _BLOCK // 2 if len(live) > _BLOCK else _BLOCK)
    for first, second in combinations_with_replacement(range(len(blocks)), 2):
        if first == second and len(blocks) > 1:
            continue  # met with another block
        wanted = list(dict.fromkeys([*blocks[first], *blocks[second]]))
        shifted = {n: value[n] - F.lit(stats[n].mean) for n in wanted}
        full = {n for n in wanted if stats[n].count == most}
        sums = _gram(df, shifted, wanted if len(full) < len(wanted) else ())
        if not sums.gaps and sums.matrix[0][0] > most:
            sums = _gram(df, shifted, wanted)
        for x, y in combinations_with_replacement(wanted, 2):
            if (x, y) in scored:
                continue
            n, sx, sy, sxx, syy, sxy = sums.pair(x, y)
            if n < 0.5:
                scored[x, y] = 0.0
                continue
            vx, vy = sxx - sx * sx / n, syy - sy * sy / n
            if not all(map(math.isfinite, (n, sxx, syy, sxy))) or not (vx > _NOISE * sxx and vy > _NOISE * syy):
                doubtful.append((x, y))
            elif x == y:
                scored[x, y] = 1.0
            else:
                scored[x, y] = max(-1.0, min(1.0, (sxy - sx * sy / n) / math.sqrt(vx) / math.sqrt(vy)))
    for part in _batches(list(dict.fromkeys(doubtful)), 20):
        row = df.agg(*[_welford(value[x], value[y]).alias(f"r{i}") for i, (x, y) in enumerate(part)]).first()
        scored.update({pair: max(-1.0, min(1.0, r)) for pair, r in zip(part, row)})
    return [(x, y, scored.get((x, y), scored.get((y, x), 0.0))) for x, y in combinations_with_replacement(names, 2)]


def _batches(items: list, size: int) -> list[list]:
    return [items[i : i + size] for i in range(0, len(items), size)]
