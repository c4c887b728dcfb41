"""Exact order statistics by histogram passes: no sort, no exchange of rows.

Each pass counts the values of the intervals in which wanted places still lie, in buckets of
an interval each, and keeps the buckets that hold them. A bucket's least and greatest value
are the next interval, so it ends where they are equal, and a value held by any share of the
rows costs nothing more. The driver sees as many numbers as buckets of open intervals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.session import materialize

BUCKETS = 1024
#: So many values at most are fetched and sorted on the driver instead of another pass.
FETCHED = 20_000


@dataclass(frozen=True)
class Interval:
    """Values of one group from `low` to `high`, `n` of them, after `before` smaller ones."""

    group: tuple
    low: float
    high: float
    n: int
    before: int


def _logarithmic(low: float, high: float) -> bool:
    """Whether values of one sign spread over so many sizes that equal steps would not part them."""
    return low * high > 0 and max(high / low, low / high) > BUCKETS


def _intervals(rows: DataFrame, group: Sequence[str], parts: Sequence[Interval]) -> DataFrame:
    """A row per interval, with what `_bucket` reads: few rows, so they are sent to all tasks."""
    out = []
    for k, x in enumerate(parts):
        if _logarithmic(x.low, x.high):
            scale = (True, math.log(abs(x.low)), math.log(abs(x.high)) - math.log(abs(x.low)))
        else:  # halves, as the whole width may be infinite
            scale = (False, x.low / 2, x.high / 2 - x.low / 2)
        out.append((*x.group, k, x.low, x.high, *scale))
    kinds = dict(rows.dtypes)
    schema = [f"`_g{k}` {kinds[c]}" for k, c in enumerate(group)]
    schema += ["_part int", "_low double", "_high double", "_log boolean", "_first double", "_width double"]
    return F.broadcast(rows.sparkSession.createDataFrame(out, ", ".join(schema)))


def _bucket(value: Column) -> Column:
    """Never falls from a value to a greater one; the least value is in the first bucket, the greatest in the last."""
    place = (F.when(F.col("_log"), F.log(F.abs(value))).otherwise(value / 2) - F.col("_first")) / F.col("_width")
    inner = F.least(F.greatest(F.floor(place * BUCKETS), F.lit(0)), F.lit(BUCKETS - 1))
    return F.when(value <= F.col("_low"), 0).when(value >= F.col("_high"), BUCKETS - 1).otherwise(inner)


def select_places(
    rows: DataFrame, value: str, group: Sequence[str], sizes: dict[tuple, tuple[int, float, float]], places: dict[tuple, Sequence[int]]
) -> dict[tuple, dict[int, float]]:
    """The values at the 0-based `places` of each group's sorted values.

    `rows` is a stored table without null values; `sizes` has each group's count, least and greatest value.
    Groups and places are few; intervals of a group do not overlap, so each row meets one at most.
    """
    found: dict[tuple, dict[int, float]] = {g: {} for g in places}
    wanted = {(g, p): Interval(g, sizes[g][1], sizes[g][2], sizes[g][0], 0) for g, ps in places.items() for p in ps}
    while True:
        for (g, p), part in list(wanted.items()):
            if part.low == part.high:
                found[g][p] = part.low
                del wanted[g, p]
        if not wanted:
            return found
        parts = sorted(set(wanted.values()), key=repr)
        own = [F.col(c).eqNullSafe(F.col(f"_g{k}")) for k, c in enumerate(group)]
        inside = reduce(lambda a, b: a & b, own, F.col(value).between(F.col("_low"), F.col("_high")))
        open_rows = rows.join(_intervals(rows, group, parts), inside)
        if sum(x.n for x in parts) <= FETCHED:
            values: list[list[float]] = [[] for _ in parts]
            for r in open_rows.select("_part", F.col(value).alias("v")).collect():
                values[r["_part"]].append(r["v"])
            values = [sorted(v) for v in values]
            for (g, p), part in wanted.items():
                found[g][p] = values[parts.index(part)][p - part.before]
            return found
        counted = open_rows.groupBy(F.col("_part").alias("part"), _bucket(F.col(value)).alias("bucket"))
        counts = counted.agg(F.count("*").alias("n"), F.min(value).alias("low"), F.max(value).alias("high")).collect()
        by_part: dict[int, list] = {}
        for r in sorted(counts, key=lambda r: (r["part"], r["bucket"])):
            by_part.setdefault(r["part"], []).append(r)
        for (g, p), part in list(wanted.items()):
            before = part.before
            for r in by_part[parts.index(part)]:
                if p < before + r["n"]:
                    wanted[g, p] = Interval(g, r["low"], r["high"], r["n"], before)
                    break
                before += r["n"]


def quantiles(
    df: DataFrame,
    value: str,
    probabilities: dict[str, float],
    group: Sequence[str] = (),
    aggregates: dict[str, Column] | None = None,
) -> DataFrame:
    """Exact linear-interpolated quantiles of each of a few groups, one column per name; nulls are left out.

    Further `aggregates` of the value come from the pass that counts the groups. `df` is evaluated once.
    """
    rows = materialize(df.select(*group, F.col(value).alias(value)).where(F.col(value).isNotNull()), "values")
    named = {f"_a{k}": a for k, a in enumerate((aggregates or {}).values())}
    first = rows.groupBy(*group).agg(
        F.count("*").alias("_n"), F.min(value).alias("_low"), F.max(value).alias("_high"), *[a.alias(k) for k, a in named.items()]
    )
    stats = {tuple(r[c] for c in group): r for r in first.where("_n > 0").collect()}
    at = {g: {q: p * (r["_n"] - 1) for q, p in probabilities.items()} for g, r in stats.items()}
    places = {
        g: sorted({x for q in at[g].values() for x in (math.floor(q), min(math.floor(q) + 1, r["_n"] - 1))}) for g, r in stats.items()
    }
    found = select_places(rows, value, group, {g: (r["_n"], float(r["_low"]), float(r["_high"])) for g, r in stats.items()}, places)
    out = []
    for g, r in stats.items():
        row = [*g, *[r[k] for k in named]]
        for q in probabilities:
            low = math.floor(at[g][q])
            a, b = found[g][low], found[g][min(low + 1, r["_n"] - 1)]
            row.append(a + (b - a) * (at[g][q] - low) if a != b else a)
        out.append(tuple(row))
    kinds = dict(rows.dtypes) | dict(first.dtypes)
    schema = [*(f"`{c}` {kinds[c]}" for c in group)]
    schema += [f"`{name}` {kinds[k]}" for name, k in zip(aggregates or {}, named)] + [f"`{q}` double" for q in probabilities]
    return df.sparkSession.createDataFrame(out, ", ".join(schema))
