"""Exact quantiles by rank selection, spread over tasks.

One mergeable sketch per column brackets each wanted rank. A count of what is
below and within a bracket shows whether it holds the rank, and brackets that
hold many rows are sketched again. Only the values inside are then read once
more and counted by value, so no task holds a column, however long it is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shape import quoted

#: Centroids of a sketch: brackets are so many times narrower than what is sketched.
ACCURACY = 5_000
#: Rows that a bracket holds at most before its values are gathered; ties count once there.
GATHER = 100_000
ROUNDS = 8


@dataclass
class _Bracket:
    """The ranks ``first`` to ``last`` (from 0) of a column lie among its values from ``low`` to ``high``; ``below`` values are less than ``low``."""

    column: str
    first: int
    last: int
    low: float | None
    high: float | None
    below: int
    size: int

    def holds(self) -> Column:
        v, ok = quoted(self.column).cast("double"), F.lit(True)
        if self.low is not None:
            ok = v >= F.lit(self.low)
        return ok if self.high is None else ok & (v <= F.lit(self.high))

    def known(self) -> bool:
        """Whether one value is left; NaN equals itself here."""
        a, b = self.low, self.high
        return a is not None and b is not None and (a == b or (math.isnan(a) and math.isnan(b)))


def _sketched(b: _Bracket) -> Column:
    """Values on both sides of the ranks, from a sketch of the bracket."""
    slack = 2.0 / ACCURACY
    share = lambda r, by: min(1.0, max(0.0, (r - b.below) / max(1, b.size - 1) + by))
    v = F.when(b.holds(), quoted(b.column).cast("double"))
    return F.percentile_approx(v, F.array(F.lit(share(b.first, -slack)), F.lit(share(b.last, slack))), ACCURACY)


def _narrowed(df: DataFrame, todo: list[_Bracket]) -> bool:
    """Narrows brackets by a sketch, checked by counting. False if none became narrower."""
    guesses = df.agg(*[_sketched(b).alias(f"s{i}") for i, b in enumerate(todo)]).first()
    aggs = []
    for i, (b, g) in enumerate(zip(todo, guesses, strict=True)):
        v, (low, high) = quoted(b.column).cast("double"), g
        aggs += [F.count_if(v < F.lit(low)).alias(f"b{i}"), F.count_if(v <= F.lit(high)).alias(f"t{i}")]
    counts = df.agg(*aggs).first()
    moved = False
    for i, (b, (low, high)) in enumerate(zip(todo, guesses, strict=True)):
        below, to, end = counts[2 * i], counts[2 * i + 1], b.below + b.size
        size = b.size
        if below <= b.first:
            b.low, b.below = low, below
        if b.last < to:
            b.high, end = high, to
        b.size = end - b.below
        moved |= b.size < size
    return moved


def _gathered(df: DataFrame, todo: list[_Bracket]) -> dict[tuple[int, int], float]:
    """(bracket, rank) -> value: the values inside brackets, counted with a partial step and summed up in order; a bracket's values are one task's."""
    cells = F.array(*[F.when(b.holds(), F.struct(F.lit(i).alias("i"), quoted(b.column).cast("double").alias("v"))) for i, b in enumerate(todo)])
    counted = df.select(F.explode(F.array_compact(cells)).alias("x")).where("x.v is not null").groupBy("x.i", "x.v").count()
    upto = F.sum("count").over(Window.partitionBy("i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    ranks = F.array(*[F.array(F.lit(b.first - b.below), F.lit(b.last - b.below)) for b in todo])
    at = counted.withColumn("upto", upto).withColumn("rank", F.explode(F.array_distinct(ranks[F.col("i")])))
    hit = at.where((F.col("rank") < F.col("upto")) & (F.col("rank") >= F.col("upto") - F.col("count")))
    return {(r["i"], r["rank"] + todo[r["i"]].below): r["v"] for r in hit.select("i", "rank", "v").collect()}  # two rows a bracket


def quantiles(df: DataFrame, columns: list[str], at: tuple[float, ...] = (0.25, 0.5, 0.75)) -> dict[str, tuple[float | None, ...]]:
    """Per column its quantiles with linear interpolation, as ``percentile`` gives them; None for a column without values.

    Nulls are left out, NaN is the greatest value. A table of up to ``GATHER``
    rows takes two jobs, a longer one four or more, each over all columns and
    quantiles at once.
    """
    if not columns:
        return {}
    sizes = dict(zip(columns, df.agg(*[F.count(quoted(c).cast("double")).alias(f"n{i}") for i, c in enumerate(columns)]).first(), strict=True))
    found: dict[tuple[str, float], _Bracket] = {}
    for c, n in sizes.items():
        for p in at if n else ():
            position = (n - 1) * p
            found[c, p] = _Bracket(c, math.floor(position), math.ceil(position), None, None, 0, n)
    for _ in range(ROUNDS):
        wide = [b for b in found.values() if b.size > GATHER and not b.known()]
        if not wide or not _narrowed(df, wide):
            break
    todo = [b for b in found.values() if not b.known()]
    values = _gathered(df, todo) if todo else {}
    place = {id(b): i for i, b in enumerate(todo)}

    def value(b: _Bracket, rank: int) -> float:
        return b.low if b.known() else values[place[id(b)], rank]

    def one(c: str, p: float) -> float | None:
        if (c, p) not in found:
            return None
        b, position = found[c, p], (sizes[c] - 1) * p
        low, high = value(b, b.first), value(b, b.last)
        return low if b.first == b.last or low == high else (b.last - position) * low + (position - b.first) * high

    return {c: tuple(one(c, p) for p in at) for c in columns}
