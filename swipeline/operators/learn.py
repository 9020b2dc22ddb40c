"""What learned steps take from a table, for all of them together: two scans at most, however many steps there are."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.operators.kept import kept
from swipeline.operators.ranges import sums_before

#: The shares whose approximate quantiles bracket the wanted ranks, and the accuracy of the sketch: ranks are off by a 1 / ACCURACY-th of the rows at most.
GRID = [k / 500 for k in range(1, 500)]
ACCURACY = 10_000


def number(column: str) -> Column:
    """The column's numbers; NaN is no number."""
    x = F.col(column).cast("double")
    return F.when(~F.isnan(x), x)


def brackets(wanted: list[int], n: int, grid: list[float]) -> list[tuple[float, float]]:
    """Disjoint closed intervals that hold the values of the ``wanted`` ranks (from 0) of ``n`` rows, from a sketch's quantiles at GRID."""
    slack, found = 3 * n / ACCURACY + 2, []
    for rank in wanted:
        low = [x for s, x in zip(GRID, grid, strict=True) if s * n <= rank - slack]
        high = [x for s, x in zip(GRID, grid, strict=True) if s * n >= rank + slack]
        a, z = max(low, default=-math.inf), min(high, default=math.inf)
        if found and a <= found[-1][1]:
            found[-1] = (found[-1][0], max(z, found[-1][1]))
        else:
            found.append((a, z))
    return found


def place(x: Column, intervals: list[tuple[float, float]]) -> Column:
    """2k + 1 inside the k-th interval, 2k below it."""
    steps = [(x >= F.lit(a)).cast("int") + (x > F.lit(z)).cast("int") for a, z in intervals]
    return reduce(lambda p, q: p + q, steps, F.lit(0))


def spans(df: DataFrame, columns: list[str]) -> list[tuple]:
    """(rows, least, most, quantiles at GRID) of the numbers in each column, in one aggregate of mergeable sketches."""
    if not columns:
        return []
    row = df.agg(*(f.alias(f"{name}{k}") for k, c in enumerate(columns) for name, f in (("n", F.count(number(c))), ("a", F.min(number(c))), ("z", F.max(number(c))), ("q", F.percentile_approx(number(c), GRID, ACCURACY))))).first()
    return [(row[f"n{k}"], row[f"a{k}"], row[f"z{k}"], row[f"q{k}"]) for k in range(len(columns))]


def values_and_ranks(df: DataFrame, texts: list[str], most: list[int], wanted: dict[str, tuple[list[int], list[tuple[float, float]]]]) -> tuple[list[list[str]], dict[str, dict[int, float]]]:
    """(the sorted distinct values of each column of ``texts``, the values at the wanted ranks of each column of ``wanted``), in one scan.

    ``wanted`` has ranks and the intervals that hold their values. Tasks count equal values, and of numbers only those inside an interval; all others are counted by
    where they lie. The values inside are numbered by a range shuffle. More than ``most`` values of a text column raise a ValueError.
    """
    cells = [F.struct(F.lit(k).alias("step"), F.col(c).cast("string").alias("key"), F.lit(0).alias("place"), F.lit(None).cast("double").alias("x")) for k, c in enumerate(texts)]
    for k, (c, (_, intervals)) in enumerate(wanted.items(), len(texts)):
        x, at = number(c), place(number(c), intervals)
        cells.append(F.struct(F.lit(k).alias("step"), F.when(x.isNotNull(), F.lit("")).alias("key"), at.alias("place"), F.when(at % 2 == 1, x).alias("x")))
    counted = kept(df.select(F.inline(F.array(*cells))).filter("key IS NOT NULL").groupBy("step", "key", "place", "x").agg(F.count("*").alias("n")))
    sizes = {r["step"]: r["count"] for r in counted.filter(F.col("step") < len(texts)).groupBy("step").count().collect()}
    for k, c in enumerate(texts):
        if sizes.get(k, 0) > most[k]:
            raise ValueError(f"{c} has more than {most[k]} values; use hash buckets")
    values: list[list[str]] = [[] for _ in texts]
    for r in counted.filter(F.col("step") < len(texts)).select("step", "key").collect() if texts else []:
        values[r["step"]].append(r["key"])
    found: dict[str, dict[int, float]] = {c: {} for c in wanted}
    if wanted:
        totals = counted.filter(F.col("step") >= len(texts)).groupBy("step", "place").agg(F.sum("n").alias("n")).orderBy("step", "place").collect()
        inside, at = 0, {}  # the wanted ranks by the number of values inside any interval that come before
        for k, (c, (ranks, _)) in enumerate(wanted.items(), len(texts)):
            below = 0
            for r in (r for r in totals if r["step"] == k):
                if r["place"] % 2:
                    at |= {inside + rank - below: (c, rank) for rank in ranks if below <= rank < below + r["n"]}
                    inside += r["n"]
                below += r["n"]
        ordered = sums_before(counted.filter("x IS NOT NULL"), ["step", "x"], before="n")
        hit = reduce(lambda p, q: p | q, ((F.col("before") <= g) & (F.col("before") + F.col("n") > g) for g in at), F.lit(False))
        rows = ordered.filter(hit).select("x", "before", "n").collect() if at else []
        for g, (c, rank) in at.items():
            found[c][rank] = next(r["x"] for r in rows if r["before"] <= g < r["before"] + r["n"])
    return [sorted(v) for v in values], found
