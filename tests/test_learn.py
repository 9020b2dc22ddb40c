"""Steps that learn: exact values and quantiles from two scans, however many steps there are."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipeline.operators import learn
from swipeline.operators.steps import LearnedBins, Mapping, fit_steps
from swipeline.operators.tokens import TokenPipeline, token_usage


def scans(spark, df, steps):
    """How many times a task of ``fit_steps`` has begun to read ``df``."""
    seen = spark.sparkContext.accumulator(0)

    def mark(batches):
        seen.add(1)
        yield from batches

    marked = df.coalesce(1).mapInArrow(mark, df.schema)
    fit_steps(marked, steps)
    return seen.value


def table(spark, n, seed=1):
    draw = random.Random(seed)
    rows = [(k, draw.gauss(0, 10) if k % 13 else None, float(draw.randint(0, 4)), math.nan if k % 7 == 0 else draw.random() ** 9 * 1e6, draw.choice("abcdef") if k % 5 else None, str(k % 37)) for k in range(n)]
    return spark.createDataFrame(rows, "row_id long, x double, few double, skew double, letter string, digit string").repartition(3)


@pytest.mark.parametrize("n", [1, 2, 3, 15, 400, 30000])
def test_exact_quantiles_between_brackets(spark, n):
    df = table(spark, n)
    steps = [LearnedBins("a", "x", "A", 10), LearnedBins("b", "few", "B", 7), LearnedBins("c", "skew", "C", 4), LearnedBins("d", "x", "D", 3), LearnedBins("e", "skew", "E", 5, "uniform"), Mapping("f", "letter", "F", learned=True), Mapping("g", "digit", "G", learned=True)]
    fit_steps(df, steps)
    rows = df.collect()
    for s in steps[:5]:
        x = [r[s.column] for r in rows if r[s.column] is not None and not math.isnan(r[s.column])]
        want = [] if not x else np.quantile(x, s.shares()) if s.strategy == "quantile" else min(x) + (max(x) - min(x)) * np.array(s.shares())
        assert s.edges == pytest.approx(list(want), rel=1e-12, abs=1e-12)
    assert [s.values for s in steps[5:]] == [sorted({r[c] for r in rows if r[c] is not None}) for c in ("letter", "digit")]


def test_few_values_are_inside_the_brackets(spark, monkeypatch):
    """With many rows the brackets leave most values out, and the quantiles stay exact."""
    df = spark.range(60_000).select(((F.col("id") * 7919) % 60_000).cast("double").alias("x"))
    inside = []
    real = learn.sums_before
    monkeypatch.setattr(learn, "sums_before", lambda rows, *a, **k: inside.append(rows.count()) or real(rows, *a, **k))
    step = LearnedBins("x", "x", "X", 4).fit(df)
    assert step.edges == pytest.approx([59_999 * p for p in (0.25, 0.5, 0.75)])
    assert 0 < inside[0] < 2_000


def test_scans_do_not_grow_with_the_steps(spark):
    df = table(spark, 300)
    maps = [Mapping(f"m{k}", c, f"M{k}", learned=True) for k, c in enumerate(("letter", "digit", "letter"))]
    bins = [LearnedBins(f"b{k}", c, f"B{k}", k + 2) for k, c in enumerate(("x", "few", "skew", "x"))]
    assert scans(spark, df, maps[:1]) == scans(spark, df, maps) == 1
    assert scans(spark, df, bins[:1]) == scans(spark, df, [*maps, *bins]) == 2
    assert scans(spark, df, [LearnedBins("u", "x", "U", 4, "uniform")]) == 1


def test_tables_without_values(spark):
    df = table(spark, 20).withColumns({"x": F.lit(None).cast("double"), "letter": F.lit(None).cast("string")})
    for d in (df, df.limit(0)):
        steps = [LearnedBins("a", "x", "A", 4), LearnedBins("u", "x", "U", 4, "uniform"), Mapping("f", "letter", "F", learned=True)]
        fit_steps(d, steps)
        assert steps[0].edges == steps[1].edges == [] and steps[2].values == []
    with pytest.raises(ValueError, match="more than 3 values"):
        Mapping("f", "letter", "F", learned=True, most=3).fit(table(spark, 100))
    with pytest.raises(ValueError, match="unknown strategy"):
        LearnedBins("a", "x", "A", 4, "log").fit(df)


def test_usage_of_a_learned_vocabulary(spark):
    df = table(spark, 200)
    pipeline = TokenPipeline([Mapping("letter", "letter", "L", learned=True), LearnedBins("x", "x", "X", 4)]).fit(df)
    used = {r.token: r.n for r in token_usage(df, pipeline).collect()}
    rows = [r for r in df.collect()]
    assert used["L_a"] == sum(r.letter == "a" for r in rows) and used["L_UNK"] == sum(r.letter is None for r in rows)
    assert sum(used[f"X_{k}"] for k in range(4)) == len(rows) and used["<pad>"] == 0
