"""Numbers and running sums in a global order, by a range shuffle: no window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipeline.operators.kept import kept


def sums_before(df: DataFrame, order: list[str], descending: bool = False, **sums: str) -> DataFrame:
    """Adds, for each name=column of ``sums``, the column's sum over the rows before, by ``order``.

    Rows are range-shuffled and kept in the shared folder, as the ranges must not change between the two passes over them: one adds up each range,
    a row a range, and one counts within it.
    """
    by = [F.desc(c) if descending else F.asc(c) for c in order]
    dealt = kept(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = dealt.groupBy("_part").agg(*(F.sum(c).alias(f"_{name}") for name, c in sums.items()))
    firsts = totals.select("_part", *(F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_{name}") for name in sums))
    inside = Window.partitionBy("_part").orderBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumns({f"_in_{name}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    joined = local.join(F.broadcast(firsts), "_part")
    return joined.withColumns({name: F.col(f"_{name}") + F.col(f"_in_{name}") for name in sums}).drop("_part", *(f"_{n}" for n in sums), *(f"_in_{n}" for n in sums))


def dense_row_id(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """Numbers from 0 in the order of ``order``."""
    return sums_before(df.withColumn("_one", F.lit(1)), order, **{name: "_one"}).drop("_one")
