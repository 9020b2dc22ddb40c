"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.llm.common import cut, join_classes, lower_ascii, quoted


def digit(text: Column, at: int, width: int) -> Column:
    return lower_ascii(F.substring(text, at + 1, width))


def grouped(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Groups of two or more ``rows`` (row, doc_id and ``keys``): their size, the row that stays, and a number. Combined before the shuffle."""
    best = F.max(F.struct("doc_id", "row")).alias("best")
    return cut(rows.groupBy(*keys).agg(F.count("*").alias("n"), best, F.min("row").alias("number")).filter("n > 1"))


def exact_dedup(docs: DataFrame, *columns, first: int = 64, growth: int = 4) -> DataFrame:
    """``columns`` of every row (all by default) with keep_id, group_size and kept, which replace columns of these names.

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty. Of equal texts the
    row with the largest doc_id stays (a null doc_id is below all). Of repeated rows, with the same doc_id and equal texts,
    each counts in group_size and one stays. Texts may be of any length; other columns may have any names; an empty table gives no rows.

    Rows start as one group. A round splits every group by its texts' next characters (their UTF-8 bytes, A-Z lower-cased): ``first``
    of them, then ``growth`` times as many each time, so the longest text sets the rounds by its logarithm. Groups of one leave; a group whose
    texts end within the digit is a class of equal texts, known without a digest of any text.

    The table is read twice: for the first digit's groups, and to number all rows and set aside the texts of those that are in a group. Later
    rounds go on with these rows alone and shuffle a row's number and digit, never whole texts. Groups are counted with
    map-side combination; the few that hold much of the data are joined back by broadcast, see ``join_classes``.
    """
    columns = columns or tuple(map(quoted, docs.columns))
    text, names = F.coalesce("text", F.lit("")), [f"_{k}" for k in range(len(docs.select(*columns).columns))]
    heads = docs.select(F.lit(0).alias("row"), "doc_id", digit(text, 0, first).alias("digit"))
    groups = grouped(heads, ["digit"])
    chosen = docs.select(*columns, F.col("doc_id"), text.alias("text")).toDF(*names, "doc_id", "text")
    chosen = chosen.withColumn("digit", digit(F.col("text"), 0, first))
    # Rows of the few digits that hold much of the data are known by broadcast and dealt evenly, under a key longer than any digit.
    common = groups.filter(F.col("n") > (groups.agg(F.sum("n")).first()[0] or 0) / 100).select("digit", F.lit(True).alias("common"))
    chosen = chosen.join(F.broadcast(common), "digit", "left")
    own = F.lpad(F.monotonically_increasing_id().cast("string"), first + 1, "#")
    chosen = chosen.withColumn("key", F.when(F.col("common"), own).otherwise(F.col("digit"))).drop("digit")
    placed = chosen.join(groups.select(F.col("digit").alias("key"), F.lit(True).alias("shared")), "key", "left")
    shared = F.coalesce("common", "shared", F.lit(False))
    base = cut(placed.select(*names, F.monotonically_increasing_id().alias("row"), "doc_id", F.when(shared, F.col("text")).alias("text")))
    rows, keys, at, width, done = base.filter("text IS NOT NULL").select("row", "doc_id", digit(F.col("text"), 0, first).alias("digit")), ["digit"], 0, first, []
    while True:
        rows = cut(rows)
        groups = grouped(rows, keys)
        found = cut(join_classes(rows, groups, keys, "n").select("row", "doc_id", "number", "best", "n", (F.char_length("digit") < width).alias("ended")))
        done.append(found.filter("ended").select("row", "best", "n"))
        live = found.filter("NOT ended").select("row", F.col("number").alias("part"))
        if live.isEmpty():
            break
        at, width = at + width, width * growth
        texts = base.filter("text IS NOT NULL").select("row", "doc_id", digit(F.col("text"), at, width).alias("digit"))
        rows, keys = texts.join(live, "row"), ["part", "digit"]
    classes = done[0]
    for more in done[1:]:
        classes = classes.unionByName(more)
    marked = base.drop("text").join(classes, "row", "left")
    marked = marked.select(
        *names,
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("best.row"), F.lit(True)).alias("kept"),
    )
    given = docs.select(*columns).columns
    out = [F.col(n).alias(c) for n, c in zip(names, given, strict=True) if c not in ("keep_id", "group_size", "kept")]
    return marked.select(*out, "keep_id", "group_size", "kept")
