"""Mixing sources to target weights: hash-random keys, range-sorted prefix sums, cuts at exact budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from swipeline.llm.common import WORD, cut, prefix_sums, row_key, word_count


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """(source, source_size, target) from rows of (source, size).

    Sources by code point, null last, take ``weights`` in turn, repeating, and share ``share`` times all sizes by
    weight. No target exceeds ``most`` times its source's size; the excess is shared again by weight among the rest, until none
    is above. Then every target is the smaller of its limit and its weight times one level. With the sources by
    limit over weight, the level is the largest of (total less the limits before) over (the weights from here on),
    as that rises while sources are above their limits and falls after. The windows without a key run over
    one row of three numbers a source; the driver gets two rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(most) * F.col("source_size"))
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    per = cut(per.withColumns({"caps": F.coalesce(F.sum("cap").over(before), F.lit(0)), "weights": F.coalesce(F.sum("weight").over(before), F.lit(0))}))
    total, weight = per.agg(F.lit(share) * F.sum("source_size"), F.sum("weight")).first()
    level = per.agg(F.max((F.lit(total) - F.col("caps")) / (F.lit(weight) - F.col("weights")))).first()[0]
    return per.select("source", "source_size", F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken) of every row of ``docs``.

    Documents get hash-random keys (md5 of seed and doc_id) and are range-sorted by source and key; a source that
    holds much of the data lies in many ranges. With distributed prefix sums of sizes each source is taken whole
    as often as its budget (the target, rounded) allows, and the rest from its start, cut within the last
    document, so that a source's taken words are its budget exactly. Ties go by doc_id, then size, so reruns agree.
    Null texts and empty ones have size 0 and nothing taken; texts of any length are counted whole; a null source is a source; columns of ``docs`` other than
    ``carry`` play no part; an empty table gives no rows.
    """
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), *carry)
    sized = cut(sized.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string")))))
    goal = targets(sized, weights, share, most).select(F.col("source").alias("_source"), "source_size", "target")
    placed = prefix_sums(sized, "source", ["_key", "doc_id", "size"], "size", "_before")
    rows = placed.join(goal, F.col("source").eqNullSafe(F.col("_source"))).withColumn("_budget", F.round("target").cast("long"))
    epochs = F.expr("CASE WHEN source_size > 0 THEN _budget DIV source_size ELSE 0 END")
    part = F.least("size", F.greatest(F.lit(0), F.col("_budget") - epochs * F.col("source_size") - F.col("_before")))
    return rows.select("doc_id", "source", "size", "source_size", "target", *carry, (epochs * F.col("size") + part).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as rows with the columns of ``docs``: a document taken twice is there twice.

    A document cut at its source's budget gives its first words, joined by one space, with n_chars (if there) to match.
    Documents without words, null texts too, are not in it; a null doc_id or source is a value like others; other
    columns are carried. Of repeated rows, which are alike but for what their source's cut leaves of them, the first take
    whole copies and a later one the rest; a source has one such group at most. An empty table gives no rows.
    """
    given, names = docs.columns, [c if c in ("doc_id", "text", "source", "n_chars") else f"_c{k}" for k, c in enumerate(docs.columns)]
    docs = docs.toDF(*names)
    most, keyed = options.get("most", 2), docs.withColumn("_row", row_key())
    plan = cut(
        mix(keyed, carry=("_row",), **options)
        .groupBy(F.col("doc_id").alias("_id"), F.col("_row").alias("_key"), F.col("size").alias("_size"))
        .agg(F.min("taken").alias("_least"), F.max("taken").alias("_taken"), F.sum("taken").alias("_all"), F.count("*").alias("_rows"))
        .filter("_taken > 0")
    )

    def planned(which: str) -> DataFrame:
        return keyed.join(plan.filter(which), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_key")))

    whole = F.floor(F.col("_least") / F.col("_size")) * F.col("_size")
    turn = F.row_number().over(Window.partitionBy("_id", "_key").orderBy(*docs.drop("text").columns)) - 1
    uneven = planned("_least < _taken").withColumn("_taken", whole + F.least("_size", F.greatest(F.lit(0), F.col("_all") - F.col("_rows") * whole - turn * F.col("_size"))))
    rows = planned("_least = _taken").unionByName(uneven)
    copies = F.filter(F.array(*(F.least("_size", F.col("_taken") - k * F.col("_size")) for k in range(most))), lambda n: n > 0)
    rows = rows.withColumn("_n", F.explode(copies))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.lit(1), F.col("_n").cast("int")), " ")
    rows = rows.withColumn("text", F.when(F.col("_n") < F.col("_size"), part).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("_n") < F.col("_size"), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*names).toDF(*given)
