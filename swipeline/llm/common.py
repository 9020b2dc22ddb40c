"""What several operators share: shared-folder checkpoints, row identity, words, prefix sums and components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word is a maximal run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session without it gets a folder of its own."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc._conf.get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="swipeline-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Removes what is at ``path``, by the file system that it names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is; ASCII texts take the fast way."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def quoted(name: str) -> Column:
    """The column of exactly that name, dots and back-quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells apart rows that share a doc_id; it is never used to compare the texts of two documents."""
    return F.xxhash64(F.col(text), F.col(doc_id))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def prefix_sums(df: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``group`` that come before, by ``order``.

    One range shuffle by (group, order) deals a large group out over many tasks. Each task adds up its own
    part of each group; the totals of the parts (a row for each task and group in it) give the offsets.
    Nulls in ``group`` form a group of their own.
    """
    keys = [group, *order]
    dealt = cut(df.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        dealt.groupBy("_part", group)
        .agg(F.sum(value).alias("_total"))
        .select(F.col("_part").alias("_p"), F.col(group).alias("_g"), F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    )
    here = Window.partitionBy("_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("_here", F.coalesce(F.sum(value).over(here), F.lit(0)))
    return (
        local.join(offsets, (F.col("_part") == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g")))
        .withColumn(out, F.col("_here") + F.col("_offset"))
        .drop("_part", "_p", "_g", "_offset", "_here")
    )


def join_classes(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, parts: int = 100, total: int | None = None) -> DataFrame:
    """``rows`` with what ``classes`` says of their ``keys``; rows without a class are left out, keys are never null.

    ``classes`` has each key once and, in ``size``, how many of the rows have it. Those with more than a ``parts``-th of all rows
    are fewer than ``parts``, so they are broadcast and their rows stay where they are; the others are joined by shuffle, where no
    key holds more than that share. Both tables are read twice: give them cut or cheap. ``total`` is the number of rows, if it is known.
    """
    least = (classes.agg(F.sum(size)).first()[0] or 0 if total is None else total) / parts
    hot = F.broadcast(classes.filter(F.col(size) > least))
    rest = rows.join(hot.select(*keys), keys, "left_anti").join(classes.filter(F.col(size) <= least), keys)
    return rows.join(hot, keys).unionByName(rest)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that can be reached, for every node with an edge to another.

    Alternating stars: each node hooks its larger neighbours, then all its neighbours, to the smallest one, until the
    edges are stars and a round changes nothing, however many rounds that takes. Minima are combined before the shuffle, and
    the nodes with more than a hundredth of all edges, fewer than 200, get theirs by broadcast, so a node with very many edges is no single task's work; nothing is collected but a count and a checksum. Edges with a null end are ignored.
    """

    def tidy(df: DataFrame) -> DataFrame:
        return cut(df.filter("u <> v").distinct())

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = tidy(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()))
    seen = state(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count_if(F.col("v") > F.col("u")).alias("n")))
        large = cut(join_classes(both.filter("v > u"), low, ["u"], "n", total=seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
        small = join_classes(large, low, ["u"], "n", total=seen[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = tidy(small.unionByName(low.select("u", F.col("m").alias("v"))))
        if (new := state(now)) == seen:
            break
        seen = new
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
