"""Accounts of any length: rows are placed by the account's days, not by a window over the account."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from swipeline.operators import tokens as tk
from swipeline.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture
def partitions_kept(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_an_account_is_dealt_to_many_tasks(spark, partitions_kept):
    lines = queries.QUERIES["corpus_lines_long"](spark, SF).withColumn("task", F.spark_partition_id())
    spread = lines.groupBy("user", "card").agg(F.count("*").alias("lines"), F.count_distinct("task").alias("tasks")).collect()
    assert len(spread) == 3 and any(r.tasks > 1 for r in spread)
    start = dt.datetime(2024, 1, 1)
    one = spark.createDataFrame([(7, 1, k, start + dt.timedelta(hours=k)) for k in range(2000)], "user long, card int, row_id long, time_full timestamp_ntz")
    tasks = tk.placed_by_day(one).groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n")).collect()
    assert len(tasks) == 4 and max(r.n for r in tasks) < 1000


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("zone", ["UTC", "America/St_Johns"])
def test_places_are_those_of_the_window(spark, kind, zone):
    """Rows of one minute, times, users and cards that are null, and a night in which clocks went back from 00:01 to 23:01."""
    draw, start = random.Random(3), dt.datetime(2006, 10, 28)
    rows = [(draw.choice([None, 1, 2]), draw.choice([None, 0, 1]), k, str(start + dt.timedelta(minutes=draw.randrange(3000))) if k % 11 else None) for k in range(900)]
    # From 02:29 UTC on 2006-10-29, half an hour by the second on both sides of the change.
    rows += [(9, 9, 1000 + k, str(dt.datetime(2006, 10, 29, 2, 29) + dt.timedelta(seconds=k))) for k in range(1800)]
    strings = spark.createDataFrame(rows, "user long, card int, row_id long, t string")
    df = strings.withColumn("time_full", F.col("t").cast("timestamp_ntz") if kind == "timestamp_ntz" else F.concat("t", F.lit(" UTC")).cast("timestamp")).drop("t")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = {r.row_id: r.pos for r in tk.placed_by_day(df).collect()}
        want = {r.row_id: r.pos for r in df.withColumn("pos", F.row_number().over(tk.account_order()) - 1).collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("chunk", [1, 4, 315])
def test_lines_are_those_of_the_window(spark, chunk):
    pipeline = queries.fitted()
    plain, dealt = (sorted(map(tuple, pipeline.corpus(queries.typed(spark, SF), chunk, long_accounts=x).collect())) for x in (False, True))
    assert plain == dealt
    assert pipeline.corpus(queries.typed(spark, SF).limit(0), chunk, long_accounts=True).collect() == []


@pytest.mark.parametrize("name", ["corpus_lines", "corpus_lines_full", "corpus_count", "corpus_stats", "corpus_bucketed", "embed_seq", "seq_position", "chunk_id"])
def test_queries_see_long_accounts(spark, monkeypatch, name):
    """With a long account no query places rows by a window over it, and its result is the same."""
    plain = sorted(str(tuple(r)) for r in queries.QUERIES[name](spark, SF).collect())
    used, by_day = [], tk.placed_by_day
    monkeypatch.setattr(tk, "MOST_ROWS", 0)
    monkeypatch.setattr(tk, "placed_by_day", lambda df: used.append(1) or by_day(df))
    df = queries.QUERIES[name](spark, SF)
    assert used and sorted(str(tuple(r)) for r in df.collect()) == plain
