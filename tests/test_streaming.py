"""Corpus lines from streams, against the batch operator and by hand."""

import os

import pytest
from pyspark.sql import functions as F

from swipeline.operators import tokens as tk
from swipeline.operators.steps import FixedInt, TimeDelta
from swipeline.plans import queries
from swipeline.sources import fixtures
from swipeline.streaming.corpus import stream_corpus

SF = "/root/testdata/sf0.001"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def rocks(spark):
    spark.conf.set(PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.unset(PROVIDER)


def write(df, folder, number):
    """One file of the folder, the ``number``-th to be read."""
    df.coalesce(1).write.parquet(str(folder / f"d{number}"))
    for f in (folder / f"d{number}").glob("*.parquet"):
        os.utime(f, (1_000_000 + number, 1_000_000 + number))


def run(spark, folder, schema, pipeline, out, **options):
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "d*"))
    lines = stream_corpus(source, pipeline, **options)
    query = lines.writeStream.format("parquet").option("path", str(out / "lines")).option("checkpointLocation", str(out / "state")).trigger(availableNow=True).start()
    assert query.awaitTermination(300)
    return {(r.user, r.card, r.chunk_id): (r.n_txn, r.late, r.text) for r in spark.read.parquet(str(out / "lines")).collect()}


def test_ten_batches_and_a_restart_give_the_batch_lines(rocks, tmp_path):
    raw = fixtures.txn(rocks, SF)
    pipeline = tk.TokenPipeline(tk.default_steps(time_bins=32)).fit()
    want = {(r.user, r.card, r.chunk_id): (r.n_txn, 0, r.text) for r in pipeline.corpus(tk.preprocess(raw), 2).collect()}
    typed = tk.preprocess(raw, gaps=False)
    assert "time_delta_s" not in typed.columns and max(k[2] for k in want) >= 3
    times = [r.t for r in typed.select(F.unix_seconds(F.col("time_full").cast("timestamp")).alias("t")).collect()]
    cuts = [sorted(times)[len(times) * k // 10] for k in range(10)] + [max(times) + 1]
    rows = typed.withColumn("_at", F.unix_seconds(F.col("time_full").cast("timestamp")))
    part = lambda k: rows.filter((F.col("_at") >= cuts[k]) & (F.col("_at") < cuts[k + 1])).drop("_at")
    quiet = 2 * (cuts[-1] - cuts[0])
    for k in range(5):
        write(part(k), tmp_path / "in", k)
    first = run(rocks, tmp_path / "in", typed.schema, pipeline, tmp_path, chunk=2, quiet_s=quiet)
    assert first and first.items() <= want.items() and all(n == 2 for n, *_ in first.values())
    for k in range(5, 10):
        write(part(k), tmp_path / "in", k)
    later = typed.limit(1).withColumns({"user": F.lit(-1).cast("long"), "time_full": F.timestamp_seconds(F.lit(cuts[-1] + 2 * quiet)).cast("timestamp_ntz")})
    write(later.select(typed.columns), tmp_path / "in", 10)  # an account far ahead moves the watermark
    got = run(rocks, tmp_path / "in", typed.schema, pipeline, tmp_path, chunk=2, quiet_s=quiet)
    assert {k: v for k, v in got.items() if k[0] >= 0} == want


def test_late_rows_and_quiet_accounts(rocks, tmp_path):
    """A late row is in no line and is counted in the next; a quiet account's line leaves short, and its next row begins the next chunk."""
    schema = "user long, card int, row_id long, n int, time_full timestamp"
    steps = [FixedInt("n", "n", "N", 0, 99), TimeDelta("gap", "gap", "T", 32)]
    pipeline = tk.TokenPipeline(steps).fit()
    batches = [
        [(1, 0, 0, 10, 100), (1, 0, 1, 11, 160), (2, 0, 2, 20, 100)],
        [(1, 0, 3, 12, 130), (1, 0, 4, 13, 200), (1, 0, 5, 14, 200)],
        [(2, 0, 6, 21, 9000)],
        [(1, 0, 7, 15, 9000), (2, 0, 8, 22, 9010), (2, 0, 9, 23, 9020)],
        [(3, 0, 10, 30, 90000)],
    ]
    for k, rows in enumerate(batches):
        write(rocks.createDataFrame(rows, "user long, card int, row_id long, n int, t long").selectExpr("user", "card", "row_id", "n", "timestamp_seconds(t) AS time_full"), tmp_path / "in", k)
    got = run(rocks, tmp_path / "in", schema, pipeline, tmp_path, chunk=3, delay="100 seconds", quiet_s=600)
    tokens = {k: v[0] for k, v in got.items()}
    assert tokens == {(1, 0, 0): 3, (1, 0, 1): 1, (1, 0, 2): 1, (2, 0, 0): 1, (2, 0, 1): 3}
    gap = lambda s: rocks.range(1).select(steps[1].token_of(F.lit(s))).first()[0]
    assert got[(1, 0, 0)] == (3, 1, f"<bos> N_10 {gap(0)} <sep> N_11 {gap(60)} <sep> N_13 {gap(40)} <eos>")
    assert got[(1, 0, 1)] == (1, 0, f"<bos> N_14 {gap(0)} <eos>")
    assert got[(1, 0, 2)] == (1, 0, f"<bos> N_15 {gap(8800)} <eos>")
    assert got[(2, 0, 1)][2] == f"<bos> N_21 {gap(8900)} <sep> N_22 {gap(10)} <sep> N_23 {gap(10)} <eos>"


def test_missing_columns_are_named(rocks):
    with pytest.raises(ValueError, match="time_full"):
        stream_corpus(rocks.range(3).withColumns({"user": F.lit(1), "card": F.lit(1), "row_id": F.lit(1)}), queries.fitted())
