"""Samples, features, metrics and the streaming variant."""

import os
import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipeline.operators import features as fe
from swipeline.operators import split as sp
from swipeline.operators.ranges import dense_row_id
from swipeline.operators import tokens as tk
from swipeline.streaming.sequences import stream_sequences


def test_average_precision_is_the_step_sum(spark):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.7, 1), (0.7, 0), (0.2, 0), (0.1, 1)], "score double, label int")
    assert fe.average_precision(df).first()[0] == pytest.approx((1 / 1 + 2 / 4 + 3 / 6) / 3)
    pairs = [(a, b) for a in (0.9, 0.7, 0.1) for b in (0.8, 0.7, 0.2)]
    assert fe.auroc(df).first()[0] == pytest.approx(sum((a > b) + (a == b) / 2 for a, b in pairs) / 9)


def test_samples(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 50 == 0).cast("int").alias("is_fraud"))
    for f, n, ones in ((sp.capped_class_sample, 100, 10), (sp.stratified_sample, 100, 2)):
        a, b = (sorted(r["row_id"] for r in f(d, n).collect()) for d in (df, df.repartition(7)))
        assert a == b and len(set(a)) == n and sum(k % 50 == 0 for k in a) == ones
    assert sp.stratified_sample(df, 5000).count() == 1000 and sp.uniform_sample(df, 30).count() == 30


def test_row_ids_alignment_and_pooling(spark):
    df = spark.createDataFrame([(x,) for x in (5, 3, 9, 1)], "x int")
    assert sorted((r["x"], r["row_id"]) for r in dense_row_id(df, ["x"]).collect()) == [(1, 0), (3, 1), (5, 2), (9, 3)]
    with pytest.raises(ValueError):
        fe.align(spark.createDataFrame([(1,)], "row_id int"), spark.createDataFrame([(2,)], "row_id int"))
    states = spark.createDataFrame([(1, [[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0])], "row_id int, states array<array<double>>, mask array<int>")
    assert fe.pool(states, "last").first()["embedding"] == [3.0, 4.0] and fe.pool(states, "mean").first()["embedding"] == [2.0, 3.0]
    with pytest.raises(ValueError):
        fe.pool(states, "max")


def test_alignment_refuses_ids_that_name_no_row(spark):
    rows = lambda *ids: spark.createDataFrame([(k,) for k in ids], "row_id int")
    for left, right in (((1, None), (1, None)), ((1, 1), (1, 1)), ((1, 2), (1, 1)), ((1, 2), (1, None))):
        with pytest.raises(ValueError):
            fe.align(rows(*left), rows(*right).withColumn("x", F.lit(1)))
    assert fe.align(rows(2, 1), rows(1, 2).withColumn("x", F.lit(1))).count() == 2


def test_null_labels_are_a_class_of_their_own(spark):
    df = spark.createDataFrame([(k, None if k % 4 == 0 else k % 2) for k in range(400)], "row_id long, is_fraud long")
    got = [r.is_fraud for r in sp.stratified_sample(df, 40).collect()]
    assert (got.count(None), got.count(0), got.count(1)) == (10, 10, 20)
    assert None not in [r.is_fraud for r in sp.capped_class_sample(df, 50).collect()]


def test_metrics_leave_out_rows_without_score_or_label(spark):
    rows = [(0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0), (None, 1), (0.95, None)]
    df = spark.createDataFrame(rows, "score double, label int")
    for f in (fe.auroc, fe.average_precision):
        assert f(df).first()[0] == f(df.dropna()).first()[0]
    assert fe.auroc(df.limit(0)).first()[0] is None and fe.average_precision(df.filter("label = 0")).first()[0] is None


def test_nothing_stays_in_memory(spark):
    fe.auroc(spark.range(50).selectExpr("id % 7 AS score", "id % 2 AS label")).collect()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


def test_encoding_and_lift(spark):
    train = spark.createDataFrame([("b",), ("a",), (None,)], "s string")
    got = fe.ordinal_encode(spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "s string"), train, ["s"])
    assert sorted(r["s"] for r in got.collect()) == [-1, -1, 0, 1]
    assert [r["best_ap"] for r in fe.lift([("x", 0.5, 0.1), ("y", 0.6, 0.2), ("z", 0.6, 0.2)])] == [False, True, False]


def test_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(k % 3, k % 2, k, start + dt.timedelta(seconds=37 * k * k % 9000)) for k in range(60)]
    df = spark.createDataFrame(rows, "user long, card int, row_id long, time_full timestamp")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = stream_sequences(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), 4)
    query = stream.writeStream.format("memory").queryName("seq").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    query.awaitTermination(120)
    got = {r["row_id"]: (r["time_delta_s"], r["seq_position"], r["chunk_id"]) for r in spark.table("seq").collect()}
    pos = F.row_number().over(tk.account_order()) - 1
    want = df.select("row_id", tk.time_delta().alias("d"), pos.alias("p"), F.floor(pos / 4).alias("c")).collect()
    assert got == {r["row_id"]: (r["d"], r["p"], r["c"]) for r in want}


def streamed(spark, tmp_path, batches, name, **options):
    """The rows that ``stream_sequences`` gives when each of ``batches`` of (user, card, row_id, seconds) is a micro-batch of its own."""
    schema = "user long, card int, row_id long, time_full timestamp"
    for k, rows in enumerate(batches):
        folder = tmp_path / name / f"d{k}"
        spark.createDataFrame(rows, "user long, card int, row_id long, t long").selectExpr("user", "card", "row_id", "timestamp_seconds(t) AS time_full").coalesce(1).write.parquet(str(folder))
        for f in folder.glob("*.parquet"):
            os.utime(f, (1_000_000 + k, 1_000_000 + k))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name / "d*"))
    query = stream_sequences(source, 2, **options).writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"{name}_c")).start()
    query.awaitTermination(120)
    return {r.row_id: (r.time_delta_s, r.seq_position, r.chunk_id, r.late) for r in spark.table(name).collect()}


def test_stream_over_batches(spark, tmp_path):
    """State goes on from batch to batch; a row that comes too late changes nothing."""
    batches = [[(1, 0, 0, 100), (2, 0, 1, 50)], [(1, 0, 2, 160), (1, 0, 3, 170)], [(1, 0, 4, 110), (1, 0, 5, 170), (2, 0, 6, 200)]]
    assert streamed(spark, tmp_path, batches, "kept") == {
        0: (0, 0, 0, False), 1: (0, 0, 0, False), 2: (60, 1, 0, False), 3: (10, 2, 1, False), 4: (None, None, None, True), 5: (0, 3, 1, False), 6: (150, 1, 0, False),
    }


def test_stream_expires(spark, tmp_path):
    """An account unseen for longer than expire_s behind the watermark starts again, one seen since goes on."""
    batches = [[(1, 0, 0, 1000), (2, 0, 1, 1000)], [(2, 0, 2, 5000)], [(2, 0, 3, 5010)], [(1, 0, 4, 5020), (2, 0, 5, 5020)]]
    got = streamed(spark, tmp_path, batches, "expired", delay="10 seconds", expire_s=600)
    assert got == {0: (0, 0, 0, False), 1: (0, 0, 0, False), 2: (4000, 1, 0, False), 3: (10, 2, 1, False), 4: (0, 0, 0, False), 5: (10, 3, 1, False)}


def test_pca_is_that_of_ml_in_two_passes(spark):
    """Coordinates up to the axes' signs and the explained share are Spark ML's; the rows are read twice for the fit."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    df = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").selectExpr("vec_id", "embedding").filter("embedding IS NOT NULL")
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got, share = fe.pca(df.mapInArrow(run, df.schema), 4)
    assert seen.value == 2 * df.count()
    x = df.withColumn("_x", array_to_vector(F.col("embedding").cast("array<double>")))
    x = StandardScaler(inputCol="_x", outputCol="_c", withMean=True, withStd=False).fit(x).transform(x)
    model = PCA(k=4, inputCol="_c", outputCol="_p").fit(x)
    want = np.array([r.p for r in model.transform(x).select("vec_id", vector_to_array("_p").alias("p")).orderBy("vec_id").collect()])
    own = np.array([r.pca for r in got.orderBy("vec_id").collect()])
    print("signs", np.sign((own * want).sum(axis=0)))
    assert np.allclose(own, want * np.sign((own * want).sum(axis=0)), atol=1e-8)
    assert share == pytest.approx(float(model.explainedVariance.toArray().sum()))
