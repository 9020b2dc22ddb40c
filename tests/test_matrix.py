"""Matrix files: round trips, size errors, and failed tasks that leave nothing."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from swipeline.sources.matrix import MatrixSource, read_matrix, write_matrix

SF = "/root/testdata/sf0.001"


def vectors(spark):
    return spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("row_id"), "label", "embedding")


def pieces(path):
    return sorted(n for n in os.listdir(path) if n.endswith(".npy") and "ids" not in n and "labels" not in n)


def test_round_trip(spark, tmp_path):
    df, path = vectors(spark), str(tmp_path / "m")
    write_matrix(df, path, pieces=3)
    want = {r.row_id: (r.label, r.embedding) for r in df.collect()}
    back = read_matrix(spark, path, 64, len(want), 70)
    assert back.rdd.getNumPartitions() >= 7
    assert {r.row_id: (r.label, r.embedding) for r in back.collect()} == want
    whole = np.concatenate([np.load(os.path.join(path, n)) for n in pieces(path)])
    assert whole.dtype == np.float32 and whole.tolist() == [want[k][1] for k in sorted(want)]
    assert len(pieces(path)) == 3 and os.path.exists(f"{path}/_SUCCESS")
    assert back.select("label").filter("label = 1").count() == sum(v[0] == 1 for v in want.values())
    write_matrix(df.limit(10), path)
    assert read_matrix(spark, path).count() == len(want) + 10
    write_matrix(df.limit(10), path, "overwrite")
    assert read_matrix(spark, path, rows=10).count() == 10


def test_files_of_others(spark, tmp_path):
    """A plain file and a folder of such files, doubles too; row ids go on from file to file."""
    a, b = np.arange(12, dtype=np.float64).reshape(4, 3), np.arange(6, dtype=np.float32).reshape(2, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    got = read_matrix(spark, str(tmp_path), 3, 6, 3).orderBy("row_id").collect()
    assert [r.row_id for r in got] == list(range(6)) and [r.embedding for r in got] == [*a.tolist(), *b.tolist()] and got[0].label is None
    spark.dataSource.register(MatrixSource)
    assert spark.read.format("npy_matrix").load(str(tmp_path / "b.npy")).count() == 2


def test_sizes_must_hold(spark, tmp_path):
    np.save(tmp_path / "a.npy", np.zeros((4, 3), np.float32))
    for options in ({"dim": 4}, {"rows": 5}):
        with pytest.raises(Exception, match="not"):
            read_matrix(spark, str(tmp_path), **options).collect()
    np.save(tmp_path / "b.npy", np.zeros((4, 2), np.float32))
    with pytest.raises(Exception, match="2, 3"):
        read_matrix(spark, str(tmp_path)).collect()
    with pytest.raises(Exception, match="two dimensions"):
        np.save(tmp_path / "c.npy", np.zeros(4))
        read_matrix(spark, str(tmp_path / "c.npy")).collect()


@pytest.mark.parametrize("bad", ["IF(id = 77, NULL, array(1F, 2F))", "IF(id = 77, array(1F), array(1F, 2F))", "IF(id = 77, array(1F, CAST(NULL AS FLOAT)), array(1F, 2F))", "IF(id = 77, array(CAST(raise_error('broken') AS FLOAT)), array(1F, 2F))"])
def test_a_failed_task_leaves_no_piece(spark, tmp_path, bad):
    path = str(tmp_path / "m")
    good = spark.range(5).selectExpr("id AS row_id", "array(1F, 2F) AS embedding")
    write_matrix(good, path)
    before = sorted(os.listdir(path))
    with pytest.raises(Exception):
        spark.range(0, 100, 1, 4).selectExpr("id AS row_id", f"{bad} AS embedding").write.format("npy_matrix").mode("append").save(path)
    assert sorted(os.listdir(path)) == before
    assert read_matrix(spark, path, 2, 5).count() == 5


def test_empty_matrix(spark, tmp_path):
    path = str(tmp_path / "m")
    write_matrix(vectors(spark).limit(0), path)
    assert read_matrix(spark, path).count() == 0
    with pytest.raises(Exception, match="row_id, label and embedding"):
        vectors(spark).withColumn("x", F.lit(1)).write.format("npy_matrix").mode("append").save(path)
