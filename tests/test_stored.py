"""Tables stored by account, sketches stored by day, and murmur buckets."""

import datetime as dt
import random
import uuid

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from swipeline.functions.murmur import murmur32
from swipeline.operators import tokens as tk
from swipeline.operators.profiles import profile, sketch_days, store_days
from swipeline.operators.steps import HashBucket, from_state
from swipeline.plans import queries
from swipeline.sources import fixtures
from swipeline.sources.bucketed import by_account, store_by_account

SF = "/root/testdata/sf0.001"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_stored_accounts_are_not_shuffled(spark, tmp_path):
    raw, table = fixtures.txn(spark, SF), f"t_{uuid.uuid4().hex}"
    stored = store_by_account(tk.preprocess(raw, gaps=False), table, 4, str(tmp_path / "t"))
    typed, pipeline = tk.preprocess(raw), tk.TokenPipeline(tk.default_steps(time_bins=32)).fit()
    position = F.row_number().over(tk.account_order()) - 1
    corpus = lambda t: pipeline.corpus(t, 4)
    for make in (lambda t: t.select("row_id", "time_delta_s"), lambda t: t.select("row_id", position.alias("pos")), corpus):
        got, want = make(by_account(spark, table)), make(typed)
        assert exchanges(got) == 0 < exchanges(want)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert stored.columns == typed.columns
    with pytest.raises(ValueError, match="time_full"):
        store_by_account(typed.drop("time_full"), "never")
    spark.sql(f"DROP TABLE {table}")


def test_sketches_of_days_merge(spark, tmp_path):
    draw, start, path = random.Random(1), dt.date(2024, 1, 1), str(tmp_path / "days")
    rows = [(start + dt.timedelta(days=k % 30), f"u{draw.randint(0, 3000)}", draw.gauss(50, 20) if k % 9 else None) for k in range(20000)]
    df = spark.createDataFrame(rows, "date date, user string, amount double").repartition(5)
    store_days(sketch_days(df, ["user"], ["amount"]), path)
    for a, z in ((0, 29), (3, 11), (7, 7)):
        first, last = start + dt.timedelta(days=a), start + dt.timedelta(days=z)
        mine = [r for r in rows if first <= r[0] <= last]
        got = profile(spark, path, str(first), str(last), (0.1, 0.5, 0.9)).first()
        users, amounts = len({r[1] for r in mine}), np.sort([r[2] for r in mine if r[2] is not None])
        assert (got.days, got.rows) == (z - a + 1, len(mine)) and got.d_user == pytest.approx(users, rel=0.02)
        for share, x in zip((0.1, 0.5, 0.9), got.q_amount, strict=True):
            assert abs(np.searchsorted(amounts, x) / len(amounts) - share) < 0.015
    none = profile(spark, path, "1999-01-01", "1999-12-31").first()
    assert (none.days, none.rows, none.d_user, none.q_amount) == (0, 0, 0, None)
    again = df.filter(F.col("date") == start).limit(7)  # a day sketched anew replaces the day alone
    store_days(sketch_days(again, ["user"], ["amount"]), path)
    assert profile(spark, path, str(start), "2024-12-31").first().rows == 7 + sum(r[0] > start for r in rows)


def test_profile_query(spark):
    got = queries.QUERIES["range_profile"](spark, SF).first()
    rows = queries.dated(spark, SF).select("date", "User", queries.clean.dollars(F.col("Amount")).alias("a")).collect()
    low, high = min(r.date for r in rows), max(r.date for r in rows)
    mine = [r for r in rows if low + (high - low) / 4 <= r.date <= high - (high - low) / 4]
    assert got.rows == len(mine) and got.d_User == pytest.approx(len({r.User for r in mine}), rel=0.02)
    amounts = np.sort([r.a for r in mine])
    assert all(abs(np.searchsorted(amounts, q) / len(amounts) - s) < 0.02 for q, s in zip(got.q_amount, (0.25, 0.5, 0.75), strict=True))


def plain_murmur(data, seed):
    """Murmur3 by Python's integers, byte by byte."""
    most, h = 0xFFFFFFFF, seed

    def scramble(k):
        k = k * 0xCC9E2D51 & most
        return ((k << 15 | k >> 17) & most) * 0x1B873593 & most

    whole = len(data) // 4 * 4
    for k in range(0, whole, 4):
        h ^= scramble(int.from_bytes(data[k : k + 4], "little"))
        h = ((h << 13 | h >> 19) & most) * 5 + 0xE6546B64 & most
    if data[whole:]:
        h ^= scramble(int.from_bytes(data[whole:], "little"))
    h ^= len(data)
    for by, mix in ((16, 0x85EBCA6B), (13, 0xC2B2AE35)):
        h = (h ^ h >> by) * mix & most
    return h ^ h >> 16


def test_murmur_vectors():
    known = [("", 0, 0), ("", 1, 0x514E28B7), ("", 0xFFFFFFFF, 0x81F16F39), ("test", 0, 0xBA6BD213), ("Hello, world!", 0x9747B28C, 0x24884CBA), ("The quick brown fox jumps over the lazy dog", 0x9747B28C, 0x2FA826CD), ("aaa", 0x9747B28C, 0x283E0130), ("ππππππππ", 0x9747B28C, 0xD58063C1)]
    for text, seed, want in known:
        assert murmur32(pa.array([text]), seed).tolist() == [want]
    draw = random.Random(2)
    texts = ["".join(draw.choices("abcé中🙂 ", k=draw.randint(0, 40))) for _ in range(500)] + ["x" * 5001]
    for array in (pa.array(texts), pa.array([None, "q", *texts]).slice(2), pa.array(texts, pa.large_string())):
        assert murmur32(array, 7).tolist() == [plain_murmur(t.encode(), 7) for t in texts]
    assert murmur32(pa.array([None, ""]), 3).tolist() == [plain_murmur(b"", 3)] * 2 and len(murmur32(pa.array([], pa.string()))) == 0


def test_murmur_buckets_in_the_pipeline(spark):
    got = {r.row_id: r.token for r in queries.QUERIES["tok_merchant_murmur"](spark, SF).collect()}
    names = {r.row_id: r.merch_hash for r in queries.typed(spark, SF).collect()}
    assert got == {k: f"MERCH_{plain_murmur(n.encode(), 0) % 2000}" for k, n in names.items()}
    step = HashBucket("m", "m", "M", 50, "murmur", 9)
    df = spark.createDataFrame([(1, "a"), (2, None)], "row_id long, m string")
    assert [r[0] for r in df.orderBy("row_id").select(from_state(step.state()).token()).collect()] == [f"M_{plain_murmur(x, 9) % 50}" for x in (b"a", b"")]
    with pytest.raises(ValueError, match="unknown hash"):
        HashBucket("m", "m", "M", 5, "crc").index()
