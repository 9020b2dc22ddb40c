"""Transactions derived from the test tables, one per order, and card events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def txn(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    k, u, p, status = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderstatus")
    cents = (
        F.when(k % 41 == 0, F.lit(-2500)).when(k % 5 == 0, k % 1500).when(k % 5 == 1, 900 + k * 13 % 6000).when(k % 5 == 2, 5000 + k * 17 % 60000)
        .when(k % 5 == 3, F.floor(p / 2)).otherwise(F.floor(p * 2)).cast("long")
    )
    pad2 = lambda c: F.lpad(c.cast("string"), 2, "0")
    text = lambda c: c.cast("string")
    whole = F.floor(F.abs(cents) / 100).cast("long")
    amount = F.concat(F.lit("$"), F.when(cents < 0, "-").otherwise(""), text(whole), F.lit("."), pad2(F.abs(cents) % 100))
    other = F.element_at(F.array(*map(F.lit, ["CA", "NY", " tx", "Italy", "FL", "ia"])), (k % 6 + 1).cast("int"))
    return o.select(
        k.alias("row_id"), u.alias("User"), (k % 3).alias("Card"),
        F.year("o_orderdate").alias("Year"), F.month("o_orderdate").alias("Month"), F.day("o_orderdate").alias("Day"),
        F.concat(pad2(k % 24), F.lit(":"), pad2(k * 7 % 60)).alias("Time"), amount.alias("Amount"),
        F.concat(F.when(status == "P", "Swipe").when(status == "F", "Chip").otherwise("Online"), F.lit(" Transaction")).alias("Use Chip"),
        F.concat(F.lit("Shop #"), text((u * 31 + k) % 997), F.lit("-"), text(k % 7), F.lit("'s")).alias("Merchant Name"),
        F.when(status == "O", "ONLINE").otherwise(F.concat(F.lit("City "), text(u % 40))).alias("Merchant City"),
        F.when(status == "O", F.when(k % 2 == 0, "")).otherwise(other).alias("Merchant State"),
        F.when(status != "O", F.concat(text(u * 97 % 99999), F.lit(".0"))).alias("Zip"),
        F.when(k % 50 != 0, (k * 37 % 10500).cast("int")).alias("MCC"),
        F.when(k % 97 == 0, "Yes").otherwise("No").alias("Is Fraud?"),
    )


def txn_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").alias("row_id"), F.col("user_id").alias("user"), (F.col("event_id") % 2).cast("int").alias("card"),
        F.date_trunc("second", "ts").cast("timestamp_ntz").alias("time_full"), F.col("value").alias("amount"), (F.col("event_type") == "error").cast("int").alias("is_fraud"),
        F.concat_ws("-", "event_type", F.get_json_object("props", "$.k")).alias("merchant"),
    )
