"""The queries, each with the SQL that DuckDB compares it with (None where SQL cannot express it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swipeline.functions import clean
from swipeline.functions.values import INDUSTRIES, SPECIALS
from swipeline.operators import features as fe
from swipeline.operators import split as sp
from swipeline.operators import tokens as tk
from swipeline.operators.kept import kept, new_path
from swipeline.operators.layout import layout
from swipeline.operators.profiles import profile, sketch_days, store_days
from swipeline.operators.provider import CausalAttention, embed_with
from swipeline.operators.ranges import dense_row_id
from swipeline.operators.steps import FixedInt, HashBucket, LearnedBins, Mapping, TimeDelta
from swipeline.plans import oracle as o
from swipeline.sources import fixtures
from swipeline.sources.bucketed import store_by_account
from swipeline.sources.io import normalize_names

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
C = F.col


def add(name: str, run: Callable, body: str | None = None, *ctes: str) -> None:
    QUERIES[name] = run
    if body is not None:
        ORACLE_SQL[name] = o.sql(body, *ctes)


def table(name: str) -> Callable:
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


def dated(s: SparkSession, d: str) -> DataFrame:
    return fixtures.txn(s, d).withColumn("date", F.make_date("Year", "Month", "Day"))


def typed(s: SparkSession, d: str) -> DataFrame:
    return tk.preprocess(fixtures.txn(s, d))


def parts(s: SparkSession, d: str) -> DataFrame:
    return sp.temporal_split(dated(s, d))


def fitted() -> tk.TokenPipeline:
    return tk.TokenPipeline().fit()


def on_txn(f: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda s, d: f(fixtures.txn(s, d))


def on_typed(f: Callable[[DataFrame], DataFrame]) -> Callable:
    return lambda s, d: f(typed(s, d))


# Sources, projections and scalar functions
add("scan_parquet", table("orders"), "SELECT * FROM orders")
add("scan_pruned", lambda s, d: table("orders")(s, d).select("o_orderkey", "o_totalprice"), "SELECT o_orderkey, o_totalprice FROM orders")
add("feature_select", on_txn(lambda t: t.select("row_id", "User", "Card", "MCC", "Zip")), 'SELECT row_id, "User", "Card", "MCC", "Zip" FROM txn', o.TXN)
add("preview", on_txn(lambda t: t.orderBy("row_id").limit(5)), "SELECT * FROM txn ORDER BY row_id LIMIT 5", o.TXN)
add("row_id", lambda s, d: dense_row_id(table("events")(s, d).select("ts", "event_id"), ["ts", "event_id"]), "SELECT ts, event_id, row_number() OVER (ORDER BY ts, event_id) - 1 AS row_id FROM events")
add("normalize_columns", on_txn(lambda t: normalize_names(t).select("row_id", "use_chip", "merchant_name", "is_fraud?")), 'SELECT row_id, "Use Chip" AS use_chip, "Merchant Name" AS merchant_name, "Is Fraud?" AS "is_fraud?" FROM txn', o.TXN)
add("clean_amount", on_txn(lambda t: t.select("row_id", clean.dollars(C("Amount")).alias("amount"))), f"SELECT row_id, {o.AMOUNT} AS amount FROM txn", o.TXN)
add("target_flag", on_txn(lambda t: t.select("row_id", clean.fraud_flag(C("Is Fraud?")).alias("target"))), "SELECT row_id, (lower(trim(\"Is Fraud?\")) IN ('yes', '1'))::INT AS target FROM txn", o.TXN)
add("hour_feature", on_txn(lambda t: t.select("row_id", F.split("Time", ":", 2)[0].cast("int").alias("hour"))), "SELECT row_id, split_part(\"Time\", ':', 1)::INT AS hour FROM txn", o.TXN)
add("raw_features", on_txn(lambda t: fe.raw_features(t).select("row_id", "Hour", "Amount", "target", "MCC")), f"SELECT row_id, split_part(\"Time\", ':', 1)::INT AS \"Hour\", {o.AMOUNT} AS \"Amount\", (\"Is Fraud?\" = 'Yes')::INT AS target, \"MCC\" FROM txn", o.TXN)
add("clip", on_txn(lambda t: t.select("row_id", clean.clip(C("User"), 100, 900).alias("clipped"))), 'SELECT row_id, least(greatest("User", 100), 900) AS clipped FROM txn', o.TXN)
add("txn_text", on_txn(lambda t: t.select("row_id", F.concat_ws(" ", "Use Chip", "Merchant Name", "Amount").alias("text"))), 'SELECT row_id, concat_ws(\' \', "Use Chip", "Merchant Name", "Amount") AS text FROM txn', o.TXN)
add("amount_bucket", on_txn(lambda t: t.select("row_id", clean.amount_bucket(clean.dollars(C("Amount"))).alias("bucket"))), f"SELECT row_id, {o.bucket('a')} AS bucket FROM (SELECT row_id, {o.AMOUNT} AS a FROM txn)", o.TXN)
for name, column in (("amount_bin", "amt_val"), ("merchant_clean", "merch_hash"), ("zip3", "zip3"), ("state_clean", "state_clean"), ("txn_time", "time_full"), ("time_delta", "time_delta_s")):
    add(name, on_typed(lambda t, c=column: t.select("row_id", c)), f"SELECT row_id, {column} FROM clean", o.TXN, o.CLEAN)
add("preprocess", typed, "SELECT * FROM clean", o.TXN, o.CLEAN)
add("mcc_category", on_typed(lambda t: t.select("row_id", clean.industry(C("mcc_int")).alias("category"))), f"SELECT row_id, {o.industry('mcc_int')} AS category FROM clean", o.TXN, o.CLEAN)


def mcc_category_join(s: SparkSession, d: str) -> DataFrame:
    """The range table is a few fixed rows, so it is broadcast."""
    ranges = s.createDataFrame(INDUSTRIES, "low int, high int, label string")
    t = typed(s, d).select("row_id", "mcc_int")
    return t.join(F.broadcast(ranges), C("mcc_int").between(C("low"), C("high")), "left").select("row_id", F.coalesce("label", F.lit("GENERAL")).alias("category"))


add("mcc_category_join", mcc_category_join, f"SELECT row_id, {o.industry('mcc_int')} AS category FROM clean", o.TXN, o.CLEAN)
add("text_tokens", lambda s, d: table("documents")(s, d).select("doc_id", F.size(F.split(F.regexp_replace("text", r"^\s+|\s+$", ""), r"\s+")).alias("n")), r"SELECT doc_id, len(regexp_split_to_array(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+')) AS n FROM documents")

# Tokens, sequences and encoding
TOKENS = (o.TXN, o.CLEAN, o.TOK)
for name, column in (("tok_amount", "amt_val"), ("tok_merchant", "merch_hash"), ("tok_category", "mcc_int"), ("tok_mcc", "mcc_str"), ("tok_hour", "hour"), ("tok_dow", "dow"), ("tok_month", "month"), ("tok_card", "card"), ("tok_chip", "chip_upper"), ("tok_zip3", "zip3"), ("tok_state", "state_clean"), ("tok_cust", "cust")):
    add(name, on_typed(lambda t, c=column: t.select("row_id", next(x for x in tk.default_steps() if x.name == c).token().alias("token"))), f"SELECT row_id, {column} AS token FROM tok", *TOKENS)
add("token_frame", on_typed(lambda t: fitted().transform(t, "row_id")), "SELECT * FROM tok", *TOKENS)
add("txn_tokens", on_typed(lambda t: t.select("row_id", fitted().text().alias("text"))), f"SELECT row_id, concat_ws(' ', {', '.join(o.PARTS)}) AS text FROM tok", *TOKENS)
for name, compatible in (("vocab_table", False), ("vocab_table_compatible", True)):
    add(name, on_typed(lambda t, c=compatible: tk.token_usage(t, tk.TokenPipeline(compatible=c).fit())), "SELECT token, id, step, local_id, coalesce(n, 0) AS n FROM vocab LEFT JOIN used USING (step, token)", *TOKENS, o.USED, o.vocab(compatible))


def vocab_learned(s: SparkSession, d: str) -> DataFrame:
    """The vocabulary of steps that learn their values from the transactions: cities, states and amounts by quantile."""
    t = typed(s, d).join(fixtures.txn(s, d).select("row_id", C("Merchant City").alias("city")), "row_id")
    t = t.withColumn("city", F.replace("city", F.lit(" "), F.lit("_")))
    steps = [Mapping("city", "city", "CITY", learned=True), Mapping("state", "state_clean", "STATE", learned=True, default="XX"), FixedInt("hour", "hour", "HOUR", 0, 23, 2)]
    pipeline = tk.TokenPipeline(steps).fit(t)
    return tk.token_usage(t, pipeline)


def learned_part(name: str, prefix: str, value: str, default: str, first: str) -> str:
    """Tokens of a learned mapping by falling back on ``default``, in sorted order and the default last unless it is a value."""
    values = f"SELECT DISTINCT {value} AS v FROM clean JOIN txn USING (row_id) WHERE {value} IS NOT NULL"
    places = f"SELECT v, row_number() OVER (ORDER BY v) - 1 AS k FROM ({values}) UNION ALL SELECT '{default}', count(*) FROM ({values}) HAVING count(*) FILTER (v = '{default}') = 0"
    return f"""{name} AS (SELECT '{prefix}_' || v AS token, ({first} + k)::INT AS id, '{name}' AS step, k::INT AS local_id, coalesce(n, 0) AS n FROM ({places})
      LEFT JOIN (SELECT coalesce({value}, '{default}') AS v, count(*) AS n FROM clean JOIN txn USING (row_id) GROUP BY 1) USING (v))"""


add("vocab_learned", vocab_learned, f"""SELECT * FROM city UNION ALL SELECT * FROM state
  UNION ALL SELECT 'HOUR_' || lpad(h::VARCHAR, 2, '0'), (5 + (SELECT count(*) FROM city) + (SELECT count(*) FROM state) + h)::INT, 'hour', h::INT, (SELECT count(*) FROM clean WHERE hour = h) FROM range(24) t(h)
  UNION ALL SELECT unnest({SPECIALS}), unnest(range(5))::INT, 'special', unnest(range(5))::INT, 0""", o.TXN, o.CLEAN, learned_part("city", "CITY", "replace(\"Merchant City\", ' ', '_')", "UNK", "5"), learned_part("state", "STATE", "state_clean", "XX", "5 + (SELECT count(*) FROM city)"))  # fmt: skip
add("encode_ids", on_typed(lambda t: t.select("row_id", fitted().ids().alias("ids"))), "SELECT row_id, ids FROM ids", o.TXN, o.CLEAN, o.IDS)
for name, length, special in (("encode_padded", 16, True), ("encode_short", 8, True), ("encode_nospecial", 16, False)):
    whole = "list_concat([1], ids, [2])" if special else "ids"
    add(name, on_typed(lambda t, n=length, x=special: fitted().encode(t, n, x)), f"SELECT row_id, list_concat({whole}, list_transform(range({length}), lambda x: 0))[1:{length}] AS input_ids FROM ids", o.TXN, o.CLEAN, o.IDS)
add("attention_mask", on_typed(lambda t: fitted().encode(t, 16).select("row_id", fe.attention_mask(F.transform("input_ids", lambda x: F.when(x % 3 == 0, 0).otherwise(x))).alias("mask"))), "SELECT row_id, list_transform(list_concat([1], ids, [2], [0, 0]), lambda x: (x % 3 <> 0)::INT) AS mask FROM ids", o.TXN, o.CLEAN, o.IDS)
add("clm_examples", on_typed(lambda t: tk.clm_examples(fitted().encode(t, 16), 20)), "SELECT row_id, list_concat([1], ids, [2], list_transform(range(6), lambda x: 0)) AS input_ids, list_concat([1], ids, [2], list_transform(range(6), lambda x: -100)) AS labels FROM ids", o.TXN, o.CLEAN, o.IDS)
add("decode", lambda s, d: tk.decode(fitted().encode(typed(s, d), 16), fitted(), "row_id"), f"SELECT row_id, '<bos> ' || concat_ws(' ', {', '.join(o.PARTS)}) || ' <eos>' AS text FROM tok", *TOKENS)
add("encode_text", lambda s, d: tk.encode_text(typed(s, d).select("row_id", F.concat(fitted().text(), F.lit(" ?")).alias("text")), fitted().vocab_table(s), ["row_id"]), "SELECT row_id, list_append(ids, 4) AS input_ids FROM ids", o.TXN, o.CLEAN, o.IDS)
add("vocab_lookup_join", lambda s, d: fitted().transform(typed(s, d), "row_id").select("row_id", C("merch_hash").alias("token")).join(F.broadcast(fitted().vocab_table(s).select("token", "id")), "token", "left").select("row_id", F.coalesce("id", F.lit(4)).alias("id")), "SELECT row_id, ids[2] AS id FROM ids", o.TXN, o.CLEAN, o.IDS)
POSITION = 'SELECT row_id, (row_number() OVER (PARTITION BY "user", card ORDER BY time_full, row_id) - 1)::INT AS'
add("seq_position", on_typed(lambda t: tk.placed(t).select("row_id", C("pos").cast("int"))), f"{POSITION} pos FROM clean", o.TXN, o.CLEAN)
add("chunk_id", on_typed(lambda t: tk.placed(t).select("row_id", F.floor(C("pos") / 4).cast("int").alias("chunk_id"))), f"SELECT row_id, (pos // 4)::INT AS chunk_id FROM ({POSITION} pos FROM clean)", o.TXN, o.CLEAN)
SEQ = (*TOKENS, o.LINE, o.CORPUS)
add("corpus_lines", on_typed(lambda t: fitted().corpus(t, 4)), "SELECT * FROM corpus", *SEQ)
add("corpus_lines_full", on_typed(lambda t: fitted().corpus(t, 315)), "SELECT * FROM corpus", *TOKENS, o.LINE, o.CORPUS.replace("pos // 4", "pos // 315"))
# All users as one: three accounts, each of a third of the rows, so that lines are full and accounts have several.
FOLDED = (o.TXN.replace("txn AS (", "every AS (", 1), 'txn AS (SELECT * REPLACE (0::BIGINT AS "User") FROM every)', o.CLEAN, o.TOK)
add("corpus_lines_long", on_txn(lambda t: fitted().corpus(tk.preprocess(t.withColumn("User", F.lit(0).cast("long"))), 315, long_accounts=True)), "SELECT * FROM corpus", *FOLDED, o.LINE, o.CORPUS.replace("pos // 4", "pos // 315"))
add("corpus_count", on_typed(lambda t: fitted().corpus(t, 4).agg(F.count("*").alias("lines"))), "SELECT count(*) AS lines FROM corpus", *SEQ)
add("corpus_stats", on_typed(lambda t: fitted().corpus(t, 4).select("user", "card", "chunk_id", (F.size(F.split("text", "<sep>")) - 1).alias("seps"), F.size(F.split("text", " ")).alias("words"))), "SELECT \"user\", card, chunk_id, len(string_split(text, '<sep>')) - 1 AS seps, len(string_split(text, ' ')) AS words FROM corpus", *SEQ)


def capacity(s: SparkSession, d: str) -> DataFrame:
    """How many transactions a context of 4,096 holds, by the longest and by the average transaction of the table."""
    n = F.size(F.split(fitted().text(), " "))
    longest, tokens, rows = typed(s, d).agg(F.max(n), F.sum(n), F.count("*")).first()
    return s.createDataFrame([(tk.context_capacity(4096, longest), tk.context_capacity(4096, tokens / rows), tokens)], "rows int, rows_average int, tokens long")


def efficiency(s: SparkSession, d: str) -> DataFrame:
    """The preset against a public byte-level vocabulary on the raw fields of the same transactions."""
    import public_tokenizers

    return tk.token_efficiency(fixtures.txn(s, d), typed(s, d), fitted(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


add("context_capacity", capacity, f"SELECT (4096 // (max(n) + 1))::INT AS rows, floor(4096 / (sum(n) / count(*) + 1))::INT AS rows_average, sum(n)::BIGINT AS tokens FROM (SELECT len(string_split(concat_ws(' ', {', '.join(o.PARTS)}), ' ')) AS n FROM tok)", *TOKENS)
add("token_efficiency", efficiency)


def corpus_bucketed(s: SparkSession, d: str) -> DataFrame:
    """The corpus over transactions stored by account: nothing is shuffled after the table is written."""
    path = new_path(s, "accounts")
    return fitted().corpus(store_by_account(tk.preprocess(fixtures.txn(s, d), gaps=False), path.rsplit("/", 1)[-1].replace("-", "_"), 16, path), 4)


add("corpus_bucketed", corpus_bucketed, "SELECT * FROM corpus", *SEQ)
add("tok_merchant_murmur", on_typed(lambda t: t.select("row_id", HashBucket("merch_hash", "merch_hash", "MERCH", 2000, "murmur").token().alias("token"))))


def events_time(s: SparkSession, d: str) -> DataFrame:
    step = TimeDelta("time_delta_s", "time_delta_s", "TDIF", 32)
    return fixtures.txn_events(s, d).withColumn("time_delta_s", tk.time_delta()).select("row_id", "time_delta_s", step.token().alias("token"))


add("tok_time_delta", events_time, """SELECT row_id, time_delta_s, 'TDIF_' || least(floor(ln(least(time_delta_s, 315569519) + 1) / ln(315569520) * 32) + 1, 31)::INT AS token FROM (
  SELECT row_id, greatest(coalesce(date_diff('second', lag(time_full) OVER (PARTITION BY "user", card ORDER BY time_full, row_id), time_full), 0), 0) AS time_delta_s FROM ev)""", o.EVENTS)  # fmt: skip


def bins(strategy: str) -> Callable:
    def run(s: SparkSession, d: str) -> DataFrame:
        e = fixtures.txn_events(s, d)
        return e.select("row_id", LearnedBins("amount", "amount", "AMT", 10, strategy).fit(e).token().alias("token"))

    return run


TENTHS = [k / 10 for k in range(1, 10)]
add("tok_amount_quantile", bins("quantile"), f"SELECT row_id, 'AMT_' || len(list_filter((SELECT quantile_cont(amount, {TENTHS}) FROM ev), lambda x: amount >= x))::VARCHAR AS token FROM ev", o.EVENTS)
add("tok_amount_uniform", bins("uniform"), f"SELECT row_id, 'AMT_' || len(list_filter({TENTHS}, lambda x: amount >= low + (high - low) * x))::VARCHAR AS token FROM ev, (SELECT min(amount) AS low, max(amount) AS high FROM ev)", o.EVENTS)
add("tok_amount_kmeans", bins("kmeans"))
add("learned_vocab", lambda s, d: table("documents")(s, d).select("lang").filter("lang IS NOT NULL").distinct().orderBy("lang"), "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL ORDER BY lang")
add("tok_learned", lambda s, d: table("documents")(s, d).select("doc_id", Mapping("lang", "lang", "LANG", learned=True).fit(table("documents")(s, d)).token().alias("token")), "SELECT doc_id, 'LANG_' || coalesce(lang, 'UNK') AS token FROM documents")

# Profiles
SPLITS = (o.TXN, o.DATED, o.CUTS, o.SPLIT)
add("dataset_summary", lambda s, d: dated(s, d).agg(F.count("*").alias("rows"), F.count_distinct("User").alias("users"), F.count_distinct("Merchant Name").alias("merchants"), F.min("date").alias("first"), F.max("date").alias("last"), F.sum(clean.fraud_flag(C("Is Fraud?"))).alias("fraud")), "SELECT count(*) AS rows, count(DISTINCT \"User\") AS users, count(DISTINCT \"Merchant Name\") AS merchants, min(date) AS first, max(date) AS last, count(*) FILTER (\"Is Fraud?\" = 'Yes') AS fraud FROM dated", o.TXN, o.DATED)
add("value_counts", on_txn(lambda t: t.groupBy(C("Use Chip").alias("value")).agg(F.count("*").alias("n"))), 'SELECT "Use Chip" AS value, count(*) AS n FROM txn GROUP BY 1', o.TXN)
add("daily_counts", lambda s, d: dated(s, d).groupBy("date").agg(F.count("*").alias("n")), "SELECT date, count(*) AS n FROM dated GROUP BY 1", o.TXN, o.DATED)
PERIOD = "monthly AS (SELECT \"Year\"::VARCHAR || '-' || lpad(\"Month\"::VARCHAR, 2, '0') AS period, count(*) AS n FROM txn GROUP BY 1), placed AS (SELECT *, row_number() OVER (ORDER BY period) - 1 AS pos FROM monthly)"


def monthly(s: SparkSession, d: str) -> DataFrame:
    period = F.concat(C("Year").cast("string"), F.lit("-"), F.lpad(C("Month").cast("string"), 2, "0"))
    return fixtures.txn(s, d).groupBy(period.alias("period")).agg(F.count("*").alias("n")).orderBy("period")


def placed(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    return monthly(s, d).withColumn("pos", F.row_number().over(Window.orderBy("period")) - 1)


add("monthly_counts", monthly, "SELECT period, n FROM monthly", o.TXN, PERIOD)
add("monthly_ticks", lambda s, d: placed(s, d).filter("pos % 12 = 0").select("pos", "period"), "SELECT pos, period FROM placed WHERE pos % 12 = 0", o.TXN, PERIOD)


def boundaries(s: SparkSession, d: str) -> DataFrame:
    train, val = sp.cutoffs(dated(s, d)).first()
    return placed(s, d).select("period", "pos", (C("period") == f"{train:%Y-%m}").alias("train_end"), (C("period") == f"{val:%Y-%m}").alias("val_end")).filter("train_end OR val_end")


add("monthly_boundaries", boundaries, "SELECT period, pos, period = strftime(train_end, '%Y-%m') AS train_end, period = strftime(val_end, '%Y-%m') AS val_end FROM placed, (SELECT train_end, val_end FROM cuts) WHERE period IN (strftime(train_end, '%Y-%m'), strftime(val_end, '%Y-%m'))", o.TXN, o.DATED, o.CUTS, PERIOD)
add("cutoff_date", lambda s, d: sp.cutoffs(dated(s, d)), "SELECT * FROM cuts", *SPLITS[:3])
add("temporal_split", lambda s, d: parts(s, d).select("row_id", "split"), "SELECT row_id, split FROM parts", *SPLITS)
for part in ("train", "val", "test"):
    add(f"split_{part}", lambda s, d, p=part: parts(s, d).filter(C("split") == p).drop("date", "split"), f"SELECT * EXCLUDE (date, split) FROM parts WHERE split = '{part}'", *SPLITS)


def split_stats(s: SparkSession, d: str) -> DataFrame:
    from pyspark.sql.window import Window

    g = parts(s, d).groupBy("split").agg(F.count("*").alias("n"), F.sum(clean.fraud_flag(C("Is Fraud?"))).alias("fraud"))
    return g.select("split", "n", "fraud", (100 * C("n") / F.sum("n").over(Window.partitionBy())).alias("share"), (100 * C("fraud") / C("n")).alias("rate"))


add("split_stats", split_stats, "SELECT split, n, fraud, 100.0::DOUBLE * n / sum(n) OVER () AS share, 100.0::DOUBLE * fraud / n AS rate FROM (SELECT split, count(*) AS n, count(*) FILTER (\"Is Fraud?\" = 'Yes') AS fraud FROM parts GROUP BY 1)", *SPLITS)
add("union_splits", lambda s, d: parts(s, d).filter("split = 'val'").unionByName(parts(s, d).filter("split = 'test'")).select("row_id", "split"), "SELECT row_id, split FROM parts WHERE split <> 'train'", *SPLITS)
PER_USER = 'per AS (SELECT "User", count(*) AS n FROM txn GROUP BY 1)'
per_user = on_txn(lambda t: t.groupBy("User").agg(F.count("*").alias("n")))
add("txns_per_user", per_user, "SELECT * FROM per", o.TXN, PER_USER)
add("txns_per_user_median", lambda s, d: per_user(s, d).agg(F.median("n").alias("median")), "SELECT median(n) AS median FROM per", o.TXN, PER_USER)


def histogram(s: SparkSession, d: str) -> DataFrame:
    per = per_user(s, d)
    low, high = per.agg(F.min("n"), F.max("n")).first()
    width = max((high - low) / 50, 1e-9) if low is not None else 1.0
    return per.groupBy(F.least(F.floor((C("n") - F.lit(low)) / width), F.lit(49)).cast("int").alias("bin")).agg(F.count("*").alias("users"))


add("user_histogram", histogram, "SELECT least(floor((n - low) / ((high - low) / 50)), 49)::INT AS bin, count(*) AS users FROM per, (SELECT min(n) AS low, max(n) AS high FROM per) GROUP BY 1", o.TXN, PER_USER)
add("mcc_fraud_topn", on_txn(lambda t: t.groupBy("MCC").agg(F.count("*").alias("n"), (100 * F.sum(clean.fraud_flag(C("Is Fraud?"))) / F.count("*")).alias("rate")).filter("n >= 2 AND MCC IS NOT NULL").orderBy(F.desc("rate"), "MCC").limit(15)), "SELECT \"MCC\", count(*) AS n, 100.0::DOUBLE * count(*) FILTER (\"Is Fraud?\" = 'Yes') / count(*) AS rate FROM txn WHERE \"MCC\" IS NOT NULL GROUP BY 1 HAVING count(*) >= 2 ORDER BY rate DESC, \"MCC\" LIMIT 15", o.TXN)

# Codes by thousands, so that groups of 500 transactions and more are there from sf0.01 on.
add("mcc_fraud_many", on_txn(lambda t: t.groupBy((C("MCC") - C("MCC") % 1000).alias("mcc_from")).agg(F.count("*").alias("n"), (100 * F.sum(clean.fraud_flag(C("Is Fraud?"))) / F.count("*")).alias("rate")).filter("n >= 500 AND mcc_from IS NOT NULL").orderBy(F.desc("rate"), "mcc_from").limit(15)), "SELECT (\"MCC\" - \"MCC\" % 1000)::INT AS mcc_from, count(*) AS n, 100.0::DOUBLE * count(*) FILTER (\"Is Fraud?\" = 'Yes') / count(*) AS rate FROM txn WHERE \"MCC\" IS NOT NULL GROUP BY 1 HAVING count(*) >= 500 ORDER BY rate DESC, 1 LIMIT 15", o.TXN)


def topn_other(s: SparkSession, d: str) -> DataFrame:
    """The top list has three rows by construction, so it is broadcast."""
    t = typed(s, d).select("row_id", "state_clean")
    top = t.groupBy("state_clean").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "state_clean").limit(3).select(C("state_clean").alias("shown"))
    return t.join(F.broadcast(top), t.state_clean == top.shown, "left").select("row_id", F.coalesce("shown", F.lit("Other")).alias("shown"))


add("topn_other", topn_other, "SELECT row_id, coalesce(t.s, 'Other') AS shown FROM clean LEFT JOIN (SELECT state_clean AS s FROM clean GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3) t ON s = state_clean", o.TXN, o.CLEAN)
add("feature_profile", on_txn(lambda t: t.agg(*(F.count_distinct(c).alias(c.lower().replace(" ", "_")) for c in ("User", "Card", "MCC", "Zip", "Use Chip", "Merchant State")))), 'SELECT count(DISTINCT "User") AS "user", count(DISTINCT "Card") AS card, count(DISTINCT "MCC") AS mcc, count(DISTINCT "Zip") AS zip, count(DISTINCT "Use Chip") AS use_chip, count(DISTINCT "Merchant State") AS merchant_state FROM txn', o.TXN)



def range_profile(s: SparkSession, d: str) -> DataFrame:
    """Distinct users and merchants and quartiles of amounts over the middle half of the days, from stored sketches."""
    t = dated(s, d).withColumn("amount", clean.dollars(C("Amount")))
    path = new_path(s, "days")
    store_days(sketch_days(t, ["User", "Merchant Name"], ["amount"]), path)
    low, high = t.agg(F.min("date"), F.max("date")).first()
    quarter = (high - low) / 4
    return profile(s, path, str(low + quarter), str(high - quarter), (0.25, 0.5, 0.75))


add("range_profile", range_profile)

# Samples
RANK = "SELECT row_id, is_fraud, row_number() OVER (PARTITION BY is_fraud ORDER BY md5('42|' || row_id::VARCHAR), row_id) AS r FROM ev"
COUNTS = "n AS (SELECT count(*) AS total, count(*) FILTER (is_fraud = 1) AS ones, count(*) - count(*) FILTER (is_fraud = 1) AS zeros FROM ev)"
add("balanced_sample", lambda s, d: sp.capped_class_sample(fixtures.txn_events(s, d), 1000).select("row_id", "is_fraud"), f"SELECT row_id, is_fraud FROM ({RANK}), n WHERE r <= CASE WHEN is_fraud = 1 THEN least(ones, 100) ELSE least(zeros, 1000 - least(ones, 100)) END", o.EVENTS, COUNTS)
add("stratified_sample", lambda s, d: sp.stratified_sample(fixtures.txn_events(s, d), 300).select("row_id", "is_fraud"), f"""SELECT row_id, is_fraud FROM ({RANK}), (
  SELECT q1 + CASE WHEN left_over > 0 AND (f1 > f0) THEN 1 ELSE 0 END AS q1, q0 + CASE WHEN left_over > 0 AND (f0 >= f1) THEN 1 ELSE 0 END AS q0 FROM (
    SELECT 300 * ones // total AS q1, 300 * zeros // total AS q0, 300 * ones % total AS f1, 300 * zeros % total AS f0, 300 - 300 * ones // total - 300 * zeros // total AS left_over FROM n))
  WHERE r <= CASE WHEN is_fraud = 1 THEN q1 ELSE q0 END""", o.EVENTS, COUNTS)  # fmt: skip
add("shuffled", lambda s, d: sp.shuffle(fixtures.txn_events(s, d)).limit(100).select("row_id"), "SELECT row_id FROM ev ORDER BY md5('42|' || row_id::VARCHAR), row_id LIMIT 100", o.EVENTS)
add("uniform_sample", lambda s, d: sp.uniform_sample(fixtures.txn_events(s, d), 500).select("row_id"), "SELECT row_id FROM ev ORDER BY md5('42|' || row_id::VARCHAR), row_id LIMIT 500", o.EVENTS)

# Features, embeddings, models and metrics
CODED = ["Use Chip", "Merchant City"]


def encoded(s: SparkSession, d: str) -> DataFrame:
    p = parts(s, d)
    return fe.ordinal_encode(p.filter("split <> 'train'"), p.filter("split = 'train'"), CODED).select("row_id", *CODED)


CODES = "SELECT v, (row_number() OVER (ORDER BY v) - 1)::INT AS i FROM (SELECT DISTINCT \"{0}\" AS v FROM parts WHERE split = 'train' AND \"{0}\" IS NOT NULL)"
add("ordinal_encode", encoded, f'SELECT row_id, coalesce(a.i, -1) AS "Use Chip", coalesce(b.i, -1) AS "Merchant City" FROM parts LEFT JOIN ({CODES.format("Use Chip")}) a ON a.v = "Use Chip" LEFT JOIN ({CODES.format("Merchant City")}) b ON b.v = "Merchant City" WHERE split <> \'train\'', *SPLITS)
vectors = lambda s, d: table("embeddings")(s, d).select(C("vec_id").alias("row_id"), "label", "embedding")
add("align_by_row_id", lambda s, d: fe.align(vectors(s, d).select("row_id", "label"), vectors(s, d).select("row_id", F.size("embedding").alias("dim"))), "SELECT vec_id AS row_id, label, len(embedding) AS dim FROM embeddings")
add("combined_features", lambda s, d: fe.align(vectors(s, d).select("row_id", F.array(C("label").cast("double")).alias("raw")), vectors(s, d).select("row_id", C("embedding").cast("array<double>").alias("e"))).select("row_id", F.concat("raw", "e").alias("features")), "SELECT vec_id AS row_id, list_prepend(label::DOUBLE, embedding::DOUBLE[]) AS features FROM embeddings")
add("embedding_stats", lambda s, d: vectors(s, d).select(F.explode(C("embedding").cast("array<double>")).alias("x")).agg(F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_pop("x"), 6).alias("std"), F.min("x").alias("min"), F.max("x").alias("max")), "SELECT round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS min, max(x) AS max FROM (SELECT unnest(embedding)::DOUBLE AS x FROM embeddings)")
add("embedding_dim_variance", lambda s, d: vectors(s, d).select(F.posexplode("embedding").alias("dim", "x")).groupBy("dim").agg(F.var_pop(C("x").cast("double")).alias("v")).agg(F.round(F.avg("v"), 6).alias("variance")), "SELECT round(avg(v), 6) AS variance FROM (SELECT i, var_pop(x) AS v FROM (SELECT unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY i)")


def states(s: SparkSession, d: str) -> DataFrame:
    """A vector of three dimensions at each of 16 positions, of which 12 are real."""
    ids = fitted().encode(typed(s, d), 16, False)
    vector = F.transform("input_ids", lambda x: F.array(x.cast("double"), (x % 7).cast("double"), (x % 11).cast("double")))
    return ids.select("row_id", vector.alias("states"), fe.attention_mask(C("input_ids")).alias("mask"))


add("pool_last", lambda s, d: fe.pool(states(s, d), "last"), "SELECT row_id, [ids[12]::DOUBLE, ids[12] % 7, ids[12] % 11] AS embedding FROM ids", o.TXN, o.CLEAN, o.IDS)
add("pool_mean", lambda s, d: fe.pool(states(s, d), "mean"), "SELECT row_id, [list_sum(ids) / 12.0::DOUBLE, list_sum(list_transform(ids, lambda x: x % 7)) / 12.0::DOUBLE, list_sum(list_transform(ids, lambda x: x % 11)) / 12.0::DOUBLE] AS embedding FROM ids", o.TXN, o.CLEAN, o.IDS)
SCORED = "scored AS (SELECT n_chars AS score, toxic AS label FROM documents JOIN labels USING (doc_id))"
scored = lambda s, d: table("documents")(s, d).join(table("labels")(s, d), "doc_id").select(C("n_chars").alias("score"), C("toxic").alias("label"))
PER = "per AS (SELECT score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM scored GROUP BY 1)"
add("auroc", lambda s, d: fe.auroc(scored(s, d)).select(F.round("auroc", 9).alias("auroc")), "SELECT round(sum(pos * (nb + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 9) AS auroc FROM (SELECT *, coalesce(sum(n - pos) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM per)", SCORED, PER)
add("avg_precision", lambda s, d: fe.average_precision(scored(s, d)).select(F.round("avg_precision", 9).alias("avg_precision")), "SELECT round(sum(pos * cp / cn) / sum(pos), 9) AS avg_precision FROM (SELECT pos, sum(pos) OVER w AS cp, sum(n) OVER w AS cn FROM per WINDOW w AS (ORDER BY score DESC))", SCORED, PER)
add("viz_frame", on_txn(lambda t: t.select("row_id", clean.industry(C("MCC"), "Unknown").alias("industry"), F.coalesce(C("MCC"), F.lit(-1)).cast("string").alias("mcc"), F.trim(F.upper(F.coalesce("Merchant State", F.lit("XX")))).alias("state"), F.trim(F.coalesce("Use Chip", F.lit("Unknown"))).alias("chip_type"), clean.amount_bucket(clean.dollars(C("Amount"))).alias("amount_bucket"), F.lpad(clean.zip3(C("Zip")).cast("string"), 3, "0").alias("zip3"), F.when(C("Is Fraud?") == "Yes", "Fraud").otherwise("Normal").alias("fraud"), F.coalesce("Merchant City", F.lit("Unknown")).alias("city"))), f"""SELECT row_id, {o.industry('"MCC"', "'Unknown'")} AS industry, coalesce("MCC", -1)::VARCHAR AS mcc, trim(upper(coalesce("Merchant State", 'XX'))) AS state, "Use Chip" AS chip_type, {o.bucket('(' + o.AMOUNT + ')')} AS amount_bucket,
  lpad(substr(replace(coalesce("Zip", '00000'), '.0', ''), 1, 3), 3, '0') AS zip3, CASE WHEN "Is Fraud?" = 'Yes' THEN 'Fraud' ELSE 'Normal' END AS fraud, "Merchant City" AS city FROM txn""", o.TXN)  # fmt: skip
add("pca_project", lambda s, d: fe.pca(vectors(s, d), 8)[0].select("row_id", "pca"))
add("embed_txn", on_typed(lambda t: fe.embed(fitted().encode(t, 128))))
add("embed_seq", lambda s, d: fe.embed(tk.encode_text(fitted().corpus(typed(s, d), 4).withColumn("seq", F.concat_ws("-", "user", "card", "chunk_id")), fitted().vocab_table(s), ["seq"]), key="seq"))
add("embed_attention", on_typed(lambda t: embed_with(fitted().encode(t, 16), CausalAttention(fitted().vocab_size()), "last", 16)))


def embed_project_2d(s: SparkSession, d: str) -> DataFrame:
    """Ids are encoded once and kept, without padding, which vectors do not depend on; the passes of the fit embed them anew.

    Rows are dealt to all cores first, as few row groups are few tasks.
    """
    pipeline = fitted()
    tasks = max(s.sparkContext.defaultParallelism, int(s.conf.get("spark.sql.shuffle.partitions")))
    ids = kept(pipeline.encode(typed(s, d).repartition(tasks, "row_id"), len(pipeline.steps) + 2))
    return fe.pca(fe.embed(ids), 2)[0].select("row_id", "pca")


add("embed_project_2d", embed_project_2d)


add("embed_layout", lambda s, d: layout(vectors(s, d)))
RAW = ["amount", "hour", "dow", "month", "mcc_int", "zip3", "cust"]
FLAT = [f"p{k}" for k in range(8)]


def gbt(which: str, columns: list[str]) -> Callable:
    """Scores of the test split with one of the tuned sets, of up to all its trees."""

    def run(s: SparkSession, d: str) -> DataFrame:
        t = fe.align(typed(s, d), parts(s, d).select("row_id", "split"))
        own = ["row_id", "is_fraud", "split", *(c for c in columns if c not in FLAT)]
        if FLAT[0] in columns:
            # Kept with the ids, so that the passes of the fit embed them where they are.
            ids = fitted().encode(t, 128, keep="*")
            t = kept(ids.select(*own, F.filter("input_ids", lambda x: x != 0).alias("input_ids")))
            flat, _ = fe.pca(fe.embed(t), len(FLAT), fe.embed(t.filter("split = 'train'")))
            t = fe.align(t.select(*own), flat.select("row_id", *(C("pca")[k].alias(c) for k, c in enumerate(FLAT))))
        t = kept(t.select(*own, *(c for c in columns if c in FLAT)).withColumn("is_val", C("split") == "val"))
        return fe.gbt_scores(t.filter("split <> 'test'"), t.filter("split = 'test'"), columns, "is_fraud", fe.GBT_SETS[which], "is_val")

    return run


add("gbt_scores", gbt("raw", RAW))
add("gbt_embedding", gbt("embedding", FLAT))
add("gbt_combined", gbt("combined", [*RAW, *FLAT]))
