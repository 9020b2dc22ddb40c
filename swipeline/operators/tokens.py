"""The token pipeline: steps in order, one vocabulary, token frames, encoding, corpora and training examples."""

from __future__ import annotations

import base64
import functools
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType
from pyspark.sql.window import Window

from swipeline.functions import clean
from swipeline.functions.values import CHIPS, INDUSTRIES, KNOWN_MCCS, SPECIALS, STATES
from swipeline.operators.steps import FixedInt, HashBucket, LearnedBins, Mapping, Ranges, Step, TimeDelta, fit_steps
from swipeline.sources.io import normalize_names, read_corpus, require

NEEDED = ["user", "card", "year", "month", "day", "time", "amount", "use_chip", "merchant_name", "merchant_state", "zip", "mcc"]
#: Between the names of a table of tokens.
APART = "\x00"
#: An account of more rows is not left to one task: a window over as many corpus lines takes a task some 200 MB.
MOST_ROWS = 1_000_000


def preprocess(raw: DataFrame, row_id: str = "row_id", lenient: bool = False, zip_width: int | None = None, gaps: bool = True) -> DataFrame:
    """Typed features of raw transactions: one projection, and with ``gaps`` one window for the time since the account's last transaction.

    ``lenient`` makes amounts that are no numbers null instead of raising; ``zip_width`` restores leading zeros of ZIP codes before they are cut.
    """
    df = require(normalize_names(raw), NEEDED)
    c = F.col
    time = c("time_full") if "time_full" in df.columns else clean.txn_time(c("year"), c("month"), c("day"), c("time"))
    mcc = F.coalesce(c("mcc"), F.lit(-1)).cast("int")
    amount = clean.dollars(c("amount"), lenient)
    typed = df.select(
        c(row_id).alias("row_id"), c("user"), clean.clip(c("card"), 0, 9).cast("int").alias("card"), time.alias("time_full"), amount.alias("amount"),
        clean.amount_bin(amount).alias("amt_val"), clean.merchant_clean(c("merchant_name")).alias("merch_hash"),
        mcc.alias("mcc_int"), mcc.cast("string").alias("mcc_str"), F.hour(time).alias("hour"), F.weekday(time).alias("dow"), F.month(time).alias("month"),
        F.upper("use_chip").alias("chip_upper"), clean.zip3(c("zip"), zip_width).alias("zip3"), clean.state_clean(c("merchant_state")).alias("state_clean"),
        clean.clip(c("user"), 0, 2999).cast("int").alias("cust"), *([clean.fraud_flag(c("is_fraud?")).alias("is_fraud")] if "is_fraud?" in df.columns else []),
    )
    return typed.withColumn("time_delta_s", time_delta()) if gaps else typed


def account_order() -> Window:
    """A minute holds several transactions at times, so row_id always ends the order."""
    return Window.partitionBy("user", "card").orderBy("time_full", "row_id")


def time_delta() -> Column:
    gap = F.timestamp_diff("SECOND", F.lag("time_full").over(account_order()), F.col("time_full"))
    return F.greatest(F.coalesce(gap, F.lit(0)), F.lit(0)).cast("long")


def placed(df: DataFrame, long_accounts: bool | None = None) -> DataFrame:
    """Adds ``pos``, a row's place from 0 in the order of its account.

    A window by account does it where accounts fit in a task, without a shuffle if the table is stored by account; where accounts are long, ``placed_by_day``.
    If ``long_accounts`` is not given, a first job counts the rows of accounts: more than ``MOST_ROWS`` make a long one.
    """
    if long_accounts is None:
        long_accounts = (df.groupBy("user", "card").count().agg(F.max("count")).first()[0] or 0) > MOST_ROWS
    return placed_by_day(df) if long_accounts else df.withColumn("pos", F.row_number().over(account_order()) - 1)


def placed_by_day(df: DataFrame) -> DataFrame:
    """``placed`` for accounts of any length: ``pos`` is a row's place within the account's day and the rows of the account's days before.

    No task holds more of an account than a day, however long its history; what is summed up by account is a row a day. ``df`` is read twice, so it must
    give the same rows again.
    """
    time = F.col("time_full")
    # Of a time with a zone the day is counted from 1970: clocks that go back over midnight would put a later row on an earlier date.
    day = F.to_date(time) if df.schema["time_full"].dataType == TimestampNTZType() else F.floor(F.unix_seconds(time) / 86400)
    # One struct, as structs with nulls in them are equal.
    keyed = df.withColumn("_day", F.struct("user", "card", day.alias("day")))
    earlier = Window.partitionBy("_day.user", "_day.card").orderBy("_day.day").rowsBetween(Window.unboundedPreceding, -1)
    days = keyed.groupBy("_day").agg(F.count("*").alias("_n")).select("_day", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_day").orderBy("time_full", "row_id")) - 1
    return keyed.withColumn("_within", within).join(days, "_day").withColumn("pos", F.col("_before") + F.col("_within")).drop("_day", "_before", "_within")


def default_steps(buckets: int = 2000, time_bins: int = 0, amount_strategy: str = "fixed", amount_bins: int = 10) -> list[Step]:
    """The twelve steps; amounts have fixed bins, or ``amount_bins`` learned ones by 'quantile', 'uniform' or 'kmeans'."""
    fixed = amount_strategy == "fixed"
    # The steps' prefixes, ranges and widths, in the order of their tokens.
    steps = [
        FixedInt("amt_val", "amt_val", "AMT", 0, 6) if fixed else LearnedBins("amt_val", "amount", "AMT", amount_bins, amount_strategy), HashBucket("merch_hash", "merch_hash", "MERCH", buckets), Ranges("mcc_int", "mcc_int", "CAT", INDUSTRIES),
        Mapping("mcc_str", "mcc_str", "MCC", sorted(map(str, KNOWN_MCCS)), None, "-1"), FixedInt("hour", "hour", "HOUR", 0, 23, 2), FixedInt("dow", "dow", "DOW", 0, 6),
        FixedInt("month", "month", "MONTH", 1, 12, 2), FixedInt("card", "card", "CARD", 0, 9), Mapping("chip_upper", "chip_upper", "CHIP", [], CHIPS, "UNK"),
        FixedInt("zip3", "zip3", "ZIP3", 0, 999, 3), Mapping("state_clean", "state_clean", "STATE", sorted(STATES), None, "XX"), FixedInt("cust", "cust", "CUST", 0, 2999),
    ]
    return [*steps, TimeDelta("time_delta_s", "time_delta_s", "TDIF", time_bins)] if time_bins else steps


class TokenPipeline:
    """Steps in order with one vocabulary: five special tokens, then each step's.

    Ids are dense and distinct; ``compatible`` gives the older layout, in which a step whose numbers begin at 1 leaves an id unused
    and shares its last one with the next step.
    """

    def __init__(self, steps: list[Step] | None = None, compatible: bool = False):
        self.steps, self.compatible, self.fitted = steps or default_steps(), compatible, False
        if len({s.name for s in self.steps}) < len(self.steps):
            raise ValueError("two steps have one name")

    def add_step(self, step: Step, *columns: str) -> TokenPipeline:
        """Adds a step at the end. With several ``columns`` it is one step for each, under the name of all and its own, with a vocabulary of its own."""
        key = "_".join(columns)
        new = [replace(step, name=key if len(columns) == 1 else f"{key}.{c}", column=c) for c in columns] or [step]
        names = [s.name for s in (*self.steps, *new)]
        if len(set(names)) < len(names):
            raise ValueError("two steps have one name")
        self.steps, self.fitted = [*self.steps, *new], False
        return self

    def vocab_size(self) -> int:
        """How many different tokens there are."""
        return len({r[0] for r in self.vocab_rows()})

    def fit(self, df: DataFrame | None = None) -> TokenPipeline:
        """Learns from ``df``, if it is given, what the steps learn, all in two scans at most (see ``fit_steps``), and numbers the vocabulary."""
        if df is not None:
            fit_steps(df, self.steps)
        self.offsets, at = {}, len(SPECIALS)
        for s in self.steps:
            self.offsets[s.name] = at + (s.first_local() if self.compatible else 0)
            at += len(s.vocab())
        self.fitted = True
        return self

    def vocab_rows(self) -> list[tuple[str, int, str, int]]:
        rows = [(t, k, "special", k) for k, t in enumerate(SPECIALS)]
        return rows + [(t, self.offsets[s.name] + k, s.name, k) for s in self.steps for k, t in enumerate(s.vocab())]

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.vocab_rows(), "token string, id int, step string, local_id int")

    def check(self) -> None:
        if not self.fitted:
            raise RuntimeError("fit the pipeline first")

    def transform(self, df: DataFrame, *keep: str) -> DataFrame:
        self.check()
        require(df, [s.column for s in self.steps])
        return df.select(*keep, *(s.token().alias(s.name) for s in self.steps))

    def ids(self) -> Column:
        """The row's token ids, worked out from each step's own formula: no lookup, no join."""
        self.check()
        return F.array(*((s.index() + self.offsets[s.name]).cast("int") for s in self.steps))

    def encode(self, df: DataFrame, length: int, special: bool = True, keep: str = "row_id") -> DataFrame:
        """Ids between bos and eos, padded or cut to ``length``; eos goes in only if there is room."""
        ids = F.concat(F.array(F.lit(1)), self.ids(), F.array(F.lit(2))) if special else self.ids()
        return df.select(keep, F.slice(F.concat(ids, F.array_repeat(F.lit(0), length)), 1, length).alias("input_ids"))

    def text(self) -> Column:
        """The row's tokens with a space between. Raises if a token holds white space, as a reader of the text could not tell it from two."""
        for s in self.steps:
            if bad := next((t for t in s.vocab() if any(c.isspace() for c in t)), None):
                raise ValueError(f"token {bad!r} of step {s.name} holds white space; clean the column's values first")
        return F.concat_ws(" ", *(s.token() for s in self.steps))

    def corpus(self, df: DataFrame, chunk: int = 315, long_accounts: bool | None = None) -> DataFrame:
        """(user, card, chunk_id, n_txn, text): an account's transactions in order, ``chunk`` to a line.

        Lines are collected by account and chunk, so no group is longer than ``chunk``; for ``long_accounts`` see ``placed``.
        """
        rows = placed(df.select("user", "card", "row_id", "time_full", self.text().alias("line")), long_accounts)
        rows = rows.withColumn("chunk_id", F.floor(F.col("pos") / chunk).cast("int"))
        lines = rows.groupBy("user", "card", "chunk_id").agg(F.count("*").cast("int").alias("n_txn"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("l"))
        body = F.array_join(F.col("l.line"), " <sep> ")
        return lines.select("user", "card", "chunk_id", "n_txn", F.concat(F.lit("<bos> "), body, F.lit(" <eos>")).alias("text"))


def encode_text(df: DataFrame, vocab: DataFrame, key: list[str], text: str = "text", length: int | None = None, most: int = 1_000_000) -> DataFrame:
    """(key, input_ids) of white-space separated words, unknown ones as 4; with ``length`` cut and padded to it.

    The vocabulary, of ``most`` tokens at most, goes to the tasks as a table, so no word is shuffled.
    """
    rows = vocab.select("token", "id").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the vocabulary has more than {most} tokens")
    ids = {r["token"]: r["id"] for r in rows}

    @F.pandas_udf("array<int>")
    def look_up(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [ids.get(w, 4) for w in t.split()] if t is not None else [])

    found = df.select(*key, look_up(F.col(text)).alias("input_ids"))
    return found if length is None else found.withColumn("input_ids", F.slice(F.concat("input_ids", F.array_repeat(F.lit(0), length)), 1, length))


def load_corpus(spark: SparkSession, path: str, vocab: DataFrame, length: int, compatible: bool = False) -> DataFrame:
    """(input_ids, attention_mask, labels) of each line of a corpus: encoded, cut and padded to ``length``."""
    rows = clm_examples(encode_text(read_corpus(spark, path), vocab, [], length=length), length, compatible)
    return rows.withColumn("attention_mask", F.transform("input_ids", lambda x: (x != 0).cast("int"))).select("input_ids", "attention_mask", "labels")


def decode(df: DataFrame, pipeline: TokenPipeline, key: str, ids: str = "input_ids") -> DataFrame:
    """(key, text) without padding and unknown ids; of tokens with one id the last counts. The names are one array, indexed by id.

    Tokens may hold spaces; the character U+0000 in one raises a ValueError.
    """
    rows = pipeline.vocab_rows()
    names = [""] * (max(r[1] for r in rows) + 1)
    if any(APART in token for token, *_ in rows):
        raise ValueError("a token holds the character U+0000")
    for token, k, _, _ in rows:
        names[k] = token if k else ""
    at = lambda x: F.try_element_at(F.split(F.lit(APART.join(names)), APART), x + 1)
    return df.select(key, F.array_join(F.filter(F.transform(ids, at), lambda x: x.isNotNull() & (x != "")), " ").alias("text"))


def clm_examples(df: DataFrame, length: int, compatible: bool = False) -> DataFrame:
    """Labels are the ids, -100 on padding (0 if ``compatible``); ids are cut and padded to ``length``."""
    ids = F.slice(F.concat("input_ids", F.array_repeat(F.lit(0), length)), 1, length)
    labels = ids if compatible else F.transform(ids, lambda x: F.when(x == 0, -100).otherwise(x))
    return df.withColumns({"input_ids": ids, "labels": labels})


def context_capacity(context: int, tokens_per_row: float) -> int:
    """How many rows fit in a context, a separator after each."""
    return int(context // (tokens_per_row + 1))


def token_usage(df: DataFrame, pipeline: TokenPipeline) -> DataFrame:
    """(token, id, step, local_id, n): the vocabulary, and how many rows of ``df`` have each token; special tokens are in no row.

    Tokens are counted by step where the rows are; the vocabulary, a table of the driver, is joined with the counts, which are no more.
    """
    pipeline.check()
    pairs = F.explode(F.array(*(F.struct(F.lit(s.name).alias("step"), s.token().alias("token")) for s in pipeline.steps)))
    counts = df.select(pairs.alias("p")).groupBy("p.step", "p.token").agg(F.count("*").alias("n"))
    return pipeline.vocab_table(df.sparkSession).join(counts, ["step", "token"], "left").select("token", "id", "step", "local_id", F.coalesce("n", F.lit(0)).alias("n"))


def raw_text(raw: DataFrame) -> Column:
    """A raw transaction's fields as a general tokenizer would get them: amount, merchant, code, date, time, card, way, ZIP, state and user, with commas between."""
    date = F.concat_ws("-", F.col("year"), F.lpad(F.col("month").cast("string"), 2, "0"), F.lpad(F.col("day").cast("string"), 2, "0"))
    fields = [*("amount", "merchant_name", "mcc"), date, *("time", "card", "use_chip", "zip", "merchant_state", "user")]
    return F.concat_ws(", ", *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in fields))


def general_tokens(text: Column, vocabulary: str, pattern: str) -> Column:
    """How many tokens a byte-level vocabulary of ranks (a .tiktoken file) makes of each text, in Arrow batches; a null has none. The file must lie at that path on every machine."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        found = rank_encoder(vocabulary, pattern).encode_ordinary_batch(texts.fillna("").tolist(), num_threads=1)
        return pd.Series([len(ids) for ids in found], dtype="int32")

    return count(text)


@functools.cache
def rank_encoder(vocabulary: str, pattern: str):
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding(vocabulary, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_efficiency(raw: DataFrame, typed: DataFrame, pipeline: TokenPipeline, vocabulary: str, pattern: str, context: int = 4096) -> DataFrame:
    """One row: tokens of all transactions by the pipeline and by a general vocabulary, the most in one, the ratio, and how many average transactions a context holds with a separator after each.

    The pipeline's tokens are counted in its texts, the general ones in the raw fields' (``raw_text``); no table of no rows has a ratio.
    """
    own = typed.agg(F.count("*").alias("transactions"), *(f(F.size(F.split(pipeline.text(), " "))).alias(n) for f, n in ((F.sum, "tokens"), (F.max, "most"))))
    names = normalize_names(raw)
    counted = names.select(general_tokens(raw_text(names), vocabulary, pattern).alias("n"))
    general = counted.agg(F.sum("n").alias("tokens_general"), F.max("n").alias("most_general"))
    fit = lambda c: F.floor(F.try_divide(F.lit(context), F.try_divide(c, "transactions") + 1))
    both = own.unionByName(general, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in both.columns)).select(
        "transactions", "tokens", "most", "tokens_general", "most_general", F.try_divide("tokens_general", "tokens").alias("ratio"),
        fit("tokens").alias("rows_in_context"), fit("tokens_general").alias("rows_in_context_general"),
    )
