"""Golden rows of the token steps and the pipeline."""

import math

import pytest
from pyspark.sql import functions as F

from swipeline.functions import clean
from swipeline.functions.values import KNOWN_MCCS
from swipeline.operators import tokens as tk
from swipeline.operators.steps import FixedInt, LearnedBins, Mapping, TimeDelta, from_state
from swipeline.sources import io

BASE = {
    "row_id": 1, "User": 1001, "Card": 0, "Year": 2025, "Month": 1, "Day": 15, "Time": "09:32", "Amount": "$42.75", "Use Chip": "Chip Transaction",
    "Merchant Name": "3527213246127876953", "Merchant City": "X", "Merchant State": "CA", "Zip": "95113.0", "MCC": 5411, "Is Fraud?": "No",
}


def frame(spark, *changes):
    rows = [tuple((BASE | {"row_id": k} | c)[n] for n in BASE) for k, c in enumerate(changes)]
    return spark.createDataFrame(rows, "row_id long, " + io.TXN_RAW)


def tokens(spark, *changes):
    pipeline = tk.TokenPipeline().fit()
    return [r["t"] for r in tk.preprocess(frame(spark, *changes)).select("row_id", pipeline.text().alias("t")).orderBy("row_id").collect()]


def test_golden_row(spark):
    got = tokens(spark, {})[0].split()
    assert got[:1] + got[2:] == "AMT_1 CAT_RETAIL MCC_5411 HOUR_09 DOW_2 MONTH_01 CARD_0 CHIP_CHIP ZIP3_951 STATE_CA CUST_1001".split()
    assert got[1].startswith("MERCH_")


def test_amounts(spark):
    texts = ["$9.99", "$10", "$49.99", "$50", "$100", "$500", "$1,000.00", "$5000", "$-25.00", "$8500.00", "$0.50"]
    assert [t.split()[0][-1] for t in tokens(spark, *({"Amount": a} for a in texts))] == list("01123456060")[:8] + ["0", "6", "0"]
    buckets = spark.createDataFrame([(10.0,), (-25.0,), (None,), (5000.5,)], "a double").select(clean.amount_bucket(F.col("a"))).collect()
    assert [b[0] for b in buckets] == ["<$10", "Unknown", "Unknown", ">$5k"]


def test_codes_states_zips_and_clipping(spark):
    codes = [0, 1499, 1500, 2999, 3299, 3300, 9999, 10000, None]
    assert [t.split()[2] for t in tokens(spark, *({"MCC": c} for c in codes))] == [f"CAT_{x}" for x in "AGRICULTURAL AGRICULTURAL CONTRACTED CONTRACTED AIRLINES CAR_RENTAL GOVERNMENT GENERAL GENERAL".split()]
    assert [t.split()[3] for t in tokens(spark, *({"MCC": c} for c in KNOWN_MCCS[1:]), {"MCC": 1234})] == [f"MCC_{c}" for c in KNOWN_MCCS[1:]] + ["MCC_-1"]
    assert [t.split()[10] for t in tokens(spark, *({"Merchant State": x} for x in (" tx", "Italy", None, "", "ONLINE")))] == ["STATE_TX", "STATE_XX", "STATE_XX", "STATE_XX", "STATE_ONLINE"]
    assert [t.split()[9] for t in tokens(spark, *({"Zip": x} for x in ("2134.0", "501.0", "7", None)))] == ["ZIP3_213", "ZIP3_501", "ZIP3_007", "ZIP3_000"]
    far = tokens(spark, {"Card": 12, "User": 5000})[0].split()
    assert (far[7], far[11]) == ("CARD_9", "CUST_2999")


def test_time_bins(spark):
    rows = spark.createDataFrame([(0,), (clean.HORIZON,), (10**10,), (-5,)], "x long")
    assert [r[0] for r in rows.select(TimeDelta("x", "x").token()).collect()] == ["TDIF_1", "TDIF_31", "TDIF_31", "TDIF_1"]
    assert clean.HORIZON == 315569519 and math.isclose(math.log(clean.HORIZON + 1), 19.569889564325276)


def test_encode(spark):
    df = tk.preprocess(frame(spark, {}))
    pipeline = tk.TokenPipeline().fit()
    ids = {n: pipeline.encode(df, n).first()["input_ids"] for n in (16, 13, 8)}
    assert ids[16][0] == 1 and ids[16][13:] == [2, 0, 0] and ids[13] == ids[16][:13] and ids[8] == ids[16][:8]
    names = {r[1]: r[0] for r in pipeline.vocab_rows()}
    assert " ".join(names[i] for i in ids[16][1:13]) == tokens(spark, {})[0]


def test_layouts():
    dense, old = (dict((r[0], r[1]) for r in tk.TokenPipeline(compatible=c).fit().vocab_rows()) for c in (False, True))
    assert len(dense) == len(set(dense.values())) == 6251 and max(dense.values()) == 6250
    assert old["MONTH_12"] == old["CARD_0"] == 2179 and 2167 not in old.values() and len(set(old.values())) == 6250


def test_decode_gives_the_later_of_two_tokens(spark):
    rows = spark.createDataFrame([(1, [1, 2179, 0, 99999])], "row_id int, input_ids array<int>")
    assert tk.decode(rows, tk.TokenPipeline(compatible=True).fit(), "row_id").first()["text"] == "<bos> CARD_0"


def test_states_round_trip(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 9.0)], "s string, x double")
    for step in (Mapping("s", "s", "S", learned=True).fit(df), LearnedBins("x", "x", "X", 2).fit(df), *tk.default_steps(time_bins=8)):
        assert from_state(step.state()) == step
    assert Mapping("s", "s", "S", learned=True).fit(df).vocab() == ["S_a", "S_b", "S_UNK"]


def test_errors(spark):
    with pytest.raises(RuntimeError):
        tk.TokenPipeline().transform(spark.range(1))
    with pytest.raises(ValueError, match="missing columns"):
        tk.preprocess(spark.range(1).withColumnRenamed("id", "user"))
    with pytest.raises(ValueError):
        tk.TokenPipeline([TimeDelta("a", "x"), TimeDelta("a", "y")])
    assert tk.context_capacity(4096, 12) == 315


def test_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("User ,Card,Year,Month,Day,Time,Amount,Use Chip,Merchant Name,Merchant City,Merchant State,Zip,MCC,Is Fraud?\n7,1,2020,2,3,04:05,$6.00,Chip Transaction,9,Y,CA,1.0,5411,No\n")
    assert io.scan_csv(spark, str(tmp_path / "t.csv")).first()["User"] == 7
    corpus = tk.TokenPipeline().fit().corpus(tk.preprocess(frame(spark, {}, {})), 1)
    io.write_corpus(corpus, str(tmp_path / "c"))
    assert io.read_corpus(spark, str(tmp_path / "c")).count() == 2 and not io.exists(spark, str(tmp_path / "none"))
    io.write_metadata(spark, {"dim": 3, "name": "x"}, str(tmp_path / "m"))
    assert io.read_metadata(spark, str(tmp_path / "m")) == {"dim": 3, "name": "x"}
    io.write_embeddings(spark.createDataFrame([(1, 0, [1.0, 2.0])], "row_id int, label int, embedding array<double>"), str(tmp_path / "e"))
    assert io.read_embeddings(spark, str(tmp_path / "e"), 2, 1).count() == 1
    with pytest.raises(ValueError):
        io.read_embeddings(spark, str(tmp_path / "e"), 3)


def test_csv_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text(" Card,User ,Time,Year,Month,Day,Amount,Use Chip,Merchant Name,Merchant City,Merchant State,Zip,MCC,Is Fraud?,More\n1,7,04:05,2020,2,3,$6.00,Chip Transaction,9,Y,CA,1.0,5411,No,x\n")
    row = io.scan_csv(spark, str(tmp_path / "t.csv")).first()
    assert (row["User"], row["Card"], row["Time"], row["MCC"]) == (7, 1, "04:05", 5411) and len(row) == 14
    (tmp_path / "u.csv").write_text("User,Card\n1,2\n")
    with pytest.raises(ValueError, match="missing columns"):
        io.scan_csv(spark, str(tmp_path / "u.csv"))


def test_corpus_lines_lose_all_white_space(spark, tmp_path):
    (tmp_path / "c.txt").write_text("a b\t\n\t\n \t c\u00a0\n\n")
    assert [r.text for r in io.read_corpus(spark, str(tmp_path / "c.txt")).collect()] == ["a b", "c"]
    states = spark.createDataFrame([("\tca\n",), ("\t",)], "s string")
    assert [r[0] for r in states.select(clean.state_clean(F.col("s"))).collect()] == ["CA", "XX"]


def test_wide_and_negative_numbers(spark):
    step = FixedInt("x", "x", "N", -5, 150, 2)
    rows = spark.createDataFrame([(150,), (-5,), (7,), (999,)], "x int")
    got = [r["t"] for r in rows.select(step.token().alias("t")).collect()]
    assert got == ["N_150", "N_-5", "N_07", "N_150"] and set(got) <= set(step.vocab())


def test_learned_mapping_without_data_and_with_too_many(spark):
    df = spark.createDataFrame([("b",), (None,)], "s string")
    step = Mapping("s", "s", "S", learned=True)
    assert [tuple(r) for r in df.select(step.token(), step.index()).collect()] == [("S_b", 0), ("S_UNK", 0)] and step.vocab() == ["S_UNK"]
    with pytest.raises(ValueError, match="more than 3"):
        Mapping("id", "id", "S", learned=True, most=3).fit(spark.range(9))


def test_steps_added_and_learned_amounts(spark):
    df = tk.preprocess(frame(spark, *({"Amount": f"${k}.00"} for k in range(20))))
    pipeline = tk.TokenPipeline(tk.default_steps(amount_strategy="quantile", amount_bins=4)).add_step(FixedInt("", "", "X", 0, 9), "hour", "dow").fit(df)
    assert [s.name for s in pipeline.steps[-2:]] == ["hour_dow.hour", "hour_dow.dow"] and pipeline.offsets["hour_dow.dow"] == pipeline.offsets["hour_dow.hour"] + 10
    assert pipeline.vocab_size() == len(pipeline.vocab_rows()) - 10  # the two columns' tokens read alike
    assert sorted(r[0] for r in pipeline.transform(df).select("amt_val").collect()) == sorted(f"AMT_{k // 5}" for k in range(20))
    with pytest.raises(ValueError):
        pipeline.add_step(FixedInt("", "", "X", 0, 9), "hour", "dow")


def test_options_of_preprocess(spark):
    df = frame(spark, {"Amount": "no number", "Zip": "501.0"})
    row = tk.preprocess(df, lenient=True, zip_width=5).first()
    assert row["amount"] is None and row["amt_val"] == 0 and row["zip3"] == 5


def test_load_corpus_and_text_lengths(spark, tmp_path):
    pipeline = tk.TokenPipeline().fit()
    vocab = pipeline.vocab_table(spark)
    (tmp_path / "c.txt").write_text("<bos> AMT_1 what <eos>\n\n  AMT_0  \n")
    rows = sorted(tuple(map(list, r)) for r in tk.load_corpus(spark, str(tmp_path / "c.txt"), vocab, 3).collect())
    assert rows == [[[1, 6, 4], [1, 1, 1], [1, 6, 4]], [[5, 0, 0], [1, 0, 0], [5, -100, -100]]] or rows == [([1, 6, 4], [1, 1, 1], [1, 6, 4]), ([5, 0, 0], [1, 0, 0], [5, -100, -100])]
    text = spark.createDataFrame([(1, "<bos> AMT_1"), (2, None)], "k int, text string")
    assert [r.input_ids for r in tk.encode_text(text, vocab, ["k"], length=4).orderBy("k").collect()] == [[1, 6, 0, 0], [0, 0, 0, 0]]


def test_splits_and_results_written_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "row_id int, split string")
    io.write_splits(df, str(tmp_path / "s"))
    assert sorted(r.row_id for r in spark.read.parquet(str(tmp_path / "s" / "split=train")).collect()) == [1, 3]
    made = []
    for _ in range(2):
        out = io.once(spark, str(tmp_path / "o"), lambda: made.append(1) or df)
        assert out.count() == 3
    assert made == [1]
    assert io.first_of(df, ["rowid", "row_id"]) == "row_id" and io.strip_names(df.toDF(" a ", "b")).columns == ["a", "b"]
