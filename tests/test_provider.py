"""Plugged-in models, row by row in plain numpy, and measured token counts."""

import io

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from swipeline.operators import tokens as tk
from swipeline.operators.provider import CausalAttention, embed_with, load_weights
from swipeline.plans import queries
from swipeline.sources import fixtures

SF = "/root/testdata/sf0.001"


def plain_states(ids, a):
    """The states of one row without padding, a position at a time."""
    dim, out = a["tokens"].shape[1], []
    x = [a["tokens"][k] + np.array([np.sin(p / 10000.0 ** (d / dim)) for d in range(dim)]) for p, k in enumerate(ids)]
    for p in range(len(ids)):
        score = np.array([x[p] @ a["query"] @ (x[q] @ a["key"]) / dim**0.5 for q in range(p + 1)])
        share = np.exp(score - score.max())
        out.append(x[p] + sum(s * (x[q] @ a["value"]) for q, s in enumerate(share / share.sum())))
    return np.array(out)


def plain(ids, a, how):
    states = plain_states(ids, a)
    return states[-1] if how == "last" else states.mean(axis=0)


ROWS = [("a", [3, 1, 4]), ("b", [1]), ("c", [5, 9, 2, 6, 5, 3, 5, 8, 9, 7, 9]), ("d", [2, 7, 1, 8]), ("e", [2, 7, 1, 8, 2, 8, 1, 8])]


@pytest.mark.parametrize("how", ["mean", "last"])
def test_provider_is_the_model_row_by_row(spark, how):
    df = spark.createDataFrame(ROWS, "seq string, input_ids array<int>").repartition(3)
    model = CausalAttention(10, 6)
    a = model.arrays()
    cut = {r.seq: r.embedding for r in embed_with(df, model, how, 4, batch=2, key="seq").collect()}
    whole = {r.seq: r.embedding for r in embed_with(df, model, how, 4, True, 2, key="seq").collect()}
    for key, ids in ROWS:
        assert np.allclose(cut[key], plain(ids[:4], a, how), atol=1e-5)
        windows = [ids[k : k + 4] for k in range(0, len(ids), 4)]
        want = plain(ids[-4:], a, "last") if how == "last" else np.concatenate([plain_states(w, a) for w in windows]).mean(axis=0)
        assert np.allclose(whole[key], want, atol=1e-5)


def test_provider_of_odd_rows(spark):
    """Null, empty and all-padding rows are padding; the key and ids may have any name."""
    df = spark.createDataFrame([(1, None, 2), (2, [], 2), (3, [0, 0], 2), (4, [5, 0, 0], 2)], "k long, `x` array<long>, embedding int")
    model = CausalAttention(10, 4)
    for windows in (False, True):
        got = {r.k: r.embedding for r in embed_with(df, model, "mean", 3, windows, ids="x", key="k").collect()}
        assert got[1] == got[2] == got[3] == [0.0] * 4 and np.allclose(got[4], plain([5], model.arrays(), "mean"), atol=1e-6)
    assert embed_with(df.limit(0), model, "last", 3, ids="x", key="k").count() == 0
    with pytest.raises(ValueError):
        embed_with(df, model, "median")


def test_weights_from_a_folder(spark, tmp_path):
    arrays, data = CausalAttention(10, 5, 7).arrays(), io.BytesIO()
    np.savez(data, **arrays)
    (tmp_path / "model.npz").write_bytes(data.getvalue())
    model = CausalAttention(weights=load_weights(spark, str(tmp_path)))
    df = spark.createDataFrame(ROWS, "seq string, input_ids array<int>")
    got = {r.seq: r.embedding for r in embed_with(df, model, "last", 16, key="seq").collect()}
    assert all(np.allclose(got[k], plain(ids, arrays, "last"), atol=1e-5) for k, ids in ROWS)
    with pytest.raises(ValueError, match="bytes of weights"):
        load_weights(spark, str(tmp_path), 100)


def test_attention_over_the_transactions(spark):
    ids = {r.row_id: [k for k in r.input_ids if k] for r in queries.fitted().encode(queries.typed(spark, SF), 16).collect()}
    got = {r.row_id: r.embedding for r in queries.QUERIES["embed_attention"](spark, SF).collect()}
    a = CausalAttention(queries.fitted().vocab_size()).arrays()
    assert got.keys() == ids.keys() and all(np.allclose(got[k], plain(ids[k], a, "last"), atol=1e-4) for k in sorted(ids)[:60])


def test_token_efficiency_is_the_tokenizers_count(spark):
    row = queries.QUERIES["token_efficiency"](spark, SF).first()
    names = tk.normalize_names(fixtures.txn(spark, SF))
    texts = [r.t for r in names.select(tk.raw_text(names).alias("t")).collect()]
    ranks = tk.rank_encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    assert isinstance(ranks, tiktoken.Encoding)
    counts = [len(ranks.encode_ordinary(t)) for t in texts]
    assert (row.transactions, row.tokens, row.most, row.tokens_general, row.most_general) == (len(texts), 12 * len(texts), 12, sum(counts), max(counts))
    assert row.ratio == pytest.approx(sum(counts) / (12 * len(texts)))
    assert (row.rows_in_context, row.rows_in_context_general) == (315, int(4096 // (sum(counts) / len(counts) + 1)))
    assert "$" in texts[0] and texts[0].count(", ") >= 9
    none = tk.token_efficiency(fixtures.txn(spark, SF).limit(0), queries.typed(spark, SF).limit(0), queries.fitted(), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).first()
    assert none.transactions == 0 and none.ratio is None


def test_decode_keeps_tokens_with_spaces(spark):
    steps = [tk.Mapping("city", "city", "CITY", learned=True), tk.FixedInt("h", "h", "H", 0, 9)]
    df = spark.createDataFrame([(1, "New York", 3), (2, "Rome", 5), (3, None, 1)], "row_id long, city string, h int")
    pipeline = tk.TokenPipeline(steps).fit(df)
    got = {r.row_id: r.text for r in tk.decode(pipeline.encode(df, 6), pipeline, "row_id").collect()}
    assert got == {1: "<bos> CITY_New York H_3 <eos>", 2: "<bos> CITY_Rome H_5 <eos>", 3: "<bos> CITY_UNK H_1 <eos>"}
    with pytest.raises(ValueError, match="white space"):
        pipeline.text()
    with pytest.raises(ValueError, match="U.0000"):
        odd = tk.TokenPipeline([tk.Mapping("city", "city", "CITY", ["a\x00b"])]).fit()
        tk.decode(df.withColumn("input_ids", F.array(F.lit(5))), odd, "row_id")
