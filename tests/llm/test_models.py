"""Toxicity and quality classifiers: held-out figures, what the fit may not see, and edge cases."""

import zlib

import llm_brute as brute
import numpy as np
import pytest
import zstandard

from swipeline.llm import queries
from swipeline.llm.labelled import training_sample
from swipeline.llm.quality import fit as fit_quality
from swipeline.llm.quality import quality
from swipeline.llm.toxicity import fit as fit_toxicity
from swipeline.llm.toxicity import ngram_buckets, toxicity

SF = "/root/testdata/sf0.01"


def auroc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    return float((score[y == 1][:, None] > score[y == 0][None]).mean() + (score[y == 1][:, None] == score[y == 0][None]).mean() / 2)


@pytest.mark.parametrize(("name", "label", "cut", "least"), [("op5_toxicity", "toxic", 0.5, 0.95), ("op7_quality", "quality", 0.3, 0.9)])
def test_held_out(spark, name, label, cut, least):
    rows = {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= cut)
    held = [(rows[i].score, y) for i, y in labels.items() if y is not None and i in rows and rows[i].held_out]
    score, y = zip(*held, strict=True)
    assert auroc(score, y) >= least
    assert np.mean((np.array(score) >= cut) == np.array(y)) >= 0.85


def labelled(spark, n=60):
    """The held-out fold's labels are the wrong way round: a fit that saw them would suffer."""
    rows = [(k, f"you {'stupid awful idiot' if k % 3 == 0 else 'kind lovely friend'} number{k} " * 4, "s") for k in range(n)]
    labels = [(k, int((k % 3 == 0) != (zlib.crc32(str(k).encode()) % 5 == 0))) for k in range(n)]
    return brute.table(spark, rows), spark.createDataFrame([(k, y, y) for k, y in labels] + [(None, 1, 1), (1, None, None)], "doc_id long, toxic int, quality int")


@pytest.mark.parametrize("classify", [toxicity, quality])
def test_fit_and_edges(spark, classify):
    docs, labels = labelled(spark)
    edges = brute.table(spark, [(None if i is None else 1000 + i, t, s) for i, t, s in brute.edge_rows()])
    both = docs.unionByName(edges)
    out = classify(both, labels)
    assert {*both.columns} | {"held_out", "score", "predicted"} == {*out.columns}
    rows = out.collect()
    assert len(rows) == both.count() and all(0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.doc_id is not None and r.doc_id < 1000]
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 0) for r in own]) > 0.95
    empty = {r.score for r in rows if not r.text}
    assert len(empty) == 1
    assert [r.held_out for r in rows if r.doc_id is None] == [False, False]
    assert classify(both.filter("false"), labels).count() == 0


@pytest.mark.parametrize("classify", [toxicity, quality])
def test_one_class_or_no_labels(spark, classify):
    docs, labels = labelled(spark, 12)
    for few in (labels.filter("toxic = 0"), labels.filter("false")):
        scores = {r.score for r in classify(docs, few).collect()}
        assert len(scores) == 1 and 0 < scores.pop() <= 0.5


def test_quality_score_is_the_difference(spark):
    """Against a plain version of the sizes and the curve, on 60 rows: two compressors, the text in blocks, one number."""
    docs, labels = labelled(spark)
    model = fit_quality(docs, labels)
    packers = [zstandard.ZstdCompressor(level=model.level, dict_data=zstandard.ZstdCompressionDict(raw), write_checksum=False, write_content_size=False, write_dict_id=False) for raw in (model.good, model.bad)]
    for r in quality(docs, labels).collect():
        data = r.text.encode()
        good, bad = (sum(len(p.compress(data[k : k + model.block])) for k in range(0, len(data), model.block)) for p in packers)
        assert r.score == pytest.approx(1 / (1 + np.exp(-((bad - good) / len(data) * model.slope + model.bias))), abs=1e-9)
    assert model.slope > 0 and model.difference("") == 0


def test_toxicity_fit_against_plain_counts(spark):
    """The log-count ratios of 60 rows, counted anew in plain Python, and a score that adds up the gains of the n-grams found."""
    docs, labels = labelled(spark)
    model = fit_toxicity(docs, labels, orders=(3,), bits=14)
    y = {r.doc_id: r.toxic for r in labels.collect() if r.doc_id is not None and r.toxic is not None and zlib.crc32(str(r.doc_id).encode()) % 5}
    counts = np.zeros((2, 1 << 14))
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i, c in y.items():
        padded = f" {texts[i].lower()} "
        own = set(ngram_buckets(texts[i], (3,), 14).tolist())
        assert 0 < len(own) <= len({padded[k : k + 3] for k in range(len(padded) - 2)})
        for b in own:
            counts[c, b] += 1
    share = (counts + 1) / (counts + 1).sum(axis=1, keepdims=True)
    used = np.flatnonzero(model.feature >= 0)
    assert np.allclose(model.ratio[model.feature[used]], np.log(share[1] / share[0])[used], atol=1e-5)
    for i, text in texts.items():
        found = {model.feature[b] for b in ngram_buckets(text, (3,), 14).tolist()} - {-1}
        z = sum(float(model.gain[f]) for f in found) + model.bias
        assert model.score(text) == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-6)


def test_repeated_documents_count_once(spark):
    """A document that is there very often is one row of the sample."""
    docs, labels = labelled(spark)
    many = docs.unionByName(docs.filter("doc_id = 1").crossJoin(spark.range(300)).select(*docs.columns))
    sample, n = training_sample(many, labels, "quality", 8000)
    assert sample.count() == sum(n) == labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").count() - sum(zlib.crc32(str(k).encode()) % 5 == 0 for k in range(60))


def test_reruns_agree(spark):
    docs, labels = labelled(spark)
    first, second = (sorted((r.doc_id, r.score) for r in toxicity(docs, labels).collect()) for _ in range(2))
    assert first == second


def test_ngrams_cover_whole_text():
    text = "abc " * 5000
    assert len(ngram_buckets(text, (3,), 18)) == len(text)
    assert len(set(ngram_buckets("Hello", (3,), 18)) - set(ngram_buckets("hello", (3,), 18))) == 0
    assert len(ngram_buckets("", (3,), 18)) == 0
    assert len(ngram_buckets("ab", (1, 2), 18)) == 4 + 3
