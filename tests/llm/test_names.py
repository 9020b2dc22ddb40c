"""Columns of any name, doc_ids at both ends of the long range, and nodes with very many edges."""

import random

import llm_brute as brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from swipeline.llm.best_fit import best_fit_pack
from swipeline.llm.codes import product_codes
from swipeline.llm.common import components, join_classes
from swipeline.llm.exact_dedup import exact_dedup
from swipeline.llm.hnsw import embedding_dedup
from swipeline.llm.licenses import license_scan
from swipeline.llm.mixing import mix, mix_documents
from swipeline.llm.packing import pack
from swipeline.llm.quality import quality
from swipeline.llm.simhash import keep_one, simhash_dedup
from swipeline.llm.substring import substring_dedup
from swipeline.llm.token_counts import TokenRollup, document_counts
from swipeline.llm.toxicity import toxicity
from swipeline.llm.whitening import whiten

ODD = ["_", "c.d", "a`b", "_aside", "_0", "_4", "_c0", "none", "row", "_text.x"]
LOW, HIGH = -(2**63), 2**63 - 1


def odd(df):
    """``df`` with more columns, whose names mean something elsewhere or need quoting; each holds its own name and the row's doc_id."""
    for k, name in enumerate(ODD):
        df = df.withColumn(f"odd{k}", F.concat_ws("|", F.lit(name), F.col("doc_id").cast("string")))
    return df.toDF(*df.columns[: -len(ODD)], *ODD)


@pytest.fixture(scope="module")
def plain(spark):
    words = random.Random(4)
    rows = [*brute.edge_rows(), *((100 + k, " ".join(words.choices([f"w{j}" for j in range(50)], k=40)), "abc"[k % 3]) for k in range(12)), (LOW, "lowest of all", "a"), (HIGH, "highest of all", "b")]
    return brute.table(spark, [r for r in rows if len(r[1] or "") < 10_000], clashing=False)


def rows_of(df, columns):
    return sorted(str(tuple(r)) for r in df.select(*(F.col("`" + c.replace("`", "``") + "`") for c in columns)).collect())


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_carry_any_column(spark, plain, name):
    stage, more = dict(corpus_pipeline.STAGES)[name], odd(plain)
    got, want = stage(spark, more, brute.SF), stage(spark, plain, brute.SF)
    if name == "packing":
        assert got.count() == want.count()
        return
    assert got.columns == more.columns
    assert rows_of(got, plain.columns) == rows_of(want, plain.columns)
    for r in got.collect():
        assert all(r[k + len(plain.columns)] == (f"{c}|{r.doc_id}" if r.doc_id is not None else c) for k, c in enumerate(ODD))


def test_operators_mind_no_column(spark, plain, tmp_path):
    labels = spark.read.parquet(f"{brute.SF}/labels.parquet")
    more = odd(plain)
    for run, columns in (
        (license_scan, ["doc_id", "license"]), (pack, ["doc_id", "start", "length", "ids"]), (mix, ["doc_id", "taken"]), (substring_dedup, ["doc_id", "n_removed", "kept_text"]),
        (exact_dedup, ["doc_id", "keep_id", "group_size"]), (simhash_dedup, ["doc_id", "component_id"]), (document_counts, ["doc_id", "tokens"]), (keep_one, ["doc_id", "text"]),
        (mix_documents, ["doc_id", "text"]), (best_fit_pack, ["doc_id", "piece", "ids"]), (lambda d: toxicity(d, labels), ["doc_id", "predicted"]), (lambda d: quality(d, labels), ["doc_id", "predicted"]),
    ):
        if columns[1] == "start":  # where a piece is cut depends on the order of the rows alone
            assert run(more.coalesce(1)).count() == run(plain.coalesce(1)).count()
        else:
            assert rows_of(run(more), columns) == rows_of(run(plain), columns)
    assert exact_dedup(more).columns == [*more.columns, "keep_id", "group_size", "kept"]
    rollup = TokenRollup(spark, str(tmp_path / "rollup"))
    rollup.commit(0, odd(document_counts(plain)).withColumn("op", F.lit("insert")))
    assert rollup.totals().agg(F.sum("docs")).first()[0] == plain.count()
    vectors = spark.createDataFrame([(k, [1.0 + k % 3, *[0.5 * k] * 7], 1, k) for k in (LOW, 0, 1, 2, 3, HIGH)], "doc_id long, embedding array<double>, label int, vec_id long")
    for run in (embedding_dedup, whiten, product_codes):
        assert run(odd(vectors)).count() == run(vectors).count() > 0


def test_substrings_of_the_ends_of_the_range(spark):
    """The largest doc_id is no null one: a row without an id is above it, and each keeps what it is."""
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(HIGH, passage + " high"), (None, passage + " none"), (None, "other " + passage), (LOW, "start of it"), (HIGH, "again " + passage)]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.kept_text) for r in substring_dedup(brute.table(spark, [(i, t, "a") for i, t in rows])).collect()))
    assert got == sorted([(False, HIGH, passage + " high"), (False, HIGH, "again " + passage), (True, 0, "none"), (True, 0, "other"), (False, LOW, "start of it")])
    low = [(LOW, passage), (HIGH, passage), (0, passage)]
    assert sorted((r.doc_id, r.n_removed) for r in substring_dedup(brute.table(spark, [(i, t, "a") for i, t in low])).collect()) == [(LOW, 0), (0, 20), (HIGH, 20)]


def test_components_of_hubs(spark):
    """Stars of many edges around small, middle and large nodes, tied by chains."""
    draw = random.Random(5)
    edges = [(500, k) for k in range(1000, 1800)] + [(3, k) for k in range(2000, 2600)] + [(k, 9999) for k in range(3000, 3400)] + [(1799, 2000), (2599, 3000)]
    edges += [(draw.randint(20000, 20400), draw.randint(20000, 20400)) for _ in range(150)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {n: c for n, c in brute.components(nodes, [e for e in edges if e[0] != e[1]]).items()}


def test_join_classes_of_hot_keys(spark):
    rows = spark.range(1000).selectExpr("IF(id < 700, 0, id) AS k", "id")
    classes = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    for total in (None, 1000):
        out = join_classes(rows, classes, ["k"], "n", total=total)
        assert out.count() == 1000 and out.filter("least <> k").count() == 0
