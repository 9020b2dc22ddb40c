"""Exact dedup, SimHash near-dedup, substring dedup and embedding near-dedup against brute force."""

import hashlib
import random

import llm_brute as brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from swipeline.llm import queries, simhash
from swipeline.llm.common import components
from swipeline.llm.exact_dedup import exact_dedup
from swipeline.llm.hnsw import Shard, embedding_dedup, unit
from swipeline.llm.simhash import keep_one, links, simhash_dedup
from swipeline.llm.substring import alike, substring_dedup


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{brute.SF}/documents.parquet").select("doc_id", "text").collect()]


def test_exact_query(spark, documents):
    same = brute.groups((brute.lower(t), i) for i, t in documents)
    want = {(i, max(same[x]), len(same[x]), i == max(same[x]), hashlib.sha256(x.encode()).hexdigest()) for i, t in documents for x in [brute.lower(t)]}
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in queries.op8_exact_dedup(spark, brute.SF).collect()} == want


def test_exact_edges(spark):
    rows = brute.edge_rows()
    out = exact_dedup(brute.table(spark, rows)).collect()
    assert len(out) == len(rows)
    assert sum(r.kept for r in out) == len({brute.lower(t) for _, t, _ in rows})
    same = brute.groups((brute.lower(t), i) for i, t, _ in rows)
    for r in out:
        ids = same[brute.lower(r.text)]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert exact_dedup(brute.table(spark, [])).count() == 0


def test_exact_long_shared_beginnings(spark):
    start = "x" * 5000
    rows = [(k, start + str(k % 3), "s") for k in range(9)] + [(9, start, "s"), (10, start.upper(), "s")]
    out = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup(brute.table(spark, rows)).collect()}
    assert out == {k: (6 + k % 3, 3) for k in range(9)} | {9: (10, 2), 10: (10, 2)}


def near(prints):
    ids = sorted(prints)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2]
    return brute.components(ids, edges)


def test_simhash_query(spark, documents):
    prints = {i: brute.fingerprint(t) for i, t in documents}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, brute.SF).collect()}
    assert got == {i: (f"{prints[i]:016x}", c) for i, c in near(prints).items()}


@pytest.mark.parametrize("crowd", [1, 5, 64])
def test_simhash_links(spark, crowd):
    draw = random.Random(crowd)
    base = [draw.getrandbits(64) for _ in range(6)]
    prints = sorted({b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 4))) for b in base for _ in range(30)})
    signed = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    found = components(links(spark.createDataFrame(signed, "fp long, rep long"), crowd))
    got = {r.node: r.component for r in found.collect()}
    assert {k: got.get(k, k) for k in range(len(prints))} == near(dict(enumerate(prints)))


def test_simhash_edges(spark):
    rows = brute.edge_rows()
    docs = brute.table(spark, rows)
    out = simhash_dedup(docs).collect()
    assert len(out) == len(rows)
    assert sorted((str(r.doc_id), r.fingerprint) for r in out) == sorted((str(i), f"{brute.fingerprint(t):016x}") for i, t, _ in rows)
    kept = keep_one(docs)
    assert kept.columns == docs.columns
    assert {1, 4, 6, 9} <= {r.doc_id for r in kept.collect()} and not {2, 3, 5, 11, 12} & {r.doc_id for r in kept.collect()}
    assert simhash_dedup(brute.table(spark, [])).count() == keep_one(brute.table(spark, [])).count() == 0


def test_simhash_shared_ids_and_repeats(spark):
    """Rows of one doc_id are judged by their own texts; of repeated rows, and of a group without any doc_id, one stays."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(3, a, "s"), (5, a, "s"), (5, b, "s"), (7, c, "s"), (7, c, "s"), (None, c, "s"), (None, "alone here", "s"), (None, "alone here", "s")]
    docs = brute.table(spark, rows)
    assert sorted((str(r.doc_id), r.text) for r in keep_one(docs).collect()) == sorted([("3", a), ("5", b), ("7", c), ("None", "alone here")])
    out = sorted((str(r.doc_id), str(r.component_id)) for r in simhash_dedup(docs).collect())
    assert out == sorted([("3", "3"), ("5", "3"), ("5", "5"), ("7", "7"), ("7", "7"), ("None", "7"), ("None", "None"), ("None", "None")])


@pytest.mark.parametrize("coarse", [1, 100])
def test_simhash_finer_grids(spark, coarse):
    draw = random.Random(coarse)
    base = [draw.getrandbits(64) for _ in range(40)]
    prints = sorted({b ^ sum(1 << k for k in draw.sample(range(64), draw.randint(0, 3))) for b in base for _ in range(10)})
    signed = [(p - (1 << 64) if p >> 63 else p, k) for k, p in enumerate(prints)]
    got = {r.node: r.component for r in components(links(spark.createDataFrame(signed, "fp long, rep long"), 3, coarse)).collect()}
    assert {k: got.get(k, k) for k in range(len(prints))} == near(dict(enumerate(prints)))


def test_exact_very_long(spark):
    """Two equal texts of 10 MB, one that differs in the last character, and unique rows without a doc_id."""
    text = "abcdefghij" * 1_000_000
    rows = [(1, text, "s"), (2, text.upper(), "s"), (3, text[:-1] + "x", "s")] + [(None, f"unique {k}", "s") for k in range(50)]
    out = exact_dedup(brute.table(spark, rows), "doc_id", F.length("text").alias("n")).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept, r.n) for r in out if r.doc_id) == [(1, 2, 2, False, 10**7), (2, 2, 2, True, 10**7), (3, 3, 1, True, 10**7)]
    assert sum(r.kept and r.group_size == 1 for r in out if r.doc_id is None) == 50


def test_components_path(spark):
    n = 70
    edges = spark.createDataFrame([(k, k + 1) for k in range(n)] + [(100, 101), (None, 5), (7, 7)], "a long, b long")
    assert {r.node: r.component for r in components(edges).collect()} == {k: 0 for k in range(n + 1)} | {100: 100, 101: 100}


def test_substring_query(spark, documents):
    want = {i: (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest()) for i, (n, kept) in brute.removed(documents).items()}
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in queries.op6_substring(spark, brute.SF).collect()} == want


@pytest.mark.parametrize("chunk", [200, 6_000_000])
def test_substring_small_windows(spark, chunk):
    draw = random.Random(3)
    docs = [(k * 7 % 101, " ".join(draw.choice("ab") for _ in range(draw.randint(0, 30)))) for k in range(60)]
    out = substring_dedup(brute.table(spark, [(i, t, "s") for i, t in docs]).repartition(3), window=4, windows_per_bucket=50, chunk=chunk)
    assert {r.doc_id: (r.n_words, r.kept_text.split()) for r in out.collect()} == brute.removed(docs, 4)
    for r in out.collect():
        assert r.n_removed == sum(s.end - s.start for s in r.spans) and all(x.end < y.start for x, y in zip(r.spans, r.spans[1:], strict=False))


def test_substring_edges(spark):
    rows = brute.edge_rows()
    out = substring_dedup(brute.table(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert by[1].n_words == by[2].n_words == by[3].n_words == 0 and by[7].n_removed == 0
    assert by[8].kept_text == "end" and by[12].kept_text == "" and by[6].kept_text == "one"
    assert substring_dedup(brute.table(spark, [])).count() == 0


def test_substring_look_alike_words(spark):
    """Words that collide in any polynomial modulo a power of two, and long ones that differ at the end, are different words."""
    thue = "a"
    for _ in range(10):
        thue += thue.translate(str.maketrans("ab", "ba"))
    other = thue.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join(["w"] * 6 + [x] + ["v"] * 6), "s") for k, x in enumerate([thue, other, "z" * 500 + "1", "z" * 500 + "2", thue, thue[:60], other[:60]])]
    assert {r.doc_id: r.n_removed for r in substring_dedup(brute.table(spark, rows)).collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 13, 5: 0, 6: 0}


def test_windows_of_one_hash_and_two_checks():
    h, c = np.array([7, 5, 7, 7, 5], np.uint64), np.array([1, 3, 2, 1, 3], np.uint8)
    order, first = alike(h, c)
    assert [p.tolist() for p in np.split(order, first[1:])] == [[1, 4], [0, 3], [2]]


def cosine_links(rows, least=0.98):
    unit = {}
    for i, v, label in rows:
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            v = np.array(v, np.float64) / max(map(abs, v))
            unit[i] = v / np.linalg.norm(v), label
    ids = sorted(unit)
    return [(a, b) for k, a in enumerate(ids) for b in ids[:k] if unit[a][1] == unit[b][1] and len(unit[a][0]) == len(unit[b][0]) and unit[a][0] @ unit[b][0] >= least]


def check_vectors(rows, out):
    edges = cosine_links(rows)
    roots = brute.components([i for i, _, _ in rows], edges)
    n = {i: 0 for i, _, _ in rows}
    for a, b in edges:
        n[a] += 1
        n[b] += 1
    rows = out.collect()
    assert all(r.audit_recall is None or r.audit_recall >= 0.9 for r in rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in rows}
    assert got == {i: (n[i], roots[i], roots[i] == i) for i in n}


def test_embedding_query(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    check_vectors(rows, queries.op3_embedding_dedup(spark, "/root/testdata/sf0.01"))


@pytest.mark.parametrize("shard", [40, 8192])
def test_embedding_shards(spark, shard):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(12, 16))
    rows = [(k, (centres[k % 12] + draw.normal(size=16) * draw.choice([0, 0.03, 0.12])).astype(np.float32).tolist(), k % 2) for k in range(400)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    check_vectors(rows, embedding_dedup(table, shard_rows=shard, block_rows=64))


def test_embedding_edges(spark):
    v = [1.0, 2.0, 3.0]
    rows = [
        (1, v, 0), (2, v, 0), (3, v, None), (4, None, 0), (5, [0.0, 0.0, 0.0], 0), (6, [1.0, None, 2.0], 0), (7, [1.0, float("nan"), 2.0], 0),
        (8, [float("inf"), 1.0, 2.0], 0), (9, [2.0, 4.0, 6.0], 0), (10, [2.0, 4.0], 0), (11, [], 0), (12, v, 1),
    ]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("block", F.lit(1)).withColumn("graph", F.lit("x"))
    check_vectors(rows, embedding_dedup(table))
    more = table.unionByName(table.filter("vec_id = 4")).unionByName(table.filter("vec_id = 1").withColumn("vec_id", F.lit(None).cast("long")))
    assert embedding_dedup(more).count() == len(rows) + 2
    assert embedding_dedup(table.filter("false")).count() == 0


def test_embedding_repeated_rows_and_shared_ids(spark):
    v, w, z = [1.0, 2.0, 3.0], [1.0, 2.0, 3.001], [-3.0, 1.0, 0.5]
    rows = [(1, v), (1, v), (2, w), (2, z), (4, z), (5, [2.0, 4.0, 6.0]), (6, [9.0, -9.0, 1.0]), (6, [9.0, -9.0, 1.0])]
    table = spark.createDataFrame([(i, x, 0) for i, x in rows], "vec_id long, embedding array<double>, label int")
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in embedding_dedup(table).collect())
    # id 2 has two vectors: one near 1 and 5, one equal to that of 4
    assert out == [(1, 2, 1, True), (1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False), (4, 1, 1, False), (5, 2, 1, False), (6, 0, 6, True), (6, 0, 6, True)]


def test_embedding_huge_and_tiny_doubles(spark):
    v = [1.0, -2.0, 0.5]
    rows = [(k, [x * s for x in v], 0) for k, s in enumerate([1e200, 3e-300, 1.0, 1e-310])] + [(9, [1e200, 1e200, 1e200], 0)]
    check_vectors(rows, embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")))


def test_embedding_dense_group(spark):
    """5,000 different vectors all within reach of each other, among others: exact links, counted and not listed."""
    draw = np.random.default_rng(11)
    centre = draw.normal(size=16)
    rows = [(k, (centre + draw.normal(size=16) * 0.02).tolist() if k % 6 else draw.normal(size=16).tolist(), 0) for k in range(6000)]
    out = embedding_dedup(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    v = np.array([x for _, x, _ in rows])
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    want = ((v @ v.T) >= 0.98).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in out} == dict(enumerate(want.tolist())) and want.max() > 4000
    assert {r.component_id for r in out if r.vec_id % 6} == {1}


def test_embedding_search_recall(spark):
    """Against brute force where the search is not exact by its size: many vectors in few dimensions, small beams."""
    draw = np.random.default_rng(2)
    x = draw.normal(size=(6000, 12))
    v = unit(np.concatenate([x, x[:3000] + draw.normal(size=(3000, 12)) * 0.05]))
    shard = Shard(v, np.arange(len(v)), np.ones(len(v), int), 0.98)
    shard.prepare()
    true = set(zip(*(k.tolist() for k in shard.every(v)), strict=True))
    got = set(zip(*(k.tolist() for k in shard.linked(v, shard.candidates(v, 32, 512))), strict=True))
    assert got <= true and len(got) >= 0.99 * len(true) and len(true) > 12000
    width, wanted, found = shard.beam_for(v, np.arange(len(v)), 2, 512, 200, 0.98)
    assert width >= 2 and found >= 0.98 * wanted
    # an audit that no beam passes leads to exact answers
    assert shard.beam_for(v, np.arange(len(v)), 2, 2, 200, 1.01)[0] == 0


def test_substring_many_rows_of_one_id(spark):
    """Thousands of rows without a doc_id, and thousands that share one, keep their own spans."""
    n, shared = 3000, " ".join(f"shared{k}" for k in range(15))
    own = {k: [f"own{k}x{j}" for j in range(k % 40)] for k in range(2 * n)}
    rows = [(0, shared, "s")] + [(None if k < n else 5, " ".join([*own[k], shared, f"end{k}"]) if k % 3 else " ".join([*own[k], f"end{k}"]), "s") for k in own]
    out = substring_dedup(brute.table(spark, rows).repartition(3)).collect()
    want = [(0, 15, 0, shared)] + [(i, len(t.split()), 15 * (shared in t), " ".join([*own[k], f"end{k}"])) for k, (i, t, _) in enumerate(rows[1:])]
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out), key=str) == sorted(want, key=str)


def test_simhash_linked_through_a_row_without_id(spark, monkeypatch):
    """Fingerprints of rows without a doc_id link like any other, take a name from their component and give none."""
    prints = [(7, 0), (None, 3), (9, 15), (None, 1 << 40 | 1 << 41 | 1 << 42), (None, 1 << 40 | 1 << 41), (8, -(1 << 63) | 0xFFFFFF)]
    monkeypatch.setattr(simhash, "fingerprint", lambda text, words: text.cast("long"))
    out = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup(spark.createDataFrame(prints, "doc_id long, text long")).collect()}
    far = prints[3:5]
    assert out == {prints[0]: 7, prints[1]: 7, prints[2]: 7, far[0]: 7, far[1]: 7, prints[5]: 8}
