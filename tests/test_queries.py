"""Every query that has SQL, against DuckDB over the smallest tables."""

import datetime as dt
import math

import duckdb
import numpy as np
import pytest

from swipeline.plans import queries
from swipeline.sources import fixtures

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return str(float(v)) if not isinstance(v, (str, int, dt.date)) else f"{v:.9g}" if isinstance(v, int) else str(v)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    want = sorted(tuple(plain(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_rows(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def plain_vectors(ids, dim=64):
    """The stand-in vectors of token ids, by Python integers."""
    out, most = [], (1 << 64) - 1
    for k in ids:
        row = []
        for d in range(1, dim + 1):
            x = (k * 0x9E3779B97F4A7C15 + d * 0xBF58476D1CE4E5B9) & most
            x = (x ^ x >> 30) * 0x94D049BB133111EB & most
            x ^= x >> 31
            row.append(((x >> 11) / 2**53 * 2 - 1) * math.sqrt(3 / dim))
        out.append(row)
    return np.array(out)


def projected(rows, k):
    x = np.array(rows) - np.mean(rows, axis=0)
    return x @ np.linalg.svd(x, full_matrices=False)[2][:k].T


def same_up_to_sign(got, want):
    got, want = np.array(got), np.array(want)
    return all(np.allclose(g, w, atol=1e-4) or np.allclose(g, -w, atol=1e-4) for g, w in zip(got.T, want.T, strict=True))


def test_pca_values(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r.row_id: r.pca for r in queries.QUERIES["pca_project"](spark, SF).collect()}
    assert same_up_to_sign([got[r.vec_id] for r in rows], projected([r.embedding for r in rows], 8))


def test_embedding_values(spark):
    ids = {r.row_id: [k for k in r.input_ids if k] for r in queries.fitted().encode(queries.typed(spark, SF), 16).collect()}
    got = {r.row_id: r.embedding for r in queries.QUERIES["embed_txn"](spark, SF).collect()}
    assert got.keys() == ids.keys()
    for k in list(ids)[:40]:
        assert np.allclose(got[k], plain_vectors(ids[k]).mean(axis=0), atol=1e-6)
    keys = sorted(got)
    flat = {r.row_id: r.pca for r in queries.QUERIES["embed_project_2d"](spark, SF).collect()}
    assert same_up_to_sign([flat[k] for k in keys], projected([got[k] for k in keys], 2))
    numbers = {t: k for t, k, *_ in queries.fitted().vocab_rows()}
    lines = {f"{r.user}-{r.card}-{r.chunk_id}": r.text for r in queries.QUERIES["corpus_lines"](spark, SF).collect()}
    seqs = {r.seq: r.embedding for r in queries.QUERIES["embed_seq"](spark, SF).collect()}
    assert seqs.keys() == lines.keys()
    for k in list(lines)[:20]:
        assert np.allclose(seqs[k], plain_vectors([numbers[w] for w in lines[k].split()]).mean(axis=0), atol=1e-6)


def test_kmeans_bins_are_nearest_centres(spark):
    amount = {r.row_id: r.amount for r in fixtures.txn_events(spark, SF).collect()}
    rows = [(amount[r.row_id], int(r.token.split("_")[1])) for r in queries.QUERIES["tok_amount_kmeans"](spark, SF).collect()]
    assert len(rows) == len(amount)
    x, k = map(np.array, zip(*sorted(rows), strict=True))
    assert (np.diff(k) >= 0).all() and len(set(k)) == 10
    centres = np.array([x[k == j].mean() for j in range(10)])
    nearest = np.abs(x[:, None] - centres).argmin(axis=1)
    assert (nearest == k).mean() >= 0.97
