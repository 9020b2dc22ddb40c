"""Neighbour graphs against brute force, and layouts against principal coordinates."""

import numpy as np
import pytest

from swipeline.operators import features as fe
from swipeline.operators.layout import closeness, layout, neighbours
from swipeline.plans import queries

SF = "/root/testdata/sf0.001"


def clusters(spark, n, size=12, kinds=9, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(kinds, size)) * 3
    x = centres[draw.integers(0, kinds, n)] + draw.normal(size=(n, size))
    return spark.createDataFrame([(10 * k, [float(c) for c in row]) for k, row in enumerate(x)], "row_id long, embedding array<double>").repartition(4), x


def curves(spark, n, size=12, kinds=4, seed=2):
    """Closed curves that wind through all dimensions, with noise: neighbours along them are lost in any projection."""
    draw = np.random.default_rng(seed)
    turn, shift = draw.normal(size=(kinds, size, size)), draw.normal(size=(kinds, size))
    t, kind = draw.random(n) * 2 * np.pi, draw.integers(0, kinds, n)
    waves = np.concatenate([f(t[:, None] * np.arange(1, size // 2 + 1)) for f in (np.sin, np.cos)], axis=1)
    x = np.einsum("nd,nde->ne", waves, turn[kind]) + 3 * shift[kind] + 0.05 * draw.normal(size=(n, size))
    return spark.createDataFrame([(10 * k, [float(c) for c in row]) for k, row in enumerate(x)], "row_id long, embedding array<double>").repartition(4), x


def brute(x, k):
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def kept_neighbours(place, near):
    """The share of the neighbours of the vectors that are neighbours in the layout."""
    flat = brute(place, near.shape[1])
    return np.mean([len(set(a) & set(b)) / len(a) for a, b in zip(flat, near, strict=True)])


def test_neighbours_of_few_rows_are_exact(spark):
    df, x = clusters(spark, 200)
    want = brute(x, 15)
    for r in neighbours(df).collect():
        assert [e.v // 10 for e in r.near] == want[r.u // 10].tolist()
        assert r.near[0].d == pytest.approx(np.linalg.norm(x[r.u // 10] - x[want[r.u // 10][0]]))


def test_recall_of_neighbours(spark):
    df, x = clusters(spark, 2500)
    want, found = brute(x, 15), 0
    got = neighbours(df, leaf=128, trees=4).collect()
    assert len(got) == len(x) and all(len(r.near) == 15 for r in got)
    found = np.mean([len({e.v // 10 for e in r.near} & set(want[r.u // 10].tolist())) / 15 for r in got])
    assert found >= 0.9


def test_equal_vectors_are_dealt_out(spark):
    df = spark.createDataFrame([(k, [1.0, 2.0] if k % 2 else [float(k), -1.0]) for k in range(1500)], "row_id long, embedding array<double>")
    got = {r.u: r.near for r in neighbours(df, 5, leaf=64, trees=2, rounds=1).collect()}
    assert len(got) == 1500 and all(e.d == 0 for k, near in got.items() if k % 2 for e in near)


def test_closeness_is_symmetric(spark):
    df, _ = clusters(spark, 120)
    w = {(r.u, r.v): r.w for r in closeness(neighbours(df)).collect()}
    assert all(w[v, u] == pytest.approx(x) and 0 < x <= 1 + 1e-9 for (u, v), x in w.items())
    assert all(max(x for (a, _), x in w.items() if a == u) == pytest.approx(1) for u in {u for u, _ in w})


@pytest.mark.parametrize("dims", [2, 3])
def test_layout_keeps_more_neighbours_than_pca(spark, dims):
    df, x = curves(spark, 600)
    near = brute(x, 15)
    place = {r.row_id // 10: r.position for r in layout(df, dims, rounds=6, block=250).collect()}
    flat = {r.row_id // 10: r.pca for r in fe.pca(df, dims)[0].collect()}
    own, other = (kept_neighbours(np.array([p[k] for k in range(len(x))]), near) for p in (place, flat))
    assert own > other + 0.1 and len(place[0]) == dims


def test_layout_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    place = {r.row_id: r.position for r in queries.QUERIES["embed_layout"](spark, SF).collect()}
    flat = {r.row_id: r.pca for r in fe.pca(queries.vectors(spark, SF), 2)[0].collect()}
    near = brute(np.array([r.embedding for r in rows]), 15)
    own, other = (kept_neighbours(np.array([p[r.vec_id] for r in rows]), near) for p in (place, flat))
    assert own > other
    again = {r.row_id: r.position for r in queries.QUERIES["embed_layout"](spark, SF).collect()}
    assert np.allclose([again[k] for k in sorted(place)], [place[k] for k in sorted(place)], atol=1e-3)


def test_layout_of_odd_tables(spark):
    df, _ = clusters(spark, 30)
    assert layout(df.limit(0)).count() == 0
    assert layout(df.limit(2), rounds=1, steps=2).count() == 2 and layout(df.limit(1)).count() == 1
    with pytest.raises(ValueError, match="vectors of"):
        neighbours(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "row_id long, embedding array<double>"))
