"""Whitening and product codes of embeddings, against plain versions in Python's integers and numpy."""

import hashlib
import math

import numpy as np
import pytest

from swipeline.llm.codes import Codebook, product_codes
from swipeline.llm.whitening import whiten

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>, label int, component string, code string, x long, at int, part int, `a.b` int, `_` int"


def table(spark, rows):
    return spark.createDataFrame([(*r, "c", "d", 1, 2, 3, 4, 5) for r in rows], SCHEMA)


def drawn(n, size, seed, scale=1.0):
    x = np.random.default_rng(seed).normal(size=(n, size)) * np.linspace(1, 3, size)
    return [(k, [float(c) for c in row * scale], k % 3 if k % 4 else None) for k, row in enumerate(x)]


def plain_whitening(vectors, k):
    """({x vector: (deviation, projections)}, explained, n), with deviations in Python's integers."""
    xs = {tuple(math.floor(64 * c) + 1000000 for c in v) for v in vectors}
    n, size = len(xs), len(vectors[0])
    sums = [sum(x[d] for x in xs) for d in range(size)]
    centred = {x: np.array([(n * x[d] - sums[d]) / n for d in range(size)]) for x in xs}
    m = np.array(list(centred.values()))
    values, axes = np.linalg.eigh(m.T @ m / n)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(k, int((values > 1e-12 * values[0]).sum()))
    found = {x: (sum((n * x[d] - sums[d]) ** 2 for d in range(size)), c @ axes[:, :k] / np.sqrt(values[:k])) for x, c in centred.items()}
    return found, values[:k] / values.sum(), n


def check_whitening(df, rows, k=16):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    found, explained, n = plain_whitening([r[1] for r in kept], k)
    got = whiten(df, k).collect()
    assert len(got) == len(kept) * len(explained)
    sign = {}
    want = sorted((r[0] if r[0] is not None else -1, tuple(math.floor(64 * c) + 1000000 for c in r[1])) for r in kept)
    for j, e in enumerate(explained, 1):
        mine = sorted((g for g in got if g.component == j), key=lambda g: (g.vec_id if g.vec_id is not None else -1, g.deviation_exact))
        exact = sorted(((i, found[x][0], found[x][1][j - 1]) for i, x in want), key=lambda t: t[:2])
        assert [(-1 if g.vec_id is None else g.vec_id, int(g.deviation_exact)) for g in mine] == [t[:2] for t in exact]
        for g, (_, deviation, value) in zip(mine, exact, strict=True):
            if abs(value) > 1e-3:
                assert sign.setdefault(j, np.sign(g.whitened * value)) == np.sign(g.whitened * value)
            assert g.whitened * sign.get(j, 1) == pytest.approx(value, abs=1e-6)
            assert (g.n, g.explained) == (n, pytest.approx(e, rel=1e-6)) and g.identity_error < 1e-4
            assert g.deviation == (deviation if deviation < 1 << 63 else None)


def test_whitening_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitening(df, [(r.vec_id, r.embedding) for r in df.collect()])


def test_whitening_of_odd_rows(spark):
    """Repeats count once in the fit list; nulls and non-finite entries drop out; a null id stays; few dimensions give few components."""
    rows = drawn(40, 6, 1) + [(3, [0.5] * 6, 1)] * 5 + [(None, [0.25, -0.5, 1.0, 2.0, -3.0, 4.0], 1), (90, None, 1), (91, [None, *[1.0] * 5], 1), (92, [math.nan, *[1.0] * 5], 1), (93, [-math.inf, *[1.0] * 5], 1)]
    check_whitening(table(spark, rows), rows)
    lame = [(k, [*v, 0.125], y) for k, v, y in drawn(30, 4, 2)]  # one entry never varies
    check_whitening(table(spark, lame), lame)
    assert whiten(table(spark, lame)).agg({"component": "max"}).first()[0] == 4


def test_whitening_keeps_large_deviations(spark):
    """Beyond the long range deviation is null and the exact one is not."""
    rows = drawn(50, 3, 3, 1e8)
    check_whitening(table(spark, rows), rows)
    assert whiten(table(spark, rows)).filter("deviation IS NULL AND deviation_exact IS NOT NULL").count() > 0
    huge = [(k, [c * 1e300 for c in v], y) for k, v, y in drawn(9, 3, 4)]
    assert whiten(table(spark, huge)).count() >= 9  # entries end at 2^61 / 64


def test_whitening_without_variance(spark):
    assert whiten(table(spark, [(k, [1.0, 2.0], 1) for k in range(4)])).count() == 0
    assert whiten(table(spark, [])).count() == 0 == whiten(table(spark, [(1, None, 1), (2, [], 1)])).count()
    ragged = drawn(20, 3, 5) + [(50, [1.0, 2.0], 1), (51, [1.0] * 4, 1)]
    assert {r.vec_id for r in whiten(table(spark, ragged)).collect()} == set(range(20))


def plain_codes(rows, entries=16, rounds=6):
    """{row number: (code, error)} and the digest, by plain loops."""
    ints = [[math.floor(4096 * c) if abs(c) < 2**53 else int(c) * 4096 for c in r[1]] for r in rows]
    width = len(ints[0]) // 8
    firsts = {}
    for r, v in sorted(zip(rows, ints, strict=True), key=lambda t: (t[0][0] is None, t[0][0] or 0, t[0][1])):
        firsts.setdefault(r[0], v)
    start = list(firsts.values())[:entries]
    books, out = [[e[p * width : (p + 1) * width] for e in start] for p in range(8)], []
    for step in range(rounds + 1):
        out = [("", 0)] * len(rows)
        for p, book in enumerate(books):
            took = [[] for _ in book]
            for k, v in enumerate(ints):
                part = v[p * width : (p + 1) * width]
                far = [sum((a - b) ** 2 for a, b in zip(part, e, strict=True)) for e in book]
                who = far.index(min(far))
                took[who].append(part)
                out[k] = (out[k][0] + f"{who:02x}", out[k][1] + far[who])
            if step < rounds:
                books[p] = [[sum(c) // len(t) for c in zip(*t, strict=True)] if t else e for e, t in zip(book, took, strict=True)]
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check_codes(df, rows):
    kept = [r for r in rows if r[1] is not None and all(c is not None and math.isfinite(c) for c in r[1])]
    out, digest = plain_codes(kept)
    labels = {}
    for r, (_, error) in zip(kept, out, strict=True):
        labels[r[2]] = labels.get(r[2], 0) + error
    long = lambda x: x if x < 1 << 63 else None
    want = sorted(str((r[0], code, long(error), long(labels[r[2]]), digest)) for r, (code, error) in zip(kept, out, strict=True))
    assert sorted(str(tuple(r)) for r in product_codes(df).collect()) == want


def test_codes_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_codes(df, [(r.vec_id, r.embedding, r.label) for r in df.collect()])


def test_codes_of_odd_rows(spark):
    rows = drawn(60, 16, 6) + [(2, [0.5] * 16, 1)] * 4 + [(None, [-0.3] * 16, None), (90, None, 1), (91, [None] * 16, 1), (92, [math.nan] * 16, None), (93, [math.inf] * 16, 2)]
    check_codes(table(spark, rows), rows)
    few = drawn(5, 8, 7)
    check_codes(table(spark, few), few)
    assert product_codes(table(spark, [])).count() == 0 == product_codes(table(spark, [(1, None, 1)])).count()
    with pytest.raises(ValueError):
        product_codes(table(spark, drawn(5, 9, 7)))


def test_codes_of_huge_components(spark):
    """Exact beyond the long range too, where errors are null."""
    rows = [(k, [c * 10.0 ** (k % 24) for c in v], y) for k, v, y in drawn(48, 8, 8)]
    check_codes(table(spark, rows), rows)
    assert 0 < product_codes(table(spark, rows)).filter("error IS NULL").count() < 48
    assert product_codes(table(spark, [(k, [c * 1e306 for c in v], y) for k, v, y in drawn(20, 8, 9)])).count() == 20


def test_annuli_lose_no_entry():
    draw = np.random.default_rng(10)
    for entries, width, top in ((1, 1, 2), (16, 1, 3), (16, 3, 4), (16, 8, 4096), (40, 2, 10**8)):
        book = draw.integers(-top, top, (entries, width)).tolist()
        rows = draw.integers(-top, top, (500, width))
        far = ((rows[:, None, :].astype(object) - np.array(book, object)) ** 2).sum(axis=2)
        who, best = Codebook(book).nearest(rows)
        assert best.tolist() == far.min(axis=1).tolist()
        assert who.tolist() == [row.tolist().index(min(row)) for row in far]
