"""Neighbour graphs of vectors, and layouts in two or three dimensions that keep neighbours together."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipeline.operators.features import pca
from swipeline.operators.kept import kept

EDGES = "u long, v long, d double"
# The curve 1 / (1 + a x^2b) of closeness for a least distance of 0.1.
CURVE_A, CURVE_B = 1.577, 0.8951


def rows_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def nearest(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, distances) of the k nearest other rows to each row, nearest first; fewer if there are no more."""
    k = min(k, len(x) - 1)
    square, places, far = (x * x).sum(axis=1), np.zeros((len(x), k), np.int64), np.zeros((len(x), k))
    for at in range(0, len(x) if k else 0, 512):
        own = np.arange(at, min(len(x), at + 512))
        d = np.maximum(square[own, None] + square - 2 * x[own] @ x.T, 0)
        d[own - at, own] = np.inf
        some = np.argpartition(d, k - 1, axis=1)[:, :k]
        order = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
        places[own], far[own] = order, np.sqrt(np.take_along_axis(d, order, 1))
    return places, far


def edge_table(ids: np.ndarray, places: np.ndarray, far: np.ndarray) -> pa.Table:
    return pa.table({"u": np.repeat(ids, places.shape[1]), "v": ids[places.ravel()], "d": far.ravel()})


def best(edges: DataFrame, k: int) -> DataFrame:
    """(u, near): the k nearest of each node, as structs of d and v. A node has some edges for each tree or neighbour, never many."""
    once = edges.groupBy("u", "v").agg(F.min("d").alias("d"))
    return once.groupBy("u").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "v"))), 1, k).alias("near"))


def neighbours(df: DataFrame, k: int = 15, leaf: int = 1024, trees: int = 6, rounds: int = 2, seed: int = 42, key: str = "row_id", column: str = "embedding") -> DataFrame:
    """(u, near): of each row's vector the about ``k`` nearest others by Euclidean distance, nearest first, as structs of d and v.

    ``trees`` random splits by hyperplanes through the mean, and one by a hash, which leaves no row alone, deal the rows to groups of about ``leaf``; larger groups, as of equal vectors, are split by a hash. Rows are compared
    within their groups, and then ``rounds`` times with the neighbours and some of those whose neighbour they are of each neighbour. So the work
    is in proportion to the rows, and no group grows with them. Up to ``leaf`` rows the graph is exact. Keys are longs and differ, vectors are of one length.
    """
    rows = kept(df.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("x")).filter("id IS NOT NULL AND x IS NOT NULL"))
    n, longest, shortest = rows.agg(F.count("*"), F.max(F.size("x")), F.min(F.size("x"))).first()
    if longest != shortest:
        raise ValueError(f"vectors of {shortest} to {longest} numbers")
    bits = max(0, math.ceil(math.log2(max(1, 1.5 * n / leaf)))) if n > leaf else 0
    centre = rows.select(Summarizer.mean(array_to_vector("x"))).first()[0].toArray() if n else np.zeros(0)
    trees = trees if bits else 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch.column("x")) - centre if batch.num_rows else np.zeros((0, 1))
            for tree in range(trees + bool(bits)):
                planes = np.random.default_rng([seed, tree]).normal(size=(x.shape[1], bits))
                bucket = ((x @ planes > 0) << np.arange(bits)).sum(axis=1) if tree < trees and bits else (batch.column("id").to_numpy() * 0x9E3779B1 >> 16) % (1 + n // leaf)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), tree, np.int32)), pa.array(bucket.astype(np.int64)), batch.column("id"), batch.column("x")], ["tree", "bucket", "id", "x"])

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        return edge_table(table.column("id").to_numpy(), *nearest(rows_of(table.column("x")), k))

    dealt = rows.mapInArrow(deal, "tree int, bucket long, id long, x array<double>")
    large = dealt.groupBy("tree", "bucket").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * leaf).select("tree", "bucket", F.ceil(F.col("n") / leaf).alias("parts"))
    split = dealt.join(large, ["tree", "bucket"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("id", "tree"), "parts"), F.lit(0)))
    found = best(split.groupBy("tree", "bucket", "part").applyInArrow(compare, EDGES), k)
    graph = kept(rows.select(F.col("id").alias("u")).join(found, "u", "left").select("u", F.coalesce("near", F.array().cast("array<struct<d:double,v:bigint>>")).alias("near")))
    blocks = 1 + n // 2048

    def meet(table: pa.Table) -> pa.Table:
        """The nearest of each to each among what the members of a node's list are."""
        table = table.sort_by("c")
        c, ids, x = table.column("c").to_numpy(), table.column("id").to_numpy(), rows_of(table.column("x"))
        ends = np.append(np.flatnonzero(np.diff(c)) + 1, len(c))
        found = [edge_table(ids[a:z], *nearest(x[a:z], k)) for a, z in zip(np.append(0, ends[:-1]), ends, strict=True) if z - a > 1]
        return pa.concat_tables(found) if found else edge_table(np.zeros(0, np.int64), np.zeros((0, 1), np.int64), np.zeros((0, 1)))

    for _ in range(rounds if bits else 0):
        edges = graph.select("u", F.explode("near").alias("e")).select("u", F.col("e.v").alias("v"), F.col("e.d").alias("d"))
        back = edges.groupBy(F.col("v").alias("c")).agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("u", "v").alias("h"), F.col("u").alias("id")))), 1, k).alias("some"))
        members = edges.select(F.col("u").alias("c"), F.col("v").alias("id")).unionByName(back.select("c", F.explode("some").alias("s")).select("c", "s.id"))
        members = members.unionByName(graph.select(F.col("u").alias("c"), F.col("u").alias("id"))).distinct()
        lists = members.join(rows, "id").withColumn("block", F.pmod(F.xxhash64("c"), F.lit(blocks)))
        found = best(edges.unionByName(lists.groupBy("block").applyInArrow(meet, EDGES)), k)
        graph = kept(graph.select("u").join(found, "u", "left").select("u", F.coalesce("near", F.array().cast("array<struct<d:double,v:bigint>>")).alias("near")))
    return graph


def closeness(graph: DataFrame) -> DataFrame:
    """(u, v, w), both ways: how surely u and v are neighbours. A node's own distances count from its nearest on, on a scale that gives them log2 of their number together; either way suffices."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, ids = batch.column("near"), batch.column("u").to_numpy()
            if not batch.num_rows:
                continue
            n, flat = lists.value_lengths().to_numpy(), lists.flatten()
            d, who = flat.field("d").to_numpy(zero_copy_only=False), np.repeat(np.arange(len(n)), n)
            least = np.full(len(n), np.inf)
            np.minimum.at(least, who, d)
            beyond, want = np.maximum(d - least[who], 0), np.maximum(np.log2(np.maximum(n, 1)), 1e-3)
            low, high = np.zeros(len(n)), np.full(len(n), 2 * (d.max(initial=0) + 1e-9) * 64)
            for _ in range(60):
                scale = (low + high) / 2
                total = np.bincount(who, np.exp(-beyond / np.maximum(scale[who], 1e-12)), len(n))
                low, high = np.where(total < want, scale, low), np.where(total < want, high, scale)
            w = np.exp(-beyond / np.maximum(high[who], 1e-12))
            yield pa.RecordBatch.from_arrays([pa.array(ids[who]), flat.field("v"), pa.array(w)], ["u", "v", "w"])

    one = graph.mapInArrow(weigh, "u long, v long, w double")
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
    total, squares = F.sum("w"), F.sum(F.col("w") * F.col("w"))
    return both.groupBy("u", "v").agg((total - (total * total - squares) / 2).alias("w"))


def layout(df: DataFrame, dims: int = 2, k: int = 15, rounds: int = 8, steps: int = 25, block: int = 4096, away: int = 5, seed: int = 42, key: str = "row_id", column: str = "embedding", **search) -> DataFrame:
    """(key, position): a place in ``dims`` dimensions for each row, near its ``k`` nearest neighbours and apart from others.

    From the first principal coordinates on, neighbours attract each other by their closeness and each step's edges push some random nodes away. Nodes are dealt to blocks of about
    ``block``. In each of ``rounds`` rounds a task takes its block's edges with the places at both ends and makes ``steps`` steps on its own nodes, while
    those of others stay; then all blocks exchange their places, by one join. So a round shuffles the edges once, however many rows there are.
    Draws are seeded and rows sorted, so a rerun gives the same layout. Rows without a key or vector are left out. See ``neighbours`` for ``search``.
    """
    graph = neighbours(df, k, seed=seed, key=key, column=column, **search)
    edges = kept(closeness(graph))
    n, most = graph.count(), edges.agg(F.max("w")).first()[0] or 1.0
    if n < 2:
        return graph.select(F.col("u").alias(key), F.array_repeat(F.lit(0.0), dims).alias("position"))
    first, _ = pca(df.select(F.col(key).cast("long").alias("id"), F.col(column).alias("x")).filter("id IS NOT NULL AND x IS NOT NULL"), dims, column="x", out="p")
    reach = first.agg(F.max(F.array_max(F.transform("p", lambda x: F.abs(x))))).first()[0] or 1.0
    place = kept(first.select("id", F.transform("p", lambda x: x * (10 / reach)).alias("p")))
    blocks = 1 + (n - 1) // block

    def move(number: int):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("u", "ascending"), ("v", "ascending")])
            u, v, w = (table.column(c).to_numpy() for c in ("u", "v", "w"))
            ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
            a, b, y = at[: len(u)], at[len(u) :], np.zeros((len(ids), dims))
            y[b], y[a] = rows_of(table.column("pv")), rows_of(table.column("pu"))
            own, draw = np.unique(a), np.random.default_rng([seed, number, int(u[0]) & 0xFFFFFFFF])
            for step in range(steps):
                rate = 1 - (number * steps + step) / (rounds * steps)
                taken = draw.permutation(np.flatnonzero(draw.random(len(w)) * most < w))
                for part in np.array_split(taken, 8):
                    i, j = a[part], b[part]
                    apart = y[i] - y[j]
                    far = (apart * apart).sum(axis=1)
                    pull = np.where(far > 0, -2 * CURVE_A * CURVE_B * np.maximum(far, 1e-12) ** (CURVE_B - 1) / (1 + CURVE_A * far**CURVE_B), 0.0)
                    force = np.clip(pull[:, None] * apart, -4, 4)
                    for _ in range(away):
                        other = draw.integers(0, len(ids), len(i))
                        apart = y[i] - y[other]
                        far = (apart * apart).sum(axis=1)
                        push = np.where(other == i, 0.0, 2 * CURVE_B / ((0.001 + far) * (1 + CURVE_A * far**CURVE_B)))
                        force += np.clip(push[:, None] * apart, -4, 4)
                    change = np.zeros_like(y)
                    np.add.at(change, i, force)
                    y += rate * np.clip(change, -4, 4)
            flat = y[own].ravel()
            return pa.table({"id": ids[own], "q": pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, dims), pa.int32()), pa.array(flat))})

        return run

    for number in range(rounds):
        ends = edges.join(place.select(F.col("id").alias("u"), F.col("p").alias("pu")), "u").join(place.select(F.col("id").alias("v"), F.col("p").alias("pv")), "v")
        moved = ends.withColumn("block", F.pmod(F.xxhash64("u", F.lit(number)), F.lit(blocks))).groupBy("block").applyInArrow(move(number), "id long, q array<double>")
        place = kept(place.join(moved, "id", "left").select("id", F.coalesce("q", "p").alias("p")))
    return place.select(F.col("id").alias(key), F.col("p").alias("position"))
