"""Boosted trees by second-order gradients over binned columns: one aggregate of gradients for each level of a tree."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.operators.kept import kept
from swipeline.operators.ranges import sums_before

#: A bin is a byte: 0 for a missing value, the others by rising value.
BINS = 255
#: Gradients are added up as integers of this many binary places, so sums do not depend on who adds them: 2^35 rows fit in a long.
PLACES = 28
#: The least gain of a split.
LEAST_GAIN = 1e-6
#: Rows of a block, and rows of a partition of blocks from which on there are more partitions than cores.
BLOCK_ROWS, PART_ROWS = 1 << 16, 1 << 22
#: The most cells (node, column, bin) for which a task holds sums, 16 bytes each; beyond, it sends a block's sums on.
MOST_CELLS = 1 << 23
#: Cells that a task of the aggregate gets, 28 bytes each.
PART_CELLS = 1 << 18
#: Margins are written anew after so many trees; until then each level of a tree works them out again.
EVERY = 2
BLOCK = "n int, bins binary, label binary, held binary, hash binary, margin binary"
CELLS = "node int, col int, bin int, g long, h long"
SPLITS = "node int, tg double, th double, gain double, col int, cut int, missing_left boolean, g double, h double"
SPLIT_NAMES = [x.split()[0] for x in SPLITS.split(", ")]
SPLIT_KINDS = [{"int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}[x.split()[1]] for x in SPLITS.split(", ")]


@dataclass
class Tree:
    """Nodes by number; a leaf has column -1. Rows of a bin up to ``cut`` go left, missing values as ``missing_left`` says."""

    column: list[int] = field(default_factory=lambda: [-1])
    cut: list[int] = field(default_factory=lambda: [0])
    missing_left: list[bool] = field(default_factory=lambda: [False])
    left: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])

    def split(self, node: int, column: int, cut: int, missing_left: bool) -> tuple[int, int]:
        """The numbers of the two new nodes."""
        at = len(self.column)
        self.column[node], self.cut[node], self.missing_left[node], self.left[node] = column, cut, missing_left, at
        for own, new in ((self.column, -1), (self.cut, 0), (self.missing_left, False), (self.left, 0), (self.value, 0.0)):
            own += [new, new]
        return at, at + 1

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The node in which each row of ``bins`` (rows x columns) ends."""
        column, cut, missing_left, left = (np.array(x) for x in (self.column, self.cut, self.missing_left, self.left))
        inner = column >= 0
        # Left is where bin - shift, as a byte, is below the limit: a missing value's 0 becomes 255 where it goes right.
        shift, limit = (~missing_left).astype(np.uint8), (cut + missing_left).astype(np.int16)
        at = np.zeros(len(bins), np.int64)
        going, node = (np.arange(len(bins)) if inner[0] else np.zeros(0, np.int64)), at
        while len(going):
            node = left[node] + (bins[going, column[node]] - shift[node] >= limit[node])
            at[going] = node
            on = inner[node]
            going, node = (going, node) if on.all() else (going[on], node[on])
        return at

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return np.array(self.value)[self.nodes(bins)]


@dataclass
class Boosting:
    """How trees are grown.

    ``l1``, ``l2`` and ``gamma`` are the penalties on leaf weights and on splits, ``least_weight`` the least sum of second derivatives of a child,
    ``columns`` and ``rows`` the shares of columns and rows drawn for each tree, ``patience`` how many trees without a better area end the search.
    """

    trees: int = 100
    depth: int = 6
    rate: float = 0.1
    columns: float = 1.0
    rows: float = 1.0
    least_weight: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    patience: int = 20
    seed: int = 42

    def shrunk(self, g: np.ndarray) -> np.ndarray:
        return np.sign(g) * np.maximum(np.abs(g) - self.l1, 0.0)

    def weight(self, g: float, h: float) -> float:
        return float(-self.shrunk(g) / (h + self.l2) * self.rate) if h + self.l2 > 0 else 0.0

    def worth(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        return np.divide(self.shrunk(g) ** 2, h + self.l2, out=np.zeros_like(g), where=h + self.l2 > 0)

    def best_cut(self, bins: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple | None, float]:
        """((cut, missing_left, g, h of the left side) or None, gain) of a node's sums by rising bin; missing values are tried on both sides, first on the right."""
        lost = bins == 0
        tg, th, mg, mh = g.sum(), h.sum(), g[lost].sum(), h[lost].sum()
        bins, lg, lh = bins[~lost], np.cumsum(g[~lost]), np.cumsum(h[~lost])
        best, most = None, 0.0
        for missing_left in (False, True):
            left, weight = lg + mg * missing_left, lh + mh * missing_left
            gain = self.worth(left, weight) + self.worth(tg - left, th - weight) - self.worth(np.full_like(lg, tg), np.full_like(lh, th))
            allowed = (weight >= self.least_weight) & (th - weight >= self.least_weight) & (weight > 0) & (th - weight > 0) & (gain > LEAST_GAIN) & (gain >= self.gamma)
            if allowed.any():
                at = int(np.argmax(np.where(allowed, gain, -1.0)))
                if gain[at] > most:
                    best, most = (int(bins[at]), missing_left, float(left[at]), float(weight[at])), float(gain[at])
        return best, most

    def tree_columns(self, tree: int, count: int) -> np.ndarray:
        draw = np.random.default_rng([self.seed, tree])
        return np.sort(draw.permutation(count)[: max(1, int(self.columns * count))])

    def drawn(self, tree: int, hashes: np.ndarray) -> np.ndarray:
        """Which rows the tree sees, by a hash of the row and the tree alone."""
        if self.rows >= 1:
            return np.ones(len(hashes), bool)
        x = hashes ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 + self.seed & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return (x ^ (x >> np.uint64(31))) >> np.uint64(11) < self.rows * 2.0**53


@dataclass
class Model:
    """The trees kept, over ``edges`` by column: value x is in bin 1 + (how many edges are below x)."""

    names: list[str]
    edges: list[list[float]]
    start: float
    trees: list[Tree] = field(default_factory=list)
    areas: list[float | None] = field(default_factory=list)

    def score(self, df: DataFrame, *keep: str) -> DataFrame:
        """(keep, score): the probability of class 1 of each row, in Arrow batches and without a shuffle. Nulls and NaN are missing values."""
        names, edges, start, trees = self.names, self.edges, self.start, self.trees
        inputs = [f"_x{k}" for k in range(len(names))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bins = to_bins(batch, inputs, edges)
                margin = sum((t.margins(bins) for t in trees), np.full(batch.num_rows, start))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(1 / (1 + np.exp(-margin)))], [*keep, "score"])

        kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
        return df.select(*keep, *numbers(names)).mapInArrow(run, f"{kinds}, score double")


def numbers(names: list[str]) -> list[Column]:
    return [F.col(f"`{c}`").cast("double").alias(f"_x{k}") for k, c in enumerate(names)]


def to_bins(batch: pa.RecordBatch, inputs: list[str], edges: list[list[float]]) -> np.ndarray:
    out = np.zeros((batch.num_rows, len(inputs)), np.uint8)
    for k, (name, e) in enumerate(zip(inputs, edges, strict=True)):
        x = batch.column(name).to_numpy(zero_copy_only=False).astype(np.float64)
        out[:, k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(np.array(e), x, "left"))
    return out


def quantile_edges(df: DataFrame, names: list[str]) -> list[list[float]]:
    """At most 254 rising edges a column, from a mergeable quantile sketch of all columns in one aggregate. The largest value is no edge, as nothing is above it."""
    shares = [k / BINS for k in range(1, BINS)]
    wanted = [F.percentile_approx(F.when(~F.isnan(c), c), shares, 20 * BINS).alias(f"e{k}") for k, c in enumerate(numbers(names))]
    tops = [F.max(F.when(~F.isnan(c), c)).alias(f"t{k}") for k, c in enumerate(numbers(names))]
    row = df.agg(*wanted, *tops).first()
    return [sorted({x for x in row[f"e{k}"] or [] if x < row[f"t{k}"]}) for k in range(len(names))]


def to_blocks(df: DataFrame, names: list[str], label: str, held: str | None, key: str, edges: list[list[float]], start: float) -> DataFrame:
    """The rows as blocks of bytes, of ``BLOCK_ROWS`` rows or few more, so that a level reads few and large values. Bins are stored column after column."""
    inputs = [f"_x{k}" for k in range(len(names))]

    def block(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        bins, y, held, hashes = (np.concatenate(x) for x in zip(*parts, strict=True))
        values = [bins.T.tobytes(), y.tobytes(), held.tobytes(), hashes.tobytes(), np.full(len(y), start).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([len(y)], pa.int32()), *(pa.array([v], pa.binary()) for v in values)], [c.split()[0] for c in BLOCK.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if batch.num_rows:
                flags = [batch.column(c).to_numpy(zero_copy_only=False).astype(np.uint8) for c in ("_y", "_held")]
                parts.append((to_bins(batch, inputs, edges), *flags, batch.column("_hash").to_numpy().astype("<i8")))
                if sum(len(x[1]) for x in parts) >= BLOCK_ROWS:
                    yield block(parts)
                    parts = []
        if parts:
            yield block(parts)

    y, aside = F.col(f"`{label}`").cast("int").alias("_y"), (F.coalesce(F.col(f"`{held}`"), F.lit(False)) if held else F.lit(False)).alias("_held")
    return df.select(*numbers(names), y, aside, F.xxhash64(F.col(f"`{key}`")).alias("_hash")).mapInArrow(run, BLOCK)


class Block:
    """One block's arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int, columns: int):
        value = lambda c, kind: np.frombuffer(batch.column(c)[row].as_py(), kind)
        self.bins = value("bins", np.uint8).reshape(columns, -1).T
        self.label, self.held, self.hash, self.margin = value("label", np.uint8), value("held", np.uint8) > 0, value("hash", "<u8"), value("margin", "<f8")

    def after(self, trees: list[Tree]) -> np.ndarray:
        return sum((t.margins(self.bins) for t in trees), self.margin)


def blocks_of(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[pa.RecordBatch, int, Block]]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch, row, Block(batch, row, columns)


def histogram(blocks: DataFrame, done: list[Tree], tree: Tree, number: int, active: list[int], chosen: np.ndarray, how: Boosting, columns: int, most: int = MOST_CELLS) -> DataFrame:
    """(node, col, bin, g, h): sums of the gradients of the drawn rows in the ``active`` nodes, one row a task for each cell that has any; where there are more
    than ``most`` cells, one a block.
    """
    names, nodes = [x.split()[0] for x in CELLS.split(", ")], np.array(active, np.int32)

    def out(c: int, used: np.ndarray, g: np.ndarray, h: np.ndarray) -> pa.RecordBatch:
        keys = [nodes[used // (BINS + 1)], np.full(len(used), c, np.int32), (used % (BINS + 1)).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*keys, g, h)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(tree.column), -1)
        place[active] = np.arange(len(active))
        width = len(active) * (BINS + 1)
        sums = np.zeros((len(chosen), 2, width), np.int64) if len(chosen) * width <= most else None
        for _, _, block in blocks_of(batches, columns):
            rows = np.flatnonzero(~block.held & how.drawn(number, block.hash))
            bins = block.bins.T[:, rows].T
            at = place[tree.nodes(bins)]
            if (at < 0).any():
                inside = np.flatnonzero(at >= 0)
                rows, bins, at = rows[inside], bins.T[:, inside].T, at[inside]
            if not len(rows):
                continue
            chance = 1 / (1 + np.exp(-sum((t.margins(bins) for t in done), block.margin[rows])))
            g = np.rint((chance - block.label[rows]) * 2.0**PLACES)
            h = np.rint(chance * (1 - chance) * 2.0**PLACES)
            at *= BINS + 1
            for k, c in enumerate(chosen):
                cell = at + bins[:, c]
                if sums is not None and width > len(rows):
                    for own, x in zip(sums[k], (g, h), strict=True):
                        np.add.at(own, cell, x.astype(np.int64))
                    continue
                found = [np.bincount(cell, x, width) for x in (g, h)]  # exact: a block's sums are below 2^53
                if sums is not None:
                    for own, x in zip(sums[k], found, strict=True):
                        own += x.astype(np.int64)
                else:
                    used = np.flatnonzero(np.bincount(cell))
                    yield out(c, used, *(x[used].astype(np.int64) for x in found))
        for k, c in enumerate(chosen if sums is not None else []):
            used = np.flatnonzero(sums[k].any(axis=0))
            if len(used):
                yield out(c, used, *sums[k][:, used])

    return blocks.mapInArrow(run, CELLS)


def best_splits(cells: DataFrame, how: Boosting, parts: int) -> DataFrame:
    """Rows (node, tg, th, gain, col, cut, missing_left, g, h), one for each node and task: the node's sums, and its split of most gain among the task's
    columns (of equal ones the first column's, then the lowest cut's), null where none is allowed. Sums meet by node and column, in ``parts`` tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[b.column(c).to_numpy() for c in ("node", "col", "bin", "g", "h")] for b in batches if b.num_rows]
        if not parts:
            return
        node, col, place, *sums = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, col, node))
        node, col, place = node[order], col[order], place[order]
        first = np.flatnonzero(np.diff(node, prepend=-1) | np.diff(col, prepend=-1) | np.diff(place, prepend=-1))
        g, h = (np.add.reduceat(x[order], first) for x in sums)
        node, col, place = node[first], col[first], place[first]
        starts = np.flatnonzero(np.diff(node, prepend=-1) | np.diff(col, prepend=-1))
        found: dict[int, tuple] = {}
        for a, z in zip(starts, [*starts[1:], len(node)], strict=True):
            best, rank = how.best_cut(place[a:z], g[a:z] * 2.0**-PLACES, h[a:z] * 2.0**-PLACES)
            key, total = int(node[a]), (float(g[a:z].sum() * 2.0**-PLACES), float(h[a:z].sum() * 2.0**-PLACES))
            if key not in found or best and (found[key][2] is None or rank > found[key][2]):
                found[key] = (*total, rank, int(col[a]), *best) if best else (*total, *[None] * 6)
        rows = [(k, *v) for k, v in sorted(found.items())]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), SPLIT_KINDS, strict=True)], SPLIT_NAMES)

    return cells.repartition(parts, "node", "col").mapInArrow(run, SPLITS)


def grow(blocks: DataFrame, tasks: int, done: list[Tree], number: int, how: Boosting, columns: int) -> Tree:
    """A tree level by level; the driver gets a row for each node of a level and task of the aggregate, and has no more tasks to keep than the level's sums need."""
    tree, chosen, active = Tree(), how.tree_columns(number, columns), [0]
    for _ in range(how.depth):
        parts = math.ceil(tasks * len(active) * len(chosen) * (BINS + 1) / PART_CELLS)
        found = best_splits(histogram(blocks, done, tree, number, active, chosen, how, columns), how, parts).collect()
        best = {r["node"]: r for r in sorted(found, key=lambda r: (r["gain"] is not None, r["gain"] or 0, -(r["col"] or 0)))}
        active = []
        for node, s in sorted(best.items()):
            tree.value[node] = how.weight(s["tg"], s["th"])
            if s["gain"] is not None:
                low, high = tree.split(node, s["col"], s["cut"], s["missing_left"])
                tree.value[low], tree.value[high] = how.weight(s["g"], s["h"]), how.weight(s["tg"] - s["g"], s["th"] - s["h"])
                sides = ((low, s["h"]), (high, s["th"] - s["h"]))
                active += [n for n, h in sides if h >= 2 * how.least_weight]  # below, no split leaves both children their least
        if not active:
            break
    return tree


def prefix_areas(blocks: DataFrame, new: list[Tree], columns: int) -> list[float | None]:
    """The area under the curve on the held-out rows after each of the ``new`` trees, all in one pass over one range order by (tree, margin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, block in blocks_of(batches, columns):
            margin, bins, label = block.margin[block.held], block.bins[block.held], block.label[block.held]
            for k, tree in enumerate(new if len(label) else []):
                margin = margin + tree.margins(bins)
                values, at = np.unique(margin, return_inverse=True)
                n = np.bincount(at, minlength=len(values))
                pos = np.bincount(at, label, len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), k, np.int32)), *map(pa.array, (values, pos, n - pos))], ["tree", "s", "pos", "neg"])

    per = blocks.mapInArrow(run, "tree int, s double, pos long, neg long").groupBy("tree", "s").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    before = sums_before(per, ["tree", "s"], neg_before="neg")
    below = F.sum(F.col("pos").cast("double") * (F.col("neg_before") + F.col("neg") / 2))
    rows = {r["tree"]: r for r in before.groupBy("tree").agg(below.alias("below"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).collect()}
    # neg_before counts the earlier trees' rows too, which are the same negatives each time.
    return [None if k not in rows or not rows[k]["pos"] * rows[k]["neg"] else rows[k]["below"] / (rows[k]["pos"] * rows[k]["neg"]) - k for k in range(len(new))]


def boost(train: DataFrame, columns: list[str], label: str, how: Boosting, validation: str | None = None, key: str = "row_id") -> Model:
    """Trees for a label of 0 and 1 on number ``columns``, by Newton steps on the log loss from the label's mean on.

    Rows are binned once by quantiles into blocks of bytes in the shared folder. A level of a tree is one aggregate: tasks add up gradients and second
    derivatives by node, column and bin, the sums meet by node and column, and the driver gets the best split of each node. Margins are kept with the blocks and written anew
    after ``EVERY`` trees, and until then worked out again from the trees since. Sums are of integers and draws are by hashes of ``key``, so the model
    does not depend on partitions, lost executors or reruns.

    With a boolean ``validation`` column its rows are not fitted on: after each ``patience`` trees the areas under the curve on them are measured for all of these, and
    trees are kept up to the first best one, once ``patience`` more have brought no better. Without rows of both labels among them all trees are kept. Rows with a null label are left out, null ``validation`` is false; null and NaN values
    are missing and go to the side of each split that gains most. No rows, or a label that never varies, give a model without trees.
    """
    rows = train.filter(F.col(f"`{label}`").isNotNull())
    fit = rows if validation is None else rows.filter(~F.coalesce(F.col(f"`{validation}`"), F.lit(False)))
    mean, size = fit.agg(F.avg(F.col(f"`{label}`").cast("double")), F.count("*")).first()
    if mean is None or not 0 < mean < 1:
        return Model(columns, [[] for _ in columns], 0.0 if mean is None else math.log((mean + 1e-6) / (1 - mean + 1e-6)))
    model = Model(columns, quantile_edges(fit, columns), math.log(mean / (1 - mean)))
    cores = train.sparkSession.sparkContext.defaultParallelism
    # Dealt by key to all cores, in few partitions, as a task's sums are one row a cell however many rows it has.
    tasks = cores * math.ceil(size / (cores * PART_ROWS))
    dealt = rows.repartition(tasks, F.col(f"`{key}`"))
    blocks, count = kept(to_blocks(dealt, columns, label, validation, key, model.edges, model.start)), len(columns)
    best, at, stored = -1.0, how.trees, 0
    measured, base = 0, blocks  # the trees whose areas are known, and the blocks of that time

    def update(trees: list[Tree]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch, row, block in blocks_of(batches, count):
                parts = [batch.column(c).slice(row, 1) for c in ("n", "bins", "label", "held", "hash")]
                yield pa.RecordBatch.from_arrays([*parts, pa.array([block.after(trees).astype("<f8").tobytes()], pa.binary())], [c.split()[0] for c in BLOCK.split(", ")])

        return kept(blocks.mapInArrow(run, BLOCK))

    for number in range(1, how.trees + 1):
        model.trees.append(grow(blocks, tasks, model.trees[stored:], number, how, count))
        if validation is not None and (number % how.patience == 0 or number == how.trees):
            for area in prefix_areas(base, model.trees[measured:], count):
                model.areas.append(area)
                if area is not None and area > best:
                    best, at = area, len(model.areas)
                elif len(model.areas) - at >= how.patience:
                    model.trees = model.trees[:at]
                    return model
            measured = number
        if number < how.trees and (number % EVERY == 0 or measured == number):
            blocks, stored = update(model.trees[stored:]), number
        if measured == number or validation is None:
            base = blocks
    model.trees = model.trees[:at]
    return model
