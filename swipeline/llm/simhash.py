"""SimHash near-dedup: fingerprints, and links between them by segment-popcount embedding and a grid range-join."""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.llm.common import components, cut, join_classes

#: Fingerprints link at so many differing bits or fewer; the grid and the stars below rest on its being two.
DISTANCE = 2
#: The low bit of each of 32 segments of two bits.
EVEN = 0x5555555555555555
#: What is added to a fingerprint to number its class: the sum is above all doc_ids.
NAMELESS = Decimal(1 << 64)
NO_ID = (1 << 63) - 1
LANES = np.uint64(0x0101010101010101)


def bit_counts(hashes: np.ndarray, sizes: list[int]) -> np.ndarray:
    """How many of each run of ``hashes`` have each bit, lowest bit first: eight byte lanes at a time, in runs of 255 at most."""
    starts, owner, at = [], [], 0
    for k, n in enumerate(sizes):
        cuts = range(at, at + n, 255)
        starts.extend(cuts)
        owner.extend([k] * len(cuts))
        at += n
    total = np.zeros((len(sizes), 64), np.int64)
    if starts:
        for bit in range(8):
            lanes = np.add.reduceat((hashes >> np.uint64(bit)) & LANES, starts)
            np.add.at(total[:, bit::8], owner, lanes.view(np.uint8).reshape(-1, 8).astype(np.int64))
    return total


def fingerprints(texts: list[str | None], words: int = 3, seed: int = 42) -> np.ndarray:
    """SimHash of each text over its shingles of ``words`` words; fewer words are one shingle, none gives zero."""
    digest, hashes, sizes = xxhash.xxh64_intdigest, [], []
    for text in texts:
        tokens = (text or "").encode("utf-8", "replace").lower().split()
        if not tokens:
            sizes.append(0)
            continue
        line, ends, at = b" ".join(tokens), [], -1
        for t in tokens:
            at += len(t) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-1])]
        last = ends[words - 1 :] or [ends[-1]]
        hashes.extend([digest(line[a:b], seed) for a, b in zip(starts, last, strict=False)])
        sizes.append(len(last))
    counts = bit_counts(np.array(hashes, np.uint64), sizes)
    bits = (2 * counts > np.array(sizes)[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def fingerprint(text: Column, words: int = 3) -> Column:
    """The unsigned 64-bit fingerprint as a long of the same bits, in Arrow batches."""

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        parts = [fingerprints(texts.iloc[k : k + 1000].tolist(), words) for k in range(0, len(texts), 1000)]
        return pd.Series(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64))

    return run(text)


def segment_counts(fp: Column) -> Column:
    """The embedding: how many bits are set in each of the 32 segments of two bits, packed as 32 numbers of two bits."""
    up = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(up).bitwiseAND(F.lit(EVEN)).bitwiseOR(F.shiftleft(fp.bitwiseAND(up).bitwiseAND(F.lit(EVEN)), 1))


def manhattan(x: Column, y: Column) -> Column:
    """Manhattan distance of two packed embeddings: 1 for each segment that differs, 1 more where 0 meets 2."""
    d = x.bitwiseXOR(y)
    low, high = d.bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned(d, 1).bitwiseAND(F.lit(EVEN))
    return F.bit_count(low.bitwiseOR(high)) + F.bit_count(high.bitwiseAND(F.bitwise_not(low)))


def grid_links(classes: DataFrame, blocks: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(pairs (a, b) of the cells with at most ``crowd`` fingerprints, the classes that lie in a fuller cell).

    The embeddings' 32 dimensions are cut into ``blocks``; two bits touch two of them at most, so linked fingerprints agree in all
    others and share a cell of the grid for each two blocks left out. Pairs in a cell within the Manhattan bound are verified
    by exact Hamming distance.
    """
    width = 64 // blocks
    block = [((1 << width) - 1) << width * k for k in range(blocks)]
    masks = [(1 << 64) - 1 - block[i] - block[j] for i in range(blocks) for j in range(i)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]
    cells = classes.withColumn("counts", segment_counts(F.col("fp"))).select(
        "fp", "rep", "counts", F.posexplode(F.array(*(F.col("counts").bitwiseAND(F.lit(m)) for m in masks))).alias("grid", "cell")
    )
    full = cells.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    cells = cut(cells.join(full, ["grid", "cell"]))
    x, y = (cells.filter(F.col("n") <= crowd).select("grid", "cell", *(F.col(c).alias(f"{c}_{s}") for c in ("fp", "rep", "counts"))) for s in "xy")
    pairs = (
        x.join(y, ["grid", "cell"])
        .filter(F.col("fp_x") < F.col("fp_y"))
        .filter(manhattan(F.col("counts_x"), F.col("counts_y")) <= DISTANCE)
        .filter(F.bit_count(F.col("fp_x").bitwiseXOR(F.col("fp_y"))) <= DISTANCE)
        .select(F.col("rep_x").alias("a"), F.col("rep_y").alias("b"))
    )
    return pairs, cut(cells.filter(F.col("n") > crowd).select("fp", "rep").distinct())


def links(classes: DataFrame, crowd: int = 64, coarse: int = 1 << 20) -> DataFrame:
    """Pairs (a, b) of representatives that connect all fingerprints within two bits.

    ``classes`` has fp, each once, and rep. Flipping a bit moves one segment's count by one, so the embeddings of
    linked fingerprints are at most DISTANCE apart by Manhattan distance. The grid has 4 blocks (6 cells a fingerprint, some 24 bits
    a cell), and 8 (28 cells of some 36 bits) for more than ``coarse`` fingerprints, 16 for more than ``coarse`` squared over 2**8,
    so that a cell holds few by chance. What lies in a cell of more than ``crowd``, which would give pairs by the square of its size, goes
    to a grid of twice as many blocks, and from the finest on is linked exactly by the values within one bit: two fingerprints are within two bits when some
    value is within one bit of both, all that share such a value are linked with each other, and a star on the smallest connects them.
    """
    n = classes.count()
    blocks = 4 if n <= coarse else 8 if n <= coarse * coarse >> 8 else 16
    out = None
    for level in dict.fromkeys([blocks, min(16, 2 * blocks)]):
        pairs, classes = grid_links(classes, level, crowd)
        out = pairs if out is None else out.unionByName(pairs)
        if classes.isEmpty():
            return out.distinct()
    flips = [0, *(1 << k for k in range(63)), -(1 << 63)]
    near = classes.select("rep", F.explode(F.array(*(F.col("fp").bitwiseXOR(F.lit(m)) for m in flips))).alias("value"))
    hubs = near.groupBy("value").agg(F.min("rep").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    stars = near.join(hubs, "value").select("a", F.col("rep").alias("b")).filter("a <> b")
    return out.unionByName(stars).distinct()


def named_classes(prints: DataFrame) -> DataFrame:
    """(fp, n, root, component) of each fingerprint of ``prints`` (fp, doc_id): how many rows have it, and two numbers for its component.

    ``root`` is the component's own; ``component`` is the smallest doc_id that can be reached, which two components may share, or
    above all doc_ids if no row that can be reached has one.
    """
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    wide = lambda c: F.col(c).cast("decimal(20,0)")
    nodes = cut(classes.select("fp", "n", "least", (wide("fp") + F.lit(NAMELESS)).cast("decimal(20,0)").alias("rep")))
    roots = components(links(nodes.select("fp", "rep")))
    joined = cut(nodes.join(roots, F.col("rep") == F.col("node"), "left").select("fp", "n", "least", F.coalesce("component", "rep").alias("root")))
    names = cut(joined.groupBy("root").agg(F.coalesce(F.min(wide("least")), F.first("root")).cast("decimal(20,0)").alias("component"), F.count("*").alias("_size")))
    return join_classes(joined, names, ["root"], "_size").select("fp", "n", "root", "component")


def simhash_dedup(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id) of every row of ``docs``; other columns play no part, whatever their names.

    Fingerprints link when they differ in two bits or fewer; component_id is the smallest doc_id that can be
    reached, its own included. Equal fingerprints, those of empty and null texts too, are one class before
    any pairs are made. A null doc_id keeps its row and never names a component (null if a component has no other). Of rows that share
    a doc_id each has the component of its own text. Texts of any length are read whole. An empty table gives no rows.
    """
    prints = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), fingerprint(F.col("text"), words).alias("fp")))
    named = cut(named_classes(prints))
    name = F.when(F.col("component") < F.lit(Decimal(1 << 63)), F.col("component").cast("long"))
    return join_classes(prints, named, ["fp"], "n").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), name.alias("component_id"))


def keep_one(docs: DataFrame, words: int = 3) -> DataFrame:
    """The rows of ``docs``, all but one of each component of near duplicates: the smallest doc_id stays, a null one only for want of another.

    Rows are told apart by a number of their own, so rows that share a doc_id or are repeated are judged by their texts, and one of equal rows
    stays. Columns of ``docs`` may have any names. Only the numbers of rows to drop are joined with the documents. An empty table gives no rows.
    """
    names = [f"_{k}" for k in range(len(docs.columns))]
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    rows = cut(docs.toDF(*names).withColumns({"row": F.monotonically_increasing_id(), "fp": fingerprint(text, words)}))
    prints = rows.select(doc_id.cast("long").alias("doc_id"), "row", "fp")
    placed = cut(join_classes(prints, cut(named_classes(prints)), ["fp"], "n").select("root", "row", F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("id"), "row").alias("rank")))
    groups = cut(placed.groupBy("root").agg(F.min("rank").alias("best"), F.count("*").alias("n")).filter("n > 1"))
    gone = join_classes(placed, groups, ["root"], "n").filter("row <> best.row").select("row")
    return rows.join(gone, "row", "left_anti").select(*names).toDF(*docs.columns)
