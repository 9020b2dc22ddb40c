"""Embeddings by a model that is plugged in: batches of ids in, states by position out, pooled to a vector a row."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import Broadcast
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

#: (ids, mask), both rows x positions -> states, rows x positions x dimensions. States at positions whose mask is 0 play no part.
Forward = Callable[[np.ndarray, np.ndarray], np.ndarray]
#: Called once in each Python worker: loads the weights and gives the forward pass.
Provider = Callable[[], Forward]


def load_weights(spark: SparkSession, path: str, most: int = 1 << 30) -> Broadcast:
    """The files under ``path``, by name, read by Spark wherever they lie and sent once to each executor; more than ``most`` bytes raise a ValueError."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    size = files.agg(F.sum("length")).first()[0] or 0
    if size > most:
        raise ValueError(f"{size} bytes of weights, more than {most}")
    return spark.sparkContext.broadcast({r["path"].rsplit("/", 1)[-1]: bytes(r["content"]) for r in files.collect()})


def pooled(states: np.ndarray, mask: np.ndarray, how: str) -> np.ndarray:
    """The state at the last of as many positions as the mask has ones (the first for none), or the mean over the ones (by 1 at least)."""
    n = mask.sum(axis=1)
    if how == "last":
        return states[np.arange(len(states)), np.maximum(n - 1, 0)]
    return (states * mask[:, :, None]).sum(axis=1) / np.maximum(n, 1)[:, None]


def embed_with(df: DataFrame, provider: Provider, pooling: str = "mean", context: int = 128, windows: bool = False, batch: int = 256, pad: int = 0, ids: str = "input_ids", key: str = "row_id") -> DataFrame:
    """(key, embedding): the provider's states of each row's ids, pooled by 'mean' or 'last', in batches of ``batch`` rows.

    Rows are padded to ``context`` ids. Longer ones are cut to it; with ``windows`` they are read whole: 'mean' is over the states of all of a row's windows of ``context`` ids,
    'last' the last state of its last ``context`` ids. Windows are rows of their own until their sums, one vector each, are added up by key, so a long
    row is no single task's work; keys must differ then. Null or empty ids are a row of padding. The provider is made once in each Python worker.
    """
    if pooling not in ("mean", "last"):
        raise ValueError(f"unknown pooling {pooling}")
    if context < 1:
        raise ValueError("the context holds no id")

    def make() -> Callable:
        forward = provider()

        def predict(inputs: np.ndarray) -> np.ndarray:
            mask = (inputs != pad).astype(np.int64)
            return pooled(np.asarray(forward(inputs, mask), np.float64), mask, pooling).astype(np.float32)

        return predict

    model = predict_batch_udf(make, return_type=ArrayType(FloatType()), batch_size=batch, input_tensor_shapes=[[context]])
    row = F.coalesce(F.col(ids).cast("array<bigint>"), F.array().cast("array<bigint>"))
    filled = lambda c: F.slice(F.concat(c, F.array_repeat(F.lit(pad).cast("long"), context)), 1, context)
    if windows and pooling == "mean":
        starts = F.sequence(F.lit(1), F.greatest(F.size("_ids"), F.lit(1)), F.lit(context))
        parts = df.select(key, row.alias("_ids")).select(key, "_ids", F.explode(starts).alias("_at")).select(key, F.slice("_ids", F.col("_at"), F.lit(context)).alias("_part"))
        found = parts.select(key, F.size(F.filter("_part", lambda x: x != pad)).alias("_n"), model(filled("_part")).alias("_v"))
        sums = found.select(key, "_n", F.posexplode("_v").alias("_d", "_x")).groupBy(key, "_d").agg((F.sum(F.col("_x").cast("double") * F.col("_n")) / F.greatest(F.sum("_n"), F.lit(1))).cast("float").alias("_x"))
        return sums.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_d", "_x"))), lambda s: s["_x"]).alias("embedding"))
    if windows:
        real = F.filter(row, lambda x: x != pad)
        row = F.when(F.size(real) > context, F.slice(real, F.greatest(F.size(real) - context + 1, F.lit(1)), context)).otherwise(row)
    return df.select(key, model(filled(row)).alias("embedding"))


class CausalAttention:
    """A provider of one causal attention layer with weights drawn by a seed, or given as a table of arrays; a small model for trials and tests.

    Each position's state is its token's vector with its place added, plus a mix of the values of the positions up to it.
    """

    def __init__(self, vocabulary: int = 0, dim: int = 16, seed: int = 42, weights: Broadcast | None = None, name: str = "model.npz"):
        self.vocabulary, self.dim, self.seed, self.weights, self.name = vocabulary, dim, seed, weights, name

    def arrays(self) -> dict[str, np.ndarray]:
        if self.weights is not None:
            import io

            return dict(np.load(io.BytesIO(self.weights.value[self.name])))
        draw = np.random.default_rng(self.seed)
        return {"tokens": draw.normal(size=(self.vocabulary, self.dim))} | {k: draw.normal(size=(self.dim, self.dim)) / self.dim**0.5 for k in ("query", "key", "value")}

    def __call__(self) -> Forward:
        table = self.arrays()
        dim = table["tokens"].shape[1]

        def forward(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
            place = np.arange(ids.shape[1])
            x = table["tokens"][ids] + np.sin(place[:, None] / 10000.0 ** (np.arange(dim) / dim))
            query, key, value = (x @ table[k] for k in ("query", "key", "value"))
            score = query @ key.transpose(0, 2, 1) / dim**0.5
            seen = (place[None, :] <= place[:, None]) & (mask[:, None, :] > 0) | np.eye(len(place), dtype=bool)
            score = np.where(seen, score, -np.inf)
            share = np.exp(score - score.max(axis=2, keepdims=True))
            return x + share / share.sum(axis=2, keepdims=True) @ value

        return forward
