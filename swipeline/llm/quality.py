"""Quality: compressed sizes with zstandard dictionaries of good and of bad text, as a calibrated score."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from swipeline.llm.labelled import held_out, logistic, training_sample


@dataclass
class Model:
    """Two dictionaries, and a logistic curve from the normalised difference of compressed sizes to the chance of class 1.

    ``slope`` and ``bias`` calibrate; without dictionaries the bias alone gives every score.
    """

    good: bytes = b""
    bad: bytes = b""
    block: int = 512
    level: int = 3
    slope: float = 0.0
    bias: float = 0.0

    def __post_init__(self):
        self.made = None

    def __getstate__(self):
        return self.__dict__ | {"made": None}

    def difference(self, text: str) -> float:
        """(bad - good) / bytes of the text, of its sizes compressed with either dictionary; 0 for no text.

        A text is compressed in blocks of ``block`` bytes, so all of it meets the dictionaries and not only its beginning.
        """
        if self.made is None:
            self.made = []
            for raw in (self.good, self.bad):
                words = zstandard.ZstdCompressionDict(raw)
                words.precompute_compress(level=self.level)
                self.made.append(zstandard.ZstdCompressor(level=self.level, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False))
        parts = blocks_of(text, self.block)
        good, bad = (sum(len(c.compress(x)) for x in parts) for c in self.made)
        return (bad - good) / max(1, sum(map(len, parts)))

    def score(self, text: str) -> float:
        z = self.difference(text) * self.slope + self.bias if self.good else self.bias
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def blocks_of(text: str, block: int) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[k : k + block] for k in range(0, len(data), block)]


def build(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary trained on ``samples``, or their plain text where they are too few to train on."""
    try:
        return zstandard.train_dictionary(min(size, max(256, sum(map(len, samples)) // 8)), samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", dictionary: int = 48 * 1024, dictionary_blocks: int = 8000, fit_rows: int = 8000, sample: int = 1024, block: int = 512, level: int = 3) -> Model:
    """A model fitted on at most about ``fit_rows`` labelled rows, half of each class.

    A hash of the text parts the sample: one half makes the dictionaries, the other the curve, weighted to the labels' true
    shares. The driver gets ``dictionary_blocks`` pieces of ``sample`` bytes a class at most, chosen by hash among those of all the half's whole texts, and a number
    a row of the other half. With one class missing, every score is the smoothed share.
    """
    rows, n = training_sample(docs, labels, label, fit_rows)
    model = Model(block=block, level=level, bias=float(np.log((n[1] + 0.5) / (n[0] + 0.5))))
    part = F.pmod(F.xxhash64("text", F.lit("part")), F.lit(1000)) < 500

    @F.pandas_udf("array<binary>")
    def cut_up(text):
        return text.map(lambda t: blocks_of(t, sample))

    samples = []
    for y in (0, 1):
        found = rows.filter(part & (F.col("y") == y)).select(F.explode(cut_up("text")).alias("b")).orderBy(F.xxhash64("b"), "b").limit(dictionary_blocks).collect()
        samples.append([bytes(r["b"]) for r in found])
    if not min(n) or not min(map(len, samples)):
        return model
    model.bad, model.good = (build(x, dictionary) for x in samples)

    @F.pandas_udf("double")
    def measured(text):
        return text.map(model.difference)

    seen = rows.filter(~part).select(measured("text").alias("x"), "y").collect() or rows.select(measured("text").alias("x"), "y").collect()
    y, x = np.array([r["y"] for r in seen]), np.array([[r["x"]] for r in seen])
    weight = np.where(y == 1, n[1] / max(1, (y == 1).sum()), n[0] / max(1, (y == 0).sum()))
    centre, scale = float(x.mean()), float(x.std()) + 1e-9
    slope, bias = logistic((x - centre) / scale, y, weight, 1e-5, 3000)
    model.slope = float(slope[0]) / scale
    model.bias = bias - centre * model.slope
    return model


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """(columns of ``docs``, held_out, score, predicted) of every row; see ``fit`` for the options.

    The fit never sees the fold whose crc32 of doc_id leaves 0; doc_id, source, lang and labels are no inputs of a score.
    Null texts count as empty, and empty ones have a difference of 0; texts of any length are read whole. Columns of docs named like the new ones are
    replaced, others carried; repeated rows have equal scores; an empty table gives no rows.
    """
    model = fit(docs, labels, **options)

    @F.pandas_udf("double")
    def scored(text):
        return text.map(model.score)

    out = docs.drop("held_out", "score", "predicted").withColumn("score", scored(F.coalesce("text", F.lit(""))))
    return out.withColumns({"held_out": held_out(), "predicted": (F.col("score") >= threshold).cast("int")})
