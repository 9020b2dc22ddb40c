"""Steps: how one or more columns become a token and its number. A step is driver-side data; its columns are Catalyst expressions."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipeline.functions import clean
from swipeline.functions.murmur import murmur_bucket
from swipeline.operators import learn


@dataclass
class Step:
    name: str
    column: str

    def vocab(self) -> list[str]:
        raise NotImplementedError

    def index(self) -> Column:
        """The token's place in ``vocab``."""
        raise NotImplementedError

    def first_local(self) -> int:
        """The local id of the first token in the compatible layout."""
        return 0

    def token(self) -> Column:
        raise NotImplementedError

    def fit(self, df: DataFrame) -> Step:
        fit_steps(df, [self])
        return self

    def state(self) -> dict:
        return {"kind": type(self).__name__} | asdict(self)


@dataclass
class FixedInt(Step):
    """An integer clipped to [low, high], as prefix_number padded to ``width``; null counts as low."""

    prefix: str = ""
    low: int = 0
    high: int = 23
    width: int = 0

    def clipped(self) -> Column:
        return clean.clip(F.coalesce(F.col(self.column), F.lit(self.low)), self.low, self.high).cast("int")

    def label(self, number: Column) -> Column:
        return F.format_string(f"%0{self.width}d", number) if self.width else number.cast("string")

    def token(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}_"), self.label(self.clipped()))

    def index(self) -> Column:
        return self.clipped() - self.low

    def first_local(self) -> int:
        return self.low

    def vocab(self) -> list[str]:
        return [f"{self.prefix}_{k:0{self.width}d}" if self.width else f"{self.prefix}_{k}" for k in range(self.low, self.high + 1)]


@dataclass
class HashBucket(Step):
    """A string's bucket of ``buckets``, by the first 32 bits of its 'md5' or by 32-bit 'murmur' with a seed; null counts as the empty string."""

    prefix: str = "MERCH"
    buckets: int = 2048
    method: str = "md5"
    seed: int = 0

    def index(self) -> Column:
        text = F.coalesce(F.col(self.column).cast("string"), F.lit(""))
        if self.method == "murmur":
            return murmur_bucket(text, self.buckets, self.seed).cast("int")
        if self.method != "md5":
            raise ValueError(f"unknown hash {self.method}")
        return clean.hash_bucket(text, self.buckets).cast("int")

    def token(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}_"), self.index().cast("string"))

    def vocab(self) -> list[str]:
        return [f"{self.prefix}_{k}" for k in range(self.buckets)]


@dataclass
class Mapping(Step):
    """A value's label; ``labels`` None takes values as their own labels. Misses and nulls get ``default``.

    With ``learned`` the values are the distinct ones of the table it is fitted on, sorted as strings, ``most`` at most; fitted without a table, every
    value passes through as its own label, though only the default has a number.
    """

    prefix: str = ""
    values: list[str] = field(default_factory=list)
    labels: dict[str, str] | None = None
    default: str = "UNK"
    learned: bool = False
    most: int = 100_000

    def label(self) -> Column:
        text = F.col(self.column).cast("string")
        if self.labels is None:
            if not self.values:
                return F.coalesce(text, F.lit(self.default)) if self.learned else F.lit(self.default)
            return F.when(text.isin(self.values), text).otherwise(self.default)
        table = F.create_map(*(F.lit(x) for pair in self.labels.items() for x in pair))
        return F.coalesce(F.try_element_at(table, text), F.lit(self.default))

    def all_labels(self) -> list[str]:
        own = sorted(set(self.labels.values())) if self.labels is not None else self.values
        return list(dict.fromkeys([*own, self.default]))

    def token(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}_"), self.label())

    def index(self) -> Column:
        names = self.all_labels()
        place = F.array_position(F.array(*map(F.lit, names)), self.label())
        return F.when(place > 0, place - 1).otherwise(names.index(self.default)).cast("int")

    def vocab(self) -> list[str]:
        return [f"{self.prefix}_{x}" for x in self.all_labels()]


@dataclass
class Ranges(Step):
    """The label of the inclusive integer range that has the value; the last one that does counts."""

    prefix: str = "CAT"
    ranges: list[tuple[int, int, str]] = field(default_factory=list)
    default: str = "GENERAL"

    def all_labels(self) -> list[str]:
        return list(dict.fromkeys([*sorted({x for _, _, x in self.ranges}), self.default]))

    def label(self) -> Column:
        return clean.industry(F.col(self.column), self.default, self.ranges)

    def token(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}_"), self.label())

    def index(self) -> Column:
        return (F.array_position(F.array(*map(F.lit, self.all_labels())), self.label()) - 1).cast("int")

    def vocab(self) -> list[str]:
        return [f"{self.prefix}_{x}" for x in self.all_labels()]


@dataclass
class LearnedBins(Step):
    """Ordinal bins with edges learned from a table: exact quantiles, equal widths, or midpoints of 1-D k-means centres.

    Quantiles interpolate between two rows of the sorted column. Nulls and NaN are no rows of it; without any there are no edges.
    """

    prefix: str = ""
    bins: int = 10
    strategy: str = "quantile"
    edges: list[float] = field(default_factory=list)

    def shares(self) -> list[float]:
        return [k / self.bins for k in range(1, self.bins)]

    def ranks(self, n: int) -> list[int]:
        """The ranks between which the quantiles of ``n`` rows lie."""
        return sorted({f((n - 1) * p) for p in self.shares() for f in (math.floor, math.ceil)}) if n else []

    def cut_at(self, n: int, values: dict[int, float]) -> None:
        places = [(n - 1) * p for p in self.shares()] if n else []
        self.edges = [values[math.floor(p)] + (values[math.ceil(p)] - values[math.floor(p)]) * (p - math.floor(p)) for p in places]

    def centres(self, df: DataFrame) -> None:
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.feature import VectorAssembler

        x = df.select(learn.number(self.column).alias("x")).filter("x IS NOT NULL")
        rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(x)
        found = sorted(float(c[0]) for c in KMeans(k=self.bins, seed=42).fit(rows).clusterCenters())
        self.edges = [(a + b) / 2 for a, b in zip(found, found[1:], strict=False)]

    def index(self) -> Column:
        x = F.col(self.column).cast("double")
        return sum((F.coalesce((x >= e).cast("int"), F.lit(0)) for e in self.edges), F.lit(0)).cast("int")

    def token(self) -> Column:
        return F.concat(F.lit(f"{self.prefix}_"), self.index().cast("string"))

    def vocab(self) -> list[str]:
        return [f"{self.prefix}_{k}" for k in range(self.bins)]


@dataclass
class TimeDelta(Step):
    """The seconds since the account's last transaction, by bins of their logarithm; null counts as 0."""

    prefix: str = "TDIF"
    bins: int = 32

    def index_of(self, seconds: Column) -> Column:
        return clean.time_bin(F.coalesce(seconds, F.lit(0)), self.bins)

    def token_of(self, seconds: Column) -> Column:
        return F.concat(F.lit(f"{self.prefix}_"), self.index_of(seconds).cast("string"))

    def index(self) -> Column:
        return self.index_of(F.col(self.column))

    def token(self) -> Column:
        return self.token_of(F.col(self.column))

    def vocab(self) -> list[str]:
        return [f"{self.prefix}_{k}" for k in range(self.bins)]


def fit_steps(df: DataFrame, steps: list[Step]) -> None:
    """Fits all ``steps`` that learn, from two scans of ``df`` in all: one for sketches of the binned columns, one for the values of mappings
    and the exact quantiles between brackets of the sketches. Mappings alone take one scan, equal widths the first; k-means walks over its column by itself.
    """
    maps = [s for s in steps if isinstance(s, Mapping) and s.learned]
    bins = [s for s in steps if isinstance(s, LearnedBins)]
    for s in bins:
        if s.strategy not in ("quantile", "uniform", "kmeans"):
            raise ValueError(f"unknown strategy {s.strategy}")
        if s.strategy == "kmeans":
            s.centres(df)
    spanned = [s for s in bins if s.strategy != "kmeans"]
    columns = list(dict.fromkeys(s.column for s in spanned))
    spans = dict(zip(columns, learn.spans(df, columns), strict=True))
    ranks: dict[str, list[int]] = {}
    for s in spanned:
        n, low, high, _ = spans[s.column]
        if s.strategy == "uniform":
            s.edges = [low + (high - low) * p for p in s.shares()] if n else []
        elif n:
            ranks[s.column] = sorted({*ranks.get(s.column, []), *s.ranks(n)})
    wanted = {c: (r, learn.brackets(r, spans[c][0], spans[c][3])) for c, r in ranks.items()}
    if maps or wanted:
        values, found = learn.values_and_ranks(df, [s.column for s in maps], [s.most for s in maps], wanted)
        for s, own in zip(maps, values, strict=True):
            s.values = own
    for s in spanned:
        if s.strategy == "quantile":
            s.cut_at(spans[s.column][0], found[s.column] if s.column in wanted else {})


def from_state(state: dict) -> Step:
    kinds = {k.__name__: k for k in (FixedInt, HashBucket, Mapping, Ranges, LearnedBins, TimeDelta)}
    return kinds[state["kind"]](**{k: v for k, v in state.items() if k != "kind"})
