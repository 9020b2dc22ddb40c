"""Column functions that turn raw transaction fields into typed ones; all stay inside Catalyst."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from swipeline.functions.values import AMOUNT_LABELS, AMOUNT_STEPS, INDUSTRIES, YEAR_SECONDS

#: Seconds of ten mean years, the horizon of the log-spaced time bins.
HORIZON = int(10 * YEAR_SECONDS)


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clip(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def dollars(text: Column, lenient: bool = False) -> Column:
    """'$1,234.50' as a double; bad text raises, or is null if ``lenient``."""
    plain = F.replace(F.replace(text, F.lit("$"), F.lit("")), F.lit(","), F.lit(""))
    return plain.try_cast("double") if lenient else plain.cast("double")


def amount_bin(amount: Column) -> Column:
    """How many bounds the amount reaches, 0 to 6; null and negative amounts are in bin 0."""
    return reduce(lambda a, b: a + b, (F.coalesce((amount >= s).cast("int"), F.lit(0)) for s in AMOUNT_STEPS))


def amount_bucket(amount: Column) -> Column:
    """Right-closed chart bucket with 0 included; Unknown for null, negative and above 1e9."""
    bounds = [*AMOUNT_STEPS, 1e9]
    out = F.when((amount >= 0) & (amount <= bounds[0]), AMOUNT_LABELS[0])
    for low, high, label in zip(bounds, bounds[1:], AMOUNT_LABELS[1:], strict=False):
        out = out.when((amount > low) & (amount <= high), label)
    return out.otherwise("Unknown")


def merchant_clean(name: Column) -> Column:
    return F.regexp_replace(F.upper(name.cast("string")), r"[^A-Z0-9\s\-]", "")


def hash_bucket(text: Column, n: int) -> Column:
    """The first 32 bits of MD5, modulo n: the same on every engine."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def zip3(code: Column, width: int | None = None) -> Column:
    """The first three characters of a ZIP code as an integer; ``width`` restores leading zeros that a float has lost."""
    text = F.replace(F.coalesce(code.cast("string"), F.lit("00000")), F.lit(".0"), F.lit(""))
    text = F.lpad(text, width, "0") if width else text
    return F.lpad(F.substring(text, 1, 3), 3, "0").cast("int")


def state_clean(state: Column) -> Column:
    return F.coalesce(F.nullif(strip(F.upper(state)), F.lit("")), F.lit("XX"))


def txn_time(year: Column, month: Column, day: Column, time: Column) -> Column:
    parts = F.split(F.coalesce(time, F.lit("00:00")), ":", 2)
    return F.make_timestamp_ntz(year.cast("int"), month.cast("int"), day.cast("int"), parts[0].cast("int"), parts[1].cast("int"), F.lit(0))


def fraud_flag(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin("yes", "1"), F.lit(False)).cast("int")


def industry(code: Column, miss: str = "GENERAL", names: list[tuple[int, int, str]] = INDUSTRIES) -> Column:
    """The label of the range that has the code; of ranges that overlap the last one counts."""
    out = None
    for low, high, label in reversed(names):
        out = (F if out is None else out).when(code.between(low, high), label)
    return out.otherwise(miss)


def time_bin(seconds: Column, bins: int = 32) -> Column:
    """Log-spaced bin of a gap: 1 for no gap, bins - 1 from the horizon on."""
    x = F.ln(clip(seconds.cast("double"), 0, HORIZON) + 1)
    return F.least(F.floor(x / math.log(HORIZON + 1) * bins) + 1, F.lit(bins - 1)).cast("int")
