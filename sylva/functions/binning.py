"""Coarser numbers, so that a numeric feature has few distinct values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def down_rez(value: Column | str, base: float = 2.0, precision: float = 100.0) -> Column:
    """Rounds the magnitude to a multiple of the power of `base` that leaves about `precision` steps.

    0 stays 0, the sign is kept, null and NaN give null.
    """
    v = F.col(value) if isinstance(value, str) else value
    v = F.nanvl(v.cast("double"), F.lit(None).cast("double"))
    step = F.pow(F.lit(float(base)), F.floor(F.ln(F.abs(v) / precision) / F.ln(F.lit(float(base)))).cast("double"))
    return F.when(v == 0, F.lit(0.0)).otherwise(F.signum(v) * F.floor(F.abs(v) / step + 0.5).cast("double") * step)


def dyadic(value: Column | str, level: int) -> Column:
    """The lower end of the dyadic interval of length 2**level that holds the value."""
    v = F.col(value) if isinstance(value, str) else value
    width = float(2.0**level)
    return F.floor(v.cast("double") / width).cast("double") * width
