"""Hash-based numbers that are the same in every engine and for every partitioning."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

Key = Column | str | int


def hash32(seed: str | int, *keys: Key) -> Column:
    """The first 32 bits of MD5("seed:key:key"), as a long.  Strings name columns; a null key hashes like ''."""
    parts = [F.lit(str(seed))]
    for k in keys:
        column = k if isinstance(k, Column) else F.lit(str(k)) if isinstance(k, int) else F.col(k)
        parts.append(F.coalesce(column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def uniform(seed: str | int, *keys: Key) -> Column:
    """A double in [0, 1) from hash32."""
    return hash32(seed, *keys) / F.lit(4294967296.0)


def uniform_of(seed: str | int, *keys: object) -> float:
    """uniform() of values on the driver or in a task; numbers and strings as SQL spells them."""
    parts = [str(seed), *("" if k is None else str(k) for k in keys)]
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:8], 16) / 4294967296.0
