"""What the two vector searches share: valid vectors in packed form, and blocks of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches


def valid(rows: DataFrame, zeros: bool) -> DataFrame:
    """(vec_id, v: array<double>) of the rows that take part: with an id, and vectors of finite numbers.

    zeros: whether vectors of only zeros (or of no component) take part.
    """
    v = F.col("embedding").cast("array<double>")
    df = rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    df = df.where("forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")
    return df if zeros else df.where("exists(v, x -> x <> 0)")


def matrix(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    """Packed vectors as rows; shorter ones are filled with zeros."""
    raw = column.to_pylist()
    size = np.dtype(kind).itemsize
    width = max(map(len, raw), default=0) // size
    return np.frombuffer(b"".join(r.ljust(width * size, b"\0") for r in raw), kind).reshape(len(raw), width)


def lists(column: pa.ListArray) -> list[np.ndarray]:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0, *(len(x) for x in column)]) if column.null_count else (np.asarray(column.offsets) - column.offsets[0].as_py())
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def by_group(df: DataFrame, keys: list[str], order: list[str], parts: int, fn: Callable[[pa.Table], pa.RecordBatch | None], schema: str) -> DataFrame:
    """fn of each group of rows with equal keys, in the order given.

    Like applyInArrow, but groups stream through one Arrow mapping, so that many small groups cost little.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def close() -> Iterator[pa.RecordBatch]:
            if held and (out := fn(pa.Table.from_batches(held).combine_chunks())) is not None:
                yield out
            held.clear()

        for b in batches:
            if not b.num_rows:
                continue
            key = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(b.num_rows, bool)
            for column in key:
                change[1:] |= column[1:] != column[:-1]
            cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                now = tuple(column[lo] for column in key)
                if now != last:
                    yield from close()
                last = now
                held.append(b.slice(lo, hi - lo))
        yield from close()

    run.__module__ = fn.__module__
    return map_batches(df.repartition(parts, *keys).sortWithinPartitions(*keys, *order), run, schema)
