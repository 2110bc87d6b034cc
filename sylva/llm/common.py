"""Shared pieces of the training-data operators: shared storage, Arrow mapping and word hashing."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64


# ---------------------------------------------------------------- storage


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir; where it is unset, a new one if all run in this process."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is unset: name a folder that driver and executors share")
        at = tempfile.mkdtemp(prefix="sylva-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write once to shared storage and read back: cuts lineage, and survives lost executors."""
    spark = df.sparkSession
    path = f"{_own_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sylva_path = path  # for discard()
    return out


def _own_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/sylva/{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by materialise() that no later plan reads."""
    _delete(df.sparkSession, df._sylva_path)


def clean(spark: SparkSession) -> None:
    """Delete all intermediate tables of this application, once its results are written.

    Results are lazy and read them, so no operator can do this by itself.
    """
    _delete(spark, _own_dir(spark))


def on_workers(spark: SparkSession) -> None:
    """Python workers import this package from where the driver did, unless it was shipped to them."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [env.get("PYTHONPATH"), root]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SMALL_SHARE = 8 << 20  # bytes of a file for each core below which rows are dealt out anew


def spread(df: DataFrame) -> DataFrame:
    """df, dealt out over all cores if its files are small for them: a file is read by as many tasks as it has row groups."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SMALL_SHARE else df


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- columns


def sealed(docs: DataFrame, *used: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with the columns `used` under these names and all others as c0, c1, ...; and what gives back all by their own names.

    So no name of an input column, with dots or twice the same, can clash with an operator's own.
    """
    own: list[str] = []
    for k, c in enumerate(docs.columns):
        own.append(c.lower() if c.lower() in used and c.lower() not in own else f"c{k}")
    return docs.toDF(*own), lambda df: df.select(*own).toDF(*docs.columns)


def unused(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be none of docs' columns."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


# ---------------------------------------------------------------- Arrow mapping


Batches = Iterator[pa.RecordBatch]


def map_batches(df: DataFrame, fn: Callable[[Batches], Batches], schema: str | T.StructType) -> DataFrame:
    """mapInArrow; batches of few rows, as one text may be long."""
    on_workers(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    module = fn.__module__

    def run(batches: Batches) -> Batches:
        serve(module)
        try:
            yield from fn(batches)
        finally:
            trim()

    return df.mapInArrow(run, schema)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str | T.StructType) -> DataFrame:
    """map_batches for a function of one batch."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                out = fn(b)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    run.__module__ = fn.__module__
    return map_batches(df, run, schema)


_caches: list[dict | list] = []
_served: list[str] = []


def kept(cache: dict | list) -> dict | list:
    """cache, which a Python worker keeps from task to task while these are of one module; see serve()."""
    _caches.append(cache)
    return cache


def serve(module: str) -> None:
    """Called in a Python worker before a task of `module`: what it kept for another one is dropped.

    Workers live through all stages of a pipeline, so each would hold the caches of all operators otherwise.
    """
    if _served != [module]:
        _served[:] = [module]
        for cache in _caches:
            cache.clear()


def trim() -> None:
    """Give freed memory back to the system: an executor's memory counts its workers', idle ones too."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def texts_of(b: pa.RecordBatch, name: str = "text") -> list[str]:
    return [t or "" for t in b.column(name).to_pylist()]


def chunks(texts: list[str], limit: int = 250_000) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` characters, so that arrays per byte stay small."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


# ---------------------------------------------------------------- hashing


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Hashes to doubles in (0, 1)."""
    return ((x >> U64(12)).astype(np.float64) + 0.5) * 2.0**-52


_TABLE = mix(np.arange(1, 257, dtype=U64) * _BASE)
_powers: list[np.ndarray] = kept([])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        inverse = U64(pow(int(_BASE), -1, 1 << 64))
        _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, b, U64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span of buf, from one prefix sum of a polynomial modulo 2**64."""
    up, down = powers(len(buf) + 1)
    prefix = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=prefix[1:])
    return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64))


_WORD = np.zeros(256, bool)
_WORD[ord("0") : ord("9") + 1] = _WORD[ord("a") : ord("z") + 1] = _WORD[128:] = True


def word_hashes(texts: list[str], word_bytes: np.ndarray = _WORD) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin (one more entry than texts).

    A word is a maximal run of letters and digits of the lower-cased text; every non-ASCII
    character counts as a letter.
    """
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    at = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buf = np.frombuffer(b"\n".join([*raw, b""]), np.uint8)
    edge = np.diff(np.concatenate([[False], word_bytes[buf], [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return span_hashes(buf, start, end), np.searchsorted(start, at)


def shingles(words: np.ndarray, first: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within a text, and where each text's runs begin.

    A text of 1 to size-1 words has the one run of all its words; a text without words has none.
    """
    n = np.diff(first)
    padded = np.where(n > 0, np.maximum(n, size), 0)
    to = np.concatenate([[0], np.cumsum(padded)])
    flat = np.zeros(to[-1], U64)
    flat[np.arange(len(words)) + np.repeat(to[:-1] - first[:-1], n)] = words
    begin = np.concatenate([[0], np.cumsum(np.where(n > 0, padded - size + 1, 0))])
    i = np.arange(begin[-1]) + np.repeat(to[:-1] - begin[:-1], np.diff(begin))
    h = np.zeros(len(i), U64)
    for k in range(size):
        h = h * U64(0xD6E8FEB86659FD93) + flat[i + k]
    return mix(h), begin
