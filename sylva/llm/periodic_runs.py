"""Periodic runs of the words of a text: every maximal repetition, and the text without its repeated periods.

A run is a stretch of consecutive words with smallest period q that no neighbouring word extends; it is reported when it is
long enough and holds enough periods.  Each run has a Lyndon root: under one of the two orders of words, some place i in
its first period begins a longest Lyndon word that is exactly one period long.  These words are found for all places by one
stack, scanned right to left, under either order: the longest Lyndon word at i ends where the next smaller suffix begins,
and suffixes that i's is smaller than are popped.  Suffixes are compared by their longest common extension, a binary search
on rolling hashes whose answer is verified word by word; stretches known to repeat at a distance are remembered, so a
periodic text costs as much as another.  There is no suffix array.

A text is one row of one task; its words and two arrays of integers are in memory while it is worked on.

Edge cases: a null text is the empty text, which has no runs and collapses to the empty string; words are what stands
between spaces and the characters U+0009 to U+000D; rows that are repeated, or have no doc_id, are worked out like others;
further columns stay, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, map_arrow, mix, powers, spread, table, unused

MIN_WORDS, MIN_PERIODS = 24, 3
DIRECT = 8  # words compared one by one before a search on hashes
RUNS = "array<struct<start:long,length:long,period:long>>"
_M = (1 << 64) - 1


class Extensions:
    """Longest common extensions of a list of numbers."""

    def __init__(self, x: list[int]):
        self.x, self.n = x, len(x)
        self.known: dict[int, tuple[int, int]] = {}  # distance p: the stretch [lo, hi) of places equal to those p after, up to a difference
        self._prefix: np.ndarray | None = None

    @property
    def prefix(self) -> np.ndarray:
        """Sums of the polynomial of the words' hashes modulo 2**64."""
        if self._prefix is None:
            words = mix(np.array(self.x, np.int64).astype(U64) + U64(0x51_7CC1B727220A95))
            self._prefix = np.concatenate([np.zeros(1, U64), np.cumsum(words * powers(self.n + 1)[0][: self.n])])
        return self._prefix

    def forward(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on, i < j."""
        x, n, p = self.x, self.n, j - i
        lo, hi = self.known.get(p, (0, -1))
        if lo <= i < hi:
            return hi - i
        k, end = 0, min(DIRECT, n - j)
        while k < end and x[i + k] == x[j + k]:
            k += 1
        if k < end or j + k == n:
            return k
        if i < lo <= i + k:  # reaches the stretch that is known
            k = hi - i
        else:
            k = self._search(i, j, n - j)
        self.known[p] = (i, i + k)
        return k

    def backward(self, i: int, j: int) -> int:
        """How many words before i equal those before j, i < j."""
        lo, hi = 0, i
        prefix, up = self.prefix, int(powers(self.n + 1)[0][j - i])
        while lo < hi:
            k = (lo + hi + 1) // 2
            if self._equal(prefix, up, i - k, j - k, k):
                lo = k
            else:
                hi = k - 1
        x = self.x
        if x[i - lo : i] == x[j - lo : j]:
            return lo
        return next(k for k in range(lo) if x[i - 1 - k] != x[j - 1 - k])

    def _search(self, i: int, j: int, most: int) -> int:
        lo, hi = 0, most
        prefix, up = self.prefix, int(powers(self.n + 1)[0][j - i])
        while lo < hi:
            k = (lo + hi + 1) // 2
            if self._equal(prefix, up, i, j, k):
                lo = k
            else:
                hi = k - 1
        x = self.x
        if x[i : i + lo] == x[j : j + lo]:  # equal words have equal hashes, so it is the longest
            return lo
        return next(k for k in range(lo) if x[i + k] != x[j + k])

    @staticmethod
    def _equal(prefix: np.ndarray, up: int, i: int, j: int, k: int) -> bool:
        return (int(prefix[i + k]) - int(prefix[i])) * up & _M == int(prefix[j + k]) - int(prefix[j]) & _M


def next_smaller(x: list[int], lce: Extensions) -> list[int]:
    """Where the next smaller suffix begins, of every suffix of x; the end of x is smaller than all words."""
    n = len(x)
    y, ends = [*x, min(x) - 1], [n] * n
    for i in range(n - 2, -1, -1):
        a, j = y[i], i + 1
        while a <= (b := y[j]):
            if a == b:
                c, d = y[i + 1], y[j + 1]
                if c == d:
                    k = lce.forward(i, j)
                    c, d = y[i + k], y[j + k]
                if c > d:
                    break
            j = ends[j]
        ends[i] = j
    return ends


def runs(words: list, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least min_words words and min_periods (3 or more) periods, in order.

    With three periods, the run holds the Lyndon root that begins in its first period twice in a row.
    """
    if min_periods < 3:
        raise ValueError("runs of fewer than three periods are not looked for")
    if len(words) < max(min_words, 3):
        return []
    number = {w: k for k, w in enumerate(dict.fromkeys(words))}
    x = list(map(number.__getitem__, words))
    lce, n, found, at = Extensions(x), len(x), set(), np.array([*x, -1])
    for order in (x, [-v for v in x]):
        lce.known.clear()
        end = np.array(next_smaller(order, lce))
        start = np.flatnonzero((at[end] == at[:-1]) & (2 * end - np.arange(n) <= n))
        period = end[start] - start
        if not len(start):
            continue
        prefix, up = lce.prefix, powers(n + 1)[0]
        i, j = start, start + period
        twice = (prefix[j] - prefix[i]) * up[period] == prefix[j + period] - prefix[j]
        reached: dict[int, int] = {}
        for i, p in zip(start[twice].tolist(), period[twice].tolist()):
            if i + p <= reached.get(p, 0):  # a later period of a run that was found
                continue
            r, before = lce.forward(i, i + p), lce.backward(i, i + p)
            s, e = i - before, i + p + r
            reached[p] = e
            if e - s >= max(min_words, min_periods * p):
                found.add((s, e - s, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def kept(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay when each run keeps its first period only."""
    change = np.zeros(n + 1, np.int64)
    for s, length, p in found:
        change[s + p] += 1
        change[s + length] -= 1
    return np.cumsum(change[:-1]) == 0


def find_runs(docs: DataFrame, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS, text: str = "text") -> tuple[DataFrame, str, str]:
    """docs with two more columns, and their names: the runs of the text, and the text without repeated periods, its words
    joined by one space."""
    at, collapsed = unused(docs, "runs"), unused(docs, "collapsed")
    names = [f"c{k}" for k in range(len(docs.columns))]  # input columns may have any names
    place = docs.columns.index(text)
    plain = docs.toDF(*names)
    out_runs = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def work(b: pa.RecordBatch) -> pa.Table:
        all_runs, texts = [], []
        for raw in b.column(place).cast(pa.binary()).to_pylist():
            words = (raw or b"").split()  # bytes split at just these six characters
            found = runs(words, min_words, min_periods)
            if found:
                words = [words[k] for k in np.flatnonzero(kept(len(words), found))]
            all_runs.append([{"start": s, "length": n, "period": p} for s, n, p in found])
            texts.append(b" ".join(words))
        columns = [*b.columns, pa.array(all_runs, out_runs), pa.array(texts, pa.binary()).cast(pa.string())]
        return pa.Table.from_arrays(columns, [*names, "runs", "collapsed"])

    schema = T.StructType([*plain.schema.fields, *T.StructType.fromDDL(f"runs {RUNS}, collapsed string").fields])
    return map_arrow(plain, work, schema).toDF(*docs.columns, at, collapsed), at, collapsed


def with_periods(text: Column, doc_id: Column) -> Column:
    """The text, of which one in ten by a checksum of the id is made periodic from some word on."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n).cast("int")
    rest = n - a
    p = (F.lit(1) + F.floor(rest / (F.lit(3) + F.pmod(g, F.lit(8))))).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int")))
    periodic = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(cycle, F.lit(1), rest)), " ")
    return F.when((F.pmod(h, F.lit(10)) == 0) & text.rlike(r"[^\x20\x09-\x0D]"), periodic).otherwise(text)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    docs = docs.withColumn("text", with_periods(F.col("text"), F.col("doc_id")))
    out, at, collapsed = find_runs(docs)
    # The greatest length/period: fractions are compared by their cross products, so exactly.
    best = F.aggregate(
        F.col(at), F.lit(None).cast("struct<start:long,length:long,period:long>"),
        lambda b, r: F.when(b.isNull() | (r["length"] * b["period"] > b["length"] * r["period"]), r).otherwise(b),
    )
    lines = F.transform(F.col(at), lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size(at) > 0, F.lit("\n")).otherwise(""))
    return out.withColumn("best", best).select(
        "doc_id",
        F.size(at).cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col(collapsed).cast("binary"), 256).alias("collapsed_sha256"),
    )
