"""Exact top-k inner products by a three-phase uniform threshold.

The components are split into LISTS ranges.  In a range every candidate has a partial score for a query: the entries of the
query's score list there; a score is the sum of a candidate's entries in all lists.  Each list is kept by tasks of its own,
which get the components of one range only, of a block of queries and a block of rows.

  1. gather: the tasks of a list send the best entries of each query, DEPTH * k of all tasks together and a few more of each.
     The entries that the best of each list lack in the other lists are fetched, and the k-th best of their scores is a safe
     cutoff, as any k candidates' scores would give: the true k-th is no lower.
  2. collect: the cutoff goes to all lists with the queries.  A score that reaches it has an entry of at least
     cutoff / LISTS in some list, signed or not; each list sends its entries down to there, and passes over rows whose
     length rules that out.
  3. resolve: entries of one pair are added, what a pair lacks is fetched from the list that has it, for these pairs alone,
     and the scores that reach the cutoff are ranked.

Numbers too large for exact sums in doubles (a component of millions or more) go through the same lists and phases with
bounds in place of entries: lower ones for the cutoff, upper ones to collect and to resolve.  Pairs whose bounds add up to the
cutoff are scored in whole numbers of any size.

Edge cases: rows without id, with a null vector, or with null or non-finite components take no part; whole numbers
beyond the largest double count as it; scores beyond a 64-bit integer are given as its nearest end; vectors of different lengths are
compared as if filled with zeros.  An id is ranked once: repeated rows count once, and an id with several different vectors
has the best score of any of them, as a query and as a candidate.  Candidates with the id of the query are its own rows;
with fewer than k candidates the cutoff is minus infinity and all are returned; ties go to the smaller id; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, map_batches, materialise, parts, table
from .vectors import lists, matrix, valid

LISTS = 2
DEPTH = 4  # times k entries are gathered of a list: more make the cutoff closer to the k-th score
FEW = 2  # entries more of each block of rows
ROWS, QUERIES, STRIP = 16_384, 4_096, 512  # rows and queries of a block; rows multiplied at once
LARGEST = 2.0**500  # components of rows with larger ones are bounded by infinity


def quantised(rows: DataFrame, scale: float = 64.0) -> DataFrame:
    """(vec_id, v, most): the whole numbers floor(scale * x) as packed doubles, and the largest magnitude of them."""

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        with np.errstate(over="ignore"):
            found = [np.nan_to_num(np.floor(x * scale)) + 0.0 for x in lists(b.column("v"))]
        most = [float(np.abs(x).max(initial=0)) for x in found]
        packed = [x.tobytes().rstrip(b"\0") for x in found]
        packed = [p.ljust(-(-len(p) // 8) * 8, b"\0") for p in packed]
        return pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed, pa.binary()), pa.array(most, pa.float64())], ["vec_id", "v", "most"])

    return map_arrow(valid(rows, zeros=True), pack, "vec_id long, v binary, most double")


# ---------------------------------------------------------------- tasks


class _Block:
    """The queries and rows of one task, in one range of components."""

    def __init__(self, t: pa.Table, kind: type):
        row = t.column("side").to_numpy() == 1
        v, ids, r = matrix(t.column("v").combine_chunks(), kind), t.column("vec_id").to_numpy(), t.column("r").to_numpy()
        length = np.sqrt((np.clip(v, -LARGEST, LARGEST).astype(np.float64) ** 2).sum(axis=1)) if kind is np.float64 else np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
        if kind is np.float64:
            length[(np.abs(v) > LARGEST).any(axis=1)] = np.inf
            v = np.clip(v, -LARGEST, LARGEST)
        self.q, self.query, self.qr, self.reach = v[~row], ids[~row], r[~row], length[~row]
        self.cutoff = t.column("cutoff").to_numpy(zero_copy_only=False)[~row]
        order = np.argsort(-length[row], kind="stable")  # long rows first
        self.x, self.row, self.r, self.length = v[row][order], ids[row][order], r[row][order], length[row][order]

    def strips(self) -> Iterator[tuple[slice, np.ndarray]]:
        """Rows and their partial scores, minus infinity for the query's own rows, a strip at a time."""
        for lo in range(0, len(self.row), STRIP):
            at = slice(lo, lo + STRIP)
            scores = (self.q @ self.x[at].T).astype(np.float64)
            scores[self.query[:, None] == self.row[None, at]] = -np.inf
            yield at, scores

    def slack(self, i: np.ndarray | slice, j: np.ndarray | slice, pairs: bool = False) -> np.ndarray:
        """A bound on the rounding of the partial scores of queries i and rows j: of all pairs, or of i and j side by side."""
        with np.errstate(invalid="ignore"):
            product = self.reach[i] * self.length[j] if pairs else np.outer(self.reach[i], self.length[j])
        return np.where(np.isnan(product), np.inf, product * (max(self.x.shape[1], 1) * 2.0**-50))

    def places(self, ids: np.ndarray, of: str) -> np.ndarray:
        r = getattr(self, of)
        order = np.argsort(r)
        return order[np.searchsorted(r, ids, sorter=order)]


Task = Callable[[_Block, pa.RecordBatch | None], Iterator[pa.RecordBatch]]


def _batch(schema: str, *columns: np.ndarray) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    names = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c).cast(kinds[k]) for c, (_, k) in zip(columns, names)], [n for n, _ in names])


HEADS = "q long, r long, vec_id long, list int, p double"


def _heads(k: int, list_: int, exact: bool) -> Task:
    """The k best entries of each query, or lower bounds of them, an id once."""

    def run(block: _Block, _) -> Iterator[pa.RecordBatch]:
        best = np.full((len(block.query), k), -np.inf)
        at_row = np.full(best.shape, -1)
        for at, scores in block.strips():
            if not exact:
                scores = scores - block.slack(slice(None), at)
            near = np.argpartition(scores, -k, axis=1)[:, -k:] if scores.shape[1] > k else np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
            both = np.concatenate([best, np.take_along_axis(scores, near, axis=1)], axis=1)
            rows = np.concatenate([at_row, near + at.start], axis=1)
            ids = np.where(rows >= 0, block.row[rows], np.iinfo(np.int64).min)
            order = np.lexsort((-both, ids), axis=-1)
            both, rows, ids = (np.take_along_axis(c, order, axis=1) for c in (both, rows, ids))
            both[:, 1:][ids[:, 1:] == ids[:, :-1]] = -np.inf  # an id's other vectors
            top = np.argsort(-both, axis=1, kind="stable")[:, :k]
            best, at_row = np.take_along_axis(both, top, axis=1), np.take_along_axis(rows, top, axis=1)
        i, j = np.nonzero(np.isfinite(best))
        own = at_row[i, j]
        yield _batch(HEADS, block.qr[i], block.r[own], block.row[own], np.full(len(i), list_), best[i, j])

    return run


ENTRIES = "q long, r long, known double, have int"


def _collect(list_: int, share: int, exact: bool) -> Task:
    """Entries, or upper bounds of them, of at least cutoff / share."""

    def run(block: _Block, _) -> Iterator[pa.RecordBatch]:
        need = block.cutoff / share
        for lo in range(0, len(block.row), STRIP):
            with np.errstate(invalid="ignore"):
                able = ~(block.reach * block.length[lo] * (1 + 1e-9) < need)
            if not able.any():
                return  # nor has any later row, as they are shorter
            at = slice(lo, lo + STRIP)
            scores = (block.q[able] @ block.x[at].T).astype(np.float64)
            if not exact:
                scores = scores + block.slack(able, at)
            hit = (scores >= need[able][:, None]) & (block.query[able][:, None] != block.row[None, at])
            i, j = np.nonzero(hit)
            yield _batch(ENTRIES, block.qr[np.flatnonzero(able)[i]], block.r[at][j], scores[i, j], np.full(len(i), 1 << list_))

    return run


_ENDS = (-(1 << 63), (1 << 63) - 1)


def whole(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product in whole numbers of any size, then brought into 64 bits."""
    s = sum(int(x) * int(y) for x, y in zip(a.tolist(), b.tolist()))
    return min(max(s, _ENDS[0]), _ENDS[1])


def scored(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """(q, r, score) of pairs of rows (r, v), which meet by their numbers."""

    def score(b: pa.RecordBatch) -> pa.RecordBatch:
        q, r = b.column("qv").to_pylist(), b.column("v").to_pylist()
        found = [whole(np.frombuffer(x), np.frombuffer(y)) for x, y in zip(q, r)]
        return pa.RecordBatch.from_arrays([b.column("q"), b.column("r"), pa.array(found, pa.int64())], ["q", "r", "score"])

    own = rows.select("r", "v")
    both = pairs.select("q", "r").join(own, "r").join(own.select(F.col("r").alias("q"), F.col("v").alias("qv")), "q")
    return map_arrow(both.select("q", "r", "qv", "v"), score, "q long, r long, score long")


def _fetch(list_: int, full: int, side: int) -> Task:
    """The entries that pairs lack in this list, added to what is known; sums of all lists go if they don't reach the cutoff.

    side: 0 for entries, -1 and 1 for lower and upper bounds of them.
    """

    def run(block: _Block, asked: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
        if asked is None:
            return
        q, r = asked.column("q").to_numpy(), asked.column("r").to_numpy()
        i, j = block.places(q, "qr"), block.places(r, "r")
        for lo in range(0, len(q), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            p = np.einsum("ij,ij->i", block.q[i[at]].astype(np.float64), block.x[j[at]].astype(np.float64))
            if side:
                p = p + side * block.slack(i[at], j[at], pairs=True)
            known, have = asked.column("known").to_numpy()[at] + p, asked.column("have").to_numpy()[at] | (1 << list_)
            stays = (have != full) | (known >= block.cutoff[i[at]])
            yield _batch(ENTRIES, q[at][stays], r[at][stays], known[stays], have[stays])

    return run


# ---------------------------------------------------------------- plans


class _Lists:
    """All rows and queries as score lists by range, in blocks."""

    def __init__(self, rows: DataFrame, k: int):
        self.rows, self.spark, self.k = rows, rows.sparkSession, k
        self.n, self.asked, most, width = rows.agg(F.count("*"), F.coalesce(F.sum(F.col("asked").cast("long")), F.lit(0)), F.coalesce(F.max("most"), F.lit(0.0)), F.coalesce(F.max(F.length("v")), F.lit(0))).first()
        width, largest = width // 8, min(most, 1e150) ** 2 * max(width // 8, 1)
        self.exact = largest < 2.0**53
        self.count = LISTS if width >= LISTS else 1
        self.kind = np.float32 if largest < 2.0**24 else np.float64
        self.cuts = [round(width * c / self.count) for c in range(self.count + 1)]
        self.rb, self.qb = max(1, -(-self.n // ROWS)), max(1, -(-self.asked // QUERIES))

    def _range(self, list_: int) -> DataFrame:
        kind, (a, b) = self.kind, self.cuts[list_ : list_ + 2]

        def one(t: pa.RecordBatch) -> pa.RecordBatch:
            x = matrix(t.column("v"))[:, a:b].astype(kind)
            return pa.RecordBatch.from_arrays([t.column("r"), t.column("vec_id"), t.column("asked"), pa.array([v.tobytes() for v in x], pa.binary())], ["r", "vec_id", "asked", "v"])

        return map_arrow(self.rows.select("r", "vec_id", "asked", "v"), one, "r long, vec_id long, asked boolean, v binary")

    def _query_block(self, name: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64({name}, 'q'), {self.qb}) as int)")

    def _row_block(self, name: str) -> Column:
        return F.expr(f"cast(pmod(xxhash64({name}, 'r'), {self.rb}) as int)")

    def run(self, task: Callable[[int], Task], schema: str, cutoff: DataFrame | None = None, requests: DataFrame | None = None) -> DataFrame:
        """A task of every list, over each block of its queries and each block of its rows.

        cutoff: (query_id, cutoff).  requests: (list, q, r, known, have), which go to the block that has q and r.
        """
        sides = []
        for list_ in range(self.count):
            own = self._range(list_)
            queries = own.where("asked")
            if cutoff is None:
                queries = queries.withColumn("cutoff", F.lit(float("-inf")))
            else:
                queries = queries.join(cutoff.withColumnRenamed("query_id", "vec_id"), "vec_id", "left").withColumn("cutoff", F.coalesce("cutoff", F.lit(float("-inf"))))
            nothing = [F.lit(0).cast("long").alias("q"), F.lit(0.0).alias("known"), F.lit(0).alias("have")]
            key = F.lit(list_).alias("list")
            sides.append(queries.select(key, self._query_block("r").alias("qb"), F.explode(F.expr(f"sequence(0, {self.rb - 1})")).alias("rb"), F.lit(0).alias("side"), "r", "vec_id", "v", "cutoff", *nothing))
            sides.append(own.select(key, F.explode(F.expr(f"sequence(0, {self.qb - 1})")).alias("qb"), self._row_block("r").alias("rb"), F.lit(1).alias("side"), "r", "vec_id", "v", F.lit(0.0).alias("cutoff"), *nothing))
        if requests is not None:
            sides.append(
                requests.select("list", self._query_block("q").alias("qb"), self._row_block("r").alias("rb"), F.lit(2).alias("side"), "r", F.lit(0).cast("long").alias("vec_id"), F.lit(b"").alias("v"), F.lit(0.0).alias("cutoff"), "q", "known", "have")
            )
        all_ = sides[0]
        for side in sides[1:]:
            all_ = all_.union(side)
        keys, kind, cells = ["list", "qb", "rb"], self.kind, self.count * self.rb * self.qb
        tasks = [task(list_) for list_ in range(self.count)]

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            block = last = None
            for b in batches:
                if not b.num_rows:
                    continue
                columns = [b.column(c).to_numpy() for c in (*keys, "side")]
                change = np.zeros(b.num_rows, bool)
                for c in columns:
                    change[1:] |= c[1:] != c[:-1]
                cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
                for lo, hi in zip(cuts[:-1], cuts[1:]):
                    *now, side = (c[lo] for c in columns)
                    if now != last:
                        if held and block is None:
                            yield from tasks[last[0]](_Block(pa.Table.from_batches(held).combine_chunks(), kind), None)
                        held, block, last = [], None, now
                    if side < 2:
                        held.append(b.slice(lo, hi - lo))
                    else:  # requests stream by, whatever their number
                        block = block or _Block(pa.Table.from_batches(held).combine_chunks(), kind)
                        yield from tasks[now[0]](block, b.slice(lo, hi - lo))
            if held and block is None:
                yield from tasks[last[0]](_Block(pa.Table.from_batches(held).combine_chunks(), kind), None)

        n = max(parts(self.spark), min(4 * parts(self.spark), cells))
        return map_batches(all_.repartition(n, *keys).sortWithinPartitions(*keys, "side"), stream, schema)

    def complete(self, entries: DataFrame, cutoff: DataFrame | None = None) -> DataFrame:
        """(q, r, score) of (q, r, known, have), with what is lacking fetched, a list at a time; fetched ones reach the cutoff.

        Scores are bounds where doubles aren't exact: lower ones without a cutoff, upper ones with one.
        """
        side = 0 if self.exact else -1 if cutoff is None else 1
        full = (1 << self.count) - 1
        for _ in range(self.count - 1):
            entries = materialise(entries, "entries")
            lacking = F.expr(" ".join(["case", *(f"when have & {1 << c} = 0 then {c}" for c in range(self.count)), "end"]))
            requests = entries.where(f"have <> {full}").withColumn("list", lacking)
            entries = entries.where(f"have = {full}").union(self.run(lambda list_: _fetch(list_, full, side), ENTRIES, cutoff, requests))
        return entries.select("q", "r", (F.col("known").cast("long") if self.exact else F.col("known")).alias("score"))

    def named(self, scores: DataFrame) -> DataFrame:
        """(query_id, vec_id, score): the best of each pair of ids."""
        ids = self.rows.select("r", "vec_id")
        out = scores.join(ids, "r").join(ids.select(F.col("r").alias("q"), F.col("vec_id").alias("query_id")), "q")
        return out.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def heads(self) -> DataFrame:
        """(q, list, vec_id, r, p): the best entries of each query in each list."""
        depth = self.k * (DEPTH if self.count > 1 else 1)
        sent = min(depth, -(-depth // self.rb) + FEW)
        heads = self.run(lambda list_: _heads(sent, list_, self.exact), HEADS)
        heads = heads.groupBy("q", "list", "vec_id").agg(F.max("p").alias("p"), F.max_by("r", "p").alias("r"))
        order = Window.partitionBy("q", "list").orderBy(F.desc("p"), "vec_id")
        return heads.withColumn("n", F.row_number().over(order)).where(F.col("n") <= depth)

    def cutoff(self) -> DataFrame:
        heads = self.heads().groupBy("q", "r").agg(F.sum("p").alias("known"), F.sum(F.expr("shiftleft(1, list)")).cast("int").alias("have"))
        scores = self.complete(heads)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        ranked = self.named(scores).withColumn("n", F.row_number().over(order)).where(F.col("n") <= self.k)
        # Scores beyond 64 bits are equal at their end, so all of them reach a cutoff there.
        score = F.when(F.col("score") > -(2.0**63), F.least(F.col("score").cast("double"), F.lit(2.0**63 - 1024))).otherwise(float("-inf"))
        return ranked.where(F.col("n") == self.k).select("query_id", score.alias("cutoff"))


def top_k(rows: DataFrame, is_query: Column, k: int, scale: float = 64.0, counts: dict[str, int] | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k best candidates of each query.

    counts: gets the number of pairs, and of those with an entry collected and with one fetched.
    """
    # Repeated rows meet before the shuffle; each vector of an id is then a row with a number of its own.
    distinct = quantised(rows, scale).groupBy("vec_id", "v").agg(F.max("most").alias("most"))
    own = materialise(distinct.withColumn("asked", F.coalesce(is_query, F.lit(False))).withColumn("r", F.monotonically_increasing_id()), "rows")
    search = _Lists(own, k)
    cutoff = materialise(search.cutoff(), "cutoff")
    found = search.run(lambda list_: _collect(list_, search.count, search.exact), ENTRIES, cutoff=cutoff)
    found = found.groupBy("q", "r").agg(F.sum("known").alias("known"), F.sum("have").cast("int").alias("have"))
    if counts is not None:
        found = materialise(found, "collected")
        lacking = F.sum((F.col("have") != (1 << search.count) - 1).cast("long"))
        collected, fetched = found.agg(F.count("*"), F.coalesce(lacking, F.lit(0))).first()
        counts.update(pairs=search.n * search.asked, collected=collected, fetched=fetched)
    found = search.complete(found, cutoff)
    # Sums below the cutoff are no results: they go before ids are joined.
    asked = own.where("asked").select(F.col("r").alias("q"), F.col("vec_id").alias("query_id"))
    bound = asked.join(cutoff, "query_id").select("q", "cutoff")
    found = found.join(bound, "q", "left").where("cutoff is null or score >= cutoff").drop("cutoff")
    if not search.exact:
        found = scored(found, own)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return search.named(found).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_three_phase_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


ORACLE = """
with valid as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id,
    max(cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint)) as score
  from valid q, valid c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id group by all),
ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 20
"""
