"""Approximate nearest neighbours on a graph built by NN-descent.

Equal vectors are one node.  A first graph links vectors that share one of their nearest centres.  Then, again
and again, every node introduces its neighbours to each other, forward and reverse ones, a new one and any other: the
table of introductions is the join of the edges with the vectors, dealt by the node that introduces, and a pair that is
closer than one of the two's farthest neighbour becomes a new edge.  It ends when few edges are new.  Every row is in the
graph.

Queries walk the graph greedily: from their own node, so that a group of nodes without edges to the outside is reached,
and entry nodes (the nearest of a bounded sample) to the neighbours of the best nodes not yet visited, all queries one step
at a time in one join, until the best BEAM nodes of every query have been visited.

The graph and the walk use vectors in single precision, each with an exponent of its own, so that none loses digits to
another's size; distances are computed in double precision.  The BEAM nodes that a walk ends with are measured again on the
original vectors.

Edge cases: rows without id, with null or zero vectors, or with null or non-finite components take no part; vectors of
different lengths are compared as if filled with zeros; repeated rows (equal id and vector) count once, and an id with
several different vectors is ranked once, at the least distance of any of them, as a query and as a candidate; candidates
with the id of the query are its own rows; with fewer than k candidates all are returned; ties go to the smaller id; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, map_arrow, materialise, parts, table
from .vectors import by_group, lists, matrix, valid

DEGREE = 32  # neighbours of a node
INTRODUCED = 24  # new, and old, neighbours that a node introduces to each other in one round
ROUNDS, ENOUGH = 8, 0.01  # at most so many rounds; stop when so small a share of the edges is new
CENTRES, NEAR, CELL = 1_024, 8, 512  # at most so many centres, cells of a node, nodes of a cell
BEAM, ENTRIES, SAMPLE = 96, 16, 1_024
REVERSE = 64  # nearest of the nodes that have a node as neighbour, to which the walk goes back: a hub may have any number
LARGEST = 505  # exponent of components up to which squared distances are finite; larger tables are scaled down to it


# ---------------------------------------------------------------- nodes


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, v) of distinct vectors, v packed doubles; and (vec_id, node) of all rows that take part."""

    def pack(b: pa.RecordBatch) -> pa.RecordBatch:
        packed = [(x + 0.0).tobytes().rstrip(b"\0") for x in lists(b.column("v"))]  # + 0.0: one zero
        packed = [p.ljust(-(-len(p) // 8) * 8, b"\0") for p in packed]
        return pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(packed, pa.binary())], ["vec_id", "v"])

    packed = map_arrow(valid(rows, zeros=False), pack, "vec_id long, v binary")
    packed = materialise(packed.withColumn("hash", F.md5("v")), "packed")
    # A node is named by the smallest id of its copies: unique, as an id with several vectors names one of them only.
    first = packed.groupBy("hash").agg(F.min("vec_id").alias("id"), F.first("v").alias("v"))
    first = first.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("hash")))
    first = first.withColumn("node", F.when(F.col("n") == 1, F.col("id")).otherwise(-F.abs(F.xxhash64("hash")) - 1))
    first = materialise(first.select("node", "hash", "v"), "nodes")
    return first.select("node", "v"), packed.join(first.select("node", "hash"), "hash").select("vec_id", "node")


# ---------------------------------------------------------------- the graph


def _peak(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(np.abs(matrix(b.column("v"))).max(initial=0))])], ["peak"])


def _wide(column: pa.Array, width: int, shift: int) -> np.ndarray:
    """Vectors of equal width, divided by 2 ** shift."""
    x = matrix(column)
    return np.pad(np.ldexp(x, -shift) if shift else x, ((0, 0), (0, width - x.shape[1])))


def _short(x: np.ndarray) -> list[bytes]:
    """Each vector packed in single precision: its exponent, then its components over 2 ** exponent."""
    e = np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None]
    return [r.tobytes() for r in np.hstack([e, np.ldexp(x, -e)]).astype(np.float32)]


def _long(column: pa.Array) -> np.ndarray:
    """The vectors that _short packed."""
    x = matrix(column, np.float32)
    return np.ldexp(x[:, 1:].astype(np.float64), x[:, :1].astype(np.int32))


def cells(nodes: DataFrame, n: int, width: int, shift: int) -> DataFrame:
    """(cell, sub, part, node, v): every node in the cells of its nearest centres.

    Centres are a sample of nodes, of bounded size.  Cells that would be large are cut by signs of random hyperplanes
    through the centre, and what is still large by hash.
    """
    count = max(1, min(CENTRES, n // 50))
    near, bits = min(NEAR, count), 0
    bits = max(0, int(np.ceil(np.log2(max(n, 1) * near / count / CELL))))
    planes = np.random.default_rng(7).standard_normal((bits, width))
    sample = nodes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(count).select("v").toArrow().column("v").combine_chunks()
    centres = _wide(sample, width, shift)

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        x = _wide(b.column("v"), width, shift)
        d = _squared(x, centres)
        cell = np.argpartition(d, near - 1, axis=1)[:, :near] if len(centres) else np.zeros((len(x), 0), int)
        signs = (x @ planes.T)[:, None, :] > (centres @ planes.T)[cell] if bits else np.zeros((*cell.shape, 0), bool)
        sub = signs @ (1 << np.arange(bits)) if bits else np.zeros(cell.shape, int)
        short = _short(x)
        columns = (np.repeat(b.column("node").to_numpy(), near), cell.ravel(), sub.ravel())
        return pa.RecordBatch.from_arrays(
            [*(pa.array(c, pa.int64()) for c in columns), pa.array([v for v in short for _ in range(near)], pa.binary())], ["node", "cell", "sub", "v"]
        )

    rows = map_arrow(nodes, place, "node long, cell long, sub long, v binary")
    size = rows.groupBy("cell", "sub").agg(F.ceil(F.count("*") / (2 * CELL)).alias("cut"))
    return rows.join(size, ["cell", "sub"]).withColumn("part", F.expr("pmod(xxhash64(node, cell), cut)"))


def _nearest(ids: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, neighbour and distance of the k nearest of each row of a square matrix."""
    np.fill_diagonal(d, np.inf)
    k = min(k, len(ids) - 1)
    near = np.argpartition(d, k - 1, axis=1)[:, :k]
    return np.repeat(ids, k), ids[near].ravel(), np.take_along_axis(d, near, axis=1).ravel()


def _squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    d = x @ y.T
    d *= -2
    d += (x * x).sum(axis=1)[:, None]
    d += (y * y).sum(axis=1)[None]
    return np.maximum(d, 0, out=d)


EDGES = "u long, w long, d double"


def _edges(u, w, d) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(w, pa.int64()), pa.array(d, pa.float64())], ["u", "w", "d"])


def _first(t: pa.Table) -> pa.RecordBatch | None:
    ids, x = t.column("node").to_numpy(), _long(t.column("v").combine_chunks())
    return _edges(*_nearest(ids, _squared(x, x), DEGREE)) if len(ids) > 1 else None


def _introduce(t: pa.Table) -> pa.RecordBatch | None:
    """Pairs of one node's neighbours, one of them new, that are closer than the farthest neighbour of either."""
    ids, new = t.column("m").to_numpy(), t.column("new").to_numpy(zero_copy_only=False)
    far, x = t.column("far").to_numpy(), _long(t.column("v").combine_chunks())
    d = _squared(x, x)
    ok = (d < far[:, None]) & (new[:, None] | new[None, :]) & (ids[:, None] != ids[None, :])
    i, j = np.nonzero(ok)
    return _edges(ids[i], ids[j], d[i, j]) if len(i) else None


def best_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k shortest edges of each node; an edge that is there already stays old."""
    one = edges.groupBy("u", "w").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "w"))
    return one.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def graph(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, w, d, new): the DEGREE nearest neighbours w of each node u that NN-descent finds, d squared; and (node, v), the
    vectors as _short packs them."""
    spark = nodes.sparkSession
    n, width = nodes.agg(F.count("*"), F.coalesce(F.max(F.length("v")), F.lit(8)) / 8).first()
    width = int(width)
    peak = map_arrow(nodes, _peak, "peak double").agg(F.max("peak")).first()[0] or 1.0
    shift = max(0, int(np.frexp(peak)[1]) - LARGEST)
    vectors = materialise(map_arrow(nodes, lambda b: _vectors(b, width, shift), "node long, v binary"), "vectors")
    first = by_group(cells(nodes, n, width, shift), ["cell", "sub", "part"], ["node"], parts(spark), _first, EDGES)
    edges = materialise(best_edges(first.withColumn("new", F.lit(True)), DEGREE), "edges")
    for turn in range(ROUNDS):
        far = edges.groupBy("u").agg(F.when(F.count("*") < DEGREE, F.lit(float("inf"))).otherwise(F.max("d")).alias("far"))
        both = edges.select(F.col("u").alias("x"), F.col("w").alias("m"), "new").union(edges.select(F.col("w").alias("x"), F.col("u").alias("m"), "new"))
        both = both.groupBy("x", "m").agg(F.max("new").alias("new"))
        pick = Window.partitionBy("x", "new").orderBy(F.xxhash64("x", "m", F.lit(turn)))
        some = both.withColumn("r", F.row_number().over(pick)).where(F.col("r") <= INTRODUCED).drop("r")
        meets = some.groupBy("x").agg(F.max("new").alias("any")).where("any").select("x")
        some = materialise(some.join(meets, "x"), "introductions")
        members = vectors.join(far, vectors["node"] == far["u"]).select(F.col("node").alias("m"), "far", "v")
        groups = some.join(members, "m").select("x", "m", "new", "far", "v")
        found = by_group(groups, ["x"], ["m"], parts(spark), _introduce, EDGES).withColumn("new", F.lit(True))
        # What has been introduced is old from now on.
        done = some.where("new").select(F.col("x").alias("u"), F.col("m").alias("w"), F.lit(True).alias("done"))
        old = edges.join(done, ["u", "w"], "left").select("u", "w", "d", F.expr("new and done is null").alias("new"))
        after = materialise(best_edges(old.union(found), DEGREE), "edges")
        fresh, total = after.agg(F.sum(F.col("new").cast("long")), F.count("*")).first()
        discard(edges)
        discard(some)
        edges = after
        if not total or fresh < ENOUGH * total:
            break
    return edges, vectors


def _vectors(b: pa.RecordBatch, width: int, shift: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("node"), pa.array(_short(_wide(b.column("v"), width, shift)), pa.binary())], ["node", "v"])


# ---------------------------------------------------------------- the walk


def _measured(pairs: DataFrame, unpack: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """d of (q, node, qv, v): the Euclidean distance of packed vectors, in double precision."""

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        x, y = (unpack(b.column(c)) for c in ("qv", "v"))
        width = max(x.shape[1], y.shape[1])
        x, y = (np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (x, y))
        d = np.sqrt(((x - y) ** 2).sum(axis=1))
        return pa.RecordBatch.from_arrays([b.column("q"), b.column("node"), pa.array(d)], ["q", "node", "d"])

    return map_arrow(pairs.select("q", "node", "qv", "v"), measure, "q long, node long, d double")


def walk(queries: DataFrame, vectors: DataFrame, edges: DataFrame, beam: int = BEAM) -> DataFrame:
    """(q, node, d): the best `beam` nodes found for each query (q, qv), a node of the graph.  Both hold vectors as _short packs them."""
    order = Window.partitionBy("w").orderBy("d", "u")
    back = edges.withColumn("r", F.row_number().over(order)).where(F.col("r") <= REVERSE)
    links = materialise(edges.select("u", "w").union(back.select(F.col("w").alias("u"), F.col("u").alias("w"))).distinct(), "links")
    sample = vectors.orderBy(F.xxhash64("node"), "node").limit(SAMPLE).toArrow()  # a bounded number of entry nodes
    entry_ids, entry = sample.column("node").to_numpy(), _long(sample.column("v").combine_chunks())

    def enter(b: pa.RecordBatch) -> pa.RecordBatch:
        q = _long(b.column("qv"))
        width = max(q.shape[1], entry.shape[1])
        d = _squared(*(np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in (q, entry)))
        k = min(ENTRIES, d.shape[1])
        near = np.argpartition(d, k - 1, axis=1)[:, :k] if k else np.zeros((len(q), 0), int)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(b.column("q").to_numpy(), k)), pa.array(entry_ids[near].ravel())], ["q", "node"]
        )

    best = Window.partitionBy("q").orderBy("d", "node")

    def measured(pairs: DataFrame) -> DataFrame:
        return _measured(pairs.join(queries, "q").join(vectors, "node"), _long)

    entries = map_arrow(queries, enter, "q long, node long").union(queries.select("q", F.col("q").alias("node"))).distinct()
    state = measured(entries).withColumn("visited", F.lit(False))
    state = materialise(state, "walk")
    while True:
        open_ = state.where("not visited")
        step = open_.join(links, open_["node"] == links["u"]).select("q", F.col("w").alias("node")).distinct()
        step = step.join(state.select("q", "node"), ["q", "node"], "left_anti")
        after = state.withColumn("visited", F.lit(True)).unionByName(measured(step).withColumn("visited", F.lit(False)))
        after = materialise(after.withColumn("r", F.row_number().over(best)).where(F.col("r") <= beam).drop("r"), "walk")
        discard(state)
        state = after
        if not state.where("not visited").limit(1).count():
            return state.select("q", "node", "d")


def nearest(rows: DataFrame, is_query: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k nearest candidates found for each query."""
    nodes, members = nodes_of(rows)
    members = materialise(members.distinct(), "members")
    asked = members.where(is_query)
    wanted = asked.select("node").distinct()
    named = lambda vectors: materialise(wanted.join(vectors, "node").select(F.col("node").alias("q"), F.col("v").alias("qv")), "queries")
    edges, vectors = graph(nodes)
    found = walk(named(vectors), vectors, edges).select("q", "node")
    found = materialise(_measured(found.join(named(nodes), "q").join(nodes, "node"), matrix), "found")
    # The k + 1 smallest ids of a node's copies are enough, found in two steps as a node may hold a third of all rows.
    salted = Window.partitionBy("node", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    few = members.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("vec_id"))).where(F.col("r") <= k + 1).drop("r")
    # An id may be on several nodes: the nearest counts.  Some more than k are kept of a node's, as one is the query's own.
    ids = found.join(few, "node").groupBy("q", "vec_id").agg(F.min("d").alias("d"))
    ids = ids.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy("d", "vec_id"))).where(F.col("r") <= k + 1)
    per_id = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("q")).distinct()
    out = per_id.join(ids.drop("r"), "q").where("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.min("d").alias("d"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("d", "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("d").alias("score"))


def op9_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
