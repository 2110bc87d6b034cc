import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sylva.llm import ann, topk

SCHEMA = "vec_id long, embedding array<float>, label int"


def test_topk_against_sql(spark, sf):
    got = sorted(tuple(r) for r in topk.op10_three_phase_topk(spark, sf).select("query_id", "rank", "vec_id", "score").collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    assert got == sorted(con.execute(f"select query_id, rank, vec_id, score from ({topk.ORACLE})").fetchall())


def brute_topk(rows, k, every):
    """rows: (id, vector), an id with several vectors several times; in whole numbers of any size."""
    whole = [(i, [int(np.floor(np.float64(x) * 64)) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in rows if i % every == 0}):
        best = {}
        for i, b in whole:
            for a in (a for j, a in whole if j == q and i != q):
                best[i] = max(best.get(i, -(1 << 999)), sum(x * y for x, y in zip(a, b)))
        found = sorted((-min(max(s, -(1 << 63)), (1 << 63) - 1), i) for i, s in best.items())[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def got_topk(df, k, every, **how):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % every == 0, k, **how).select("query_id", "rank", "vec_id", "score").collect())


def test_topk_with_ties_signs_and_small_blocks(spark, monkeypatch):
    for name, value in (("ROWS", 40), ("QUERIES", 10), ("STRIP", 16)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(2)
    for shift in (0.0, -3.0, 3.0):
        rows = [(k, [float(x) for x in np.round(rng.normal(size=6) + shift, 1).astype(np.float32)]) for k in range(300)]
        rows += [(300 + k, rows[0][1]) for k in range(100)]
        assert got_topk(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA), 20, 7) == brute_topk(rows, 20, 7)


def test_topk_ids_with_several_vectors_and_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(topk, "STRIP", 8)
    rng = np.random.default_rng(3)
    rows = [(int(rng.integers(0, 40)) if k % 3 else 0, [float(x) for x in np.round(rng.normal(size=5), 1).astype(np.float32)]) for k in range(150)]
    df = spark.createDataFrame([(k, v, 0) for k, v in [*rows, *rows[:50], *[rows[0]] * 70]], SCHEMA)
    assert got_topk(df, 7, 4) == brute_topk(rows, 7, 4)


def test_topk_of_huge_components(spark):
    rng = np.random.default_rng(6)
    rows = [(k, [float(x) for x in rng.normal(size=4).astype(np.float32) * (1, 1e3, 1e9, 1e18, 3e37)[k % 5]]) for k in range(60)]
    assert got_topk(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA), 6, 4) == brute_topk(rows, 6, 4)
    rows = [(k, [float(x) for x in rng.normal(size=4).astype(np.float32) * 1e4]) for k in range(60)]
    assert got_topk(spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA), 6, 4) == brute_topk(rows, 6, 4)
    wide = (1, 1e9, 1e155, 1e200, 1e305)
    rows = [(k, [float(x) * wide[k % 5] if rng.random() < 0.8 else 0.0 for x in rng.normal(size=5)]) for k in range(60)]
    rows += [(60, [1e305, -1e305, 1.0, 0.0, 0.0]), (61, [1.0, 1.0, 2.0, 0.0, 0.0]), (64, [1.0, 1.0, 3.0, 0.0, 0.0])]
    assert got_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 6, 4) == brute_topk(rows, 6, 4)
    beyond = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.5e308, 1.0]), (2, [-1e307, 5.0])], "vec_id long, embedding array<double>")
    assert [r[1:] for r in got_topk(beyond, 2, 100)] == [(1, 1, (1 << 63) - 1), (2, 2, -(1 << 63))]


def test_one_outlier_leaves_the_lists_as_they_are(spark, monkeypatch):
    for name, value in (("ROWS", 700), ("QUERIES", 40), ("STRIP", 64)):
        monkeypatch.setattr(topk, name, value)
    rng = np.random.default_rng(16)
    centres = rng.normal(size=(20, 8)) * 3
    rows = [(k, [float(x) for x in (centres[k % 20] + rng.normal(size=8) * 0.3).astype(np.float32)]) for k in range(2000)]
    rows[77] = (77, [*rows[77][1][:7], 3e30])
    counts = {}
    df = spark.createDataFrame([(k, v, 0) for k, v in rows], SCHEMA)
    assert got_topk(df, 5, 50, counts=counts) == brute_topk(rows, 5, 50)
    assert counts["pairs"] == 80_000 and counts["collected"] < 0.3 * counts["pairs"]


def test_gathered_entries_follow_the_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROWS", 100)
    rng = np.random.default_rng(17)
    sent = []
    real = topk._heads
    monkeypatch.setattr(topk, "_heads", lambda k, *rest: sent.append(k) or real(k, *rest))
    for n in (400, 2000):
        rows = [(k, [float(x) for x in rng.normal(size=6)], 0) for k in range(n)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert got_topk(df, 5, 50) == brute_topk([(k, [float(np.float32(x)) for x in v]) for k, v, _ in rows], 5, 50)
        blocks = n // 100
        assert set(sent) == {-(-20 // blocks) + topk.FEW}  # of each block, list and query: 20 in all and FEW more a block
        sent.clear()


def test_topk_fetches_for_few_pairs(spark):
    counts = {}
    rows = topk.top_k(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), F.col("vec_id") % 20 == 0, 20, counts=counts).count()
    assert rows == 2000 and counts["pairs"] == 200_000
    assert 2000 <= counts["collected"] < 0.2 * counts["pairs"] and counts["fetched"] <= counts["collected"]


ODD = [
    (0, [1.0, 2.0], 0),
    (100, [1.0, 2.0], 0),
    (200, None, 0),
    (300, [1.0, None], 0),
    (400, [1.0, float("nan")], 0),
    (500, [float("inf"), 1.0], 0),
    (600, [0.0, -0.0], 0),
    (None, [1.0, 1.0], 0),
    (700, [3.0], 0),
    (700, [3.0], 0),
    (1, [0.5, 0.5], 0),
]


def test_odd_vectors(spark):
    df = spark.createDataFrame(ODD, SCHEMA).withColumn("v", F.lit(1)).withColumn("node", F.lit(2))
    near = ann.nearest(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect()
    assert sorted({r.query_id for r in near}) == [0, 100, 700]
    assert [(r.vec_id, round(r.score, 6)) for r in near if r.query_id == 0] == [(100, 0.0), (1, 1.581139), (700, 2.828427)]
    best = topk.top_k(df, F.col("vec_id") % 100 == 0, 20)
    assert sorted({r.query_id for r in best.collect()}) == [0, 100, 600, 700]
    assert [r.vec_id for r in best.where("query_id = 0").orderBy("rank").collect()] == [100, 700, 1, 600]
    assert ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0, 10).count() == 0
    assert topk.top_k(df.limit(0), F.col("vec_id") % 100 == 0, 20).count() == 0


def test_neighbours_recall_and_distances(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(10, 24)) * 2
    x = (centres[rng.integers(0, 10, 3000)] + rng.normal(size=(3000, 24))).astype(np.float32)
    x[2000:2400] = x[0]  # one common vector
    df = spark.createDataFrame([(k, [float(c) for c in v], 0) for k, v in enumerate(x)], SCHEMA)
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 100 == 0, 10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    x, hit = x.astype(np.float64), 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        near = np.lexsort((np.arange(3000), d))[:10]
        hit += len(set(near) & {v for v, _ in got[q]})
        assert np.allclose([d[v] for v, _ in got[q]], [s for _, s in got[q]], rtol=1e-12)
    assert hit / 300 >= 0.95
    assert [v for v, _ in got[0]] == list(range(2000, 2010))


def test_neighbours_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(14)
    rows = [(int(rng.integers(0, 60)) if k % 3 else 0, rng.normal(size=4).astype(np.float32)) for k in range(200)]
    df = spark.createDataFrame([(k, [float(c) for c in v], 0) for k, v in rows], SCHEMA)
    got = [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, 5).orderBy("query_id", "rank").collect()]
    want = []
    for q in sorted({k for k, _ in rows if k % 20 == 0}):
        d = {}
        for k, v in rows:
            for j, w in rows:
                if j == q and k != q:
                    d[k] = min(d.get(k, np.inf), float(np.sqrt(((v.astype(float) - w.astype(float)) ** 2).sum())))
        want += [(q, r + 1, k) for r, (_, k) in enumerate(sorted((x, k) for k, x in d.items())[:5])]
    assert got == want


def recall(spark, x, k=10, every=100):
    """The share of the k nearest of each query, by comparison with all, that are found."""
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0, k).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit, queries = 0, range(0, len(x), every)
    for q in queries:
        with np.errstate(over="ignore"):
            d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:k].tolist()) & got[q])
    return hit / (k * len(queries))


def test_recall_beside_one_huge_vector(spark):
    x = np.random.default_rng(4).normal(size=(1500, 12))
    for size in (1e9, 1e300):
        x[77] = size
        assert recall(spark, x) >= 0.95


def test_walk_reaches_the_own_cluster_of_each_query(spark):
    rng, clusters, size = np.random.default_rng(5), 3000, 40
    x = rng.normal(size=(clusters, 1, 6)) * 1000 + rng.normal(size=(clusters, size, 6))
    d = ((x[:, :, None] - x[:, None]) ** 2).sum(axis=3)
    near = np.argsort(d, axis=2)[:, :, 1 : ann.DEGREE + 1] + np.arange(clusters)[:, None, None] * size  # no edge leaves a cluster
    u = np.repeat(np.arange(clusters * size), ann.DEGREE)
    apart = np.take_along_axis(d, near - np.arange(clusters)[:, None, None] * size, axis=2)
    edges = spark.createDataFrame(pa.table({"u": u, "w": near.ravel(), "d": apart.ravel()}))
    vectors = spark.createDataFrame(pa.table({"node": np.arange(clusters * size), "v": pa.array(ann._short(x.reshape(-1, 6)), pa.binary())}))
    queries = vectors.where("node % 1111 = 0").select(F.col("node").alias("q"), F.col("v").alias("qv"))
    got = {}
    for r in ann.walk(queries, vectors, edges).orderBy("q", "d", "node").collect():
        got.setdefault(r.q, []).append(r.node)
    asked = range(0, clusters * size, 1111)
    hit = sum(len(set(got[q][1:11]) & set(near[q // size, q % size, :10].tolist())) for q in asked)
    assert hit / (10 * len(asked)) >= 0.99
