import duckdb
from pyspark.sql import functions as F

from sylva.llm import mixing as M


def test_against_sql(spark, sf):
    got = sorted(tuple(r) for r in M.op2_poisson_mixing(spark, sf).select("doc_id", "source", "copy", "text", "shuffle_key").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    want = sorted(con.execute(f"select doc_id, source, copy, text, shuffle_key from ({M.ORACLE})").fetchall())
    assert got == want and got


def test_shares_meet_the_targets(spark):
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 < 4, None).otherwise("common").alias("source"), F.lit(7).alias("copy"))
    out = M.mix(docs, {"rare": 1.0, "common": 1.0}).groupBy("source").count()
    n = {r["source"]: r["count"] for r in out.collect()}
    assert set(n) == {"rare", "common"}  # the source without a weight gets no copies
    assert abs(n["rare"] - 10000) < 500 and abs(n["common"] - 10000) < 500
    copies = M.mix(docs, {"rare": 1.0, "common": 1.0}).where("source = 'rare'").groupBy("doc_id").agg(F.count("*").alias("n"), F.max("copy_").alias("m"))
    assert copies.where("m <> n - 1").count() == 0
    per = {r["n"]: r["count"] for r in copies.groupBy("n").count().collect()}
    assert abs(per[5] / 2000 - 0.175) < 0.04  # Poisson with mean 5


def test_same_result_for_any_partitioning(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = (sorted((r.doc_id, r.copy) for r in M.mix(d).collect()) for d in (docs, docs.repartition(7)))
    assert a == b


def test_edges(spark):
    schema = "doc_id long, text string, source string, extra int"
    assert M.mix(spark.createDataFrame([], schema)).count() == 0
    docs = spark.createDataFrame([(None, None, None, 1), (1, "", "a", 2), (2, "abc", "a", 3), (2, "abc", "a", 3)], schema)
    out = M.mix(docs, temperature=1.0)
    assert {"doc_id", "text", "source", "extra", "copy", "shuffle_key"} == set(out.columns)
    rows = [r for r in out.collect() if r.doc_id == 2]
    assert len(rows) % 2 == 0  # equal rows are drawn alike


def test_rates_far_above_the_mean_of_even_sources(spark):
    source = F.when(F.col("id") % 100 == 0, "rare").otherwise("common")
    docs = spark.range(20000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), source.alias("source"))
    n = {r["source"]: r["count"] for r in M.mix(docs, {"rare": 1.0, "common": 1.0}).groupBy("source").count().collect()}
    assert abs(n["rare"] - 10000) < 500 and abs(n["common"] - 10000) < 500  # rates of 50 and 0.505
    # One document of a source: its counts, by seed, are Poisson where exp(-rate) is 0 and copies come in blocks.
    few = docs.where("doc_id > 0 and source = 'common' or doc_id = 0")
    for seed in ("a", "b"):
        copies = M.mix(few, {"rare": 1.0, "common": 1.0}, seed=seed).where("source = 'rare'").agg(F.count("*"), F.max("copy"), F.countDistinct("copy")).first()
        assert abs(copies[0] - 9900.5) < 600 and copies[1] == copies[0] - 1 and copies[2] == copies[0]


def test_counts_invert_the_distribution_at_any_rate(spark):
    import math

    units = [2.0**-53, 1e-9, 0.01, 0.3, 0.5, 0.9, 0.999999, 1 - 2.0**-53]
    rows = [(r, u) for r in (0.0, 0.3, 8.0, 50.0, 167.0, 169.0, 900.0, 20000.0) for u in units]
    df = spark.createDataFrame(rows, "__mix_rate double, u double")
    low, high = M.reach(F.col("__mix_rate"))
    df = df.withColumn("__mix_low", low).withColumn("__mix_high", high)
    rate = [F.col(c) for c in M.RATE]
    for r in df.withColumn("n", M.poisson(*rate, M.first_term(*rate), F.col("u"))).collect():
        at = lambda k, m=r["__mix_rate"]: math.exp(-m + k * math.log(m) - math.lgamma(k + 1)) if m else float(k == 0)
        below = math.fsum(at(k) for k in range(r.n))  # P(count < n) <= u < P(count <= n)
        assert below <= r.u + 1e-10 and r.u <= below + at(r.n) + 1e-10, r
        assert abs(r.n - r["__mix_rate"]) <= 9.5 * math.sqrt(r["__mix_rate"]) + 30


def test_clashing_columns_and_equal_rows_are_dealt_out(spark):
    rows = [(None, "same text", "a", 1, 2, 3)] * 400 + [(5, f"t{k}", "a", 1, 2, 3) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int, `x.y` int, __mix_rate int")
    out = M.mix(docs, temperature=1.0, scale=40.0)
    assert out.columns == ["doc_id", "text", "source", "copy", "x.y", "__mix_rate", "copy_", "shuffle_key"]
    assert out.select("copy", F.col("`x.y`"), "__mix_rate").distinct().collect() == [(1, 2, 3)]
    # Copies of one id aren't one partition's.
    sizes = [r["count"] for r in out.where("doc_id = 5").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 4 and max(sizes) < 2 * sum(sizes) / 4


def test_equal_rows_are_spread_over_all_partitions(spark, tmp_path):
    docs = spark.range(40_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same text").alias("text"), F.lit("a").alias("source"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    # A seed by which the document has a copy.
    seed = next(s for s in "abcdefgh" if M.mix(docs.limit(1), temperature=1.0, seed=s).count())
    for out in (M.mix(spark.read.parquet(str(tmp_path / "documents.parquet")), temperature=1.0, seed=seed, deal=d) for d in (False, True)):
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == 4 and max(sizes) < 1.1 * sum(sizes) / 4
    found = M.op2_poisson_mixing(spark, str(tmp_path))
    sizes = [r["count"] for r in found.groupBy(F.spark_partition_id()).count().collect()]
    assert not sizes or len(sizes) == 4 and max(sizes) < 1.1 * sum(sizes) / 4


def test_sql_holds_for_rates_far_above_even_ones(spark, tmp_path):
    docs = spark.range(30000).select(F.col("id").alias("doc_id"), F.lit("0123456789").alias("text"), F.when(F.col("id") % 15000 == 0, "rare").otherwise(F.concat(F.lit("s"), (F.col("id") % 2).cast("string"))).alias("source"))
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(r) for r in M.op2_poisson_mixing(spark, str(tmp_path)).select("doc_id", "source", "copy").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(con.execute(f"select doc_id, source, copy from ({M.ORACLE})").fetchall())
    assert max(r[2] for r in got if r[1] == "rare") > 8
