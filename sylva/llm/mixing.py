"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the corpus over its present share.  Each document's
count inverts the Poisson distribution with that mean at a uniform number hashed from seed and doc_id, so the
result depends on no partitioning; the document is exploded by its count and all copies are dealt out by a
hash of (seed, doc_id, copy) and sorted by it: a global shuffle.  Rates have no upper bound.

Rows are dealt out by that hash, the text and the row's place in the input, so that neither rows without doc_id nor many
equal rows go to one task.  The place is taken before any shuffle: documents should come from files, where a task that runs
again finds its rows in the same order.

Edge cases: a null source is a source of its own; a null doc_id hashes like the empty string; null texts have
length 0 and are kept; a source of weight 0 or of no characters gets no copies; an empty table gives an empty
table; repeated rows are drawn alike.  Columns of the input are kept, whatever their names; the operator's own are copy
and shuffle_key, with an underscore more where the input has a column of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, parts, sealed, spread, table, unused

REACH = 12.0  # standard deviations, and counts, about the mean outside of which 52-bit uniform numbers never fall
BLOCK = 4_096  # copies of a document that are made at a time
BROADCAST_SOURCES = 100_000
SEED = "mix-1"


def hashed_unit(*keys: Column | str) -> Column:
    """A double in (0, 1) from 52 bits of MD5, the same in any SQL engine."""
    joined = F.concat_ws(":", *[F.coalesce(F.col(k).cast("string"), F.lit("")) if isinstance(k, str) else k for k in keys])
    return (F.conv(F.substring(F.md5(joined), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def rates(docs: DataFrame, weights: dict[str, float] | None, temperature: float, scale: float) -> DataFrame:
    """One row per source: its mean repetition rate.

    Without `weights` a source's target weight is its number of characters to the power `temperature`.
    """
    size = docs.groupBy(F.col("source").alias("__mix_source")).agg(
        F.sum(F.coalesce(F.length("text"), F.lit(0))).cast("double").alias("__mix_chars")
    )
    if weights is None:
        weight = F.when(F.col("__mix_chars") > 0, F.pow("__mix_chars", F.lit(temperature))).otherwise(0.0)
    else:
        known = [F.when(F.col("__mix_source") == s, F.lit(float(w))) for s, w in weights.items()]
        weight = F.coalesce(*known, F.lit(0.0))
    size = size.withColumn("__mix_weight", weight)
    total = size.agg(F.sum("__mix_chars").alias("__mix_all"), F.sum("__mix_weight").alias("__mix_weights"))
    rate = F.try_divide(
        F.lit(scale) * F.col("__mix_all") * F.col("__mix_weight"), F.col("__mix_weights") * F.col("__mix_chars")
    )
    size = size.join(F.broadcast(total)).select("__mix_source", F.coalesce(rate, F.lit(0.0)).alias("__mix_rate"))
    low, high = reach(F.col("__mix_rate"))
    return size.withColumn("__mix_low", low).withColumn("__mix_high", high).withColumn("__mix_first", first_term(*map(F.col, RATE)))


RATE = ("__mix_rate", "__mix_low", "__mix_high")


def reach(rate: Column) -> tuple[Column, Column]:
    """The least and largest count that a uniform number of 52 bits can fall on."""
    about = F.lit(REACH) * (F.sqrt(rate) + 1)
    return F.greatest(F.floor(rate - about), F.lit(0)).cast("long"), F.ceil(rate + about).cast("long")


def first_term(rate: Column, low: Column, high: Column) -> Column:
    """The probability of the count `low`: from the sum of all terms in its units, as exp(-rate) can be 0."""
    step = lambda acc, k: F.struct((acc["p"] * rate / (k + 1)).alias("p"), (acc["sum"] + acc["p"]).alias("sum"))
    start = F.struct(F.lit(1.0).alias("p"), F.lit(0.0).alias("sum"))
    return F.when(low == 0, F.exp(-rate)).otherwise(1 / F.aggregate(F.sequence(low, high), start, step)["sum"])


def poisson(rate: Column, low: Column, high: Column, first: Column, u: Column) -> Column:
    """How many terms of the distribution function lie at or below u; terms before `low` do.

    Above the mean, terms too small to reach the next u don't count: rounded sums can stay below the last u.
    """
    step = lambda acc, k: F.struct(
        (acc["p"] * rate / (k + 1)).alias("p"),
        (acc["cdf"] + acc["p"]).alias("cdf"),
        (acc["n"] + F.when((u >= acc["cdf"] + acc["p"]) & ((k <= rate) | (acc["p"] > 1e-17)), 1).otherwise(0)).alias("n"),
    )
    start = F.struct(first.alias("p"), F.lit(0.0).alias("cdf"), low.alias("n"))
    return F.aggregate(F.sequence(low, high), start, step)["n"]


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    temperature: float = 0.7,
    scale: float = 1.0,
    seed: str = SEED,
    deal: bool = False,
) -> DataFrame:
    """Copies of the documents in a shuffled order, with `copy` (from 0) and `shuffle_key`.

    deal: small files are dealt out over all cores first.
    """
    spark, copy, key = docs.sparkSession, unused(docs, "copy"), unused(docs, "shuffle_key")
    plain, _ = sealed(docs, "doc_id", "text", "source")
    own = plain.columns
    rate = materialise(rates(plain, weights, temperature, scale), "rates")
    if rate.count() <= BROADCAST_SOURCES:  # beyond it: a shuffled join, whose hot sources AQE splits
        rate = F.broadcast(rate)
    plain = plain.withColumn("__mix_at", F.monotonically_increasing_id())
    plain = spread(plain) if deal else plain
    dealt = plain.join(rate, plain["source"].eqNullSafe(rate["__mix_source"]), "left")
    dealt = dealt.withColumn("__mix_n", poisson(*map(F.col, RATE), F.col("__mix_first"), hashed_unit(F.lit(seed), "doc_id")))
    # In two steps: the copies of a document are never one array.
    copies = dealt.where("__mix_n > 0").withColumn("__mix_block", F.explode(F.expr(f"sequence(0, __mix_n - 1, {BLOCK})")))
    copies = copies.withColumn("__mix_copy", F.explode(F.expr(f"sequence(__mix_block, least(__mix_block + {BLOCK}, __mix_n) - 1)")))
    copies = copies.withColumn("__mix_key", hashed_unit(F.lit(seed + "-order"), "doc_id", "__mix_copy"))
    copies = copies.withColumn("__mix_deal", F.xxhash64("__mix_key", "text", "__mix_at")).select(*own, "__mix_copy", "__mix_key", "__mix_deal")
    copies = copies.repartition(parts(spark), "__mix_deal").sortWithinPartitions("__mix_key")
    return copies.select(*own, "__mix_copy", "__mix_key").toDF(*docs.columns, copy, key)


def op2_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix(table(spark, sf_dir, "documents"), deal=True)
    return out.select("doc_id", "source", F.col("copy").cast("long").alias("copy"), "text", "shuffle_key")


ORACLE = f"""
with size as (
  select source, cast(sum(coalesce(length(text), 0)) as double) as chars from documents group by source),
weighted as (
  select source, chars, case when chars > 0 then pow(chars, 0.7) else 0.0 end as weight from size),
rate as (
  select source, coalesce(sum(chars) over () * weight / nullif(sum(weight) over () * chars, 0), 0.0) as r from weighted),
drawn as (
  select d.doc_id, d.source, d.text,
    (cast(('0x' || substr(md5('{SEED}:' || d.doc_id), 1, 13)) as bigint) + 0.5) / 4503599627370496.0 as u
  from documents d join rate r on d.source is not distinct from r.source),
term as (select source, r, unnest(range(0, cast(ceil(r + {REACH} * (sqrt(r) + 1)) as bigint) + 1)) as k from rate),
cdf as (
  select source, k, sum(case when r = 0 then cast(k = 0 as double) else exp(k * ln(r) - r - lgamma(k + 1)) end) over (partition by source order by k) as f
  from term),
counted as (
  select d.doc_id, d.source, d.text, d.u,
    (select count(*) from cdf c where c.source is not distinct from d.source and d.u >= c.f) as n
  from drawn d),
copies as (
  select doc_id, source, text, cast(unnest(range(0, n)) as bigint) as copy from counted)
select doc_id, source, copy, text,
  (cast(('0x' || substr(md5('{SEED}-order:' || doc_id || ':' || copy), 1, 13)) as bigint) + 0.5) / 4503599627370496.0 as shuffle_key
from copies
"""
