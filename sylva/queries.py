"""Queries that apply the library's operators to the tables, each with SQL of the same result where SQL can express it."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import streaming
from .functions import down_rez, dyadic, uniform
from .operators import evaluate, metrics, routing, splitters, voting
from .operators.features import Columns
from .operators.evaluate import AccuracySplit, BrierSplit, ChiSquared, MinWeight, Stopper, VotedError
from .operators.sampling import KFold, RandomForest, SingleTree, TimeGrouped, out_of_time, sampled_leaves, training_rows, validation_rows
from .operators.splitters import Feature, MapFeatures
from .plans import tree as T
from .plans.forest import Forest
from .sources import instances, models
from .sources.storage import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- instances


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return instances.from_table(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus", ["o_totalprice", "o_custkey", "o_orderpriority"], "o_orderdate")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events whose value is missing for every fifth id."""
    e = table(spark, sf_dir, "events").withColumn("value", F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")))
    return instances.from_table(e, "event_id", "event_type", ["value", "user_id"], "ts")


ORDERS = "select o_orderkey as id, o_orderstatus as label, 1.0::double as weight, o_totalprice, o_custkey, o_orderpriority, epoch_us(o_orderdate) as ts from orders"
EVENTS = "select event_id as id, event_type as label, 1.0::double as weight, case when event_id % 5 = 0 then null else value end as value, user_id, epoch_us(ts) as ts from events"

PRICE = Feature("o_totalprice", "ordinal", lambda c: F.floor(c / 5000))
CUSTOMER = Feature("o_custkey", "ordinal", lambda c: F.floor(c / 10))
PRIORITY = Feature("o_orderpriority", "nominal")


def h(seed: str, *keys: str) -> str:
    """SQL of functions.hash32."""
    joined = " || ':' || ".join([f"'{seed}'", *(f"coalesce(cast({k} as varchar), '')" for k in keys)])
    return f"cast(('0x' || substr(md5({joined}), 1, 8)) as bigint)"


def u(seed: str, *keys: str) -> str:
    return f"({h(seed, *keys)} / 4294967296.0)"


def fixed_tree() -> T.Tree:
    """o_totalprice < 250000 ? (priority is urgent ? 0 : 1) : (o_custkey < 750 ? 2 : 3)"""
    left = T.Node("o_orderpriority", T.Predicate("isEq", "1-URGENT"), T.Leaf(0), T.Leaf(1))
    return T.Node("o_totalprice", T.Predicate("lt", 250000.0), left, T.Node("o_custkey", T.Predicate("lt", 750.0), T.Leaf(2), T.Leaf(3)))


FIXED = """case when coalesce(o_totalprice < 250000, true) then case when coalesce(o_orderpriority = '1-URGENT', true) then 0 else 1 end
  else case when coalesce(o_custkey < 750, true) then 2 else 3 end end"""


def events_tree() -> T.Tree:
    """A tree on events with annotations (weights) 5, 9 | 20, 3 of its leaves."""
    left = T.Node("user_id", T.Predicate("lt", 50.0), T.Leaf(0, {"a": 5.0}, 5.0), T.Leaf(1, {"a": 9.0}, 9.0), 14.0)
    right = T.Node("value", T.Predicate("lt", 400.0), T.Leaf(2, {"a": 20.0}, 20.0), T.Leaf(3, {"a": 3.0}, 3.0), 23.0)
    return T.Node("value", T.Predicate("lt", 200.0), left, right, 37.0)


def route_sql(root: str, low: str, high: str) -> str:
    return f"""case when coalesce(value < 200, {root}) then case when coalesce(user_id < 50, {low}) then 0 else 1 end
      else case when coalesce(value < 400, {high}) then 2 else 3 end end"""


# ---------------------------------------------------------------- sampling


@query(f"select id, {h('kfold', 'id')} % 4 as fold from ({ORDERS})")
def kfold_assign(spark, sf):
    return orders(spark, sf).select("id", KFold(4).fold().cast("long").alias("fold"))


@query(f"""with r as (select {h('kfold', 'id')} % 4 as fold from ({ORDERS})), t as (select unnest(range(0, 4)) as tree)
select tree, sum(cast(fold <> tree as bigint))::bigint as n_train, sum(cast(fold = tree as bigint))::bigint as n_valid from r, t group by tree""")
def kfold_counts(spark, sf):
    rows, sampler = orders(spark, sf), KFold(4)
    train = training_rows(rows, sampler).groupBy("tree").agg(F.count("*").alias("n_train"))
    valid = validation_rows(rows, sampler).groupBy("tree").agg(F.count("*").alias("n_valid"))
    return train.join(valid, "tree").select(F.col("tree").cast("long").alias("tree"), "n_train", "n_valid")


def _cdf(rate: float) -> list[float]:
    out, p, cdf = [], math.exp(-rate), 0.0
    for k in range(60):
        cdf += p
        p *= rate / (k + 1)
        if 1 - cdf < 2.0**-33:
            break
        out.append(cdf)
    return out


def times_sql(tree: str, rate: float = 1.0) -> str:
    return "(" + " + ".join(f"cast({u('rf', tree, 'id')} >= {c!r} as bigint)" for c in _cdf(rate)) + ")"


@query(f"select tree, {times_sql('tree')} as times, count(*) as n from ({ORDERS}), (select unnest(range(0, 3)) as tree) group by all")
def rf_multiplicity(spark, sf):
    rows = orders(spark, sf).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(2))))
    times = RandomForest(3, 0.5).times(F.col("tree")).cast("long")
    return rows.groupBy(F.col("tree").cast("long").alias("tree"), times.alias("times")).agg(F.count("*").alias("n"))


DAY = 86_400_000_000


@query(f"""with r as (select {h('kfold', 'id')} % 2 as fold, (ts // {DAY}) % 3 as phase from ({EVENTS})), t as (select unnest(range(0, 6)) as tree),
x as (select tree, cast(phase = tree % 3 and fold <> tree // 3 as bigint) as times from r, t)
select tree, sum(times)::bigint as n_train, sum(1 - times)::bigint as n_valid from x group by tree""")
def time_grouped_counts(spark, sf):
    sampler = TimeGrouped(KFold(2), DAY, 3)
    rows = events(spark, sf).withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(5))))
    out = rows.groupBy("tree").agg(F.sum(sampler.times(F.col("tree"))).cast("long").alias("n_train"), F.sum(sampler.validates(F.col("tree")).cast("long")).alias("n_valid"))
    return out.withColumn("tree", F.col("tree").cast("long"))


@query(f"""with q as (select quantile_disc(ts, 0.8) as threshold from ({EVENTS}))
select threshold, count(*) filter (where ts < threshold) as n_train, count(*) filter (where ts >= threshold) as n_valid from ({EVENTS}), q group by threshold""")
def out_of_time_split(spark, sf):
    rows = events(spark, sf)
    sampler = out_of_time(KFold(2), rows, 0.8)
    before = F.col("ts") < sampler.threshold
    return rows.agg(F.lit(sampler.threshold).cast("long").alias("threshold"), F.sum(before.cast("long")).alias("n_train"), F.sum((~before).cast("long")).alias("n_valid"))


@query(f"select id, tree, leaf from (select id, 0::bigint as tree, ({FIXED})::bigint as leaf from ({ORDERS})) where {u('local', 'id', 'tree', 'leaf')} < 0.25")
def downsampled_rows(spark, sf):
    from .operators.sampling import downsampled

    routed = routing.route(orders(spark, sf).withColumn("tree", F.lit(0)), {0: fixed_tree()})
    return downsampled(routed, F.lit(0.25)).select("id", F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"))


@query(f"""with l as (select tree, leaf from (select unnest(range(0, 3)) as tree), (select unnest(range(0, 20)) as leaf))
select tree, leaf from (select *, row_number() over (partition by tree order by {h('leaves', 'tree', 'leaf')}, leaf) as r from l) where r <= 5""")
def sampled_leaves_bottom_k(spark, sf):
    grid = spark.range(3).withColumnRenamed("id", "tree").withColumn("leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(19).cast("long"))))
    return sampled_leaves(grid, 5)


# ---------------------------------------------------------------- features and statistics


def down_rez_sql(v: str) -> str:
    step = f"pow(2.0, floor(ln(abs({v}) / 100.0) / ln(2.0)))"
    return f"(case when {v} = 0 then 0.0 else sign({v}) * floor(abs({v}) / {step} + 0.5) * {step} end)"


@query(f"select {down_rez_sql('o_totalprice')}::double as bin, count(*) as n from orders group by 1")
def downrez_bins(spark, sf):
    return table(spark, sf, "orders").groupBy(down_rez("o_totalprice").alias("bin")).agg(F.count("*").alias("n"))


@query(f"select {down_rez_sql('value')}::double as bin, count(*) as n from events group by 1")
def downrez_bins_events(spark, sf):
    return table(spark, sf, "events").groupBy(down_rez("value").alias("bin")).agg(F.count("*").alias("n"))


@query("select floor(value / 16.0) * 16.0 as bin, count(*) as n from events group by 1")
def dyadic_bins(spark, sf):
    return table(spark, sf, "events").groupBy(dyadic("value", 4).alias("bin")).agg(F.count("*").alias("n"))


@query(f"""select id, 'o_totalprice' as feature, floor(o_totalprice / 5000)::double as num, null::varchar as str from ({ORDERS})
union all select id, 'o_custkey', floor(o_custkey / 10)::double, null from ({ORDERS})
union all select id, 'o_orderpriority', null, o_orderpriority from ({ORDERS})""")
def instances_long(spark, sf):
    return splitters.long_form(orders(spark, sf), [PRICE, CUSTOMER, PRIORITY], ["id"])


LINE_STATS = " union all ".join(f"select '{f}' as feature, {f}::double as num, l_returnflag as label from lineitem" for f in ("l_quantity", "l_discount", "l_tax"))


@query(f"select feature, num, label, count(*)::double as w from ({LINE_STATS}) group by all")
def split_stats(spark, sf):
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("label"), F.lit(1.0).alias("weight"), "l_quantity", "l_discount", "l_tax")
    features = [Feature(f, "ordinal") for f in ("l_quantity", "l_discount", "l_tax")]
    return splitters.statistics(rows, features, []).select("feature", "num", "label", "w")


# ---------------------------------------------------------------- best splits

TREES = "(select unnest(range(0, 4)) as tree)"
FOLDS = f"select r.*, tree from ({ORDERS}) r, {TREES} where {h('kfold', 'id')} % 4 <> tree"
NUMERIC = f"""select tree, feature, num, null::varchar as str, label, sum(weight) as w from (
  select tree, label, weight, 'o_totalprice' as feature, floor(o_totalprice / 5000)::double as num from ({FOLDS})
  union all select tree, label, weight, 'o_custkey', floor(o_custkey / 10)::double from ({FOLDS})) group by all"""
NOMINAL = f"select tree, 'o_orderpriority' as feature, null::double as num, o_orderpriority as str, label, sum(weight) as w from ({FOLDS}) group by all"


def candidates_sql(stats: str, keys: str = "tree") -> str:
    return f"""stats as ({stats}),
vals as (select distinct {keys}, feature, num, str from stats),
labs as (select distinct {keys}, feature, label from stats),
grid as (select v.*, l.label, coalesce(s.w, 0) as w from vals v join labs l using ({keys}, feature)
  left join stats s on {' and '.join(f's.{k} = v.{k}' for k in keys.split(', '))} and s.feature = v.feature and s.label = l.label and s.num is not distinct from v.num and s.str is not distinct from v.str),
sided as (select {keys}, feature, num, str, label, sum(w) over (partition by {keys}, feature, label) as tw,
  case when num is null then w else coalesce(sum(w) over (partition by {keys}, feature, label order by num rows between unbounded preceding and 1 preceding), 0) end as lw from grid),
cand as (select {keys}, feature, case when num is null then 'isEq' else 'lt' end as op, num, str, label, lw, tw - lw as rw from sided)"""


SCORES = {
    "chi2": "sum(case when lw + rw > 0 then (lw - (lw + rw) * lt / n) ** 2 / ((lw + rw) * lt / n) + (rw - (lw + rw) * rt / n) ** 2 / ((lw + rw) * rt / n) else 0 end)",
    "chi2_multiplicity": "sum(case when lw + rw > 0 then ((lw > 0)::int + (rw > 0)::int) * ((lw - (lw + rw) * lt / n) ** 2 / ((lw + rw) * lt / n) + (rw - (lw + rw) * rt / n) ** 2 / ((lw + rw) * rt / n)) else 0 end)",
    "brier": "-sum(lw * ((1 - lw / lt) ** 2 - (lw / lt) ** 2) + lt * (lw / lt) ** 2 + rw * ((1 - rw / rt) ** 2 - (rw / rt) ** 2) + rt * (rw / rt) ** 2) / max(n)",
    "accuracy": "-(max(n) - max(lw) - max(rw)) / max(n)",
}


def best_sql(candidates: str, score: str, where: str = "true", keys: str = "tree") -> str:
    """candidates: CTEs that end in `cand`."""
    own = f"{keys}, feature, op, num, str"
    return f"""with {candidates},
sums as (select *, sum(lw) over (partition by {own}) as lt, sum(rw) over (partition by {own}) as rt, sum(lw + rw) over (partition by {own}) as n from cand),
scored as (select {own}, max(lt) as lt, max(rt) as rt, {SCORES[score]} as score from sums where lt > 0 and rt > 0 and {where} group by {own}),
ranked as (select *, row_number() over (partition by {keys} order by round(score, 9) desc, feature, op, num nulls last, str) as r from scored)
select {keys}, feature, op, num, str, lt::double as lt, rt::double as rt, round(score, 6) as score from ranked where r = 1"""


def _best(candidates: DataFrame, evaluator: evaluate.Evaluator, keys: list[str] = ("tree",)) -> DataFrame:
    best = evaluate.best_splits(evaluator.evaluate(candidates, list(keys)), list(keys))
    return best.select(*[F.col(k).cast("long").alias(k) for k in keys], "feature", "op", "num", "str", "lt", "rt", F.round("score", 6).alias("score"))


def _of_forest(spark, sf, features: tuple[Feature, ...], evaluator: evaluate.Evaluator = ChiSquared()) -> DataFrame:
    """The best first splits of a cross-validated forest."""
    best = Forest(orders(spark, sf), features, KFold(4), evaluator).best_splits()
    return best.select(F.col("tree").cast("long").alias("tree"), "feature", "op", "num", "str", "lt", "rt", F.round("score", 6).alias("score"))


@query(best_sql(candidates_sql(NUMERIC), "chi2"))
def best_split_chi2(spark, sf):
    return _of_forest(spark, sf, (PRICE, CUSTOMER))


@query(best_sql(candidates_sql(NUMERIC), "chi2_multiplicity"))
def best_split_chi2_multiplicity(spark, sf):
    return _of_forest(spark, sf, (PRICE, CUSTOMER), ChiSquared(label_multiplicity=True))


@query(best_sql(candidates_sql(NOMINAL), "chi2"))
def best_split_nominal(spark, sf):
    return _of_forest(spark, sf, (PRIORITY,))


@query(best_sql(candidates_sql(NUMERIC + " union all " + NOMINAL), "chi2", "lt > 500 and rt > 500"))
def best_split_minweight(spark, sf):
    return _of_forest(spark, sf, (PRICE, CUSTOMER, PRIORITY), MinWeight(lambda w: w > 500))


@query(best_sql(candidates_sql(NUMERIC), "brier"))
def best_split_brier(spark, sf):
    return _of_forest(spark, sf, (PRICE, CUSTOMER), BrierSplit())


@query(best_sql(candidates_sql(NUMERIC), "accuracy"))
def best_split_accuracy(spark, sf):
    return _of_forest(spark, sf, (PRICE, CUSTOMER), AccuracySplit())


@query(best_sql(candidates_sql(NUMERIC), "brier"))
def best_split_voted_brier(spark, sf):
    """The same by an error and a voter that are written once, for Spark's arrays and for numpy's."""
    return _of_forest(spark, sf, (PRICE, CUSTOMER), VotedError("brier", "soft"))


@query(best_sql(candidates_sql(NUMERIC), "accuracy"))
def best_split_voted_accuracy(spark, sf):
    return _of_forest(spark, sf, (PRICE, CUSTOMER), VotedError("accuracy", "mode"))


SPARSE = f"""stats as (select 0::bigint as tree, cast(user_id as varchar) as str, label, sum(weight) as w from ({EVENTS}) where user_id is not null group by all),
top as (select *, row_number() over (partition by label order by w desc, str) as r from stats),
parent as (select label, sum(weight) as total from ({EVENTS}) group by label),
vals as (select distinct str from top where r <= 20),
cand as (select 0::bigint as tree, 'user_id' as feature, 'isEq' as op, null::double as num, v.str, p.label, coalesce(s.w, 0) as lw, p.total - coalesce(s.w, 0) as rw
  from vals v, parent p left join stats s on s.str = v.str and s.label = p.label)"""


@query(best_sql(SPARSE, "chi2"))
def best_split_sparse_topk(spark, sf):
    rows = events(spark, sf).withColumn("tree", F.lit(0))
    stats = splitters.statistics(rows, [Feature("user_id", "sparse")], ["tree"])
    parents = rows.groupBy("tree", "label").agg(F.sum("weight").alias("weight"))
    return _best(splitters.heavy_hitters(stats, parents, ["tree"], 20), ChiSquared())


QUANTILE = f"""cuts as (select unnest(list_distinct([{', '.join(f'quantile_disc(value, {i / 10})' for i in range(1, 10))}])) as num from ({EVENTS}) where value is not null),
cand as (select 0::bigint as tree, 'value' as feature, 'lt' as op, c.num, null::varchar as str, label, sum(case when value < c.num then weight else 0 end) as lw, sum(case when value < c.num then 0 else weight end) as rw
  from ({EVENTS}), cuts c where value is not null group by all)"""


@query(best_sql(QUANTILE, "chi2"))
def best_split_quantile(spark, sf):
    rows = events(spark, sf).withColumn("tree", F.lit(0))
    return _best(splitters.quantiles(rows, [Feature("value", "continuous")], ["tree"], 10, exact=True), ChiSquared())


DYADIC = f"select 0::bigint as tree, 'value' as feature, floor(value / 16.0) * 16.0 as num, null::varchar as str, label, sum(weight) as w from ({EVENTS}) where value is not null group by all"


@query(best_sql(candidates_sql(DYADIC), "chi2"))
def best_split_dyadic(spark, sf):
    stats = splitters.statistics(events(spark, sf).withColumn("tree", F.lit(0)), [Feature("value", "ordinal")], ["tree"])
    return _best(splitters.dyadic_cuts(stats, ["tree"], 4), ChiSquared())


@query(best_sql(SPARSE, "chi2"))
def best_split_sparse_sketch(spark, sf):
    """Frequent values from one sketch a label, which tracks more items than there are values here."""
    rows = events(spark, sf).withColumn("tree", F.lit(0))
    parents = rows.groupBy("tree", "label").agg(F.sum("weight").alias("weight"))
    return _best(splitters.heavy_hitter_sketches(rows, [Feature("user_id", "sparse")], parents, ["tree"], 20, 20_000), ChiSquared())


@query(f"select label, count(*)::double as w, 9::bigint as cuts, true as near from ({EVENTS}) where value is not null group by label")
def quantile_digest_sides(spark, sf):
    """Sides of nine cuts by digests: each within 1.5 % of the label's rows of the exact one."""
    rows = events(spark, sf).withColumn("tree", F.lit(0))
    found = splitters.quantile_digests(rows, [Feature("value", "continuous")], ["tree"], 10, 1000).persist()
    values = splitters.raw_statistics(rows, [Feature("value", "continuous")], ["tree"]).select("label", F.col("num").alias("x"), "w")
    exact = found.select("label", "num", "lw", "rw").join(values, "label").groupBy("label", "num", "lw", "rw").agg(F.sum(F.when(F.col("x") <= F.col("num"), F.col("w")).otherwise(0.0)).alias("left"), F.sum("w").alias("w"))
    near = (F.abs(F.col("lw") - F.col("left")) <= 0.015 * F.col("w")) & (F.abs(F.col("lw") + F.col("rw") - F.col("w")) < 1e-6)
    return exact.groupBy("label").agg(F.max("w").alias("w"), F.count("*").alias("cuts"), F.min(near).alias("near"))


def dyadic_sql(value: str, levels: int, finest: int = 0) -> str:
    """CTEs: kept nodes (l, pos, w), and whether both halves hold values."""
    return f"""base as (select floor(({value}) / {2**finest}.0)::bigint as v, sum(weight) as w from ({EVENTS}) where ({value}) is not null group by 1),
lev as (select v, w, unnest(range(0, {levels + 1})) as l from base),
node as (select l, floor(v / pow(2.0, l))::bigint as pos, sum(w) as w from lev group by all),
half as (select l + 1 as l, floor(pos / 2.0)::bigint as pos, count(*) as n from node group by all),
kept as (select n.l + {finest} as l, n.pos, n.w, coalesce(h.n, 0) = 2 as halves from node n left join half h on h.l = n.l and h.pos = n.pos where n.w > (select sum(w) from base) / 64.0)"""


@query(best_sql(f"""{dyadic_sql('value', 40)},
cuts as (select distinct (pos + 0.5) * pow(2.0, l) as num from kept where halves),
cand as (select 0::bigint as tree, 'value' as feature, 'lt' as op, c.num, null::varchar as str, label, sum(case when value < c.num then weight else 0 end) as lw, sum(case when value < c.num then 0 else weight end) as rw
  from ({EVENTS}), cuts c where value is not null group by all)""", "chi2"))
def best_split_adaptive_dyadic(spark, sf):
    """Thresholds in the middle of the nodes of a tree of dyadic intervals that hold more than 1/64 of the weight."""
    rows = events(spark, sf).withColumn("tree", F.lit(0))
    stats = splitters.raw_statistics(rows, [Feature("value", "continuous")], ["tree"])
    return _best(splitters.adaptive_dyadic_cuts(stats, ["tree"], 6), ChiSquared())


@query(f"""with {dyadic_sql('ts', 42, 20)},
ends as (select pos * pow(2.0, l) as x from kept union select (pos + 1) * pow(2.0, l) from kept),
share as (select x, (select sum(weight) from ({EVENTS}) where ts < x) / (select sum(w) from base) as below from ends),
cut as (select min(x)::bigint as threshold from share where below >= 0.8)
select threshold, count(*) filter (where ts < threshold) as n_train, count(*) filter (where ts >= threshold) as n_valid from ({EVENTS}), cut group by threshold""")
def out_of_time_by_dyadic_tree(spark, sf):
    """Rows before and from the upper bound that a compressed tree of times knows of their quantile."""
    rows = events(spark, sf)
    sampler = out_of_time(KFold(2), rows, 0.8, compression=6)
    before = F.col("ts") < sampler.threshold
    return rows.agg(F.lit(sampler.threshold).cast("long").alias("threshold"), F.sum(before.cast("long")).alias("n_train"), F.sum((~before).cast("long")).alias("n_valid"))


@query(f"""with {candidates_sql(NOMINAL)}, ids as (select distinct tree, feature, op, num, str from cand),
one as (select *, row_number() over (partition by tree, feature order by {h('split', 'tree', 'feature', 'str')}, str) as r from ids)
select tree, feature, str, label, lw::double as lw, rw::double as rw from cand semi join (select * from one where r = 1) o using (tree, feature, str)""")
def random_split(spark, sf):
    forest = Forest(orders(spark, sf), (PRIORITY,), KFold(4))
    one = splitters.one_at_random(forest.candidates(forest.training()).drop("leaf"), ["tree"])
    return one.select(F.col("tree").cast("long").alias("tree"), "feature", "str", "label", "lw", "rw")


@query(f"""with l as (select ({FIXED})::bigint as leaf, label, sum(weight) as weight from ({ORDERS}) group by all),
t as (select leaf, sum(weight)::double as total, count(*) filter (where weight > 0) as labels from l group by leaf)
select leaf, total, labels > 1 and total > 1000 as splits, total > 2000 as splits_distributed, least(1.0, 2000 / total) as local_rate from t""")
def stopper_rules(spark, sf):
    targets = routing.leaf_targets(routing.route(orders(spark, sf), {0: fixed_tree()}))
    return Stopper(2000, 1000).columns(targets, ["leaf"]).withColumn("leaf", F.col("leaf").cast("long"))


@query()
def approximate_heavy_hitters(spark, sf):
    """A sketch: compared in tests with exact counts."""
    return splitters.approximate_heavy_hitters(events(spark, sf).withColumn("tree", F.lit(0)), "user_id", ["tree"], 20)


@query()
def best_split_quantile_sketch(spark, sf):
    """Cut points from a sketch, exact sides; compared in tests with exact quantiles."""
    rows = events(spark, sf).withColumn("tree", F.lit(0))
    return _best(splitters.quantiles(rows, [Feature("value", "continuous")], ["tree"], 25), ChiSquared())


# ---------------------------------------------------------------- routing

LEAVES = f"select id, ({FIXED})::bigint as leaf from ({ORDERS})"


@query(LEAVES)
def route_fixed_tree(spark, sf):
    return routing.route(orders(spark, sf), {0: fixed_tree()}).select("id", F.col("leaf").cast("long").alias("leaf"))


@query(LEAVES)
def route_by_level(spark, sf):
    routed = routing.route_by_level(orders(spark, sf).withColumn("tree", F.lit(0)), {0: fixed_tree()})
    return routed.select("id", F.col("leaf").cast("long").alias("leaf"))


@query(f"select ({FIXED})::bigint as leaf, label, sum(weight)::double as weight from ({ORDERS}) group by all")
def update_targets_fixed_tree(spark, sf):
    forest = Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), trees={0: fixed_tree()}).update_targets()
    rows = [(x.index, k, w) for x in T.leaves(forest.trees[0]) for k, w in sorted(x.target.items())]
    return spark.createDataFrame(rows, "leaf long, label string, weight double")


def _routed(order: str) -> Query:
    def run(spark, sf):
        routed = routing.route(events(spark, sf), {0: events_tree()}, order)
        return routed.select("id", F.col("leaf").cast("long").alias("leaf"))

    run.__name__ = f"route_missing_{order}"
    return run


def coin(path: str) -> str:
    return u("traversal", "0", "id", f"'{path}'")


for _order, _root, _low, _high in (
    ("depth", "true", "true", "true"),
    ("weighted", "14 >= 23", "5 >= 9", "20 >= 3"),
    ("random", f"{coin('')} < 0.5", f"{coin('L')} < 0.5", f"{coin('R')} < 0.5"),
    ("probabilistic", f"{coin('')} * 37 < 14", f"{coin('L')} * 14 < 5", f"{coin('R')} * 23 < 20"),
):
    query(f"select id, ({route_sql(_root, _low, _high)})::bigint as leaf from ({EVENTS})")(_routed(_order))

_ALL = f"""select id, unnest([0, 1, 2, 3])::bigint as leaf, unnest([
    coalesce(value < 200, true) and coalesce(user_id < 50, true), coalesce(value < 200, true) and coalesce(user_id >= 50, true),
    coalesce(value >= 200, true) and coalesce(value < 400, true), coalesce(value >= 200, true) and coalesce(value >= 400, true)]) as hit from ({EVENTS})"""


@query(f"select id, leaf, row_number() over (partition by id order by leaf) as ord from ({_ALL}) where hit")
def route_all_leaves(spark, sf):
    found = routing.all_leaves(events(spark, sf), events_tree())
    return found.select("id", F.col("leaf").cast("long").alias("leaf"), F.col("ord").cast("long").alias("ord"))


@query(f"select id, leaf from (select id, leaf, row_number() over (partition by id order by leaf) as ord from ({_ALL}) where hit) where ord <= 2")
def route_limit(spark, sf):
    return routing.all_leaves(events(spark, sf), events_tree(), limit=2).select("id", F.col("leaf").cast("long").alias("leaf"))


def _ordered_sql(root: str, low: str, high: str) -> str:
    """The first two of the leaves that a row may reach; a digit for each node above a leaf, 0 on the side that comes first."""
    digit = lambda first, left: f"case when {first} then {int(not left)} else {int(left)} end"
    keys = ", ".join(f"{digit(root, k < 2)} * 2 + {digit(low if k < 2 else high, k % 2 == 0)}" for k in range(4))
    ranked = f"select a.id, a.leaf, row_number() over (partition by a.id order by k.key) as ord from ({_ALL}) a join (select id, unnest([0, 1, 2, 3])::bigint as leaf, unnest([{keys}]) as key from ({EVENTS})) k on k.id = a.id and k.leaf = a.leaf where a.hit"
    return f"select id, leaf, ord from ({ranked}) where ord <= 2"


def _ordered(order: str, walked: bool) -> Query:
    def run(spark, sf):
        found = routing.all_leaves(events(spark, sf), {0: events_tree()}, 2, order, case_nodes=0 if walked else None)
        return found.select("id", F.col("leaf").cast("long").alias("leaf"), F.col("ord").cast("long").alias("ord"))

    run.__name__ = f"route_leaves_{order}" + "_walked" * walked
    return run


for _order, _root, _low, _high in (
    ("weighted", "14 >= 23", "5 >= 9", "20 >= 3"),
    ("random", f"{coin('')} < 0.5", f"{coin('L')} < 0.5", f"{coin('R')} < 0.5"),
    ("probabilistic", f"{coin('')} * 37 < 14", f"{coin('L')} * 14 < 5", f"{coin('R')} * 23 < 20"),
):
    query(_ordered_sql(_root, _low, _high))(_ordered(_order, False))
    query(_ordered_sql(_root, _low, _high))(_ordered(_order, True))


@query(LEAVES)
def route_by_walk(spark, sf):
    """The same leaves by compressed trees that numpy walks."""
    return routing.route(orders(spark, sf), {0: fixed_tree()}, case_nodes=0).select("id", F.col("leaf").cast("long").alias("leaf"))


# ---------------------------------------------------------------- growth


def _grown(spark, *forests: Forest) -> DataFrame:
    """Splits with the weights of their sides; of several steps of growth, each split as it was when it was new."""
    rows, seen = [], set()
    for i, tree in ((i, t) for f in forests for i, t in f.trees.items()):
        for path, t in T.with_paths(tree):
            if isinstance(t, T.Node) and (i, path) not in seen:
                seen.add((i, path))
                rows.append((i, path, t.feature, float(t.predicate.value), float(T.total(T.target_of(t.left))), float(T.total(T.target_of(t.right)))))
    return spark.createDataFrame(rows, "tree long, path string, feature string, num double, lt double, rt double")


#: Names and SQL of the features of orders; and the column that holds each.
BINNED = {"o_totalprice": "floor(o_totalprice / 5000)::double", "o_custkey": "floor(o_custkey / 10)::double"}


def tree_sql(levels: int, minimum: int, rows: str = FOLDS, allowed: str = "true", features: dict[str, str] = BINNED) -> str:
    """Level by level: rows carry the path of their leaf.  allowed: whether a node, by tree and path, may use a feature."""
    own_values = ", ".join(f"{v} as f{i}" for i, v in enumerate(features.values()))
    ctes = [f"r0 as (select *, '' as path, {own_values} from ({rows}))"]
    for k in range(levels):
        long = " union all ".join(f"select tree, path, label, weight, '{f}' as feature, f{i} as num from r{k}" for i, f in enumerate(features))
        stats = f"""select s.* from (select tree, path, feature, num, null::varchar as str, label, sum(weight) as w from ({long}) where num is not null and {allowed} group by all) s
          semi join (select tree, path from r{k} group by tree, path having sum(weight) > {minimum} and count(distinct label) > 1) g using (tree, path)"""
        own = candidates_sql(stats, "tree, path")
        for name in ("stats", "vals", "labs", "grid", "sided", "cand"):
            own = own.replace(f"{name} as (", f"{name}{k} as (", 1) if own.startswith(f"{name} as (") else own.replace(f"\n{name} as (", f"\n{name}{k} as (", 1)
            for word in ("from ", "join "):
                own = own.replace(f"{word}{name} ", f"{word}{name}{k} ").replace(f"{word}{name})", f"{word}{name}{k})").replace(f"{word}{name},", f"{word}{name}{k},")
        keys = "tree, path, feature, op, num, str"
        value = "case b.feature " + " ".join(f"when '{f}' then r.f{i}" for i, f in enumerate(features)) + " end"
        ctes += [
            own,
            f"sums{k} as (select *, sum(lw) over (partition by {keys}) as lt, sum(rw) over (partition by {keys}) as rt, sum(lw + rw) over (partition by {keys}) as n from cand{k})",
            f"scored{k} as (select {keys}, max(lt) as lt, max(rt) as rt, {SCORES['chi2']} as score from sums{k} where lt > 0 and rt > 0 group by {keys})",
            f"best{k} as (select * from (select *, row_number() over (partition by tree, path order by round(score, 9) desc, feature, op, num nulls last, str) as rn from scored{k}) where rn = 1)",
            f"""r{k + 1} as (select r.* exclude (path), case when b.feature is null then r.path || '.' when coalesce({value} < b.num, true) then r.path || 'L' else r.path || 'R' end as path
              from r{k} r left join best{k} b on b.tree = r.tree and b.path = r.path)""",
        ]
    found = " union all ".join(f"select tree, path, feature, num, lt::double as lt, rt::double as rt from best{k}" for k in range(levels))
    return "with " + ",\n".join(ctes) + f"\n{found}"


def _binned_orders(spark, sf) -> DataFrame:
    rows = orders(spark, sf)
    return rows.withColumn("o_totalprice", F.floor(F.col("o_totalprice") / 5000).cast("double")).withColumn("o_custkey", F.floor(F.col("o_custkey") / 10).cast("double"))


@query(tree_sql(2, 100))
def tree_depth2(spark, sf):
    rows = _binned_orders(spark, sf)
    forest = Forest(rows, (Feature("o_totalprice", "ordinal"), Feature("o_custkey", "ordinal")), KFold(4), stopper=Stopper(100, 100))
    return _grown(spark, forest.expand_times(2))


#: Events whose features are a map: `k` of props but for every seventh id, and two of the columns.
PROPS = {"k": "case when event_id % 7 <> 0 then json_extract(props, '$.k')::double end", "user": "floor(user_id / 10)::double", "value": "floor(value / 5)::double"}
EVENT_FOLDS = f"select e.*, event_type as label, 1.0::double as weight, tree from events e, (select unnest(range(0, 3)) as tree) where {h('kfold', 'event_id')} % 3 <> tree"


def open_events(spark: SparkSession, sf: str, tagged: bool = False) -> DataFrame:
    """Events as instances with an open map of features, from the JSON text props and from columns."""
    e = table(spark, sf, "events")
    props = F.from_json("props", "map<string, string>")
    props = F.map_filter(props, lambda k, v: F.col("event_id") % 7 != 0)
    own = {"user": F.floor(F.col("user_id") / 10), "value": F.floor(F.col("value") / 5)}
    if tagged:
        kinds = {"k": "ordinal", "user": "ordinal", "value": "continuous", "day": "nominal"}
        own = {"user": F.floor(F.col("user_id") / 10), "value": F.col("value"), "day": F.date_format("ts", "yyyy-MM-dd")}
        features = instances.tagged_map(kinds, own, [props])
    else:
        features = F.map_concat(F.transform_values(props, lambda k, v: v.try_cast("double")), F.create_map(*[x for f, c in own.items() for x in (F.lit(f), c.cast("double"))]))
    return e.select(F.col("event_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("label"), F.lit(1.0).alias("weight"), features.alias("features"))


@query(tree_sql(2, 100, EVENT_FOLDS, features=PROPS))
def open_map_depth2(spark, sf):
    """Two levels on a map of features of any names: exploded, found by aggregation, routed by lookup."""
    forest = Forest(open_events(spark, sf), MapFeatures("features", "ordinal"), KFold(3), stopper=Stopper(100, 100)).expand_times(1)
    return _grown(spark, forest, forest.expand())


_TAGGED = " union all ".join(
    f"select tree, '{f}' as feature, {num}::double as num, {text}::varchar as str, label, sum(weight) as w from ({EVENT_FOLDS}) where coalesce({num}::varchar, {text}) is not null group by all"
    for f, num, text in (("k", PROPS["k"], "null"), ("user", PROPS["user"], "null"), ("value", down_rez_sql("value"), "null"), ("day", "null", "strftime(ts, '%Y-%m-%d')"))
)


@query(best_sql(candidates_sql(_TAGGED), "chi2"))
def best_split_tagged_values(spark, sf):
    """Values that say by row what kind they are: numbers split by <, binned if continuous, texts by equality."""
    found = Forest(open_events(spark, sf, True), MapFeatures(), KFold(3)).best_splits()
    return found.select(F.col("tree").cast("long").alias("tree"), "feature", "op", "num", "str", "lt", "rt", F.round("score", 6).alias("score"))


@query(tree_sql(2, 100))
def grow_in_memory(spark, sf):
    """The same two levels, grown in one task a tree while its rows fit there."""
    features = (Feature("o_totalprice", "ordinal"), Feature("o_custkey", "ordinal"))
    forest = Forest(_binned_orders(spark, sf), features, KFold(4), stopper=Stopper(1e12, 100)).update_targets()
    return _grown(spark, forest.expand_in_memory(2))


BOOTSTRAP = f"select * exclude (weight, times), weight * times as weight from (select r.*, tree, {times_sql('tree')} as times from ({ORDERS}) r, (select unnest(range(0, 3)) as tree)) where times > 0"
ALLOWED = f"{u('rf-feature', 'tree', 'path', 'feature')} < 0.7"


@query(tree_sql(2, 100, BOOTSTRAP, ALLOWED))
def random_forest_depth2(spark, sf):
    """Two levels of a bootstrap forest with a random subset of features at each node."""
    features = (Feature("o_totalprice", "ordinal"), Feature("o_custkey", "ordinal"))
    return _grown(spark, Forest(_binned_orders(spark, sf), features, RandomForest(3, 0.7), stopper=Stopper(100, 100)).expand_times(2))


@query(tree_sql(2, 100, BOOTSTRAP, ALLOWED))
def random_forest_in_memory(spark, sf):
    """The same, each tree in one task while its rows fit there."""
    features = (Feature("o_totalprice", "ordinal"), Feature("o_custkey", "ordinal"))
    forest = Forest(_binned_orders(spark, sf), features, RandomForest(3, 0.7), stopper=Stopper(1e12, 100)).update_targets()
    return _grown(spark, forest.expand_in_memory(2))


@query(tree_sql(1, 100, f"select *, 0 as tree from ({ORDERS})"))
def one_leaf_at_a_time(spark, sf):
    """The first step of a single tree that splits one leaf a step."""
    from .plans import recipes

    features = (Feature("o_totalprice", "ordinal"), Feature("o_custkey", "ordinal"))
    forest, _ = next(recipes.one_leaf_at_a_time(_binned_orders(spark, sf), features, 1, Stopper(100, 100)))
    return _grown(spark, forest)


def _leaf_rows(spark, forest: Forest) -> DataFrame:
    rows = [(i, p, x.index, json.dumps(x.target, sort_keys=True)) for i, t in forest.trees.items() for p, x in T.with_paths(t) if isinstance(x, T.Leaf)]
    return spark.createDataFrame(rows, "tree long, path string, leaf long, target string")


def _embeddings(spark, sf) -> tuple[DataFrame, tuple[Feature, ...]]:
    vectors = table(spark, sf, "embeddings")
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    names = [f"e{k}" for k in range(width)]
    e = vectors.select("vec_id", "label", *[F.get("embedding", F.lit(k)).cast("double").alias(n) for k, n in enumerate(names)])
    return instances.from_table(e, "vec_id", "label", names), tuple(Feature(n, "continuous") for n in names)


@query()
def expand_in_memory(spark, sf):
    """Growth in single tasks, below a first distributed level; the result is an iterative model."""
    rows, features = _embeddings(spark, sf)
    forest = Forest(rows, features, KFold(2), stopper=Stopper(2000, 20)).update_targets().expand(local=True)
    return _leaf_rows(spark, forest.expand_in_memory(3))


@query()
def random_forest_growth(spark, sf):
    """A bootstrap forest with feature subsets, grown, validated and pruned."""
    forest = Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), RandomForest(3, 0.7), stopper=Stopper(100, 100))
    return _leaf_rows(spark, forest.expand_times(2).prune())


@query()
def sparse_and_quantile_growth(spark, sf):
    features = (Feature("value", "continuous"), Feature("user_id", "sparse"))
    forest = Forest(events(spark, sf), features, KFold(2), stopper=Stopper(100, 100), capacity=50, cuts=10)
    return _leaf_rows(spark, forest.expand_times(2))


# ---------------------------------------------------------------- votes


def fixed_forest() -> dict[int, T.Tree]:
    a, b = {"F": 3.0, "O": 5.0, "P": 2.0}, {"F": 6.0, "O": 1.0}
    c, d = {"P": 9.0, "O": 1.0}, {"O": 0.25, "F": 0.25}
    one = T.Node("o_totalprice", T.Predicate("lt", 250000.0), T.Leaf(0, a), T.Leaf(1, b))
    two = T.Node("o_custkey", T.Predicate("lt", 300.0), T.Leaf(0, c), T.Leaf(1, d))
    three = T.Node("o_orderpriority", T.Predicate("isEq", "1-URGENT"), T.Leaf(0, b), T.Leaf(1, c))
    return {0: one, 1: two, 2: three}


_LEAF_OF = ("case when o_totalprice < 250000 then 0 else 1 end", "case when o_custkey < 300 then 0 else 1 end", "case when o_orderpriority = '1-URGENT' then 0 else 1 end")
VOTES = "votes as (select r.id, t.tree, t.label, t.weight from (" + " union all ".join(f"select id, {i} as tree, {c} as leaf from ({ORDERS})" for i, c in enumerate(_LEAF_OF)) + ") r join (values " + ", ".join(f"({i}, {x.index}, '{k}', {w!r}::double)" for i, t in fixed_forest().items() for x in T.leaves(t) for k, w in x.target.items()) + ") t(tree, leaf, label, weight) using (tree, leaf))"
SOFT = f"{VOTES}, soft as (select id, label, sum(share) / 3 as p from (select id, label, greatest(weight, 0) / greatest(sum(greatest(weight, 0)) over (partition by id, tree), 1.0) as share from votes) group by id, label)"


def _votes(spark, sf) -> tuple[Forest, DataFrame]:
    rows = orders(spark, sf)
    forest = Forest(rows, (PRICE, CUSTOMER, PRIORITY), KFold(3), trees=fixed_forest())
    return forest, forest.votes(rows)


@query(f"with {SOFT} select id, label, round(p, 9) as p from soft")
def predict_soft(spark, sf):
    return voting.soft(_votes(spark, sf)[1]).select("id", "label", F.round("p", 9).alias("p"))


@query(f"with {SOFT} select id, label, round(p, 9) as p from soft")
def predict_folded(spark, sf):
    """The same shares by a function of the list of an id's targets that Spark knows nothing of."""
    return voting.folded(_votes(spark, sf)[1], voting.soft_target).select("id", "label", F.round("p", 9).alias("p"))


@query(f"""with {VOTES}, best as (select id, tree, label from (select *, row_number() over (partition by id, tree order by weight desc, label) as r from votes) where r = 1)
select id, label, round(count(*) / 3.0, 9)::double as p from best group by id, label""")
def predict_mode(spark, sf):
    return voting.mode(_votes(spark, sf)[1]).select("id", "label", F.round("p", 9).alias("p"))


@query(f"with {SOFT} select id, coalesce(max(p) filter (where label = 'P'), 0) > 0.4 as vote from soft group by id")
def predict_threshold(spark, sf):
    return voting.threshold(voting.soft(_votes(spark, sf)[1]), 0.4, "P")


@query(f"with {VOTES}, v as (select id, tree, sum(weight) as value from votes group by all) select id, round(avg(value), 9) as vote from v group by id")
def predict_mean(spark, sf):
    values = _votes(spark, sf)[1].groupBy("id", "tree").agg(F.sum("weight").alias("value"))
    return voting.mean(values).select("id", F.round("vote", 9).alias("vote"))


@query(f"with {VOTES} select id, max(weight) as vote from votes group by id")
def predict_combined(spark, sf):
    return voting.combined(_votes(spark, sf)[1], F.max("weight"))


@query(f"""with {VOTES}, cut as (select id, tree, label, least(weight, 4.0) as weight from votes),
s as (select id, label, weight / greatest(sum(weight) over (partition by id, tree), 1.0) as share from cut), soft as (select id, label, round(sum(share) / 3, 9) as p from s group by id, label)
select id, label, p from soft where p > 0.21""")
def predict_adapted(spark, sf):
    """Soft votes of weights cut at 4, of which only larger shares are kept."""
    cut = lambda votes: votes.select("id", "tree", "label", F.least("weight", F.lit(4.0)).alias("weight"))
    large = lambda shares: shares.select("id", "label", F.round("p", 9).alias("p")).where("p > 0.21")
    forest, _ = _votes(spark, sf)
    return forest.predict(forest.rows, voting.adapted(voting.soft, cut, large))


# ---------------------------------------------------------------- validation

HELD = f"{VOTES}, held as (select v.* from votes v where {h('kfold', 'id')} % 3 = tree), soft as (select id, label, greatest(weight, 0) / greatest(sum(greatest(weight, 0)) over (partition by id), 1.0) as p from held)"
ACTUAL = f"select id, label, weight from ({ORDERS})"


@query(f"""with {HELD}, d as (select a.id, a.weight, (case when l = a.label then 1 else 0 end) - coalesce(s.p, 0) as x
  from ({ACTUAL}) a, (select unnest(['F', 'O', 'P']) as l) left join soft s on s.id = a.id and s.label = l),
e as (select id, weight, sum(x * x) / greatest(count(*) filter (where x <> 0), 1) as x from d group by all)
select round(sum(x * weight) / sum(weight), 9) as brier, sum(weight)::double as weight from e""")
def validate_brier(spark, sf):
    return _votes(spark, sf)[0].validate(metrics.brier).select(F.round("brier", 9).alias("brier"), "weight")


@query(f"""with {HELD}, best as (select id, label from (select *, row_number() over (partition by id order by p desc, label) as r from soft) where r = 1)
select coalesce(sum(a.weight) filter (where a.label = b.label), 0)::double as correct, coalesce(sum(a.weight) filter (where a.label <> b.label), 0)::double as incorrect from ({ACTUAL}) a join best b using (id)""")
def validate_accuracy(spark, sf):
    return _votes(spark, sf)[0].validate(metrics.accuracy)


SCORED = "select d.doc_id as id, least(n_chars / 8000.0, 0.995) as p, toxic = 1 as positive, 1.0::double as weight from documents d join labels l using (doc_id) where toxic is not null"
BINS = f"bins as (select floor(p * 100)::bigint as bin, sum(case when positive then weight else 0 end)::double as t, sum(case when positive then 0 else weight end)::double as f from ({SCORED}) group by 1)"
CONFUSION = f"{BINS}, confusion as (select b.bin, (select sum(t) from bins x where x.bin >= b.bin)::double as tp, coalesce((select sum(f) from bins x where x.bin < b.bin), 0)::double as tn, (select sum(f) from bins x where x.bin >= b.bin)::double as fp, coalesce((select sum(t) from bins x where x.bin < b.bin), 0)::double as fn from bins b)"


def _scored(spark, sf) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id").where("toxic is not null")
    return rows.select(F.col("doc_id").alias("id"), F.least(F.col("n_chars") / 8000.0, F.lit(0.995)).alias("p"), (F.col("toxic") == 1).alias("positive"), F.lit(1.0).alias("weight"))


@query(f"with {BINS} select * from bins")
def binned_errors(spark, sf):
    return metrics.binned_errors(_scored(spark, sf)).withColumn("bin", F.col("bin").cast("long"))


@query(f"with {CONFUSION} select * from confusion")
def confusion_by_threshold(spark, sf):
    return metrics.confusion_by_threshold(metrics.binned_errors(_scored(spark, sf))).withColumn("bin", F.col("bin").cast("long"))


@query(f"""with {CONFUSION}, rates as (select bin, fp / (fp + tn) as x, tp / (tp + fn) as y from confusion),
steps as (select x - lag(x, 1, 0) over (order by bin desc) as dx, y + lag(y, 1, 0) over (order by bin desc) as sy from rates)
select round(sum(dx * sy / 2), 9) as auc from steps""")
def auc(spark, sf):
    return metrics.auc(metrics.binned_errors(_scored(spark, sf))).select(F.round("auc", 9).alias("auc"))


@query(f"""with {CONFUSION} select *, tp + fn as positives, fp + tn as negatives, round(tp / nullif(tp + fn, 0), 9) as sensitivity, round(tn / nullif(fp + tn, 0), 9) as specificity,
round(tp / nullif(tp + fp, 0), 9) as ppv, round(tn / nullif(tn + fn, 0), 9) as npv, round(fp / nullif(fp + tn, 0), 9) as fpr, round(fp / nullif(fp + tp, 0), 9) as fdr,
round(fn / nullif(fn + tp, 0), 9) as fnr, round((tp + tn) / nullif(tp + fn + fp + tn, 0), 9) as accuracy, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) as f1,
round(tp / nullif(tp + fn, 0), 9) as recall, round(tp / nullif(tp + fn, 0), 9) as tpr, round(tn / nullif(fp + tn, 0), 9) as tnr, round(tp / nullif(tp + fp, 0), 9) as precision from confusion""")
def confusion_rates(spark, sf):
    m = metrics.rates(metrics.confusion_by_threshold(metrics.binned_errors(_scored(spark, sf))))
    plain = ("bin", "tp", "tn", "fp", "fn", "positives", "negatives")
    return m.select(F.col("bin").cast("long").alias("bin"), *plain[1:], *[F.round(c, 9).alias(c) for c in metrics.RATES if c not in plain])


# ---------------------------------------------------------------- pruning and importance

_SIDE = f"select {h('kfold', 'id')} % 2 as fold, ({FIXED})::bigint as leaf, label, weight from ({ORDERS})"
#: Wrong rows of a node, when it votes for the label most frequent in training.
_WRONG = """(select coalesce(sum(h.weight), 0) from held h where h.leaf in ({0}) and h.label <> (select label from (select label, sum(weight) as w from train where leaf in ({0}) group by label) order by w desc, label limit 1))"""


@query(f"""with side as ({_SIDE}), train as (select leaf, label, sum(weight) as weight from side where fold <> 0 group by all), held as (select leaf, label, sum(weight) as weight from side where fold = 0 group by all),
e as (select {_WRONG.format('0')} as e0, {_WRONG.format('1')} as e1, {_WRONG.format('2')} as e2, {_WRONG.format('3')} as e3, {_WRONG.format('0, 1')} as e01, {_WRONG.format('2, 3')} as e23, {_WRONG.format('0, 1, 2, 3')} as e),
m as (select e0 + e1 >= e01 as left_merged, e2 + e3 >= e23 as right_merged, e01 + e23 >= e as all_merged from e)
select case when left_merged and right_merged and all_merged then 1 else 4 - left_merged::int - right_merged::int end::bigint as leaves, (left_merged and right_merged and all_merged) as whole from m""")
def prune_fixed_tree(spark, sf):
    forest = Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), KFold(2), trees={0: fixed_tree(), 1: fixed_tree()}).update_targets()

    def wrong(held: T.Target, target: T.Target) -> float:
        return metrics.accuracy_target(held, target)[1]

    pruned = forest.prune(wrong).trees[0]
    return spark.createDataFrame([(sum(1 for _ in T.leaves(pruned)), isinstance(pruned, T.Leaf))], "leaves long, whole boolean")


_PERMUTED = f"""ordered as (select *, {h('forest-group', 'id')} % 10 as g, ['o_totalprice', 'o_custkey', 'o_orderpriority'][1 + {h('forest-pick', 'id')} % 3] as feature, {h('forest', 'id')} as k from ({ORDERS})),
lagged as (select *, row_number() over w as n, lag(o_totalprice) over w as l1, lag(o_custkey) over w as l2, lag(o_orderpriority) over w as l3 from ordered window w as (partition by g order by k, id)),
changed as (select id, label, weight, feature, case when feature = 'o_totalprice' then l1 else o_totalprice end as o_totalprice, case when feature = 'o_custkey' then l2 else o_custkey end as o_custkey,
  case when feature = 'o_orderpriority' then l3 else o_orderpriority end as o_orderpriority from lagged where n > 1)"""
_CHANGED_VOTES = "votes as (select r.id, r.feature, t.tree, t.label, t.weight from (" + " union all ".join(f"select id, feature, {i} as tree, {c} as leaf from changed where {h('kfold', 'id')} % 3 = {i}" for i, c in enumerate(_LEAF_OF)) + ") r join (values " + ", ".join(f"({i}, {x.index}, '{k}', {w!r}::double)" for i, t in fixed_forest().items() for x in T.leaves(t) for k, w in x.target.items()) + ") t(tree, leaf, label, weight) using (tree, leaf))"


@query(f"""with {_PERMUTED}, {_CHANGED_VOTES}, soft as (select id, label, greatest(weight, 0) / greatest(sum(greatest(weight, 0)) over (partition by id), 1.0) as p from votes),
d as (select a.id, a.feature, a.weight, (case when l = a.label then 1 else 0 end) - coalesce(s.p, 0) as x from changed a, (select unnest(['F', 'O', 'P']) as l) left join soft s on s.id = a.id and s.label = l),
e as (select id, feature, weight, sum(x * x) / greatest(count(*) filter (where x <> 0), 1) as x from d group by all)
select feature, round(sum(x * weight) / sum(weight), 9) as brier, sum(weight)::double as weight from e group by feature""")
def feature_importance_fixed(spark, sf):
    return _votes(spark, sf)[0].feature_importance().select("feature", F.round("brier", 9).alias("brier"), "weight")


# ---------------------------------------------------------------- models and streams


@query(LEAVES)
def model_roundtrip(spark, sf):
    """Leaves by a tree that went through JSON, the compact string and compressed arrays."""
    tree = T.expand_compressed(T.compress(models.from_string(models.to_string(models.loads(models.dumps(fixed_tree()))))))
    return routing.route(orders(spark, sf), {0: tree}).select("id", F.col("leaf").cast("long").alias("leaf"))


def _older(tree: T.Tree) -> object:
    """A tree in the older format, in which a split is two branches with predicates of their own."""
    if isinstance(tree, T.Leaf):
        return {"leaf": tree.index, "distribution": tree.target}
    left = {{"isEq": "eq"}.get(tree.predicate.op, tree.predicate.op): tree.predicate.value}
    return [{"feature": tree.feature, "predicate": p, "children": _older(t)} for p, t in ((left, tree.left), ({"not": left}, tree.right))]


@query(LEAVES)
def migrate_model(spark, sf):
    """Leaves by a tree of the older format, migrated."""
    line = models.migrate_model([f"0\t{json.dumps(_older(fixed_tree()))}"])[0]
    return routing.route(orders(spark, sf), {0: models.loads(line.partition("\t")[2])}).select("id", F.col("leaf").cast("long").alias("leaf"))


_NODE = f"(['LL', 'LR', 'RL', 'RR'])[({FIXED}) + 1]"


@query(f"""select tree, node, feature, {u('rf-feature', 'tree', 'node', 'feature')} < 0.5 as included, count(*) as n
from (select unnest(range(0, 3)) as tree), (select {_NODE} as node, o_orderpriority as feature from ({ORDERS})) group by all""")
def rf_feature_subset(spark, sf):
    """Which of the features that reach a node a random forest lets it use; features are named by the rows."""
    rows = routing.route(orders(spark, sf).withColumn("tree", F.lit(0)), {0: fixed_tree()}).drop("tree")
    rows = rows.select(F.element_at(F.array(*map(F.lit, ["LL", "LR", "RL", "RR"])), F.col("leaf") + 1).alias("node"), F.col("o_orderpriority").alias("feature"))
    grid = rows.groupBy("node", "feature").agg(F.count("*").alias("n")).withColumn("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))))
    return grid.withColumn("included", RandomForest(3, 0.5).feature(F.col("tree"), F.col("node"), F.col("feature")))


@query(f"with {SOFT}, r as (select id from ({ORDERS})), l as (select unnest(['F', 'O', 'P']) as label) select r.id, " + ", ".join(f"round(coalesce(max(p) filter (where soft.label = '{k}'), 0), 9) as p_{k}" for k in "FOP") + " from r left join soft using (id) group by r.id")
def score_rows(spark, sf):
    scored = streaming.score(orders(spark, sf), fixed_forest(), ["F", "O", "P"])
    return scored.select("id", *[F.round(f"p_{k}", 9).alias(f"p_{k}") for k in "FOP"])


@query(f"select id, {u('x', 'id')} as u from ({ORDERS})")
def portable_uniform(spark, sf):
    return orders(spark, sf).select("id", uniform("x", "id").alias("u"))


# ---------------------------------------------------------------- predicates, codecs and tree algebra

_OPS = {"isEq": "=", "notEq": "<>", "lt": "<", "ltEq": "<=", "gt": ">", "gtEq": ">="}


@query(" union all ".join(f"select '{op}' as op, count(*) filter (where l_quantity {sql} 25) as holds, count(*) filter (where not (l_quantity {sql} 25)) as fails from lineitem" for op, sql in _OPS.items()))
def predicates(spark, sf):
    """The six comparisons and their opposites."""
    rows = table(spark, sf, "lineitem")
    tests = {op: T.Predicate(op, 25.0) for op in _OPS}
    sums = rows.agg(*[F.sum(p.column(F.col("l_quantity")).cast("long")).alias(f"{op}_1") for op, p in tests.items()], *[F.sum((~p).column(F.col("l_quantity")).cast("long")).alias(f"{op}_0") for op, p in tests.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(op).alias("op"), F.col(f"{op}_1").alias("holds"), F.col(f"{op}_0").alias("fails")) for op in tests])).alias("r")).select("r.*")


@query(f"select ({FIXED})::bigint as leaf, label, count(*)::bigint as weight from ({ORDERS}) group by all")
def distribution_codec(spark, sf):
    """Distributions of leaves as JSON objects and back."""
    targets = routing.leaf_targets(routing.route(orders(spark, sf), {0: fixed_tree()}))
    entries = F.collect_list(F.struct("label", F.col("weight").cast("long").alias("weight")))
    written = targets.groupBy("leaf").agg(F.to_json(F.map_from_entries(entries)).alias("json"))
    return written.select(F.col("leaf").cast("long").alias("leaf"), F.explode(F.from_json("json", "map<string,bigint>")).alias("label", "weight"))


@query(f"""with l as (select ({FIXED})::bigint as leaf, count(*)::double as w from ({ORDERS}) group by 1),
p as (select unnest(['LL', 'LR', 'RL', 'RR']) as path, unnest([0, 1, 2, 3])::bigint as leaf), a as (select path[1:k] as path, coalesce(w, 0) as w from p left join l using (leaf), (select unnest([0, 1, 2]) as k))
select path, sum(w) as annotation from a group by path""")
def annotate_fixed_tree(spark, sf):
    """Weights of leaves, bubbled up to all nodes."""
    forest = Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), trees={0: fixed_tree()}).update_targets()
    rows = [(p, float(t.annotation)) for p, t in T.with_paths(T.annotate(forest.trees[0], T.total))]
    return spark.createDataFrame(rows, "path string, annotation double")


@query(f"select ({h('kfold', 'id')} % 4)::bigint as tree, ({FIXED})::bigint as leaf, label, sum(weight)::double as weight from ({ORDERS}) group by all")
def validation_by_leaf(spark, sf):
    """Held-out targets of the leaves of all four trees."""
    rows = validation_rows(orders(spark, sf), KFold(4))
    targets = routing.leaf_targets(routing.route(rows, {i: fixed_tree() for i in range(4)}))
    return targets.select(F.col("tree").cast("long").alias("tree"), F.col("leaf").cast("long").alias("leaf"), "label", "weight")


@query(f"""select id, arg_max(leaf, w) as leaf from (select id, unnest([0, 1, 2, 3])::bigint as leaf, unnest([5.0, 9.0, 20.0, 3.0]) as w, unnest([
    coalesce(value < 200, true) and coalesce(user_id < 50, true), coalesce(value < 200, true) and coalesce(user_id >= 50, true),
    coalesce(value >= 200, true) and coalesce(value < 400, true), coalesce(value >= 200, true) and coalesce(value >= 400, true)]) as hit from ({EVENTS})) where hit group by id""")
def route_heaviest_of_all(spark, sf):
    """Among all leaves that a row may reach, the one with the largest annotation."""
    weights = F.array(*[F.lit(float(x.annotation)) for x in T.leaves(events_tree())])
    found = routing.all_leaves(events(spark, sf), events_tree()).withColumn("w", F.element_at(weights, F.col("leaf") + 1))
    return found.groupBy("id").agg(F.max_by("leaf", "w").cast("long").alias("leaf"))


# ---------------------------------------------------------------- sources and sinks


def values_sql(names: str, rows: list[tuple]) -> str:
    """SQL of a table of constants."""
    plain = lambda v: "null" if v is None else str(v).lower() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else f"{v!r}::double" if isinstance(v, float) else f"{v}::bigint"
    return f"select * from (values {', '.join('(' + ', '.join(map(plain, r)) + ')' for r in rows)}) t({names})"


def _lines(spark, sf) -> str:
    """Labelled text made of the orders: key, customer, status."""
    path = scratch(spark, "lines")
    table(spark, sf, "orders").select(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus").alias("value")).write.text(path)
    return path


@query("select concat_ws(',', o_orderkey, o_custkey, o_orderstatus) as id, 0::bigint as ts, o_orderstatus as label, 1.0::double as weight, o_orderkey::double as k, o_custkey::double as c from orders")
def labelled_text(spark, sf):
    """Instances from delimited lines whose last field is the label."""
    return instances.from_csv(spark, _lines(spark, sf), ["k", "c"])


@query("select count(*) as lines, count(distinct o_custkey) as customers, sum(o_orderkey)::double as keys from orders")
def lines_read_twice(spark, sf):
    """A file of lines read in two passes."""
    path = _lines(spark, sf)
    lines = spark.read.text(path).agg(F.count("*").alias("lines"))
    rows = instances.from_csv(spark, path, ["k", "c"]).agg(F.countDistinct("c").alias("customers"), F.sum("k").alias("keys"))
    return lines.join(rows)


_ROWS = [("a", 5, "x", 2.0, 1.5), ("b", 0, "y", 1.0, None), ("c", -3, "x", 0.5, 0.0)]


@query(f"with m as ({values_sql('id, ts, label, weight, f', _ROWS)}) select id, label, weight, f, r.n_name from m join nation r on r.n_nationkey = abs(m.ts)")
def in_memory_rows(spark, sf):
    """Rows from memory, joined to a table."""
    rows = instances.in_memory(spark, _ROWS, "id string, ts long, label string, weight double, f double")
    return rows.join(table(spark, sf, "nation"), F.abs("ts") == F.col("n_nationkey")).select("id", "label", "weight", "f", "n_name")


@query(f"select id, label, 1.0::double as weight, o_totalprice as price, null::double as absent from ({ORDERS})")
def instances_of_maps(spark, sf):
    """Instances from maps of features and of targets."""
    rows = orders(spark, sf).select("id", "ts", F.create_map(F.lit("price"), "o_totalprice").alias("features"), F.create_map("label", F.lit(1).cast("long")).alias("target"))
    return instances.from_maps(rows, ["price", "absent"]).select("id", "label", "weight", "price", "absent")


@query(f"select label, label = '1-URGENT' as parsed, case when label = '1-URGENT' then 'true' else 'false' end as written, count(*) as n from (select o_orderpriority as label from orders) group by all")
def boolean_labels(spark, sf):
    """Booleans as exactly 'true' or 'false', and back."""
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("label"), (F.col("o_orderpriority") == "1-URGENT").alias("b"))
    rows = rows.select("label", instances.boolean_label("b").alias("written")).withColumn("parsed", instances.parse_boolean("written"))
    return rows.groupBy("label", "parsed", "written").agg(F.count("*").alias("n"))


def _targets(spark, forest: Forest) -> DataFrame:
    rows = [(i, x.index, k, w) for i, t in forest.trees.items() for x in T.leaves(t) for k, w in sorted(x.target.items())]
    return spark.createDataFrame(rows, "tree long, leaf long, label string, weight double")


_FOLDED = f"select tree::bigint as tree, ({FIXED})::bigint as leaf, label, sum(weight)::double as weight from ({FOLDS.replace('range(0, 4)', 'range(0, 2)').replace('% 4', '% 2')}) group by all"


def _two_fixed(spark, sf) -> Forest:
    return Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), KFold(2), trees={0: fixed_tree(), 1: fixed_tree()})


@query(_FOLDED)
def model_written_through(spark, sf):
    """Targets, written as text and read before they are used."""
    return _targets(spark, _two_fixed(spark, sf).update_targets(scratch(spark, "model")))


@query(_FOLDED)
def model_of_nodes(spark, sf):
    """Targets, saved as a table of nodes and loaded into a new forest."""
    path = scratch(spark, "nodes")
    forest = _two_fixed(spark, sf).update_targets().save(path, "parquet")
    return _targets(spark, Forest(forest.rows, forest.features, forest.sampler).load(path, "parquet"))


@query(_FOLDED)
def model_in_steps(spark, sf):
    """Targets from the first numbered step of a run."""
    base = scratch(spark, "run")
    forest = _two_fixed(spark, sf)
    forest.update_targets(models.step(base, 0))
    return _targets(spark, forest.load(f"{base}/step_00"))


@query(_FOLDED)
def model_as_strings(spark, sf):
    """Targets of trees that went through compact strings and through JSON."""
    trees = {i: models.loads(models.dumps(models.from_string(models.to_string(t)))) for i, t in _two_fixed(spark, sf).update_targets().trees.items()}
    return _targets(spark, Forest(orders(spark, sf), (PRICE,), KFold(2), trees=trees))


@query(_FOLDED)
def rows_kept_on_disk(spark, sf):
    """Targets of rows that were persisted."""
    forest = _two_fixed(spark, sf).persisted()
    try:
        return _targets(spark, forest.update_targets())
    finally:
        forest.rows.unpersist()


@query(f"select label, sum(weight)::double as weight, count(*) as rows from ({ORDERS}) group by label")
def combinators(spark, sf):
    """Other trees and another sampler by functions of what the forest holds, and a side effect in between."""
    seen: list[int] = []
    forest = _two_fixed(spark, sf).flat_map_sampler(lambda rows, sampler, trees: SingleTree())
    forest = forest.flat_map_trees(lambda rows, sampler, trees: {0: T.singleton()}).tee(lambda f: seen.append(len(f.trees))).update_targets()
    assert seen == [1]
    return _targets(spark, forest).select("label", "weight", F.col("weight").cast("long").alias("rows"))


@query(f"""with {HELD}, best as (select id, label from (select *, row_number() over (partition by id order by p desc, label) as r from soft) where r = 1)
select 'correct' as what, coalesce(sum(a.weight) filter (where a.label = b.label), 0)::double as weight from ({ACTUAL}) a join best b using (id)
union all select 'incorrect', coalesce(sum(a.weight) filter (where a.label <> b.label), 0)::double from ({ACTUAL}) a join best b using (id)""")
def metrics_written(spark, sf):
    """An error as tab-separated text, read again."""
    path = scratch(spark, "metrics")
    instances.write_metrics(_votes(spark, sf)[0].validate(metrics.accuracy), path)
    found = spark.read.option("sep", "\t").schema("correct double, incorrect double").csv(path)
    return found.select(F.explode(F.array(*[F.struct(F.lit(c).alias("what"), F.col(c).alias("weight")) for c in found.columns])).alias("r")).select("r.*")


@query(f"""with t as (select unnest(range(0, 80))::bigint as tree), r as (select (ts // {DAY}) % 40 as phase, {h('kfold', 'id')} % 2 as fold, weight from ({EVENTS}))
select t.tree, coalesce(sum(r.weight), 0)::double as weight from t left join r on r.phase = t.tree % 40 and r.fold <> t.tree // 40 group by t.tree""")
def every_tree_stays(spark, sf):
    """A row for each tree, with or without rows that train it."""
    forest = Forest(events(spark, sf), (Feature("value", "continuous"),), TimeGrouped(KFold(2), DAY, 40)).update_targets()
    return spark.createDataFrame([(i, float(T.total(T.target_of(t)))) for i, t in forest.trees.items()], "tree long, weight double")


_KINDS = {"o_orderkey": "ordinal", "o_custkey": "ordinal", "o_orderstatus": "nominal", "o_totalprice": "continuous", "o_orderpriority": "nominal"}


@query(" union all ".join(f"select '{c}' as name, '{k}' as kind, count({c}) as present, count(distinct {c}) as cells from orders" for c, k in _KINDS.items()))
def default_kinds(spark, sf):
    """Kinds of features by the types of columns, and what each has: present values, and distinct ones."""
    rows = table(spark, sf, "orders")
    found = splitters.infer_features(rows)
    raw = [Feature(f.name, f.kind, (lambda c: c) if f.kind == "continuous" else None) for f in found]  # unbinned
    cells = splitters.long_form(rows, raw, []).groupBy("feature", "num", "str").agg(F.count("*").alias("n"))
    cells = cells.groupBy(F.col("feature").alias("name")).agg(F.sum("n").alias("present"), F.count("*").alias("cells"))
    return spark.createDataFrame([(f.name, f.kind) for f in found], "name string, kind string").join(cells, "name")


# ---------------------------------------------------------------- codecs and tree algebra, applied to rows


@query("""select o_orderpriority as label, 'x === ' || o_orderpriority as predicate, '["nominal", "' || o_orderpriority || '"]' as tagged, '["ordinal", ' || count(*) || ']' as number,
  count(*) as n, o_orderpriority = '1-URGENT' as urgent, 'error: continuous needs a number' as refused from orders group by o_orderpriority""")
def codecs(spark, sf):
    """Predicates, tagged values, options and booleans of what a table holds, written as JSON and read again."""
    rows = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n")).collect()
    again = lambda v: json.loads(json.dumps(v))
    out = []
    for label, n in rows:
        predicate = models.decode_predicate(again(models.encode_predicate(T.Predicate("isEq", label))))
        tagged, number = (json.dumps(models.decode_tagged(again(v))) for v in ({"nominal": label}, {"ordinal": n}))
        try:
            refused = json.dumps(models.decode_tagged({"continuous": label}))
        except models.ModelError as e:
            refused = f"error: {e}"
        urgent = models.decode_boolean("true" if label == "1-URGENT" else "false")
        out.append((label, str(predicate), tagged, number, models.decode_option(again([n])), urgent, refused))
    return spark.createDataFrame(out, "label string, predicate string, tagged string, number string, n long, urgent boolean, refused string")


_LEAF_TARGETS = f"select ({FIXED})::bigint as leaf, label, sum(weight)::double as weight from ({ORDERS}) group by all"


def _fixed_targets(spark, sf) -> T.Tree:
    return Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), trees={0: fixed_tree()}).update_targets().trees[0]


@query(_LEAF_TARGETS)
def compressed_tree(spark, sf):
    """Targets of a tree as arrays in breadth-first order, after a round trip."""
    tree = T.expand_compressed(T.compress(_fixed_targets(spark, sf)))
    return spark.createDataFrame([(x.index, k, w) for x in T.leaves(tree) for k, w in x.target.items()], "leaf long, label string, weight double")


@query(f"""select leaf, '{{"leaf":' || leaf || ',"distribution":{{' || string_agg('"' || label || '":' || cast(weight as bigint) || '.0', ',' order by label) || '}},"annotation":' || cast(sum(weight) as bigint) || '.0}}' as json
from ({_LEAF_TARGETS}) group by leaf""")
def tree_json(spark, sf):
    """Leaves with targets and annotations as JSON, after a round trip."""
    tree = T.map_leaves(T.annotate(_fixed_targets(spark, sf), T.total), lambda x: T.Leaf(x.index, dict(sorted(x.target.items())), x.annotation))
    again = models.loads(models.dumps(models.loads(models.dumps(tree))))
    return spark.createDataFrame([(x.index, models.dumps(x)) for x in T.leaves(again) if x.target], "leaf long, json string")


_SQL_OPS = {"lt": "<", "isEq": "=", "gt": ">", "ltEq": "<=", "gtEq": ">=", "notEq": "<>"}
_FULL = [{"<", ">="}, {">", "<="}, {"=", "<>"}, {"<=", ">="}, {"<=", "<>"}, {">=", "<>"}]


@query(" union all ".join(
    f"select '{p}|{q}' as name, " + ("-1::bigint" if {a, b} in _FULL else f"count(*) filter (where o_custkey {a} 700 or o_custkey {b} 700)") + " as n, count(*) as total from orders"
    for p, a in _SQL_OPS.items() for q, b in _SQL_OPS.items()))
def migrated_models(spark, sf):
    """Splits of the older format by the union of any two comparisons: how many orders go left, or -1 where no predicate is that union."""
    rows, split = table(spark, sf, "orders"), {}
    for p in _SQL_OPS:
        for q in _SQL_OPS:
            left = {"or": [{p: 700}, {q: 700}]}
            old = [{"feature": "o_custkey", "predicate": left, "children": {"leaf": 0, "distribution": {}}}, {"feature": "o_custkey", "predicate": {"not": left}, "children": {"leaf": 1, "distribution": {}}}]
            try:
                split[f"{p}|{q}"] = models.loads(models.migrate_model([f"0\t{json.dumps(old)}"])[0].partition("\t")[2])
            except models.ModelError:
                split[f"{p}|{q}"] = None
    source = Columns(rows)
    counts = [(F.sum((routing.leaf_case(t, source) == 0).cast("long")) if t else F.lit(-1).cast("long")).alias(f"n{k}") for k, t in enumerate(split.values())]
    names = F.array(*[F.struct(F.lit(c).alias("name"), F.col(f"n{k}").alias("n")) for k, c in enumerate(split)])
    return rows.agg(F.count("*").alias("total"), *counts).select("total", F.explode(names).alias("x")).select("x.*", "total")


@query(LEAVES)
def route_mapped_tree(spark, sf):
    """Features renamed and constants doubled, on rows that are renamed and doubled alike."""
    rows = orders(spark, sf).select("id", *[(F.col(c) * 2).alias(f"{c}_2") for c in ("o_totalprice", "o_custkey")], F.col("o_orderpriority").alias("o_orderpriority_2"))
    tree = T.map_predicates(T.map_features(fixed_tree(), lambda f: f"{f}_2"), lambda v: v if isinstance(v, str) else 2 * v)
    return routing.route(rows, {0: tree}).select("id", F.col("leaf").cast("long").alias("leaf"))


@query(f"""select id, case leaf when 0 then 0 when 1 then case when o_custkey < 300 then 1 else 2 end when 2 then 3 else 4 end::bigint as leaf
from (select *, ({FIXED}) as leaf from ({ORDERS}))""")
def route_grafted_tree(spark, sf):
    """One leaf replaced by a tree; leaves renumbered from left to right."""
    more = T.Node("o_custkey", T.Predicate("lt", 300.0), T.Leaf(0), T.Leaf(1))
    tree = T.update_leaves(fixed_tree(), lambda k: more if k == 1 else None)
    return routing.route(orders(spark, sf), {0: tree}).select("id", F.col("leaf").cast("long").alias("leaf"))


@query(f"""with l as (select ({FIXED})::bigint as leaf, count(*)::double as w from ({ORDERS}) group by 1)
select 4::bigint as leaves, 2::bigint as depth, (select sum(w) from l) as weight, (select sum(w) from l where leaf < 2) * 2 as left_twice, (select w from l where leaf = 2) as third, 'o_totalprice < 250000.0' as says""")
def tree_algebra(spark, sf):
    """Folds, mapped annotations, a leaf by its index, and the display of a predicate, on a tree with targets."""
    tree = T.annotate(Forest(orders(spark, sf), (PRICE, CUSTOMER, PRIORITY), trees={0: fixed_tree()}).update_targets().trees[0], T.total)
    twice = T.map_annotation(tree, lambda a: 2 * a)
    row = (T.fold(tree, lambda x: 1, lambda n, a, b: a + b), T.depth(tree), float(tree.annotation), float(twice.left.annotation), float(T.total(T.leaf_at(tree, 2).target)), tree.predicate.display(tree.feature))
    return spark.createDataFrame([row], "leaves long, depth long, weight double, left_twice double, third double, says string")


@query(f"""with {SOFT}, moved as (select id, case label when 'F' then 'closed' else 'open' end as label, sum(p) as p from soft group by all)
select id, round(max(p) filter (where label = 'closed'), 9) as closed from moved group by id""")
def predict_mapped(spark, sf):
    """Votes for labels that are mapped before the vote, and shares that are mapped after it."""
    votes = _votes(spark, sf)[1].withColumn("label", F.when(F.col("label") == "F", "closed").otherwise("open"))
    shares = voting.soft(votes).groupBy("id").agg(F.max(F.when(F.col("label") == "closed", F.col("p"))).alias("p"))
    return shares.select("id", F.round("p", 9).alias("closed"))


@query(f"with {SOFT}, r as (select id from ({ORDERS})), l as (select unnest(['F', 'O', 'P']) as label) select r.id, " + ", ".join(f"round(coalesce(max(p) filter (where soft.label = '{k}'), 0), 9) as p_{k}" for k in "FOP") + " from r left join soft using (id) group by r.id")
def score_by_node_table(spark, sf):
    """Scores of the same trees, walked as compressed arrays as large ones are."""
    scored = streaming.score(orders(spark, sf), fixed_forest(), ["F", "O", "P"], case_nodes=0)
    return scored.select("id", *[F.round(f"p_{k}", 9).alias(f"p_{k}") for k in "FOP"])
