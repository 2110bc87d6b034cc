"""Sufficient statistics and the candidate splits made from them.

Statistics are rows (keys..., feature, num or str, label, w): weights summed by value and label, with partial aggregation
before the only shuffle; rows without a label are in none.  Candidates are rows (keys..., feature, op, num, str, label, lw, rw): what of each label goes left
and right.  `keys` are usually tree and leaf.  Rows whose feature is missing are in no statistics.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import down_rez, dyadic, hash32
from .features import OpenMap, name

RANKS = 500  # values of a digest that tell the rank of a cut
KINDS = ("ordinal", "nominal", "continuous", "sparse")


@dataclass(frozen=True)
class Feature:
    """A feature: its column and kind.

    ordinal: numbers with few values, split by <; continuous: numbers, binned, split by <; nominal: few values, split by
    equality; sparse: many values, split by equality with the most frequent ones.
    """

    name: str
    kind: str
    bin: Callable[[Column], Column] | None = None
    column: str | None = None  # where it isn't the name

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"kind is one of {KINDS}")

    @property
    def numeric(self) -> bool:
        return self.kind in ("ordinal", "continuous")

    def raw(self) -> Column:
        v = F.col(name(self.column or self.name))
        return F.nanvl(v.cast("double"), F.lit(None).cast("double")) if self.numeric else v.cast("string")

    def value(self) -> Column:
        v = self.raw()
        if not self.numeric:
            return v
        if self.bin:
            return self.bin(v).cast("double")
        return down_rez(v) if self.kind == "continuous" else v


@dataclass(frozen=True)
class MapFeatures:
    """All features of a map column, whatever their names: each value's kind is its tag, or one for all values.

    Values are numbers, texts, or structs (kind, num, str).  A feature whose values have several kinds is an error, when
    statistics are made.
    """

    column: str = "features"
    kind: str | None = None

    def long(self, rows: DataFrame, keep: list[str], raw: bool = False) -> DataFrame:
        source = OpenMap(rows, self.column)
        value = F.col("__v")
        num, text = source.of(value)
        if source.tagged:
            known = value["kind"].isin(*KINDS)
            kind = F.when(known, value["kind"]).otherwise(F.raise_error(F.concat(F.lit("no kind of value: "), F.coalesce(value["kind"], F.lit("null")))))
        else:
            name_of = source.value.typeName()
            kind = F.lit(self.kind or {"double": "continuous", "float": "continuous", "string": "nominal", "boolean": "nominal"}.get(name_of, "ordinal"))
        out = rows.select(*keep, F.explode(F.col(name(self.column))).alias("feature", "__v")).where("__v is not null")
        out = out.select(*keep, "feature", kind.alias("kind"), num.alias("num"), text.alias("str"))
        whole = F.col("num") if raw else F.when(F.col("kind") == "continuous", down_rez("num")).otherwise(F.col("num"))
        numeric = F.col("kind").isin("ordinal", "continuous")
        out = out.withColumns({"num": F.when(numeric, whole), "str": F.when(~numeric, F.col("str"))})
        return out.where("num is not null or str is not null")


def one_kind(stats: DataFrame) -> DataFrame:
    """Statistics with the one kind of each feature; an error if it has several."""
    kinds = stats.groupBy("feature").agg(F.min("kind").alias("__lo"), F.max("kind").alias("__hi"))
    wrong = F.raise_error(F.concat(F.lit("values of several kinds in one feature: "), F.col("feature")))
    kinds = kinds.select("feature", F.when(F.col("__lo") == F.col("__hi"), F.col("__lo")).otherwise(wrong).alias("kind"))
    return stats.drop("kind").join(kinds, "feature")


def infer_features(df: DataFrame, skip: list[str] = ()) -> list[Feature]:
    """Default kinds by type: integers ordinal, doubles continuous, strings and booleans nominal."""
    kinds = {"double": "continuous", "float": "continuous", "string": "nominal", "boolean": "nominal"}
    whole = ("int", "bigint", "smallint", "tinyint")
    return [
        Feature(c, kinds.get(t, "ordinal"))
        for c, t in df.dtypes
        if c not in skip and (t in kinds or t in whole or t.startswith("decimal"))
    ]


def long_form(rows: DataFrame, features: list[Feature] | MapFeatures, keep: list[str], raw: bool = False) -> DataFrame:
    """keep..., feature, num, str: one row for each present feature of each row; of a map also the kind.

    raw: without binning.  Values are exploded first and binned after, by one expression for all continuous features.
    """
    if isinstance(features, MapFeatures):
        return features.long(rows, keep, raw)
    none = {True: F.lit(None).cast("string"), False: F.lit(None).cast("double")}
    structs = [
        F.struct(
            F.lit(f.name).alias("feature"),
            ((f.value() if f.bin and not raw else f.raw()) if f.numeric else none[False]).alias("num"),
            (none[True] if f.numeric else f.raw()).alias("str"),
            F.lit(f.kind == "continuous" and not f.bin and not raw).alias("__rough"),
        )
        for f in features
    ]
    out = rows.select(*keep, F.explode(F.array(*structs)).alias("__f")).select(*keep, "__f.*")
    out = out.where("num is not null or str is not null")
    if any(f.kind == "continuous" and not f.bin for f in features) and not raw:
        out = out.withColumn("num", F.when(F.col("__rough"), down_rez("num")).otherwise(F.col("num")))
    return out.drop("__rough")


def statistics(rows: DataFrame, features: list[Feature] | MapFeatures, keys: list[str], label: str = "label", weight: str = "weight") -> DataFrame:
    """Weights by keys, feature (of a map: and kind), value and label."""
    long = long_form(rows.where(F.col(label).isNotNull()), features, [*keys, label, weight])
    kind = ["kind"] if isinstance(features, MapFeatures) else []
    return long.groupBy(*keys, "feature", *kind, "num", "str", F.col(label).alias("label")).agg(F.sum(weight).alias("w"))


def binned(stats: DataFrame, keys: list[str], fn: Callable[[Column], Column]) -> DataFrame:
    """Statistics of coarser values: fn of each number, summed again."""
    return stats.withColumn("num", fn(F.col("num"))).groupBy(*keys, "feature", "num", "str", "label").agg(F.sum("w").alias("w"))


def _sided(stats: DataFrame, keys: list[str], op: str) -> DataFrame:
    """Candidates from statistics in which every label has a row at every value."""
    own = [*keys, "feature", "label"]
    if op == "lt":
        before = Window.partitionBy(*own).orderBy("num").rowsBetween(Window.unboundedPreceding, -1)
        left = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    else:
        left = F.col("w")
    total = F.sum("w").over(Window.partitionBy(*own))
    out = stats.withColumn("lw", left.cast("double")).withColumn("rw", (total - left).cast("double"))
    return out.select(*keys, "feature", F.lit({"lt": "lt", "isEq": "isEq"}[op]).alias("op"), "num", "str", "label", "lw", "rw")


def dense(stats: DataFrame, keys: list[str]) -> DataFrame:
    """A row for every label at every value of a feature, 0 where there was none."""
    at = [*keys, "feature"]
    values = stats.groupBy(*at, "num", "str").agg(F.map_from_entries(F.collect_list(F.struct("label", "w"))).alias("__w"))
    labels = stats.groupBy(*at).agg(F.sort_array(F.collect_set("label")).alias("__labels"))
    grid = values.join(labels, at).select(*at, "num", "str", "__w", F.explode("__labels").alias("label"))
    return grid.select(*at, "num", "str", "label", F.coalesce(F.try_element_at("__w", F.col("label")), F.lit(0.0)).alias("w"))


def same_rows(left: DataFrame, right: DataFrame, names: list[str]) -> DataFrame:
    """The rows of left that agree with a row of right in all names; nulls agree."""
    test = F.lit(True)
    for c in names:
        test = test & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return left.alias("l").join(right.select(*names).alias("r"), test, "left_semi")


def binary(stats: DataFrame, keys: list[str]) -> DataFrame:
    """One candidate per distinct value: numbers split by <, strings by equality.  Sorted running sums, n log n."""
    grid = dense(stats, keys)
    return _sided(grid.where("num is not null"), keys, "lt").unionByName(_sided(grid.where("str is not null"), keys, "isEq"))


def heavy_hitters(stats: DataFrame, parents: DataFrame, keys: list[str], capacity: int = 1000) -> DataFrame:
    """Equality with each of the `capacity` most frequent values of each label; the rest of the node goes right.

    parents: (keys..., label, weight), the targets of the nodes.  Rows without the feature are on the right.
    """
    order = Window.partitionBy(*keys, "feature", "label").orderBy(F.desc("w"), "str")
    kept = stats.where("str is not null").withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= capacity)
    values = kept.select(*keys, "feature", "str").distinct()
    grid = values.join(parents.select(*keys, "label", F.col("weight").alias("__all")), keys)
    own = stats.where("str is not null").select(*keys, "feature", "str", "label", "w")
    out = grid.join(own, [*keys, "feature", "str", "label"], "left").withColumn("lw", F.coalesce("w", F.lit(0.0)).cast("double"))
    rest = (F.col("__all") - F.col("lw")).cast("double")
    return out.select(*keys, "feature", F.lit("isEq").alias("op"), F.lit(None).cast("double").alias("num"), "str", "label", "lw", rest.alias("rw"))


def approximate_heavy_hitters(rows: DataFrame, feature: str, keys: list[str], capacity: int = 1000) -> DataFrame:
    """(keys..., feature, str, n): the most frequent values by a sketch of bounded size."""
    top = rows.groupBy(*keys).agg(F.expr(f"approx_top_k(cast({feature} as string), {capacity}, {10 * capacity})").alias("__top"))
    out = top.select(*keys, F.explode("__top").alias("__t"))
    return out.select(*keys, F.lit(feature).alias("feature"), F.col("__t.item").alias("str"), F.col("__t.count").alias("n"))


def _binned_cuts(stats: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """Exact candidates `num < cut` for given cut points (keys..., feature, cuts: array).

    A value is in the bucket numbered by the cuts that it isn't below; weights are summed by bucket, of which there are
    as many as cuts, and a cut's left side is the sum of the buckets before it.
    """
    at = [*keys, "feature"]
    cuts = cuts.withColumn("cuts", F.array_sort(F.array_distinct("cuts")))
    bucket = F.size(F.filter("cuts", lambda c: c <= F.col("num")))
    summed = stats.join(cuts, at).groupBy(*at, "label", bucket.alias("__b")).agg(F.sum("w").alias("w"))
    sides = summed.join(cuts.select(*at, F.posexplode("cuts").alias("__i", "num")), at)
    left = F.sum(F.when(F.col("__b") <= F.col("__i"), F.col("w")).otherwise(0.0))
    right = F.sum(F.when(F.col("__b") <= F.col("__i"), 0.0).otherwise(F.col("w")))
    out = sides.groupBy(*at, "num", "label").agg(left.cast("double").alias("lw"), right.cast("double").alias("rw"))
    return out.select(*at, F.lit("lt").alias("op"), "num", F.lit(None).cast("string").alias("str"), "label", "lw", "rw")


def _raw_numbers(rows: DataFrame, features: list[Feature] | MapFeatures, keep: list[str]) -> DataFrame:
    """Unbinned values of numeric features; of a map, of the continuous ones."""
    if isinstance(features, MapFeatures):
        return long_form(rows, features, keep, raw=True).where("kind = 'continuous'").drop("kind")
    return long_form(rows, [f for f in features if f.numeric], keep, raw=True)


def raw_statistics(rows: DataFrame, features: list[Feature] | MapFeatures, keys: list[str], label: str = "label", weight: str = "weight") -> DataFrame:
    """statistics() of the unbinned values of numeric features; of a map, of the continuous ones."""
    long = _raw_numbers(rows.where(F.col(label).isNotNull()), features, [*keys, label, weight])
    return long.groupBy(*keys, "feature", "num", "str", F.col(label).alias("label")).agg(F.sum(weight).alias("w"))


def quantiles(rows: DataFrame, features: list[Feature] | MapFeatures, keys: list[str], k: int = 25, accuracy: int = 10_000, label: str = "label", weight: str = "weight", exact: bool = False) -> DataFrame:
    """Candidates at the quantiles i/k of each numeric feature, with exact sides."""
    long = _raw_numbers(rows.where(F.col(label).isNotNull()), features, [*keys, label, weight])
    points = [i / k for i in range(1, k)]
    if exact:
        array = F.array(*[F.expr(f"percentile_disc({p}) within group (order by num)") for p in points])
    else:
        array = F.percentile_approx("num", F.lit([float(p) for p in points]), F.lit(accuracy))
    cuts = long.groupBy(*keys, "feature").agg(array.alias("cuts"))
    stats = long.groupBy(*keys, "feature", "num", F.col(label).alias("label")).agg(F.sum(weight).alias("w"))
    return _binned_cuts(stats, cuts, keys)


def quantile_digests(rows: DataFrame, features: list[Feature] | MapFeatures, keys: list[str], k: int = 25, size: int = 400, label: str = "label", weight: str = "weight") -> DataFrame:
    """Candidates `num <= cut` at about the quantiles i/k of each numeric feature, sides and all from mergeable digests.

    One KLL digest for each label, and for each weight, of which there should be few (as numbers of copies are): only
    digests are shuffled, never values.  The digests of a feature are merged for the cuts, and a cut's left side is its rank
    in each label's.  With size 400 a rank is off by about 0.7 % of the rows, with 1,000 by 0.3 %, and by 0.1 % for RANKS.
    """
    at = [*keys, "feature"]
    long = _raw_numbers(rows.where(F.col(label).isNotNull()), features, [*keys, label, weight])
    own = long.groupBy(*at, F.col(label).alias("label"), F.col(weight).alias("__weight")).agg(F.kll_sketch_agg_double("num", F.lit(size)).alias("__digest"), F.count("*").alias("__n"))
    cuts = own.groupBy(*at).agg(F.kll_merge_agg_double("__digest", F.lit(size)).alias("__all"))
    points = F.array(*[F.lit(i / k) for i in range(1, k)])
    cuts = cuts.select(*at, F.array_distinct(F.kll_sketch_get_quantile_double("__all", points)).alias("__cuts"))
    # A cut's rank is the share of a digest's evenly ranked values that it isn't below.
    even = F.array(*[F.lit((i + 0.5) / RANKS) for i in range(RANKS)])
    own = own.withColumn("__even", F.kll_sketch_get_quantile_double("__digest", even))
    sides = own.join(cuts, at).select(*at, "label", "__even", (F.col("__n") * F.col("__weight")).alias("__w"), F.explode("__cuts").alias("num"))
    left = F.sum(F.size(F.filter("__even", lambda v: v <= F.col("num"))) / RANKS * F.col("__w"))
    out = sides.groupBy(*at, "num", "label").agg(left.cast("double").alias("lw"), (F.sum("__w") - left).cast("double").alias("rw"))
    return out.select(*at, F.lit("ltEq").alias("op"), "num", F.lit(None).cast("string").alias("str"), "label", "lw", "rw")


def heavy_hitter_sketches(rows: DataFrame, features: list[Feature] | MapFeatures, parents: DataFrame, keys: list[str], capacity: int = 1000, tracked: int = 10_000, label: str = "label", weight: str = "weight") -> DataFrame:
    """heavy_hitters() whose frequent values mergeable sketches propose, of `tracked` items for each label, and for each weight,
    of which there should be few: values that can't be frequent are not shuffled.

    What the sketches report is counted exactly, in a second pass.  A value that none reports is no more frequent than the
    last one of a full report, nor than all that isn't reported together.  Where that doesn't rule out that it belongs to the
    `capacity` first of a label, as where a feature has far more values than `tracked`, the feature's values are all counted.
    """
    at = [*keys, "feature"]
    long = long_form(rows.where(F.col(label).isNotNull()), features, [*keys, label, weight])
    if isinstance(features, MapFeatures):
        long = long.where("kind = 'sparse'")
    long = long.where("str is not null").select(*at, "str", F.col(label).alias("label"), F.col(weight).alias("__weight"))
    most = min(2 * capacity + 100, tracked)
    top = long.groupBy(*at, "label", "__weight").agg(F.expr(f"approx_top_k(str, {most}, {tracked})").alias("__top"))
    reported = top.select(*at, F.explode("__top.item").alias("str")).distinct().withColumn("__reported", F.lit(True))
    full = F.when(F.size("__top") == most, F.array_min("__top.count") * F.col("__weight"))  # null: no bound
    last = top.groupBy(*at, "label").agg(F.when(F.count(full) == F.count("*"), F.sum(full)).alias("__last"), F.min("__weight").alias("__light"))
    counted = long.join(F.broadcast(reported), [*at, "str"], "left").groupBy(*at, F.when(F.col("__reported"), F.col("str")).alias("str"), "label")
    counted = counted.agg(F.sum("__weight").alias("w"))
    ranked = counted.withColumn("__r", F.row_number().over(Window.partitionBy(*at, "label", F.col("str").isNull()).orderBy(F.desc("w"))))
    own = ranked.groupBy(*at, "label").agg(
        F.max(F.when(F.col("str").isNotNull() & (F.col("__r") == capacity), F.col("w"))).alias("__least"), F.coalesce(F.sum(F.when(F.col("str").isNull(), F.col("w"))), F.lit(0.0)).alias("__rest")
    )
    most_of_others = F.least("__last", "__rest")
    sure = (F.col("__light") >= 0) & ((F.col("__rest") == 0) | F.coalesce(F.col("__least") > most_of_others, F.lit(False)))
    unsure = own.join(last, [*at, "label"]).where(~sure).select(*at).distinct()
    whole = long.join(F.broadcast(unsure), at, "left_semi").groupBy(*at, "str", "label").agg(F.sum("__weight").alias("w"))
    found = counted.where("str is not null").join(F.broadcast(unsure), at, "left_anti").unionByName(whole)
    return heavy_hitters(found.withColumn("num", F.lit(None).cast("double")), parents, keys, capacity)


def dyadic_tree(stats: DataFrame, keys: list[str], compression: int = 6, finest: int = 0, levels: int = 40) -> DataFrame:
    """(keys..., feature, level, at, w, total, left, right): the nodes of each feature's tree of dyadic intervals that hold
    more than a share 2**-compression of its weight, with the weights of their two halves.

    Node `at` of a level is the interval [at, at + 1) * 2**level; values are told apart down to 2**finest.  All levels are
    summed at once from the values' sums.
    """
    own = [*keys, "feature"]
    width = float(2.0**finest)
    base = stats.where("num is not null").groupBy(*own, F.floor(F.col("num") / width).cast("long").alias("__v")).agg(F.sum("w").alias("w"))
    # Each sum counts in its interval of every level; equal ones are summed before the shuffle.
    level = F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("__l")
    rows = base.select(*own, "__v", "w", level)
    half = F.expr("cast(floor(__v / pow(2.0D, __l)) as long)")
    nodes = rows.groupBy(*own, "__l", half.alias("at")).agg(F.sum("w").alias("w"))
    child = nodes.select(*own, (F.col("__l") + 1).alias("__l"), F.expr("cast(floor(at / 2) as long)").alias("__up"), F.expr("at - 2 * floor(at / 2)").alias("__side"), F.col("w").alias("__w"))
    halves = child.groupBy(*own, "__l", F.col("__up").alias("at")).agg(
        F.sum(F.when(F.col("__side") == 0, F.col("__w")).otherwise(0.0)).alias("left"), F.sum(F.when(F.col("__side") == 1, F.col("__w")).otherwise(0.0)).alias("right")
    )
    total = base.groupBy(*own).agg(F.sum("w").alias("total"))
    kept = nodes.join(total, own).where(F.col("w") > F.col("total") * 2.0**-compression)
    out = kept.join(halves, [*own, "__l", "at"], "left")
    return out.select(*own, (F.col("__l") + finest).alias("level"), "at", "w", "total", F.coalesce("left", F.lit(0.0)).alias("left"), F.coalesce("right", F.lit(0.0)).alias("right"))


def adaptive_dyadic_cuts(stats: DataFrame, keys: list[str], compression: int = 6, finest: int = 0, levels: int = 40) -> DataFrame:
    """Candidates in the middle of each kept node of the dyadic tree both of whose halves hold values, with exact sides."""
    nodes = dyadic_tree(stats, keys, compression, finest, levels).where("left > 0 and right > 0")
    middle = ((F.col("at") + 0.5) * F.pow(F.lit(2.0), F.col("level"))).cast("double")
    cuts = nodes.groupBy(*keys, "feature").agg(F.collect_set(middle).alias("cuts"))
    return _binned_cuts(stats.where("num is not null"), cuts, keys)


def dyadic_quantiles(stats: DataFrame, keys: list[str], q: float, compression: int = 6, finest: int = 0, levels: int = 40) -> DataFrame:
    """(keys..., feature, lower, upper): bounds of a quantile from the compressed tree.

    The ends of its kept nodes are all that the tree knows: the quantile lies between the last one with less than a share q
    below it and the first one with q or more.
    """
    own = [*keys, "feature"]
    nodes = dyadic_tree(stats, keys, compression, finest, levels)
    size = F.pow(F.lit(2.0), F.col("level"))
    nodes = nodes.select(*own, "total", (F.col("at") * size).cast("double").alias("lo"), ((F.col("at") + 1) * size).cast("double").alias("hi"))
    # The shares below the ends of kept nodes, summed by value first.
    ends = nodes.select(*own, "total", F.explode(F.array("lo", "hi")).alias("end")).distinct()
    below = _binned_cuts(stats.where("num is not null").withColumn("label", F.lit("all")).groupBy(*own, "num", "str", "label").agg(F.sum("w").alias("w")), ends.groupBy(*own).agg(F.collect_set("end").alias("cuts")), keys)
    found = below.join(nodes.select(*own, "total").distinct(), own).select(*own, F.col("num").alias("end"), (F.col("lw") / F.col("total")).alias("share"))
    return found.groupBy(*own).agg(F.max(F.when(F.col("share") < q, F.col("end"))).alias("lower"), F.min(F.when(F.col("share") >= q, F.col("end"))).alias("upper"))


def dyadic_cuts(stats: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Candidates at the boundaries of dyadic intervals of length 2**level, with exact sides."""
    return binary(binned(stats.where("num is not null"), keys, lambda c: dyadic(c, level)), keys)


def one_at_random(candidates: DataFrame, keys: list[str], seed: str = "split") -> DataFrame:
    """One candidate per feature, chosen by hash."""
    value = F.coalesce(F.col("num").cast("string"), F.col("str"))
    ids = candidates.select(*keys, "feature", "op", "num", "str").distinct()
    order = Window.partitionBy(*keys, "feature").orderBy(hash32(seed, *keys, "feature", value), value)
    chosen = ids.withColumn("__r", F.row_number().over(order)).where(F.col("__r") == 1).drop("__r")
    return same_rows(candidates, chosen, [*keys, "feature", "op", "num", "str"])
