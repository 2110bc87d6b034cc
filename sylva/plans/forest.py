"""Training, validation, pruning and prediction of forests.

A Forest is immutable: every step returns a new one.  Its rows are a DataFrame (id, ts, label, weight and feature
columns); its trees live on the driver, as models do.  Each level of growth is one job: rows are routed with the trees
compiled into the plan, statistics are aggregated map-side and shuffled once by node and feature, all candidate splits are
scored with windows over those statistics, and one row per leaf comes back.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import hash32, uniform
from ..functions.hashing import uniform_of
from ..operators import metrics, voting
from ..operators.evaluate import ChiSquared, Evaluator, Stopper, best_splits
from ..operators.features import Columns, OpenMap, Source, name
from ..operators.routing import leaf_targets, route, targets_frame
from ..operators.sampling import KFold, RandomForest, Sampler, SingleTree, downsampled, out_of_time, training_rows, validation_rows
from ..operators.splitters import Feature, MapFeatures, adaptive_dyadic_cuts, binary, heavy_hitter_sketches, heavy_hitters, one_at_random, one_kind, quantile_digests, quantiles, raw_statistics, same_rows, statistics
from ..sources import models
from ..sources.storage import on_workers, scratch
from . import local_grow
from . import tree as T

KEYS = ["tree", "leaf"]
MOST_TARGETS = 5_000_000
BUCKET_ROWS = 50_000  # rows that are sorted together for a permutation
VOTE_ROWS = 100_000  # rows whose votes are in one task


def _collected(targets: DataFrame) -> list:
    rows = targets.limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets of leaves: too many labels for a model on the driver")
    return rows


@dataclass(frozen=True)
class Forest:
    rows: DataFrame
    features: tuple[Feature, ...] | MapFeatures  # columns, or all features of a map
    sampler: Sampler = SingleTree()
    evaluator: Evaluator = ChiSquared()
    stopper: Stopper = Stopper()
    order: str = "depth"
    capacity: int = 1000  # values of a sparse feature that are candidates
    cuts: int = 0  # continuous features: split at so many quantiles instead of binned values
    digests: int = 0  # quantiles and their sides from digests of this size, instead of exact sides
    tracked: int = 0  # sparse features: frequent values from sketches of so many items, instead of exact counts
    dyadic: int | None = None  # continuous features: split in nodes of dyadic trees compressed to shares above 2**-dyadic
    randomized: bool = False  # one candidate per feature, chosen by hash
    seed: str = "forest"
    trees: dict[int, T.Tree] = field(default_factory=dict)
    partial: bool = False  # targets of the last splits lack rows without the features that were split

    def __post_init__(self):
        kinds = dict(self.rows.dtypes)
        if isinstance(self.features, MapFeatures):
            OpenMap(self.rows, self.features.column)
        for f in () if isinstance(self.features, MapFeatures) else self.features:
            if f.name not in kinds:
                raise ValueError(f"no column {f.name}")
            if f.numeric and kinds[f.name] in ("string", "boolean"):
                raise ValueError(f"{f.name} is {kinds[f.name]}: a numeric kind needs numbers")
        if not self.trees:
            object.__setattr__(self, "trees", {i: T.singleton() for i in range(self.sampler.num_trees)})

    # ------------------------------------------------------------ pieces

    @property
    def spark(self) -> SparkSession:
        return self.rows.sparkSession

    def _read(self, rows: DataFrame) -> tuple[DataFrame, Source]:
        """Rows whose features can't clash with own columns (tree, leaf, ...), and how to read them."""
        if isinstance(self.features, MapFeatures):
            own = rows.withColumn("__features", F.col(name(self.features.column)))
            return own, OpenMap(own, "__features")
        used = {f.name for f in self.features} | {t.feature for x in self.trees.values() for _, t in T.with_paths(x) if isinstance(t, T.Node)}
        columns = {f: f"__x{k}" for k, f in enumerate(sorted(used))}
        own = rows.withColumns({c: F.col(name(f)) for f, c in columns.items()})
        return own, Columns(own, columns)

    def _own(self, features: list[Feature] | MapFeatures) -> list[Feature] | MapFeatures:
        """Features as statistics read them from rows of _read()."""
        if isinstance(features, MapFeatures):
            return replace(features, column="__features")
        columns = self._read(self.rows)[1].columns
        return [replace(f, column=columns[f.name]) for f in features]

    def training(self) -> DataFrame:
        rows, source = self._read(self.rows)
        return route(training_rows(rows, self.sampler), self.trees, self.order, source=source)

    def validation(self) -> DataFrame:
        rows, source = self._read(self.rows)
        return route(validation_rows(rows, self.sampler), self.trees, self.order, source=source)

    def paths(self) -> dict[tuple[int, int], str]:
        return {(i, x.index): path for i, t in self.trees.items() for path, x in T.with_paths(t) if isinstance(x, T.Leaf)}

    # ------------------------------------------------------------ steps

    def update_targets(self, path: str | None = None) -> Forest:
        """Each leaf's target becomes the sum of the training rows that reach it: zero where none does.

        Models live on the driver, so more than MOST_TARGETS pairs of leaf and label are an error.
        """
        found: dict[tuple[int, int], T.Target] = {}
        for r in _collected(leaf_targets(self.training())):
            found.setdefault((r["tree"], r["leaf"]), {})[r["label"]] = r["weight"]
        return replace(self, partial=False)._with({i: T.map_leaves(t, lambda x, i=i: replace(x, target=found.get((i, x.index), {}))) for i, t in self.trees.items()}, path)

    def _statistics(self, rows: DataFrame, features: list[Feature] | MapFeatures) -> DataFrame:
        """Statistics of routed rows by tree and leaf.

        At the roots of a cross-validation they don't depend on the tree but for the fold that it leaves out: rows are
        summed by fold, once for all trees, and the folds' sums are combined.
        """
        if not isinstance(self.sampler, KFold) or any(isinstance(t, T.Node) for t in self.trees.values()):
            return statistics(rows, features, KEYS)
        by_fold = statistics(self._read(self.rows)[0].withColumn("fold", self.sampler.fold()), features, ["fold"])
        trees = by_fold.withColumn("tree", F.explode(F.array(*[F.lit(i) for i in self.trees]))).where("tree <> fold")
        at = ["tree", "feature", *(["kind"] if isinstance(features, MapFeatures) else []), "num", "str", "label"]
        return trees.groupBy(*at).agg(F.sum("w").alias("w")).select("tree", F.lit(0).alias("leaf"), *at[1:], "w")

    def best_splits(self) -> DataFrame:
        """The best split of each leaf of each tree, with the weight of both sides and the score, whether or not the stopper
        lets the leaf split."""
        return best_splits(self.evaluator.evaluate(self.candidates(self.training()), KEYS), KEYS)

    def candidates(self, rows: DataFrame) -> DataFrame:
        """All candidate splits of routed rows (with tree and leaf)."""
        found = []
        if isinstance(self.features, MapFeatures):
            own = self._own(self.features)
            stats = self._allowed(one_kind(self._statistics(rows, own)))
            dense = "kind <> 'sparse'" + (" and kind <> 'continuous'" if self.cuts or self.dyadic is not None else "")
            found.append(binary(stats.where(dense).drop("kind"), KEYS))
            if self.cuts or self.dyadic is not None:
                found.append(self._cut(rows, own))
            found.append(self._frequent(rows, own, stats.where("kind = 'sparse'").drop("kind")))
        else:
            cut = [f for f in self.features if (self.cuts or self.dyadic is not None) and f.kind == "continuous"]
            dense = [f for f in self.features if f.kind != "sparse" and f not in cut]
            sparse = [f for f in self.features if f.kind == "sparse"]
            if dense:
                found.append(binary(self._allowed(self._statistics(rows, self._own(dense))), KEYS))
            if cut:
                found.append(self._cut(rows, self._own(cut)))
            if sparse:
                own = self._own(sparse)
                found.append(self._frequent(rows, own, None if self.tracked else self._allowed(self._statistics(rows, own))))
        out = found[0]
        for more in found[1:]:
            out = out.unionByName(more)
        return one_at_random(out, KEYS, self.seed) if self.randomized else out

    def _cut(self, rows: DataFrame, features: list[Feature] | MapFeatures) -> DataFrame:
        """Candidates of continuous features by quantiles, digests or dyadic trees."""
        if self.digests:
            return self._allowed(quantile_digests(rows, features, KEYS, self.cuts or 25, self.digests))
        if self.dyadic is None:
            return self._allowed(quantiles(rows, features, KEYS, self.cuts))
        return adaptive_dyadic_cuts(self._allowed(raw_statistics(rows, features, KEYS)), KEYS, self.dyadic)

    def _frequent(self, rows: DataFrame, features: list[Feature] | MapFeatures, stats: DataFrame | None) -> DataFrame:
        """Candidates of sparse features."""
        if self.tracked:
            return self._allowed(heavy_hitter_sketches(rows, features, leaf_targets(rows), KEYS, self.capacity, self.tracked))
        return heavy_hitters(stats, leaf_targets(rows), KEYS, self.capacity)

    def _allowed(self, stats: DataFrame) -> DataFrame:
        """Without features that the sampler denies a node; nodes are named by their paths, which stay."""
        test = self.sampler.feature(F.col("tree"), F.col("__path"), F.col("feature"))
        if "__path" not in str(test):
            return stats
        paths = self.spark.createDataFrame([(i, leaf, p) for (i, leaf), p in self.paths().items()], "tree int, leaf int, __path string")
        return stats.join(F.broadcast(paths), KEYS).where(test).drop("__path")

    def expand(self, path: str | None = None, max_leaves: int | None = None, local: bool = False) -> Forest:
        """One level: every leaf that the stopper lets split on the cluster takes its best split.

        local: leaves small enough for one task are split too.  max_leaves: at most so many of each tree, by hash.
        The new leaves' targets are the sides of their splits, without rows that lack the feature; where there are such rows,
        the next step counts targets again before it asks the stopper.
        """
        if self.partial:
            return self.update_targets().expand(path, max_leaves, local)
        active = [
            (i, x.index)
            for i, t in self.trees.items()
            for x in T.leaves(t)
            if self.stopper.splits(x.target) and (local or self.stopper.splits_distributed(x.target))
        ]
        if max_leaves is not None:
            paths = self.paths()
            rank = lambda k: (np.random.default_rng([k[0], *paths[k].encode()]).random(), k)
            active = [k for i in self.trees for k in sorted((a for a in active if a[0] == i), key=rank)[:max_leaves]]
        if not active:
            return self._with(self.trees, path)
        wanted = self.spark.createDataFrame(active, "tree int, leaf int")
        rows = self.training().join(F.broadcast(wanted), KEYS, "left_semi")
        # Read twice, for the best and for the winners' sides: kept, so that rows are scanned once a level.
        candidates = self.candidates(rows).join(F.broadcast(wanted), KEYS, "left_semi").persist(StorageLevel.MEMORY_AND_DISK)
        best = best_splits(self.evaluator.evaluate(candidates, KEYS), KEYS)
        splits: dict[tuple[int, int], tuple] = {}
        for r in same_rows(candidates, best, [*KEYS, "feature", "op", "num", "str"]).collect():
            value = r["num"] if r["num"] is not None else r["str"]
            _, _, left, right = splits.setdefault((r["tree"], r["leaf"]), (r["feature"], T.Predicate(r["op"], value), {}, {}))
            for side, w in ((left, r["lw"]), (right, r["rw"])):
                if w:
                    side[r["label"]] = w
        candidates.unpersist()
        whole = {(i, x.index): T.total(x.target) for i, t in self.trees.items() for x in T.leaves(t)}
        partial = any(T.total(left) + T.total(right) < whole[k] * (1 - 1e-9) for k, (_, _, left, right) in splits.items())
        return replace(self, partial=partial)._with({i: T.grow(t, lambda k, i=i: splits.get((i, k))) for i, t in self.trees.items()}, path)

    def expand_times(self, times: int, base: str | None = None, local: bool = False) -> Forest:
        """update_targets and then `times` levels, each written to a folder of its own below base."""
        return self.update_targets(base and models.step(base, 0)).expand_from(1, times, base, local)

    def expand_from(self, start: int, to: int, base: str | None = None, local: bool = False) -> Forest:
        out = self
        for k in range(start, to + 1):
            out = out.expand(base and models.step(base, k), local=local)
        return out

    def expand_in_memory(self, times: int, path: str | None = None, max_rows: int = 1_000_000) -> Forest:
        """Every leaf that may split grows up to `times` levels in one task, from its rows downsampled to the stopper's size.

        max_rows bounds a task: a leaf with more sampled rows takes its best split on the cluster, and so do the nodes below
        it until they have fewer.  Splits are those of the forest's evaluator over all distinct values, and rows
        without the feature of a split go the way of the forest's order; evaluators and samplers that only Spark can
        compute, `randomized`, `cuts` and sparse features raise an error.
        """
        if self.partial:
            return self.update_targets().expand_in_memory(times, path, max_rows)
        on_workers(self.spark)
        score = local_grow.scorer(self.evaluator)
        if isinstance(self.features, MapFeatures):
            raise ValueError("growth in memory needs a list of features: use expand")
        if self.randomized or any(f.kind == "sparse" or ((self.cuts or self.dyadic is not None) and f.kind == "continuous") for f in self.features):
            raise ValueError("growth in memory has no randomized candidates, cuts or sparse features: use expand")
        active = {(i, x.index): self.stopper.local_rate(x.target) for i, t in self.trees.items() for x in T.leaves(t) if self.stopper.splits(x.target)}
        if not active:
            return self._with(self.trees, path)
        paths, features, sampler, minimum = self.paths(), self.features, self.sampler, self.stopper.min_size
        order = self.order
        values = [f.value().alias(f"__f{k}") for k, f in enumerate(self._own(features))]

        wanted = self.spark.createDataFrame([(*k, r, paths[k]) for k, r in active.items()], "tree int, leaf int, rate double, path string")
        rows = downsampled(self.training().join(F.broadcast(wanted), KEYS), F.col("rate"), self.seed).where(F.col("label").isNotNull())
        sampled = rows.select("tree", "path", F.col("id").cast("string").alias("id"), F.col("label").cast("string").alias("label"), F.col("weight").cast("double").alias("weight"), *values)
        sampled = rows = sampled.persist(StorageLevel.MEMORY_AND_DISK)  # counted, then grown from
        while hasattr(sampler, "base"):
            sampler = sampler.base
        if type(sampler).feature not in (Sampler.feature, RandomForest.feature):
            raise ValueError(f"growth in memory can't ask {sampler} which features a node may use: use expand")
        rate, seed = getattr(sampler, "feature_rate", None), getattr(sampler, "seed", "")

        def build(pdf: pd.DataFrame) -> pd.DataFrame:
            tree, top = int(pdf["tree"].iloc[0]), pdf["path"].iloc[0]

            def allowed(path: str, feature: str) -> bool:  # the same hash as Sampler.feature
                return uniform_of(f"{seed}-feature", tree, top + path, feature) < rate

            ids = pdf["id"].to_numpy(dtype=object)

            def left(path: str, own: np.ndarray) -> np.ndarray:  # as routing.goes_left of nodes without annotations
                if order != "random":
                    return np.full(len(own), order != "probabilistic")
                return np.array([uniform_of("traversal", tree, i, top + path) < 0.5 for i in ids[own]], bool)

            columns = {f.name: pdf[f"__f{k}"].to_numpy(dtype=object) for k, f in enumerate(features)}
            grown = local_grow.grow(
                columns, {f.name: f.numeric for f in features}, pdf["label"].to_numpy(), pdf["weight"].to_numpy(), below, minimum, score, allowed=allowed if rate is not None else None, left=left
            )
            return pd.DataFrame({"tree": [tree], "path": [top], "json": [models.dumps(T.renumber(grown))]})

        at = ["tree", "path"]
        named = lambda nodes: F.broadcast(self.spark.createDataFrame(list(nodes), "tree int, path string"))
        grown: dict[tuple[int, str], T.Tree] = {}
        splits: dict[tuple[int, str], tuple[str, T.Predicate]] = {}
        for below in range(times, -1, -1):
            count: dict[tuple[int, str], int] = {}
            for r in _collected(sampled.groupBy(*at, "label").agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))):
                k = r["tree"], r["path"]
                count[k] = count.get(k, 0) + r["n"]
                grown[k] = T.Leaf(0, {**grown[k].target, r["label"]: r["weight"]} if k in grown else {r["label"]: r["weight"]})
            for k in count:
                grown[k] = T.Leaf(0, {label: w for label, w in grown[k].target.items() if w})
            more = [k for k in count if below and len(grown[k].target) > 1 and T.total(grown[k].target) > minimum]
            large = [k for k in more if count[k] > max_rows]
            small = [k for k in more if count[k] <= max_rows]
            if small:
                own = sampled if len(small) == len(count) else sampled.join(named(small), at, "left_semi")
                grown |= {(r["tree"], r["path"]): models.loads(r["json"]) for r in own.groupBy(*at).applyInPandas(build, "tree int, path string, json string").collect()}
            if not large:
                break
            sampled = self._split_large(sampled.join(named(large), at, "left_semi"), at, splits)
        rows.unpersist()

        def made(i: int, path: str) -> T.Tree:
            if (i, path) not in splits:
                return grown.get((i, path), T.Leaf(0))
            return T.Node(*splits[i, path], made(i, path + "L"), made(i, path + "R"))

        def graft(i: int):
            def new(index: int) -> T.Tree | None:
                path = paths[(i, index)]
                if (i, index) not in active or (i, path) not in grown:
                    return None
                s = 1 / active[(i, index)]
                return T.map_leaves(made(i, path), lambda x: replace(x, target={k: w * s for k, w in x.target.items()}))

            return new

        return self._with({i: T.update_leaves(t, graft(i)) for i, t in self.trees.items()}, path)

    def _split_large(self, rows: DataFrame, at: list[str], splits: dict[tuple[int, str], tuple[str, T.Predicate]]) -> DataFrame:
        """One level on the cluster for nodes, by tree and path, that are too large for a task, from the values that tasks grow
        from: adds their best splits to `splits`, and returns their rows with the paths of the nodes below."""
        own = [replace(f, kind="ordinal" if f.numeric else "nominal", bin=None, column=f"__f{k}") for k, f in enumerate(self.features)]
        stats = statistics(rows, own, at).where(self.sampler.feature(F.col("tree"), F.col("path"), F.col("feature")))
        best = best_splits(self.evaluator.evaluate(binary(stats, at), at), at).select(*at, "feature", "op", "num", "str").collect()
        splits |= {(r["tree"], r["path"]): (r["feature"], T.Predicate(r["op"], r["num"] if r["num"] is not None else r["str"])) for r in best}
        table = self.spark.createDataFrame([tuple(r) for r in best], "tree int, path string, __feature string, __op string, __num double, __str string")
        source = Columns(rows, {f.name: f.column for f in own})
        packed = {f"__{k}": c for k, c in source.packed([f.name for f in own]).items()}
        number, text = source.unpacked("__feature")
        left = F.when(F.col("__op") == "lt", number < F.col("__num")).otherwise(text == F.col("__str"))
        first = uniform("traversal", "tree", "id", "path") < 0.5 if self.order == "random" else F.lit(self.order != "probabilistic")
        below = rows.join(F.broadcast(table), at).withColumns(packed)
        below = below.withColumn("path", F.concat("path", F.when(F.coalesce(left, first), "L").otherwise("R")))
        return below.select(*rows.columns)

    # ------------------------------------------------------------ prediction and validation

    def votes(self, rows: DataFrame, trees: dict[int, T.Tree] | None = None, keep: list[str] = ("id",)) -> DataFrame:
        """(keep..., tree, label, weight) of rows, or of rows with their own `tree` column, if no feature is named so."""
        trees = trees or self.trees
        own, source = replace(self, trees=trees)._read(rows)
        if isinstance(source, Columns) and "tree" in source.columns:
            own = own.drop("tree")
        return self._votes(own, source, trees, keep, rows.count())

    def _votes(self, own: DataFrame, source: Source, trees: dict[int, T.Tree], keep: list[str], size: int) -> DataFrame:
        """Votes of rows of _read().

        Rows, of which there are `size`, come together by `keep` before they are multiplied by trees and labels, about
        VOTE_ROWS in a task: voters shuffle no votes then, and hold no more in a task however many rows there are.
        """
        parts = max(1 + size // VOTE_ROWS, min(self.spark.sparkContext.defaultParallelism, 1 + size // 10_000))
        own = own.repartition(parts, *keep)
        return voting.predictions(route(own, trees, self.order, source=source), targets_frame(self.spark, trees), list(keep))

    def predict(self, rows: DataFrame, voter: Callable[..., DataFrame] = voting.soft) -> DataFrame:
        return voter(self.votes(rows))

    def validate(self, error: Callable[..., DataFrame] = metrics.brier, voter: Callable[..., DataFrame] = voting.soft) -> DataFrame:
        """The error over all rows of what the trees that they validate predict."""
        own, source = self._read(self.rows)
        predicted = voter(self._votes(validation_rows(own, self.sampler), source, self.trees, ["id"], self.rows.count()))
        return error(self.rows.select("id", "label", "weight"), predicted)

    def prune(self, error: Callable[[T.Target, T.Target], float] | None = None, path: str | None = None) -> Forest:
        """Pairs of leaves merge where that doesn't raise the error on validation rows; every tree is kept."""
        error = error or (lambda held, target: metrics.brier_target(held, voting.soft_target([target]))[0] * T.total(held))
        held: dict[int, dict[int, T.Target]] = {}
        for r in _collected(leaf_targets(self.validation())):
            held.setdefault(r["tree"], {}).setdefault(r["leaf"], {})[r["label"]] = r["weight"]
        return self._with({i: T.prune(t, held.get(i, {}), error) for i, t in self.trees.items()}, path)

    def permuted(self, groups: int = 10, buckets: int | None = None) -> DataFrame:
        """Rows with one feature, named in `permuted`, taken from the predecessor in a group ordered by hash.

        A group is cut into buckets of the hash, each sorted on its own, of about BUCKET_ROWS rows; the first row of a bucket
        takes from the last row of the bucket before it that isn't empty.  The number of buckets changes no result.
        """
        buckets = buckets or 1 + self.rows.count() // (groups * BUCKET_ROWS)
        if isinstance(self.features, MapFeatures):
            raise ValueError("permutation needs a list of features")
        own = [f.name for f in self.features]
        pick = F.pmod(hash32(self.seed + "-pick", "id"), F.lit(len(own)))
        names = F.array(*map(F.lit, own))
        rows = self.rows.withColumn("__g", F.pmod(hash32(self.seed + "-group", "id"), F.lit(groups)).cast("int")).withColumn("__k", hash32(self.seed, "id"))
        rows = rows.withColumn("__b", F.floor(F.col("__k") / F.lit((1 << 32) / buckets)).cast("int"))
        last = rows.groupBy("__g", "__b").agg(F.max(F.struct("__k", "id", F.struct(*map(name, own)).alias("v"))).alias("last"))
        last = last.select("__g", "__b", F.lag("last.v").over(Window.partitionBy("__g").orderBy("__b")).alias("__before"))
        within = Window.partitionBy("__g", "__b").orderBy("__k", "id")
        rows = rows.withColumn("__n", F.row_number().over(within)).withColumn("__lag", F.lag(F.struct(*map(name, own))).over(within)).join(last, ["__g", "__b"])
        rows = rows.withColumn("__lag", F.when(F.col("__n") == 1, F.col("__before")).otherwise(F.col("__lag"))).where("__lag is not null")
        rows = rows.withColumn("permuted", names[pick.cast("int")])
        changed = {c: F.when(F.col("permuted") == c, F.col("__lag").getField(c)).otherwise(F.col(name(c))) for c in own}
        return rows.withColumns(changed).drop("__g", "__k", "__b", "__n", "__lag", "__before")

    def feature_importance(self, error: Callable[..., DataFrame] = metrics.brier, voter: Callable[..., DataFrame] = voting.soft, groups: int = 10) -> DataFrame:
        """By feature, the validation error of rows in which that feature was permuted."""
        path = scratch(self.spark, "permuted")  # read twice: as actual rows and for what is predicted of them
        self.permuted(groups).write.parquet(path)
        permuted = self.spark.read.parquet(path)
        ids = ["id", "permuted"]
        own, source = self._read(permuted)
        predicted = voter(self._votes(validation_rows(own, self.sampler), source, self.trees, ids, permuted.count()), ids=ids)
        actual = permuted.select("id", "permuted", "label", "weight")
        return error(actual, predicted, by=["permuted"]).withColumnRenamed("permuted", "feature")

    def out_of_time(self, quantile: float = 0.8) -> Forest:
        """Rows from a quantile of the times on validate, those before train."""
        return replace(self, sampler=out_of_time(self.sampler, self.rows, quantile))

    # ------------------------------------------------------------ models and combinators

    def save(self, path: str, form: str = "tsv") -> Forest:
        models.write(self.spark, self.trees, path, form)
        return self

    def load(self, path: str, form: str = "tsv") -> Forest:
        return replace(self, trees=models.read(self.spark, path, form))

    def persisted(self) -> Forest:
        """Rows kept on executors' disks; a lost executor's share is computed again."""
        return replace(self, rows=self.rows.persist(StorageLevel.DISK_ONLY))

    def flat_map_trees(self, f: Callable[[DataFrame, Sampler, dict[int, T.Tree]], dict[int, T.Tree]]) -> Forest:
        return replace(self, trees=f(self.rows, self.sampler, self.trees))

    def flat_map_sampler(self, f: Callable[[DataFrame, Sampler, dict[int, T.Tree]], Sampler]) -> Forest:
        return replace(self, sampler=f(self.rows, self.sampler, self.trees))

    def tee(self, f: Callable[[Forest], Any]) -> Forest:
        f(self)
        return self

    def _with(self, trees: dict[int, T.Tree], path: str | None) -> Forest:
        out = replace(self, trees=trees)
        return out.save(path).load(path) if path else out
