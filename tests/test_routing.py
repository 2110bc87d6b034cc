"""All ways to route give the same leaves, whatever features are named."""

import random

import pytest
from pyspark.sql import functions as F

from sylva import streaming
from sylva.operators import routing
from sylva.operators.evaluate import Stopper
from sylva.operators.features import Columns, OpenMap
from sylva.operators.routing import all_leaves, route, route_by_level
from sylva.operators.sampling import KFold, SingleTree
from sylva.operators.splitters import Feature, MapFeatures
from sylva.plans import tree as T
from sylva.plans.forest import Forest
from sylva.sources import instances

NAMES = ["path", "leaf", "op", "num", "str", "feature", "tree", "__path", "a.b", "ord", "left_weight"]


def random_tree(rng, numbers, texts, depth):
    if depth == 0 or rng.random() < 0.1:
        return T.Leaf(0, {"a": rng.randint(0, 9), "b": rng.randint(1, 9)})
    op = rng.choice(T.OPERATORS)
    name = rng.choice(numbers + texts)
    value = rng.choice([rng.randint(0, 9), rng.random() * 9]) if name in numbers else rng.choice("acegi")
    return T.Node(name, T.Predicate(op, value), random_tree(rng, numbers, texts, depth - 1), random_tree(rng, numbers, texts, depth - 1))


def random_rows(rng, numbers, texts, n):
    number = lambda: rng.choice([None, float("nan"), float(rng.randint(0, 9)), rng.random() * 9])
    return [[k, *(number() for _ in numbers), *(rng.choice([None, *"abcdefghij"]) for _ in texts)] for k in range(n)]


def frame(spark, rows, numbers, texts):
    columns = ", ".join(["id long", *(f"`{c}` double" for c in numbers), *(f"`{c}` string" for c in texts)])
    return spark.createDataFrame(rows, columns)


@pytest.mark.parametrize("order", routing.ORDERS)
def test_all_ways_agree_with_the_search_on_the_driver(spark, order):
    rng = random.Random(order)
    numbers, texts = NAMES[::2], NAMES[1::2]
    trees = {i: T.annotate(T.renumber(random_tree(rng, numbers, texts, 5)), T.total) for i in (0, 3)}
    data = random_rows(rng, numbers, texts, 40)
    rows = frame(spark, data, numbers, texts)
    by_id = {r[0]: dict(zip(["id", *numbers, *texts], r)) for r in data}
    every = {(i, k): [x.index for x in T.search(t, row, order, k, index=i)] for i, t in trees.items() for k, row in by_id.items()}
    names = {"tree": "t", "leaf": "l"}
    for found in (route(rows, trees, order, **names), route(rows, trees, order, case_nodes=0, **names), route_by_level(rows.withColumn("t", F.explode(F.array(F.lit(0), F.lit(3)))), trees, order, **names)):
        assert found.columns == [*rows.columns, "t", "l"]
        assert {(r["t"], r["id"]): r["l"] for r in found.collect()} == {k: v[0] for k, v in every.items()}
    for limit in (None, 1, 3):
        for nodes in (None, 0):
            got = {}
            for r in all_leaves(rows, trees, limit, order, case_nodes=nodes, **names).collect():
                got.setdefault((r["t"], r["id"]), []).append((r["ord"], r["l"]))
            assert {k: [x for _, x in sorted(v)] for k, v in got.items()} == {k: v[:limit] for k, v in every.items()}
            assert all([o for o, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_a_feature_named_leaf_is_read_before_it_is_replaced_and_tree_needs_another_name(spark):
    t = T.Node("leaf", T.Predicate("lt", 5), T.Leaf(0), T.Leaf(1))
    rows = spark.createDataFrame([(1, 2.0), (2, 7.0)], "id long, leaf double")
    for nodes in (None, 0):
        assert {r["id"]: r["leaf"] for r in route(rows, {0: t}, case_nodes=nodes).collect()} == {1: 0, 2: 1}
    own = rows.withColumnRenamed("leaf", "tree")
    with pytest.raises(ValueError):
        route(own, {0: T.map_features(t, lambda _: "tree")})
    with pytest.raises(ValueError):
        all_leaves(rows, t, order="other")


def test_scores_are_the_same_either_way(spark):
    rng = random.Random(9)
    numbers, texts = NAMES[::2], NAMES[1::2]
    trees = {i: T.renumber(random_tree(rng, numbers, texts, d)) for i, d in ((0, 2), (1, 6), (2, 5))}
    rows = frame(spark, random_rows(rng, numbers, texts, 60), numbers, texts)
    want = None
    for nodes in (10**6, 20, 0):
        found = streaming.score(rows, trees, ["a", "b"], case_nodes=nodes)
        assert found.columns == [*rows.columns, "p_a", "p_b"]
        got = {r["id"]: (round(r["p_a"], 9), round(r["p_b"], 9)) for r in found.collect()}
        assert want in (None, got)
        want = got
    one = streaming.score_one(rows.where("id = 7").first().asDict(), trees)
    assert (round(one.get("a", 0), 9), round(one.get("b", 0), 9)) == want[7]


def test_a_tree_of_thousands_of_nodes_is_walked_in_one_stage(spark):
    def full(lo, hi):
        return T.Leaf(0) if hi - lo == 1 else T.Node("x", T.Predicate("lt", (lo + hi) // 2), full(lo, (lo + hi) // 2), full((lo + hi) // 2, hi))

    t = T.renumber(full(0, 2600))
    rows = spark.range(5000).select("id", (F.col("id") % 2600).cast("double").alias("x"), F.lit(0).alias("tree"))
    found = route(rows, {0: t})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Exchange" not in plan and "Join" not in plan
    assert {r["id"]: r["leaf"] for r in found.collect()} == {r["id"]: r["leaf"] for r in route_by_level(rows, {0: t}).collect()} == {k: k % 2600 for k in range(5000)}


@pytest.mark.parametrize("kind", ["map<string, double>", "map<string, struct<kind:string, num:double, str:string>>"])
def test_open_maps_are_looked_up_alike(spark, kind):
    t = T.renumber(T.Node("a.b", T.Predicate("lt", 3), T.Node("zz", T.Predicate("gtEq", 1.5), T.Leaf(0), T.Leaf(0)), T.Leaf(0)))
    plain = [{}, {"a.b": 2.0}, {"a.b": 4.0}, {"a.b": 1.0, "zz": 1.0}, {"zz": 2.0, "more": 1.0}, {"a.b": None}, None]
    tag = (lambda v: v) if "struct" not in kind else (lambda v: ("ordinal", v, None))
    rows = spark.createDataFrame([(k, m and {f: tag(v) for f, v in m.items()}) for k, m in enumerate(plain)], f"id long, m {kind}")
    want = [0, 0, 2, 1, 0, 0, 0]
    source = OpenMap(rows, "m")
    for found in (route(rows, {0: t}, source=source), route(rows, {0: t}, source=source, case_nodes=0), route_by_level(rows.withColumn("tree", F.lit(0)), {0: t}, source=source)):
        assert [r["leaf"] for r in found.orderBy("id").collect()] == want


def test_a_forest_of_ten_thousand_sparse_names(spark):
    rng = random.Random(3)
    rows = []
    for k in range(3000):
        label = rng.choice("ab")
        own = {f"f{rng.randrange(10_000)}": ("sparse", None, str(rng.randrange(5))) for _ in range(6)}
        if rng.random() < 0.8:
            own["telling"] = ("sparse", None, "yes" if label == "a" else "no")
        if label == "a" and rng.random() < 0.5:
            own["number"] = ("ordinal", float(rng.randrange(4)), None)
        rows.append((k, 0, label, 1.0, own))
    df = spark.createDataFrame(rows, "id long, ts long, label string, weight double, features map<string, struct<kind:string, num:double, str:string>>")
    forest = Forest(df, MapFeatures(), SingleTree(), stopper=Stopper(50, 50), capacity=20).expand_times(2)
    assert forest.trees[0].feature == "telling" and T.depth(forest.trees[0]) == 2
    assert sum(T.total(x.target) for x in T.leaves(forest.update_targets().trees[0])) == 3000
    assert forest.predict(df).count() >= 3000
    with pytest.raises(ValueError):
        forest.expand_in_memory(1)


def test_a_feature_of_several_kinds_is_an_error(spark):
    kind = "id long, ts long, label string, weight double, features map<string, struct<kind:string, num:double, str:string>>"
    mixed = [(1, 0, "a", 1.0, {"x": ("ordinal", 1.0, None)}), (2, 0, "b", 1.0, {"x": ("nominal", None, "1")})]
    unknown = [(1, 0, "a", 1.0, {"x": ("none", 1.0, None)})]
    for rows, message in ((mixed, "several kinds"), (unknown, "no kind")):
        with pytest.raises(Exception, match=message):
            Forest(spark.createDataFrame(rows, kind), MapFeatures()).best_splits().collect()
    with pytest.raises(ValueError):
        Forest(spark.createDataFrame(mixed, kind), MapFeatures("label"))


def test_tagged_map_of_columns_and_maps(spark):
    rows = spark.createDataFrame([(1.5, "t", {"x": "3", "y": "word", "u": "7"}), (None, None, None)], "u double, v string, m map<string,string>")
    out = rows.select(instances.tagged_map({"u": "continuous", "v": "nominal", "y": "sparse"}, {"u": F.col("u"), "v": F.col("v")}, [F.col("m")]).alias("f")).collect()
    assert {k: tuple(v) for k, v in out[0].f.items()} == {"u": ("continuous", 7.0, None), "v": ("nominal", None, "t"), "x": ("ordinal", 3.0, None), "y": ("sparse", None, "word")}
    assert out[1].f == {}


def test_forests_of_features_with_any_names(spark):
    rng = random.Random(1)
    names = ["tree", "leaf", "path", "times", "fold", "a.b"]
    rows = [(k, 0, rng.choice("xy"), 1.0, *[float(rng.randrange(9)) for _ in names]) for k in range(400)]
    columns = "id long, ts long, label string, weight double, "
    named = spark.createDataFrame(rows, columns + ", ".join(f"`{c}` double" for c in names))
    plain = spark.createDataFrame(rows, columns + ", ".join(f"z{k} double" for k in range(len(names))))
    grown = []
    for df, own in ((named, names), (plain, [f"z{k}" for k in range(len(names))])):
        f = Forest(df, tuple(Feature(c, "ordinal") for c in own), KFold(2), stopper=Stopper(20, 20)).expand_times(2).update_targets()
        back = {c: k for k, c in enumerate(own)}
        grown.append(({i: T.map_features(t, lambda c: str(back[c])) for i, t in f.trees.items()}, sorted(map(tuple, f.predict(df).collect())), f.validate().collect()))
    # Ties between features go by name, so trees are compared by what they predict where names order differently.
    assert all(T.depth(t) == 2 for t in grown[0][0].values()) and len(grown[0][1]) == len(grown[1][1])
