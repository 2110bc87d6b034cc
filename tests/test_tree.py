import json

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sylva.plans import tree as T
from sylva.sources import models
from sylva.sources.models import ModelError

predicates = st.builds(T.Predicate, st.sampled_from(models.OPS), st.floats(-100, 100))


def trees(depth=5):
    leaf = st.builds(T.Leaf, st.just(0), st.dictionaries(st.sampled_from("abc"), st.integers(0, 9), max_size=3), st.integers(0, 50) | st.none())
    return st.recursive(leaf, lambda t: st.builds(T.Node, st.sampled_from(["f1", "f2", "f3"]), predicates, t, t, st.integers(0, 50) | st.none()), max_leaves=2**depth).map(T.renumber)


@given(predicates, st.floats(-100, 100))
def test_negation(p, x):
    assert (not p(x)) == (~p)(x) and ~~p == p and p.display("x")


@given(predicates, st.floats(-100, 100))
def test_order_preserving_map(p, x):
    assert p.map(lambda v: 2 * v)(2 * x) == p(x)


@given(trees())
def test_roundtrips(t):
    assert models.loads(models.dumps(t)) == t
    assert models.from_string(models.to_string(t)) == t
    assert T.expand_compressed(T.compress(t)) == t


junk = st.recursive(st.none() | st.booleans() | st.integers() | st.floats(allow_nan=False) | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.sampled_from(["leaf", "key", "predicate", "left", "right", "distribution", "lt", "a"]), x, max_size=5), max_leaves=12)


@given(junk)
def test_decoding_fails_cleanly(value):
    for decode in (models.decode, models.decode_predicate, models.decode_tagged, models.decode_option):
        try:
            decode(value)
        except ModelError:
            pass
    for text in (json.dumps(value), str(value)):
        for load in (models.loads, models.from_string):
            try:
                load(text)
            except ModelError:
                pass


@given(trees())
def test_leaves_from_left_to_right(t):
    assert [x.index for x in T.leaves(t)] == list(range(sum(1 for _ in T.leaves(t))))
    assert [x.index for x in T.search(t, {})] == [x.index for x in T.leaves(t)]
    assert T.leaf_at(t, 0) == next(T.leaves(t)) and T.leaf_at(t, 10**6) is None


@given(trees(), st.integers(0, 99))
def test_seeded_orders_are_stable(t, id_):
    t = T.annotate(t, lambda x: 1 + sum(x.values()))
    for order in ("random", "probabilistic"):
        assert [x.index for x in T.search(t, {}, order, id_)] == [x.index for x in T.search(t, {}, order, id_)]


def two(a, b, feature="f1"):
    return T.Node(feature, T.Predicate("lt", 0), T.Leaf(0, {}, a), T.Leaf(1, {}, b), a + b)


def test_weighted_order():
    assert T.leaf_for(two(12, 9), {}, order="weighted").index == 0
    assert T.leaf_for(two(-3, 9), {}, order="weighted").index == 1
    assert T.leaf_for(two(5, 5), {}, order="weighted").index == 0
    deep = T.renumber(T.Node("f1", T.Predicate("lt", 0), two(33, 53, "f2"), two(77, 19, "f2"), 182))
    for row, want in (({}, 2), ({"f1": -1}, 1), ({"f2": 1}, 3), ({"f1": -1, "f2": -1}, 0)):
        assert T.leaf_for(deep, row, order="weighted").index == want


def test_limit():
    assert len(T.limited(T.search(two(1, 2), {}), 1)) == 1
    with pytest.raises(ValueError):
        T.limited(T.search(two(1, 2), {}), 0)


@given(trees())
def test_annotations_bubble_up(t):
    t = T.annotate(t, T.total)
    assert t.annotation == T.total(T.target_of(t))
    doubled = T.map_annotation(t, lambda a: 2 * a)
    assert doubled.annotation == 2 * t.annotation


@given(trees())
def test_maps(t):
    back = T.map_features(T.map_features(t, lambda f: f + "x"), lambda f: f[:-1])
    assert back == t and T.map_predicates(t, lambda v: v) == t


def test_grow_and_update():
    t = T.grow(T.singleton({"a": 1.0}), lambda k: ("f", T.Predicate("lt", 1), {"a": 1.0}, {}))
    assert [x.index for x in T.leaves(t)] == [0, 1]
    t = T.update_leaves(t, lambda k: t if k == 1 else None)
    assert [x.index for x in T.leaves(t)] == [0, 1, 2] and T.depth(t) == 2


@given(trees())
def test_pruning_does_not_raise_the_error(t):
    t = T.map_leaves(t, lambda x: T.Leaf(x.index, x.target or {"a": 1}))
    held = {x.index: {"a": x.index % 3, "b": 1} for x in T.leaves(t)}

    def wrong(h, target):
        best = min(target, key=lambda k: (-target[k], k))
        return sum(w for k, w in h.items() if k != best)

    def error(tree, held):
        return sum(wrong(held.get(x.index, {}), x.target) for x in T.leaves(tree))

    pruned = T.prune(t, held, wrong)
    groups = iter(sorted(held))
    merged = {}

    def collect(old, new):
        if isinstance(new, T.Leaf):
            total = {}
            for x in T.leaves(old):
                total = T.add(total, held[x.index])
            merged[new.index] = total
        else:
            collect(old.left, new.left)
            collect(old.right, new.right)

    collect(t, pruned)
    assert error(pruned, merged) <= error(t, held) and list(groups) is not None
    assert [x.index for x in T.leaves(pruned)] == list(range(len(merged)))


def test_option_boolean_and_tags():
    assert models.decode_option([]) is None and models.decode_option([3]) == 3
    with pytest.raises(ModelError):
        models.decode_option([1, 2])
    assert models.decode_boolean("true") is True and models.decode_boolean(models.encode_boolean(False)) is False
    with pytest.raises(ModelError):
        models.decode_boolean("True")
    assert models.decode_tagged(models.encode_tagged("nominal", "x")) == ("nominal", "x")
    for bad, said in (({}, "empty"), ({"a": 1, "b": 2}, "more than one")):
        with pytest.raises(ModelError, match=said):
            models.single(bad, "object")


def test_migration():
    leaf = lambda k: {"leaf": k, "distribution": {"a": 1}}

    def branches(p, q, f="f", g="f"):
        return [{"feature": f, "predicate": p, "children": leaf(0)}, {"feature": g, "predicate": q, "children": leaf(1)}]

    ok = models.migrate_model(["7\t" + json.dumps(branches({"or": [{"lt": 3}, {"eq": 3}]}, {"not": {"or": [{"lt": 3}, {"eq": 3}]}}))])[0]
    index, text = ok.split("\t")
    t = models.loads(text)
    assert index == "7" and t.predicate == T.Predicate("ltEq", 3)
    for bad in (branches({"lt": 3}, {"lt": 3}), branches({"lt": 3}, {"not": {"lt": 4}}), branches({"lt": 3}, {"not": {"lt": 3}}, "f", "g"), branches({"exists": 1}, {"lt": 3}), [1], branches({"or": [{"lt": 3}, {"eq": 4}]}, {"gt": 3})):
        with pytest.raises(ModelError):
            models.migrate_model(["0\t" + json.dumps(bad)])
