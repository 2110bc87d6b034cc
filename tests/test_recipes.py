import numpy as np

from sylva.operators.evaluate import Stopper
from sylva.operators.splitters import Feature
from sylva.plans import recipes
from sylva.plans import tree as T
from sylva.sources.instances import from_csv


def write(path):
    """Three kinds of flowers that differ in two of four measures."""
    rng = np.random.default_rng(8)
    lines = []
    for k in range(150):
        kind = k % 3
        x = rng.normal([5, 3, 1.5 + 2 * kind, 0.3 + 0.8 * kind], [0.4, 0.3, 0.3, 0.15])
        lines.append(",".join(f"{v:.2f}" for v in x) + f",kind{kind}")
    path.write_text("\n".join(lines) + "\n")
    return str(path)


NAMES = ["a", "b", "c", "d"]


def test_cross_validation_from_text(spark, tmp_path):
    base = str(tmp_path / "out")
    forest = recipes.from_labelled_text(spark, write(tmp_path / "in.csv"), NAMES, base, folds=2, levels=1, local_levels=3, stopper=Stopper(40, 3))
    assert len(forest.trees) == 2 and all(isinstance(t, T.Node) for t in forest.trees.values())
    brier = {name: float(spark.read.csv(f"{base}/{name}", sep="\t").first()[0]) for name in ("brier", "brier_pruned")}
    assert brier["brier"] < 0.1 and brier["brier_pruned"] < 0.1
    importance = {r[0]: float(r[1]) for r in spark.read.csv(f"{base}/importance", sep="\t").collect()}
    assert set(importance) == set(NAMES)
    assert forest.load(f"{base}/step_01").trees.keys() == forest.trees.keys()


def test_one_leaf_at_a_time(spark, tmp_path):
    rows = from_csv(spark, write(tmp_path / "in.csv"), NAMES)
    steps = list(recipes.one_leaf_at_a_time(rows, tuple(Feature(n, "continuous") for n in NAMES), 2, Stopper(1000, 3)))
    assert [sum(1 for _ in T.leaves(f.trees[0])) for f, _ in steps] == [2, 3]
    assert steps[1][1] > 0.9 and steps[1][1] >= steps[0][1]
