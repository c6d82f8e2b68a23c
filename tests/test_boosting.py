"""Boosted trees against one split at a time, attributions against all subsets."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest

from tidemark.operators import boosting as B

SCHEMA = "fold_id int, split string, id long, a double, b double, c string, y double"


def table(n=240, folds=(1, 2)):
    r = np.random.default_rng(7)
    rows = []
    for fold in folds:
        for i in range(n):
            a, b = (None if r.random() < 0.1 else float(r.integers(0, 30)) for _ in range(2))
            c = None if r.random() < 0.1 else "uvwx"[r.integers(0, 3 + (fold == 2))]
            split = "train" if i < n * 2 // 3 else "valid" if i < n * 5 // 6 else "test"
            y = 3 * (a or 5) + (7 if c == "v" else 0) * (b or 1) + r.normal()
            rows.append((fold, split, i, a, b, c, float(y)))
    return rows


def one_split_at_a_time(rows, lay, fold, rule):
    """Predictions of all rows, trees as nested tuples: the plain algorithm, on codes."""
    own = [r for r in rows if r[0] == fold]
    train = np.array([r[1] == "train" for r in own])
    y = np.array([r[6] for r in own])
    med = [np.median([r[i] for r, t in zip(own, train, strict=True) if t and r[i] is not None]) for i in (3, 4)]
    seen = [r[5] for r, t in zip(own, train, strict=True) if t and r[5] is not None]
    mode = min(set(seen), key=lambda c: (-seen.count(c), c))
    x = [[med[i] if r[3 + i] is None else r[3 + i] for i in range(2)] + [mode if r[5] is None else r[5]] for r in own]
    code = np.array([[min(np.searchsorted(lay.borders[i], v[i]), len(lay.borders[i]) - 1) for i in range(2)] + [lay.levels[0].index(v[2])] for v in x])
    p = np.full(len(own), y[train].mean())

    def best(rows_at):
        g = (p - y)[rows_at]
        found = (0.0, None, None)
        for col in range(3):
            for cut in range(lay.sizes()[col]):
                left = code[rows_at, col] <= cut if col < 2 else code[rows_at, col] != cut
                if min(left.sum(), (~left).sum()) < rule.least_rows:
                    continue
                gain = sum(g[m].sum() ** 2 / (m.sum() + rule.l2) for m in (left, ~left)) - g.sum() ** 2 / (len(g) + rule.l2)
                if gain > found[0] * (1 + 1e-9):
                    found = (gain, col, cut)
        return found

    for _ in range(rule.trees):
        everything = np.arange(len(own))
        leaves = [everything]
        while len(leaves) < rule.leaves:
            found = [best(at[train[at]]) for at in leaves]
            k = max(range(len(leaves)), key=lambda i: found[i][0])
            if found[k][0] <= 0:
                break
            _, col, cut = found[k]
            left = code[leaves[k], col] <= cut if col < 2 else code[leaves[k], col] != cut
            leaves[k : k + 1] = [leaves[k][left], leaves[k][~left]]
        add = np.zeros(len(own))
        for at in leaves:
            g = (p - y)[at[train[at]]]
            add[at] = -rule.rate * g.sum() / (len(g) + rule.l2)
        p += add
    return {r[2]: v for r, v in zip(own, p, strict=True)}


@pytest.fixture(scope="module")
def fitted(spark):
    points = [B.Boosting(trees=10, leaves=5, rate=0.3, least_rows=6), B.Boosting(trees=4, leaves=8, rate=0.2, least_rows=10, l2=1.0)]
    rows = table()
    return rows, points, B.fit(spark.createDataFrame(rows, SCHEMA).repartition(5), ["a", "b"], ["c"], "y", points, ["id"], bins=16)


def test_trees_are_those_of_one_split_at_a_time(fitted):
    rows, points, model = fitted
    got = {(r.fold_id, r.point, r.id): r.y_pred for r in model.predictions().collect()}
    assert len(got) == len(rows) * 2
    for fold in (1, 2):
        for j, rule in enumerate(points):
            for i, p in one_split_at_a_time(rows, model.lay, fold, rule).items():
                assert got[fold, j, i] == pytest.approx(p, abs=1e-8)


def test_copies_of_rows_are_cells(spark):
    """A pass reads as many cells of four copies as of one, and splits them alike."""
    found = []
    for copies in (1, 4):
        rows = [r for r in table(90) for _ in range(copies)]
        model = B.fit(spark.createDataFrame(rows, SCHEMA).repartition(3), ["a", "b"], ["c"], "y", [B.Boosting(trees=9, leaves=4, rate=0.3, least_rows=5 * copies)], ["id"], bins=16)
        assert sum(t.cover[0] for t in model.trees[1, 0]) == 9 * 60 * copies
        found.append((sum(r.cells for r in model.blocks.collect()), {(r.fold_id, r.id): r.y_pred for r in model.predictions().collect()}, [t.column for t in model.trees[2, 0]]))
    assert found[0][0] == found[1][0] <= 2 * 60
    assert found[0][1] == pytest.approx(found[1][1], abs=1e-9) and found[0][2] == found[1][2]


def test_passes_do_not_grow_with_folds(spark):
    rule = [B.Boosting(trees=2, leaves=6, least_rows=5)]
    passes = []
    for folds in ((1,), (1, 2, 3, 4, 5)):
        rows = [(fold, *r[1:]) for fold in folds for r in table(90, (1,))]
        passes.append(B.fit(spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["c"], "y", rule, ["id"]).passes)
    assert passes[0] == passes[1] <= 2 * 6


def brute_force_shap(tree, x, lay, place, n_features):
    """Over all subsets of features, with shares of training rows elsewhere."""

    def expected(at, subset):
        c, b = tree.column[at], tree.bin[at]
        if c < 0:
            return tree.value[at]
        left, right = tree.left[at], tree.right[at]
        if place(c, b) in subset:
            return expected(left if (x[c] <= b if c < len(lay.numeric) else x[c] != b) else right, subset)
        return sum(tree.cover[k] / tree.cover[at] * expected(k, subset) for k in (left, right))

    out = np.zeros(n_features)
    for j in range(n_features):
        rest = [i for i in range(n_features) if i != j]
        for s in range(n_features):
            for subset in combinations(rest, s):
                weight = factorial(s) * factorial(n_features - s - 1) / factorial(n_features)
                out[j] += weight * (expected(0, {*subset, j}) - expected(0, set(subset)))
    return out


def test_attributions(spark, fitted):
    rows, _, model = fitted
    names = model.lay.features()
    assert names == ["a", "b", "c_u", "c_v", "c_w", "c_x"]
    place = lambda c, b: c if c < 2 else 2 + b
    found = model.attributions("test", 1).collect()
    assert len(found) == sum(r[1] == "test" for r in rows)
    codes = {(r.fold_id, r.id): np.frombuffer(bytes(r._x), np.uint16) for r in model.rows.filter("split = 'test'").collect()}
    for r in found:
        assert r.base + sum(r.shap) == pytest.approx(r.y_pred, abs=1e-8)
    for r in found[:12]:
        x = codes[r.fold_id, r.id].astype(int)
        x = np.where(x == B.MISSING, model.lay.fill[r.fold_id], x)
        expected = sum(brute_force_shap(t, x, model.lay, place, len(names)) for t in model.trees[r.fold_id, 1])
        assert list(r.shap) == pytest.approx(list(expected), abs=1e-8)
    means = {r.feature: r.mean_abs_shap for r in model.mean_attributions("test", 1).collect()}
    assert means == pytest.approx({n: np.mean([abs(r.shap[i]) for r in found]) for i, n in enumerate(names)})


def test_importances(fitted):
    _, points, model = fitted
    found = model.importances().collect()
    assert {r.feature for r in found} == set(model.lay.features())
    for fold in (1, 2):
        splits = sum(len(t.column) // 2 for t in model.trees[fold, 0])
        assert sum(r.splits for r in found if (r.fold_id, r.point) == (fold, 0)) == splits
    assert max((r for r in found if r.point == 0), key=lambda r: r.gain).feature in ("a", "b", "c_v")


def test_odd_tables(spark):
    """No rows, no training rows, one value, all missing, no labels."""
    rule = [B.Boosting(trees=2, leaves=3, least_rows=1)]
    empty = B.fit(spark.createDataFrame([], SCHEMA), ["a"], ["c"], "y", rule, ["id"])
    assert empty.predictions().count() == 0 and empty.importances().count() == 0
    rows = [(1, "train", 1, None, 2.0, None, 4.0), (1, "train", 2, None, 2.0, None, 8.0), (1, "test", 3, 1.0, 9.0, "new", None), (1, "test", 4, 1.0, 9.0, "new", 5.0), (1, "test", 5, float("nan"), None, None, 5.0)]
    got = {r.id: r.y_pred for r in B.fit(spark.createDataFrame(rows, SCHEMA), ["a", "b"], ["c"], "y", rule, ["id"]).predictions().collect()}
    assert got == pytest.approx({1: 6.0, 2: 6.0, 4: 6.0, 5: 6.0})
    with pytest.raises(ValueError):
        B.fit(spark.createDataFrame(rows, SCHEMA), ["a"], [], "y", [B.Boosting(leaves=0)], [])
