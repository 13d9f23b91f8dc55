"""Joint fits, tree contributions, saved models and the nested search on small tables."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from noteframe.ml import boosting, ordinal
from noteframe.ml import contributions as paths
from noteframe.ml import models as mm
from noteframe.ml import search as ms
from noteframe.ml import validation as mv

RNG = np.random.default_rng(11)
X = np.round(RNG.normal(size=(260, 4)), 2)
Y = np.digitize(X[:, 0] + 0.8 * X[:, 1] * (X[:, 2] > 0) + 0.3 * RNG.normal(size=260), [-0.6, 0.7])
PLAIN = boosting.Settings(rounds=1, step=1.0, rows=1.0, columns=1.0)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(i, int(Y[i]), X[i].tolist(), int(i % 4 != 0), 1) for i in range(len(Y))]
    return spark.createDataFrame(data, "id long, y int, x array<double>, part int, whole int").repartition(3).cache()


def test_first_split_is_the_best_of_all(rows):
    model = boosting.fit_boosted(rows, "y", "id", 3, [boosting.Plan("x", "part", 1)], PLAIN)[0]
    use = np.arange(len(Y)) % 4 != 0
    x, y = X[use], Y[use]
    cuts = [np.unique(np.quantile(x[:, j], np.arange(1, 32) / 32, method="inverted_cdf")) for j in range(4)]
    for k in range(3):
        g, h = 1 / 3 - (y == k), np.full(len(y), 2 / 9)
        score = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1)  # noqa: E731, B023
        best = max((score(x[:, j] <= c) + score(x[:, j] > c), j, c) for j in range(4) for c in cuts[j] if (x[:, j] > c).sum() > 5)
        j, cut = int(model.feature[0, k, 0]), model.threshold[0, k, 0]
        assert score(x[:, j] <= cut) + score(x[:, j] > cut) == pytest.approx(best[0], rel=1e-9)
        left = x[:, j] <= cut
        assert model.value[0, k, 0] == pytest.approx(-g[left].sum() / (h[left].sum() + 1))
        assert model.cover[0, k].tolist() == pytest.approx([h.sum(), h[left].sum(), h[~left].sum()])


def test_models_grown_together_equal_models_grown_alone(rows):
    told = boosting.Settings(rounds=11, step=0.3)
    plans = [boosting.Plan("x", r, d, s) for r, d, s in (("part", 2, 1), ("whole", 3, 2), ("part", 3, 1))]
    together = boosting.fit_boosted(rows, "y", "id", 3, plans, told)
    alone = boosting.fit_boosted(rows.repartition(1), "y", "id", 3, plans[2:], told)[0]
    assert together[2].margins(X) == pytest.approx(alone.margins(X), abs=1e-9)
    p = together[2].probabilities(X)
    held = np.arange(len(Y)) % 4 == 0
    assert p.sum(1) == pytest.approx(np.ones(len(Y)))
    assert -np.log(p[held][np.arange(held.sum()), Y[held]]).mean() < 0.6


def test_odd_tables_of_boosted_trees(spark):
    schema = "id long, y int, x array<double>, r int"
    same = spark.createDataFrame([(i, i % 2, [1.0, 2.0], 1) for i in range(20)], schema)
    flat = boosting.fit_boosted(same, "y", "id", 3, [boosting.Plan("x", "r", 2)], PLAIN)[0]
    assert not np.isfinite(flat.threshold).any()  # constant features give no split
    p = flat.probabilities(np.array([[1.0, 2.0]]))[0]
    assert p[0] == pytest.approx(p[1]) and p[2] < p[0]
    none = boosting.fit_boosted(same.withColumn("r", F.lit(0)), "y", "id", 2, [boosting.Plan("x", "r", 2)], PLAIN)[0]
    assert none.margins(np.zeros((3, 2))).tolist() == np.zeros((3, 2)).tolist()


def test_ordinal_models_in_one_fit(rows):
    plans = [ordinal.Plan("x", r, a) for r in ("part", "whole") for a in (0.01, 1.0)]
    for plan, (beta, theta) in zip(plans, ordinal.fit_ordinal(rows, "y", 3, plans), strict=True):
        use = np.arange(len(Y)) % 4 != 0 if plan.role == "part" else np.ones(len(Y), bool)
        weight = (1 / np.bincount(Y[use]))[Y[use]]
        _, grad, _ = ordinal.likelihood(X[use], Y[use], weight / weight.sum(), beta, theta)
        grad[:4] += plan.alpha / 4 * beta
        assert np.abs(grad).max() < 1e-7 and (np.diff(theta) > 0).all()
        p = ordinal.probabilities(X, beta, theta)
        assert (p > 0).all() and p.sum(1) == pytest.approx(np.ones(len(Y)))


def test_an_absent_class_leaves_the_ordinal_fit_at_its_optimum(rows, monkeypatch):
    steps = []
    solve = np.linalg.solve
    monkeypatch.setattr(np.linalg, "solve", lambda *a: steps.append(1) or solve(*a))
    for absent in (2, 0):  # of four classes: inside, and at an end
        codes = [k for k in range(4) if k != absent]
        y = F.element_at(F.array(*[F.lit(k) for k in codes]), F.col("y") + 1)
        beta, theta = ordinal.fit_ordinal(rows.withColumn("y", y), "y", 4, [ordinal.Plan("x", "whole", 0.01)])[0]
        weight = (1 / np.bincount(Y))[Y]
        own = theta[[0, 1]] if absent == 2 else theta[[1, 2]]
        _, grad, _ = ordinal.likelihood(X, Y, weight / weight.sum(), beta, own)
        grad[:4] += 0.01 / 4 * beta
        assert np.abs(grad).max() < 1e-7
        p = ordinal.probabilities(X, beta, theta)
        assert p[:, absent].max() < 1e-9 and p.sum(1) == pytest.approx(np.ones(len(Y))) and (np.diff(theta) >= 0).all()
    assert len(steps) < 40


def _shapley(leaves, row, n_classes):
    """By the definition: averages over all subsets of features."""
    f = len(row)

    def known(subset):
        out = np.zeros(n_classes)
        for leaf in leaves:
            w = 1.0
            for j, (low, high, share) in leaf.path.items():
                w *= (low < row[j] <= high) if j in subset else share
            out += w * leaf.value
        return out

    out = np.zeros((f, n_classes))
    for j in range(f):
        rest = [i for i in range(f) if i != j]
        for size in range(f):
            for s in combinations(rest, size):
                share = factorial(size) * factorial(f - size - 1) / factorial(f)
                out[j] += share * (known({*s, j}) - known(set(s)))
    return out


def test_contributions_of_boosted_trees_add_up(spark, rows):
    model = boosting.fit_boosted(rows, "y", "id", 3, [boosting.Plan("x", "whole", 3, 5)], boosting.Settings(rounds=4, step=0.5))[0]
    leaves = list(paths.ensemble_leaves(model))
    told = paths.contributions(leaves, X, 3)
    assert told.sum(1) + paths.expected(leaves) == pytest.approx(model.margins(X), abs=1e-9)
    for i in (0, 17, 200):
        assert told[i] == pytest.approx(_shapley(leaves, X[i], 3), abs=1e-9)
    spread = paths.with_contributions(rows.select("id", "x"), "x", leaves, 3)
    got = {r["id"]: np.array(r["contributions"]) for r in spread.collect()}
    assert len(got) == spread.count() == len(Y)  # no row is multiplied
    assert all(got[i] == pytest.approx(told[i]) for i in got)
    assert paths.with_contributions(rows.limit(0).select("id", "x"), "x", leaves, 3).count() == 0


@pytest.fixture(scope="module")
def ready(rows):
    return rows.select("id", "y", array_to_vector("x").alias("features")).cache()


def test_contributions_of_a_forest_add_up_to_its_probabilities(ready):
    forest = mm.Forest(trees=7, max_depth=4, seed=3).fit(ready, "y", 3)
    told = {r["id"]: np.array(r["contributions"]) for r in forest.with_contributions(ready.select("id", "features"), 3).collect()}
    shares = forest.model.transform(ready).select("id", vector_to_array("probability").alias("p")).collect()
    base = shares[0]["p"] - told[shares[0]["id"]].sum(0)
    for r in shares:
        assert told[r["id"]].sum(0) + base == pytest.approx(np.array(r["p"]), abs=1e-9)


@pytest.mark.parametrize(
    "candidate", [mm.OrdinalLogit(alpha=0.1), mm.Boosted(rounds=3, max_depth=2, step=0.5), mm.Forest(trees=3, max_depth=3)], ids=lambda c: type(c).__name__
)
def test_a_saved_model_predicts_the_same(spark, ready, tmp_path, candidate):
    fitted = candidate.fit(ready, "y", 3)
    fitted.save(str(tmp_path / "m"), spark)
    again = type(candidate).load(str(tmp_path / "m"), spark)
    columns = ["id", "predicted_code", *[f"proba_{k}" for k in range(3)]]
    before = fitted.predict(ready, 3).select(*columns).orderBy("id").collect()
    assert before == again.predict(ready, 3).select(*columns).orderBy("id").collect()


TASK = mv.Task(key="id", y="y", n_classes=3, seed=1, outer_folds=3, inner_folds=2, test_size=0.25)


@pytest.fixture(scope="module")
def table(spark):
    data = [
        (i, int(Y[i]), float(X[i, 0]) if i % 9 else None, float(X[i, 1]), float(X[i, 2]), "ab"[i % 2] if i % 7 else None, int(X[i, 0] > 0))
        for i in range(len(Y))
    ]
    return spark.createDataFrame(data, "id long, y int, a double, b double, c double, kind string, rule int").cache()


@pytest.fixture(scope="module")
def cut(table):
    marked, sets = ms.with_roles(table, TASK)
    return marked.cache(), sets


def test_roles_cut_every_set_apart(cut):
    marked, sets = cut
    assert set(sets) == {"outer1", "outer2", "outer3", "final"} and all(len(v) == 2 for v in sets.values())
    got = {r["id"]: r for r in marked.collect()}
    test = {i for i, r in got.items() if r["role_final"] == 2}
    assert abs(len(test) - len(Y) / 4) <= 2
    judged = [{i for i, r in got.items() if r[f"role_outer{k}"] == 2} for k in (1, 2, 3)]
    assert set.union(*judged) == set(got) - test and sum(map(len, judged)) == len(got) - len(test)
    for name, inner in sets.items():
        train = {i for i, r in got.items() if r[f"role_{name}"] == 1}
        parts = [{i for i, r in got.items() if r[f"role_{n}"] == 2} for n in inner]
        assert set.union(*parts) == train and not parts[0] & parts[1]
        for n, part in zip(inner, parts, strict=True):
            assert {i for i, r in got.items() if r[f"role_{n}"] == 1} == train - part
            for k in range(3):  # class shares are kept
                assert abs(sum(Y[i] == k for i in part) - sum(Y[i] == k for i in train) / 2) <= 1


def test_design_equals_a_preprocessor_of_the_training_rows(table, cut):
    marked, _ = cut
    designed, labels = ms.designed(marked, ["final", "outer1"], ["a", "b", "c"], ["kind"])
    for name in ("final", "outer1"):
        train = marked.where(F.col(f"role_{name}") == 1).select("a", "b", "c", "kind")
        alone = mm.fit_preprocessor(train, ["a", "b", "c"], ["kind"])
        assert labels[name] == alone.names
        expected = {r["id"]: r["features"].toArray() for r in alone.transform(table).collect()}
        for r in designed.collect():
            assert np.array(r[f"x_{name}"]) == pytest.approx(expected[r["id"]], abs=1e-6)


def test_nested_search(table, cut):
    registry = {
        "ordinal_logit": [mm.OrdinalLogit(alpha=a) for a in (0.01, 30.0)],
        "boosted_trees": [mm.Boosted(rounds=3, max_depth=d, step=0.5, seed=1) for d in (1, 2)],
        "random_forest": [mm.Forest(trees=3, max_depth=d, seed=1) for d in (2, 4)],
    }
    found = ms.nested_search(table, registry, TASK, "toy", "rule")
    summary = {r["model"]: r for r in found.summary.collect()}
    assert set(summary) == {*registry, "rule_baseline"}
    assert all(0.3 < r["development_f1_macro"] <= 1 for n, r in summary.items() if n != "rule_baseline")
    marked, _ = cut
    dev = {r["id"] for r in marked.where("role_final = 1").collect()}
    for family in registry:
        outer = found.outer[family].collect()
        assert sorted(r["id"] for r in outer) == sorted(dev) and {r["outer_fold"] for r in outer} == {1, 2, 3}
        assert {r["id"] for r in found.final[family].collect()} == set(range(len(Y))) - dev
        assert [c["set"] for c in found.chosen[family]] == ["outer1", "outer2", "outer3", "final"]


def test_models_on_cells_equal_models_on_rows(rows, monkeypatch):
    from noteframe.ml import cells

    told = boosting.Settings(rounds=6, step=0.3)
    coarse = rows.withColumn("x", F.expr("transform(x, v -> round(v * 2) / 2)")).withColumn("none", F.lit(0))
    plans = [boosting.Plan("x", r, d, s) for r, d, s in (("part", 2, 1), ("whole", 3, 2), ("part", 3, 1), ("none", 1, 1))]
    grown_on_rows = boosting._grown_on_rows

    def refused(*_):
        raise AssertionError("a small set was fitted pass by pass")

    monkeypatch.setattr(boosting, "_grown_on_rows", refused)
    on_cells = boosting.fit_boosted(coarse, "y", "id", 3, plans, told)
    monkeypatch.setattr(boosting, "_grown_on_rows", grown_on_rows)
    monkeypatch.setattr(cells, "CELLS", 2)  # too many cells for one task
    on_rows = boosting.fit_boosted(coarse, "y", "id", 3, plans, told)
    for a, b in zip(on_cells, on_rows, strict=True):
        assert a.margins(X) == pytest.approx(b.margins(X), abs=1e-9)
        assert a.cover == pytest.approx(b.cover, abs=1e-9)


def test_cells_keep_every_row_of_a_set(rows):
    from noteframe.ml import cells

    edges = {("x", "part"): [np.array([-0.5, 0.5])] * 4, ("x", "whole"): [np.array([0.0])] * 4}
    folded = cells.fold(rows, "y", "id", edges, 1, lambda ids: np.ones((len(ids), 1), np.uint8), lambda one, role: one * (role == 1)[:, None])
    parts = folded.table.toArrow()
    for i, (pair, use) in enumerate(zip(edges, (np.arange(len(Y)) % 4 != 0, np.ones(len(Y), bool)), strict=True)):
        some = parts.filter([v == i for v in parts["pair"].to_pylist()])
        _, bins, cell, label, counts = cells.sorted_cells(some, 1, 4)
        found = {(*bins[c].tolist(), int(k)): int(n) for c, k, n in zip(cell, label, counts[:, 0])}
        expected = {}
        for x, y in zip(cells.binned(X[use], edges[pair]), Y[use]):
            expected[*x.tolist(), int(y)] = expected.get((*x.tolist(), int(y)), 0) + 1
        assert found == expected
    assert folded.cells == max(sum(n for n, p in zip(parts["n"].to_pylist(), parts["pair"].to_pylist()) if p == i) for i in (0, 1))
    wide = np.arange(60).reshape(2, 30) % 32
    assert (cells.unpacked(cells.packed(wide), 30) == wide).all()


def test_a_tree_cut_lower_is_the_beginning_of_the_deeper_one():
    from noteframe.ml import forests

    x = np.column_stack([np.arange(32).repeat(4), np.tile(np.arange(4), 32)]).astype(np.uint8)
    y, n, weight = (x[:, 0] // 8 + x[:, 1] % 2) % 3, np.full(128, 3), np.ones(3)
    told = lambda leaf, depths: forests.grow(x, y, n, weight, x, leaf, depths, np.random.default_rng([4, 2]))
    both = told(1, [2, 30])
    assert (both[2] == told(1, [2])[2]).all() and len(np.unique(both[2], axis=0)) <= 4
    drawn = np.random.default_rng([4, 2]).poisson(n) > 0
    assert (both[30][drawn].argmax(1) == y[drawn]).all() and (both[30][drawn].max(1) == 1).all()  # pure leaves
    assert np.allclose(both[2].sum(1), 1)
    assert len(np.unique(told(200, [30])[30], axis=0)) == 1  # no side may be that small
    assert len(np.unique(told(40, [30])[30], axis=0)) <= n.sum() * 2 // 40


def test_the_best_split_of_a_node_is_the_best_of_all():
    from noteframe.ml import forests

    rng = np.random.default_rng(2)
    weight = np.array([1.0, 2.0, 0.5])
    for size, nodes in ((400, 2), (60, 20)):  # by dense sums, and by sorting
        x, y, n, at = rng.integers(0, 32, (size, 3)), rng.integers(0, 3, size), rng.integers(1, 4, size).astype(float), rng.integers(0, nodes, size)
        total = np.zeros((nodes, 3))
        np.add.at(total, (at, y), n)
        top, feature, bin_ = forests._best(x, y, n, at, total, weight, np.tile([2, 0], (nodes, 1)), 5)
        for node in range(nodes):
            def gain(f, b):
                sides = [np.bincount(y[m], n[m], 3) for m in ((at == node) & (x[:, f] <= b), (at == node) & (x[:, f] > b))]
                if min(s.sum() for s in sides) < 5:
                    return 0.0
                return sum(((s * weight) ** 2).sum() / (s * weight).sum() for s in [*sides]) - ((total[node] * weight) ** 2).sum() / (total[node] * weight).sum()

            best = max(gain(f, b) for f in (0, 2) for b in range(32))
            assert top[node] == pytest.approx(max(best, 0.0), abs=1e-9)
            if top[node] > 0:
                assert feature[node] in (0, 2) and gain(feature[node], bin_[node]) == pytest.approx(best)


def test_edges_of_a_feature_that_is_mostly_zero():
    from noteframe.ml import forests

    assert forests.strides(np.array([0, 0, 1, 3.0])).tolist() == [0.5, 2.0]
    skewed = forests.strides(np.concatenate([np.zeros(900), np.arange(1, 125)]))
    assert len(skewed) >= 4 and skewed[0] == 0.5 and skewed.tolist() == sorted(skewed)
    assert len(forests.strides(np.arange(1025.0))) == 31


def test_forests_of_a_search_are_not_fitted_one_by_one(table, monkeypatch):
    from noteframe.ml import cells

    registry = {"random_forest": [mm.Forest(trees=30, max_depth=d, min_leaf=m, seed=1) for d, m in ((None, 1), (3, 5))]}
    fits = []
    fit = mm.Forest.fit
    monkeypatch.setattr(mm.Forest, "fit", lambda self, *a: fits.append(self) or fit(self, *a))
    on_cells = ms.nested_search(table, registry, TASK, "toy")
    assert not fits
    told = ["outer_fold", "id", "predicted_code", "proba_0", "proba_1", "proba_2"]
    rows = on_cells.outer["random_forest"].select(*told).collect()
    assert all(abs(sum(r[3:]) - 1) < 1e-9 for r in rows)
    monkeypatch.setattr(cells, "CELLS", 2)  # too many cells for one task
    small = {"random_forest": [mm.Forest(trees=30, max_depth=6, seed=1)]}
    on_rows = ms.nested_search(table, small, TASK, "toy")
    assert len(fits) == 4
    a, b = (r.summary.first() for r in (on_cells, on_rows))
    assert abs(a["development_f1_macro"] - b["development_f1_macro"]) < 0.1
