"""Boosting: rounds that stop, leaves in closed form, samples that do not depend on partitions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorSlicer

from panelwright.operators import learn

NAMES = ["a", "b", "c"]
SMALL = {"maxDepth": 3, "minInstancesPerNode": 4, "maxBins": 16}


def panel(spark, days=12, stocks=40, noise=0.3, seed=3):
    draw = np.random.default_rng(seed)
    rows = []
    for day in range(days):
        x = draw.standard_normal((stocks, 3))
        y = x[:, 0] + 0.5 * np.sign(x[:, 1]) + noise * draw.standard_normal(stocks)
        rows += [(20240101 + day, f"{i:06d}", *map(float, x[i]), float(y[i])) for i in range(stocks)]
    return spark.createDataFrame(rows, "Date int, Code string, a double, b double, c double, target double")


def numbers(frame):
    rows = frame.orderBy("Date", "Code").toPandas()
    return rows[NAMES].to_numpy(), rows["target"].to_numpy()


def leaf_of(tree, x):
    node = np.zeros(len(x), int)
    for _ in range(tree.depth):
        node = np.where(x[np.arange(len(x)), tree.feature[node]] <= tree.threshold[node], tree.left[node], tree.right[node])
    return node


def test_training_stops_long_before_the_last_round(spark):
    data = panel(spark, noise=0.0)
    nothing = data.selectExpr("Date", "Code", "a", "b", "c", "cast(pmod(xxhash64(Code, Date), 1000) AS double) AS target")  # no feature helps
    model, history = learn.train_on_panel(nothing.filter("Date < 20240109"), nothing.filter("Date >= 20240109"), NAMES, "target", patience=3, block=4, maxIter=5000, stepSize=0.3, **SMALL)
    rounds = {r["round"]: r.daily_ic for r in history.collect()}
    assert model.fitted == len(rounds) <= 40  # of 5000
    best = model.getNumTrees
    assert rounds[best] == max(rounds[r] for r in range(1, min(model.fitted, best + 3) + 1))
    assert model.fitted - best < 3 + 4 + 4


@pytest.mark.parametrize("preset,penalties", [("lgb", {}), ("xgb", {}), ("xgb", {"leafL1": 4.0, "leafL2": 10.0})])
def test_leaves_have_the_closed_form(spark, preset, penalties):
    data = panel(spark)
    model, _ = learn.train_on_panel(data, data, NAMES, "target", preset, patience=9, block=2, maxIter=3, stepSize=0.2, rowFraction=1.0, featureFraction=1.0, **SMALL, **penalties)
    params = learn.tree_params(preset, **penalties)
    x, y = numbers(data)
    margin = np.full(len(y), y.mean())  # no tree weighs more than the step
    assert model.start == pytest.approx(y.mean())
    for tree in model.trees:
        node, residual = leaf_of(tree, x), y - margin
        assert set(node) <= set(tree.leaves) and len(tree.leaves) > 2
        for leaf in set(node):
            total, n = residual[node == leaf].sum(), (node == leaf).sum()
            want = np.sign(total) * max(abs(total) - params["leafL1"], 0) / (n + params["leafL2"])
            assert tree.value[leaf] == pytest.approx(want, abs=1e-9)
        margin = margin + 0.2 * tree.value[node]
    scored = learn.predict(model, data, NAMES).orderBy("Date", "Code").toPandas()
    np.testing.assert_allclose(scored["prediction"], margin, atol=1e-9)


def test_printed_tree_is_the_fitted_tree(spark):
    data = learn.feature_vectors(panel(spark), NAMES, "target").withColumn("_margin", learn.F.lit(0.0))
    params = learn.tree_params("lgb", featureFraction=0.67, rowFraction=1.0, **SMALL)
    grown, tree = learn.grow_tree(data, 3, params, "target", 7, 1)
    assert len(grown.chosen) == 2
    sliced = VectorSlicer(inputCol="features", outputCol="x", indices=grown.chosen).transform(data)
    grown.model.setFeaturesCol("x").setPredictionCol("p").setLeafCol("leaf")
    rows = grown.model.transform(sliced).orderBy("Date", "Code").toPandas()
    x = np.array([v.toArray() for v in rows["features"]])
    assert [list(tree.leaves).index(n) for n in leaf_of(tree, x)] == rows["leaf"].astype(int).tolist()


def test_a_round_derives_its_rows_once(spark):
    data = learn.feature_vectors(panel(spark), NAMES, "target").withColumn("_margin", learn.F.lit(0.0)).repartition(3)
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    learn.grow_tree(data.mapInArrow(counted, data.schema), 3, learn.tree_params("lgb", rowFraction=1.0, **SMALL), "target", 7, 1)
    assert seen.value == 12 * 40


def test_samples_do_not_depend_on_partitions(spark):
    data = panel(spark).select("Date", "Code")
    draws = [{(r.Date, r.Code) for r in learn._sampled(data.repartition(n), 0.8, 5, 2).collect()} for n in (1, 7)]
    assert draws[0] == draws[1] and 0.7 < len(draws[0]) / 480 < 0.9
    assert draws[0] != {(r.Date, r.Code) for r in learn._sampled(data, 0.8, 5, 3).collect()}


def test_names_and_settings_are_checked(spark):
    with pytest.raises(ValueError, match="no tree preset"):
        learn.tree_params("cat")
    with pytest.raises(ValueError, match="colour"):
        learn.tree_params("lgb", colour=1)
    with pytest.raises(ValueError, match="other features"):
        learn.predict(learn.Ensemble(["a"], 0.0, 0.1), panel(spark, 1, 2), NAMES)


def test_the_fitting_queries_take_the_presets_as_they_are(spark, monkeypatch):
    from checks import catalog

    asked = []
    monkeypatch.setattr(catalog, "daily_model_panel", lambda *_: spark.range(1))
    monkeypatch.setattr(catalog, "daily_calendar", lambda *_: spark.range(1))
    monkeypatch.setattr(catalog, "roles_of", lambda days: days)
    monkeypatch.setattr(catalog.universe, "split_samples", lambda *_: None)
    monkeypatch.setattr(learn, "boost", lambda train, valid, names, target, preset, patience, seed, block, **changed: asked.append((learn.tree_params(preset, **changed), patience)) or (None, None))
    monkeypatch.setattr(learn, "feature_vectors", lambda *_: None)
    assert len(list(catalog._fitted(spark, "", [("lgb", "F1"), ("xgb", "F2")]))) == 2
    assert asked == [(learn.PRESETS["lgb"], 50), (learn.PRESETS["xgb"], 50)] and {p["maxIter"] for p, _ in asked} == {5000}


def test_training_scores_are_carried_over_writes(spark, tmp_path, monkeypatch):
    data = panel(spark, days=4, stocks=30)
    settings = {"patience": 20, "maxIter": 6, "stepSize": 0.2, "rowFraction": 1.0, "featureFraction": 1.0, **SMALL}
    made = {}
    for every in (2, 99):
        monkeypatch.setattr(learn, "CARRY", every)
        gone = []
        monkeypatch.setattr(learn, "unstage", lambda frame, kept=learn.unstage: gone.append(frame) or kept(frame))
        model, _ = learn.train_on_panel(data, data, NAMES, "target", block=3, **settings)
        made[every] = [t.value for t in model.trees]
        monkeypatch.undo()
        assert len(gone) == (3 if every == 2 else 1) and not any(_there(spark, f) for f in gone)
    assert len(made[2]) == len(made[99]) and all(np.allclose(a, b) for a, b in zip(made[2], made[99]))


def _there(spark, frame):
    try:
        return frame.count() >= 0
    except Exception:
        return False
