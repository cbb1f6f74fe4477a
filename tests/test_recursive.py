"""Recursive forecasts of boosted trees against a plain loop, and Shapley values against all subsets."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tests.test_automodels import panel_of
from tsforge.operators import automodels, recursive, trees
from tsforge.operators.runs import run_forecasters
from tsforge.panel import Panel
from tsforge.spec import BacktestPlan, PanelSpec

CONFIG = recursive.TargetFeatures(lags=(1, 2, 7), windows=(3, 7), stats=("mean", "std", "min", "max", "median"), diffs=(1, 7), rates=(1,), shift=2)


@pytest.fixture(scope="module")
def panel(spark):
    t, rng = np.arange(150), np.random.default_rng(3)
    a, b = 20 + 5 * np.sin(2 * np.pi * t / 7) + rng.normal(size=150), 50 + 0.1 * t + rng.normal(size=150)
    a[[20, 21, 149]] = np.nan
    return panel_of(spark, {"a": a, "b": b, "short": np.arange(5.0)})


@pytest.fixture(scope="module")
def fitted(panel, tmp_path_factory):
    model, rows, names = recursive.fit(panel, CONFIG, rounds=8, depth=3)
    return model, rows, names, trees.forest_of(model, str(tmp_path_factory.mktemp("trees")))


def test_exported_trees_predict_like_the_model(fitted):
    model, rows, names, forest = fitted
    got = model.transform(VectorAssembler(inputCols=names, outputCol="inputs").transform(rows)).toPandas()
    assert len(got) and forest.predict(got[names].to_numpy(float)) == pytest.approx(got["prediction"].to_numpy())
    assert forest.mean() == pytest.approx(sum(w * t.predict(got[names].to_numpy(float)).mean() for t, w in zip(forest.trees, forest.weights, strict=True)), rel=1e-6)


def row_features(values, ds):
    """The inputs of the row behind ``values``, written out anew."""
    s = pd.Series(values)
    lags = [s.iloc[-k] for k in (1, 2, 7)]
    rolled = [getattr(s.iloc[-1 - w : -1], stat)() for w in (3, 7) for stat in ("mean", "std", "min", "max", "median")]
    moved = [s.iloc[-2] - s.iloc[-3], s.iloc[-2] - s.iloc[-9]]
    return [*lags, *rolled, *moved, s.iloc[-2] / s.iloc[-3] - 1, ds.hour, ds.weekday(), ds.month, float(ds.weekday() >= 5)]


def test_design_equals_the_features_of_tails(panel, fitted):
    _, rows, names, _ = fitted
    got = rows.where("unique_id = 'a'").toPandas().set_index("ds")
    values = panel.df.where("unique_id = 'a'").orderBy("ds").toPandas()
    filled = values["y"].ffill().to_numpy()
    assert set(got.index) == {d for k, d in enumerate(values["ds"]) if k >= 9 and not math.isnan(values["y"][k])} and CONFIG.width == 9
    for k in (9, 25, 60, 148):
        assert got.loc[values["ds"][k], names].to_numpy(float) == pytest.approx(row_features(filled[:k], values["ds"][k]))
        assert CONFIG.of_tails(filled[None, k - 9 : k])[0] == pytest.approx(row_features(filled[:k], values["ds"][k])[:-4])


def test_forecasts_feed_on_themselves(panel, fitted):
    forest = fitted[3]
    cutoff = panel.df.agg(F.max("ds")).first()[0]
    got = recursive.forecast(panel, CONFIG, forest, cutoff, steps=10).toPandas()
    assert set(got["unique_id"]) == {"a", "b"}
    for name, part in got.groupby("unique_id"):
        values = panel.df.where(F.col("unique_id") == name).orderBy("ds").toPandas()["y"].ffill().tolist()
        for r in part.sort_values("ds").itertuples():
            values.append(forest.predict(np.array([row_features(values, r.ds)]))[0])
            assert r.y_hat == pytest.approx(values[-1])
        assert len(part) == 10 and part["ds"].min() == cutoff + pd.Timedelta(days=1)


def test_windows_and_intervals(spark, panel, tmp_path):
    plan = BacktestPlan(h=3, n_windows=2, gap=1)
    made = recursive.forecaster(CONFIG, str(tmp_path / "models"), rounds=3, depth=2)
    two = panel.select_ids(["a", "b"])
    run = run_forecasters(two, plan, {"recursive": automodels.calibrated(made, h=3, gap=1, quantiles=plan.quantiles)}, str(tmp_path / "runs"))
    got = run.forecasts.toPandas()
    assert len(got) == 12 and set(got["h_step"]) == {1, 2, 3} and (got["q_9000"] >= got["q_1000"]).all() and got["q_2500"].isna().all()
    with pytest.raises(ValueError):
        recursive.TargetFeatures(stats=("mode",))
    with pytest.raises(ValueError):
        recursive.TargetFeatures(lags=(0,))


def conditional(tree, x, known, node=0):
    """What the tree gives if only ``known`` features are."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    left, right = int(tree.left[node]), int(tree.right[node])
    if f in known:
        return conditional(tree, x, known, left if x[f] <= tree.threshold[node] else right)
    return (tree.cover[left] * conditional(tree, x, known, left) + tree.cover[right] * conditional(tree, x, known, right)) / tree.cover[node]


def test_shapley_values_equal_all_subsets(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (300, 5)).astype(float)
    y = x[:, 0] * x[:, 1] + 3 * (x[:, 2] > 2) - x[:, 3] + rng.normal(size=300)
    names = list("abcde")
    rows = spark.createDataFrame([(k, *map(float, v), float(t)) for k, (v, t) in enumerate(zip(x, y, strict=True))], "k long, a double, b double, c double, d double, e double, label double")
    from pyspark.ml.regression import GBTRegressor

    model = GBTRegressor(featuresCol="inputs", labelCol="label", maxIter=4, maxDepth=4, seed=1).fit(VectorAssembler(inputCols=names, outputCol="inputs").transform(rows))
    forest = trees.forest_of(model, str(tmp_path / "m"))
    some = trees.sampled(rows, ["k"], rows=12, seed=5)
    assert [r["k"] for r in some.collect()] == [r["k"] for r in trees.sampled(rows.repartition(7), ["k"], rows=12, seed=5).collect()] and some.count() == 12
    got = trees.shapley_values(some, forest, names, ["k"]).toPandas().pivot(index="k", columns="feature", values="shap")
    for k, shares in got.iterrows():
        worth = lambda known: sum(w * conditional(t, x[k], known) for t, w in zip(forest.trees, forest.weights, strict=True))  # noqa: E731,B023
        for i in range(5):
            others = [j for j in range(5) if j != i]
            want = sum(
                math.factorial(n) * math.factorial(4 - n) / math.factorial(5) * (worth({*s, i}) - worth(set(s)))
                for n in range(5) for s in itertools.combinations(others, n)
            )
            assert shares[names[i]] == pytest.approx(want, abs=1e-9)
        assert shares.sum() + forest.mean() == pytest.approx(forest.predict(x[k : k + 1])[0])
    table = trees.mean_abs_shap(trees.shapley_values(some, forest, names, ["k"])).collect()
    assert [r["feature"] for r in table] == got.abs().mean().sort_values(ascending=False).index.tolist()
    gain = trees.importance(model, names).collect()
    assert sum(r["importance"] for r in gain) == pytest.approx(1) and gain[0]["feature"] in ("a", "b") and len(gain) == 5


def test_a_backtest_reads_the_panel_once(spark, tmp_path):
    """Fits, forecasts and checks read what was written of the panel, not what it is made of."""
    made = spark.sparkContext.accumulator(0)

    def counted(frames):
        for df in frames:
            made.add(len(df))
            yield df

    days = spark.range(200).selectExpr("'a' AS unique_id", "TIMESTAMP_NTZ'2024-01-01 00:00:00' + make_dt_interval(int(id)) AS ds", "CAST(id % 7 AS double) AS y")
    panel = Panel(days.mapInPandas(counted, days.schema), PanelSpec("days", "D", (7,)))
    config = recursive.TargetFeatures(lags=(1, 7), windows=(7,), stats=("mean",), diffs=(1,))
    forecaster = recursive.forecaster(config, str(tmp_path / "trees"), rounds=2, depth=2)
    rows = run_forecasters(panel, BacktestPlan(h=7, n_windows=1), {"m": forecaster}, str(tmp_path / "runs")).forecasts
    assert rows.count() == 7
    assert made.value == 200
