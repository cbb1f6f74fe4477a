"""Payload readers, detectors, models and streams on small cases."""

import json
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsforge.operators import detectors, models, quality
from tsforge.panel import Panel
from tsforge.sources import readers
from tsforge.spec import BacktestPlan, LeakError, PanelSpec, VintageError
from tsforge.streaming import online

T0 = datetime(2024, 1, 1)


def test_payloads(spark, tmp_path):
    (tmp_path / "k").mkdir()
    row = lambda h, c: [1704067200000 + h * 3600000, "1", "2", "0", str(c), "9"]
    (tmp_path / "k/1.json").write_text(json.dumps([row(0, 5), row(1, 6)]))
    (tmp_path / "k/2.json").write_text(json.dumps([row(1, 7), row(2, 8)]))
    assert [tuple(r) for r in readers.klines(spark, f"{tmp_path}/k", symbol="X").orderBy("ds").collect()] == [("X", T0, 5.0), ("X", T0 + timedelta(hours=1), 7.0), ("X", T0 + timedelta(hours=2), 8.0)]
    (tmp_path / "w.json").write_text(json.dumps({"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [1.5, None]}}))
    assert [r["temp_c"] for r in readers.weather(spark, f"{tmp_path}/w.json", location="m").orderBy("ds").collect()] == [1.5, None]
    (tmp_path / "g.json").write_text(json.dumps({"included": [{"attributes": {"title": "real", "values": [{"datetime": "2024-01-01T01:00:00.000+01:00", "value": 20.0}]}}, {"attributes": {"title": "plan", "values": []}}]}))
    assert [tuple(r) for r in readers.grid_demand(spark, f"{tmp_path}/g.json", title="real").collect()] == [("ES", T0, 20.0)]
    (tmp_path / "m.csv").write_text(";A;B\n2024-01-01 00:15:00;1,5;2\n2024-01-01 00:30:00;2,5;x\n2024-03-31 01:30:00;9;9\n")
    got = {(r["unique_id"], r["ds"]): r["y"] for r in readers.meters(spark, f"{tmp_path}/m.csv").collect()}
    assert got == {("A", T0): 2.0, ("B", T0): 2.0}


def test_cache_and_bounds(spark, tmp_path):
    a = readers.cache_key("s", T0, T0, ["b", "a"])
    assert a == readers.cache_key("s", T0, T0, ["a", "b"]) != readers.cache_key("s", T0, T0, ["a"])
    calls = []
    fetch = lambda: calls.append(1) or spark.range(3)
    assert readers.cached(spark, str(tmp_path), a, fetch).count() == readers.cached(spark, str(tmp_path), a, fetch).count() == 3 and len(calls) == 1
    with pytest.raises(VintageError):
        readers.require_no_vintage(readers.SourceSpec("s"), T0)
    assert len(readers.date_chunks(T0, T0 + timedelta(days=800))) == 3
    assert readers.out_of_bounds(spark.createDataFrame([(-1.0,), (1.0,), (None,)], "y double"), "meters").count() == 1


def test_old_tables_are_renewed_or_served(spark, tmp_path):
    def gone():
        raise readers.SourceUnavailable

    with pytest.raises(readers.SourceUnavailable):
        readers.cached(spark, str(tmp_path), "k", gone)
    assert readers.cached(spark, str(tmp_path), "k", lambda: spark.range(3), max_age=timedelta(0)).count() == 3
    with pytest.warns(readers.StaleWarning):
        assert readers.cached(spark, str(tmp_path), "k", gone, max_age=timedelta(0)).count() == 3
    assert readers.cached(spark, str(tmp_path), "k", gone).count() == 3
    assert readers.cached(spark, str(tmp_path), "k", lambda: spark.range(5), max_age=timedelta(0)).count() == 5


def test_vintages_are_read_as_of_a_time(spark):
    rows = [("a", T0, T0 + timedelta(days=k), float(k)) for k in range(3)] + [("b", T0, T0, 9.0), ("a", T0 + timedelta(days=5), T0, 7.0)]
    df = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, as_of timestamp_ntz, y double")
    spec, when = readers.SourceSpec("s", vintage_aware=True), {"start": T0, "end": T0 + timedelta(days=1)}
    assert sorted(r["y"] for r in readers.fetched(df, spec, as_of=T0 + timedelta(days=1), **when).collect()) == [1.0, 9.0]
    assert [r["y"] for r in readers.fetched(df, spec, ids=["a"], **when).collect()] == [2.0]


def series(spark, values):
    return spark.createDataFrame([("a", T0 + timedelta(hours=i), float(v)) for i, v in enumerate(values)], "unique_id string, ds timestamp_ntz, y double")


def test_detectors_find_what_stands_out(spark):
    y = np.sin(np.arange(400) * 2 * np.pi / 24)
    y[300:312] = -y[300:312]
    got = detectors.discords(series(spark, y), m=24).toPandas().sort_values("ds").reset_index(drop=True)
    assert 300 <= pd.to_numeric(got["score"]).idxmax() <= 340 and not got["scorable"][:23].any()
    y = np.random.default_rng(0).normal(size=400)
    y[350] = 12
    got = detectors.isolation_forest(detectors.window_features(series(spark, y)), trees=30).toPandas().sort_values("ds").reset_index(drop=True)
    assert pd.to_numeric(got["score"])[350] > 1.5
    flat = np.tile([0.0, 1.0, 2.0, 1.0], 60)
    flat[200] = 9
    errors = detectors.pca_reconstruction(series(spark, flat), length=8, parts=3).toPandas().sort_values("ds")["error"].to_numpy()
    assert 193 <= errors.argmax() <= 200


def test_discords_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    y = rng.normal(size=150).cumsum()
    y[60] = np.nan
    m, best = 8, {}
    z = {}
    for i in range(150 - m + 1):
        w = y[i : i + m]
        if np.isfinite(w).all():
            z[i] = (w - w.mean()) / w.std()
    for i in z:
        best[i] = min(np.sqrt(((z[i] - z[j]) ** 2).sum()) for j in z if abs(i - j) >= m // 2 + 1)
    for block in (512, 16):
        got = detectors.discords(series(spark, y).withColumn("y", F.nanvl("y", F.lit(None))), m=m, block=block).toPandas().sort_values("ds").reset_index(drop=True)
        want = {i + m - 1: -np.log10((1 + sum(d >= best[i] - 1e-9 for d in best.values())) / (len(best) + 1)) for i in best}
        assert set(got.index[got["scorable"]]) == set(want) and set(got["calib_n"]) == {len(best)}
        assert all(abs(float(got["score"][k]) - s) < 1e-6 for k, s in want.items())
    assert not detectors.discords(series(spark, [1.0] * 10), m=8).where("scorable").count()


def test_projection_errors_equal_a_dense_one(spark):
    rng = np.random.default_rng(9)
    y = rng.normal(size=80).cumsum()
    got = detectors.pca_reconstruction(series(spark, y), length=6, parts=2).toPandas().sort_values("ds")["error"].to_numpy()
    x = (y - y.mean()) / y.std()
    w = np.lib.stride_tricks.sliding_window_view(x, 6)
    axes = np.linalg.eigh(np.cov(w.T))[1][:, -2:]
    np.testing.assert_allclose(got, ((w - w @ axes @ axes.T) ** 2).mean(axis=1), atol=1e-9)


def test_tails_bridge_frames_and_severity(spark):
    rows = series(spark, range(40))
    early, late = rows.where(F.col("y") < 30), rows.where(F.col("y") >= 30)
    both = detectors.bridged(late, detectors.tails(rows.where(F.col("y") < 32), 7))
    assert sorted((r["y"], r["borrowed"]) for r in both.collect()) == [(float(v), v < 30) for v in range(25, 40)]
    whole = {r["ds"]: r["zscore"] for r in detectors.window_features(rows, window=6).where("usable").collect()}
    parts = detectors.window_features(detectors.bridged(late, detectors.tails(early, 8)).drop("borrowed"), window=6).where("usable").collect()
    assert len([r for r in parts if r["ds"] in whole]) >= 10 and all(whole[r["ds"]] == r["zscore"] for r in parts)
    pool = spark.createDataFrame([(float(v),) for v in range(21)], "value double")
    got = [r["severity"] for r in detectors.pool_severity(spark.createDataFrame([(19.0,), (26.413,), (None,)], "value double"), pool).collect()]
    assert got[0] == 0.0 and abs(got[1] - 1.0) < 1e-9 and got[2] is None


def test_series_models_by_window(spark):
    rng = np.random.default_rng(10)
    y = 20 + np.tile([0, 3, 1, 5, 2, 4, 6], 12) + rng.normal(size=84)
    days = spark.createDataFrame([("a", T0 + timedelta(days=i), float(v)) for i, v in enumerate(y)], "unique_id string, ds timestamp_ntz, y double")
    plan = BacktestPlan(h=5, n_windows=2)
    got = {(r["model_id"], r["window_id"], r["h_step"]): (r["y_hat"], r["ds"]) for r in models.backtest_series(Panel(days, PanelSpec("t", "D", (7,))), plan).collect()}
    for w, end in enumerate((74, 79)):
        for name, model in models.MODELS.items():
            want = model(y[:end], 5, 7)
            assert all(got[name, w, k + 1] == (want[k], T0 + timedelta(days=end + k)) for k in range(5))


def test_tuning_uses_development_windows_alone(spark, tmp_path):
    y = [float(i % 5) for i in range(40)] + [500.0] * 10
    days = spark.createDataFrame([("a", T0 + timedelta(days=i), v) for i, v in enumerate(y)], "unique_id string, ds timestamp_ntz, y double")
    panel = Panel(days, PanelSpec("t", "D", (5,)))

    def constant(level):
        def forecast(train, window, ahead):
            assert train.df.agg(F.max("y")).first()[0] < 500
            return ahead.select("unique_id", "ds", F.lit(level).alias("y_hat"))

        return forecast

    def nothing(train, window, ahead):
        return ahead.limit(0).select("unique_id", "ds", F.lit(0.0).alias("y_hat"))

    plan = BacktestPlan(h=5, n_windows=4, holdout_windows=2)
    got = models.tune(panel, plan, {"two": constant(2.0), "nine": constant(9.0), "none": nothing}, str(tmp_path), metric="mae")
    assert got.best == "two" and got.n_windows == 2 and [r["model_id"] for r in got.table.collect()] == ["two", "nine", "none"]


def test_closed_schema(spark):
    rows = spark.createDataFrame([("a", "2024-01-01 00:00:00", "5"), ("a", "2024-01-01 00:00:00", "-1"), (None, "later", "x"), ("b", "2024-01-02 00:00:00", None)], "unique_id string, ds string, y string")
    cast, broken = quality.raw_schema(rows, {"y": (0.0, 100.0)})
    assert dict(cast.dtypes) == {"unique_id": "string", "ds": "timestamp_ntz", "y": "double"}
    assert {r["rule"]: r["n_violations"] for r in broken.collect()} == {
        "unique_id is known": 1, "ds is timestamp_ntz": 1, "ds is known": 1, "y is double": 1, "one row for each series and ds": 1, "y lies within its bounds": 1,
    }
    assert quality.raw_schema(rows.withColumn("z", F.lit(1)), {"y": (None, None)})[1].count() == 1
    assert quality.raw_schema(cast, {"y": (-5.0, None)}, coerce=False)[1].where("rule like '%is double'").count() == 0
    assert quality.hourly_step(series(spark, [1, 2, 3])) == 1.0 and quality.hourly_step(series(spark, [1])) == 1.0


def test_forest_pool_is_every_later_row(spark):
    y = np.random.default_rng(3).normal(size=400)
    y[100] = 40
    rows = detectors.window_features(series(spark, y))
    got = detectors.isolation_forest(rows, trees=20, train_rows=50).toPandas().sort_values("ds").reset_index(drop=True)
    usable = sorted(r["ds"] for r in rows.where("usable").collect())
    later = got["ds"] > usable[round(len(usable) * 0.7) - 1]
    n = int(later.sum())
    assert set(got["calib_n"]) == {n} and 50 < n == len(usable) - round(len(usable) * 0.7) and got["scorable"].sum() == len(usable)
    pool = pd.to_numeric(got["score"][later]).to_numpy()
    # A pool row's own p-value counts the pool rows that score as high or higher.
    assert np.allclose(10.0**-pool * (n + 1) - 1, [(pool >= s - 1e-9).sum() for s in pool])
    assert np.isclose(float(got["score"][100]), np.log10(n + 1)) and not got["score"][~got["scorable"]].notna().any()
    none = detectors.isolation_forest(rows.limit(0)).toPandas()
    one = detectors.isolation_forest(rows.where("usable").limit(1)).toPandas()
    assert len(none) == 0 and len(one) == 1 and not one["scorable"].any()


def test_online_conformal_keeps_its_rate(spark):
    rng = np.random.default_rng(1)
    rows = [("a", T0 + timedelta(hours=24 * w + h), T0 + timedelta(hours=24 * w - 1), float(rng.normal())) for w in range(60) for h in range(24)]
    frame = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, cutoff timestamp_ntz, residual double")
    got = detectors.online_conformal(frame).toPandas()
    scored = got[got["scorable"]]
    assert 0.03 < (pd.to_numeric(scored["score"]) >= -np.log10(0.05)).mean() < 0.07 and scored["calib_n"].min() >= 50


def test_models_follow_a_season():
    y = 10 + np.tile([0, 1, 2, 3, 2, 1, 0], 30) + 0.0
    for model in models.MODELS.values():
        assert np.abs(model(y, 7, 7) - y[:7]).max() < 0.5


def test_streams(spark, tmp_path):
    rows = series(spark, [1.0, 2.0, 1.5, 2.5, 40.0, 1.0]).withColumn("ds", F.col("ds").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    source = lambda: spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for name, df in (("hours", online.hourly(source())), ("scores", online.running_z(source()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        q.stop()
    assert spark.table("scores").count() == 6 and spark.table("scores").orderBy(F.desc_nulls_last("z")).first()["y"] == 40.0
    assert spark.table("hours").where("n = 1").count() >= 2


@pytest.mark.parametrize("window", [6, 7])
def test_spectral_energy_of_windows(spark, window):
    values = np.random.default_rng(3).normal(size=40) * 3 + 5
    rows = spark.createDataFrame([("a", pd.Timestamp("2024-01-01").to_pydatetime() + timedelta(hours=k), float(v)) for k, v in enumerate(values)], "unique_id string, ds timestamp_ntz, y double")
    got = detectors.window_features(rows, window=window).orderBy("ds").toPandas()["energy"].to_numpy()
    for k in range(window - 1, 40):
        w = values[k - window + 1 : k + 1]
        assert got[k] == pytest.approx((np.abs(np.fft.rfft(w - w.mean())) ** 2).sum() / window)


def test_later_stretches_against_known_ones(spark):
    rng = np.random.default_rng(6)
    series = {"a": rng.normal(size=130), "b": np.sin(np.arange(130) / 3) + 0.1 * rng.normal(size=130)}
    series["a"][[20, 101]] = np.nan
    at = lambda k: datetime(2024, 1, 1) + timedelta(hours=k)
    rows = spark.createDataFrame([(n, at(k), float(v)) for n, y in series.items() for k, v in enumerate(y)] + [("new", at(k), float(k % 5)) for k in range(90, 130)], "unique_id string, ds timestamp_ntz, y double")
    cut, m = at(90), 8
    known, later = rows.where(F.col("ds") < F.lit(cut)), rows.where(F.col("ds") >= F.lit(cut))
    got = {(r["unique_id"], r["ds"]): r for r in detectors.discords_behind(known, later, m=m, block=32).collect()}
    assert len(got) == 120 and not any(r["scorable"] for (n, _), r in got.items() if n == "new")

    def shape(w):
        return None if not np.isfinite(w).all() else (w - w.mean()) / max(w.std(), 1e-12) if w.std() > 1e-12 else np.zeros(m)

    for name, y in series.items():
        shapes = [shape(y[k : k + m]) for k in range(130 - m + 1)]
        dist = lambda i, j: np.linalg.norm(shapes[i] - shapes[j])  # noqa: E731,B023
        near = lambda i: min((dist(i, j) for j in range(90 - m + 1) if shapes[j] is not None and abs(i - j) >= m // 2 + 1), default=None)  # noqa: E731,B023
        pool = [near(i) for i in range(90 - m + 1) if shapes[i] is not None]
        for k in range(90, 130):
            r, i = got[name, at(k)], k - m + 1
            assert r["scorable"] == (shapes[i] is not None)
            if shapes[i] is not None:
                assert r["calib_n"] == len(pool) and r["score"] == pytest.approx(-np.log10((1 + sum(p >= near(i) - 1e-9 for p in pool)) / (len(pool) + 1)), abs=1e-9)
    with pytest.raises(LeakError):
        detectors.discords_behind(rows, later, m=m)
