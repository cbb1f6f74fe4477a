"""Stateful scores of a stream: order of time, nulls and what a later micro-batch adds."""

import math

import numpy as np
import pandas as pd
import pytest

from tsforge.streaming import online


def plain_scores(values, half_life=48.0):
    keep, out = 0.5 ** (1 / half_life), []
    for k, y in enumerate(values):
        past = np.array([v for v in values[:k] if v is not None and math.isfinite(v)], float)
        if y is None or not math.isfinite(y):
            out.append(None)
            continue
        w = keep ** np.arange(len(past))[::-1]
        mean = (w @ past) / w.sum() if len(past) else 0.0
        spread = math.sqrt(w @ (past - mean) ** 2 / w.sum()) if len(past) else 0.0
        out.append((y - mean) / spread if len(past) > 2 and spread > 0 else None)
    return out


def test_nulls_count_for_nothing_and_state_carries_on(spark, tmp_path):
    rng = np.random.default_rng(1)
    values = {k: [None if i in (5, 6, 40) else float("nan") if i == 9 else float(v) for i, v in enumerate(rng.normal(10, 2, 60))] for k in ("a", "b")}
    times = pd.date_range("2024-01-01", periods=60, freq="h")
    schema = "unique_id string, ds timestamp, y double"
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for part in (range(35), range(35, 60)):
        rows = [(k, times[i].to_pydatetime(), v[i]) for k, v in values.items() for i in part]
        rng.shuffle(rows)
        rows = [(str(k), t, y) for k, t, y in rows]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        got = online.drained(online.running_z(stream), str(tmp_path / "out"), "scores").toPandas()
    assert len(got) == 120
    for k, v in values.items():
        z = got[got["unique_id"] == k].sort_values("ds")["z"].tolist()
        for mine, want in zip(z, plain_scores(v), strict=True):
            assert pd.isna(mine) if want is None else mine == pytest.approx(want, rel=1e-6)
