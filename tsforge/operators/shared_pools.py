"""Adaptive conformal scores whose widest pools are shared by all series.

A series alone may lack residuals; the pools of an hour bin and of everything have those of all
series. What is in them at a cutoff depends on what every series had learned by then, so the work is
a fold over cutoffs (a plan's windows), each one a pass over all series: a series judges its rows of
one cutoff by the shared state as it stands, then learns what the next cutoff knows. What the series
give to the shared pools is ranked and cut to the pools' size in Spark, so the shared state is
``(hour_bins + 1) * pool`` residuals and a level for each of a fixed number of error rates, however
many series there are; that is all the driver holds and sends out.

Levels of a shared group take all errors of a cutoff at once: they move by their sum and are
clipped once. The latest residuals stay in a pool, by their time, then by series.
"""

from __future__ import annotations

import uuid
from bisect import insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.operators.adaptive import HIGHEST, LOWEST, Along, _how, with_groups

KINDS = "unique_id string, kind string, ds timestamp_ntz, score double, scorable boolean, severity double, calib_n int, judged string, state string, pool string, at double, r double, flag int"
COLUMNS = [c.split()[0] for c in KINDS.split(", ")]


class Pools:
    """The shared state: the latest residuals of each group, and its levels."""

    def __init__(self, most: int, grid: np.ndarray, gamma: float):
        self.most, self.grid, self.gamma = most, grid, gamma
        self.held: dict[str, list[tuple[float, str, float]]] = {}
        self.levels: dict[str, np.ndarray] = {}

    def now(self) -> dict[str, tuple[list[float], np.ndarray]]:
        names = set(self.held) | set(self.levels)
        return {g: (sorted(r for *_, r in self.held.get(g, [])), self.levels.get(g, self.grid)) for g in names}

    def take(self, given: list[tuple[str, float, str, float]], missed: list[tuple[str, int, int]]) -> None:
        """``given``: (group, at, series, residual), at most as many a group as a pool holds;
        ``missed``: (group, first level that flagged, how many rows)."""
        for g, at, series, r in given:
            insort(self.held.setdefault(g, []), (at, series, r))
        self.held = {g: v[-self.most :] for g, v in self.held.items()}
        moves: dict[str, np.ndarray] = {}
        for g, first, n in missed:
            moves[g] = moves.get(g, 0) + n * (self.grid - (np.arange(len(self.grid)) >= first))
        for g, move in moves.items():
            self.levels[g] = np.clip(self.levels.get(g, self.grid) + self.gamma * move, LOWEST, HIGHEST)


def shared_adaptive_scores(rows: DataFrame, folder: str, **how) -> tuple[DataFrame, DataFrame]:
    """(scores, states): scores are unique_id, ds, score, scorable, severity, calib_n and the group
    that judged; states are each series' own behind the last cutoff. ``rows`` has unique_id, ds,
    cutoff and residual; settings are those of ``adaptive_scores``, of which ``pool`` must be given.
    Rows without a cutoff or residual aren't scored. ``folder`` is one that all executors share."""
    how = _how(**how)
    if not how["pool"]:
        raise ValueError("shared pools need a size")
    spark = rows.sparkSession
    settings = {k: how[k] for k in ("gamma", "alpha", "pool", "min_calibration", "freeze_after", "max_freeze")}
    placed = with_groups(rows, **{k: how[k] for k in ("step", "tz", "hour_bins", "lead_bins")}).select("unique_id", "ds", "cutoff", "residual", "hour", "hour_bin", "lead_bin")
    path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}"
    placed.write.parquet(f"{path}/rows")
    placed = spark.read.parquet(f"{path}/rows")
    cutoffs = [r[0] for r in placed.where("cutoff IS NOT NULL").select("cutoff").distinct().orderBy("cutoff").collect()]  # a plan's windows
    pools = Pools(how["pool"], Along(**settings).grid, how["gamma"])
    since = lambda t: (pd.Timestamp(t) - pd.Timestamp(0)).total_seconds()
    states, scored = None, []

    def step(shared: dict, until: float | None):
        def run(df: pd.DataFrame) -> pd.DataFrame:
            held = df.loc[df["state"].notna(), "state"]
            along = Along(held.iloc[0] if len(held) else None, **settings)
            along.shared = shared
            series, out = df["unique_id"].iloc[0], []
            for x in df[df["state"].isna()].sort_values("ds").itertuples():
                own = [f"h{int(x.hour)}|l{int(x.lead_bin)}", f"b{int(x.hour_bin)}|l{int(x.lead_bin)}", f"b{int(x.hour_bin)}"]
                wide = (f"all|b{int(x.hour_bin)}", "all")
                at = (x.ds - pd.Timestamp(0)).total_seconds()
                if pd.isna(x.residual) or pd.isna(x.cutoff):
                    made = (None, False, None, 0, None)
                else:
                    made = (*along.judge(float(x.residual), own, at, wide), along.waiting[-1]["judged_by"])
                out.append({"kind": "score", "ds": x.ds, **dict(zip(("score", "scorable", "severity", "calib_n", "judged"), made, strict=True))})
            if until is not None:
                along.learn(until)
            out += [{"kind": "given", "pool": g, "at": at, "r": r} for g, at, r in along.given] + [{"kind": "missed", "pool": g, "flag": f} for g, f in along.missed]
            out.append({"kind": "state", "state": along.saved()})
            made = pd.DataFrame(out, columns=COLUMNS).assign(unique_id=series)
            return made.astype({"ds": "datetime64[ns]", **dict.fromkeys(("score", "severity", "at", "r"), "Float64"), "scorable": "boolean", "calib_n": "Int32", "flag": "Int32", **dict.fromkeys(("unique_id", "kind", "judged", "state", "pool"), object)})

        return run

    latest = Window.partitionBy("pool").orderBy(F.desc("at"), F.desc("unique_id"), F.desc("r"))
    for k, cutoff in enumerate(cutoffs):
        block = placed.where(F.col("cutoff") == F.lit(cutoff).cast("timestamp_ntz")).withColumn("state", F.lit(None).cast("string"))
        if states is not None:
            block = block.unionByName(states.select("unique_id", "state"), allowMissingColumns=True)
        until = since(cutoffs[k + 1]) if k + 1 < len(cutoffs) else None
        block.groupBy("unique_id").applyInPandas(step(pools.now(), until), KINDS).write.parquet(f"{path}/step={k}")
        done = spark.read.parquet(f"{path}/step={k}")
        states = done.where("kind = 'state'").select("unique_id", "state")
        scored.append(done.where("kind = 'score'").select("unique_id", "ds", "score", "scorable", "severity", "calib_n", "judged"))
        given = done.where("kind = 'given'").withColumn("place", F.row_number().over(latest)).where(F.col("place") <= how["pool"])
        missed = done.where("kind = 'missed'").groupBy("pool", "flag").agg(F.count("*").alias("n"))
        pools.take([tuple(r) for r in given.select("pool", "at", "unique_id", "r").collect()], [tuple(r) for r in missed.collect()])
    out = placed.where("cutoff IS NULL").select("unique_id", "ds", F.lit(None).cast("double").alias("score"), F.lit(False).alias("scorable"), F.lit(None).cast("double").alias("severity"), F.lit(0).alias("calib_n"), F.lit(None).cast("string").alias("judged"))
    for part in scored:
        out = out.unionByName(part)
    return out, states if states is not None else spark.createDataFrame([], "unique_id string, state string")
