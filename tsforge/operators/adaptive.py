"""Conformal scores conditional on hour and lead: a split form in joins and windows, and an
adaptive form that runs along each series with its state going in and out as a table.

A residual's groups, from the narrowest: (series, hour, lead bin), (series, hour bin, lead bin),
(series, hour bin), and in the split form also (hour bin) and all. The narrowest group whose pool
holds ``min_calibration`` residuals judges it.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.functions.calendar import local
from tsforge.panel import seconds

#: The levels whose own error rate is followed: from 0.001 to 0.2 by equal factors, and the usual ones.
GRID = tuple(sorted({round(0.001 * 200 ** (i / 39), 4) for i in range(40)} | {0.01, 0.05, 0.1}))
LOWEST, HIGHEST = 1e-4, 0.5
LEVELS = (("unique_id", "hour", "lead_bin"), ("unique_id", "hour_bin", "lead_bin"), ("unique_id", "hour_bin"), ("hour_bin",), ())


def with_groups(rows: DataFrame, *, step: int = 3600, tz: str = "UTC", hour_bins: int = 6, lead_bins: tuple[int, ...] = (1, 6, 24)) -> DataFrame:
    """Adds hour (local), hour_bin and lead_bin: the number of bounds below the lead, which is the
    steps from the cutoff, one at least (one where there is no cutoff)."""
    lead = F.greatest(F.coalesce(F.floor((seconds("ds") - seconds("cutoff")) / step), F.lit(1)), F.lit(1))
    hour = F.hour(local("ds", tz))
    above: Column = F.lit(0)
    for bound in lead_bins:
        above = above + (lead > bound).cast("int")
    return rows.withColumn("hour", hour).withColumn("hour_bin", F.floor(hour / (24 // hour_bins)).cast("int")).withColumn("lead_bin", above)


def _at_least(pool: DataFrame, asked: DataFrame, keys: tuple[str, ...], slices: int = 64) -> DataFrame:
    """asked (row, keys, residual) with n, the size of its group's pool, and ge, how many of the
    pool are at least as large. Pools are counted by value, then by slices of values, and ranked
    inside a slice, so that a group however large is no task of its own."""
    by = (*keys, "slice", "residual")
    cut = F.floor(F.col("residual") * slices)
    counts = pool.withColumn("slice", cut).groupBy(*by).agg(F.count("*").alias("here"))
    values = counts.unionByName(asked.withColumn("slice", cut).select(*by, F.lit(0).cast("long").alias("here"))).groupBy(*by).agg(F.sum("here").alias("here"))
    sums = values.groupBy(*keys, "slice").agg(F.sum("here").alias("here"))
    down = Window.partitionBy(*keys, F.lit(1)).orderBy(F.desc("slice"))
    whole = Window.partitionBy(*keys, F.lit(1))
    above = sums.select(*keys, "slice", F.coalesce(F.sum("here").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"), F.sum("here").over(whole).alias("n"))
    inside = Window.partitionBy(*keys, "slice").orderBy(F.desc("residual")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = values.withColumn("ge", F.sum("here").over(inside)).join(above, [*keys, "slice"])
    return asked.join(ranked.select(*keys, "residual", (F.col("ge") + F.col("above")).alias("ge"), "n"), [*keys, "residual"], "left")


def conditional_scores(calibration: DataFrame, rows: DataFrame, *, min_calibration: int = 50) -> DataFrame:
    """-log10 p of each row against the narrowest group's calibration residuals that are many
    enough. Both sides have residual and the columns of ``with_groups``; ``level`` says which."""
    key = ["unique_id", "ds"]
    none = {"unique_id": F.lit(""), "hour": F.lit(-1), "hour_bin": F.lit(-1), "lead_bin": F.lit(-1)}
    # All levels at once: a row stands in one group of each.
    groups = F.array(*(F.struct(F.lit(i).alias("level"), *((F.col(c) if c in keys else v).cast("string").alias(c) for c, v in none.items())) for i, keys in enumerate(LEVELS)))
    known = F.col("residual").isNotNull()
    pool = calibration.where(known).select("residual", F.explode(groups).alias("group"))
    asked = rows.where(known).select(*key, "residual", F.explode(groups).alias("group"))
    level = F.struct(F.col("group.level").alias("level"), "n", "ge")
    enough = _at_least(pool, asked, ("group",)).where(F.col("n") >= min_calibration)
    narrowest = enough.groupBy(*key).agg(F.min_by(level, F.col("group.level")).alias("x"))
    out = rows.select(*key, "side").join(narrowest, key, "left")
    p = (1 + F.col("x.ge")) / (F.col("x.n") + 1)
    return out.select(
        *key, F.when(F.col("x").isNotNull(), -F.log10(p)).alias("score"), F.col("x").isNotNull().alias("scorable"), F.col("x.level").alias("level"),
        F.coalesce(F.col("x.n"), F.lit(0)).cast("int").alias("calib_n"), "side",
    )


def p_at_nominal(p: float, grid: np.ndarray, level: np.ndarray) -> float:
    """The nominal level whose followed level is ``p``: by straight lines between logarithms, and
    in proportion to the outermost level beyond both ends."""
    if p <= level[0]:
        return min(1.0, grid[0] * p / level[0])
    if p >= level[-1]:
        return min(1.0, grid[-1] * p / level[-1])
    k = int(np.searchsorted(level, p, side="right")) - 1
    if level[k + 1] <= level[k]:
        return float(grid[k])
    return float(min(1.0, np.exp(np.interp(np.log(p), np.log(level[k : k + 2]), np.log(grid[k : k + 2])))))


class Along:
    """One series' state: pools and followed levels by group, what waits to be known, and what is
    kept out. It is read from and written to JSON."""

    def __init__(self, saved: str | None = None, *, gamma: float, alpha: float, pool: int | None, min_calibration: int, freeze_after: int, max_freeze: int):
        self.gamma, self.alpha, self.most, self.least, self.freeze_after, self.max_freeze = gamma, alpha, pool, min_calibration, freeze_after, max_freeze
        self.grid = np.array(sorted({*GRID, alpha}))
        self.reference = int(np.searchsorted(self.grid, alpha))
        held = json.loads(saved) if saved else {}
        self.arrived: dict[str, list[float]] = held.get("arrived", {})
        self.ordered = {g: sorted(v) for g, v in self.arrived.items()}
        self.levels = {g: np.array(v) for g, v in held.get("levels", {}).items()}
        self.counts: dict[str, dict[str, int]] = held.get("counts", {})
        self.waiting: list[dict] = held.get("waiting", [])
        #: Pools and levels that all series share, as of now, and what this series has for them.
        self.shared: dict[str, tuple[list[float], np.ndarray]] = {}
        self.given: list[tuple[str, float, float]] = []
        self.missed: list[tuple[str, int]] = []
        self.frozen: dict[str, int] = held.get("frozen", {"ingested": 0, "run": 0, "frozen_run": 0, "excluded": 0, "budget_exhausted": 0})

    def saved(self) -> str:
        levels = {g: v.tolist() for g, v in self.levels.items()}
        return json.dumps({"arrived": self.arrived, "levels": levels, "counts": self.counts, "waiting": self.waiting, "frozen": self.frozen})

    def _kept_out(self, flagged: bool) -> bool:
        """Long runs of flags stay out of pools and levels, for a while and within a budget."""
        f = self.frozen
        f["ingested"] += 1
        f["run"] = f["run"] + 1 if flagged else 0
        f["frozen_run"] = f["frozen_run"] if flagged else 0
        if f["run"] < self.freeze_after or not flagged:
            return False
        if f["excluded"] + 1 > 3 * self.alpha * f["ingested"]:
            f["budget_exhausted"] = 1
            return False
        if f["frozen_run"] >= self.max_freeze:
            return False
        f["frozen_run"] += 1
        f["excluded"] += 1
        return True

    def learn(self, by: float) -> None:
        """Takes in, in the order of time, what is known by then."""
        ready = sorted((w for w in self.waiting if w["at"] <= by), key=lambda w: w["at"])
        self.waiting = [w for w in self.waiting if w["at"] > by]
        for w in ready:
            if self._kept_out(w["flagged"]):
                continue
            group = w["judged_by"]
            if group in w.get("shared", ()):
                self.missed.append((group, w["first_flag"]))
            elif group is not None and self.gamma:
                # The error is the one made by the levels as they stood when the row was judged.
                missed = np.arange(len(self.grid)) >= w["first_flag"]
                moved = self.levels[group] + self.gamma * (self.grid - missed)
                self.levels[group] = np.clip(moved, LOWEST, HIGHEST)
                self.counts[group]["clipped"] += int((self.levels[group] != moved).sum())
            self.given += [(g, w["at"], w["r"]) for g in w.get("shared", ())]
            for g in w["groups"]:
                self.arrived.setdefault(g, []).append(w["r"])
                insort(self.ordered.setdefault(g, []), w["r"])
                if self.most and len(self.arrived[g]) > self.most:
                    del self.ordered[g][bisect_left(self.ordered[g], self.arrived[g].pop(0))]

    def _pool(self, group: str) -> list[float]:
        return self.shared[group][0] if group in self.shared else self.ordered.get(group, [])

    def judge(self, r: float, groups: list[str], at: float, shared: tuple[str, ...] = ()) -> tuple:
        """(score, scorable, severity, calib_n) by the narrowest group that is large enough; the
        ``shared`` ones are wider than all of ``groups``."""
        group = next((g for g in (*groups, *shared) if len(self._pool(g)) >= self.least), None)
        wait = {"at": at, "r": r, "groups": groups, "judged_by": group, "first_flag": 0, "flagged": False}
        if shared:
            wait["shared"] = list(shared)
        self.waiting.append(wait)
        if group is None:
            return None, False, None, 0
        pool = self._pool(group)
        n = len(pool)
        p = (1 + n - bisect_left(pool, r)) / (n + 1)
        level = np.maximum.accumulate(self.shared[group][1] if group in self.shared else self.levels.setdefault(group, self.grid.copy()))
        wait["first_flag"] = int(np.searchsorted(level, p))
        wait["flagged"] = bool(p <= level[self.reference])
        count = self.counts.setdefault(group, {"scored": 0, "flagged": 0, "clipped": 0})
        count["scored"] += 1
        count["flagged"] += wait["flagged"]
        rank = int(np.ceil((n + 1) * (1 - level[self.reference])))
        edge = pool[rank - 1] if 1 <= rank <= n else np.nan
        severity = (r - edge) / (1 + 2 * edge) if 1 + 2 * edge > 0 else None
        return -np.log10(p_at_nominal(p, self.grid, level)), True, severity, n

    def report(self) -> list[tuple]:
        """(group, n_calib, n_scored, n_flagged, alpha_eff, n_clipped)."""
        out = []
        for g in sorted(self.ordered):
            count = self.counts.get(g, {"scored": 0, "flagged": 0, "clipped": 0})
            level = np.maximum.accumulate(self.levels[g])[self.reference] if g in self.levels else self.alpha
            out.append((g, len(self.ordered[g]), count["scored"], count["flagged"], float(level), count["clipped"]))
        return out


SCORES = "unique_id string, ds timestamp_ntz, score double, scorable boolean, severity double, calib_n int, side byte, state string"


def _run(rows: DataFrame, state: DataFrame | None, how: dict) -> DataFrame:
    """Score rows, and for each series one row with its state behind them."""
    side = F.col("side").cast("byte") if "side" in rows.columns else F.lit(None).cast("byte")
    hours = with_groups(rows, **{k: how[k] for k in ("step", "tz", "hour_bins", "lead_bins")})
    rows = hours.select("unique_id", "ds", "cutoff", "residual", side.alias("side"), "hour", "hour_bin", "lead_bin", F.lit(None).cast("string").alias("state"))
    if state is not None:
        # A state is a first row of its series, without a cutoff.
        rows = rows.unionByName(state.select("unique_id", "state"), allowMissingColumns=True)
    settings = {k: v for k, v in how.items() if k in ("gamma", "alpha", "pool", "min_calibration", "freeze_after", "max_freeze")}

    def run(df: pd.DataFrame) -> pd.DataFrame:
        held = df.loc[df["state"].notna(), "state"]
        along, out = Along(held.iloc[0] if len(held) else None, **settings), []
        df = df[df["state"].isna()].sort_values(["cutoff", "ds"], na_position="first")
        seconds_of = lambda t: (t - pd.Timestamp(0)).total_seconds()
        for cutoff, block in df.groupby("cutoff", sort=True, dropna=False):
            if not pd.isna(cutoff):
                along.learn(seconds_of(cutoff))
            judged = []
            for x in block.itertuples():
                known = not (pd.isna(cutoff) or pd.isna(x.residual))
                groups = [f"h{int(x.hour)}|l{int(x.lead_bin)}", f"b{int(x.hour_bin)}|l{int(x.lead_bin)}", f"b{int(x.hour_bin)}"]
                judged.append((x.ds, *(along.judge(float(x.residual), groups, seconds_of(x.ds)) if known else (None, False, None, 0)), x.side if known else None))
            out += judged
        done = pd.DataFrame(out, columns=["ds", "score", "scorable", "severity", "calib_n", "side"])
        done["state"] = None
        last = pd.DataFrame([{"ds": pd.NaT, "score": None, "scorable": False, "severity": None, "calib_n": 0, "side": None, "state": along.saved()}])
        done = pd.concat([done, last]) if len(done) else last
        done.insert(0, "unique_id", df["unique_id"].iloc[0] if len(df) else None)
        return done.astype({"side": "Int8", "score": "Float64", "severity": "Float64"})

    return rows.groupBy("unique_id").applyInPandas(run, SCORES)


def _how(step: int = 3600, tz: str = "UTC", hour_bins: int = 6, lead_bins: tuple[int, ...] = (1, 6, 24), gamma: float = 0.01, alpha: float = 0.05,
         pool: int | None = 2000, min_calibration: int = 50, freeze_after: int = 3, max_freeze: int = 48) -> dict:
    if 24 % hour_bins or not 0 < alpha < 1 or gamma < 0 or min_calibration < 1:
        raise ValueError("hour bins divide a day, alpha lies between 0 and 1, gamma isn't negative, a pool holds one residual at least")
    return dict(locals())


def adaptive_scores(rows: DataFrame, state: DataFrame | None = None, **how) -> DataFrame:
    """(unique_id, ds, score, scorable, severity, calib_n, side) of rows (unique_id, ds, cutoff,
    residual, side): each block of one cutoff is judged by what was known then. Levels follow the
    errors made with a rate of ``gamma``. Runs of ``freeze_after`` flags and more are kept out, at
    most ``max_freeze`` in a row. A series is one group; its own groups alone calibrate it.
    ``state`` is what ``advance`` gave; it isn't changed."""
    return _run(rows, state, _how(**how)).where("state IS NULL").drop("state")


def advance(rows: DataFrame, state: DataFrame | None = None, **how) -> DataFrame:
    """(unique_id, state): the state behind the rows."""
    return _run(rows, state, _how(**how)).where("state IS NOT NULL").select("unique_id", "state")


def coverage_report(state: DataFrame, **how) -> DataFrame:
    """Of each group: how large its pool is, what it has judged and flagged, and its level now."""
    settings = {k: v for k, v in _how(**how).items() if k in ("gamma", "alpha", "pool", "min_calibration", "freeze_after", "max_freeze")}

    def run(batches):
        for df in batches:
            rows = [(x.unique_id, *r) for x in df.itertuples() for r in Along(x.state, **settings).report()]
            out = pd.DataFrame(rows, columns=["unique_id", "group", "n_calib", "n_scored", "n_flagged", "alpha_eff", "n_clipped"])
            yield out.assign(flag_rate=(out["n_flagged"] / out["n_scored"].where(out["n_scored"] > 0)).astype(float))

    return state.mapInPandas(run, "unique_id string, group string, n_calib int, n_scored int, n_flagged int, alpha_eff double, n_clipped int, flag_rate double")


def freeze_report(state: DataFrame) -> DataFrame:
    """What each series has kept out of its pools."""
    f = F.from_json("state", "frozen struct<ingested: int, run: int, frozen_run: int, excluded: int, budget_exhausted: int>")["frozen"]
    return state.select("unique_id", f["ingested"].alias("n_ingested"), f["run"].alias("flag_run"), f["frozen_run"].alias("frozen_run"), f["excluded"].alias("n_frozen"), (f["budget_exhausted"] == 1).alias("budget_exhausted"))
