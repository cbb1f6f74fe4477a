"""Adaptive conformal scores against a slow run over one ordered list, and their state."""

import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from tsforge.operators import adaptive

T0 = datetime(2024, 1, 1)
SCHEMA = "unique_id string, ds timestamp_ntz, cutoff timestamp_ntz, residual double, side int"


def rows_of(n_days=30, seed=2, gap_from=None):
    rng, rows = np.random.default_rng(seed), []
    for u in ("a", "b"):
        for d in range(n_days):
            for h in range(12):
                r = float(rng.normal(scale=2.0 if 6 <= h < 9 else 0.5)) + (6 if u == "b" and gap_from and d >= gap_from else 0)
                rows.append((u, T0 + timedelta(days=d, hours=h), T0 + timedelta(days=d, hours=-2), None if (d + h) % 17 == 0 else r, 1))
    return rows


def slowly(rows, *, gamma=0.01, alpha=0.05, pool=40, least=20, freeze_after=3, max_freeze=4):
    """One pass over all rows, with lists and plain loops."""
    grid = sorted({*adaptive.GRID, alpha})
    out, reports = {}, {}
    for u in sorted({r[0] for r in rows}):
        pools, levels, waiting = {}, {}, []
        taken = run = frozen = excluded = 0
        mine = sorted((r for r in rows if r[0] == u and r[3] is not None), key=lambda r: (r[2], r[1]))
        for cutoff in sorted({r[2] for r in mine}):
            for w in sorted((w for w in waiting if w[0] <= cutoff), key=lambda w: w[0]):
                taken += 1
                if w[4]:
                    run += 1
                else:
                    run = frozen = 0
                if w[4] and run >= freeze_after and frozen < max_freeze and excluded + 1 <= 3 * alpha * taken:
                    frozen, excluded = frozen + 1, excluded + 1
                    continue
                if w[3] is not None:
                    g, hits = w[3]
                    levels[g] = [min(0.5, max(1e-4, a + gamma * (n - f))) for a, n, f in zip(levels[g], grid, hits, strict=True)]
                for g in w[2]:
                    pools.setdefault(g, []).append(w[1])
                    pools[g] = pools[g][-pool:]
            waiting = [w for w in waiting if w[0] > cutoff]
            for _, ds, _, r, _ in (x for x in mine if x[2] == cutoff):
                lead = max(1, int((ds - cutoff).total_seconds() // 3600))
                lead_bin = sum(lead > b for b in (1, 6, 24))
                groups = [("h", ds.hour, lead_bin), ("b", ds.hour // 4, lead_bin), ("b", ds.hour // 4)]
                group = next((g for g in groups if len(pools.get(g, [])) >= least), None)
                if group is None:
                    waiting.append((ds, r, groups, None, False))
                    continue
                held = pools[group]
                p = (1 + sum(x >= r for x in held)) / (len(held) + 1)
                level = [max(levels.setdefault(group, list(grid))[: k + 1]) for k in range(len(grid))]
                hits = [p <= x for x in level]
                if p <= level[0]:
                    q = grid[0] * p / level[0]
                elif p >= level[-1]:
                    q = grid[-1] * p / level[-1]
                else:
                    k = max(i for i, x in enumerate(level) if x <= p)
                    q = grid[k] if level[k + 1] <= level[k] else grid[k] * (grid[k + 1] / grid[k]) ** (math.log(p / level[k]) / math.log(level[k + 1] / level[k]))
                out[u, ds] = (-math.log10(min(1.0, q)), len(held))
                waiting.append((ds, r, groups, (group, hits), hits[grid.index(alpha)]))
        reports[u] = (taken, excluded)
    return out, reports


HOW = {"pool": 40, "min_calibration": 20, "freeze_after": 3, "max_freeze": 4}


@pytest.mark.parametrize("shift", [None, 20])
def test_scores_equal_a_slow_run(spark, shift):
    rows = rows_of(gap_from=shift)
    frame = spark.createDataFrame(rows, SCHEMA)
    got = {(r["unique_id"], r["ds"]): r for r in adaptive.adaptive_scores(frame, **HOW).collect()}
    want, reports = slowly(rows)
    assert len(got) == len(rows) and {k for k, r in got.items() if r["scorable"]} == set(want)
    assert all(math.isclose(got[k]["score"], s, abs_tol=1e-9) and got[k]["calib_n"] == n for k, (s, n) in want.items())
    kept_out = {r["unique_id"]: (r["n_ingested"], r["n_frozen"]) for r in adaptive.freeze_report(adaptive.advance(frame, **HOW)).collect()}
    assert kept_out == reports and (shift is None or reports["b"][1] > 0)


def test_state_carries_on(spark):
    rows = rows_of()
    cut = T0 + timedelta(days=18)
    whole = {(r["unique_id"], r["ds"]): r["score"] for r in adaptive.adaptive_scores(spark.createDataFrame(rows, SCHEMA), **HOW).collect()}
    early, late = (spark.createDataFrame([r for r in rows if (r[2] < cut) == first], SCHEMA) for first in (True, False))
    state = adaptive.advance(early, **HOW)
    for _ in range(2):  # scoring leaves the state as it was
        assert all(r["score"] == whole[r["unique_id"], r["ds"]] for r in adaptive.adaptive_scores(late, state, **HOW).collect())
    report = adaptive.coverage_report(adaptive.advance(late, state, **HOW), **HOW).toPandas()
    assert report["n_calib"].max() <= 40 and 0 < report["n_flagged"].sum() < report["n_scored"].sum() and report["alpha_eff"].between(1e-4, 0.5).all()


def test_severity_agrees_with_the_flag(spark):
    rows = adaptive.adaptive_scores(spark.createDataFrame(rows_of(60), SCHEMA), gamma=0.0, min_calibration=50, freeze_after=10**6).where("scorable").collect()
    assert all((r["severity"] >= 0) == (r["score"] >= -math.log10(0.05) - 1e-9) for r in rows if r["severity"] is not None and abs(r["severity"]) > 1e-12) and len(rows) > 100
