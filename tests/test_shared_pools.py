"""Adaptive scores with shared pools against one sequential pass over all series."""

from bisect import bisect_left
from datetime import datetime, timedelta

import numpy as np
import pytest

from tsforge.operators import adaptive, shared_pools

HOW = {"min_calibration": 8, "pool": 40, "gamma": 0.05, "alpha": 0.1, "freeze_after": 3, "max_freeze": 4, "hour_bins": 4, "lead_bins": (1, 6)}


def made_rows(n_series=4, n_cutoffs=9, h=9):
    rng, start = np.random.default_rng(2), datetime(2024, 1, 1)
    rows = []
    for s in range(n_series):
        for k in range(n_cutoffs):
            cutoff = start + timedelta(hours=6 * k)
            for step in range(1, h + 1):
                r = abs(rng.normal()) * (1 + s / 3) + (6.0 if s == 1 and k == 3 else 0.0)
                rows.append((f"s{s}", cutoff + timedelta(hours=step), cutoff, None if rng.random() < 0.05 else float(r)))
    return [*rows, ("s0", start, None, 1.0)]


def sequential(rows):
    """All series at once, cutoff by cutoff, with nothing but lists."""
    grid = np.array(sorted({*adaptive.GRID, HOW["alpha"]}))
    reference = int(np.searchsorted(grid, HOW["alpha"]))
    seconds = lambda t: (t - datetime(1970, 1, 1)).total_seconds()
    arrived, levels, waiting, frozen, out = {}, {}, [], {}, {}
    for cutoff in sorted({r[2] for r in rows if r[2]}):
        known = sorted((w for w in waiting if w[0] <= seconds(cutoff)), key=lambda w: (w[0], w[1]))
        waiting = [w for w in waiting if w[0] > seconds(cutoff)]
        moves, shared_arrivals = {}, []
        for at, s, r, own, wide, group, first, flagged in known:
            f = frozen.setdefault(s, [0, 0, 0, 0])  # ingested, run, frozen run, excluded
            f[0] += 1
            f[1], f[2] = (f[1] + 1, f[2]) if flagged else (0, 0)
            if flagged and f[1] >= HOW["freeze_after"] and f[3] + 1 <= 3 * HOW["alpha"] * f[0] and f[2] < HOW["max_freeze"]:
                f[2] += 1
                f[3] += 1
                continue
            missed = np.arange(len(grid)) >= first
            if group and group in wide:
                moves[group] = moves.get(group, 0) + (grid - missed)
            elif group:
                levels[group] = np.clip(levels[group] + HOW["gamma"] * (grid - missed), adaptive.LOWEST, adaptive.HIGHEST)
            for g in own:
                arrived.setdefault(g, []).append((at, s, r))
            shared_arrivals += [(g, (at, s, r)) for g in wide]
        for g, x in shared_arrivals:
            arrived.setdefault(g, []).append(x)
        for g, move in moves.items():
            levels[g] = np.clip(levels.get(g, grid) + HOW["gamma"] * move, adaptive.LOWEST, adaptive.HIGHEST)
        arrived = {g: sorted(v)[-HOW["pool"] :] if g.startswith("all") else v[-HOW["pool"] :] for g, v in arrived.items()}
        for s, ds, _, r in sorted((x for x in rows if x[2] == cutoff), key=lambda x: (x[0], x[1])):
            if r is None:
                out[s, cutoff, ds] = (None, False, 0, None)
                continue
            lead = max(1, int((ds - cutoff).total_seconds() // 3600))
            bins, b = sum(lead > x for x in HOW["lead_bins"]), ds.hour // 6
            own, wide = [f"{s}|h{ds.hour}|l{bins}", f"{s}|b{b}|l{bins}", f"{s}|b{b}"], [f"all|b{b}", "all"]
            group = next((g for g in own + wide if len(arrived.get(g, [])) >= HOW["min_calibration"]), None)
            first, flagged, told = 0, False, (None, False, 0, None)
            if group:
                pool = sorted(v for *_, v in arrived[group])
                p = (1 + len(pool) - bisect_left(pool, r)) / (len(pool) + 1)
                level = np.maximum.accumulate(levels.setdefault(group, grid.copy()))
                first, flagged = int(np.searchsorted(level, p)), bool(p <= level[reference])
                told = (-np.log10(adaptive.p_at_nominal(p, grid, level)), True, len(pool), group.removeprefix(f"{s}|"))
            waiting.append((seconds(ds), s, r, own, wide, group, first, flagged))
            out[s, cutoff, ds] = told
    return out


def test_folds_equal_one_sequential_pass(spark, tmp_path):
    rows = made_rows()
    frame = spark.createDataFrame(rows, "unique_id string, ds timestamp_ntz, cutoff timestamp_ntz, residual double").repartition(3)
    scores, states = shared_pools.shared_adaptive_scores(frame, str(tmp_path), **HOW)
    want = sequential(rows)
    got = sorted(((r["unique_id"], r["ds"], r["score"], r["scorable"], r["calib_n"], r["judged"]) for r in scores.collect()), key=lambda x: (x[0], x[1], str(x[5]), str(x[2])))
    told = sorted([(s, ds, *t) for (s, _, ds), t in want.items()] + [("s0", datetime(2024, 1, 1), None, False, 0, None)], key=lambda x: (x[0], x[1], str(x[5]), str(x[2])))
    assert len(got) == len(rows) == len(told) and states.count() == 4
    for a, b in zip(got, told, strict=True):
        assert a[:2] == b[:2] and a[3:] == b[3:] and (a[2] is None if b[2] is None else a[2] == pytest.approx(b[2]))
    assert {"all", "all|b1"} & {x[5] for x in got} and any(x[5] and not x[5].startswith("all") for x in got)


def test_nothing_and_no_size(spark, tmp_path):
    frame = spark.createDataFrame([], "unique_id string, ds timestamp_ntz, cutoff timestamp_ntz, residual double")
    scores, states = shared_pools.shared_adaptive_scores(frame, str(tmp_path), **HOW)
    assert scores.collect() == [] and states.collect() == []
    with pytest.raises(ValueError, match="size"):
        shared_pools.shared_adaptive_scores(frame, str(tmp_path), pool=None)
