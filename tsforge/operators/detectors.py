"""Anomaly detectors beyond conformal scores: discords, isolation forest, PCA.

Windows run along one series at a time; the forest's trees grow on a bounded sample, and discords
compare blocks of a series in tasks of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.operators.adaptive import _at_least, adaptive_scores
from tsforge.panel import by_series, missing
from tsforge.spec import LeakError

def online_conformal(rows: DataFrame, **how) -> DataFrame:
    """Adaptive scores from an empty state; see ``adaptive.adaptive_scores``."""
    return adaptive_scores(rows, **how)


def tails(rows: DataFrame, length: int) -> DataFrame:
    """The last ``length`` rows of each series: what windows of a later frame reach back to."""
    back = Window.partitionBy("unique_id").orderBy(F.desc("ds"))
    return rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= length).drop("_n")


def bridged(rows: DataFrame, tail: DataFrame) -> DataFrame:
    """A later frame with its series' tails before it, which ``borrowed`` tells apart. Rows that a
    tail and the frame share, or that don't lie before the frame's first, aren't borrowed."""
    first = rows.groupBy("unique_id").agg(F.min("ds").alias("_first"))
    kept = tail.join(first, "unique_id").where(F.col("ds") < F.col("_first")).drop("_first")
    return rows.withColumn("borrowed", F.lit(False)).unionByName(kept.withColumn("borrowed", F.lit(True)))


def pool_severity(rows: DataFrame, pool: DataFrame, *, value: str = "value", alpha: float = 0.05) -> DataFrame:
    """rows with severity: how many robust spreads of the pool the value lies beyond the pool's
    upper ``alpha``; zero on that edge. Null without a pool."""
    known = pool.select(missing(value).alias("v")).where("v IS NOT NULL")
    n = known.count()
    if not n:
        return rows.withColumn("severity", F.lit(None).cast("double"))
    # The value of a whole rank, so nothing is interpolated.
    rank = min(n - 1, math.ceil((n - 1) * (1 - alpha) - 1e-12))
    edge, middle = known.agg(F.percentile("v", F.lit(rank / max(1, n - 1))), F.median("v")).first()
    spread = known.agg(F.median(F.abs(F.col("v") - middle))).first()[0]
    return rows.withColumn("severity", (missing(value) - edge) / max(1.4826 * spread, 1e-8))


def _nearest(placed: DataFrame, *, m: int, block: int, split: DataFrame | None = None) -> DataFrame:
    """unique_id, pos (of its last row) and d, the distance to the nearest other stretch, of every
    stretch of ``m`` known rows. With ``split`` (unique_id, split) of those that end behind that
    position alone, among those that end up to it."""
    home = F.floor(F.col("pos") / block).cast("int")
    before = F.floor((F.col("pos") - m + 1) / block).cast("int")
    homes = F.array_distinct(F.array(home, F.greatest(before, F.lit(0))))
    dealt = placed.select("unique_id", F.explode(homes).alias("b"), F.struct("pos", F.coalesce("v", F.lit(float("nan"))).alias("v")).alias("x"))
    blocks = dealt.groupBy("unique_id", "b").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["v"]).alias("w")).where(F.size("w") >= m)
    count = blocks.groupBy("unique_id").agg(F.max("b").alias("last"))
    ends = split if split is not None else count.select("unique_id", F.lit(None).cast("long").alias("split"))
    left = blocks.join(count, "unique_id").join(ends, "unique_id").select("unique_id", "b", "w", "split", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("c"))
    pairs = left.join(blocks.select("unique_id", F.col("b").alias("c"), F.col("w").alias("other")), ["unique_id", "c"])

    def stretches(values) -> tuple[np.ndarray, np.ndarray]:
        w = np.lib.stride_tricks.sliding_window_view(np.array(values, float), m)
        known = np.isfinite(w).all(axis=1)
        z = np.where(known[:, None], w, 0)
        sd = z.std(axis=1, keepdims=True)
        return np.where(sd > 1e-12, (z - z.mean(axis=1, keepdims=True)) / np.maximum(sd, 1e-12), 0), known

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for x in df.itertuples():
                (one, known), (two, held) = stretches(x.w), stretches(x.other)
                at, to = x.b * block + np.arange(len(one)), x.c * block + np.arange(len(two))
                if not pd.isna(x.split):
                    known, held = known & (at + m - 1 > x.split), held & (to + m - 1 <= x.split)
                d = np.maximum(2 * m - 2 * one @ two.T, 0)
                d[(np.abs(at[:, None] - to) < m // 2 + 1) | ~held] = np.inf
                least = np.where(known, d.min(axis=1), np.inf)
                fit = np.isfinite(least)
                yield pd.DataFrame({"unique_id": x.unique_id, "pos": at[fit] + m - 1, "d": np.sqrt(least[fit])})

    found = pairs.select("unique_id", "b", "w", "c", "other", "split").mapInPandas(run, "unique_id string, pos int, d double")
    return found.groupBy("unique_id", "pos").agg(F.min("d").alias("d"))


def discords(df: DataFrame, *, m: int = 24, value: str = "y", block: int = 512) -> DataFrame:
    """The distance of each z-normalised stretch of ``m`` rows to its nearest other one (stretches
    within m / 2 rows don't count), at the stretch's last row, scored against all of its series.
    A series is cut into blocks of ``block`` stretches, and a task compares two blocks, so that
    the squares of a long series are dealt out."""
    block = max(block, m)
    row = (F.row_number().over(by_series()) - 1).alias("pos")
    placed = df.select("unique_id", "ds", missing(value).alias("v"), row)
    # Series shorter than two stretches have none that stands apart.
    long_enough = placed.groupBy("unique_id").count().where(F.col("count") >= 2 * m + 1)
    best = _nearest(placed, m=m, block=block).join(long_enough.select("unique_id"), "unique_id", "left_semi")
    down = Window.partitionBy("unique_id").orderBy(F.desc("d")).rangeBetween(Window.unboundedPreceding, 0)
    n = F.count("*").over(Window.partitionBy("unique_id"))
    ranked = best.select("unique_id", "pos", (-F.log10((1 + F.count("*").over(down)) / (n + 1))).alias("score"), n.cast("int").alias("calib_n"))
    scored = placed.join(ranked, ["unique_id", "pos"], "left")
    pool = F.coalesce(F.max("calib_n").over(Window.partitionBy("unique_id")), F.lit(0))
    return scored.select("unique_id", "ds", "score", F.col("score").isNotNull().alias("scorable"), pool.alias("calib_n"))


def discords_behind(known: DataFrame, later: DataFrame, *, m: int = 24, value: str = "y", block: int = 512) -> DataFrame:
    """unique_id, ds, score, scorable, calib_n of a later frame: how far each stretch that ends in it
    lies from the nearest one of the frame that is known, against how far those lie from each other.
    Stretches may reach back into the known frame. Raises LeakError if ``later`` begins before the
    end of ``known``."""
    ends = known.agg(F.max("ds").alias("last")).crossJoin(later.agg(F.min("ds").alias("first"))).first()
    if ends["last"] is not None and ends["first"] is not None and ends["first"] <= ends["last"]:
        raise LeakError("the frame begins before the end of what is known")
    block = max(block, m)
    both = known.select("unique_id", "ds", missing(value).alias("v"), F.lit(False).alias("later"))
    both = both.union(later.select("unique_id", "ds", missing(value).alias("v"), F.lit(True).alias("later")))
    placed = both.withColumn("pos", F.row_number().over(by_series()) - 1)
    split = placed.groupBy("unique_id").agg(F.coalesce(F.max(F.when(~F.col("later"), F.col("pos"))), F.lit(-1)).cast("long").alias("split"))
    asked = _nearest(placed, m=m, block=block, split=split).select("unique_id", "pos", F.col("d").alias("residual"))
    pool = _nearest(placed.where("not later"), m=m, block=block).select("unique_id", F.col("d").alias("residual"))
    ranked = _at_least(pool, asked, ("unique_id",)).where("n > 0")
    p = (1 + F.col("ge")) / (F.col("n") + 1)
    told = ranked.select("unique_id", "pos", (-F.log10(p)).alias("score"), F.col("n").cast("int").alias("calib_n"))
    out = placed.where("later").join(told, ["unique_id", "pos"], "left")
    return out.select("unique_id", "ds", "score", F.col("score").isNotNull().alias("scorable"), F.coalesce("calib_n", F.lit(0)).alias("calib_n"))


FEATURES = ("value", "zscore", "diff1", "diff2", "energy", "hour")


def window_features(df: DataFrame, *, window: int = 24, value: str = "y") -> DataFrame:
    frame = by_series().rowsBetween(-(window - 1), 0)
    v = missing(value)
    base = df.select("unique_id", "ds", v.alias("value")).withColumn("m", F.avg("value").over(frame)).withColumn("s", F.stddev_pop("value").over(frame)).withColumn("n", F.count("value").over(frame))
    d1, d2 = (F.col("value") - F.lag("value", k).over(by_series()) for k in (1, 2))
    # The one-sided spectrum of a centred window holds half of its energy, but the fastest wave of an
    # even window, whose signs alternate, whole.
    sign = F.when(F.row_number().over(by_series()) % 2 == 0, F.col("value")).otherwise(-F.col("value"))
    base = base.withColumn("sign", sign).withColumn("fast", F.sum("sign").over(frame) if window % 2 == 0 else F.lit(0.0))
    rows = base.select(
        "unique_id", "ds", "value", F.when(F.col("s") > 0, (F.col("value") - F.col("m")) / F.col("s")).otherwise(0.0).alias("zscore"), d1.alias("diff1"), d2.alias("diff2"),
        (F.col("s") * F.col("s") * window / 2 + F.col("fast") * F.col("fast") / (2 * window)).alias("energy"), F.hour("ds").cast("double").alias("hour"), (F.col("n") == window).alias("full"),
    )
    known = F.col("full")
    for c in FEATURES:
        known = known & F.col(c).isNotNull()
    return rows.withColumn("usable", known).drop("full")


def _sample(rows: DataFrame, most: int) -> np.ndarray:
    """Of the usable rows, those with the smallest hashes of their keys: ``most`` at the most."""
    picked = rows.where("usable").orderBy(F.xxhash64("unique_id", "ds")).limit(most).select(*FEATURES).collect()
    return np.array([tuple(r) for r in picked], float).reshape(-1, len(FEATURES))


def _path_length(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def _time_split(rows: DataFrame, calib_fraction: float) -> str | None:
    """Of the usable rows' distinct times in order, the last one of the part that trains; counts
    by day find its day, so that one day's times are sorted at the most."""
    times = rows.where("usable").select("ds").distinct().withColumn("day", F.to_date("ds"))
    days = times.groupBy("day").count().orderBy("day").collect()
    n = sum(r["count"] for r in days)
    if not n:
        return None
    at = max(1, min(round(n * (1 - calib_fraction)), n - 1))
    for r in days:
        if at <= r["count"]:
            break
        at -= r["count"]
    return times.where(F.col("day") == r["day"]).orderBy("ds").limit(at).agg(F.max("ds").cast("string")).first()[0]


def isolation_forest(rows: DataFrame, *, trees: int = 100, size: int = 256, train_rows: int = 20000, calib_fraction: float = 0.3, seed: int = 7) -> DataFrame:
    """Scores of window_features by an isolation forest. The distinct times of usable rows are
    split: trees grow on a bounded sample of the rows of the earlier part, and every row of the
    later part (``calib_fraction``) is the pool of the p-values, (1 + pool rows that are at least
    as anomalous) / (pool rows + 1), for the rows of both parts. Nothing is scorable without a
    row on each side."""
    split = _time_split(rows, calib_fraction)
    later = F.col("usable") & (F.col("ds") > F.lit(split).cast(rows.schema["ds"].dataType))
    calib_n = rows.where(later).count()
    if not calib_n:
        return rows.select("unique_id", "ds", F.lit(None).cast("double").alias("score"), F.lit(False).alias("scorable"), F.lit(0).alias("calib_n"))
    data = _sample(rows.where(~later), train_rows)
    rng = np.random.default_rng(seed)

    def grow(x: np.ndarray, depth: int):
        spread = np.ptp(x, axis=0) if len(x) else np.zeros(len(FEATURES))
        if depth == 0 or len(x) <= 1 or not spread.any():
            return _path_length(len(x))
        axis = rng.choice(np.flatnonzero(spread))
        cut = rng.uniform(x[:, axis].min(), x[:, axis].max())
        low = x[:, axis] < cut
        return axis, cut, grow(x[low], depth - 1), grow(x[~low], depth - 1)

    forest = [grow(data[rng.choice(len(data), min(size, len(data)), replace=False)], 8) for _ in range(trees)]

    def walk(node, x: np.ndarray, depth: int) -> np.ndarray:
        if not isinstance(node, tuple):
            return np.full(len(x), node + depth)
        out, low = np.empty(len(x)), x[:, node[0]] < node[1]
        out[low], out[~low] = walk(node[2], x[low], depth + 1), walk(node[3], x[~low], depth + 1)
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            usable = df["usable"].to_numpy(bool)
            depth, x = np.full(len(df), np.nan), df.loc[usable, list(FEATURES)].to_numpy(float)
            # Summed tree by tree: the same row has the same depth in any batch.
            depth[usable] = sum((walk(t, x, 0) for t in forest), np.zeros(len(x))) / len(forest)
            yield pd.DataFrame({"unique_id": df["unique_id"], "ds": df["ds"], "scorable": usable, "depth": np.where(usable, depth, None)})

    # A score falls with the depth, so pool rows no deeper than a row are at least as anomalous.
    # They are counted by depth, then over slices of depth: no task sorts all of them.
    scored = rows.mapInPandas(run, "unique_id string, ds timestamp_ntz, scorable boolean, depth double")
    in_pool = F.col("ds") > F.lit(split).cast("timestamp_ntz")
    each = scored.where("scorable").groupBy("depth").agg(F.sum(in_pool.cast("long")).alias("here")).withColumn("slice", F.floor(F.col("depth") * 1024))
    slices = each.groupBy("slice").agg(F.sum("here").alias("here"))
    before = slices.select("slice", F.coalesce(F.sum("here").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("slice").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    ranked = each.join(F.broadcast(before), "slice").select("depth", (F.col("before") + F.sum("here").over(within)).alias("reach"))
    score = F.log10(F.lit(calib_n + 1) / (F.col("reach") + 1))
    return scored.join(ranked, "depth", "left").select("unique_id", "ds", score.alias("score"), "scorable", F.lit(calib_n).cast("int").alias("calib_n"))


def pca_reconstruction(df: DataFrame, *, length: int = 24, parts: int = 4, value: str = "y") -> DataFrame:
    """(unique_id, ds, error): how far each stretch of ``length`` rows, scaled by its series' mean
    and spread, lies from the space of the main components of all stretches."""
    whole = Window.partitionBy("unique_id")
    v = missing(value)
    scaled = df.select("unique_id", "ds", ((v - F.avg(v).over(whole)) / F.greatest(F.stddev_pop(v).over(whole), F.lit(1e-8))).alias("x"))
    stretch = F.collect_list("x").over(by_series().rowsBetween(-(length - 1), 0))
    rows = scaled.select("unique_id", "ds", stretch.alias("w")).where(F.size("w") == length)
    wide = VectorAssembler(inputCols=[f"x{i}" for i in range(length)], outputCol="features").transform(rows.select("unique_id", "ds", "w", *(F.col("w")[i].alias(f"x{i}") for i in range(length))))
    model = PCA(k=parts, inputCol="features", outputCol="parts").fit(wide)
    axes = model.pc.toArray()
    rest = np.eye(length) - axes @ axes.T
    off = [sum((F.col("w")[j] * float(rest[i, j]) for j in range(1, length)), F.col("w")[0] * float(rest[i, 0])) for i in range(length)]
    squares = F.aggregate(F.array(*off), F.lit(0.0), lambda s, x: s + x * x)
    return wide.select("unique_id", "ds", (squares / length).alias("error"))
