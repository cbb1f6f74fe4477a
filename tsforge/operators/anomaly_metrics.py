"""Range, affiliation, point and area metrics of anomaly flags and scores.

Input rows: unique_id, pos (place on the common scorable support, from 0), flag, label, score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.operators.events import islands


def _ranges(rows: DataFrame, flag: str, merge_gap: int = 0) -> DataFrame:
    marked = islands(rows.where(F.col(flag)), merge_gap=merge_gap)
    return marked.groupBy("unique_id", "island").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))


def _latest(rows: DataFrame, on: str, ranges: DataFrame, start: str) -> DataFrame:
    """Each row with the struct ``r`` of the range of its series that starts last at or before
    ``on``: one sort of both together instead of pairs."""
    held = ranges.select("unique_id", F.col(start).alias("_on"), F.lit(0).alias("_side"), F.struct(*(c for c in ranges.columns if c != "unique_id")).alias("r"))
    both = rows.select("*", F.col(on).alias("_on"), F.lit(1).alias("_side")).unionByName(held, allowMissingColumns=True)
    back = Window.partitionBy("unique_id").orderBy("_on", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("r", F.last("r", True).over(back)).where("_side = 1").drop("_on", "_side")


def f1(p: str, r: str):
    return F.when(F.col(p).isNotNull() & F.col(r).isNotNull(), F.coalesce(F.try_divide(2 * F.col(p) * F.col(r), F.col(p) + F.col(r)), F.lit(0.0)))


#: Which places of a range weigh most; the weights fall or rise by one from place to place.
BIASES = ("flat", "front", "middle", "back")
#: What a range that meets several others keeps of its share.
CARDINALITIES: dict[str, Callable[[Column], Column]] = {"one": lambda k: F.lit(1.0), "reciprocal": lambda k: 1.0 / k}


def _weight(bias: str, to: Column, n: Column) -> Column:
    """The weight of the first ``to`` places of a range of n."""
    if bias == "flat":
        return to * 1.0
    if bias == "back":
        return to * (to + 1) / 2.0
    if bias == "front":
        return to * n - to * (to - 1) / 2.0
    half = F.floor((n + 1) / 2)
    rest = to - half
    up = F.least(to, half) * (F.least(to, half) + 1) / 2.0
    return up + F.when(rest > 0, rest * (n - half) - rest * (rest - 1) / 2.0).otherwise(0.0)


def range_parts(rows: DataFrame, *, existence: float = 0.0, merge_gap: int = 0, bias: str = "flat", cardinality: str = "reciprocal") -> DataFrame:
    """(unique_id, metric, value): one row for each range found (range_precision) and each true
    range (range_recall). Ranges of one kind don't overlap, so two ranges that meet are told by
    the one that starts inside the other."""
    if bias not in BIASES or cardinality not in CARDINALITIES or not 0 <= existence <= 1:
        raise ValueError("a bias and a cardinality that are known, existence between 0 and 1")
    true, found = _ranges(rows, "label"), _ranges(rows, "flag", merge_gap)
    t, p = (x.select("unique_id", F.col("island").alias(f"{s}_id"), F.col("a").alias(f"{s}_a"), F.col("b").alias(f"{s}_b")) for x, s in ((true, "t"), (found, "p")))
    names = ("unique_id", "t_id", "t_a", "t_b", "p_id", "p_a", "p_b")
    begun = _latest(t, "t_a", p, "p_a").where("r.p_b >= t_a").select(*(F.col(f"r.{c}").alias(c) if c.startswith("p_") else F.col(c) for c in names))
    inside = _latest(p, "p_a", t, "t_a").where("r.t_b >= p_a and r.t_a < p_a").select(*(F.col(f"r.{c}").alias(c) if c.startswith("t_") else F.col(c) for c in names))
    both = begun.union(inside).withColumn("lo", F.greatest("t_a", "p_a")).withColumn("hi", F.least("t_b", "p_b"))

    def side(ranges: DataFrame, s: str, alpha: float, name: str) -> DataFrame:
        a, n = F.col(f"{s}_a"), F.col(f"{s}_b") - F.col(f"{s}_a") + 1
        covered = _weight(bias, F.col("hi") - a + 1, n) - _weight(bias, F.col("lo") - a, n)
        met = both.groupBy("unique_id", f"{s}_id").agg(F.count("*").alias("met"), F.sum(covered).alias("covered"))
        share = F.col("covered") / _weight(bias, n, n) * CARDINALITIES[cardinality](F.col("met"))
        each = ranges.join(met, ["unique_id", f"{s}_id"], "left")
        return each.select("unique_id", F.lit(name).alias("metric"), F.coalesce(alpha + (1 - alpha) * share, F.lit(0.0)).alias("value"))

    return side(p, "p", 0.0, "range_precision").union(side(t, "t", existence, "range_recall"))


def _of_series(rows: DataFrame, parts: DataFrame, names: dict[str, str]) -> DataFrame:
    """The parts' means, one column for each metric, for every series of rows."""
    wide = parts.groupBy("unique_id").agg(*(F.avg(F.when(F.col("metric") == m, F.col("value"))).alias(c) for m, c in names.items()))
    return rows.select("unique_id").distinct().join(wide, "unique_id", "left")


def range_precision_recall(rows: DataFrame, *, existence: float = 0.0, merge_gap: int = 0, bias: str = "flat", cardinality: str = "reciprocal") -> DataFrame:
    """Per series, the means over its ranges. ``bias`` says which places of a range weigh most."""
    parts = range_parts(rows, existence=existence, merge_gap=merge_gap, bias=bias, cardinality=cardinality)
    return _of_series(rows, parts, {"range_precision": "precision", "range_recall": "recall"}).withColumn("f1", f1("precision", "recall"))


def affiliation_zones(rows: DataFrame) -> DataFrame:
    """(unique_id, a, b, z0, z1, p, r): each true event owns the zone nearest to it; flags (p) and
    event rows (r) are judged by distance against a random flag in the zone."""
    size = rows.groupBy("unique_id").agg((F.max("pos") + 1).alias("size"))
    order = Window.partitionBy("unique_id").orderBy("a")
    events = _ranges(rows, "label").join(size, "unique_id")
    zones = events.select(
        "unique_id", "a", "b",
        F.coalesce(F.floor((F.lag("b").over(order) + F.col("a")) / 2) + 1, F.lit(0)).alias("z0"),
        F.coalesce(F.floor((F.col("b") + F.lead("a").over(order)) / 2), F.col("size") - 1).alias("z1"),
    )
    inside = _latest(rows.select("unique_id", "pos", "flag", "label"), "pos", zones, "z0").where("pos <= r.z1").select("unique_id", "pos", "flag", "label", "r.*")
    key = ["unique_id", "a", "b", "z0", "z1"]
    ahead = Window.partitionBy(*key).orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    behind = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    mark = F.when(F.col("flag"), F.col("pos"))
    near = inside.withColumn("left", F.last(mark, True).over(behind)).withColumn("right", F.first(mark, True).over(ahead))
    n = F.least(F.col("pos") - F.col("left"), F.col("right") - F.col("pos"))
    d = F.greatest(F.col("a") - F.col("pos"), F.col("pos") - F.col("b"), F.lit(0))
    width = F.col("z1") - F.col("z0") + 1
    farther = F.greatest(F.col("a") - d - F.col("z0"), F.lit(0)) + F.greatest(F.col("z1") - F.col("b") - d, F.lit(0))
    covered = F.least(F.col("z1"), F.col("pos") + n) - F.greatest(F.col("z0"), F.col("pos") - n) + 1
    return near.groupBy(*key).agg(
        F.avg(F.when(F.col("flag"), farther / width)).alias("p"), F.avg(F.when(F.col("label"), F.coalesce(1 - covered / width, F.lit(0.0)))).alias("r")
    )


def affiliation(rows: DataFrame) -> DataFrame:
    """Per series, the means over the zones of its true events."""
    zones = affiliation_zones(rows).groupBy("unique_id").agg(F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.count("*").alias("n_zones"))
    return zones.withColumn("f1", f1("precision", "recall"))


def point_precision_recall(rows: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("flag") & F.col("label"))
    out = rows.groupBy("unique_id").agg(F.try_divide(hit, F.count_if("flag")).alias("precision"), F.try_divide(hit, F.count_if("label")).alias("recall"))
    return out.withColumn("f1", f1("precision", "recall"))


def pr_curve(rows: DataFrame) -> DataFrame:
    """One row for each distinct score, from the highest; missing scores come last."""
    score = F.when(F.isnan("score") | F.col("score").isNull(), float("-inf")).otherwise(F.col("score"))
    ties = rows.groupBy("unique_id", score.alias("threshold")).agg(F.count("*").alias("n"), F.count_if("label").alias("hits"))
    down = Window.partitionBy("unique_id").orderBy(F.desc("threshold")).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum("hits").over(Window.partitionBy("unique_id"))
    tp, n = F.sum("hits").over(down), F.sum("n").over(down)
    return ties.select("unique_id", "threshold", (tp / n).alias("precision"), F.try_divide(tp, total).alias("recall"))


def auc_pr(rows: DataFrame) -> DataFrame:
    """The stepwise area under the curve, and the share of positives for comparison."""
    before = F.coalesce(F.lag("recall").over(Window.partitionBy("unique_id").orderBy(F.desc("threshold"))), F.lit(0.0))
    area = pr_curve(rows).withColumn("gain", (F.col("recall") - before) * F.col("precision")).groupBy("unique_id").agg(F.sum("gain").alias("area"))
    base = rows.groupBy("unique_id").agg(F.avg(F.col("label").cast("double")).alias("baseline"), F.count_if("label").alias("n_positive"), F.count("*").alias("n_obs"))
    return base.join(area, "unique_id", "left")


def vus_pr(rows: DataFrame, *, max_buffer: int = 24) -> DataFrame:
    """The mean over buffers of ``range_auc_pr``'s area."""
    return range_auc_pr(rows, buffers=range(max_buffer + 1)).groupBy("unique_id").agg(F.avg("area").alias("vus_pr"))


def range_auc_pr(rows: DataFrame, *, buffers: Iterable[int]) -> DataFrame:
    """(unique_id, buffer, area): the area under the precision and range-aware recall curve, where
    labels fade out over half a buffer on either side of an event. What fades is dealt from the
    events to the rows around them."""
    buffers = sorted(set(buffers))
    table = rows.sparkSession.createDataFrame([(b,) for b in buffers], "buffer int")
    events = _ranges(rows, "label").select("unique_id", "a", "b", "island")
    steps = F.sequence(F.lit(1), F.lit(max(1, buffers[-1] // 2)))
    around = events.select("unique_id", "a", "b", F.explode(steps).alias("k")).select("unique_id", F.explode(F.array(F.col("a") - F.col("k"), F.col("b") + F.col("k"))).alias("pos"), "k")
    halo = around.groupBy("unique_id", "pos").agg(F.collect_list("k").alias("ks"))
    soft = rows.join(halo, ["unique_id", "pos"], "left").join(F.broadcast(table))
    fade = F.aggregate(F.coalesce("ks", F.array().cast("array<int>")), F.lit(0.0), lambda s, k: s + F.when(k <= F.floor(F.col("buffer") / 2), F.sqrt(1 - k / F.col("buffer"))).otherwise(0.0))
    soft = soft.withColumn("ext", F.least(F.col("label").cast("double") + fade, F.lit(1.0)))
    score = F.when(F.isnan("score") | F.col("score").isNull(), float("-inf")).otherwise(F.col("score"))
    ties = soft.groupBy("unique_id", "buffer", score.alias("threshold")).agg(F.sum("ext").alias("tp"), F.count("*").alias("n"))
    peaks = islands(rows.where("label")).groupBy("unique_id", "island").agg(F.max(score).alias("threshold"))
    seen = peaks.groupBy("unique_id", "threshold").agg(F.count("*").alias("seen"))
    counts = rows.where("label").groupBy("unique_id").agg(F.count("*").alias("positives")).join(events.groupBy("unique_id").agg(F.count("*").alias("n_events")), "unique_id")
    by = Window.partitionBy("unique_id", "buffer").orderBy(F.desc("threshold"))
    down = by.rowsBetween(Window.unboundedPreceding, 0)
    curve = ties.join(seen, ["unique_id", "threshold"], "left").join(counts, "unique_id")
    tp, n, share = F.sum("tp").over(down), F.sum("n").over(down), F.coalesce(F.sum("seen").over(down), F.lit(0)) / F.col("n_events")
    curve = curve.select("unique_id", "buffer", "threshold", (tp / n).alias("precision"), (F.least(tp / ((F.col("buffer") + 1) * F.col("positives")), F.lit(1.0)) * share).alias("recall"))
    before = lambda c, first: F.coalesce(F.lag(c).over(by), F.lit(first))
    gain = (F.col("recall") - before("recall", 0.0)) * (F.col("precision") + before("precision", 1.0)) / 2
    return curve.withColumn("gain", gain).groupBy("unique_id", "buffer").agg(F.sum("gain").alias("area"))


def event_delays(rows: DataFrame) -> DataFrame:
    """(unique_id, island, a, delay) of each true event; no delay where no flag lies in it."""
    true = _ranges(rows, "label")
    hits = _latest(rows.where("flag").select("unique_id", "pos"), "pos", true, "a").where("pos <= r.b")
    first = hits.groupBy("unique_id", F.col("r.island").alias("island")).agg(F.min("pos").alias("first"))
    return true.join(first, ["unique_id", "island"], "left").select("unique_id", "island", "a", (F.col("first") - F.col("a")).alias("delay"))


def false_alarms(rows: DataFrame, *, merge_gap: int = 0) -> DataFrame:
    """(unique_id, a, b) of the ranges found that meet no true range."""
    found = _ranges(rows, "flag", merge_gap).select("unique_id", "a", "b")
    met = _latest(found, "b", _ranges(rows, "label").select("unique_id", F.col("a").alias("ta"), F.col("b").alias("tb")), "ta")
    return met.where("r is null or r.tb < a").drop("r")


def detection_delay(rows: DataFrame, *, merge_gap: int = 0, per: int = 1000) -> DataFrame:
    """First hits of true events, their delays, and events of flags that meet no true event."""
    per_series = event_delays(rows).groupBy("unique_id").agg(
        F.count("*").alias("n_true_events"), F.count("delay").alias("n_detected"), F.avg("delay").alias("mean_delay"), F.median("delay").alias("median_delay")
    )
    alarms = false_alarms(rows, merge_gap=merge_gap).groupBy("unique_id").agg(F.count("*").alias("n_false_alarms"))
    out = rows.groupBy("unique_id").agg(F.count("*").alias("n_obs")).join(per_series, "unique_id", "left").join(alarms, "unique_id", "left").na.fill(0, ["n_false_alarms", "n_true_events", "n_detected"])
    return out.withColumn("detection_rate", F.try_divide("n_detected", "n_true_events")).withColumn("false_alarms_per", per * F.col("n_false_alarms") / F.col("n_obs"))


def common_support(scores: DataFrame) -> DataFrame:
    """Rows (detector_id, unique_id, ds, scorable): where every detector can score. ``aligned`` is
    false where a detector lacks the row."""
    n = scores.select("detector_id").distinct().count()
    return scores.groupBy("unique_id", "ds").agg(F.bool_and("scorable").alias("scorable"), (F.count_distinct("detector_id") == n).alias("aligned"))


def support_rows(scores: DataFrame, truth: DataFrame, *, alpha: float) -> DataFrame:
    """Scorable rows with places counted after the others are gone."""
    labels = truth.groupBy("unique_id", "ds").agg(F.bool_or("is_anomaly").alias("label"))
    rows = scores.where("scorable").join(labels, ["unique_id", "ds"], "left").withColumn("label", F.coalesce("label", F.lit(False)))
    flag = F.coalesce(F.col("score") >= -F.log10(F.lit(alpha)), F.lit(False))
    return rows.select("unique_id", "ds", (F.row_number().over(Window.partitionBy("unique_id").orderBy("ds")) - 1).alias("pos"), flag.alias("flag"), "label", "score")


#: What can be said of one kind of anomaly alone: a false alarm has no kind.
OF_KINDS = ("range_recall", "affiliation_recall", "detection_rate", "detection_delay_mean", "detection_delay_median", "auc_pr", "auc_pr_baseline")


def evaluate_by_type(rows: DataFrame, types: Iterable[str], *, detector_id: str, merge_gap: int = 2, max_buffer: int = 24) -> DataFrame:
    """``evaluate_detector`` with anomaly_type: 'all', and each of ``types`` (a few names) by itself,
    for which instants of the other kinds are taken out of the support, since finding them is no
    fault. ``rows`` has anomaly_type beside the label."""
    rest = [c for c in rows.columns if c not in ("pos", "anomaly_type")]
    out = evaluate_detector(rows.drop("anomaly_type"), detector_id=detector_id, merge_gap=merge_gap, max_buffer=max_buffer).withColumn("anomaly_type", F.lit("all"))
    order = Window.partitionBy("unique_id").orderBy("ds")
    for kind in types:
        own = F.coalesce(F.col("anomaly_type") == kind, F.lit(False))
        here = rows.where(~F.col("label") | own).withColumn("label", F.col("label") & own).select(*rest, (F.row_number().over(order) - 1).alias("pos"))
        part = evaluate_detector(here, detector_id=detector_id, merge_gap=merge_gap, recall_only=True)
        out = out.union(part.withColumn("anomaly_type", F.lit(kind)).select(*out.columns))
    return out


def evaluate_detector(rows: DataFrame, *, detector_id: str, merge_gap: int = 2, max_buffer: int = 24, recall_only: bool = False) -> DataFrame:
    """A long table (detector_id, unique_id, metric, value, n_obs, n_events) of each series and,
    with a null unique_id, of all series together: there ranges, zones, events and rows are pooled
    before their means are taken, and only the areas under curves are means of the series' areas."""
    zones = affiliation_zones(rows)
    delays = event_delays(rows)
    value = lambda name, c: F.struct(F.lit(name).alias("metric"), F.col(c).cast("double").alias("value"))
    of_zones = zones.select("unique_id", F.explode(F.array(value("affiliation_precision", "p"), value("affiliation_recall", "r"))).alias("x")).select("unique_id", "x.*")
    areas = auc_pr(rows).select("unique_id", F.lit("auc_pr").alias("metric"), F.col("area").alias("value"))
    if not recall_only:
        areas = areas.union(vus_pr(rows, max_buffer=max_buffer).select("unique_id", F.lit("vus_pr"), "vus_pr"))
    parts = range_parts(rows, merge_gap=merge_gap).union(of_zones).union(areas)
    late = delays.select("unique_id", F.lit("delay").alias("metric"), F.col("delay").cast("double").alias("value"))
    sets = [["unique_id", "metric"], ["metric"]]
    means = parts.groupingSets(sets, "unique_id", "metric").agg(F.avg("value").alias("value"), F.grouping("unique_id").alias("g"))
    # Detection: every event counts, its delay only where it has one.
    of_events = late.groupingSets([["unique_id"], []], "unique_id").agg(
        F.grouping("unique_id").alias("g"), F.count("*").alias("n_events"), (F.count("value") / F.count("*")).alias("detection_rate"),
        F.avg("value").alias("detection_delay_mean"), F.median("value").alias("detection_delay_median"),
    )
    hit = F.count_if(F.col("flag") & F.col("label"))
    of_rows = rows.groupingSets([["unique_id"], []], "unique_id").agg(
        F.grouping("unique_id").alias("g"), F.count("*").alias("n_obs"), F.try_divide(hit, F.count_if("flag")).alias("point_precision"),
        F.try_divide(hit, F.count_if("label")).alias("point_recall"), F.avg(F.col("label").cast("double")).alias("auc_pr_baseline"),
    )
    alarms = false_alarms(rows, merge_gap=merge_gap).groupingSets([["unique_id"], []], "unique_id").agg(F.grouping("unique_id").alias("g"), F.count("*").alias("n_false_alarm_events"))
    same = lambda other: F.col("k").eqNullSafe(F.col(f"{other}_k"))
    keyed = lambda df, name: df.where("g = 1 or unique_id is not null").withColumnRenamed("unique_id", f"{name}_k").drop("g")
    names = ("range_precision", "range_recall", "affiliation_precision", "affiliation_recall", "auc_pr", "vus_pr")
    wide = means.groupBy("unique_id", "g").agg(*(F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in names))
    base = of_rows.withColumnRenamed("unique_id", "k").drop("g")
    for df, name in ((wide, "means"), (of_events, "events"), (alarms, "alarms")):
        base = base.join(keyed(df, name), same(name), "left").drop(f"{name}_k")
    base = base.na.fill(0, ["n_events", "n_false_alarm_events"])
    base = base.withColumn("false_alarms_per_1000", 1000 * F.col("n_false_alarm_events") / F.col("n_obs"))
    for kind in ("range", "affiliation", "point"):
        base = base.withColumn(f"{kind}_f1", f1(f"{kind}_precision", f"{kind}_recall"))
    metrics = [c for c in base.columns if c not in ("k", "n_obs", "n_events") and (c in OF_KINDS or not recall_only)]
    long = base.select("k", "n_obs", "n_events", *(F.col(c).cast("double").alias(c) for c in metrics)).unpivot(["k", "n_obs", "n_events"], metrics, "metric", "value")
    return long.where("value is not null").select(F.lit(detector_id).alias("detector_id"), F.col("k").alias("unique_id"), "metric", "value", "n_obs", "n_events")
