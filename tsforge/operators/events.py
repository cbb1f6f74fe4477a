"""Anomaly flags to events (gaps and islands), truth events, and their matching."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.panel import by_series, missing, seconds


def islands(flagged: DataFrame, *, merge_gap: int = 0, position: str = "pos", by: tuple[str, ...] = ("unique_id",)) -> DataFrame:
    """Adds ``island``: the number of the run that a flagged row belongs to; runs no more than
    ``merge_gap`` rows apart are one."""
    order = Window.partitionBy(*by).orderBy(position)
    starts = F.coalesce((F.col(position) - F.lag(position).over(order) - 1 > merge_gap).cast("int"), F.lit(0))
    return flagged.withColumn("_s", starts).withColumn("island", F.sum("_s").over(order)).drop("_s")


def runs_to_ranges(rows: DataFrame, flag: Column, *, merge_gap: int = 0, order: str = "ds") -> DataFrame:
    """(unique_id, island, start_pos, end_pos, n_points) of the runs where ``flag`` holds."""
    placed = rows.withColumn("pos", F.row_number().over(Window.partitionBy("unique_id").orderBy(order)) - 1)
    marked = islands(placed.where(flag), merge_gap=merge_gap)
    return marked.groupBy("unique_id", "island").agg(F.min("pos").alias("start_pos"), F.max("pos").alias("end_pos"), F.count("*").alias("n_points"))


def threshold_table(calibration: DataFrame, alphas: tuple[float, ...]) -> DataFrame:
    """-log10(alpha) for each alpha, and whether any calibration score reaches it."""
    top = calibration.where("scorable").agg(F.max(missing("score")).alias("ceiling"))
    each = F.explode(F.array(*map(F.lit, alphas))).alias("alpha")
    threshold = -F.log10("alpha")
    return top.select("ceiling", each).select("alpha", threshold.alias("threshold"), F.coalesce(threshold <= F.col("ceiling"), F.lit(True)).alias("reachable"))


def aggregate_events(scores: DataFrame, *, detector_id: str, alpha: float, merge_gap: int = 2, min_points: int = 1) -> DataFrame:
    """Events of the rows that are scorable and reach -log10(alpha)."""
    placed = scores.withColumn("pos", F.row_number().over(by_series()))
    hit = F.col("scorable") & (missing("score") >= -F.log10(F.lit(alpha)))
    marked = islands(placed.where(hit), merge_gap=merge_gap)
    severity = missing("severity")
    first = F.min_by("ds", F.struct(F.coalesce(-severity, F.lit(float("inf"))).alias("s"), F.col("pos")))
    events = marked.groupBy("unique_id", "island").agg(
        F.min("ds").alias("start_ds"), F.max("ds").alias("end_ds"), F.count("*").alias("n_points"), (F.max("pos") - F.min("pos") + 1).alias("duration_steps"),
        F.max(missing("score")).alias("peak_score"), F.max(severity).alias("peak_severity"), F.sum(severity).alias("cum_severity"), first.alias("peak_ds"),
        F.when((F.min("side") == 1) & (F.max("side") == 1), "over").when((F.min("side") == -1) & (F.max("side") == -1), "under").otherwise("mixed").alias("direction"),
    ).where(F.col("n_points") >= min_points)
    name = F.concat_ws("|", F.lit(detector_id), "unique_id", F.lit(f"{alpha:.4f}"), F.date_format("start_ds", "yyyyMMdd'T'HHmm"))
    return events.drop("island").select(F.lit(detector_id).alias("detector_id"), "unique_id", name.alias("event_id"), F.lit(alpha).alias("alpha"), *events.drop("island").columns[1:])


def truth_events(truth: DataFrame) -> DataFrame:
    return truth.where("is_anomaly").groupBy("unique_id", "event_id").agg(
        F.min("ds").alias("start_ds"), F.max("ds").alias("end_ds"), F.count("*").alias("n_points"), F.min_by("anomaly_type", "ds").alias("anomaly_type")
    )


def overlaps(detected: DataFrame, truth: DataFrame, *, tolerance_seconds: int = 0, slot_seconds: int = 7 * 86400) -> DataFrame:
    """Pairs of a detected and a true event of one series that overlap, with the overlap in
    seconds. Events meet in the time slots that they touch, and a pair counts in the slot where
    the later of the two begins."""
    reach = F.expr(f"INTERVAL {tolerance_seconds} SECONDS")

    def dealt(df: DataFrame, start: Column, end: Column) -> DataFrame:
        slots = F.sequence(F.floor(seconds(start) / slot_seconds), F.floor(seconds(end) / slot_seconds))
        return df.withColumn("slot", F.explode(slots))

    t = truth.select("unique_id", F.col("event_id").alias("truth_id"), F.col("start_ds").alias("t_start"), F.col("end_ds").alias("t_end"))
    t = dealt(t, F.col("t_start") - reach, F.col("t_end") + reach)
    d = dealt(detected.select("unique_id", "event_id", "start_ds", "end_ds"), F.col("start_ds"), F.col("end_ds"))
    span = F.timestamp_diff("SECOND", F.greatest("start_ds", "t_start"), F.least("end_ds", "t_end")) + 2 * tolerance_seconds
    touching = (F.col("start_ds") <= F.col("t_end") + reach) & (F.col("t_start") <= F.col("end_ds") + reach)
    begins = F.floor(seconds(F.greatest(F.col("start_ds"), F.col("t_start") - reach)) / slot_seconds)
    return d.join(t, ["unique_id", "slot"]).where(touching & (F.col("slot") == begins)).select("unique_id", "event_id", "truth_id", "start_ds", "t_start", span.alias("overlap"))


def match_events(detected: DataFrame, truth: DataFrame, *, tolerance_seconds: int = 0) -> DataFrame:
    """One to one, the largest overlap first: hits, false alarms and missed events."""

    def greedy(pairs: pd.DataFrame) -> pd.DataFrame:
        taken, given, kept = set(), set(), []
        for r in pairs.sort_values(["overlap", "start_ds", "t_start", "event_id", "truth_id"], ascending=[False, True, True, True, True]).itertuples():
            if r.event_id not in taken and r.truth_id not in given:
                taken.add(r.event_id)
                given.add(r.truth_id)
                kept.append((r.unique_id, r.event_id, r.truth_id))
        return pd.DataFrame(kept, columns=["unique_id", "event_id", "truth_id"])

    # A group is the overlapping pairs of one series, as many as it has events.
    pairs = overlaps(detected, truth, tolerance_seconds=tolerance_seconds).groupBy("unique_id").applyInPandas(greedy, "unique_id string, event_id string, truth_id string")
    mine = detected.select("unique_id", "event_id", "start_ds", "end_ds").join(pairs, ["unique_id", "event_id"], "left")
    hits = mine.select("unique_id", "event_id", F.col("truth_id").alias("matched_truth_event_id"), F.when(F.col("truth_id").isNull(), "false_alarm").otherwise("hit").alias("match_kind"), "start_ds", "end_ds")
    found = pairs.select("unique_id", F.col("truth_id").alias("event_id"))
    gone = truth.join(found, ["unique_id", "event_id"], "left_anti")
    missed = gone.select("unique_id", F.lit(None).cast("string").alias("event_id"), F.col("event_id").alias("matched_truth_event_id"), F.lit("missed").alias("match_kind"), "start_ds", "end_ds")
    return hits.unionByName(missed)
