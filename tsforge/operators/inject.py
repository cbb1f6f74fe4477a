"""Synthetic anomalies: a small table of specs, joined to the panel by series and span."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.panel import Panel, missing

KINDS = ("spike", "level_shift", "variance_shift", "seasonal_phase", "sensor_freeze", "data_gap")


@dataclass(frozen=True)
class AnomalySpec:
    kind: str
    unique_id: str
    start: datetime
    duration: int
    magnitude: float
    direction: int = 1  # 0: either, at random

    def __post_init__(self):
        if self.kind not in KINDS or self.duration < 1 or self.magnitude <= 0 or self.direction not in (-1, 0, 1):
            raise ValueError("a kind that is known, a positive duration and magnitude, direction 1, -1 or 0")


def inject(panel: Panel, specs: list[AnomalySpec], *, reference: int | None = None, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(panel rows with anomalies, truth of the points that changed). Every spec reads the original
    panel; where spans meet, the first spec holds. Sigma is the robust spread of the ``reference``
    rows before the start. A data gap drops ``magnitude`` of its span's rows (one at least). What is
    chosen at random, which rows a gap drops and the direction of a spec without one, follows from
    hashes of ``seed``, event and instant."""
    spark, step, y = panel.df.sparkSession, panel.spec.step, panel.spec.target
    reference = reference or 2 * max(panel.spec.seasonalities)
    rows = [(i, s.kind, s.unique_id, s.start, s.duration, float(s.magnitude), s.direction) for i, s in enumerate(specs)]
    table = spark.createDataFrame(rows, "n int, kind string, unique_id string, start timestamp_ntz, duration int, magnitude double, direction int")
    table = table.withColumn("stop", (F.col("start") + F.make_dt_interval(secs=(F.col("duration") - 1) * step)).cast("timestamp_ntz"))
    table = table.withColumn("event_id", F.concat_ws("|", "kind", "unique_id", F.date_format("start", "yyyyMMdd'T'HHmm")))
    either = F.when(F.pmod(F.xxhash64(F.lit(seed), "event_id"), F.lit(2)) == 0, 1).otherwise(-1)
    table = table.withColumn("direction", F.when(F.col("direction") == 0, either).otherwise(F.col("direction")))
    base = panel.df.select("unique_id", "ds", missing(y).alias("v"))
    back = F.make_dt_interval(secs=F.lit(reference * step))
    before = base.join(F.broadcast(table.select("n", "unique_id", "start")), "unique_id").where((F.col("ds") < F.col("start")) & (F.col("ds") >= F.col("start") - back))
    centre = before.groupBy("n").agg(F.median("v").alias("mu"))
    spread = before.join(F.broadcast(centre), "n").groupBy("n", "mu").agg((1.4826 * F.median(F.abs(F.col("v") - F.col("mu")))).alias("sigma"))
    first = base.join(F.broadcast(table.select("n", "unique_id", F.col("start").alias("ds"))), ["unique_id", "ds"]).select("n", F.col("v").alias("held"))
    known = table.join(spread, "n", "left").join(first, "n", "left").withColumn("mu", F.coalesce("mu", F.lit(0.0))).withColumn("sigma", F.greatest(F.coalesce("sigma", F.lit(1.0)), F.lit(1e-8)))
    shifted = table.where("kind = 'seasonal_phase'").select("n", "unique_id", "start", "stop", F.make_dt_interval(secs=F.col("magnitude").cast("int") * step).alias("back"))
    earlier = base.join(F.broadcast(shifted), "unique_id").where((F.col("ds") + F.col("back")).between(F.col("start"), F.col("stop")))
    earlier = earlier.select("n", "unique_id", (F.col("ds") + F.col("back")).cast("timestamp_ntz").alias("ds"), F.col("v").alias("phased"))
    inside = base.join(F.broadcast(known), "unique_id").where(F.col("ds").between(F.col("start"), F.col("stop"))).join(earlier, ["n", "unique_id", "ds"], "left")
    lot = Window.partitionBy("n").orderBy(F.xxhash64(F.lit(seed), "event_id", "ds"), "ds")
    # Spans are short beside the panel: a window holds the rows of one spec.
    inside = inside.withColumn("lot", F.row_number().over(lot)).withColumn("rows", F.count("*").over(Window.partitionBy("n")))
    dropped = F.col("lot") <= F.greatest(F.lit(1), F.round(F.col("magnitude") * F.col("rows")))
    move = F.col("direction") * F.col("magnitude") * F.col("sigma")
    new = (
        F.when(F.col("kind").isin("spike", "level_shift"), F.col("v") + move)
        .when(F.col("kind") == "variance_shift", F.col("mu") + (F.col("v") - F.col("mu")) * F.col("magnitude"))
        .when(F.col("kind") == "seasonal_phase", F.coalesce("phased", "v")).when(F.col("kind") == "sensor_freeze", F.col("held"))
        .when(F.col("kind") == "data_gap", F.when(~dropped, F.col("v")))
    )
    hit = inside.withColumn("new", new).where(~F.col("v").eqNullSafe(F.col("new")))
    hit = hit.groupBy("unique_id", "ds").agg(F.min_by(F.struct("kind", "event_id", "new", "v", "sigma"), "n").alias("x"))
    changed = panel.df.join(hit, ["unique_id", "ds"], "left")
    out = changed.select(*(F.when(F.col("x").isNotNull(), F.col("x.new")).otherwise(F.col(c).cast("double")).alias(c) if c == y else F.col(c) for c in panel.df.columns))
    severity = F.abs(F.col("x.new") - F.col("x.v")) / F.col("x.sigma")
    truth = hit.select("unique_id", "ds", F.lit(True).alias("is_anomaly"), F.col("x.event_id").alias("event_id"), F.col("x.kind").alias("anomaly_type"), severity.alias("severity"))
    return out, truth
