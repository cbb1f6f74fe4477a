"""Streams: hourly sums with a watermark, and running anomaly scores by series."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCORED = "unique_id string, ds timestamp, y double, z double"


def hourly(stream: DataFrame, *, late: str = "2 hours", ds: str = "ds", value: str = "y") -> DataFrame:
    """Sums an hour; an hour is given out once nothing as late as ``late`` can change it."""
    hours = stream.withWatermark(ds, late).groupBy("unique_id", F.window(ds, "1 hour").alias("w"))
    return hours.agg(F.sum(value).alias(value), F.count("*").alias("n")).select("unique_id", F.col("w.start").alias("ds"), value, "n")


def running_z(stream: DataFrame, *, half_life: float = 48.0) -> DataFrame:
    """Each row (unique_id, ds, y) with its deviation from the series' running mean in running
    standard deviations, before the row is counted itself. A series' state is three numbers. Within
    a micro-batch rows count in the order of time, so a series' rows of one micro-batch are held at
    once (the source's options say how large those are); a row that comes in a later micro-batch
    counts after all earlier ones. Rows without a finite value have no score and don't count."""
    keep = 0.5 ** (1 / half_life)

    def score(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        weight, mean, square = state.get if state.exists else (0.0, 0.0, 0.0)
        rows, z = pd.concat(batches).sort_values(["ds", "y"]), []
        for y in rows["y"].to_numpy(float):
            if not math.isfinite(y):
                z.append(None)
                continue
            spread = (square / weight) ** 0.5 if weight > 2 else 0.0
            z.append((y - mean) / spread if spread > 0 else None)
            weight = weight * keep + 1
            step = y - mean
            mean += step / weight
            square = square * keep + step * (y - mean)
        state.update((float(weight), float(mean), float(square)))
        yield pd.DataFrame({"unique_id": key[0], "ds": rows["ds"], "y": rows["y"], "z": pd.array(z, "Float64")})

    return stream.groupBy("unique_id").applyInPandasWithState(score, SCORED, "weight double, mean double, square double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, folder: str, name: str) -> DataFrame:
    """Runs a stream over all that its source holds now, into Parquet below ``folder``, and reads
    it. A second run with the same folder carries on from where the first one stopped."""
    place = f"{folder.rstrip('/')}/{name}"
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")
