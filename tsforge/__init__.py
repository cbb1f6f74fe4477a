"""Time-series analytics over long-format panels, as Spark jobs."""
