"""Mergeable moments of two measures over an event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_moments(events: DataFrame, x: str, y: str, by: list[str], time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, by..., n, sx, sy, sxx, syy, sxy) per tumbling window; works on batches and, behind a watermark, on streams.

    Correlation is a function of these sums, and sums of windows add up.
    """
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    src = events.withWatermark(time, late) if events.isStreaming else events
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    g = src.groupBy(F.window(time, width).alias("w"), *by).agg(F.count("*").alias("n"), F.sum(a).alias("sx"), F.sum(b).alias("sy"), F.sum(a * a).alias("sxx"), F.sum(b * b).alias("syy"), F.sum(a * b).alias("sxy"))
    return g.select(F.col("w.start").alias("start"), *by, "n", "sx", "sy", "sxx", "syy", "sxy")


def correlation_of(moments: DataFrame, by: list[str]) -> DataFrame:
    """(by..., n, cor) over all windows."""
    s = moments.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")))
    d = (F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")) * (F.col("n") * F.col("syy") - F.col("sy") * F.col("sy"))
    r = (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.nullif(F.sqrt(F.greatest(d, F.lit(0.0))), F.lit(0.0))
    return s.select(*by, "n", F.coalesce(r, F.lit(0.0)).alias("cor"))
