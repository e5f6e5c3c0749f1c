"""How far a scan of the catalogue has come, and what it has met."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, functions as F


def observed(decoded: DataFrame, name: str = "scan") -> tuple[DataFrame, Observation]:
    """``decoded`` (contour, error) as it is, and an observation that any action on it
    fills: ``scanned`` tracks, ``failed`` ones whose blob cannot be read, ``skipped`` ones
    without frames, and ``frames``. Each task's counts enter once, when it has
    succeeded; they come with the job's own tasks, no pass more. While a streaming
    query runs, ``QueryProgressEvent.observedMetrics`` has them batch by batch.
    """
    seen = Observation(name)
    bad = F.col("error").isNotNull()
    size = F.coalesce(F.size("contour"), F.lit(0))
    counts = (F.count(F.lit(1)).alias("scanned"), F.count(F.when(bad, 1)).alias("failed"), F.count(F.when(~bad & (size <= 0), 1)).alias("skipped"), F.coalesce(F.sum(F.greatest(size, F.lit(0)).cast("long")), F.lit(0).cast("long")).alias("frames"))
    return decoded.observe(seen, *counts), seen
