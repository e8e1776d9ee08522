"""Progress and stage events of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def totals(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """rows (with bytes) with ``total``: a counter that starts again below its last value adds that value to what is finished."""
    w = Window.partitionBy(*by).orderBy(*order)
    last = F.lag("bytes").over(w)
    fell = F.when(F.col("bytes") < last, last).otherwise(F.lit(0))
    return rows.withColumn("_fell", fell).withColumn("total", F.col("bytes") + F.sum("_fell").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_fell")


def stages(rows: DataFrame, by: list[str], order: list[str], at: str = "at") -> DataFrame:
    """A row for each stage that a job opens (events of one stage in a row are one), with opened and closed: when the next opens, or the job's last event."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = rows.withColumn("_last", F.lag("stage").over(w)).withColumn("_end", F.max(at).over(Window.partitionBy(*by)))
    opened = marked.where(~F.col("_last").eqNullSafe(F.col("stage")))
    return opened.withColumn("closed", F.coalesce(F.lead(at).over(w), "_end")).withColumnRenamed(at, "opened").drop("_last", "_end")
