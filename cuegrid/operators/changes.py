"""Snapshots compared, and one row of many for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _of_each(df: DataFrame, by: list[str], order: list[str], pick) -> DataFrame:
    """A grouped minimum or maximum of whole rows, which combines before the shuffle; ``order`` must tell rows apart."""
    rest = [c for c in df.columns if c not in by and c not in order]
    best = df.groupBy(*by).agg(pick(F.struct(*order, *rest)).alias("_r"))
    return best.select(*by, *[F.col(f"_r.{c}").alias(c) for c in df.columns if c not in by])


def first_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return _of_each(df, by, order, F.min)


def last_wins(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return _of_each(df, by, order, F.max)


def added(after: DataFrame, before: DataFrame, by: list[str]) -> DataFrame:
    """Distinct rows of after that before does not have."""
    return after.select(*by).distinct().join(before.select(*by).distinct(), by, "left_anti")


def map_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, before, after) of keys whose value (v) is not the same on both sides."""
    both = before.select("key", F.col("v").alias("before")).join(after.select("key", F.col("v").alias("after")), "key", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def snapshot_diff(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """(by, what): new, gone or changed, for rows whose fingerprint (k) differs."""
    both = old.select(*by, F.col("k").alias("a")).join(new.select(*by, F.col("k").alias("z")), by, "full_outer").where(~F.col("a").eqNullSafe(F.col("z")))
    return both.select(*by, F.when(F.col("a").isNull(), "new").when(F.col("z").isNull(), "gone").otherwise("changed").alias("what"))


def known_or_not(df: DataFrame, known: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    return df.join(known, by, "left_semi"), df.join(known, by, "left_anti")


def unsettled(rows: DataFrame, settled: DataFrame, by: list[str], batch: list[str]) -> DataFrame:
    """(batch, n): the batches that are not settled as a whole, and so run again whole."""
    marked = rows.join(settled.select(*by).distinct().withColumn("_done", F.lit(True)), by, "left")
    done = F.bool_and(F.coalesce("_done", F.lit(False)))
    return marked.groupBy(*batch).agg(F.count(F.lit(1)).alias("n"), done.alias("_all")).where("NOT _all").drop("_all")
