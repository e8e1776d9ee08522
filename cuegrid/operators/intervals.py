"""Joins and unions of time intervals. Every table has a recording; nothing meets across recordings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap_join(left: DataFrame, right: DataFrame, *, by: list[str], reach: float = 0.0, width: float = 30.0) -> DataFrame:
    """All pairs of rows of one key whose intervals meet, touch or lie at most ``reach`` apart.

    Both sides have start_s and end_s; the right side's columns other than the key get the prefix ``r_``. Intervals go to
    bins of ``width`` seconds and are joined on key and bin, so a long recording is spread over many tasks. A pair is
    kept in the first bin that both share only.
    """
    lo = lambda c: F.floor(c / width).cast("long")
    renamed = right.select(*by, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in by])
    a = left.withColumn("_from", lo(F.col("start_s") - reach)).withColumn("_bin", F.explode(F.sequence("_from", F.greatest("_from", lo(F.col("end_s") + reach)))))
    b = renamed.withColumn("_rfrom", lo(F.col("r_start_s"))).withColumn("_bin", F.explode(F.sequence("_rfrom", F.greatest("_rfrom", lo(F.col("r_end_s"))))))
    met = a.join(b, [*by, "_bin"]).where(F.col("_bin") == F.greatest("_from", "_rfrom"))
    near = (F.col("r_start_s") <= F.col("end_s") + reach) & (F.col("r_end_s") >= F.col("start_s") - reach)
    return met.where(near).drop("_bin", "_from", "_rfrom")


def shared() -> Column:
    """Seconds that a pair of overlap_join has in common; negative for a gap."""
    return F.least("end_s", "r_end_s") - F.greatest("start_s", "r_start_s")


def union(rows: DataFrame, *, by: list[str], tolerance: float = 0.0, strict: bool = False) -> DataFrame:
    """(by, start_s, end_s, n): intervals that meet are one; with ``strict`` the gap must be less than the tolerance."""
    order = Window.partitionBy(*by).orderBy("start_s", "end_s")
    reached = F.max("end_s").over(order.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.col("start_s") - reached
    broken = F.coalesce(gap >= tolerance if strict else gap > tolerance, F.lit(True))
    marked = rows.withColumn("_new", broken.cast("int")).withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*by, "_island").agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s"), F.count(F.lit(1)).alias("n")).drop("_island")


def speaker_names(turns: DataFrame) -> DataFrame:
    """(recording_id, speaker, name): speaker_0, speaker_1, ... by first appearance."""
    first = turns.groupBy("recording_id", "speaker").agg(F.min(F.struct("start_s", "id")).alias("f"))
    rank = F.row_number().over(Window.partitionBy("recording_id").orderBy("f")) - 1
    return first.select("recording_id", "speaker", F.concat(F.lit("speaker_"), rank).alias("name"))


def speaker_of(segments: DataFrame, turns: DataFrame, *, fallback: str = "speaker_0", within: float = 1.0) -> DataFrame:
    """segments with speaker_name: of the speaker with the most overlap (the first seen wins ties), else of the nearest turn within so many seconds, else the fallback."""
    pairs = overlap_join(segments.select("recording_id", "id", "start_s", "end_s"), turns.select("recording_id", "id", "start_s", "end_s", "speaker"), by=["recording_id"], reach=within)
    pairs = pairs.withColumn("ord", F.struct("r_start_s", "r_id")).withColumn("shared", F.greatest(shared(), F.lit(0.0))).withColumn("gap", F.greatest(-shared(), F.lit(0.0)))
    by_speaker = pairs.groupBy("recording_id", "id", "r_speaker").agg(F.sum("shared").alias("total"), F.min(F.when(F.col("shared") > 0, F.col("ord"))).alias("first"), F.min(F.struct("gap", "ord")).alias("near"))
    best = by_speaker.groupBy("recording_id", "id").agg(
        F.min(F.when(F.col("total") > 0, F.struct((-F.col("total")).alias("t"), "first", "r_speaker"))).alias("most"), F.min(F.struct("near", "r_speaker")).alias("nearest")
    )
    chosen = best.select("recording_id", "id", F.coalesce("most.r_speaker", "nearest.r_speaker").alias("speaker"))
    named = chosen.join(speaker_names(turns), ["recording_id", "speaker"]).select("recording_id", "id", F.col("name").alias("speaker_name"))
    return segments.join(named, ["recording_id", "id"], "left").withColumn("speaker_name", F.coalesce("speaker_name", F.lit(fallback)))


def snap_to_speech(segments: DataFrame, regions: DataFrame, *, window: float, least: float = 0.15) -> DataFrame:
    """segments with edges moved to the speech they hold: the start within the window, the end within it or where speech ended before (but not before last_word_s, if there is one)."""
    pairs = overlap_join(segments.select("recording_id", "id", "start_s", "end_s"), regions.select("recording_id", "start_s", "end_s"), by=["recording_id"])
    real = pairs.where((shared() > 0) & ((shared() >= least) | (shared() >= (F.col("r_end_s") - F.col("r_start_s")) * 0.5)))
    edges = real.groupBy("recording_id", "id").agg(F.min(F.struct("r_start_s", "r_end_s")).alias("a"), F.max(F.struct("r_start_s", "r_end_s")).alias("z"))
    out = segments.join(edges, ["recording_id", "id"], "left")
    first, last = F.col("a.r_start_s"), F.col("z.r_end_s")
    word = F.col("last_word_s") if "last_word_s" in segments.columns else F.lit(None).cast("double")
    start = F.when(F.abs(first - F.col("start_s")) <= window, first).otherwise(F.col("start_s"))
    end = F.when(F.abs(last - F.col("end_s")) <= window, last).when(last < F.col("end_s"), F.greatest(last, word)).otherwise(F.col("end_s"))
    fits = F.col("a").isNotNull() & (end > start)
    return out.select(*segments.columns, F.when(fits, start).otherwise(F.col("start_s")).alias("snapped_start"), F.when(fits, end).otherwise(F.col("end_s")).alias("snapped_end"))


def claims(golden: DataFrame, produced: DataFrame) -> DataFrame:
    """(recording_id, g_id, p_id, ...): each produced row goes to the first reference row that it truly lies in."""
    pairs = overlap_join(golden.select("recording_id", "id", "start_s", "end_s"), produced.select("recording_id", "id", "start_s", "end_s"), by=["recording_id"])
    half = (F.col("r_end_s") - F.col("r_start_s")) * 0.5
    fits = pairs.where((shared() > 0) & ((shared() >= F.least(F.lit(0.15), half)) | (shared() >= half)))
    first = Window.partitionBy("recording_id", "r_id").orderBy("start_s", "id")
    return fits.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").drop("_rn")


def evaluate(golden: DataFrame, produced: DataFrame) -> DataFrame:
    """A row for each reference row: n produced rows, deviations of their outer edges in ms (null without any)."""
    own = claims(golden, produced)
    groups = own.groupBy("recording_id", "id").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("r_start_s", "r_id")).alias("a"), F.max(F.struct("r_start_s", "r_id", "r_end_s")).alias("z")
    )
    out = golden.join(groups, ["recording_id", "id"], "left")
    ms = lambda x: F.floor(x * 1000 + F.lit(0.5)).cast("long")
    return out.select("recording_id", "id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), ms(F.col("a.r_start_s") - F.col("start_s")).alias("start_ms"), ms(F.col("z.r_end_s") - F.col("end_s")).alias("end_ms"))


def evaluation_report(golden: DataFrame, produced: DataFrame, *, tolerance_ms: int = 250) -> DataFrame:
    """One row for each recording that has reference or produced rows."""
    rows = evaluate(golden, produced)
    hit = F.col("n") > 0
    good = lambda c: (F.abs(c) <= tolerance_ms).cast("long")
    by = rows.groupBy("recording_id").agg(
        F.count_if(hit).alias("matched"), F.count_if(F.col("n") > 1).alias("split"), F.count_if(~hit).alias("missing"), F.sum("n").alias("claimed"),
        F.coalesce(F.sum(good(F.col("start_ms")) + good(F.col("end_ms"))) / (2 * F.count_if(hit)), F.lit(0.0)).alias("share"),
        F.coalesce(F.max(F.abs("start_ms")), F.lit(0)).alias("max_start_ms"), F.coalesce(F.max(F.abs("end_ms")), F.lit(0)).alias("max_end_ms"),
        F.floor(F.coalesce(F.median(F.abs("start_ms")), F.lit(0.0)) + 0.5).cast("long").alias("median_start_ms"),
    )
    made = produced.groupBy("recording_id").agg(F.count(F.lit(1)).alias("made"))
    both = by.join(made, "recording_id", "full_outer").na.fill(0)
    return both.select("recording_id", "matched", "split", "missing", (F.col("made") - F.col("claimed")).alias("spurious"), F.floor(F.col("share") * 1e6 + 0.5).cast("long").alias("within_ppm"), "max_start_ms", "max_end_ms", "median_start_ms")


def alone(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """segments that at most one speaker's turns overlap; a turn of no length overlaps the segment that it lies in."""
    pairs = overlap_join(segments.select("recording_id", "id", "start_s", "end_s"), turns.select("recording_id", "start_s", "end_s", "speaker"), by=["recording_id"])
    pairs = pairs.where((F.col("r_end_s") > F.col("start_s")) & (F.col("r_start_s") < F.col("end_s")))
    crowded = pairs.groupBy("recording_id", "id").agg(F.min("r_speaker").alias("x"), F.max("r_speaker").alias("y")).where("x <> y").select("recording_id", "id")
    return segments.join(crowded, ["recording_id", "id"], "left_anti")


def depth_on_grid(windows: DataFrame, step: float, fade: float) -> DataFrame:
    """(recording_id, tick, depth): how far the envelope is down at each grid time near a window: 1 inside, falling to 0 over the fade, the deepest window counts."""
    lo, hi = F.ceil((F.col("start_s") - fade) / step), F.floor((F.col("end_s") + fade) / step)
    ticks = windows.where(lo <= hi).withColumn("tick", F.explode(F.sequence(lo, hi)))
    t = F.col("tick") * step
    inside = F.least(F.lit(1.0), (t - (F.col("start_s") - fade)) / fade, ((F.col("end_s") + fade) - t) / fade)
    return ticks.groupBy("recording_id", "tick").agg(F.max(F.greatest(F.lit(0.0), inside)).alias("depth"))
