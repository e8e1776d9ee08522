"""Words of a row: pauses, phrases, edges, and where to put silence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.numbers import places
from cuegrid.operators.sequence import islands


def pauses(words: DataFrame, *, least: float = 0.3) -> DataFrame:
    """(recording_id, id, start_s, end_s) of the gaps of at least so many seconds after a word."""
    after = F.lead("start_s").over(Window.partitionBy("recording_id").orderBy("id"))
    return words.withColumn("_n", after).where(F.col("_n") - F.col("end_s") >= least).select("recording_id", "id", F.col("end_s").alias("start_s"), F.col("_n").alias("end_s"))


def phrases(words: DataFrame, *, least: float = 0.3, by: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """(by, phrase, start_s, end_s, pause_after): runs of words between pauses; what has no pause has none. ``by`` names whose words go together: a recording's, or a segment's."""
    w = Window.partitionBy(*by).orderBy("id")
    runs = islands(words, w, F.col("start_s") - F.lag("end_s").over(w) >= least, "phrase")
    own = runs.groupBy(*by, "phrase").agg(F.min("start_s").alias("start_s"), F.max_by("end_s", "id").alias("end_s"))
    order = Window.partitionBy(*by).orderBy("phrase")
    pause = F.coalesce(places(F.lead("start_s").over(order) - F.col("end_s"), 3), F.lit(0.0))
    return own.withColumn("pause_after", pause).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*by))).where(F.col("_n") > 1).drop("_n")


def refined(rows: DataFrame, *, window: float) -> DataFrame:
    """rows (start_s, end_s, words) with edges at their first and last word where these are within the window."""
    sound = F.filter("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull() & ~F.isnan(w["start"]) & ~F.isnan(w["end"]))
    first, last = F.get(sound, 0)["start"], F.try_element_at(sound, F.lit(-1))["end"]
    start = F.when(F.abs(first - F.col("start_s")) <= window, first).otherwise(F.col("start_s"))
    end = F.when(F.abs(last - F.col("end_s")) <= window, last).otherwise(F.col("end_s"))
    fits = end > start
    return rows.withColumn("refined_start", F.when(fits, start).otherwise(F.col("start_s"))).withColumn("refined_end", F.when(fits, end).otherwise(F.col("end_s")))


def spread(pauses_: DataFrame, slack: Column, *, most: float = 0.4, least: float = 0.08, top: int = 2) -> DataFrame:
    """(recording_id, at, seconds): silence put into a clip's longest pauses: equal shares of the slack, none too short, until nothing is left."""
    longest = Window.partitionBy("recording_id").orderBy(F.desc(F.col("end_s") - F.col("start_s")), "start_s")
    chosen = pauses_.withColumn("_slack", slack).withColumn("_n", F.row_number().over(longest)).where((F.col("_n") <= top) & (F.col("_slack") > least))
    grouped = chosen.groupBy("recording_id", "_slack").agg(F.array_sort(F.collect_list(F.struct("start_s", "end_s"))).alias("xs"))
    start = F.struct(F.col("_slack").alias("left"), F.expr("CAST(array() AS array<struct<at:double,seconds:double>>)").alias("out"))

    def step(s: Column, x: Column) -> Column:
        share = F.least(F.lit(most), F.col("_slack") / F.size("xs"), s["left"])
        item = F.array(F.struct(places((x["start_s"] + x["end_s"]) / 2, 3).alias("at"), places(share, 3).alias("seconds")))
        take = (s["left"] > least) & (share >= least)
        return F.struct(F.when(take, s["left"] - share).otherwise(s["left"]).alias("left"), F.when(take, F.concat(s["out"], item)).otherwise(s["out"]).alias("out"))

    return grouped.select("recording_id", F.explode(F.aggregate("xs", start, step, lambda s: s["out"])).alias("p")).select("recording_id", "p.*")
