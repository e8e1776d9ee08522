"""Cases of the third round's findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import edges


def shuffles(df) -> int:
    """Exchanges of a query's plan."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def test_frames_of_a_line_stay_in_its_row(spark):
    lines = spark.range(40).select(F.lit(1).cast("long").alias("recording_id"), "id", F.lit(0.0).alias("window_start"), F.lit(0.5).alias("start_s"), F.lit(2.5).alias("end_s"), F.lit(0.2).alias("previous_end"), F.lit(None).cast("double").alias("next_start"))
    level = lambda i: F.when((i < 15) | (i > 126) & (F.col("id") != 7), -60.0).when((i == 50) & (F.col("id") == 9), None).otherwise(-20.0)
    frames = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(149).cast("long")), lambda i: F.struct(i.alias("frame_id"), level(i).alias("level")))
    whole = lines.withColumn("frames", F.when(F.col("id") != 5, frames))
    one = edges.window_edges(whole)
    assert shuffles(one) == 0
    got = sorted(one.collect())
    assert got[0].cut_start == 0.25 and got[0].cut_end == 2.62 and got[0].clean
    assert [r.id for r in got if r.cut_end is None] == [5, 7]
    rows = whole.select("recording_id", "id", F.explode("frames").alias("f")).select("recording_id", "id", "f.*")
    assert sorted(edges.reference_edges(rows, lines).collect()) == got


def test_lines_agree_in_two_passes_of_python(spark):
    from cuegrid.operators import gender

    rows = spark.createDataFrame([(1, 0, 0.0, 1.0, "A", "Я пришёл", ["Я пришёл"]), (1, 1, 2.0, 3.0, "B", "Ты пришёл", None), (1, 2, 4.0, 5.0, "B", None, None)], "recording_id long, id long, start_s double, end_s double, speaker string, text string, phrases array<string>")
    log = gender.agreed_with_voices(rows, spark.createDataFrame([(1, "A", "f")], "recording_id long, speaker string, gender string"), {})
    assert log._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 2
    assert [(r.id, r.after, r.phrases) for r in sorted(log.collect())] == [(0, "Я пришла", ["Я пришла"]), (1, "Ты пришла", None)]
