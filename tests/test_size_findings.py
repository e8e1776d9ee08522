"""Cases that came up on larger tables."""

from __future__ import annotations

import random
import re
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F

from cuegrid.functions import text
from cuegrid.operators import cues, intervals, segments
from cuegrid.plans import records

SPAN = "recording_id long, id long, start_s double, end_s double, speaker string"


def test_a_turn_of_no_length_is_heard_where_it_lies(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 4.0, "a"), (1, 2, 5.0, 9.0, "a"), (1, 3, 10.0, 14.0, "a")], SPAN)
    turns = spark.createDataFrame([(1, 1, 1.0, 3.0, "x"), (1, 2, 2.0, 2.0, "y"), (1, 3, 5.0, 9.0, "x"), (1, 4, 9.0, 9.0, "y"), (1, 5, 12.0, 12.0, "y")], SPAN)
    assert sorted(r.id for r in intervals.alone(rows, turns).collect()) == [2, 3]


def test_costs_are_rounded_as_all_numbers_are(spark, duck):
    prices = spark.createDataFrame([(x,) for x in (3500.0, 6500.0, 7500.0, 56500.0, 103500.0, 198500.0, 1e6, 1005000.0)], "p double")
    got = {r.p: r.c for r in prices.select("p", text.cost_text(F.col("p") / 1e8).alias("c")).collect()}
    sql = "SELECT CASE WHEN {0} / 1e8 < 0.01 THEN '$' || format('{{:.5f}}', floor({0} / 1e8 * 1e5 + 0.5) / 1e5) ELSE '$' || format('{{:.4f}}', floor({0} / 1e8 * 1e4 + 0.5) / 1e4) END"
    assert got == {p: duck.execute(sql.format(f"{p!r}::DOUBLE")).fetchone()[0] for p in got}


def test_long_lists_are_python_objects_a_few_rows_at_a_time():
    batch = pa.RecordBatch.from_pylist([{"id": k, "words": None if k == 3 else [k] * n} for k, n in enumerate((5, 10, 40, 0, 3, 3, 3))], pa.schema([("id", pa.int64()), ("words", pa.list_(pa.int64()))]))
    held, segments.HELD = segments.HELD, 12
    try:
        some = [[r["id"] for r in rows] for rows in segments.slices(batch, "words")]
    finally:
        segments.HELD = held
    assert some == [[0], [1], [2], [3, 4, 5], [6]]


def test_words_find_speakers_as_their_joins_did(spark):
    rng = random.Random(4)
    turns = [(1, k, s := rng.randrange(0, 60) / 2, s + rng.choice((0, 1, 4, 25)) / 2, rng.choice("xyz")) for k in range(20)]
    words = [(1, k, s := rng.randrange(-4, 80) / 2, s + rng.choice((0, 0.5, 1, 3)), "") for k in range(60)]
    rows = spark.createDataFrame(words, SPAN)
    told = spark.createDataFrame(turns, SPAN)
    want = {r.id: r.speaker_name for r in intervals.speaker_of(rows.drop("speaker"), told, fallback="", within=0.0).collect()}
    names = {r.speaker: r["name"] for r in intervals.speaker_names(told).collect()}
    own = sorted(({"start": s, "id": k, "end": e, "speaker": w, "name": names[w]} for _, k, s, e, w in turns), key=lambda t: (t["start"], t["id"]))
    starts, reached = [t["start"] for t in own], list(accumulate((t["end"] for t in own), max))
    assert want == {k: segments._heard({"start": s, "end": e}, own, starts, reached) or "" for _, k, s, e, _ in words}


def test_words_are_numbered_without_a_shuffle_of_words(spark, tmp_path):
    import duckdb

    rows = [(1, 2, "u", "e f"), (1, 1, "u", "a b c"), (1, 1, "u", "a b c"), (1, 1, "u", " \n"), (1, None, "u", "z"), (2, 1, "u", None), (2, 5, "u", "q")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").where("turn is not null").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"WITH {records.WORDS} SELECT recording_id, id, word FROM words").fetchall()
    assert sorted(tuple(r) for r in records.spoken(spark, str(tmp_path)).select("recording_id", "id", "word").collect()) == sorted(want)


def test_break_points_of_a_very_long_line(spark):
    cases = ["", " ", ".", ". ", "a, b", "😀, b. c", "—  —", "a,b", ("word, " * 40_000)]
    got = {r.t: r.p for r in spark.createDataFrame([(c,) for c in cases], "t string").select("t", cues.break_points(F.col("t")).alias("p")).collect()}
    assert got == {c: [m.end() for m in re.finditer("[.,!?;:…—](?= )", c)] for c in cases}
    assert spark.createDataFrame([(None,)], "t string").select(cues.break_points(F.col("t")).alias("p")).first().p is None
