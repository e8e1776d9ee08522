"""Agreement, clip checks, voices and built segments on small inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.functions import agreement as ag
from cuegrid.operators import segments, voices


def test_words_flip_with_case_and_endings():
    assert ag.flip("сказал", "f") == "сказала"
    assert ag.flip("Пришла", "m") == "Пришел" or ag.flip("Пришла", "m") == "Пришёл"
    assert ag.flip("старалась", "m") == "старался"
    assert ag.flip("рад", "f") == "рада"
    assert ag.flip("стол", "f") is None and ag.flip("сказал", "m") is None


def test_predicates_of_a_pronoun_agree():
    assert ag.agreed("Я сказал и ушёл. Он пришёл.", "я", "f") == "Я сказала и ушла. Он пришёл."
    assert ag.agreed("Ты мог, а он сказал.", "ты", "f") == "Ты могла, а он сказал."
    assert ag.agreed("", "я", "f") == ""


def test_agreement_in_spark(spark):
    df = spark.createDataFrame([(1, "Я рад", "f"), (2, "Я рад", "unknown"), (3, None, "m")], "id long, text string, gender string")
    assert [r.x for r in df.select("id", ag.agree(F.col("text"), "я", F.col("gender")).alias("x")).orderBy("id").collect()] == ["Я рада", "Я рад", None]


def test_clips(spark):
    assert ag.judged("Привет мой старый друг", "привет мой старый друг") == (True, 1.0, 1.0, [])
    assert ag.judged("Привет мой старый друг", "")[3] == ["garbled"]
    assert "lost-end" in ag.judged("Привет мой старый добрый друг", "привет мой старый")[3]
    assert ag.aligned(["натарсоа", "идет"], ["на", "тарса", "идет"]) == [(0, 0), (1, 2)]
    row = spark.createDataFrame([("да", None)], "a string, b string").select(ag.clip_verdict(F.col("a"), F.col("b")).alias("v")).first().v
    assert row.ok


def test_translation_is_cut_at_pauses():
    assert ag.split_by_pauses("Первая часть, вторая часть. Третья", [0.3, 0.8]) == ["Первая часть,", "вторая часть.", "Третья"]
    assert ag.split_by_pauses("Без знаков совсем", [0.5]) is None


def test_voices_taken_once(spark):
    rows = spark.createDataFrame([(1, "speaker_0", "m", 100.0), (1, "speaker_1", "m", 101.0), (1, "speaker_2", "f", None), (1, "speaker_10", "m", 99.0)], "recording_id long, speaker string, gender string, f0 double")
    got = {r.speaker: r.voice for r in voices.assigned(rows, [("a", "m", 100.0, False), ("b", "m", 150.0, False), ("c", "f", 200.0, False)]).collect()}
    assert got == {"speaker_0": "a", "speaker_1": "b", "speaker_2": "c", "speaker_10": "a"}


def test_long_rows_are_cut_at_pauses(spark):
    words = [{"word": f"w{i}", "start": i * 1.0 + (0.5 if i >= 6 else 0), "end": i * 1.0 + (0.5 if i >= 6 else 0) + 0.95} for i in range(10)]
    df = spark.createDataFrame([(1, 1, "a", words), (1, 2, "a", [])], f"recording_id long, id long, speaker string, words {segments.WORDS}")
    got = [(r.id, r.piece, r.start_s, r.end_s, r.forced) for r in segments.split_long(df, most=8.0).orderBy("id", "piece").collect()]
    assert got == [(1, 0, 0.0, 5.95, False), (1, 1, 6.5, 10.45, False), (2, 0, None, None, False)]
    df = spark.createDataFrame([(1, 3, "a", None, 0.0, 40.0, "a b c"), (1, 4, "a", words[:1], 0.0, 50.0, "w0"), (1, 5, None, None, None, None, None)], f"recording_id long, id long, speaker string, words {segments.WORDS}, start_s double, end_s double, text string")
    got = [(r.id, r.piece, r.start_s, r.end_s, r.text, r.forced) for r in segments.split_long(df).orderBy("id", "piece").collect()]
    assert got == [(3, 0, 0.0, 20.0, "a", True), (3, 1, 20.0, 40.0, "b c", True), (4, 0, 0.0, 50.0, "w0", False), (5, 0, None, None, None, False)]


def test_rows_are_cut_where_the_speaker_changes(spark):
    words = [{"word": f"w{i}", "start": float(i), "end": i + 0.9} for i in range(8)]
    rows = spark.createDataFrame([(1, 1, 0.0, 7.9, words), (1, 2, 0.0, 2.0, words[:2])], f"recording_id long, id long, start_s double, end_s double, words {segments.WORDS}")
    turns = spark.createDataFrame([(1, 1, 0.0, 4.0, "x"), (1, 2, 4.0, 8.0, "y")], "recording_id long, id long, start_s double, end_s double, speaker string")
    got = sorted((r.id, r.piece, r.speaker_name, r.start_s, r.end_s) for r in segments.split_by_speaker(rows, turns).collect())
    assert got == [(1, 0, "speaker_0", 0.0, 3.9), (1, 1, "speaker_1", 4.0, 7.9), (2, 0, "speaker_0", 0.0, 2.0)]


def test_segments_are_cleaned_and_numbered(spark):
    rows = [(1, 1, 5.0, 6.0, "[music]"), (1, 2, 3.0, 4.5, "hello"), (1, 3, 4.0, 5.0, "hello"), (1, 4, 0.0, 1.0, "first"), (1, 5, 9.0, 8.0, "odd"), (1, 6, 7.0, 7.3, "short"), (1, 7, 10.0, float("inf"), "endless"), (1, 8, float("nan"), 11.0, "nowhere")]
    got = [(r.id, r.text, r.overlap) for r in segments.build(spark.createDataFrame(rows, "recording_id long, id long, start_s double, end_s double, text string")).orderBy("id").collect()]
    assert got == [(0, "first", False), (1, "hello", False)]
