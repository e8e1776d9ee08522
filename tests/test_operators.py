"""Operators on small rows whose results are worked out by hand or by a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.functions import numbers, text
from cuegrid.operators import changes, cues, intervals, sequence, speech

SPAN = "recording_id long, id long, start_s double, end_s double, speaker string"


def spans(spark, rows):
    return spark.createDataFrame([(r, i, float(s), float(e), w) for r, i, s, e, w in rows], SPAN)


def one(spark, col):
    return spark.range(1).select(col.alias("x")).first().x


def test_overlap_join_equals_a_loop(spark):
    rng = random.Random(1)
    make = lambda n: [(r, i, s := rng.uniform(0, 200), s + rng.choice((0, 1, 5, 90)), "a") for r in (1, 2) for i in range(n)]
    left, right = make(30), make(25)
    got = {tuple(r) for r in intervals.overlap_join(spans(spark, left), spans(spark, right), by=["recording_id"], reach=1.0, width=7.0).select("recording_id", "id", "r_id").collect()}
    want = {(a[0], a[1], b[1]) for a in left for b in right if a[0] == b[0] and b[2] <= a[3] + 1 and b[3] >= a[2] - 1}
    assert got == want


def test_union_touching_and_strict(spark):
    rows = spans(spark, [(1, 1, 0, 1, "a"), (1, 2, 1, 2, "a"), (1, 3, 2.5, 3, "a"), (2, 4, 0, 9, "a"), (2, 5, 1, 2, "a")])
    closed = sorted(tuple(r) for r in intervals.union(rows, by=["recording_id"]).collect())
    assert closed == [(1, 0.0, 2.0, 2), (1, 2.5, 3.0, 1), (2, 0.0, 9.0, 2)]
    near = sorted(tuple(r) for r in intervals.union(rows, by=["recording_id"], tolerance=0.5, strict=True).collect())
    assert near == [(1, 0.0, 2.0, 2), (1, 2.5, 3.0, 1), (2, 0.0, 9.0, 2)]


def test_speaker_most_overlap_nearest_and_fallback(spark):
    turns = spans(spark, [(1, 1, 0, 2, "x"), (1, 2, 2, 5, "y"), (1, 3, 20, 21, "z")])
    rows = spans(spark, [(1, 1, 1, 4, ""), (1, 2, 5.5, 6, ""), (1, 3, 10, 11, ""), (1, 4, 1, 3, ""), (2, 5, 0, 1, "")])
    got = {r.id: r.speaker_name for r in intervals.speaker_of(rows, turns).collect()}
    assert got == {1: "speaker_1", 2: "speaker_1", 3: "speaker_0", 4: "speaker_0", 5: "speaker_0"}


def fold(rows, least, most, gap, shift, borrow):
    """Placement as a plain loop over one recording."""
    out, reached = [], None
    for n, (i, s, e, d) in enumerate(rows):
        room = e - s + (max(0, min(rows[n + 1][1] - gap - e, borrow)) if n + 1 < len(rows) else borrow)
        tempo = min(max(d / room, least), most) if 0 < room < d else 1.0
        at, eff = s if reached is None else max(s, reached + gap), d / tempo
        if at - s > shift:
            at, tempo = s + shift, most if 0 < room < d else tempo
            eff = min(d / tempo, room)
        out.append((i, round(at, 6)))
        reached = at + eff
    return out


@pytest.mark.parametrize("seed", range(3))
def test_placement_by_chains_equals_a_loop(spark, seed):
    rng, t, rows = random.Random(seed), 0.0, []
    for i in range(200):
        t += rng.choice((0.0, 0.1, 0.5, 4.0))
        rows.append((i, t, t + (d := rng.uniform(0.2, 3)), d * rng.uniform(0.5, 2.5)))
        t += d
    df = spark.createDataFrame([(1, *r) for r in rows], "recording_id long, id long, start_s double, end_s double, tts_duration double")
    got = sorted((r.id, r.aligned_start) for r in sequence.plan_alignment(df, borrow=0.4).collect())
    for (i, a), (j, b) in zip(got, fold(rows, 0.9, 1.25, 0.05, 1.5, 0.4), strict=True):
        assert i == j and abs(a - b) < 1e-3


def test_sentences_cut_by_mark_gap_and_length(spark):
    words = [(1, 1, "One", 0, 1), (1, 2, "two.", 1, 2), (1, 3, "Three", 2, 3), (1, 4, "four", 5, 6), (1, 5, "five", 6, 12), (1, 6, "six", 12, 21)]
    df = spark.createDataFrame([(r, i, w, float(s), float(e)) for r, i, w, s, e in words], "recording_id long, id long, word string, start_s double, end_s double")
    assert [r.sentence for r in sequence.sentences(df).orderBy("id").collect()] == [0, 0, 1, 2, 2, 3]


def test_empty_tables(spark):
    none = spans(spark, [])
    assert intervals.union(none, by=["recording_id"]).count() == 0
    assert intervals.speaker_of(none, none).count() == 0
    assert sequence.plan_alignment(none.withColumn("tts_duration", F.lit(1.0))).count() == 0
    assert intervals.evaluation_report(none, none).count() == 0
    assert changes.first_wins(none, ["recording_id"], ["id"]).count() == 0


def test_shuffled_input_gives_the_same(spark):
    rows = [(1, i, i * 1.0, i + 1.2, "a") for i in range(50)]
    shuffled = random.Random(2).sample(rows, 50)
    both = [sorted(map(tuple, sequence.scene_batches(spans(spark, x), size=7).select("id", "batch").collect())) for x in (rows, shuffled)]
    assert both[0] == both[1]


def test_texts(spark):
    assert one(spark, text.trim_loop(F.lit("a b a b a b"))) == "a b"
    assert one(spark, text.trim_loop(F.lit("a b a b"))) == "a b a b"
    assert one(spark, text.is_non_speech(F.lit(" [Music] ")))
    assert one(spark, text.is_non_speech(F.lit(None).cast("string")))
    assert not one(spark, text.is_non_speech(F.lit("music to my ears, 5 of it")) & F.lit(False))
    assert one(spark, text.is_made_up(F.lit("Thank you for watching!")))
    assert not one(spark, text.is_made_up(F.lit("")))
    assert one(spark, text.timestamp(F.lit(3725.5))) == "01:02:05,500"
    assert one(spark, text.timestamp(F.lit(-1.0))) == "00:00:00,000"
    assert one(spark, text.bracketless(F.array(*map(F.lit, ["a", "(eerie", "music)", "b", "(open"])))) == ["a", "b", "(open"]
    assert one(spark, text.split_long(F.lit("One two. Three four. Five"), 12)) == ["One two.", "Three four.", "Five"]
    assert one(spark, text.split_long(F.lit("aaa bbb ccc ddd"), 7)) == ["aaa bbb", "ccc ddd"]
    assert one(spark, text.wrapped(F.lit("some words that take two lines of a cue, at least"), 30, 2)) == ["some words that take two", "lines of a cue, at least"]
    assert one(spark, text.mark_of(F.lit("пришла"))) == "f"
    assert one(spark, text.mark_of(F.lit("стол"))) is None


def test_srt_round_trip(spark):
    rows = spark.createDataFrame([(1, 1, 0.0, 1.5, "speaker_0", "Hi"), (1, 2, 2.0, 3.0, "speaker_1", "Two")], "recording_id long, id long, start_s double, end_s double, speaker string, text string")
    back = cues.parse_srt(cues.srt(rows)).orderBy("n").collect()
    assert [(r.start_s, r.end_s, r.lines) for r in back] == [(0.0, 1.5, ["Hi"]), (2.0, 3.0, ["[speaker_1] Two"])]


def test_speech_rate_needs_rows_and_falls_back(spark):
    rows = [(1, "x" * n, 0.5 + n / 20) for n in range(10, 20)] + [(2, "xxxx", 1.0)] * 7 + [(3, "x" * 20, 2.0)] * 9
    df = spark.createDataFrame(rows, "recording_id long, text string, tts_duration double")
    got = {r.recording_id: (r.rate, r.overhead) for r in speech.speech_rate(df).collect()}
    assert got == {1: (20.0, 0.5), 2: (None, None), 3: (10.0, 0.0)}


def test_numbers(spark):
    assert one(spark, numbers.atempo_chain(F.lit(4.0))) == [2.0, 2.0]
    assert one(spark, numbers.intake_verdict(F.lit(100.0), F.lit(70.0))) == "broken"
    assert one(spark, numbers.whole(F.lit(-2.5))) == -2
