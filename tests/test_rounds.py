"""Loops in rounds against plain loops, and reference edges against a walk over frames."""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import functions as F

from cuegrid.operators import edges, rounds, sequence


def segments(spark, rows):
    return spark.createDataFrame(rows, "recording_id long, id long, start_s double, end_s double, text string, tts_duration double")


def test_shortening_ends_where_nothing_changes(spark):
    rows = [(1, 0, 0.0, 2.0, "a b c d e f", 6.0), (1, 1, 10.0, 12.0, "fits", 1.0), (2, 0, 0.0, 2.0, "fits", 2.0), (3, 0, 0.0, 1.0, "stubborn", 9.0), (4, 0, 0.0, 1.0, None, 9.0), (5, 0, 0.0, 1.0, "a " * 40, 60.0)]
    asked: list[list[tuple]] = []

    def shorten(df):
        asked.append(sorted((r.recording_id, r.id, r.target_chars) for r in df.collect()))
        cut = F.expr("substring(text, 1, length(text) - 2)")
        return df.where("length(text) > 2 and text <> 'stubborn'").select("recording_id", "id", cut.alias("text"), (F.col("tts_duration") / 2).alias("tts_duration"))

    out = {(r.recording_id, r.id): r for r in rounds.shortened_placement(segments(spark, rows), shorten, rounds=3, rate=15.0, borrow=0.0).collect()}
    assert len(out) == 6
    assert [[a[:2] for a in x] for x in asked] == [[(1, 0), (3, 0), (5, 0)], [(1, 0), (5, 0)], [(5, 0)]]
    assert all(t >= 4 for x in asked for _, _, t in x)
    assert (out[1, 0].shortened, out[1, 0].rounds, out[1, 0].text, out[1, 0].needs_shorten) == (2, 2, "a b c d"[:7], False)
    assert (out[1, 1].shortened, out[2, 0].rounds, out[3, 0].rounds, out[4, 0].rounds) == (0, 0, 0, 0)
    assert (out[5, 0].shortened, out[5, 0].rounds, out[5, 0].needs_shorten) == (3, 3, True)
    for key in ((2, 0), (3, 0)):
        plain = {(r.recording_id, r.id): r for r in sequence.plan_alignment(segments(spark, rows), borrow=0.0).collect()}
        assert out[key].aligned_start == plain[key].aligned_start and out[key].tempo == plain[key].tempo


def test_shortening_of_nothing(spark):
    never = lambda df: df.select("recording_id", "id", "text", "tts_duration")
    assert rounds.shortened_placement(segments(spark, []), never, rounds=2, rate=15.0).count() == 0


def test_a_round_asks_only_what_the_last_refused(spark):
    rows = [(1, i, float(i * 5), i * 5 + 3.0, 3.0, "word " * 8) for i in range(6)] + [(2, 0, 0.0, 3.0, 3.0, None)]
    df = spark.createDataFrame(rows, "recording_id long, id long, start_s double, end_s double, slot double, text string")
    told: list[list[int]] = []

    def reviewer(chunks):
        assert sorted({r.chunk for r in chunks.collect()}) == [0, 1]
        new = F.when(F.col("id") == 1, F.lit("fine words that do fit the slot here okay")).otherwise(F.concat(F.repeat(F.lit("long "), 40), F.col("chunk").cast("string")))
        answers = chunks.select("recording_id", "chunk", F.col("id").alias("ord"), "id", new.alias("new_text")).where("id in (1, 2, 3, 4)")
        return answers.unionByName(answers.withColumn("id", F.col("id") + 100))  # rows that nobody asked for

    def refitter(asked):
        told.append(sorted(r.id for r in asked.collect()))
        assert all(r.over == max(0, len(r.proposed) - r.most_chars) for r in asked.collect())
        new = F.when(F.col("id") == 2, F.lit("now it is of about the same length as that")).otherwise(F.col("proposed"))
        return asked.where("id <> 4").select("recording_id", "id", new.alias("new_text"))

    texts, journal = rounds.reviewed(df, reviewer, refitter, size=4, overlap=2, rounds=3, rate=15.0, overhead=0.0, tolerance=0.15, floor=0.25, most_share=0.9)
    entries = sorted((r.id, r.round, r.verdict) for r in journal.collect())
    assert told == [[2, 3, 4], [3], [3]]  # 2 is accepted, 4 got no answer
    assert entries == [(1, 0, "applied"), (2, 0, "worse_fit"), (2, 1, "applied"), (3, 0, "worse_fit"), (3, 1, "worse_fit"), (3, 2, "worse_fit"), (3, 3, "worse_fit"), (4, 0, "worse_fit")]
    got = {(r.recording_id, r.id): (r.text, r.changed) for r in texts.collect()}
    assert got[1, 1][1] and got[1, 2][0] == "now it is of about the same length as that" and got[1, 3] == ("word " * 8, False) and got[2, 0] == (None, False)
    first = {r.id: r.after for r in journal.where("round = 0").collect()}
    assert first[2].endswith("0") and first[3].endswith("0") and first[4].endswith("1")  # the first chunk that holds a row


def test_a_review_that_changes_too_much_is_dropped(spark):
    df = spark.createDataFrame([(1, i, float(i), i + 1.0, 1.0, "some words here") for i in range(30)], "recording_id long, id long, start_s double, end_s double, slot double, text string")
    reviewer = lambda c: c.select("recording_id", "chunk", F.col("id").alias("ord"), "id", F.lit("other words here").alias("new_text"))
    texts, journal = rounds.reviewed(df, reviewer, lambda a: a.select("recording_id", "id", F.lit("x").alias("new_text")), size=10, overlap=2, rounds=2, rate=15.0, overhead=0.0, tolerance=0.15, floor=0.25, most_share=0.5)
    assert {r.verdict for r in journal.collect()} == {"discarded"} and not any(r.changed for r in texts.collect())


def test_attempts_stop_at_the_mark(spark):
    rows = spark.createDataFrame([(1, i, f"k{i}", 2.0) for i in range(6)], "recording_id long, id long, key string, seconds double")
    old = spark.createDataFrame([(1, 0, "k0", 2.0, 0.5, "old"), (1, 1, "stale", 2.0, 0.9, "old"), (1, 2, "k2", 9.0, 0.9, "old")], "recording_id long, id long, key string, got_seconds double, score double, clip string")
    script = {(1, 1): 0.9, (2, 1): 0.2, (2, 2): 0.6, (2, 3): 0.4, (3, 1): None, (4, 1): 0.3, (4, 2): 0.8, (5, 1): -1, (5, 2): -1, (5, 3): -1}
    calls: list[tuple] = []

    def attempt(asked):
        out = []
        for r in asked.collect():
            calls.append((r.id, r.attempt))
            score = script[r.id, r.attempt]
            out.append((1, r.id, 9.0 if score == -1 else 2.1, None if score == -1 else score, f"c{r.id}.{r.attempt}"))
        return asked.sparkSession.createDataFrame(out, "recording_id long, id long, got_seconds double, score double, clip string")

    best, made = rounds.best_attempts(rows, old, attempt, attempts=3, mark=0.7)
    got = {r.id: (r.attempt, r.clip, r.sure) for r in best.collect()}
    assert sorted(calls) == sorted([(1, 1), (2, 1), (2, 2), (2, 3), (3, 1), (4, 1), (4, 2), (5, 1), (5, 2), (5, 3)])
    assert got == {0: (0, "old", False), 1: (1, "c1.1", True), 2: (2, "c2.2", False), 3: (1, "c3.1", True), 4: (2, "c4.2", True), 5: (None, None, False)}
    calls.clear()
    again, none = rounds.best_attempts(rows.where("id < 5"), old.unionByName(made.drop("attempt")), attempt, attempts=3, mark=0.7)
    assert not calls and none.count() == 0 and {r.id: r.clip for r in again.collect()} == {i: c for i, (_, c, _) in got.items() if i < 5}


def test_phrases_fill_what_the_slot_leaves(spark):
    clips = spark.createDataFrame([(1, 0, k, 100, [float(k + 1)] * 50) for k in range(3)] + [(1, 1, 0, 100, [1.0] * 100), (1, 1, 1, 100, [2.0] * 100)], "recording_id long, id long, part int, rate int, samples array<float>")
    plans = spark.createDataFrame([(1, 0, 2.0, [0.4, 0.6]), (1, 1, 2.0, [0.5])], "recording_id long, id long, slot double, pauses array<double>")
    (row,) = rounds.joined_phrases(clips, plans).collect()
    # 1.5 s of speech leave 0.5 s for 1 s of pauses: 20 and 30 samples; the second row has no time left
    assert (row.id, row.seconds) == (0, 2.0)
    assert row.samples == [1.0] * 50 + [0.0] * 20 + [2.0] * 50 + [0.0] * 30 + [3.0] * 50


def walked(levels, ws, s, e, previous, following):
    """A walk over the frames, one after another."""
    half = lambda x: math.floor(x + 0.5)
    at = lambda t: half((t - ws) / 0.02)
    inside = sorted(levels[max(0, at(s)) : max(0, at(e))])
    if not inside:
        return None
    border = inside[int(len(inside) * 0.9)] - 18
    hush = lambda i: not 0 <= i < len(levels) or levels[i] < border
    stops = [i for i in range(max(0, at(e - 0.15)), len(levels)) if all(hush(i + k) for k in range(8))]
    goes = [i for i in range(0, min(len(levels), at(s + 0.15)) + 1) if all(hush(i - 1 - k) for k in range(8))]
    if not stops or (following is not None and ws + stops[0] * 0.02 > following + 0.1):
        return None
    end, clean = ws + stops[0] * 0.02, bool(goes) and (previous is None or ws + goes[-1] * 0.02 >= previous - 0.1)
    if clean:
        start = ws + goes[-1] * 0.02
    else:
        low = max(0, at(max(s - 0.3, -1e9 if previous is None else previous - 0.05)))
        high = min(len(levels) - 1, at(s + 0.1))
        start = ws + min(range(low, high + 1), key=lambda i: (levels[i], i), default=min(low, high)) * 0.02
    return None if end - start < 1 else (math.floor(max(ws, start - 0.05) * 1000 + 0.5) / 1000, math.floor((end + 0.08) * 1000 + 0.5) / 1000, clean)


def test_edges_equal_a_walk(spark):
    rng = random.Random(11)
    lines, levels, want = [], [], {}
    for i in range(150):
        s = rng.choice([10.0, 10.25, 33.4])
        e = s + rng.uniform(0.1, 3)
        ws = s - rng.choice([0.0, 0.3, 0.6])
        own, loud = [], True
        while len(own) < int((e - ws + rng.choice([0.0, 0.5, 1.0])) / 0.02):
            own += [rng.uniform(-30, -20) if loud else rng.uniform(-70, -55) for _ in range(rng.randint(3, 60) if loud else rng.randint(2, 14))]
            loud = not loud
        previous = rng.choice([None, s - 0.05, s - 0.4, s + 0.2])
        following = rng.choice([None, e + 0.05, e + 0.6])
        lines.append((1 + i % 3, i, ws, s, e, previous, following))
        levels += [(1 + i % 3, i, k, v) for k, v in enumerate(own)]
        want[i] = walked(own, ws, s, e, previous, following)
    df = spark.createDataFrame(lines, "recording_id long, id long, window_start double, start_s double, end_s double, previous_end double, next_start double")
    out = edges.reference_edges(spark.createDataFrame(levels, "recording_id long, id long, frame_id long, level double"), df).collect()
    got = {r.id: None if r.cut_start is None else (r.cut_start, r.cut_end, r.clean) for r in out}
    assert got == want and sum(x is not None for x in want.values()) > 30 and {x[2] for x in want.values() if x} == {True, False}
    assert np.mean([x is None for x in want.values()]) > 0.1
    none = edges.reference_edges(spark.createDataFrame([], "recording_id long, id long, frame_id long, level double"), df.limit(2)).collect()
    assert len(none) == 2 and all(r.cut_start is None for r in none)


def test_batches_carry_glossary_and_context(spark):
    """A scripted model: lines left out are asked again, the last attempt counts as far as it goes, terms stay as they were first told."""
    import json

    from cuegrid import plugins

    class Script:
        def __init__(self):
            self.asked = {}

        def complete(self, system, user):
            told, lines = json.loads(system), [json.loads(x) for x in user.split("\n")]
            n = self.asked[user] = self.asked.get(user, 0) + 1
            if any(x["text"] == "broken" for x in lines) and n < 3:
                return "no json" if n == 1 else '{"items": 5}'
            good = [x for x in lines if not (x["text"] == "late" and n < 2) and x["text"] != "never"]
            return json.dumps({"items": [{"id": x["id"], "text": f"{sorted(told['glossary'].items())}|{len(told['context'])}|{x['text']}"} for x in good], "glossary": {"term": lines[0]["text"]}})

    plugins.REGISTRY["script"] = Script
    rows = [(1, 0, 0, "one"), (1, 1, 0, "late"), (1, 2, 1, "never"), (1, 3, 1, "three"), (1, 4, 2, None), (1, 5, 3, "broken"), (2, 0, 0, "other")]
    df = spark.createDataFrame(rows, "recording_id long, id long, batch long, text string")
    out = {(r.recording_id, r.id): (r.text_tgt, r.attempts) for r in plugins.translated_batches(df.repartition(3), "script").collect()}
    term = "[('term', 'one')]"
    assert out == {(1, 0): ("[]|0|one", 2), (1, 1): ("[]|0|late", 2), (1, 2): (None, 3), (1, 3): (f"{term}|2|three", 3), (1, 4): (None, 0), (1, 5): (f"{term}|3|broken", 3), (2, 0): ("[]|0|other", 1)}
    assert plugins.translated_batches(df.limit(0), "script").count() == 0
