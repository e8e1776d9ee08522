"""Lines made to agree with voices against a walk over words, requests keyed by their rows, long folds, nearest voices."""

from __future__ import annotations

import json
import random
import re
import time

from pyspark.sql import functions as F

from cuegrid.functions import agreement as ag
from cuegrid.operators import gender, replies, sequence, voices, words


def walk(text: str, pronoun: str, to: str) -> tuple[str, list[tuple[str, str]]]:
    """Word by word: the first telling word of three after the pronoun, what stands with it or is joined to it, and stressing words to the sentence's end."""
    parts, fixes = re.split("([а-яёА-ЯЁ]+)", text), []
    low = lambda i: parts[i].lower()

    def after(i):
        return None if i is None or i + 2 >= len(parts) or re.search("[.!?;…]", parts[i + 1]) else i + 2

    def flip(i):
        if new := ag.flip(parts[i], to):
            fixes.append((parts[i], new))
            parts[i] = new

    def telling(i, steps):
        for _ in range(steps):
            i = after(i)
            if i is None or low(i) in ag.SUBJECTS:
                return None
            if ag.mark(parts[i]):
                return i
        return None

    for p in range(1, len(parts), 2):
        if low(p) != pronoun:
            continue
        last, hit = p, telling(p, 3)
        while hit:
            flip(hit)
            last, following = hit, after(hit)
            if following and low(following) in ag._SHORT:
                flip(following)
                following = after(following)
            hit = telling(following, 2) if following and low(following) in ag.JOINERS else None
        i = after(last)
        while i and low(i) not in ag.PERSONS:
            if low(i) in ag.STRESS:
                flip(i)
            i = after(i)
    return "".join(parts), fixes


VOCAB = ["я", "ты", "он", "сказал", "сказала", "пришёл", "рад", "рада", "и", "но", "сам", "сама", "дом", "не", "был", "была", "Я", "Ты", "мог", "старалась", "это"]


def lines(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(VOCAB) + rng.choice([" ", " ", " ", ", ", ". ", "! ", "; "]) for _ in range(rng.randint(1, 14))).strip() for _ in range(n)]


def test_fixes_equal_a_walk():
    for k, text in enumerate(lines(1500, 1)):
        for pronoun in ("я", "ты"):
            for to in ("m", "f"):
                got, fixes = ag.agreed_with_fixes(text, pronoun, to)
                want, other = walk(text, pronoun, to)
                assert got == want, (k, text, pronoun, to)
                assert sorted(fixes) == sorted(other)


def test_lines_agree_with_their_voices(spark):
    texts = lines(300, 2)
    who = ["A", "B", "C"]
    rows = [(i % 7, i, float(i), i + 0.9, who[(i // 7) % 2], t, re.split("(?<=[,.!;]) ", t) if i % 3 else None) for i, t in enumerate(texts)] + [(1, 900, 0.0, 1.0, "A", None, None), (1, 901, 0.0, 1.0, "C", "", [])]
    df = spark.createDataFrame(rows, "recording_id long, id long, start_s double, end_s double, speaker string, text string, phrases array<string>")
    kinds = {(r, s): {"A": "f", "B": "m"}.get(s, "unknown") if r != 3 else "unknown" for r in range(7) for s in who}
    genders = spark.createDataFrame([(r, s, g) for (r, s), g in kinds.items()], "recording_id long, speaker string, gender string")
    to = {(r.recording_id, r.id): r.addressee for r in gender.addressees(df, {"A": "Анна"}).collect()}
    want = {}
    for rec, i, _, _, speaker, text, phrases in rows:
        if not text:
            continue
        now, fixes = text, []
        if kinds[rec, speaker] in "mf":
            now, fixes = walk(now, "я", kinds[rec, speaker])
        told = any(w.lower() == "ты" and any(ag.mark(x) for x in re.findall("[а-яёА-ЯЁ]+", now)[k + 1 : k + 4]) for k, w in enumerate(re.findall("[а-яёА-ЯЁ]+", now)))
        their = kinds.get((rec, to[rec, i]), "unknown")
        if told and their in "mf":
            now, more = walk(now, "ты", their)
            fixes = fixes + more
        if fixes:
            want[rec, i] = (text, now, sorted(fixes))
    log = gender.agreed_with_voices(df, genders, {"A": "Анна"})
    found = {(r.recording_id, r.id): r for r in log.collect()}
    assert {k: (r.before, r.after, sorted((f.old, f.new) for f in r.fixes)) for k, r in found.items()} == want and len(want) > 30
    own = {(r[0], r[1]): r[6] for r in rows}
    for k, r in found.items():
        assert r.phrases == (None if own[k] is None else [ag.replayed(p, [(f.old, f.new) for f in r.fixes]) for p in own[k]])
    after = {(r.recording_id, r.id): r for r in gender.with_agreement(df, log).collect()}
    assert len(after) == len(rows) and all(after[k].text == v[1] and after[k].agreed for k, v in want.items())
    assert {r.recording_id: (r.changed, r.ids) for r in gender.agreement_warnings(log).collect()} == {rec: (n, ids) for rec in {k[0] for k in want} for ids in [sorted(k[1] for k in want if k[0] == rec)] for n in [len(ids)]}


def test_fixes_are_replayed_on_phrases():
    assert ag.replayed("сказал, что сказал", [("сказал", "сказала")]) == "сказала, что сказал"
    assert ag.replayed("досказал", [("сказал", "сказала")]) == "досказал"


def test_phrases_of_each_segment(spark):
    """Two segments of one recording ask for their own phrases."""
    spoken = [(1, 0, 0, 0.0, 0.4), (1, 0, 1, 1.0, 1.5), (1, 1, 0, 5.0, 5.2), (1, 1, 1, 5.3, 6.0), (1, 1, 2, 7.0, 7.25), (1, 2, 0, 9.0, 9.5)]
    own = words.phrases(spark.createDataFrame(spoken, "recording_id long, segment long, id long, start_s double, end_s double"), by=("recording_id", "segment"))
    rows = spark.createDataFrame([(1, 0, " one "), (1, 1, "two"), (1, 2, "three"), (2, 0, "four"), (1, 3, None)], "recording_id long, id long, text string")
    got = {r.id: (r.text, r.phrases, r.pauses) for r in replies.phrase_requests(rows, own.withColumnRenamed("segment", "id")).collect()}
    assert got == {0: ("one", [0.4, 0.5], [0.6]), 1: ("two", [1.0, 0.25], [1.0])}


def test_requests_hold_what_a_line_may_be(spark):
    rows = spark.createDataFrame([(1, 0, 0.0, 2.0, "A", 2.0, 'say "hi"\nto me'), (1, 1, 2.1, 4.0, "B", 1.9, None), (1, 2, 30.0, 31.0, "A", 1.0, "über")], "recording_id long, id long, start_s double, end_s double, speaker string, room double, text string")
    told = spark.createDataFrame([(1, "A", "f"), (1, "B", "unknown")], "recording_id long, speaker string, gender string")
    out = [r.request.split("\n") for r in replies.batch_requests(rows, told, size=5, rate=15.0, cap=1.5, fill=False).orderBy("batch").collect()]
    assert [json.loads(x) for x in out[0][1:]] == [{"id": 0, "slot_seconds": 2, "max_chars": 23, "speaker": "female", "text": 'say "hi"\nto me'}, {"id": 1, "slot_seconds": 1.9, "max_chars": 8, "text": ""}] or json.loads(out[0][1])["max_chars"] == min(30, round(len('say "hi"\nto me') * 1.5 + 1e-9))
    assert json.loads(out[1][1]) == {"id": 2, "slot_seconds": 1, "max_chars": 8, "speaker": "female", "text": "über"}
    assert len(out) == 2 and '"slot_seconds":2,' in out[0][1]


def test_a_long_chain_costs_no_square(spark):
    """One chain of 60,000 rows, whose results are carried block by block; all of them at each step took a minute."""
    n = 60_000
    df = spark.range(n).select(F.lit(1).cast("long").alias("recording_id"), "id", (F.col("id") * 1.0).alias("start_s"), (F.col("id") + 0.9).alias("end_s"), F.lit(1.6).alias("tts_duration"))
    began = time.time()
    out = sequence.plan_alignment(df, borrow=0.0)
    assert out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("d")).first() == (n, n)
    assert time.time() - began < 30


def test_nearest_voice_equals_all_pairs(spark):
    rng = random.Random(3)
    cast = [(f"v{i:02d}", float(rng.randint(80, 300)), rng.choice([True, False, None])) for i in range(40)] + [("none", None, False)]
    people = [(1, f"s{i}", rng.choice([None, float(rng.randint(60, 330)), rng.uniform(60, 330)])) for i in range(200)]
    got = {r.speaker: r.voice for r in voices.nearest_voice(spark.createDataFrame(people, "recording_id long, speaker string, f0 double"), spark.createDataFrame(cast, "name string, f0 double, accent boolean")).collect()}
    want = {}
    for _, s, f0 in people:
        if f0 is not None:
            best = min((abs(v - f0), n) for n, v, _ in cast if v is not None)
            plain = min((abs(v - f0), n) for n, v, x in cast if v is not None and x is False)
            want[s] = plain[1] if plain[0] <= best[0] + 25 else best[1]
    assert got == want
    assert voices.nearest_voice(spark.createDataFrame(people, "recording_id long, speaker string, f0 double"), spark.createDataFrame([], "name string, f0 double, accent boolean")).count() == 0
