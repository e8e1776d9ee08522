"""Built segments against a plain loop over rows, and speakers that split them."""

from __future__ import annotations

import math
import random

from cuegrid.operators import segments

KIND = "recording_id long, id long, speaker string, start_s double, end_s double, text string, words array<struct<word:string,start:double,end:double>>"
THRESHOLDS = (0.4, 0.3, 0.2, 0.15)


def pieces(words, most):
    """A row's words in pieces: at the pause nearest the middle among those of the widest kind there is, else at the middle."""
    if len(words) < 2 or words[-1][2] - words[0][1] <= most:
        return [(words, False)]
    gaps = {i: words[i][1] - words[i - 1][2] for i in range(1, len(words))}
    for t in THRESHOLDS:
        if good := [i for i, g in gaps.items() if g > t]:
            at, force = min(good, key=lambda i: (abs(i - len(words) / 2), i)), False
            break
    else:
        at, force = (len(words) + 1) // 2, True
    return [(w, f or force) for part in (words[:at], words[at:]) for w, f in pieces(part, most)]


def plain(rows, window, least, most):
    out = []
    for rec, i, who, s, e, text, words in rows:
        if s is None or e is None or not (math.isfinite(s) and math.isfinite(e) and e > s):
            continue
        words = [tuple(w) for w in words or []]
        if words:
            a = words[0][1] if abs(words[0][1] - s) <= window else s
            z = words[-1][2] if abs(words[-1][2] - e) <= window else e
            s, e = (a, z) if z > a else (s, e)
        if e - s <= most:
            out.append((rec, i, 0, who, s, e, text, False))
        elif len(words) > 1:
            out += [(rec, i, k, who, w[0][1], w[-1][2], " ".join(x[0] for x in w), f) for k, (w, f) in enumerate(pieces(words, most))]
        else:
            def halves(s, e, ws, f):
                if len(ws) < 2 or e - s <= most:
                    return [(s, e, ws, f)]
                m, h = (s + e) / 2, len(ws) // 2
                return halves(s, m, ws[:h], True) + halves(m, e, ws[h:], True)
            out += [(rec, i, k, who, a, z, " ".join(ws), f) for k, (a, z, ws, f) in enumerate(halves(s, e, text.split(), False))]
    done = []
    for rec in {r[0] for r in out}:
        own = [r for r in out if r[0] == rec and any(c.isalnum() for c in r[6] or "") and r[5] - r[4] >= least]
        own = sorted(own, key=lambda r: (r[4], r[1], r[2]))
        done += [(rec, n, r[1], r[2], r[3] or "speaker_0", round(r[4], 3), round(r[5], 3), r[6], r[7]) for n, r in enumerate(own)]
    return done


def test_built_equals_a_loop(spark):
    rng = random.Random(4)
    rows = []
    for i in range(120):
        at, words = rng.uniform(0, 500), []
        for k in range(rng.choice([0, 1, 2, 8, 60])):
            at += rng.choice([0.05, 0.1, 0.18, 0.25, 0.5])
            words.append((f"w{i}x{k}", round(at, 3), round(at + 0.3, 3)))
            at += 0.3
        s, e = (words[0][1], words[-1][2]) if words else (at, at + rng.choice([0.1, 3.0, 25.0]))
        text = " ".join(w[0] for w in words) or " ".join(f"t{i}y{k}" for k in range(rng.randint(1, 9)))
        rows.append((1 + i % 3, i, rng.choice(["A", None]), round(s + rng.choice([-0.6, -0.2, 0.0, 0.3]), 3), round(e + rng.choice([0.5, 0.2, 0.0]), 3), text, words or None))
    rows += [(1, 500, "A", 3.0, 3.0, "none", None), (1, 501, "A", None, 4.0, "none", None), (1, 502, "A", 1.0, float("inf"), "none", None), (1, 503, "A", 1.0, 2.0, "...", None), (1, 504, "A", 1.0, 2.0, None, None)]
    got = sorted((r.recording_id, r.id, r.source_id, r.piece, r.speaker, r.start_s, r.end_s, r.text, "force_split" in r.flags) for r in segments.built(spark.createDataFrame(rows, KIND), window=0.4, least=0.4, most=10.0).collect())
    want = sorted(plain(rows, 0.4, 0.4, 10.0))
    assert len(got) == len(want) and len({x[2] for x in got}) < len(got)
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[7:] == b[7:] and abs(a[5] - b[5]) < 2e-3 and abs(a[6] - b[6]) < 2e-3, (a, b)


def test_speakers_split_and_numbers_follow(spark):
    words = [(f"w{k}", k * 0.5, k * 0.5 + 0.4) for k in range(12)]
    rows = [(1, 0, None, 0.0, 6.0, " ".join(w[0] for w in words), words), (1, 1, None, 8.0, 9.0, "later", None), (2, 0, None, 0.0, 2.0, "no turns here", None)]
    turns = spark.createDataFrame([(1, 0, 0.0, 2.95, "X"), (1, 1, 2.95, 6.0, "Y"), (1, 2, 7.5, 9.5, "X")], "recording_id long, id long, start_s double, end_s double, speaker string")
    regions = spark.createDataFrame([(1, 8.1, 9.0)], "recording_id long, start_s double, end_s double")
    doubts = spark.createDataFrame([(1, 0)], "recording_id long, source_id long")
    out = segments.recognised(spark.createDataFrame(rows, KIND), regions, turns, doubts).collect()
    by = {(r.recording_id, r.id): r for r in out}
    assert [(k, r.source_id, r.before) for k, r in sorted(by.items())] == [((1, 0), 0, 0), ((1, 1), 0, 0), ((1, 2), 1, 1), ((2, 0), 0, 0)]
    assert by[1, 0].text == "w0 w1 w2 w3 w4 w5" and by[1, 1].text == "w6 w7 w8 w9 w10 w11" and len(by[1, 1].words) == 6
    assert by[1, 0].speaker != by[1, 1].speaker and by[1, 0].speaker == by[1, 2].speaker and by[2, 0].speaker == "speaker_0"
    assert by[1, 0].flags == ["force_split", "speaker_doubt"] and by[1, 2].flags == [] and by[1, 2].start_s == 8.1
    assert segments.recognised(spark.createDataFrame([], KIND), regions, turns).count() == 0
