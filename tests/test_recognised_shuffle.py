"""orc07: the words of segments meet turns and doubts without being shuffled for each."""

from __future__ import annotations

import re

from cuegrid.operators import segments
from test_built import KIND


def test_words_are_not_shuffled_for_each_join(spark, capsys):
    words = [(f"w{k}", k * 0.5, k * 0.5 + 0.4) for k in range(12)]
    rows = [(i, k, None, 10.0 * k, 10.0 * k + 6, " ".join(w[0] for w in words), [(w, 10 * k + a, 10 * k + z) for w, a, z in words]) for i in range(5) for k in range(3)]
    kind = "recording_id long, id long, start_s double, end_s double, speaker string"
    turns = spark.createDataFrame([(i, k, 5.0 * k, 5.0 * k + 4.5, "XYZ"[(i + k) % 3]) for i in range(4) for k in range(6)], kind)
    regions = spark.createDataFrame([(1, 0.1, 5.0)], "recording_id long, start_s double, end_s double")
    doubts = spark.createDataFrame([(i, 1) for i in range(0, 5, 2)] + [(None, 1), (1, None)], "recording_id long, source_id long")
    out = segments.recognised(spark.createDataFrame(rows, KIND), regions, turns, doubts)
    got = out.collect()
    assert {(r.recording_id, r.source_id) for r in got if "speaker_doubt" in r.flags} == {(i, 1) for i in (0, 2, 4)}
    assert {r.speaker for r in got if r.recording_id == 4} == {"speaker_0"} and len({r.speaker for r in got if r.recording_id == 0}) > 1
    assert all(sorted(r.id for r in got if r.recording_id == i) == list(range(sum(r.recording_id == i for r in got))) for i in range(5))
    capsys.readouterr()
    out.explain("formatted")
    moved = re.findall(r"\n\(\d+\) Exchange\nInput \[\d+\]: \[([^\n]*)\]", capsys.readouterr().out)
    # In the plan and in the plan as it ran: to the recordings with turns, to the turns that meet a segment, and by recording.
    assert sum(bool(re.search(r"\bwords#", x)) for x in moved) <= 6, moved
