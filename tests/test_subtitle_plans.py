"""snk04: cues are counted with their file, so texts are split into cues once."""

from __future__ import annotations

from cuegrid.operators import cues


def test_texts_are_split_once_for_each_kind_of_rules(spark, capsys):
    rows = spark.createDataFrame([(1, k, 5.0 * k, 5.0 * k + 4, "A sentence of some words. " * 8, "Да" if k else None, 0) for k in range(3)], "recording_id long, id long, start_s double, end_s double, text_src string, text_tgt string, shift_ms int")
    known = spark.createDataFrame([(1, "film.mp4", "en")], "recording_id long, input string, lang string")
    files, _ = cues.subtitle_files(rows, known)
    assert all(r.cues == r.content.count(" --> ") > 1 for r in files.collect())
    again, _ = cues.subtitle_files(rows, known)
    capsys.readouterr()
    again.explain()
    assert capsys.readouterr().out.count("Generate posexplode") == 4
