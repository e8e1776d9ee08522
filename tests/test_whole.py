"""Queries over whole tables: nothing of a long recording is left out."""

from __future__ import annotations

from cuegrid import plugins
from cuegrid.operators import speech
from cuegrid.plans import records, timeline, voices
from cuegrid.sources import readers


def conversations(spark, tmp_path, rows) -> str:
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def test_words_beyond_a_block(spark, tmp_path):
    d = conversations(spark, tmp_path, [(1, t, "user", " ".join(f"w{t}x{i}" for i in range(90))) for t in range(10)] + [(2, 0, "user", "few words")])
    want = {1: [f"w{t}x{i}" for t in range(10) for i in range(90)], 2: ["few", "words"]}
    for query in (records.all_plain_words, records.all_stamped_words):
        got: dict = {}
        for r in sorted(query(spark, d).collect(), key=lambda r: (r.recording_id, r.pos)):
            got.setdefault(r.recording_id, []).append(r.word)
            assert r.pos == len(got[r.recording_id]) - 1
        assert got == want


def test_translations_of_all_texts_carry_on(spark, tmp_path):
    class Told:
        """Answers with what it was told and the text, so that the carried state shows."""

        def complete(self, system: str, user: str) -> str:
            return f"{user}<{system.count(chr(10))}{system[-2:]}"

    texts = [(c, t, "user", None if t == 7 else f"ж{c}.{t}") for c in (1, 2, 13) for t in range(50)]
    d = conversations(spark, tmp_path, texts)
    assert {(r.recording_id, r.id): r.text_tgt for r in records.all_translated(spark, d).collect()} == {(c, t): x and x.upper() for c, t, _, x in texts}
    plugins.REGISTRY["told"] = Told
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = spark.createDataFrame([(c, t, t // 4, x) for c, t, _, x in texts], "recording_id long, id long, batch long, text string")
        got = {(r.recording_id, r.id): r.text_tgt for r in plugins.translated(rows, "told").collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        del plugins.REGISTRY["told"]
    told = {c: "" for c in (1, 2, 13)}
    for c, t, _, x in texts:
        want = x and Told().complete(told[c], x)
        assert got[c, t] == want
        told[c] = "\n".join([*told[c].split("\n"), want or ""][-3:])


def test_picks_and_choices(spark):
    said = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (2, "a", 3), (5, "a", 4), (5, "b", 5)], "recording_id long, speaker string, id long")
    best = spark.createDataFrame([(1, "a", 1, 1), (1, "a", 2, 2), (2, "a", 3, 1), (5, "a", 4, 1)], "recording_id long, speaker string, id long, rank int")
    choices = spark.createDataFrame([(1, "a", "2"), (2, "a", "off"), (5, "a", "5"), (5, "b", "5")], "recording_id long, speaker string, chosen string")
    assert {(r.recording_id, r.speaker, r.id) for r in speech.picked_references(best, said, choices).collect()} == {(1, "a", 2), (2, "a", None), (5, "a", 4), (5, "b", 5)}


def test_formats_without_codec(spark):
    rows = spark.createDataFrame([("x", 4, 720, 1.0, "avc", None), ("x", 8, None, 9.0, "none", "aac"), ("x", 5, 720, 2.0, "none", None), ("x", 12, 720, 3.0, "avc", "aac")], "item string, id long, height int, bytes double, vcodec string, acodec string")
    assert {(r.id, r.rank) for r in readers.listed_formats(rows).collect()} == {(12, 1), (4, 2), (8, 3)}


def test_comparisons_and_contexts_hold_whole_texts(spark, tmp_path):
    long = lambda c, t: f"text {c}.{t} " + "word " * 12 + "end"
    d = conversations(spark, tmp_path, [(c, t, "user", long(c, t)) for c in (0, 1, 2, 9, 10, 11, 13) for t in range(6 if c % 3 else 4)])
    got = {(r.comparison, r.pos): r.texts for r in voices.all_side_by_side(spark, d).collect()}
    want = {(g, t): " | ".join(f"m{m}: {long(3 * g + m, t)}" for m in range(3)) for g in (0, 3) for t in range(4)}
    assert got == want | {(4, t): f"m1: {long(13, t)}" for t in range(6)}
    for r in timeline.whole_context(spark, d).collect():
        assert r.context == " | ".join(long(r.recording_id, t) for t in range(max(0, r.id - 3), r.id))
