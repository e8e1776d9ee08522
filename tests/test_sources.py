"""Readers, signals, fingerprints, plug-ins and streams on small inputs."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid import plugins
from cuegrid.operators import fingerprints, progress, signal
from cuegrid.sources import readers
from cuegrid.streaming import jobs

RATE = 16_000


def tone(hz, seconds, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(int(RATE * seconds)) / RATE)


def test_wav_round_trip(spark, tmp_path):
    x = tone(220, 0.3)
    (tmp_path / "a.wav").write_bytes(readers.wav_bytes(x, RATE))
    (tmp_path / "b.wav").write_bytes(b"no sound")
    rows = {r.path[-5:]: r for r in readers.audio(spark.read.format("binaryFile").load(str(tmp_path / "*.wav"))).collect()}
    assert rows["a.wav"].rate == RATE and abs(rows["a.wav"].seconds - 0.3) < 1e-9
    assert np.abs(np.array(rows["a.wav"].samples) - x).max() < 1e-3
    assert rows["b.wav"].samples is None


@pytest.mark.parametrize("hz", [90, 150, 220, 380])
def test_pitch_of_a_tone(hz):
    assert abs(signal.pitch(signal.high_pass(tone(hz, 0.064), RATE), RATE) - hz) < 0.02 * hz
    assert signal.pitch(np.zeros(1024), RATE) is None


def test_pitches_in_spark(spark):
    df = spark.createDataFrame([([float(v) for v in tone(200, 0.2)], RATE)], "samples array<float>, rate int")
    got = df.select(signal.pitches(F.col("samples"), F.col("rate")).alias("p")).first().p
    assert len(got) == 7 and all(abs(p - 200) < 4 for p in got)


def test_pauses_and_silence():
    x = np.concatenate([tone(200, 0.5), np.zeros(int(0.4 * RATE)), tone(200, 0.5), np.zeros(RATE)])
    (pause,) = signal.pauses(x, RATE)
    assert abs(pause[0] - 0.5) < 0.03 and abs(pause[1] - 0.9) < 0.03
    longer = signal.with_silence(x, RATE, [0.7, 0.1], [0.2, 0.1])
    assert len(longer) == len(x) + int(0.3 * RATE)
    assert not longer[int(0.1 * RATE) : int(0.2 * RATE)].any()


def test_stft_round_trip():
    x = np.random.default_rng(1).normal(size=30_000)
    assert np.abs(signal.istft(signal.stft(x), len(x)) - x).max() < 1e-6


def test_segment_files(spark, tmp_path):
    (tmp_path / "good.json").write_text('[{"recording_id":1,"id":0,"start":0,"end":1.5,"text_src":"hi","flags":["x"]}]')
    (tmp_path / "bad.json").write_text("[{")
    assert [(r.id, r.end, r.flags) for r in readers.segments(spark, str(tmp_path)).where("id IS NOT NULL").collect()] == [(0, 1.5, ["x"])]


def test_fingerprints():
    assert fingerprints.stable_json({"b": 1, "a": {"d": None, "c": [1]}}) == '{"a":{"c":[1]},"b":1}'
    one, two = fingerprints.stage_chain({"s1": 1, "s2": 2, "s3": 3}, "x"), fingerprints.stage_chain({"s1": 1, "s2": 9, "s3": 3}, "x")
    assert one["s1"] == two["s1"] and one["s2"] != two["s2"] and one["s3"] != two["s3"]


def test_plug_in_carries_context(spark):
    class Told(plugins.Echo):
        def complete(self, system, user):
            return f"{len(system.split())}:{user}"

    plugins.REGISTRY["told"] = Told
    rows = spark.createDataFrame([(1, 1, 0, "a"), (1, 2, 0, "b"), (2, 1, 0, "c")], "recording_id long, id long, batch long, text string")
    got = {(r.recording_id, r.id): r.text_tgt for r in plugins.translated(rows, "echo").collect()}
    assert got == {(1, 1): "A", (1, 2): "B", (2, 1): "C"}
    assert plugins.chat("echo/large").complete("", "x") == "X"


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows = events.select("user_id", "event_id", F.floor("value").cast("long").alias("bytes"))
    path = str(tmp_path / "in")
    for k in range(3):  # files of rising ids
        rows.where(f"floor(event_id / 400) = {k}").coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/part=*")
    query = jobs.progress_totals(stream).writeStream.format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    want = {(r.user_id, r.event_id): r.total for r in progress.totals(rows, ["user_id"], ["event_id"]).collect()}
    assert {(r.user_id, r.event_id): r.total for r in spark.table("totals").collect()} == want


def test_sessions_and_latest_state(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    path = str(tmp_path / "in")
    events.coalesce(1).write.parquet(path)
    for name, make, mode in (("sessions", jobs.talk_sessions, "append"), ("latest", jobs.latest_state, "update"), ("firsts", jobs.first_of_each, "append")):
        query = make(spark.readStream.schema(events.schema).parquet(path)).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).outputMode(mode).trigger(availableNow=True).start()
        query.awaitTermination(120)
    assert spark.table("latest").count() == events.select("user_id").distinct().count()
    assert spark.table("firsts").count() == events.count()
    assert spark.table("sessions").count() > 0


def test_profiles_of_tones(spark):
    rows = [(1, "a", 1, [float(v) for v in tone(120, 2.0)], RATE), (1, "b", 2, [float(v) for v in tone(240, 2.0)], RATE), (1, "c", 3, [0.0] * RATE, RATE)]
    got = {r.speaker: r for r in signal.profile_speech(spark.createDataFrame(rows, "recording_id long, speaker string, id long, samples array<float>, rate int")).collect()}
    assert got["a"].gender == "m" and abs(got["a"].f0 - 120) < 3
    assert got["b"].gender == "f" and abs(got["b"].f0 - 240) < 5
    assert "c" not in got


def test_a_stage_depends_on_its_part_of_the_configuration():
    base = {"input": "x", "asr": {"model": "a"}, "translate": {"chars_per_second": 15}, "alignment": {"gap_ms": 80, "borrow_silence_ms": 400, "max_tempo": 1.2}, "tts": {"voice": "v", "clone": {"enabled": False, "steps": 4}}, "mix": {"db": -12}}
    changed = lambda part, **new: {k for k, v in fingerprints.config_slices({**base, part: {**base[part], **new}}).items() if v != fingerprints.config_slices(base)[k]}
    assert changed("alignment", max_tempo=1.3) == {"s6"} and changed("alignment", gap_ms=90) == {"s3", "s6"}
    assert changed("tts", clone={"enabled": True}) == {"s6"} and changed("tts", clone={"enabled": False, "steps": 8}) == set()
    assert changed("translate", chars_per_second=16) == {"s3", "s6"} and changed("mix", db=-9) == {"s7"}


def test_sizes_and_hashes_of_files(spark, tmp_path):
    import hashlib

    (tmp_path / "a" / "deep").mkdir(parents=True)
    (tmp_path / "b").mkdir()
    for name, body in (("a/x.json", b"12345"), ("a/deep/y.bin", b"123"), ("b/z", b""), ("top", b"1")):
        (tmp_path / name).write_bytes(body)
    assert {r.folder: r.bytes for r in readers.folder_sizes(spark, str(tmp_path)).collect()} == {"a": 8}
    got = {r.path.rsplit("/", 1)[1]: r.hash for r in readers.file_hashes(spark, str(tmp_path)).collect()}
    assert got["y.bin"] == hashlib.sha256(b"123").hexdigest() and len(got) == 3
