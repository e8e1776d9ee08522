"""Folders of recordings and frames of sound, written and read again."""

from __future__ import annotations

import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuegrid.sources import frames, readers, workspace


def write(path, value) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=2) + "\n")


def test_siblings_and_their_defaults(spark, tmp_path):
    root = tmp_path / "cache"
    write(root / "one two" / "meta.json", {"input": "a.mp4", "duration_seconds": 12.5, "has_video": True, "stage_fingerprints": {"s1": "x"}, "extra": 1})
    write(root / "one two" / "speakers.json", {"S1": {"gender": "m", "f0": 120.5, "text": {"gender": "m", "self": 2}}})
    write(root / "one two" / "cues.target.json", [{"index": 1, "start": 0.5, "end": 1.5, "lines": ["a", "b"], "segmentId": 7}])
    write(root / "one two" / "state.json", {"fingerprints": {"s2": "f"}})
    write(root / "one two" / "review.json", {"model": "m", "entries": [{"id": 3, "verdict": "applied", "miss_before": 0.5}]})
    write(root / "one two" / "overrides.json", {"voices": {"S1": " v "}, "refs": {"S1": "off"}})
    for name in ("meta", "speakers", "cues.target", "state", "review", "overrides"):
        write(root / "broken" / f"{name}.json", "{ no json")
    write(root / "one two" / "deeper" / "meta.json", {"input": "hidden"})
    wanted = spark.createDataFrame([("one two",), ("broken",), ("absent",), ("absent",)], "recording_id string")
    get = lambda df: {r.recording_id: r.value for r in df.collect()}
    meta = get(workspace.meta(spark, str(root), wanted))
    assert set(meta) == {"one two", "broken", "absent"} and meta["absent"] is None and meta["one two"].duration_seconds == 12.5 and meta["one two"].stage_fingerprints == {"s1": "x"}
    assert meta["broken"] is None
    speakers = get(workspace.speakers(spark, str(root), wanted))
    assert speakers["one two"]["S1"].f0 == 120.5 and speakers["one two"]["S1"].text.self == 2 and speakers["absent"] == speakers["broken"] == {}
    cues = get(workspace.cues(spark, str(root), wanted, "target"))
    assert cues["one two"][0].lines == ["a", "b"] and cues["broken"] is None and cues["absent"] is None
    assert set(get(workspace.cues(spark, str(root), wanted, "source")).values()) == {None}
    state = get(workspace.state(spark, str(root), wanted))
    assert state["one two"].fingerprints == {"s2": "f"} and state["one two"].segmentsHash == {} and state["absent"].fingerprints == state["broken"].segmentsHash == {}
    assert get(workspace.review(spark, str(root), wanted))["one two"].entries[0].verdict == "applied"
    edits = {r.recording_id: r for r in workspace.overrides(spark, str(root), wanted).collect()}
    assert edits["one two"].voices == {"S1": "v"} and edits["one two"].refs["S1"].off and edits["absent"].voices == edits["broken"].voices == {}


def test_projects_newest_first(spark, tmp_path):
    root = tmp_path / "cache"
    for k, name in enumerate(["old", "new", "mid", "tools", "bad", "badstate"]):
        write(root / name / "meta.json", {"input": f"{name}.mp4", "duration_seconds": k, "has_video": False, "created_at": "2024"} if name != "bad" else "{")
        os.utime(root / name / "meta.json", (1_700_000_000 + {"new": 300, "mid": 200}.get(name, 100),) * 2)
    write(root / "new" / "state.json", {"fingerprints": {"s2": "b", "s1": "a"}})
    write(root / "badstate" / "state.json", "nothing")
    (root / "empty").mkdir()
    got = [(r.id, r.input, r.stages) for r in workspace.projects(spark, str(root)).collect()]
    assert got == [("new", "new.mp4", ["s1", "s2"]), ("mid", "mid.mp4", []), ("old", "old.mp4", [])]


def test_a_failed_write_leaves_what_was_there(spark, tmp_path):
    root, kind = str(tmp_path / "segments"), "recording_id long, id int, text string, flags array<string>"
    first = spark.createDataFrame([(1, 0, "a", ["x"]), (1, 1, None, []), (2, 0, "b", None)], kind)
    workspace.write_recordings(first, root)
    read = lambda: sorted((r.recording_id, r.id, r.text, r.flags) for r in workspace.read_recordings(spark, root, kind).collect())
    before = read()
    assert before == [(1, 0, "a", ["x"]), (1, 1, None, []), (2, 0, "b", None)]
    boom = F.udf(lambda x: 1 // 0 if x > 50 else "new", "string")
    broken = spark.range(100).select(F.lit(1).cast("long").alias("recording_id"), F.col("id").cast("int").alias("id"), boom("id").alias("text"), F.lit(None).cast("array<string>").alias("flags"))
    with pytest.raises(Exception, match="division"):
        workspace.write_recordings(broken, root)
    assert read() == before
    workspace.write_recordings(spark.createDataFrame([(1, 5, "c", None), (3, 0, "d", None)], kind), root)
    assert read() == [(1, 5, "c", None), (2, 0, "b", None), (3, 0, "d", None)]


def test_written_segments_can_be_read_as_segments(spark, tmp_path):
    rows = spark.createDataFrame([(4, 0, 0.5, 1.5, "A", "hello", ["f"])], "recording_id long, id int, start double, end double, speaker string, text_src string, flags array<string>")
    workspace.write_recordings(rows, str(tmp_path / "s"))
    (r,) = workspace.read_recordings(spark, str(tmp_path / "s"), readers.SEGMENT).collect()
    assert (r.recording_id, r.id, r.start, r.text_src, r.flags, r.words) == (4, 0, 0.5, "hello", ["f"], None)


def wav(samples: np.ndarray, rate: int = 8000, bits: int = 16, said: int | None = None, before: bytes = b"") -> bytes:
    channels = samples.shape[1] if samples.ndim > 1 else 1
    body = samples.astype("<i2").tobytes()
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, channels, rate, rate * channels * 2, channels * 2, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVE" + before + fmt + struct.pack("<4sI", b"data", len(body) if said is None else said) + body


def test_frames_equal_a_whole_read(spark, tmp_path):
    rng = np.random.default_rng(1)
    shapes = {"mono": (5003,), "stereo": (700, 2), "short": (3,), "exact": (512,), "none": (0,)}
    data = {k: rng.integers(-32768, 32767, s) for k, s in shapes.items()}
    for k, x in data.items():
        (tmp_path / f"{k}.wav").write_bytes(wav(x, before=struct.pack("<4sI", b"LIST", 3) + b"abc\0" if k == "stereo" else b"", said={"mono": 0xFFFFFFFF}.get(k)))
    for per_task in (700, 64 << 20):  # a frame of a few tasks, and all in one
        df = frames.frames(spark, str(tmp_path), 256, bytes_per_task=per_task)
        if per_task == 700:
            assert df.rdd.getNumPartitions() > 20
        got: dict = {}
        for r in sorted(df.collect(), key=lambda r: (r.path, r.frame_id)):
            own = got.setdefault(r.path.split("/")[-1][:-4], [])
            assert r.frame_id == len(own) and len(r.samples) == 256
            own.append(r.samples)
        assert set(got) == set(shapes) - {"none"}
        for k, own in got.items():
            mono = data[k] if data[k].ndim == 1 else data[k].mean(axis=1)
            flat = np.concatenate(own)
            assert np.allclose(flat[: len(mono)], mono / 32768, atol=1e-7) and not flat[len(mono) :].any() and len(flat) - len(mono) < 256


def test_a_file_beyond_two_gigabytes(tmp_path):
    """Ranges of a sparse file; its last range is read alone."""
    path, size = tmp_path / "long.wav", 2_400_000_000
    head = wav(np.zeros(0), said=size)
    with path.open("wb") as f:
        f.write(head)
        f.truncate(len(head) + size)
        f.seek(len(head) + size - 4)
        f.write(struct.pack("<hh", 16384, -16384))
    reader = frames.FramesReader({"path": str(path), "framesize": "1000"})
    parts = reader.partitions()
    total = -(-size // 2 // 1000)
    assert len(parts) > 30 and parts[0].first == 0 and parts[-1].end == total and all(a.end == b.first for a, b in zip(parts, parts[1:], strict=False))
    last = list(reader.read(frames.Range(str(path), parts[-1].pcm, total - 1, total)))[-1]
    assert last.column("samples")[0].as_py()[-2:] == [0.5, -0.5]


def test_files_of_another_kind(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(np.arange(10)))
    (tmp_path / "b.wav").write_bytes(wav(np.arange(10), bits=24))
    (tmp_path / "c.wav").write_bytes(b"text")
    with pytest.raises(Exception, match="16-bit|RIFF"):
        frames.frames(spark, str(tmp_path), 4).collect()
    assert frames.frames(spark, str(tmp_path), 4, bad_files="skip").count() == 3


def test_a_clip_is_its_first_channel(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(np.stack([np.full(8, 16384), np.zeros(8)], axis=1)))
    (tmp_path / "b.wav").write_bytes(b"none")
    out = {r.path.split("/")[-1]: r for r in frames.clip(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert out["a.wav"].samples == [0.5] * 8 and out["a.wav"].rate == 8000 and out["b.wav"].samples is None
