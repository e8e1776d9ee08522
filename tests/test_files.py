"""Subtitle files and descriptions of addresses."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cuegrid.operators import cues
from cuegrid.sources import readers


def test_subtitle_files_follow_their_language(spark):
    long = "これは長い文です。" * 6
    rows = [(1, 0, 1.0, 4.0, "Hello there", "Привет", 500), (1, 1, 5.0, 9.0, "General text", None, None), (2, 0, 0.0, 8.0, long, None, 0), (3, 0, 0.0, 1.0, None, "только", None), (4, 0, 0.0, 1.0, " ", "", 0)]
    df = spark.createDataFrame(rows, "recording_id long, id long, start_s double, end_s double, text_src string, text_tgt string, shift_ms int")
    known = spark.createDataFrame([(1, "/a/b/film.part.mp4", "en-GB"), (2, "https://x/y.mp4", "ja"), (3, "plain", None), (4, "none.mkv", "xx")], "recording_id long, input string, lang string")
    files, warnings = cues.subtitle_files(df, known)
    got = {(r.recording_id, r.kind): r for r in files.collect()}
    assert {k: r.name for k, r in got.items()} == {(1, "source"): "film.part.en.srt", (1, "target"): "film.part.ru.srt", (2, "source"): "subtitles.ja.srt", (3, "target"): "plain.ru.srt"}
    assert all(r.content.startswith("﻿1\n") for r in got.values())
    assert sorted(r.recording_id for r in warnings.collect()) == [2, 4]
    parsed = {(r.recording_id, r.n): r for r in cues.parse_srt(files.where("kind = 'target' or recording_id = 2").select("recording_id", F.col("content").alias("srt"))).collect()}
    assert abs(parsed[1, 1].start_s - 1.5) < 1e-3 and parsed[1, 1].lines == ["Привет"]
    assert got[2, "source"].cues >= 2  # lines of half the width of Latin ones


def test_what_an_address_holds(spark):
    video = {"height": 720, "filesize": 500, "vcodec": "v", "acodec": "none"}
    sound = {"filesize_approx": 30, "vcodec": "none", "acodec": "a"}
    told = [
        (1, {"id": "a", "title": "T", "channel": "C", "duration": 9.5, "thumbnails": [{"url": "p"}], "is_live": True, "formats": [video, {**video, "height": 2160, "filesize": 9000}, sound]}),
        (2, {"_type": "playlist", "id": "l", "is_live": True, "entries": [{"id": "x", "url": "u", "duration": 4}, {"webpage_url": "w", "title": "n"}]}),
        (3, {"_type": "playlist", "entries": []}),
        (4, {"formats": [{"height": 360, "filesize": 7, "vcodec": "v", "acodec": "a"}], "webpage_url": "real"}),
    ]
    df = spark.createDataFrame([(i, f"https://{i}", json.dumps(j)) for i, j in told] + [(5, "https://5", "no json"), (6, None, None)], "item long, url string, json string")
    out = {r.item: r for r in readers.web_media(df).collect()}
    assert len(out) == 6
    assert (out[1].height, out[1].bytes, out[1].uploader, out[1].thumbnail, out[1].is_live, out[1].seconds) == (720, 530, "C", "p", True, 9.5)
    assert (out[2].title, out[2].seconds, out[2].is_live, out[2].height, [tuple(e) for e in out[2].entries]) == ("Playlist", 4.0, False, None, [("x", "u", "(untitled)", 4.0), ("", "w", "n", None)])
    assert (out[3].seconds, out[3].entries) == (None, []) and (out[4].height, out[4].bytes, out[4].url) == (360, 7, "real")
    assert (out[5].id, out[5].title, out[5].url) == ("", "(untitled)", "https://5") and out[6].url is None
