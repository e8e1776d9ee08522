"""Requests to models: the pass that fits lengths, models side by side, and the snapshot of the model list."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import models
from cuegrid.sources import workspace

MEASURE = {"rate": 15.0, "overhead": 0.2, "tolerance": 0.15, "floor": 0.25}
SCHEMA = "recording_id long, id long, text string, slot double"


def _rows() -> list[tuple]:
    rng = random.Random(4)
    rows = [(i % 3, i, "ab " * rng.randint(0, 30), rng.choice([0.5, 1.0, 2.0, 4.0])) for i in range(60)]
    return [*rows, (0, 100, None, 1.0), (4, 0, "", 0.3)]


def _seconds(text: str) -> float:
    return 0.2 + len(text) / 15.0


def _fits(text: str, slot: float) -> bool:
    return abs(_seconds(text) - slot) <= max(slot * 0.15, 0.25)


def test_one_pass_equals_a_loop_and_makes_no_row_worse(spark):
    rows, sent = _rows(), []

    def refitter(asked):
        sent.extend(asked.collect())
        new = asked.where("chunk <> 1").withColumn("text", F.when(F.col("id") % 4 == 0, "").otherwise(F.rpad(F.expr("substring(text, 1, int(target))"), F.col("target").cast("int"), F.lit("x"))))
        twice = new.select("recording_id", "id", "text")
        return twice.unionByName(twice.where("text <> ''").withColumn("text", F.concat("text", F.lit("z" * 90)))).unionByName(spark.createDataFrame([(9, 9, "never asked for"), (0, 100, "nor this")], "recording_id long, id long, text string"))

    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.recording_id, r.id): r for r in models.fitted_lengths(df, refitter, size=5, cap=2.0, **MEASURE).collect()}
    asked = {(r.recording_id, r.id): r for r in sent}
    assert len(got) == len(rows) and len(sent) == len(asked) > 20
    ids: dict = {}
    for rec, i in sorted(asked):
        ids.setdefault(rec, []).append(i)
    for rec, i, text, slot in rows:
        r, want = got[rec, i], text
        if (rec, i) in asked:
            a = asked[rec, i]
            assert not _fits(text, slot) and a.chunk == ids[rec].index(i) // 5
            new = "" if i % 4 == 0 or a.chunk == 1 else text[: a.target].ljust(a.target, "x")
            if new and abs(_seconds(new) - slot) < abs(_seconds(text) - slot):
                want = new
        assert (r.text, r.fitted) == (want, want != text)
    assert sum(r.fitted for r in got.values()) > 10


def test_a_pass_over_nothing(spark):
    out = models.fitted_lengths(spark.createDataFrame([], SCHEMA), lambda asked: asked, size=5, cap=2.0, **MEASURE)
    assert out.columns == ["recording_id", "id", "text", "slot", "fitted"] and out.collect() == []


def test_models_side_by_side_and_one_failure_stops_no_other(spark):
    rows = _rows()

    def plain(df):
        return df.select("recording_id", "id", F.col("text").alias("text_tgt"), F.lit(2).alias("prompt_tokens"), F.lit(1).alias("completion_tokens"))

    def some(df):
        one = df.where("id % 2 = 0").select("recording_id", "id", F.lit("abcde").alias("text_tgt"), F.lit(0.5).alias("cost"))
        return one.unionByName(one)

    def in_a_task(df):
        return df.select("recording_id", "id", F.raise_error(F.lit("out of words")).cast("string").alias("text_tgt"))

    def never_ends(batches):
        for batch in batches:
            time.sleep(60)
            yield batch

    def raises(batches):
        raise ValueError("no answer at all")

    def in_python(df):
        return df.mapInArrow(raises, df.schema).withColumnRenamed("text", "text_tgt")

    def slow(df):
        return df.mapInArrow(never_ends, df.schema).withColumnRenamed("text", "text_tgt")

    began = time.monotonic()
    group = spark.sparkContext.getLocalProperty("spark.jobGroup.id")
    report, lines = models.compared(spark.createDataFrame(rows, SCHEMA), {"in a task": in_a_task, "in python": in_python, "slow": slow, "plain": plain, "some": some}, prices={"plain": (0.5, 4.0), "some": (1.0, 1.0)}, budget_s=12, **MEASURE)
    assert time.monotonic() - began < 50
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == group
    by = {r.model: r for r in report.collect()}
    assert not by["slow"].ok and by["slow"].error == "more than 12 s" and by["slow"].total == 0 and by["slow"].seconds >= 12
    assert not by["in a task"].ok and "out of words" in by["in a task"].error and not by["in a task"].passed
    assert by["in python"].error == "ValueError: no answer at all"
    answered = [(t, s) for _, _, t, s in rows if t is not None]
    p = by["plain"]
    assert p.ok and p.error is None and p.total == len(answered) and p.within == sum(_fits(t, s) for t, s in answered) and p.share == p.within / p.total
    assert p.too_long + p.too_short + p.within == p.total and (p.prompt_tokens, p.completion_tokens, p.cost) == (2 * len(rows), len(rows), 5.0 * len(rows))
    even = sum(i % 2 == 0 for _, i, _, _ in rows)
    assert by["some"].total == even and by["some"].cost == 1.0 * even
    got = {(r.model, r.recording_id, r.id): r for r in lines.collect()}
    assert len(got) == 2 * len(rows)
    for rec, i, text, slot in rows:
        assert got["plain", rec, i].fits == (text is not None and _fits(text, slot))
        assert got["some", rec, i].fits == (i % 2 == 0 and _fits("abcde", slot))


def test_no_model_and_no_row(spark):
    report, lines = models.compared(spark.createDataFrame([], SCHEMA), {}, **MEASURE)
    assert report.collect() == [] and lines.collect() == []


def test_a_snapshot_is_read_while_it_is_young(spark, tmp_path):
    at, calls = str(tmp_path / "models"), []

    def fetch(answer: str):
        def call() -> str:
            calls.append(answer)
            return answer

        return call

    def names(answer: str, **options) -> list[str]:
        return sorted(r.id for r in workspace.catalogue_snapshot(spark, at, fetch(answer), **options).collect())

    first, second = (json.dumps({"data": [{"id": x}, {"id": x + "2"}]}, indent=1) for x in "ab")
    assert names(first) == ["a", "a2"] and names(second) == ["a", "a2"] and len(calls) == 1
    assert names(second, force=True) == ["b", "b2"] and names(first, most_age_s=3600) == ["b", "b2"]
    time.sleep(1.2)
    assert names(first, most_age_s=1) == ["a", "a2"] and len(calls) == 3
    with pytest.raises(ValueError):
        names("no json", force=True)
    assert names(second) == ["a", "a2"]
    for path in (tmp_path / "models").rglob("*.json"):
        path.write_text("broken {")
    for path in (tmp_path / "models").rglob(".*.crc"):
        path.unlink()
    assert names(second) == ["b", "b2"]
