"""Voices for speakers, and checks of what a stage has made."""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import date

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def voice_of(speaker: Column, voices: Column, default: str) -> Column:
    """The voice of a map, or the default."""
    return F.coalesce(F.try_element_at(voices, speaker), F.lit(default))


def nearest_voice(speakers: DataFrame, voices: DataFrame, *, slack: float = 25.0) -> DataFrame:
    """(recording_id, speaker, voice): the voice (name, f0, accent) whose pitch is nearest the speaker's f0, the first by name of equals; one without an accent wins if it is nearly as near.

    Voices are a cast's short list: it goes to every task sorted by pitch, and each speaker is held against the two
    pitches around its own. More than 10,000 voices are refused.
    """
    held = [(r.f0, r.name, r.accent) for r in voices.where("f0 IS NOT NULL AND NOT isnan(f0)").select("f0", "name", "accent").limit(10_001).collect()]
    if len(held) > 10_000:
        raise ValueError("voices are a list of at most 10,000 rows")

    def ladder(own: list[tuple]) -> tuple[np.ndarray, list[str]]:
        first = {}
        for f0, name, _ in sorted(own):
            first.setdefault(f0, name)
        return np.array(list(first)), list(first.values())

    every, clean = ladder(held), ladder([v for v in held if v[2] is False])

    def near(f0: float, steps: tuple[np.ndarray, list[str]]) -> tuple[float, str] | None:
        at = int(np.searchsorted(steps[0], f0))
        return min(((abs(float(steps[0][k]) - f0), steps[1][k]) for k in (at - 1, at) if 0 <= k < len(steps[1])), default=None)

    @F.pandas_udf("string")
    def pick(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pitches in batches:
            out = []
            for f0 in pitches:
                best, plain = near(f0, every), near(f0, clean)
                out.append(None if best is None else plain[1] if plain and plain[0] <= best[0] + slack else best[1])
            yield pd.Series(out, dtype=object)

    named = speakers.where("f0 IS NOT NULL").select("recording_id", "speaker", pick("f0").alias("voice"))
    return named.where("voice IS NOT NULL")


def assigned(speakers: DataFrame, voices: list[tuple[str, str, float | None, bool]]) -> DataFrame:
    """(recording_id, speaker, voice): speakers of a recording in turn take the nearest free voice of their gender, or the next in rotation without a pitch; taken voices again only when none is free. A recording's speakers are few."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        taken: set[str] = set()
        turn: dict[str, int] = {}
        out = []
        number = lambda s: int(m[0]) if (m := re.search(r"\d+$", s)) else 0
        for row in sorted(group.itertuples(), key=lambda r: (number(r.speaker), r.speaker)):
            pool = [v for v in voices if v[1] == row.gender] or voices
            free = [v for v in pool if v[0] not in taken] or pool
            pitched = [v for v in free if v[2] is not None] if not pd.isna(row.f0) else []
            if pitched:
                near = min(pitched, key=lambda v: abs(v[2] - row.f0))
                clean = min((v for v in pitched if not v[3]), key=lambda v: abs(v[2] - row.f0), default=None)
                pick = clean if clean and abs(clean[2] - row.f0) <= abs(near[2] - row.f0) + 25 else near
            else:
                ordered = sorted(free, key=lambda v: v[3])
                pick = ordered[turn.get(row.gender, 0) % len(ordered)]
                turn[row.gender] = turn.get(row.gender, 0) + 1
            taken.add(pick[0])
            out.append((row.recording_id, row.speaker, pick[0]))
        return pd.DataFrame(out, columns=["recording_id", "speaker", "voice"])

    return speakers.select("recording_id", "speaker", "gender", "f0").groupBy("recording_id").applyInPandas(run, "recording_id long, speaker string, voice string")


def speaking_genders(profiles: DataFrame, chosen: DataFrame) -> DataFrame:
    """(recording_id, speaker, gender, firm): an explicit choice (voice_gender) first, else the profile's."""
    both = profiles.join(chosen, ["recording_id", "speaker"], "full_outer")
    return both.select("recording_id", "speaker", F.coalesce("voice_gender", "gender", F.lit("unknown")).alias("gender"), F.col("voice_gender").isNotNull().alias("firm"))


def stage_complete(rows: DataFrame, files: DataFrame, source: str, made: str) -> DataFrame:
    """(recording_id, complete): something was made, and each row with a source has a file that exists."""
    there = files.select(F.col("file").alias(made), F.lit(True).alias("_there")).distinct()
    marked = rows.join(there, made, "left")
    fine = F.col(source).isNull() | (F.col(source) == "") | F.coalesce("_there", F.lit(False))
    return marked.groupBy("recording_id").agg((F.bool_or(F.col(made).isNotNull()) & F.bool_and(fine)).alias("complete"))


def judged_translation(rows: DataFrame) -> DataFrame:
    """(recording_id, ok, reason): whether all rows have a text, and all of it in Cyrillic."""
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    by = rows.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(blank).alias("missing"), F.count_if(~blank & ~F.coalesce("text", F.lit("")).rlike("[а-яёА-ЯЁ]")).alias("foreign"))
    reason = F.when(F.col("missing") > 0, F.concat(F.lit("missing "), F.col("missing").cast("string"))).when(F.col("foreign") > 0, F.concat(F.lit("foreign "), F.col("foreign").cast("string")))
    return by.select("recording_id", reason.isNull().alias("ok"), reason.alias("reason"))


def stale(version: Column, today: date, most_days: int = 45) -> Column:
    """Whether a version that begins with its date is older than so many days; another version is not."""
    day = F.regexp_extract(F.trim(version), "^(\\d{4}\\.\\d{2}\\.\\d{2})", 1)
    return F.coalesce(F.datediff(F.lit(today), F.try_to_timestamp(day, F.lit("yyyy.MM.dd")).cast("date")) > most_days, F.lit(False))


def usable_token_rate(prompt: Column, completion: Column, chars: Column, least: int = 500) -> Column:
    good = lambda c: ~F.isnan(c) & (c > 0) & (c < float("inf"))
    return F.coalesce(good(prompt) & good(completion) & (chars >= least), F.lit(False))


def side_by_side(outputs: DataFrame, by: str | None = None) -> DataFrame:
    """(pos, texts): outputs (model, pos, text) of all models beside those of the first, by place; with ``by`` a column of its own comparison, which comes first."""
    if by is None:
        first = outputs.agg(F.min("model").alias("m"))
        base, key = outputs.join(F.broadcast(first), F.col("model") == F.col("m")).select("pos"), ["pos"]
    else:
        key = [by, "pos"]
        base = outputs.join(outputs.groupBy(by).agg(F.min("model").alias("model")), [by, "model"]).select(*key)
    return base.distinct().join(outputs, key).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("model", "text"))).alias("texts"))


def listing(media: DataFrame, projects: DataFrame) -> DataFrame:
    """media (path) with the first project (path, id, stages) of the same path, no stages if there is none."""
    first = projects.groupBy("path").agg(F.min(F.struct("id", "stages")).alias("p"))
    return media.join(first, "path", "left").select(*media.columns, F.col("p.id").alias("project"), F.coalesce("p.stages", F.lit(0)).alias("stages"))


def ranked(rows: DataFrame) -> DataFrame:
    """rows (recording_id, model, ok, share) with rank: good ones first, then by share."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("recording_id").orderBy(F.desc("ok"), F.desc("share"), "model")))
