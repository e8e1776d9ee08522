"""Requests to language models and what comes back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import fixed
from cuegrid.functions.numbers import bounded_target_chars, places
from cuegrid.operators.sequence import scene_batches
from cuegrid.operators.speech import disputed, effective_gender


def _first_json(text: str) -> str | None:
    """The first JSON object or array in free text, by trying to decode from each bracket."""
    decoder = json.JSONDecoder()
    at = min((i for i in (text.find("{"), text.find("[")) if i >= 0), default=-1)
    if at < 0:
        return None
    try:
        return text[at : decoder.raw_decode(text, at)[1]]
    except ValueError:
        return None


def extracted_json(reply: Column) -> Column:
    """The first JSON value of a reply, null if there is none that is whole."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _first_json(t) if isinstance(t, str) else None)

    return run(reply)


def translations(replies: DataFrame, expected: DataFrame) -> DataFrame:
    """(recording_id, id, text) of replies (recording_id, reply): items or a bare array, known ids only, the last of equal ids wins, no empty texts."""
    item = "array<struct<id:string,text_ru:string,ru:string,text:string>>"
    body = replies.select("recording_id", extracted_json(F.col("reply")).alias("j"))
    items = F.coalesce(F.from_json("j", f"struct<items:{item}>")["items"], F.from_json("j", item))
    rows = body.select("recording_id", F.posexplode(items).alias("pos", "x"))
    named = rows.select("recording_id", "pos", F.expr("try_cast(x.id AS long)").alias("id"), F.trim(F.coalesce("x.text_ru", "x.ru", "x.text")).alias("text")).where("text <> ''")
    last = named.groupBy("recording_id", "id").agg(F.max(F.struct("pos", "text")).alias("r")).select("recording_id", "id", "r.text")
    return last.join(expected.select("recording_id", "id").distinct(), ["recording_id", "id"], "left_semi")


def _number(x: Column) -> Column:
    """A number as JSON has it: no fraction where it is whole."""
    return F.regexp_replace(x.cast("string"), "\\.0$", "")


def batch_requests(rows: DataFrame, genders: DataFrame, *, size: int, rate: float, cap: float, overhead: float = 0.0, fill: bool = True, lead: str = "Translate the lines. One on each line:") -> DataFrame:
    """(recording_id, batch, request): after a lead a JSON line for each row (recording_id, id, start_s, end_s, speaker, room, text).

    A line has the id, the room in seconds, the characters to reach (``fill``) or not to pass, bounded by the text's own
    length, the speaker where genders (recording_id, speaker, gender) say m or f, and the text. Batches end at changes of
    scene and at ``size`` rows, so a request is short.
    """
    told = rows.join(genders.where("gender IN ('m', 'f')").select("recording_id", "speaker", "gender"), ["recording_id", "speaker"], "left")
    chars = bounded_target_chars(F.length("text"), F.col("room"), rate, cap, overhead)
    who = F.when(F.col("gender") == "m", ',"speaker":"male"').when(F.col("gender") == "f", ',"speaker":"female"').otherwise("")
    body = F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text")))  # {"text":"..."}
    quoted = F.substring(body, F.lit(9), F.length(body) - 9)
    line = F.concat(F.lit('{"id":'), F.col("id").cast("string"), F.lit(',"slot_seconds":'), _number(places(F.col("room"), 2)), F.lit(',"target_chars":' if fill else ',"max_chars":'), chars.cast("long").cast("string"), who, F.lit(',"text":'), quoted, F.lit("}"))
    lines = scene_batches(told, size=size).groupBy("recording_id", "batch").agg(F.array_sort(F.collect_list(F.struct("start_s", "id", line.alias("l")))).alias("xs"))
    return lines.select("recording_id", "batch", F.concat(F.lit(lead + "\n"), F.array_join(F.transform("xs", lambda x: x["l"]), "\n")).alias("request"))


def glossary_text(glossary: Column) -> Column:
    """A map as a list of lines."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(glossary)), lambda e: F.concat(F.lit("- "), e["key"], F.lit(" = "), e["value"])), "\n")


def prompt(template: str, **values: Column) -> Column:
    """A template whose placeholders are replaced, the first of each."""
    out = F.lit(template)
    for name, value in values.items():
        mark = "{" + name + "}"
        at = F.instr(out, mark)
        out = F.when(at > 0, F.concat(F.substring(out, F.lit(1), at - 1), value, F.substring(out, at + len(mark), F.length(out)))).otherwise(out)
    return out


def language_column(code: Column, what: int) -> Column:
    """A value of a language's profile by the primary part of its code; languages not known are taken as Latin."""
    main = F.lower(F.split(code, "[-_]")[0])
    out = F.lit(fixed.LANGUAGES["en"][what])
    for name, profile in fixed.LANGUAGES.items():
        out = F.when(main == name, F.lit(profile[what])).otherwise(out)
    return out


def accepted_fits(rows: DataFrame) -> DataFrame:
    """rows (seconds, proposed, room) with ``taken``: a proposal counts if it is strictly nearer its room."""
    return rows.withColumn("taken", F.coalesce(F.abs(F.col("proposed") - F.col("room")) < F.abs(F.col("seconds") - F.col("room")), F.lit(False)))


def error_class(text: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    """The class of the first rule (part of a text, class) that fits, else other."""
    low, out = F.lower(text), F.lit("other")
    for part, name in reversed(rules):
        out = F.when(low.contains(part), name).otherwise(out)
    return out


def review_lines(rows: DataFrame, genders: DataFrame, *, most: Column) -> DataFrame:
    """(recording_id, id, speaker, gender, gender_disputed, name, source, text, max_chars, over) of rows with a translation, for a reviewer.

    rows: recording_id, id, speaker, source, text. genders: recording_id, speaker, voice, pitch, told, name; a voice settles
    the gender and ends a dispute, else pitch and then words tell. ``over`` is by how many characters the text exceeds ``most``.
    """
    said = rows.withColumn("text", F.trim("text")).where("text <> ''").join(genders, ["recording_id", "speaker"], "left")
    pitch, told = (F.coalesce(c, F.lit("unknown")) for c in ("pitch", "told"))
    return said.select(
        "recording_id", "id", "speaker", F.coalesce("voice", effective_gender(pitch, told)).alias("gender"), (F.col("voice").isNull() & disputed(pitch, told)).alias("gender_disputed"), F.nullif("name", F.lit("")).alias("name"),
        F.coalesce("source", F.lit("")).alias("source"), "text", most.alias("max_chars"), F.greatest(F.lit(0), F.length("text") - most).alias("over"),
    )


def phrase_requests(rows: DataFrame, phrases: DataFrame) -> DataFrame:
    """(recording_id, id, text, phrases, pauses): rows (recording_id, id, text) whose own words (phrases by recording and id) were spoken in two phrases or more, with the phrases' seconds and the pauses between them."""
    key = ["recording_id", "id"]
    item = F.struct("phrase", places(F.col("end_s") - F.col("start_s"), 2).alias("seconds"), "pause_after")
    own = phrases.groupBy(*key).agg(F.array_sort(F.collect_list(item)).alias("xs")).where(F.size("xs") > 1)
    said = rows.select(*key, F.trim("text").alias("text")).where("text <> ''").join(own, key)
    return said.select(*key, "text", F.transform("xs", lambda x: x["seconds"]).alias("phrases"), F.transform(F.slice("xs", 1, F.size("xs") - 1), lambda x: x["pause_after"]).alias("pauses"))


def track_selector(quality: Column) -> Column:
    """Selector of tracks for a quality: sound alone, the best, or no higher than so many lines."""
    lines = F.regexp_replace(quality, "p", "")
    limited = F.concat(F.lit("bv*[height<="), lines, F.lit("]+ba/b[height<="), lines, F.lit("]/b"))
    return F.when(quality == "audio", "ba[ext=m4a]/ba/b").when(quality == "best", "bv*+ba/b").otherwise(limited)
