"""Cues and subtitle files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import fixed
from cuegrid.functions import text as tx

#: Where the width of lines stands in a language's profile; reading rate and ends of sentences follow.
_WIDTH = 2


def break_points(text: Column) -> Column:
    """Places (from 1) of marks that a space follows."""
    # The text is taken apart once and bound, as a place found from a text's beginning costs the length before it.
    marked = lambda cs, i: F.get(cs, i - 1).isin(".", ",", "!", "?", ";", ":", "…", "—") & (F.get(cs, i) == " ")
    places_ = F.transform(F.array(F.split(text, "")), lambda cs: F.filter(F.sequence(F.lit(1), F.greatest(F.size(cs) - 1, F.lit(1))), lambda i: marked(cs, i)))
    return F.when(text.isNotNull(), F.get(places_, 0))


def plan(items: DataFrame, *, width: int = 42, most_lines: int = 2, least: float = 1.0, most: float = 7.0, gap: float = 0.084, rate: float = 17.0, enders: str = ".!?…") -> DataFrame:
    """(recording_id, n, id, start_s, end_s, lines): rows as cues. A text beyond one cue is split, its time shared by characters; a cue lasts as long as it takes to read, within the limits and before the next."""
    t = tx.collapsed(F.col("text"))
    rows = items.where((t != "") & (F.col("end_s") > F.col("start_s"))).select("recording_id", "id", "start_s", "end_s", tx.split_long(F.col("text"), width * most_lines, enders).alias("parts"))
    rows = rows.withColumn("total", F.aggregate("parts", F.lit(0), lambda s, x: s + F.length(x))).select("*", F.posexplode("parts").alias("k", "text"))
    before = F.aggregate(F.slice("parts", F.lit(1), F.col("k")), F.lit(0), lambda s, x: s + F.length(x))
    span = F.col("end_s") - F.col("start_s")
    start = F.col("start_s") + before / F.col("total") * span + F.col("k") * gap
    last = F.col("k") == F.size("parts") - 1
    end = F.when(last, F.col("end_s")).otherwise(F.least(F.col("end_s"), start + F.length("text") / F.col("total") * span))
    raw = rows.select("recording_id", "id", "k", "text", start.alias("start_s"), F.greatest(end, start + 0.2).alias("end_s"))
    w = Window.partitionBy("recording_id").orderBy("start_s", "id", "k")
    length = F.least(F.greatest(F.col("end_s") - F.col("start_s"), F.lit(least), tx.reading_seconds(F.col("text"), rate)), F.lit(most))
    ceiling = F.lead("start_s").over(w) - gap
    end = F.when(F.col("start_s") + length > ceiling, F.greatest(F.col("start_s") + 0.2, ceiling)).otherwise(F.col("start_s") + length)
    out = raw.withColumn("n", F.row_number().over(w)).withColumn("end_s", end)
    return out.select("recording_id", "n", "id", "start_s", "end_s", tx.wrapped(F.col("text"), width, most_lines).alias("lines"))


def problems(cues: DataFrame, *, width: int = 42, most_lines: int = 2, least: float = 1.0, most: float = 7.0, rate: float = 17.0) -> DataFrame:
    """cues with what breaks the rules of reading: too_short, too_long, too_fast, line_overflow, too_many_lines, overlap."""
    seconds = F.col("end_s") - F.col("start_s")
    chars = tx.char_count(F.array_join("lines", " "))
    later = F.lead("start_s").over(Window.partitionBy("recording_id").orderBy("start_s", "id"))
    said = [
        F.when((seconds <= 0) | (seconds + 0.001 < least), "too_short"), F.when(seconds > most + 0.001, "too_long"), F.when((seconds > 0) & (chars / seconds > rate + 0.5), "too_fast"),
        F.when(F.exists("lines", lambda x: F.length(x) > width), "line_overflow"), F.when(F.size("lines") > most_lines, "too_many_lines"), F.when(F.col("end_s") > later, "overlap"),
    ]
    return cues.withColumn("problems", F.array_compact(F.array(*said)))


def _file(rows: DataFrame, body: Column) -> DataFrame:
    """(recording_id, cues, srt): one file for each recording and how many cues it has; a file holds one recording's cues, so its size is bounded by the recording's."""
    entry = F.concat(F.col("n").cast("string"), F.lit("\n"), tx.timestamp(F.col("start_s")), F.lit(" --> "), tx.timestamp(F.col("end_s")), F.lit("\n"), body, F.lit("\n"))
    parts = rows.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("n", entry.alias("entry")))).alias("xs"))
    return parts.select("recording_id", F.size("xs").cast("long").alias("cues"), F.array_join(F.transform("xs", lambda x: x["entry"]), "\n").alias("srt"))


def srt(rows: DataFrame, *, unnamed: str = "speaker_0") -> DataFrame:
    """(recording_id, srt): rows in id order as a subtitle file, with the speaker before the text unless it is the unnamed one."""
    numbered = rows.withColumn("n", F.row_number().over(Window.partitionBy("recording_id").orderBy("id")))
    return _file(numbered, F.concat(F.when(F.col("speaker") != unnamed, F.concat(F.lit("["), "speaker", F.lit("] "))).otherwise(F.lit("")), F.coalesce("text", F.lit("")))).drop("cues")


def cue_srt(cues: DataFrame) -> DataFrame:
    return _file(cues, F.array_join("lines", "\n")).drop("cues")


def parse_srt(files: DataFrame) -> DataFrame:
    """(recording_id, n, start_s, end_s, lines) of files (recording_id, srt). Blocks without a line of times, or without text, are left out."""
    blocks = files.select("recording_id", F.posexplode(F.split(F.regexp_replace("srt", "\r\n?", "\n"), "\n{2,}")).alias("pos", "block"))
    lines = blocks.withColumn("ls", F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")).withColumn("at", F.array_position(F.transform("ls", lambda x: x.contains("-->")), True))
    time = lambda k: F.regexp_extract(F.get("ls", (F.col("at") - 1).cast("int")), "(\\d+):(\\d+):(\\d+)[,.](\\d+)\\s*-->\\s*(\\d+):(\\d+):(\\d+)[,.](\\d+)", k)
    seconds = lambda k: time(k).cast("long") * 3600 + time(k + 1).cast("long") * 60 + time(k + 2).cast("long") + time(k + 3).cast("long") / 1000
    good = lines.where((F.size("ls") >= 2) & (F.col("at") > 0)).where(time(1) != "")
    out = good.select("recording_id", "pos", seconds(1).alias("start_s"), seconds(5).alias("end_s"), F.slice("ls", (F.col("at") + 1).cast("int"), F.size("ls")).alias("lines"))
    return out.withColumn("n", F.row_number().over(Window.partitionBy("recording_id").orderBy("pos"))).drop("pos")


def subtitle_files(rows: DataFrame, recordings: DataFrame, *, target: str = "ru", width: int | None = None, rate: float | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(files, warnings): a subtitle file of the original and of the translation for each recording that has the text.

    rows: (recording_id, id, start_s, end_s, text_src, text_tgt, shift_ms); recordings: (recording_id, input, lang). The
    original keeps its times and has the language of the recording; the translation goes with its voice, so it moves by
    shift_ms. Width of lines and reading rate are those of each language's profile unless given. files: (recording_id,
    kind, lang, name, cues, content), the content with a byte order mark, the name from the input's (of an address:
    subtitles). warnings: (recording_id, warning) of recordings that have rows but no translation.

    Languages that share their rules are planned together, so there are as many plans as kinds of rules, four.
    """
    told = rows.join(recordings.select("recording_id", F.lower(F.split("lang", "[-_]")[0]).alias("lang")), "recording_id")
    shift = F.coalesce(F.col("shift_ms"), F.lit(0)) / 1000
    source = told.select("recording_id", "id", "start_s", "end_s", F.col("text_src").alias("text"), F.lit("source").alias("kind"), "lang")
    moved = told.select("recording_id", "id", (F.col("start_s") + shift).alias("start_s"), (F.col("end_s") + shift).alias("end_s"), F.col("text_tgt").alias("text"), F.lit("target").alias("kind"), F.lit(target).alias("lang"))
    said = source.unionByName(moved).where("trim(coalesce(text, '')) <> ''")
    # A recording's two files are planned like two recordings.
    keyed = said.withColumn("recording_id", F.struct("recording_id", "kind", "lang"))
    rules: dict[tuple, list[str]] = {}
    for code, profile in fixed.LANGUAGES.items():
        rules.setdefault(profile[_WIDTH:], []).append(code)
    plans = None
    for (wide, fast, enders), codes in rules.items():
        own = F.col("lang").isin(codes)
        own = own | ~F.col("lang").isin(list(fixed.LANGUAGES)) | F.col("lang").isNull() if "en" in codes else own
        one = plan(keyed.where(own), width=width or wide, rate=rate or fast, enders=enders, **options)
        plans = one if plans is None else plans.unionByName(one)
    both = _file(plans, F.array_join("lines", "\n")).select("recording_id.*", "cues", F.concat(F.lit("﻿"), "srt").alias("content"))
    stem = F.regexp_replace(F.regexp_extract("input", "([^/\\\\]*)$", 1), "(?<=.)\\.[^.]*$", "")
    named = recordings.select("recording_id", F.when(F.col("input").rlike("(?i)^https?://"), F.lit("subtitles")).otherwise(stem).alias("stem"))
    files = both.join(named, "recording_id").select("recording_id", "kind", "lang", F.concat_ws(".", "stem", "lang", F.lit("srt")).alias("name"), "cues", "content")
    done = said.where("kind = 'target'").select("recording_id").distinct()
    warnings = rows.select("recording_id").distinct().join(done, "recording_id", "left_anti").select("recording_id", F.lit("not translated").alias("warning"))
    return files, warnings
