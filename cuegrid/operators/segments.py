"""Segments from recognised rows: split where they are long or the speaker changes, cleaned, numbered."""

from __future__ import annotations

import math
import uuid
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as tx
from cuegrid.functions.numbers import places
from cuegrid.operators import sequence
from cuegrid.operators.intervals import overlap_join, snap_to_speech, speaker_names, speaker_of
from cuegrid.operators.rounds import shared_folder
from cuegrid.operators.words import refined

#: Seconds: pauses at which a long row is cut, widest first.
PAUSES = (0.4, 0.3, 0.2, 0.15)
WORDS = "array<struct<word:string,start:double,end:double>>"
#: Elements of lists that are Python objects at one time.
HELD = 1 << 14


def slices(batch: pa.RecordBatch, lists: str) -> Iterator[list[dict]]:
    """A batch's rows, a few at a time: their lists have at most HELD elements together, or it is one row."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(lists)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + HELD, "right")))
        yield batch.slice(at, to - at).to_pylist()
        at = to


def _cut(words: list[dict], most: float) -> list[tuple[list[dict], bool]]:
    """Pieces of a row's words, each with whether it was cut by force: at the widest kind of pause there is, nearest the middle."""
    done, todo = [], [(words, False)]
    while todo:
        own, forced = todo.pop()
        if len(own) < 2 or own[-1]["end"] - own[0]["start"] <= most:
            done.append((own, forced))
            continue
        gaps = [own[i]["start"] - own[i - 1]["end"] for i in range(1, len(own))]
        at = next((min((abs(i + 1 - len(own) / 2), i + 1) for i, g in enumerate(gaps) if g > p)[1] for p in PAUSES if max(gaps) > p), None)
        force = at is None
        at = at or (len(own) + 1) // 2
        todo += [(own[at:], forced or force), (own[:at], forced or force)]
    return done


def _halved(start: float, end: float, words: list[str], most: float, forced: bool = False) -> list[tuple[float, float, list[str], bool]]:
    """Pieces of a row without word times: halves of its words and of its time, as long as there is something to halve."""
    if len(words) < 2 or end - start <= most:
        return [(start, end, words, forced)]
    middle, half = (start + end) / 2, len(words) // 2
    return _halved(start, middle, words[:half], most, True) + _halved(middle, end, words[half:], most, True)


def split_long(rows: DataFrame, *, most: float = 30.0) -> DataFrame:
    """rows (recording_id, id, speaker, words) as pieces of at most so many seconds: (recording_id, id, piece, speaker, start_s, end_s, text, words, forced).

    A row with fewer than two words that have finite times keeps its own start_s, end_s and text, null where rows have no
    such columns, and is halved by words and time as long as it is too long. No row is lost.
    """
    own = [c if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in (("start_s", "double"), ("end_s", "double"), ("text", "string"))]

    word = pa.struct([("word", pa.string()), ("start", pa.float64()), ("end", pa.float64())])
    schema = pa.schema([("recording_id", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("speaker", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("text", pa.string()), ("words", pa.list_(word)), ("forced", pa.bool_())])

    def pieces(r: dict) -> list[tuple]:
        words = [w for w in r["words"] or [] if w["start"] is not None and w["end"] is not None and math.isfinite(w["start"]) and math.isfinite(w["end"])]
        start, end, key = r["start_s"], r["end_s"], (r["recording_id"], r["id"])
        timed = start is not None and end is not None and not math.isnan(start) and not math.isnan(end)
        if len(words) > 1 or words and not timed:
            return [(*key, k, r["speaker"], part[0]["start"], part[-1]["end"], " ".join(w["word"] for w in part), part, forced) for k, (part, forced) in enumerate(_cut(words, most))]
        if timed and r["text"] is not None and math.isfinite(end - start):
            return [(*key, k, r["speaker"], a, z, " ".join(part), words, forced) for k, (a, z, part, forced) in enumerate(_halved(start, end, r["text"].split(), most))]
        return [(*key, 0, r["speaker"], start if timed else None, end if timed else None, r["text"], words, False)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (x for b in batches for x in slices(b, "words")):
            columns = zip(*(p for r in some for p in pieces(r)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    told = [F.col(c).cast(kind) for c, kind in (("recording_id", "long"), ("id", "long"), ("speaker", "string"), ("words", WORDS))]
    return rows.select(*told, *own).mapInArrow(run, f"recording_id long, id long, piece int, speaker string, start_s double, end_s double, text string, words {WORDS}, forced boolean")


def build(rows: DataFrame, *, least: float = 0.4) -> DataFrame:
    """Rows (recording_id, id, start_s, end_s, text) cleaned: loops trimmed, overlapping repeats and lines without speech dropped, numbered by time, with overlaps flagged."""
    finite = "abs({0}) < double('Infinity')"  # neither null, nor infinite, nor NaN, which is greater than all
    sound = rows.where(f"{finite.format('start_s')} AND {finite.format('end_s')} AND end_s > start_s").withColumn("text", tx.trim_loop(F.col("text")))
    once = sequence.collapse_repeats(sound, F.lower(tx.collapsed(F.col("text"))))
    kept = once.where(~tx.is_non_speech(F.col("text")) & ~tx.is_made_up(F.col("text")) & (F.col("end_s") - F.col("start_s") >= least))
    order = Window.partitionBy("recording_id").orderBy("start_s", "id")
    numbered = kept.withColumn("_id", (F.row_number().over(order) - 1).cast("long")).drop("id").withColumnRenamed("_id", "id")
    return sequence.overlap_flags(numbered.withColumn("start_s", places(F.col("start_s"), 3)).withColumn("end_s", places(F.col("end_s"), 3)))


def _merged(runs: list[list]) -> list[list]:
    """Runs [speaker, words] with those too short for a row of their own joined to the run before."""
    solid = lambda r: len(r[1]) >= 2 and r[1][-1][2] - r[1][0][1] >= 0.6
    out: list[list] = []
    for who, words in runs:
        if out and (not solid([who, words]) or not solid(out[-1]) or out[-1][0] == who):
            if not solid(out[-1]) and solid([who, words]):
                out[-1][0] = who
            out[-1][1] = out[-1][1] + words
        else:
            out.append([who, words])
    return out


def _heard(word: dict, turns: list[dict], starts: list[float], reached: list[float]) -> str | None:
    """The name of the speaker with the most time in common with a word, the first heard wins ties; else of the first turn that touches it. Turns are sorted by start; ``reached`` is how far those up to each reach."""
    a, z = word["start"], word["end"]
    if a is None or z is None or not math.isfinite(a) or not math.isfinite(z):
        return None
    met = [t for t in turns[bisect_left(reached, a) : bisect_right(starts, z)] if t["end"] >= a]
    total: dict[str | None, list] = {}
    for t in met:
        if (own := min(z, t["end"]) - max(a, t["start"])) > 0:
            held = total.setdefault(t["speaker"], [0.0, (t["start"], t["id"]), t["name"]])
            held[0] += own
    name = min(((-v[0], v[1], k or "", v[2]) for k, v in total.items()), default=(None,))[-1]
    return name if name is not None or not met else met[0]["name"]


def split_by_speaker(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """(recording_id, id, piece, speaker_name, start_s, end_s): rows (with words) cut where the speaker of their words changes and both parts are long enough; the outer edges stay.

    The turns that meet a row's words go to the row, so no word is a row of its own.
    """
    key = ["recording_id", "id"]
    whole = speaker_of(rows.select(*key, "start_s", "end_s"), turns)
    times = F.transform("words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end")))
    long = rows.where(F.size("words") >= 4).select(*key, times.alias("ws"))
    sound = F.filter("ws", lambda w: w["start"].isNotNull() & w["end"].isNotNull() & (F.abs(w["start"]) < float("inf")) & (F.abs(w["end"]) < float("inf")))
    span = long.select(*key, F.array_min(F.transform(sound, lambda w: w["start"])).alias("start_s"), F.array_max(F.transform(sound, lambda w: w["end"])).alias("end_s"))
    named = turns.select(*key, "start_s", "end_s", "speaker").join(speaker_names(turns), ["recording_id", "speaker"], "left")
    turn = F.struct(F.col("r_start_s").alias("start"), F.col("r_id").alias("id"), F.col("r_end_s").alias("end"), F.col("r_speaker").alias("speaker"), F.col("r_name").alias("name"))
    met = overlap_join(span, named, by=["recording_id"]).groupBy(*key).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    told = long.join(met, key, "left")

    schema = pa.schema([("recording_id", pa.int64()), ("id", pa.int64()), ("piece", pa.int32()), ("speaker_name", pa.string()), ("start_s", pa.float64()), ("end_s", pa.float64())])

    def parts(r: dict) -> list[tuple]:
        turns, runs = r["turns"] or [], []
        starts, reached = [t["start"] for t in turns], list(accumulate((t["end"] for t in turns), max))
        for k, w in enumerate(r["ws"] or []):
            who = _heard(w, turns, starts, reached) or r["speaker_name"]
            if not runs or runs[-1][0] != who:
                runs.append([who, []])
            runs[-1][1].append((k, w["start"], w["end"]))
        own = _merged(runs) if len(runs) > 1 else []
        if len(own) < 2:
            return [(r["recording_id"], r["id"], 0, r["speaker_name"], r["start_s"], r["end_s"])]
        last = len(own) - 1
        return [(r["recording_id"], r["id"], k, who, r["start_s"] if k == 0 else round(ws[0][1], 3), r["end_s"] if k == last else round(ws[-1][2], 3)) for k, (who, ws) in enumerate(own)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (x for b in batches for x in slices(b, "ws")):
            columns = zip(*(p for r in some for p in parts(r)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    both = whole.join(told, key, "left").select(F.col("recording_id").cast("long"), F.col("id").cast("long"), F.col("start_s").cast("double"), F.col("end_s").cast("double"), "speaker_name", "ws", "turns")
    return both.mapInArrow(run, "recording_id long, id long, piece int, speaker_name string, start_s double, end_s double")


FLAGS = "array<string>"


def built(rows: DataFrame, *, window: float = 0.4, least: float = 0.4, most: float = 30.0) -> DataFrame:
    """Segments from recognised rows (recording_id, id, speaker, start_s, end_s, text, words): (recording_id, id, source_id, piece, speaker, start_s, end_s, text, words, flags, overlap).

    Rows of no finite, positive length go. Edges move to the first and last word where these are within the window; rows
    over ``most`` seconds are split, and pieces cut by force flagged ``force_split``. Then loops are trimmed, repeats that
    overlap and lines without speech or under ``least`` seconds dropped, and what is left is numbered by time from 0.
    source_id and piece say which row a segment came from, so that what is known of a row finds its segments again. A row
    without a speaker has speaker_0.
    """
    finite = "abs({0}) < double('Infinity')"
    sound = words_of(rows).where(f"{finite.format('start_s')} AND {finite.format('end_s')} AND end_s > start_s")
    edged = refined(sound, window=window).withColumn("start_s", F.col("refined_start")).withColumn("end_s", F.col("refined_end")).drop("refined_start", "refined_end")
    names = ["recording_id", "id", "piece", "speaker", "start_s", "end_s", "text", "words", "forced"]
    short = edged.where(F.col("end_s") - F.col("start_s") <= most).withColumn("piece", F.lit(0)).withColumn("forced", F.lit(False)).select(*names)
    pieces = short.unionByName(split_long(edged.where(F.col("end_s") - F.col("start_s") > most), most=most).select(*names))
    order = Window.partitionBy("recording_id").orderBy("source_id", "piece")
    numbered = pieces.withColumnRenamed("id", "source_id").withColumn("id", F.row_number().over(order).cast("long"))
    done = build(numbered.withColumn("text", F.coalesce("text", F.lit(""))), least=least)
    flags = F.when(F.col("forced"), F.array(F.lit("force_split"))).otherwise(F.array().cast(FLAGS))
    return done.select("recording_id", "id", "source_id", "piece", F.coalesce("speaker", F.lit("speaker_0")).alias("speaker"), "start_s", "end_s", F.trim(tx.collapsed(F.col("text"))).alias("text"), "words", flags.alias("flags"), "overlap")


def words_of(rows: DataFrame) -> DataFrame:
    """rows with lists of words that are never null."""
    return rows.withColumn("words", F.coalesce("words", F.array().cast(WORDS)))


def with_speakers(segments: DataFrame, turns: DataFrame) -> DataFrame:
    """segments as ``built`` gives them with the speakers of turns (recording_id, id, start_s, end_s, speaker), split where the speaker of their words changes and numbered anew.

    ``before`` is the segment's number before. A piece has the words that begin in it and their text, and is flagged
    ``force_split``. Recordings without turns stay as they are. Segments are read twice, so they should be stored.

    Segments are numbered from 0 in each recording, so the pieces of all of a recording's segments meet it as one narrow
    list in their order, and the words go by recording only once.
    """
    told = segments.join(turns.select("recording_id").distinct(), "recording_id", "left_semi")
    cut = split_by_speaker(told.select("recording_id", "id", "start_s", "end_s", "words"), turns)
    own = cut.groupBy("recording_id", "id").agg(F.array_sort(F.collect_list(F.struct("piece", "start_s", "end_s", F.col("speaker_name").alias("speaker")))).alias("own"))
    listed = own.groupBy("recording_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", "own"))), lambda x: x["own"]).alias("_cuts"))
    stays = F.array(F.struct(F.lit(0).alias("piece"), "start_s", "end_s", "speaker"))
    met = segments.join(listed.hint("shuffle_merge"), "recording_id", "left")
    met = met.withColumn("_own", F.coalesce(F.get("_cuts", F.col("id").cast("int")), stays)).drop("_cuts", "start_s", "end_s", "speaker", "overlap")
    both = met.select("*", F.posexplode("_own").alias("part", "_now")).select("*", "_now.start_s", "_now.end_s", "_now.speaker", F.get("_own", F.col("part") + 1)["start_s"].alias("_to"))
    inside = F.filter("words", lambda w: ((F.col("part") == 0) | (F.round(w["start"], 3) >= F.col("start_s"))) & (F.col("_to").isNull() | (F.round(w["start"], 3) < F.col("_to"))))
    split = F.size("_own") > 1
    both = both.withColumn("words", F.when(split, inside).otherwise(F.col("words"))).withColumn("text", F.when(split, F.trim(tx.collapsed(F.array_join(F.transform("words", lambda w: w["word"]), " ")))).otherwise(F.col("text")))
    both = both.withColumn("flags", F.when(split, F.array_union("flags", F.array(F.lit("force_split")))).otherwise(F.col("flags")))
    order = Window.partitionBy("recording_id").orderBy("start_s", "before", "part")
    names = ["recording_id", "before", "part", "source_id", "piece", "speaker", "start_s", "end_s", "text", "words", "flags"]
    numbered = both.withColumnRenamed("id", "before").select(*names).withColumn("id", (F.row_number().over(order) - 1).cast("long"))
    return sequence.overlap_flags(numbered.drop("part"))


def stored(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession)}/segments-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def recognised(rows: DataFrame, regions: DataFrame, turns: DataFrame, doubts: DataFrame | None = None, *, snap: float = 0.4, window: float = 0.4, least: float = 0.4, most: float = 30.0) -> DataFrame:
    """From recognised rows to segments with speakers: edges to detected speech, built segments, speakers by turns, doubts flagged ``speaker_doubt``.

    doubts (recording_id, source_id) are recognised rows whose pitch disputes their speaker; every segment that came from
    such a row is flagged.
    """
    snapped = snap_to_speech(rows, regions, window=snap).withColumn("start_s", F.col("snapped_start")).withColumn("end_s", F.col("snapped_end")).drop("snapped_start", "snapped_end")
    out = with_speakers(stored(built(snapped, window=window, least=least, most=most)), turns)
    if doubts is None:
        return out
    # A recording's doubts are one narrow list, so that its segments stay where they are.
    listed = doubts.groupBy("recording_id").agg(F.collect_set("source_id").alias("_doubts"))
    marked = out.join(listed.hint("shuffle_merge"), "recording_id", "left")
    doubted = F.coalesce(F.array_contains("_doubts", F.col("source_id")), F.lit(False))
    return marked.withColumn("flags", F.when(doubted, F.array_union("flags", F.array(F.lit("speaker_doubt")))).otherwise(F.col("flags"))).select(*out.columns)
