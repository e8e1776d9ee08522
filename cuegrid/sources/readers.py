"""Readers of recognisers' output, catalogues, media descriptions, segment files and PCM audio."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.functions.text import is_non_speech

SEGMENT = "recording_id long, id int, start double, end double, speaker string, text_src string, text_tgt string, tts_file string, tts_duration double, overlap boolean, shift_ms int, flags array<string>, phrases array<string>, words array<struct<word:string,start:double,end:double>>"
#: Seconds: the longest word, and a word's length where nothing tells it.
MOST_WORD, SOME_WORD = 2.5, 0.3


def segments(spark: SparkSession, path: str) -> DataFrame:
    """Segment files, one array of objects each; a file that is no JSON gives no rows."""
    return spark.read.schema(SEGMENT).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("ignoreMissingFiles", True).load(root)


def folder_sizes(spark: SparkSession, root: str) -> DataFrame:
    """(folder, bytes) of each folder right under root, with all that lies below it; contents are not read, files that vanish count for nothing. Spark lists no empty files, so a folder of nothing else has no row."""
    below = F.substring_index(F.col("path"), root.rstrip("/") + "/", -1)
    return _files(spark, root).select(below.alias("below"), "length").where("below LIKE '%/%'").groupBy(F.substring_index("below", "/", 1).alias("folder")).agg(F.sum("length").alias("bytes"))


def file_hashes(spark: SparkSession, root: str) -> DataFrame:
    """(path, hash) of files by content, empty ones left out; Spark reads a file of at most 2 GB whole, so larger ones take ``fingerprints.input_hash``."""
    return _files(spark, root).select("path", F.sha2("content", 256).alias("hash"))


def _numbered(files: DataFrame, items: Column) -> DataFrame:
    """Items with their places; where a recording is in several files, ``first`` is the place of a file's first item."""
    rows = files.select("recording_id", *(["first"] if "first" in files.columns else []), F.posexplode(items).alias("pos", "x"))
    return rows.withColumn("pos", F.col("first") + F.col("pos")).drop("first") if "first" in files.columns else rows


def _spoken(words: DataFrame) -> DataFrame:
    """Words without groups in brackets, sounds, and words that end before they start."""
    bracket = Window.partitionBy("recording_id").orderBy("pos")
    inside = F.sum(F.col("word").rlike("^[\\[({]").cast("int") - F.lag(F.col("word").rlike("[\\])}]$").cast("int"), 1, 0).over(bracket)).over(bracket.rowsBetween(Window.unboundedPreceding, 0))
    return words.withColumn("_in", inside).where((F.col("_in") <= 0) & (F.col("word") != "") & ~is_non_speech(F.col("word")) & (F.col("end_s") >= F.col("start_s"))).drop("_in")


def stamped_words(files: DataFrame) -> DataFrame:
    """(recording_id, pos, word, start_s, end_s) of files (recording_id, json, and first if a recording is in several) with one word an item, offsets in ms and token stamps in hundredths.

    A word starts at its least stamp if it has any; it ends at its own end or the next word's stamp, whichever is first after its start.
    """
    kind = "struct<transcription:array<struct<text:string,offsets:struct<from:double,to:double>,tokens:array<struct<t_dtw:double>>>>>"
    rows = _numbered(files, F.from_json("json", kind)["transcription"])
    stamp = F.array_min(F.filter(F.transform("x.tokens", lambda t: t["t_dtw"]), lambda v: v >= 0)) / 100
    words = _spoken(rows.select("recording_id", "pos", F.trim("x.text").alias("word"), (F.col("x.offsets.from") / 1000).alias("start_s"), (F.col("x.offsets.to") / 1000).alias("end_s"), stamp.alias("stamp")))
    later = F.lead("stamp").over(Window.partitionBy("recording_id").orderBy("pos"))
    first = F.coalesce("stamp", "start_s")
    bound = F.least(F.when(F.col("end_s") > first, F.col("end_s")), F.when(later > first, later))
    end = F.when(F.col("stamp").isNull(), F.col("end_s")).otherwise(F.coalesce(bound, first + SOME_WORD))
    return words.select("recording_id", "pos", "word", first.alias("start_s"), F.least(end, first + MOST_WORD).alias("end_s"))


def plain_words(files: DataFrame) -> DataFrame:
    """(recording_id, pos, word, start_s, end_s) of files (recording_id, json, and first if a recording is in several) with words of start and end in seconds."""
    rows = _numbered(files, F.from_json("json", "struct<words:array<struct<word:string,start:double,end:double>>>")["words"])
    words = _spoken(rows.select("recording_id", "pos", F.trim("x.word").alias("word"), F.col("x.start").alias("start_s"), F.col("x.end").alias("end_s")).where("NOT isnan(start_s) AND NOT isnan(end_s)"))
    return words.withColumn("end_s", F.least("end_s", F.col("start_s") + MOST_WORD))


def cached_turns(files: DataFrame, fingerprint: Column) -> DataFrame:
    """Turns of files (recording_id, json) whose stored fingerprint is the one asked for; malformed ones are left out."""
    kept = files.withColumn("j", F.from_json("json", "struct<fingerprint:string,turns:array<struct<start:double,end:double,speaker:string>>>")).where(F.col("j.fingerprint") == fingerprint)
    return _numbered(kept, F.col("j.turns")).select("recording_id", "pos", "x.*").where("start IS NOT NULL AND end > start AND speaker IS NOT NULL")


def catalogue(files: DataFrame) -> DataFrame:
    """(id, name, context, prompt_price, completion_price, free) of model lists (json): those with an id that only give text."""
    kind = "array<struct<id:string,name:string,context_length:long,pricing:struct<prompt:string,completion:string>,architecture:struct<output_modalities:array<string>>>>"
    items = F.coalesce(F.from_json("json", f"struct<data:{kind}>")["data"], F.from_json("json", kind))
    rows = files.select(F.explode(items).alias("x"))
    out = F.col("x.architecture.output_modalities")
    text = out.isNull() | ((F.size(out) > 0) & F.forall(out, lambda m: m == "text"))
    price = lambda c: F.coalesce(F.expr(f"try_cast(x.pricing.{c} AS double)"), F.lit(0.0))
    good = rows.where((F.col("x.id") != "") & text).select("x.id", F.coalesce("x.name", "x.id").alias("name"), F.coalesce("x.context_length", F.lit(0)).alias("context"), price("prompt").alias("prompt_price"), price("completion").alias("completion_price"))
    return good.withColumn("free", (F.col("prompt_price") == 0) & (F.col("completion_price") == 0))


def listed_formats(formats: DataFrame) -> DataFrame:
    """(item, id, rank) of rows (item, id, height, bytes, vcodec, acodec) that have a codec of video or sound: the highest first, then the largest; null and ``none`` are no codec."""
    has = lambda c: F.coalesce(F.col(c), F.lit("none")) != "none"
    w = Window.partitionBy("item").orderBy(F.desc(F.coalesce("height", F.lit(0))), F.desc(F.coalesce("bytes", F.lit(0))), "id")
    return formats.where(has("vcodec") | has("acodec")).select("item", "id", F.row_number().over(w).alias("rank"))


def download_estimate(formats: DataFrame, limit: int | None) -> DataFrame:
    """(item, height, bytes) of rows (item, ord, height, bytes, has_video, has_audio): the highest video within the limit with the best audio, the last of equals; else the best with both."""
    rank = lambda c: F.max(F.when(c, F.struct(F.coalesce("height", F.lit(0)).alias("h"), "ord", "height", "bytes")))
    within = F.lit(True) if limit is None else F.coalesce("height", F.lit(0)) <= limit
    best = formats.groupBy("item").agg(rank(F.col("has_audio") & ~F.col("has_video")).alias("a"), rank(F.col("has_video") & ~F.col("has_audio") & within).alias("v"), rank(F.col("has_video") & F.col("has_audio")).alias("m"))
    return best.select("item", F.when(F.col("v").isNotNull(), F.col("v.height")).otherwise(F.col("m.height")).alias("height"), F.when(F.col("v").isNotNull(), F.col("v.bytes") + F.col("a.bytes")).otherwise(F.col("m.bytes")).alias("bytes"))


def media_info(probes: DataFrame) -> DataFrame:
    """(recording_id, duration, has_video, has_audio, channels, rate) of descriptions (recording_id, json); attached pictures are no video, the first audio stream counts."""
    kind = "struct<format:struct<duration:string>,streams:array<struct<codec_type:string,channels:int,sample_rate:string,disposition:struct<attached_pic:int>>>>"
    j = probes.withColumn("j", F.from_json("json", kind)).withColumn("a", F.get(F.filter("j.streams", lambda s: s["codec_type"] == "audio"), 0))
    video = F.exists("j.streams", lambda s: (s["codec_type"] == "video") & (F.coalesce(s["disposition"]["attached_pic"], F.lit(0)) != 1))
    return j.select("recording_id", F.coalesce(F.expr("try_cast(j.format.duration AS double)"), F.lit(0.0)).alias("duration"), video.alias("has_video"), F.col("a").isNotNull().alias("has_audio"), F.col("a.channels").alias("channels"), F.expr("try_cast(a.sample_rate AS int)").alias("rate"))


def overrides(files: DataFrame) -> DataFrame:
    """(recording_id, voices, names, refs) of edits (recording_id, json): trimmed texts that are not empty, names of at most 60 characters, references as a number or off."""
    j = files.withColumn("j", F.from_json("json", "struct<voices:map<string,string>,names:map<string,string>,refs:map<string,string>>"))
    tidy = lambda c: F.map_filter(F.transform_values(F.coalesce(c, F.expr("CAST(map() AS map<string,string>)")), lambda _, v: F.trim(v)), lambda _, v: F.coalesce(v != "", F.lit(False)))
    names = F.transform_values(tidy(F.col("j.names")), lambda _, v: F.substring(F.regexp_replace(v, "[ \\t\\n\\x0B\\f\\r]+", " "), 1, 60))
    refs = F.map_filter(tidy(F.col("j.refs")), lambda _, v: (v == "off") | v.rlike("^[0-9]+$"))
    return j.select("recording_id", tidy(F.col("j.voices")).alias("voices"), names.alias("names"), F.transform_values(refs, lambda _, v: F.struct(F.when(v != "off", v.cast("int")).alias("id"), (v == "off").alias("off"))).alias("refs"))


def _wav(data: bytes) -> tuple[int, int, int, int, int] | None:
    """(channels, rate, bits, offset, length) of a RIFF file; chunks of odd length are padded."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        return None
    at, shape = 12, None
    while at + 8 <= len(data):
        name, n = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"fmt " and n >= 16:
            _, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            shape = (channels, rate, bits)
        elif name == b"data":
            return (*shape, at + 8, min(n, len(data) - at - 8)) if shape else None
        at += 8 + n + n % 2
    return None


def audio(files: DataFrame) -> DataFrame:
    """(path, channels, rate, seconds, samples) of 16-bit files (path, content) as binaryFile gives them: the mean of the channels within -1 and 1. A file of another kind has nulls."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                shape = _wav(bytes(content))
                if shape is None or shape[2] != 16 or not shape[0]:
                    rows.append((path, None, None, None, None))
                    continue
                channels, rate, _, offset, n = shape
                frames = np.frombuffer(content, "<i2", n // 2 // channels * channels, offset).reshape(-1, channels)
                rows.append((path, channels, rate, len(frames) / rate, (frames.mean(axis=1) / 32768).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "channels", "rate", "seconds", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, channels int, rate int, seconds double, samples array<float>")


def wav_bytes(samples: np.ndarray, rate: int) -> bytes:
    """A mono 16-bit file; samples beyond 1 are clipped."""
    body = np.clip(np.floor(np.asarray(samples) * 32767 + 0.5), -32768, 32767).astype("<i2").tobytes()
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(body)) + body


_FORMATS = "array<struct<height:int,filesize:bigint,filesize_approx:bigint,vcodec:string,acodec:string>>"
_ENTRY = "struct<id:string,webpage_url:string,url:string,title:string,duration:double>"
_INFO = f"struct<_type:string,id:string,webpage_url:string,title:string,uploader:string,channel:string,duration:double,thumbnail:string,thumbnails:array<struct<url:string>>,is_live:boolean,formats:{_FORMATS},entries:array<{_ENTRY}>>"


def web_media(infos: DataFrame, limit: int | None = 1080, *, untitled: str = "(untitled)", playlist: str = "Playlist") -> DataFrame:
    """(item, id, url, title, uploader, seconds, thumbnail, is_live, is_playlist, entries, height, bytes) of descriptions (item, url, json) of what an address holds.

    A playlist has its entries (id, url, title, seconds), the sum of their seconds if that is more than none, and neither
    height nor bytes; anything else has those that download_estimate gives for videos of at most ``limit`` lines (None:
    any). A text that is no JSON object gives a row of nulls and defaults. item tells rows apart.
    """
    read = infos.select("item", F.col("url").alias("asked"), F.from_json("json", _INFO).alias("j"))
    has = lambda c: F.coalesce(c, F.lit("none")) != "none"
    formats = read.select("item", F.posexplode("j.formats").alias("ord", "f")).select("item", "ord", "f.height", F.coalesce("f.filesize", "f.filesize_approx").alias("bytes"), has(F.col("f.vcodec")).alias("has_video"), has(F.col("f.acodec")).alias("has_audio"))
    sizes = download_estimate(formats, limit).withColumnRenamed("height", "h").withColumnRenamed("bytes", "b")
    many = F.coalesce(F.col("j._type") == "playlist", F.lit(False))
    entries = F.transform(F.coalesce("j.entries", F.array().cast(f"array<{_ENTRY}>")), lambda e: F.struct(F.coalesce(e["id"], F.lit("")).alias("id"), F.coalesce(e["webpage_url"], e["url"], F.lit("")).alias("url"), F.coalesce(e["title"], F.lit(untitled)).alias("title"), e["duration"].alias("seconds")))
    total = F.aggregate(entries, F.lit(0.0), lambda s, e: s + F.coalesce(e["seconds"], F.lit(0.0)))
    one = lambda c: F.when(~many, c)
    return read.join(sizes, "item", "left").select(
        "item", F.coalesce("j.id", F.lit("")).alias("id"), F.when(many, F.col("asked")).otherwise(F.coalesce("j.webpage_url", "asked")).alias("url"), F.coalesce("j.title", F.when(many, playlist).otherwise(untitled)).alias("title"), F.coalesce("j.uploader", "j.channel").alias("uploader"),
        F.when(many, F.when(total > 0, total)).otherwise(F.col("j.duration")).alias("seconds"), F.coalesce("j.thumbnail", F.get("j.thumbnails", 0)["url"]).alias("thumbnail"), (~many & F.coalesce("j.is_live", F.lit(False))).alias("is_live"), many.alias("is_playlist"),
        F.when(many, entries).otherwise(F.slice(entries, 1, 0)).alias("entries"), one(F.col("h")).alias("height"), one(F.col("b")).alias("bytes"),
    )
