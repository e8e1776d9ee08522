"""Folders of recordings: one folder each, with a JSON file for each kind of what is known about it.

Readers take the recordings wanted and give each of them a row: where a file is absent or no JSON, the kind's default.
Writers replace whole recordings and leave all others as they are.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.sources import readers

META = "struct<input:string,input_hash:string,duration_seconds:double,created_at:string,tool_version:string,has_video:boolean,stage_fingerprints:map<string,string>,source_path:string,source_title:string,output:string,subtitles:array<struct<lang:string,kind:string,path:string>>,translation_cost_usd:double>"
CUES = "array<struct<index:int,start:double,end:double,lines:array<string>,segmentId:int>>"
SPEAKERS = "map<string,struct<gender:string,f0:double,voicedSeconds:double,p25:double,p75:double,text:struct<gender:string,self:int,address:int,examples:array<string>>>>"
REVIEW = "struct<reviewed_at:string,engine:string,model:string,lines:int,applied:int,rejected:int,discarded:boolean,entries:array<struct<id:int,before:string,after:string,reason:string,verdict:string,miss_before:double,miss_after:double>>>"
#: Rows of one file.
PART_ROWS = 1_000_000
STATE = "struct<fingerprints:map<string,string>,segmentsHash:map<string,string>>"


def _texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(recording_id, json, changed) of the files of that name in folders right under root; empty where there are none."""
    found = spark.read.option("ignoreMissingFiles", True).option("pathGlobFilter", name).option("recursiveFileLookup", True).text(root, wholetext=True)
    # The path as the scan gives it is an URI.
    parts = F.split(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))), "/")
    top = root.rstrip("/").split("/")[-1]
    own = found.select(F.element_at(parts, -3).alias("top"), F.element_at(parts, -2).alias("recording_id"), F.col("value").alias("json"), F.col("_metadata.file_modification_time").alias("changed"))
    return own.where(F.col("top") == top).drop("top")


def _value(kind: str) -> Column:
    """A file's value; null if its text is no JSON, which from_json alone would read as a value of nulls."""
    return F.when(F.try_parse_json("json").isNotNull(), F.from_json("json", kind))


def _parsed(spark: SparkSession, root: str, name: str, recordings: DataFrame, kind: str, default: Column | None = None) -> DataFrame:
    """(recording_id, value) for each recording: its file's value, or the default where that is absent or broken."""
    read = _texts(spark, root, name).select("recording_id", _value(kind).alias("value"))
    out = recordings.select("recording_id").distinct().join(read, "recording_id", "left")
    return out if default is None else out.withColumn("value", F.coalesce("value", default))


def meta(spark: SparkSession, root: str, recordings: DataFrame) -> DataFrame:
    """(recording_id, value): what is known about the recording; null by default."""
    return _parsed(spark, root, "meta.json", recordings, META)


def cues(spark: SparkSession, root: str, recordings: DataFrame, role: str) -> DataFrame:
    """(recording_id, value): cues edited by hand for the role source or target; null where there are none."""
    return _parsed(spark, root, f"cues.{role}.json", recordings, CUES)


def speakers(spark: SparkSession, root: str, recordings: DataFrame) -> DataFrame:
    """(recording_id, value): profiles by speaker; an empty map by default."""
    return _parsed(spark, root, "speakers.json", recordings, SPEAKERS, F.expr(f"CAST(map() AS {SPEAKERS})"))


def review(spark: SparkSession, root: str, recordings: DataFrame) -> DataFrame:
    """(recording_id, value): the journal of the last review; null by default."""
    return _parsed(spark, root, "review.json", recordings, REVIEW)


def state(spark: SparkSession, root: str, recordings: DataFrame) -> DataFrame:
    """(recording_id, value): fingerprints of finished stages; empty maps by default. A file without one of the maps has an empty one."""
    empty = lambda c: F.coalesce(c, F.expr("CAST(map() AS map<string,string>)"))
    read = _parsed(spark, root, "state.json", recordings, STATE)
    return read.select("recording_id", F.struct(empty(F.col("value.fingerprints")).alias("fingerprints"), empty(F.col("value.segmentsHash")).alias("segmentsHash")).alias("value"))


def overrides(spark: SparkSession, root: str, recordings: DataFrame) -> DataFrame:
    """(recording_id, voices, names, refs): a person's edits, made tidy; empty maps by default."""
    read = _texts(spark, root, "overrides.json").select("recording_id", "json")
    return readers.overrides(recordings.select("recording_id").distinct().join(read, "recording_id", "left"))


def projects(spark: SparkSession, root: str, *, beside: tuple[str, ...] = ("tools", "models")) -> DataFrame:
    """(id, input, duration_seconds, has_video, created_at, updated_at, stages): recordings under root, the last changed first.

    A recording is a folder whose meta.json can be read; if it has a state.json, that must be readable too. ``stages`` are
    the names in the state's fingerprints, sorted. Folders named in ``beside`` hold no recordings. The time is that of
    the file itself, from the scan's own metadata.
    """
    told = _texts(spark, root, "meta.json").where(~F.col("recording_id").isin(*beside)).withColumn("m", _value(META)).where("m IS NOT NULL")
    done = _texts(spark, root, "state.json").select("recording_id", _value("struct<fingerprints:map<string,string>>").alias("s"), F.lit(True).alias("has_state"))
    both = told.join(done, "recording_id", "left").where("has_state IS NULL OR s IS NOT NULL")
    stages = F.coalesce(F.sort_array(F.map_keys("s.fingerprints")), F.array().cast("array<string>"))
    out = both.select(F.col("recording_id").alias("id"), "m.input", "m.duration_seconds", "m.has_video", "m.created_at", F.col("changed").alias("updated_at"), stages.alias("stages"))
    return out.orderBy(F.desc("updated_at"), "id")


def write_recordings(df: DataFrame, root: str, *, by: str = "recording_id") -> None:
    """Writes df as JSON lines under root, a folder ``recording_id=...`` for each recording that df holds, which it replaces as a whole; other recordings stay.

    Spark writes beside and moves the new folders in place when all tasks have ended, so a write that fails, for whatever
    reason, leaves what was there. Time goes by the number of files, so a recording is one file of at most PART_ROWS rows,
    and a longer one is as many files as it needs, in tasks of their own. Tasks move their own files to the place beside;
    the driver moves folders only.
    """
    # Rows are counted first; only recordings of more than one part are named again.
    parts = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > PART_ROWS).select(by, F.ceil(F.col("_n") / PART_ROWS).cast("int").alias("_parts"))
    nth = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.coalesce("_parts", F.lit(1)))
    spread = df.join(parts, by, "left").withColumn("_part", nth).repartition(F.col(by), F.col("_part")).drop("_parts", "_part")
    out = spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("mapreduce.fileoutputcommitter.algorithm.version", 2)
    out.option("maxRecordsPerFile", PART_ROWS).option("ignoreNullFields", False).partitionBy(by).json(root)


def read_recordings(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """What write_recordings wrote, with the given schema (which names recording_id)."""
    return spark.read.schema(schema).json(root)


def catalogue_snapshot(spark: SparkSession, at: str, fetch: Callable[[], str], *, most_age_s: float = 86_400, force: bool = False) -> DataFrame:
    """The model list that ``fetch`` gives as JSON text, as readers.catalogue reads it, with a snapshot of it in the folder ``at``.

    A snapshot younger than so many seconds is read in place of a call, unless ``force`` is set or it is no JSON. A call
    that raises, or whose answer is no JSON, raises and leaves the snapshot as it was; else the new one replaces it in one
    step. The text is one list of models and goes through the driver.
    """
    young = F.col("_metadata.file_modification_time") > F.current_timestamp() - F.make_dt_interval(secs=F.lit(float(most_age_s)))
    if not force:
        try:
            held = read_recordings(spark, at, "json string, name string").where(young & F.try_parse_json("json").isNotNull()).select("json").first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            held = None
        if held:
            return readers.catalogue(spark.createDataFrame([(held.json,)], "json string"))
    text = fetch()
    json.loads(text)
    new = spark.createDataFrame([("models", text)], "name string, json string")
    write_recordings(new, at, by="name")
    return readers.catalogue(new)
