"""Views of the driver's tables as timed transcripts, each with the same view in SQL.

The tables hold no transcripts: one hour of event time stands for one second, a conversation for a recording.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Microseconds of the events' first instant, 2024-01-01 UTC.
EPOCH_US = 1704067200000000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(df: DataFrame, col: str) -> Column:
    """Microseconds since 1970 of a timestamp with or without a time zone, whatever the session's zone is."""
    if dict(df.dtypes)[col] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {col})")
    return F.unix_micros(col)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A: (recording_id, id, start_s, end_s, speaker), a row for each event."""
    events = table(spark, sf_dir, "events")
    start = (micros(events, "ts") - F.lit(EPOCH_US)) / F.lit(3.6e9)
    return events.select(F.col("user_id").alias("recording_id"), F.col("event_id").alias("id"), start.alias("start_s"), (start + F.col("value") / 20).alias("end_s"), F.col("event_type").alias("speaker"))


SPANS = f"""spans AS (SELECT user_id AS recording_id, event_id AS id, (epoch_us(ts) - {EPOCH_US}) / 3.6e9 AS start_s,
  (epoch_us(ts) - {EPOCH_US}) / 3.6e9 + value / 20 AS end_s, event_type AS speaker FROM events)"""


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: the spans of two of the event types."""
    return spans(spark, sf_dir).where("speaker IN ('purchase', 'error')")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B: the other spans."""
    return spans(spark, sf_dir).where("speaker NOT IN ('purchase', 'error')")


SEGMENTS = f"{SPANS}, segments AS (SELECT * FROM spans WHERE speaker IN ('purchase', 'error')), turns AS (SELECT * FROM spans WHERE speaker NOT IN ('purchase', 'error'))"


def dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C: (recording_id, id, speaker, text, slot, start_s, end_s, tts_duration), a row for each turn of a conversation, laid out along a timeline."""
    from pyspark.sql import Window

    talk = table(spark, sf_dir, "conversations")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    slot = F.lit(0.51) + F.length("text") / F.lit(17.8)
    # Sums of lengths are whole numbers, so the start doesn't depend on the order of additions.
    start = 0.51 * F.coalesce(F.count("turn").over(before), F.lit(0)) + F.coalesce(F.sum(F.length("text")).over(before), F.lit(0)) / 17.8 + 0.45 * F.col("turn") + 4 * F.floor(F.col("turn") / 3)
    return talk.select(
        F.col("conv_id").alias("recording_id"), F.col("turn").alias("id"), F.col("role").alias("speaker"), "text", slot.alias("slot"), start.alias("start_s"), (start + slot).alias("end_s"),
        (slot * (F.lit(0.8) + F.lit(0.1) * (F.col("turn") % 6))).alias("tts_duration"),
    )


DIALOGUE = """dialogue0 AS (SELECT conv_id AS recording_id, turn AS id, role AS speaker, text, 0.51::DOUBLE + length(text) / 17.8::DOUBLE AS slot,
  0.51::DOUBLE * count(turn) OVER b + coalesce(sum(length(text)) OVER b, 0)::DOUBLE / 17.8::DOUBLE + 0.45::DOUBLE * turn + 4 * (turn // 3) AS start_s,
  (0.51::DOUBLE + length(text) / 17.8::DOUBLE) * (0.8::DOUBLE + 0.1::DOUBLE * (turn % 6)) AS tts_duration FROM conversations
  WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dialogue AS (SELECT *, start_s + slot AS end_s FROM dialogue0)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D: (recording_id, id, text, start_s, end_s), a row for each line of a document."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("recording_id"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    id_ = F.col("pos").cast("long") + 1
    return rows.select("recording_id", id_.alias("id"), "text", id_.cast("double").alias("start_s"), (id_ + F.lit(0.9) + F.lit(0.3) * (id_ % 3)).alias("end_s"))


LINES = """lines0 AS (SELECT doc_id AS recording_id, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT recording_id, i::BIGINT AS id, parts[i] AS text, i::DOUBLE AS start_s, i::DOUBLE + 0.9::DOUBLE + 0.3::DOUBLE * (i % 3) AS end_s
  FROM lines0, unnest(range(1, len(parts) + 1)) AS t(i))"""


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: reference rows."""
    return spans(spark, sf_dir).where("id % 7 <> 0")


def produced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E: the rows to judge: some spans are lost, the others moved, some cut in two."""
    a = spans(spark, sf_dir).where("id % 11 <> 0")
    s = F.col("start_s") + ((F.col("id") % 9) - 4) * F.lit(0.05)
    e = F.col("end_s") + ((F.col("id") % 5) - 2) * F.lit(0.08)
    mid = (F.col("start_s") + F.col("end_s")) / 2
    cut = F.col("id") % 13 == 0
    parts = F.when(cut, F.array(F.struct(F.lit(0).alias("k"), s.alias("s"), mid.alias("e")), F.struct(F.lit(1).alias("k"), mid.alias("s"), e.alias("e")))).otherwise(F.array(F.struct(F.lit(0).alias("k"), s.alias("s"), e.alias("e"))))
    rows = a.select("recording_id", "id", "speaker", F.explode(parts).alias("p"))
    return rows.select("recording_id", (F.col("id") * 10 + F.col("p.k")).alias("id"), F.col("p.s").alias("start_s"), F.col("p.e").alias("end_s"), "speaker").where("end_s > start_s")


GOLDEN = f"""{SPANS}, golden AS (SELECT * FROM spans WHERE id % 7 <> 0),
moved AS (SELECT *, start_s + ((id % 9) - 4) * 0.05::DOUBLE AS s, end_s + ((id % 5) - 2) * 0.08::DOUBLE AS e, (start_s + end_s) / 2 AS mid FROM spans WHERE id % 11 <> 0),
produced AS (SELECT * FROM (
  SELECT recording_id, id * 10 AS id, s AS start_s, CASE WHEN id % 13 = 0 THEN mid ELSE e END AS end_s, speaker FROM moved
  UNION ALL SELECT recording_id, id * 10 + 1, mid, e, speaker FROM moved WHERE id % 13 = 0) WHERE end_s > start_s)"""
