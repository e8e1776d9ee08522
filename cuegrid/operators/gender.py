"""Gender of speakers as their words tell it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import agreement
from cuegrid.functions import text as tx
from cuegrid.operators.intervals import overlap_join

SELF, ADDRESS = "я", "ты"


def hits(rows: DataFrame) -> DataFrame:
    """(recording_id, id, speaker, pronoun, gender, fragment): what the words after a pronoun tell of its person."""
    each = [rows.select("recording_id", "id", "speaker", F.lit(p).alias("pronoun"), F.explode(tx.gender_hits(F.col("text"), p)).alias("h")) for p in (SELF, ADDRESS)]
    return each[0].unionByName(each[1]).select("recording_id", "id", "speaker", "pronoun", "h.*")


def addressees(rows: DataFrame, names: dict[str, str], *, scene: float = 8.0) -> DataFrame:
    """(recording_id, id, addressee): the first other speaker that the row calls by name, else the only other one who speaks near it, else null."""
    spark = rows.sparkSession
    called = rows.select("recording_id", "id", "speaker", F.posexplode(tx.vocatives(F.col("text"))).alias("j", "name"))
    known = spark.createDataFrame([(who, name.lower()) for who, name in names.items()], "who string, lower_name string")  # a recording's cast
    named = called.join(F.broadcast(known), F.lower("name") == F.col("lower_name")).where("who <> speaker").groupBy("recording_id", "id").agg(F.min(F.struct("j", "who")).alias("v"))
    keys = ["recording_id", "id", "start_s", "end_s", "speaker"]
    near = overlap_join(rows.select(*keys), rows.select(*[k for k in keys if k != "id"]), by=["recording_id"], reach=scene)
    strict = (F.col("r_end_s") > F.col("start_s") - scene) & (F.col("r_start_s") < F.col("end_s") + scene)
    others = near.where(strict & (F.col("r_speaker") != F.col("speaker"))).groupBy("recording_id", "id").agg(F.min("r_speaker").alias("a"), F.max("r_speaker").alias("z"))
    out = rows.select("recording_id", "id").join(named, ["recording_id", "id"], "left").join(others, ["recording_id", "id"], "left")
    return out.select("recording_id", "id", F.coalesce("v.who", F.when(F.col("a") == F.col("z"), F.col("a"))).alias("addressee"))


def by_text(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """(recording_id, speaker, gender, self, address, examples): a verdict needs two hits of one gender and none of the other."""
    found = hits(rows)
    own = found.where(F.col("pronoun") == SELF).withColumn("who", F.col("speaker"))
    other = found.where(F.col("pronoun") == ADDRESS).join(addressees(rows, names), ["recording_id", "id"]).withColumn("who", F.col("addressee")).drop("addressee").where("who IS NOT NULL")
    votes = own.unionByName(other)
    male, female = F.count_if(F.col("gender") == "m"), F.count_if(F.col("gender") == "f")
    verdict = F.when((male >= 2) & (female == 0), "m").when((female >= 2) & (male == 0), "f").otherwise("unknown")
    by = votes.groupBy("recording_id", F.col("who").alias("speaker")).agg(verdict.alias("verdict"), F.count_if(F.col("pronoun") == SELF).alias("self"), F.count_if(F.col("pronoun") == ADDRESS).alias("address"))
    return by.withColumnRenamed("verdict", "gender")


def agreed_with_voices(rows: DataFrame, genders: DataFrame, names: dict[str, str], *, scene: float = 8.0) -> DataFrame:
    """(recording_id, id, before, after, fixes, phrases) of rows (recording_id, id, start_s, end_s, speaker, text, phrases) whose words change.

    What a speaker says of themselves follows the gender (m or f) of their own voice in genders (recording_id, speaker,
    gender); what is said to another follows the voice of the one addressed, where the text tells anything of that
    person. The same replacements are replayed on the row's phrases. A speaker without a known gender changes nothing.
    """
    key = ["recording_id", "id"]
    voice = genders.where("gender IN ('m', 'f')").select("recording_id", F.col("speaker").alias("who"), "gender")
    to = addressees(rows, names, scene=scene)
    mine, theirs = voice.select("recording_id", F.col("who").alias("speaker"), F.col("gender").alias("own")), voice.select("recording_id", F.col("who").alias("addressee"), F.col("gender").alias("their"))
    told = rows.where("text <> ''").select(*key, "speaker", "text", "phrases").join(to, key).join(mine, ["recording_id", "speaker"], "left").join(theirs, ["recording_id", "addressee"], "left")
    first = told.withColumn("self", agreement.agree_with_fixes(F.col("text"), SELF, F.col("own")))
    said = F.when(F.size(tx.gender_hits(F.col("self.text"), ADDRESS)) > 0, F.col("their"))
    both = first.withColumn("other", agreement.agree_and_replay(F.col("self.text"), ADDRESS, said, F.col("self.fixes"), F.col("phrases"))).where(F.size("other.fixes") > 0)
    return both.select(*key, F.col("text").alias("before"), F.col("other.text").alias("after"), "other.fixes", "other.phrases")


def with_agreement(rows: DataFrame, log: DataFrame) -> DataFrame:
    """rows with the texts and phrases of agreed_with_voices, and ``agreed``: whether the row changed."""
    new = log.select("recording_id", "id", F.col("after").alias("_text"), F.col("phrases").alias("_phrases"))
    out = rows.join(new, ["recording_id", "id"], "left").withColumn("agreed", F.col("_text").isNotNull())
    return out.withColumn("text", F.coalesce("_text", "text")).withColumn("phrases", F.coalesce("_phrases", "phrases")).drop("_text", "_phrases")


def agreement_warnings(log: DataFrame) -> DataFrame:
    """(recording_id, changed, ids): how many rows of a recording were changed and which."""
    return log.groupBy("recording_id").agg(F.count(F.lit(1)).alias("changed"), F.array_sort(F.collect_list("id")).alias("ids"))
