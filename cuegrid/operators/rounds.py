"""Loops in rounds over a shrinking set of rows: placement with shortening, review with refitting, the best of several attempts.

A round's rows go to a function from DataFrame to DataFrame, the model that stays outside; what it answers is kept in the
shared checkpoint folder, so that no round runs again when an executor is lost or a later round is planned.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.functions.numbers import fits_length, shorten_target_chars, target_chars, whole
from cuegrid.operators.changes import first_wins
from cuegrid.operators.sequence import plan_alignment, review_chunks
from cuegrid.operators.speech import review

KEY = ["recording_id", "id"]
Model = Callable[[DataFrame], DataFrame]


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; in local mode a new one where that is unset."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """df without its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shortened_placement(df: DataFrame, shorten: Model, *, rounds: int, rate: float, overhead: float = 0.0, most_tempo: float = 1.25, **placement) -> DataFrame:
    """The placement of df (recording_id, id, start_s, end_s, text, tts_duration) after texts that do not fit were shortened, with ``shortened`` (times of the row) and ``rounds`` (of its recording).

    ``shorten`` gets the rows that do not fit even at the greatest tempo, with ``target_chars``, and returns
    (recording_id, id, text, tts_duration) of those that it could shorten. A recording goes into another round only if
    a row of it was shortened, for at most so many rounds; all others keep the plan that they have, so an unchanged
    recording is planned once. Rows without a text are never sent. A row answered twice has its first answer by text.
    """
    names = [*df.columns, "shortened"]
    open_, done = df.withColumn("shortened", F.lit(0)), []
    for k in range(rounds + 1):
        plan = kept(plan_alignment(open_, most_tempo=most_tempo, **placement))
        asked = plan.where("needs_shorten AND trim(coalesce(text, '')) <> ''").withColumn("target_chars", shorten_target_chars(F.col("available"), rate, most_tempo, overhead))
        if k == rounds or asked.isEmpty():
            done.append(plan.withColumn("rounds", F.lit(k)))
            break
        told = shorten(asked).select(*KEY, "text", "tts_duration").join(asked.select(*KEY), KEY, "left_semi")
        answers = kept(told.groupBy(*KEY).agg(F.min(F.struct("text", "tts_duration")).alias("new")))
        moving = answers.select("recording_id").distinct()
        done.append(plan.join(moving, "recording_id", "left_anti").withColumn("rounds", F.lit(k)))
        if answers.isEmpty():
            break
        going = plan.select(*names).join(moving, "recording_id", "left_semi").join(answers, KEY, "left")
        new = going.withColumn("text", F.coalesce("new.text", "text")).withColumn("tts_duration", F.coalesce("new.tts_duration", "tts_duration"))
        open_ = new.withColumn("shortened", F.col("shortened") + F.col("new").isNotNull().cast("int")).select(*names)
    return _union(done)


def reviewed(df: DataFrame, reviewer: Model, refitter: Model, *, size: int, overlap: int, rounds: int, rate: float, overhead: float, **options) -> tuple[DataFrame, DataFrame]:
    """(texts, journal) of a review of df (recording_id, id, start_s, slot, text).

    ``reviewer`` gets the rows with a text in overlapping chunks and returns (recording_id, chunk, ord, id, new_text);
    where a row is judged in two chunks, the first judgement counts. What speech.review refuses because it fits worse goes
    to ``refitter`` with ``proposed``, ``most_chars`` and ``over``, which returns (recording_id, id, new_text). A
    recording's accepted changes and the new proposals are then judged together. Only rows refused in the last round are
    asked again, and a recording for which nothing comes back is settled. Answers for other rows count for nothing.

    texts: df with the new ``text`` and ``changed``. journal: (recording_id, id, round, before, after, verdict,
    miss_before, miss_after), an entry for each row and round in which it was judged; round 0 is the review itself.
    """
    judge = lambda rows, changes: kept(review(rows, changes, rate=rate, overhead=overhead, **options))
    lines = df.where("trim(coalesce(text, '')) <> ''")
    told = reviewer(review_chunks(lines, size=size, overlap=overlap)).join(lines.select(*KEY), KEY, "left_semi")
    first = first_wins(told.select(*KEY, "chunk", "ord", "new_text"), KEY, ["chunk", "ord"])
    outcome = judge(df, first.select(*KEY, F.lit(0).alias("ord"), "new_text"))
    journal, settled = [outcome.withColumn("round", F.lit(0))], []
    room = target_chars(F.col("slot"), rate, 0.0, overhead)
    for k in range(1, rounds + 1):
        refused = outcome.where("verdict = 'worse_fit'").join(df.drop("text"), KEY)
        asked = refused.withColumn("proposed", F.col("after")).withColumn("most_chars", room).withColumn("over", F.greatest(F.lit(0), F.length("after") - room))
        if asked.isEmpty():
            break
        answers = refitter(asked).select(*KEY, "new_text").join(asked.select(*KEY), KEY, "left_semi")
        answers = kept(answers.groupBy(*KEY).agg(F.min("new_text").alias("new_text")))
        moving = answers.select("recording_id").distinct()
        settled.append(outcome.join(moving, "recording_id", "left_anti"))
        if answers.isEmpty():
            outcome = outcome.limit(0)
            break
        held = outcome.where("verdict = 'applied'").join(moving, "recording_id", "left_semi").select(*KEY, F.col("after").alias("new_text"))
        merged = held.unionByName(answers.join(held.select(*KEY), KEY, "left_anti"))
        outcome = judge(df.join(moving, "recording_id", "left_semi"), merged.select(*KEY, F.lit(0).alias("ord"), "new_text"))
        journal.append(outcome.join(answers.select(*KEY), KEY, "left_semi").withColumn("round", F.lit(k)))
    taken = _union([*settled, outcome]).where("verdict = 'applied'").select(*KEY, F.col("after").alias("_new"))
    texts = df.join(taken, KEY, "left").withColumn("text", F.coalesce("_new", "text")).withColumn("changed", F.col("_new").isNotNull()).drop("_new")
    entries = _union(journal).select(*KEY, "round", "before", "after", "verdict", "miss_before", "miss_after")
    return texts, entries


def best_attempts(wanted: DataFrame, stored: DataFrame, attempt: Model, *, attempts: int, mark: float) -> tuple[DataFrame, DataFrame]:
    """(best, made): the clip of each wanted row (recording_id, id, key, seconds) and the clips that had to be made for it.

    ``key`` names all that a clip follows from. A stored clip (recording_id, id, key, got_seconds, score, clip) of the same
    key whose length fits is used again, and nothing is made for its row. All others go to ``attempt`` with the number of
    the attempt; it returns (recording_id, id, got_seconds, score, clip). A clip of another length counts for nothing;
    a row is tried again only while no clip of it reaches the mark, or has no score at all, and at most ``attempts``
    times; the clip of the greatest score stays, the earliest of equals. best: (recording_id, id, key, attempt, score,
    clip, sure), attempt 0 for stored ones and null where none fits.
    """
    fits = fits_length(F.col("got_seconds"), F.col("seconds"))
    again = wanted.join(stored, [*KEY, "key"]).where(fits).groupBy(*KEY, "key").agg(F.max(F.struct("score", "clip")).alias("b"))
    again = again.select(*KEY, "key", F.lit(0).alias("attempt"), "b.score", "b.clip")
    todo = open_ = kept(wanted.join(again.select(*KEY), KEY, "left_anti"))
    tries: list[DataFrame] = []
    for k in range(1, attempts + 1):
        got = attempt(open_.withColumn("attempt", F.lit(k))).select(*KEY, "got_seconds", "score", "clip")
        own = kept(open_.select(*KEY, "key", "seconds").join(got, KEY).where(fits).select(*KEY, "key", F.lit(k).alias("attempt"), "got_seconds", "score", "clip"))
        tries.append(own)
        open_ = kept(open_.join(own.where((F.col("score") >= mark) | F.col("score").isNull()).select(*KEY), KEY, "left_anti"))
        if k < attempts and open_.isEmpty():
            break
    every = _union(tries)
    order = F.struct(F.coalesce("score", F.lit(float("inf"))).alias("s"), (-F.col("attempt")).alias("a"))
    made = every.groupBy(*KEY, "key").agg(F.max_by(F.struct("attempt", "got_seconds", "score", "clip"), order).alias("b")).select(*KEY, "key", "b.*")
    new = todo.select(*KEY, "key").join(made.drop("got_seconds"), [*KEY, "key"], "left")
    best = again.unionByName(new).withColumn("sure", F.col("clip").isNotNull() & F.coalesce(F.col("score") >= mark, F.lit(True)))
    return best, made


def phrase_pauses(slot: Column, speech: Column, pauses: Column, rate: Column) -> Column:
    """(scale, silences) of phrases spoken one by one: pauses in samples, all shortened alike to what the slot leaves beside the speech. Null where less than 0.08 s of pauses would be left: then the text is spoken as a whole."""
    asked = F.aggregate(pauses, F.lit(0.0), lambda s, x: s + x)
    scale = F.when(asked > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), slot - speech) / asked)).otherwise(F.lit(0.0))
    spread = F.struct(scale.alias("scale"), F.transform(pauses, lambda x: whole(x * scale * rate).cast("long")).alias("silences"))
    return F.when(scale * asked >= 0.08, spread)


def joined_phrases(clips: DataFrame, plans: DataFrame) -> DataFrame:
    """(recording_id, id, rate, seconds, samples): the clips of a row's phrases (recording_id, id, part, rate, samples) one after another with the silences of phrase_pauses between them; rows that are spoken as a whole are left out.

    plans: (recording_id, id, slot, pauses). A row is one spoken line, so its clips fit in one task.
    """
    own = clips.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("part", "samples"))).alias("parts"), F.min_by("rate", "part").alias("rate"))
    total = F.aggregate("parts", F.lit(0).cast("long"), lambda s, p: s + F.size(p["samples"]))
    both = own.join(plans.select(*KEY, "slot", "pauses"), KEY).withColumn("p", phrase_pauses(F.col("slot"), total / F.col("rate"), F.col("pauses"), F.col("rate"))).where("p IS NOT NULL")
    silence = lambda i: F.array_repeat(F.lit(0.0).cast("float"), F.coalesce(F.get("p.silences", i), F.lit(0)).cast("int"))
    pieces = F.transform("parts", lambda p, i: F.concat(p["samples"], F.when(i < F.size("parts") - 1, silence(i)).otherwise(F.array().cast("array<float>"))))
    out = both.select(*KEY, "rate", F.flatten(pieces).alias("samples"))
    return out.select(*KEY, "rate", (F.size("samples") / F.col("rate")).alias("seconds"), "samples")
