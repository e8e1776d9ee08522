"""Speech rate, length fit, review of texts, gender of voices, and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.numbers import bounded_target_chars, length_ratio, miss_by, places, shorten_target_chars, speech_seconds, target_chars, usable_rate, within_length


def length_stats(df: DataFrame, *, rate: float, tolerance: float, floor: float = 0.0, overhead: float = 0.0, room: str = "slot") -> DataFrame:
    """(recording_id, total, within, too_long, too_short, passed) over rows with a text."""
    seconds, slot = speech_seconds(F.length("text"), rate, overhead), F.col(room)
    fits, ratio = within_length(seconds, slot, tolerance, floor), length_ratio(seconds, slot)
    by = df.where("text IS NOT NULL").groupBy("recording_id").agg(F.count(F.lit(1)).alias("total"), F.count_if(fits).alias("within"), F.count_if(~fits & (ratio > 1)).alias("too_long"), F.count_if(~fits & (ratio <= 1)).alias("too_short"))
    return by.withColumn("passed", F.col("within") / F.col("total") >= 0.9)


def speech_rate(df: DataFrame, *, least_rows: int = 8) -> DataFrame:
    """(recording_id, rate, overhead): characters a second and seconds for each row, by least squares of seconds on characters; the plain average where the line makes no sense; null where nothing does. The sums combine before the shuffle."""
    x, y = F.length(F.trim("text")).cast("double"), F.col("tts_duration")
    usable = df.where("text IS NOT NULL AND text <> '' AND tts_duration > 0.2")
    s = usable.groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"))
    s = s.withColumn("den", F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    s = s.withColumn("slope", F.when(F.col("den") != 0, (F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.col("den")))
    s = s.withColumn("line", F.coalesce((F.col("slope") > 0) & (1 / F.col("slope")).between(5, 40), F.lit(False)))
    mean = F.col("sx") / F.col("sy")
    enough = F.col("n") >= least_rows
    rate = F.when(enough & F.col("line"), places(1 / F.col("slope"), 2)).when(enough & usable_rate(mean), places(mean, 2))
    overhead = F.when(enough & F.col("line"), places(F.greatest(F.lit(0.0), F.least(F.lit(2.0), (F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n"))), 3)).when(enough & usable_rate(mean), F.lit(0.0))
    return s.select("recording_id", "n", rate.alias("rate"), overhead.alias("overhead"))


def budgets(df: DataFrame, *, rate: float, overhead: float, tolerance: float, most_tempo: float, cap: float) -> DataFrame:
    """df with the characters that fit its slot: target, target within a cap on growth, least and most, and at the greatest tempo."""
    slot = F.col("slot")
    return df.select(
        "*", target_chars(slot, rate, 0.0, overhead).alias("target"), bounded_target_chars(F.length("text"), slot, rate, cap, overhead).alias("bounded"),
        target_chars(slot, rate, -tolerance, overhead).alias("least"), target_chars(slot, rate, tolerance, overhead).alias("most"), shorten_target_chars(slot, rate, most_tempo, overhead).alias("shortened"),
    )


def chars_outside(chars: Column, least: Column, most: Column) -> Column:
    return F.when(chars > most, chars - most).when(chars < least, chars - least).otherwise(F.lit(0))


def misfits(df: DataFrame, *, rate: float, overhead: float, tolerance: float, floor: float, cap: float) -> DataFrame:
    """Rows out of tolerance with what to do: shorten, or expand if the target is beyond what there is."""
    seconds = speech_seconds(F.length("text"), rate, overhead)
    target = bounded_target_chars(F.length("text"), F.col("slot"), rate, cap, overhead)
    out = df.where(~within_length(seconds, F.col("slot"), tolerance, floor)).withColumn("action", F.when(length_ratio(seconds, F.col("slot")) > 1, "shorten").otherwise("expand")).withColumn("target", target)
    return out.where((F.col("action") == "shorten") | (F.length("text") < F.col("target")))


def review(df: DataFrame, changes: DataFrame, *, rate: float, overhead: float, tolerance: float, floor: float, most_share: float, worse: float = 0.05, least_rows: int = 20) -> DataFrame:
    """Journal of proposed changes (recording_id, id, ord, new_text) to df (with slot and text): before, after, verdict, miss before and after.

    The first proposal for an id counts. A recording with at least so many texts drops all its changes if their share is too great.
    """
    first = Window.partitionBy("recording_id", "id").orderBy("ord")
    named = changes.withColumn("_rn", F.row_number().over(first)).where("_rn = 1").select("recording_id", "id", F.trim("new_text").alias("after"))
    both = named.join(df.select("recording_id", "id", "slot", F.trim(F.coalesce("text", F.lit(""))).alias("before"), F.lit(True).alias("known")), ["recording_id", "id"], "left")
    miss = lambda c: miss_by(speech_seconds(F.length(c), rate, overhead), F.col("slot"), tolerance, floor)
    both = both.withColumn("miss_before", miss(F.col("before"))).withColumn("miss_after", miss(F.col("after")))
    why = F.when(F.col("known").isNull(), "unknown_id").when(F.col("after") == "", "empty").when(F.col("after") == F.col("before"), "same").when((F.col("before") != "") & (F.col("miss_after") > F.col("miss_before") + worse), "worse_fit").otherwise("applied")
    judged = both.withColumn("why", why)
    texts = df.groupBy("recording_id").agg(F.count_if(F.trim(F.coalesce("text", F.lit(""))) != "").alias("translated"))
    done = judged.groupBy("recording_id").agg(F.count_if(F.col("why") == "applied").alias("applied"))
    guard = done.join(texts, "recording_id", "left").select("recording_id", F.coalesce((F.col("translated") >= least_rows) & (F.col("applied") > 0) & (F.col("applied") / F.col("translated") > most_share), F.lit(False)).alias("discarded"))
    out = judged.join(guard, "recording_id")
    return out.select(
        "recording_id", "id", F.coalesce("before", F.lit("")).alias("before"), "after", F.when(F.col("discarded"), "discarded").otherwise(F.col("why")).alias("verdict"),
        F.when(F.col("known").isNull(), 0.0).otherwise(places(F.col("miss_before"), 2)).alias("miss_before"), F.when(F.col("known").isNull() | (F.col("after") == ""), 0.0).otherwise(places(F.col("miss_after"), 2)).alias("miss_after"),
    )


def gender_of(f0: Column, voiced: Column, p25: Column, *, confident: float = 1.5) -> Column:
    """m, f or unknown from the median and lower quartile of the pitch, given enough voice; with little voice only far from the border."""
    unsure = f0.isNull() | p25.isNull() | (voiced < 0.6) | ((voiced < confident) & f0.between(120, 260))
    return F.when(F.coalesce(unsure, F.lit(True)), "unknown").when((p25 < 150) & (f0 < 275), "m").when((p25 >= 155) & (f0 > 175), "f").otherwise("unknown")


def profiles(samples: DataFrame, *, frame: float) -> DataFrame:
    """(recording_id, speaker, f0, p25, p75, voiced, gender) from pitch samples (hz): nearest-rank quantiles, which need no interpolation.

    The rank is found by counting equal pitches first, so a speaker with most samples is a small histogram.
    """
    counts = samples.groupBy("recording_id", "speaker", "hz").agg(F.count(F.lit(1)).alias("k"))
    group = Window.partitionBy("recording_id", "speaker")
    placed = counts.withColumn("n", F.sum("k").over(group)).withColumn("upto", F.sum("k").over(group.orderBy("hz")))
    at = lambda share: F.min(F.when(F.col("upto") > F.floor(F.col("n") * share), F.col("hz")))
    by = placed.groupBy("recording_id", "speaker").agg(at(0.5).alias("f0"), at(0.25).alias("p25"), at(0.75).alias("p75"), (F.max("n") * frame).alias("voiced"))
    return by.withColumn("gender", gender_of(F.col("f0"), F.col("voiced"), F.col("p25")))


def reference_candidates(df: DataFrame, turns: DataFrame, *, low: float, high: float, ideal: float = 5.0) -> DataFrame:
    """Rows fit to clone a voice from, with rank within recording and speaker: one speaker alone, no overlap, enough text, 1.5 to 10 s; good ones (3 to 8 s at a usual rate) first, then those nearest the ideal length."""
    from cuegrid.operators.intervals import alone
    from cuegrid.operators.sequence import overlap_flags

    seconds = F.col("end_s") - F.col("start_s")
    rate = F.length(F.trim("text")) / seconds
    fit = overlap_flags(df).where(~F.col("overlap") & (F.length(F.trim("text")) > 8) & seconds.between(1.5, 10))
    rows = alone(fit, turns).select("recording_id", "id", "speaker", "start_s", places(seconds, 2).alias("seconds"), places(rate, 1).alias("rate"), (seconds.between(3, 8) & rate.between(low, high)).alias("good"))
    best = Window.partitionBy("recording_id", "speaker").orderBy(F.desc("good"), F.abs(F.col("seconds") - ideal), "start_s", "id")
    return rows.withColumn("rank", F.row_number().over(best)).drop("start_s")


def picked_references(candidates: DataFrame, segments: DataFrame, choices: DataFrame) -> DataFrame:
    """(recording_id, speaker, id): of each speaker with candidates or a choice that can be met, the segment chosen if it is the speaker's own, else the best candidate; null if choices (recording_id, speaker, chosen) say ``off``."""
    key = ["recording_id", "speaker"]
    best = candidates.where("rank = 1").select(*key, F.col("id").alias("best"))
    own = choices.join(segments.select(*key, F.col("id").alias("own")), key).where(F.col("chosen") == F.col("own").cast("string")).select(*key, "own").distinct()
    rows = best.join(own, key, "full").join(choices, key, "left")
    return rows.select(*key, F.when(F.coalesce(F.col("chosen") != "off", F.lit(True)), F.coalesce("own", "best")).alias("id"))


def whole_cost(chars: Column, prompt_per_char: Column, completion_per_char: Column, prompt_price: Column, completion_price: Column) -> Column:
    """Cost of so many characters; null without prices or characters."""
    return F.when(chars > 0, chars * (prompt_per_char * prompt_price + completion_per_char * completion_price))


def effective_gender(pitch: Column, told: Column) -> Column:
    """What the pitch says, else what the words say."""
    return F.coalesce(F.nullif(pitch, F.lit("unknown")), F.nullif(told, F.lit("unknown")), F.lit("unknown"))


def disputed(pitch: Column, told: Column) -> Column:
    return (pitch != "unknown") & (told != "unknown") & (pitch != told)
