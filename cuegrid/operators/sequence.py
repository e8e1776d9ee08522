"""Windows and ordered folds over the rows of a recording.

A rule that only looks at neighbours is a window. A rule that carries state is a fold over short chains: a row whose
result cannot depend on the state before it begins a new chain, so a long recording is many independent folds.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.numbers import places, whole

BY = ["recording_id"]


def by_start(*more: str) -> Window:
    return Window.partitionBy(*BY).orderBy("start_s", *(more or ("id",)))


def so_far(w: Window) -> Window:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def folded(xs: str, kind: str, state: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]]) -> Column:
    """array<kind> with a result for each element of xs, which is not empty: step gets the state and an element and gives the next state and the result.

    Spark copies the whole of what ``aggregate`` carries at each step. So elements go through in blocks of about the root
    of their number: a block's results are carried within it, and those of finished blocks from block to block only.
    """
    size = F.greatest(F.lit(16), F.ceil(F.sqrt(F.size(xs)))).cast("int")
    none = F.expr(f"CAST(array() AS array<{kind}>)").alias("out")
    fields = lambda s: [s[n].alias(n) for n in state]

    def one(s: Column, x: Column) -> Column:
        after, result = step(s, x)
        return F.struct(*[c.alias(n) for n, c in after.items()], F.concat(s["out"], F.array(result)).alias("out"))

    def block(s: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(*fields(s), none), one)
        # A list of one names the finished block, which is then worked out once.
        return F.get(F.transform(F.array(done), lambda d: F.struct(*fields(d), F.concat(s["out"], d["out"]).alias("out"))), 0)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), lambda i: F.slice(xs, i * size + 1, size))
    return F.aggregate(blocks, F.struct(*[c.alias(n) for n, c in state.items()], none), block, lambda s: s["out"])


def islands(df: DataFrame, order: Window, broken: Column, name: str = "island") -> DataFrame:
    """df with the number of the run that each row is in; ``broken`` says that a row begins a new one."""
    return df.withColumn("_b", F.coalesce(broken, F.lit(True)).cast("int")).withColumn(name, F.sum("_b").over(so_far(order))).drop("_b")


def available_seconds(df: DataFrame, *, borrow: float = 1.2, gap: float = 0.05) -> DataFrame:
    """df with ``available``: the slot and what of the silence after it may be borrowed; the last row borrows all."""
    free = F.lead("start_s").over(by_start()) - gap - F.col("end_s")
    return df.withColumn("available", F.col("end_s") - F.col("start_s") + F.greatest(F.lit(0.0), F.least(F.coalesce(free, F.lit(borrow)), F.lit(borrow))))


def overlap_flags(df: DataFrame) -> DataFrame:
    """df with ``overlap``: whether the row overlaps its neighbour in time order."""
    w = by_start()
    before = F.col("start_s") < F.lag("end_s").over(w) - 1e-6
    after = F.lead("start_s").over(w) < F.col("end_s") - 1e-6
    return df.withColumn("overlap", F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False)))


def scene_batches(df: DataFrame, *, size: int, scene_gap: float = 3.0) -> DataFrame:
    """df with ``batch``, counted from 0 within the recording: a new one after a gap or when the last has so many rows."""
    w = by_start()
    scenes = islands(df, w, F.col("start_s") - F.lag("end_s").over(w) > scene_gap, "scene")
    nth = F.row_number().over(Window.partitionBy(*BY, "scene").orderBy("start_s", "id")) - 1
    cut = scenes.withColumn("_new", (nth % size == 0).cast("int"))
    return cut.withColumn("batch", (F.sum("_new").over(so_far(w)) - 1).cast("long")).drop("_new")


def collapse_repeats(df: DataFrame, text: Column) -> DataFrame:
    """df without the later rows of each run of equal texts in which rows overlap. Rows stand in id order."""
    w = Window.partitionBy(*BY).orderBy("id")
    keyed = islands(df.withColumn("_t", text), w, F.col("_t") != F.lag("_t").over(w), "_run")
    run = Window.partitionBy(*BY, "_run")
    overlaps = F.coalesce(F.col("start_s") < F.lag("end_s").over(run.orderBy("id")) - 0.01, F.lit(False))
    marked = keyed.withColumn("_o", overlaps).withColumn("_bad", F.bool_or("_o").over(run)).withColumn("_n", F.row_number().over(run.orderBy("id")))
    return marked.where("NOT _bad OR _n = 1").select(*df.columns)


def review_chunks(df: DataFrame, *, size: int, overlap: int) -> DataFrame:
    """(chunk, then df's columns): overlapping blocks of rows in time order, each begun ``size - overlap`` rows after the last, until the end is covered."""
    step = max(1, size - overlap)
    numbered = df.withColumn("_n", F.row_number().over(by_start()) - 1).withColumn("_of", F.count(F.lit(1)).over(Window.partitionBy(*BY)))
    last = F.greatest(F.lit(0), F.ceil((F.col("_of") - size) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("_n") - size + 1) / step))
    end = F.least(F.floor(F.col("_n") / step), last)
    return numbered.where(first <= end).select(F.explode(F.sequence(first.cast("long"), end.cast("long"))).alias("chunk"), *df.columns)


def context_before(df: DataFrame, *, rows: int, text: str = "text") -> DataFrame:
    """df with ``context``: the texts of so many rows before it, oldest first."""
    return df.withColumn("context", F.collect_list(text).over(by_start().rowsBetween(-rows, -1)))


def pitch_runs(df: DataFrame, *, jump: float = 0.2, least: int = 3) -> DataFrame:
    """Rows of (recording_id, id, pitch) in runs of at least so many frames without a relative jump; null pitches break runs."""
    w = Window.partitionBy(*BY).orderBy("id")
    last = F.lag("pitch").over(w)
    runs = islands(df, w, F.col("pitch").isNull() | last.isNull() | (F.abs(F.col("pitch") - last) / last > jump), "run").where("pitch IS NOT NULL")
    return runs.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*BY, "run"))).where(F.col("_n") >= least).drop("_n")


def plan_alignment(
    df: DataFrame, *, least_tempo: float = 0.9, most_tempo: float = 1.25, gap: float = 0.05, most_shift: float = 1.5, borrow: float = 0.0
) -> DataFrame:
    """Placement of each row's clip (tts_duration long) on the timeline.

    A clip that is longer than what is available is sped up within the tempo limits; it starts at its row's start or
    a gap after the clip before; a shift beyond the limit is capped, at the greatest tempo and cut to what is available.
    Adds aligned_start, shift_ms, tempo, effective, truncate_to, needs_shorten, available.

    The one state carried is where the clip before ends. That end is never later than its start plus the greatest shift
    plus its longest duration, so a row that starts a gap after that begins a chain of its own.
    """
    rows = available_seconds(df, borrow=borrow, gap=gap)
    slot = F.col("end_s") - F.col("start_s")
    rows = rows.withColumn("duration", F.coalesce("tts_duration", slot))
    long = (F.col("available") > 0) & (F.col("duration") > F.col("available"))
    tempo = F.when(long, F.least(F.greatest(F.col("duration") / F.col("available"), F.lit(least_tempo)), F.lit(most_tempo))).otherwise(F.lit(1.0))
    capped = F.when(long, F.lit(most_tempo)).otherwise(F.col("tempo1"))
    rows = rows.withColumn("tempo1", tempo).withColumn("effective1", F.col("duration") / F.col("tempo1")).withColumn("tempo2", capped)
    rows = rows.withColumn("raw2", F.col("duration") / F.col("tempo2")).withColumn("cut", F.when(F.col("raw2") > F.col("available"), F.col("available")))
    rows = rows.withColumn("effective2", F.coalesce("cut", "raw2"))
    w = by_start()
    latest = F.lag(F.col("start_s") + most_shift + F.greatest("effective1", "effective2")).over(w) + gap
    chained = islands(rows, w, F.col("start_s") >= latest, "chain")
    item = F.struct("start_s", "id", "effective1", "effective2", "cut")
    grouped = chained.groupBy(*BY, "chain").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        free = F.greatest(x["start_s"], F.coalesce(s["reached"] + gap, x["start_s"]))
        over = free - x["start_s"] > most_shift
        at = F.when(over, x["start_s"] + most_shift).otherwise(free)
        return {"reached": at + F.when(over, x["effective2"]).otherwise(x["effective1"])}, F.struct(x["id"].alias("id"), at.alias("at"), over.alias("capped"))

    places_ = folded("xs", "struct<id:bigint,at:double,capped:boolean>", {"reached": F.lit(None).cast("double")}, step)
    placed = grouped.select(*BY, F.explode(places_).alias("p")).select(*BY, "p.*")
    out = rows.join(placed, [*BY, "id"])
    effective = F.when(F.col("capped"), F.col("effective2")).otherwise(F.col("effective1"))
    shift = F.when(F.col("capped"), F.lit(most_shift)).otherwise(F.col("at") - F.col("start_s"))
    return out.select(
        *df.columns, places(F.col("at"), 3).alias("aligned_start"), whole(shift * 1000).cast("long").alias("shift_ms"), places(F.when(F.col("capped"), F.col("tempo2")).otherwise(F.col("tempo1")), 4).alias("tempo"),
        places(effective, 3).alias("effective"), F.when(F.col("capped"), F.col("cut")).alias("truncate_to"), (F.col("effective1") > F.col("available") + 1e-6).alias("needs_shorten"), places(F.col("available"), 3).alias("available"),
    )


def alignment_stats(plan: DataFrame, *, tolerance_ms: int = 250) -> DataFrame:
    """(recording_id, n, median_ms, max_ms, outside, speed_up, truncated) of a plan."""
    shift = F.abs("shift_ms")
    return plan.groupBy(*BY).agg(
        F.count(F.lit(1)).alias("n"), whole(F.median(shift)).cast("long").alias("median_ms"), F.max(shift).alias("max_ms"), F.count_if(shift > tolerance_ms).alias("outside"),
        F.count_if(F.col("tempo") > 1.001).alias("speed_up"), F.count_if(F.col("truncate_to").isNotNull()).alias("truncated"),
    )


def pull_continuations(df: DataFrame, *, gap: float = 0.05, most: float = 3.0, pause: float = 0.3, within: float = 0.6) -> DataFrame:
    """df (with shift_ms and aligned_duration) with new_shift_ms: a row that goes on with the phrase before moves earlier, up to ``most`` seconds, to end its silence.

    Only rows that continue a phrase read the state, so each phrase is a chain of its own.
    """
    w = by_start()
    told = F.trim(F.coalesce(F.lag("text").over(w), F.lit("")))
    goes_on = (F.lag("speaker").over(w) == F.col("speaker")) & (F.col("start_s") - F.lag("end_s").over(w) <= within) & (told != "") & ~told.rlike('[.!?…]["»”)\\]]*$')
    rows = df.where("aligned_duration > 0").withColumn("_goes", F.coalesce(goes_on, F.lit(False))).withColumn("_rest", F.greatest(F.lit(gap), F.least(F.col("start_s") - F.lag("end_s").over(w), F.lit(pause))))
    chained = islands(rows, w, ~F.col("_goes"), "chain")
    item = F.struct("start_s", "id", "shift_ms", "aligned_duration", "_rest")
    grouped = chained.groupBy(*BY, "chain").agg(F.array_sort(F.collect_list(item)).alias("xs"))

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        now = x["start_s"] + x["shift_ms"] / 1000
        wanted = F.greatest(x["start_s"] - most, s["reached"] + x["_rest"])
        shift = F.when(s["reached"].isNotNull() & (wanted < now - 0.05), F.floor((wanted - x["start_s"]) * 1000 + F.lit(0.5)).cast("bigint")).otherwise(x["shift_ms"])
        return {"reached": x["start_s"] + shift / 1000 + x["aligned_duration"]}, F.struct(x["id"].alias("id"), shift.alias("shift"))

    shifts = folded("xs", "struct<id:bigint,shift:bigint>", {"reached": F.lit(None).cast("double")}, step)
    moved = grouped.select(*BY, F.explode(shifts).alias("p")).select(*BY, F.col("p.id").alias("id"), F.col("p.shift").alias("new_shift_ms"))
    return df.join(moved, [*BY, "id"], "left").withColumn("new_shift_ms", F.coalesce("new_shift_ms", "shift_ms"))


def voice_track(clips: DataFrame, *, rate: int) -> DataFrame:
    """(recording_id, id, placed, collided): the sample at which each clip is written: its own, or where the clip before ends if that is later.

    The writer's cursor is a running maximum of (own sample minus the samples before), plus the samples before, so it is a
    window and no fold.
    """
    w = by_start()
    rows = clips.select(*BY, "id", "start_s", whole(F.col("start_s") * rate).alias("want"), F.greatest(F.lit(0), whole((F.col("end_s") - F.col("start_s")) * rate)).alias("n"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("placed", (F.max(F.col("want") - F.col("before")).over(so_far(w)) + F.col("before")).cast("long"))
    return rows.select(*BY, "id", "placed", (F.col("placed") > F.col("want")).alias("collided"))


def sentences(words: DataFrame, *, most_gap: float = 0.7, most_seconds: float = 15.0) -> DataFrame:
    """words (recording_id, id, word, start_s, end_s) with ``sentence``: a new one after a final mark, after a gap, or when the sentence would last too long.

    The first two cuts are islands. The last depends on where a sentence began, so it is a fold within each island.
    """
    w = Window.partitionBy(*BY).orderBy("id")
    final = F.lag("word").over(w).rlike('[.!?…]["»”)\\]]*$')
    cut = islands(words, w, final | (F.col("start_s") - F.lag("end_s").over(w) > most_gap), "_piece")
    grouped = cut.groupBy(*BY, "_piece").agg(F.array_sort(F.collect_list(F.struct("id", "start_s", "end_s"))).alias("xs"))

    def step(s: Column, x: Column) -> tuple[dict[str, Column], Column]:
        fresh = F.coalesce(x["end_s"] - s["begun"] > most_seconds, F.lit(True))
        k = s["k"] + fresh.cast("long")
        return {"begun": F.when(fresh, x["start_s"]).otherwise(s["begun"]), "k": k}, F.struct(x["id"].alias("id"), k.alias("k"))

    numbers = folded("xs", "struct<id:bigint,k:bigint>", {"begun": F.lit(None).cast("double"), "k": F.lit(0).cast("long")}, step)
    split = grouped.select(*BY, "_piece", F.explode(numbers).alias("p")).select(*BY, "_piece", "p.*")
    new = split.withColumn("_new", F.coalesce((F.col("k") != F.lag("k").over(w)) | (F.col("_piece") != F.lag("_piece").over(w)), F.lit(True)).cast("int"))
    numbered = new.select(*BY, "id", (F.sum("_new").over(so_far(w)) - 1).cast("long").alias("sentence"))
    return words.join(numbered, [*BY, "id"])


def speech_regions(frames: DataFrame, *, frame: float, silence: float = 0.15, least: float = 0.2, pad: float = 0.06, threshold: float = 0.5) -> DataFrame:
    """(recording_id, start_s, end_s) of speech in frames (recording_id, frame_id, p): opened by a loud frame, closed after so much silence, short ones dropped, the rest padded and joined.

    A region is a run of loud frames whose gaps are shorter than the silence.
    """
    from cuegrid.operators.intervals import union

    total = frames.groupBy(*BY).agg((F.max("frame_id") + 1).alias("frames"))
    w = Window.partitionBy(*BY).orderBy("frame_id")
    loud = frames.where(F.col("p") >= threshold)
    quiet = F.ceil(F.lit(silence / frame - 1e-9))
    runs = islands(loud, w, F.col("frame_id") - F.lag("frame_id").over(w) - 1 >= quiet, "run")
    runs = runs.groupBy(*BY, "run").agg(F.min("frame_id").alias("a"), F.max("frame_id").alias("z")).join(total, BY)
    tail = F.col("frames") - F.col("z") - 1 < quiet  # still open at the end
    end = F.when(tail, F.col("frames")).otherwise(F.col("z") + 1)
    real = runs.where((end - F.col("a")) * frame >= least - 1e-9)
    padded = real.select(*BY, F.greatest(F.lit(0.0), F.col("a") * frame - pad).alias("start_s"), F.least(F.col("frames") * frame, end * frame + pad).alias("end_s"))
    return union(padded, by=BY).drop("n")
