"""Where a voice sample is cut: edges at pauses in a series of levels, and the sample chosen of each speaker."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from cuegrid.functions.numbers import places, whole

KEY = ["recording_id", "id"]
FRAMES = "array<struct<frame_id:bigint,level:double>>"
PLACES = StructType().add("to", LongType()).add("from", LongType()).add("quietest", LongType())
#: Frames that are looked at together.
HELD = 1 << 18


def _places(frames: pa.ListArray, marks: pa.StructArray) -> pa.StructArray:
    """(to, from, quietest) of each line: frame numbers by the rules of ``window_edges``. frames are lists of (frame_id, level) in order, marks what is asked of each line, in frames."""
    n = np.asarray(pc.list_value_length(frames).to_numpy(zero_copy_only=False), np.int64)
    flat = frames.flatten()
    i = flat.field("frame_id").to_numpy(zero_copy_only=False).astype(np.int64)
    known = flat.field("level").is_valid().to_numpy(zero_copy_only=False)
    level = pc.fill_null(flat.field("level"), 0.0).to_numpy(zero_copy_only=False)
    mark = {f.name: marks.field(f.name).to_numpy(zero_copy_only=False).astype(np.float64) for f in marks.type}
    end = np.cumsum(n)
    first, row, at = end - n, np.repeat(np.arange(len(n)), n), np.arange(len(i))
    inside = known & (i >= mark["a_s"][row]) & (i < mark["a_e"][row])
    order = np.flatnonzero(inside)
    order = order[np.lexsort((level[order], row[order]))]
    own = np.bincount(row[order], minlength=len(n))
    rank = np.cumsum(own) - own + np.floor(own * 0.9).astype(np.int64)
    told = own > 0
    speech = np.full(len(n), np.nan)
    speech[told] = level[order[rank[told]]]
    loud = known & ((level >= (speech - mark["quiet"])[row]) | np.isnan(level)) & told[row]
    # The nearest loud frame from each frame on, and the last one before each frame and before the window's end.
    after = np.minimum.accumulate(np.where(loud, at, len(at))[::-1])[::-1] if len(at) else at
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(loud, at, -1)))) if len(at) else np.array([-1])
    need = mark["need"][row]
    ends = told[row] & (i >= mark["e_from"][row]) & ((after >= end[row]) | (i[np.minimum(after, len(at) - 1)] - i >= need))
    starts = told[row] & (i <= mark["s_to"][row]) & ((before[:-1] < first[row]) | (i - 1 - i[before[:-1]] >= need))
    near = told[row] & (i >= mark["q_from"][row]) & (i <= mark["q_to"][row])

    def one(hit: np.ndarray, last: bool) -> np.ndarray:
        """The number of the first or last frame hit of each line, or -1."""
        rows, spot = np.unique(row[hit][::-1] if last else row[hit], return_index=True)
        out = np.full(len(n), -1, np.int64)
        out[rows] = (i[hit][::-1] if last else i[hit])[spot]
        return out

    to, frm = one(ends, False), one(starts, True)
    # A pause may end where the window does, a frame after the last one.
    past = np.full(len(n), -1, np.int64)
    full = told & (n > 0)
    past[full] = i[end[full] - 1] + 1
    free = before[end]
    clear = (free < first) | (past - 1 - (i[free] if len(i) else free) >= mark["need"])
    frm = np.where(full & (past <= mark["s_to"]) & clear, past, frm)
    spots = np.flatnonzero(near)
    spots = spots[np.lexsort((i[spots], level[spots], known[spots], row[spots]))]
    rows, spot = np.unique(row[spots], return_index=True)
    quietest = np.full(len(n), -1, np.int64)
    quietest[rows] = i[spots[spot]]
    whole = lambda x: pa.array(x, pa.int64(), mask=x < 0)
    return pa.StructArray.from_arrays([whole(to), whole(frm), whole(quietest)], ["to", "from", "quietest"])


@F.arrow_udf(PLACES)
def _found(frames: pa.Array, marks: pa.Array) -> pa.Array:
    """_places of some lines at a time, so that memory follows HELD frames or the longest window."""
    ends = np.cumsum(pc.list_value_length(frames).to_numpy(zero_copy_only=False).astype(np.int64))
    out, at = [], 0
    while at < len(frames):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + HELD, "right")))
        out.append(_places(frames.slice(at, to - at), marks.slice(at, to - at)))
        at = to
    return pa.concat_arrays(out) if out else pa.array([], pa.struct([(c, pa.int64()) for c in ("to", "from", "quietest")]))


def window_edges(lines: DataFrame, *, frame: float = 0.02, quiet_db: float = 18.0, pause: float = 0.15, least: float = 1.0) -> DataFrame:
    """(recording_id, id, cut_start, cut_end, clean) of lines (recording_id, id, window_start, start_s, end_s, previous_end, next_start, frames); null where no clean sample can be cut.

    frames are the (frame_id, level) of the line's window in order, levels in dB. A frame is quiet if it lies more than
    ``quiet_db`` below the 90th percentile within the line; frames outside of the window are quiet. The end is the first
    pause that begins just before the line's end or later, and must come before the next line. The start is the last
    pause that ends just after the line's start or earlier; where it would reach into the line before, the quietest
    frame near the start is taken instead and the cut is not ``clean``. Cuts under ``least`` seconds are none.

    A line's frames, a few hundred, stay in its row, so nothing is shuffled.
    """
    at = lambda s: whole((s - F.col("window_start")) / frame)
    frames = F.coalesce("frames", F.array().cast(FRAMES))
    rows = lines.withColumn("n", F.coalesce(F.element_at(F.when(F.size(frames) > 0, frames), -1)["frame_id"] + 1, F.lit(0)))
    low = F.greatest(F.lit(0), at(F.greatest(F.col("start_s") - 0.3, F.coalesce(F.col("previous_end") - 0.05, F.col("start_s") - 0.3))))
    high = F.least(F.col("n") - 1, at(F.col("start_s") + 0.1))
    marks = {
        "a_s": F.greatest(F.lit(0), at(F.col("start_s"))), "a_e": F.greatest(F.lit(0), at(F.col("end_s"))), "e_from": F.greatest(F.lit(0), at(F.col("end_s") - pause)), "s_to": F.least("n", at(F.col("start_s") + pause)),
        "q_from": low, "q_to": high, "quiet": F.lit(quiet_db), "need": F.lit(int(pause / frame + 0.5)),
    }
    # A line without times is asked for nothing.
    timed = (F.col("start_s") + F.col("end_s") + F.col("window_start")).isNotNull()
    asked = F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(name) for name, c in marks.items()])
    rows = rows.withColumn("_low", F.least(low, high)).withColumn("_c", _found(F.when(timed, frames).otherwise(F.array().cast(FRAMES)), asked))
    second = lambda f: F.col("window_start") + f * F.lit(frame)
    end, own = second(F.col("_c.to")), second(F.col("_c.from"))
    clean = F.col("_c.from").isNotNull() & F.coalesce(own >= F.col("previous_end") - 0.1, F.lit(True))
    start = F.when(clean, own).otherwise(second(F.coalesce("_c.quietest", "_low")))
    good = F.coalesce((end <= F.col("next_start") + 0.1) | F.col("next_start").isNull(), F.lit(False)) & F.coalesce(end - start >= least, F.lit(False))
    return rows.select(*KEY, F.when(good, places(F.greatest("window_start", start - 0.05), 3)).alias("cut_start"), F.when(good, places(end + 0.08, 3)).alias("cut_end"), F.when(good, clean).alias("clean"))


def reference_edges(levels: DataFrame, lines: DataFrame, **rules: float) -> DataFrame:
    """window_edges() of lines whose levels (recording_id, id, frame_id, level) are rows of their own: they meet once, as lists."""
    own = levels.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct(F.col("frame_id").cast("long").alias("frame_id"), F.col("level").cast("double").alias("level")))).alias("frames"))
    return window_edges(lines.join(own, KEY, "left"), **rules)


def chosen_references(candidates: DataFrame, cuts: DataFrame, choices: DataFrame) -> DataFrame:
    """(recording_id, speaker, id, cut_start, cut_end, clean): the sample of each speaker of candidates (recording_id, speaker, id, rank).

    The one named in choices (recording_id, speaker, id), measured or not; else the first by rank that is cut clean, else the
    first with any cut, else the first. cuts are those of reference_edges. One row of many is a grouped minimum.
    """
    who = ["recording_id", "speaker"]
    told = candidates.join(choices.select(*who, F.col("id").alias("wanted")), who, "left").join(cuts, KEY, "left")
    chosen = F.coalesce(F.col("id") == F.col("wanted"), F.lit(False))
    kind: Column = F.when(chosen, 0).when(F.col("clean"), 1).when(F.col("cut_start").isNotNull(), 2).otherwise(3)
    best = told.groupBy(*who).agg(F.min(F.struct(kind.alias("kind"), "rank", "id", "cut_start", "cut_end", "clean")).alias("b"))
    return best.select(*who, "b.id", "b.cut_start", "b.cut_end", "b.clean")
