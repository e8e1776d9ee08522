"""Queries over spans, segments and turns: windows, interval joins, placement, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions.numbers import places, whole
from cuegrid.operators import intervals, sequence
from cuegrid.plans.registry import Registry
from cuegrid.sources import adapters as a

register = Registry()


def r3(c: str):
    return places(F.col(c), 3).alias(c)


@register("prj01_slot", f"WITH {a.SPANS} SELECT recording_id, id, floor((end_s - start_s) * 1000 + 0.5) / 1000 AS slot FROM spans")
def slot(spark, d):
    return a.spans(spark, d).select("recording_id", "id", places(F.col("end_s") - F.col("start_s"), 3).alias("slot"))


@register("agg01_segments_summary", f"""WITH {a.SPANS}, n AS (SELECT *, lag(end_s) OVER w AS p, lead(start_s) OVER w AS q FROM spans WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id))
SELECT recording_id, count(*) AS n, floor(sum(floor((end_s - start_s) * 1000 + 0.5)) / 10 + 0.5) / 100 AS seconds, array_to_string(list_sort(list(DISTINCT speaker)), ',') AS speakers,
  count(*) FILTER (coalesce(start_s < p - 1e-6, false) OR coalesce(q < end_s - 1e-6, false)) AS overlaps FROM n GROUP BY 1""")
def segments_summary(spark, d):
    ms = whole((F.col("end_s") - F.col("start_s")) * 1000)
    return sequence.overlap_flags(a.spans(spark, d)).groupBy("recording_id").agg(F.count(F.lit(1)).alias("n"), (F.floor(F.sum(ms) / 10 + 0.5) / 100).alias("seconds"), F.array_join(F.array_sort(F.collect_set("speaker")), ",").alias("speakers"), F.count_if("overlap").alias("overlaps"))


@register("win01_available_seconds", f"""WITH {a.SPANS}, n AS (SELECT *, lead(start_s) OVER (PARTITION BY recording_id ORDER BY start_s, id) AS q FROM spans)
SELECT recording_id, id, floor((end_s - start_s + greatest(0, least(coalesce(q - 0.05 - end_s, 1.2), 1.2))) * 1000 + 0.5) / 1000 AS available FROM n""")
def available_seconds(spark, d):
    return sequence.available_seconds(a.spans(spark, d)).select("recording_id", "id", r3("available"))


@register("win03_overlap_flags", f"""WITH {a.SPANS} SELECT recording_id, id, coalesce(start_s < lag(end_s) OVER w - 1e-6, false) OR coalesce(lead(start_s) OVER w < end_s - 1e-6, false) AS overlap
FROM spans WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id)""")
def overlap_flags(spark, d):
    return sequence.overlap_flags(a.spans(spark, d)).select("recording_id", "id", "overlap")


@register("win04_repeat_collapse", f"""WITH {a.LINES}, t AS (SELECT *, lower(trim(text)) AS k FROM lines),
m AS (SELECT *, CASE WHEN k = lag(k) OVER w THEN 0 ELSE 1 END AS b FROM t WINDOW w AS (PARTITION BY recording_id ORDER BY id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY id) AS run FROM m),
o AS (SELECT *, coalesce(start_s < lag(end_s) OVER (PARTITION BY recording_id, run ORDER BY id) - 0.01, false) AS o, row_number() OVER (PARTITION BY recording_id, run ORDER BY id) AS n FROM r),
f AS (SELECT *, bool_or(o) OVER (PARTITION BY recording_id, run) AS bad FROM o)
SELECT recording_id, id, text FROM f WHERE NOT bad OR n = 1""")
def repeat_collapse(spark, d):
    return sequence.collapse_repeats(a.lines(spark, d), F.lower(F.trim("text"))).select("recording_id", "id", "text")


@register("win07_scene_batches", f"""WITH {a.SPANS}, n AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w > 3 OR lag(end_s) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM spans WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY start_s, id ROWS UNBOUNDED PRECEDING) AS scene FROM n),
p AS (SELECT *, (row_number() OVER (PARTITION BY recording_id, scene ORDER BY start_s, id) - 1) // 5 AS part FROM s)
SELECT recording_id, id, dense_rank() OVER (PARTITION BY recording_id ORDER BY scene, part) - 1 AS batch FROM p""")
def scene_batches(spark, d):
    return sequence.scene_batches(a.spans(spark, d), size=5).select("recording_id", "id", "batch")


def _union_sql(broken: str) -> str:
    return f"""WITH {a.SPANS}, m AS (SELECT *, max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM spans),
i AS (SELECT *, sum(CASE WHEN reached IS NULL OR {broken} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT recording_id, floor(min(start_s) * 1000 + 0.5) / 1000 AS start_s, floor(max(end_s) * 1000 + 0.5) / 1000 AS end_s, count(*) AS n FROM i GROUP BY recording_id, island"""


@register("win10_interval_union", _union_sql("start_s - reached > 0"))
def interval_union(spark, d):
    return intervals.union(a.spans(spark, d), by=["recording_id"]).select("recording_id", r3("start_s"), r3("end_s"), "n")


@register("win11_close_windows", _union_sql("start_s - reached >= 0.5"))
def close_windows(spark, d):
    return intervals.union(a.spans(spark, d), by=["recording_id"], tolerance=0.5, strict=True).select("recording_id", r3("start_s"), r3("end_s"), "n")


_NAMES = """names AS (SELECT recording_id, speaker, 'speaker_' || (row_number() OVER (PARTITION BY recording_id ORDER BY s, i) - 1) AS name
  FROM (SELECT recording_id, speaker, min(start_s) AS s, arg_min(id, (start_s, id)) AS i FROM turns GROUP BY 1, 2))"""


@register("win12_speaker_names", f"WITH {a.SEGMENTS}, {_NAMES} SELECT * FROM names")
def speaker_names(spark, d):
    return intervals.speaker_names(a.turns(spark, d))


_SPEAKER = f"""WITH {a.SEGMENTS}, {_NAMES},
pairs AS (SELECT s.recording_id, s.id, t.speaker, t.start_s AS ts, t.id AS tid, greatest(least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s), 0) AS shared,
  greatest(greatest(s.start_s, t.start_s) - least(s.end_s, t.end_s), 0) AS gap FROM segments s JOIN turns t ON s.recording_id = t.recording_id AND t.start_s <= s.end_s + 1 AND t.end_s >= s.start_s - 1),
total AS (SELECT recording_id, id, speaker, sum(shared) AS total, min(ts) FILTER (shared > 0) AS fs FROM pairs GROUP BY 1, 2, 3),
most AS (SELECT *, row_number() OVER (PARTITION BY recording_id, id ORDER BY total DESC, fs) AS rn FROM total WHERE total > 0),
nearest AS (SELECT *, row_number() OVER (PARTITION BY recording_id, id ORDER BY gap, ts, tid) AS rn FROM pairs),
chosen AS (SELECT s.*, coalesce(m.speaker, n.speaker) AS who FROM segments s LEFT JOIN most m ON m.recording_id = s.recording_id AND m.id = s.id AND m.rn = 1
  LEFT JOIN nearest n ON n.recording_id = s.recording_id AND n.id = s.id AND n.rn = 1),
named AS (SELECT c.recording_id, c.id, c.start_s, coalesce(n.name, 'speaker_0') AS speaker_name FROM chosen c LEFT JOIN names n ON n.recording_id = c.recording_id AND n.speaker = c.who)
"""


@register("jon01_speaker_by_overlap", _SPEAKER + "SELECT recording_id, id, speaker_name FROM named")
def speaker_by_overlap(spark, d):
    return intervals.speaker_of(a.segments(spark, d), a.turns(spark, d)).select("recording_id", "id", "speaker_name")


@register("jon02_assign_speakers", _SPEAKER + "SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, id) - 1 AS id, id AS old_id, speaker_name FROM named")
def assign_speakers(spark, d):
    named = intervals.speaker_of(a.segments(spark, d), a.turns(spark, d))
    return named.select("recording_id", (F.row_number().over(sequence.by_start()) - 1).cast("long").alias("id"), F.col("id").alias("old_id"), "speaker_name")


@register("jon04_snap_to_speech", f"""WITH {a.SEGMENTS}, p AS (SELECT s.recording_id, s.id, t.start_s AS rs, t.end_s AS re, least(s.end_s, t.end_s) - greatest(s.start_s, t.start_s) AS shared
  FROM segments s JOIN turns t ON s.recording_id = t.recording_id AND t.start_s <= s.end_s AND t.end_s >= s.start_s),
e AS (SELECT recording_id, id, arg_min(rs, (rs, re)) AS first, arg_max(re, (rs, re)) AS last FROM p WHERE shared > 0 AND (shared >= 0.15 OR shared >= (re - rs) * 0.5) GROUP BY 1, 2),
x AS (SELECT s.*, e.first, CASE WHEN abs(first - start_s) <= 0.5 THEN first ELSE start_s END AS a, CASE WHEN abs(last - end_s) <= 0.5 THEN last WHEN last < end_s THEN last ELSE end_s END AS z
  FROM segments s LEFT JOIN e USING (recording_id, id))
SELECT recording_id, id, floor(CASE WHEN first IS NOT NULL AND z > a THEN a ELSE start_s END * 1000 + 0.5) / 1000 AS snapped_start, floor(CASE WHEN first IS NOT NULL AND z > a THEN z ELSE end_s END * 1000 + 0.5) / 1000 AS snapped_end FROM x""")
def snap_to_speech(spark, d):
    return intervals.snap_to_speech(a.segments(spark, d), a.turns(spark, d), window=0.5).select("recording_id", "id", r3("snapped_start"), r3("snapped_end"))


_CLAIMS = f"""WITH {a.GOLDEN},
p AS (SELECT g.recording_id, g.id, g.start_s AS gs, a.id AS aid, a.start_s AS s, a.end_s AS e, least(g.end_s, a.end_s) - greatest(g.start_s, a.start_s) AS sh
  FROM golden g JOIN produced a ON g.recording_id = a.recording_id AND g.start_s < a.end_s AND a.start_s < g.end_s),
q AS (SELECT *, row_number() OVER (PARTITION BY recording_id, aid ORDER BY gs, id) AS rn FROM p WHERE sh > 0 AND (sh >= least(0.15, (e - s) * 0.5) OR sh >= (e - s) * 0.5)),
grp AS (SELECT recording_id, id, count(*) AS n, arg_min(s, (s, aid)) AS a, arg_max(e, (s, aid)) AS z FROM q WHERE rn = 1 GROUP BY 1, 2),
rows_ AS (SELECT g.recording_id, g.id, coalesce(n, 0) AS n, floor((a - g.start_s) * 1000 + 0.5)::BIGINT AS start_ms, floor((z - g.end_s) * 1000 + 0.5)::BIGINT AS end_ms FROM golden g LEFT JOIN grp USING (recording_id, id))
"""


@register("jon05_evaluate", _CLAIMS + "SELECT * FROM rows_")
def evaluate(spark, d):
    return intervals.evaluate(a.golden(spark, d), a.produced(spark, d))


@register("jon05_evaluation_report", _CLAIMS + """, b AS (SELECT recording_id, count(*) FILTER (n > 0) AS matched, count(*) FILTER (n > 1) AS split, count(*) FILTER (n = 0) AS missing, sum(n) AS claimed,
  coalesce((count(*) FILTER (abs(start_ms) <= 250) + count(*) FILTER (abs(end_ms) <= 250)) / (2 * count(*) FILTER (n > 0)), 0) AS share, coalesce(max(abs(start_ms)), 0) AS max_start_ms,
  coalesce(max(abs(end_ms)), 0) AS max_end_ms, floor(coalesce(median(abs(start_ms)), 0) + 0.5)::BIGINT AS median_start_ms FROM rows_ GROUP BY 1),
m AS (SELECT recording_id, count(*) AS made FROM produced GROUP BY 1)
SELECT recording_id, coalesce(matched, 0) AS matched, coalesce(split, 0) AS split, coalesce(missing, 0) AS missing, (coalesce(made, 0) - coalesce(claimed, 0))::BIGINT AS spurious, floor(coalesce(share, 0) * 1e6 + 0.5)::BIGINT AS within_ppm,
  coalesce(max_start_ms, 0) AS max_start_ms, coalesce(max_end_ms, 0) AS max_end_ms, coalesce(median_start_ms, 0) AS median_start_ms FROM b FULL JOIN m USING (recording_id)""")
def evaluation_report(spark, d):
    return intervals.evaluation_report(a.golden(spark, d), a.produced(spark, d))


_PLAN = f"""WITH RECURSIVE {a.DIALOGUE},
av AS (SELECT *, row_number() OVER w AS rn, end_s - start_s + greatest(0, least(coalesce(lead(start_s) OVER w - 0.05 - end_s, 0.4), 0.4)) AS available FROM dialogue WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id)),
t AS (SELECT *, CASE WHEN available > 0 AND tts_duration > available THEN least(greatest(tts_duration / available, 0.9), 1.25) ELSE 1.0 END::DOUBLE AS tempo1, CASE WHEN available > 0 AND tts_duration > available THEN 1.25 ELSE 1.0 END::DOUBLE AS tempo2 FROM av),
e AS (SELECT *, tts_duration / tempo1 AS eff1, tts_duration / tempo2 AS raw2, CASE WHEN tts_duration / tempo2 > available THEN available END AS cut FROM t),
f AS (SELECT *, coalesce(cut, raw2) AS eff2 FROM e),
plan AS (
  SELECT recording_id, rn, id, start_s AS pos, false AS capped, start_s + eff1 AS reached FROM f WHERE rn = 1
  UNION ALL SELECT recording_id, rn, id, CASE WHEN free - start_s > 1.5 THEN start_s + 1.5 ELSE free END, free - start_s > 1.5, CASE WHEN free - start_s > 1.5 THEN start_s + 1.5 + eff2 ELSE free + eff1 END
  FROM (SELECT f.*, greatest(f.start_s, plan.reached + 0.05) AS free FROM plan JOIN f ON f.recording_id = plan.recording_id AND f.rn = plan.rn + 1)),
placed AS (SELECT f.recording_id, f.id, floor(pos * 1000 + 0.5) / 1000 AS aligned_start, floor(CASE WHEN capped THEN 1.5 ELSE pos - start_s END * 1000 + 0.5)::BIGINT AS shift_ms, floor(CASE WHEN capped THEN tempo2 ELSE tempo1 END * 10000 + 0.5) / 10000 AS tempo,
  floor(CASE WHEN capped THEN eff2 ELSE eff1 END * 1000 + 0.5) / 1000 AS effective, CASE WHEN capped THEN cut END AS truncate_to, eff1 > available + 1e-6 AS needs_shorten, floor(available * 1000 + 0.5) / 1000 AS available
  FROM f JOIN plan USING (recording_id, rn))
"""


def _plan(spark, d) -> DataFrame:
    return sequence.plan_alignment(a.dialogue(spark, d).select("recording_id", "id", "start_s", "end_s", "tts_duration"), borrow=0.4)


@register("win13_plan_alignment", _PLAN + "SELECT recording_id, id, aligned_start, shift_ms, tempo, effective, floor(truncate_to * 1000 + 0.5) / 1000 AS truncate_to, needs_shorten, available FROM placed")
def plan_alignment(spark, d):
    return _plan(spark, d).select("recording_id", "id", "aligned_start", "shift_ms", "tempo", "effective", r3("truncate_to"), "needs_shorten", "available")


@register("agg03_alignment_stats", _PLAN + """SELECT recording_id, count(*) AS n, floor(median(abs(shift_ms)) + 0.5)::BIGINT AS median_ms, max(abs(shift_ms)) AS max_ms, count(*) FILTER (abs(shift_ms) > 250) AS outside,
  count(*) FILTER (tempo > 1.001) AS speed_up, count(truncate_to) AS truncated FROM placed GROUP BY 1""")
def alignment_stats(spark, d):
    return sequence.alignment_stats(_plan(spark, d))


@register("win14_pull_continuations", f"""WITH RECURSIVE {a.SPANS}, x AS (SELECT *, (id * 37 % 11) * 150 AS shift_ms, (end_s - start_s) * 0.8::DOUBLE AS len, CASE WHEN id % 3 = 0 THEN 'done.' ELSE 'goes on' END AS text FROM spans WHERE end_s > start_s),
n AS (SELECT *, row_number() OVER w AS rn, coalesce(lag(end_s) OVER w >= start_s - 0.6 AND lag(text) OVER w <> 'done.', false) AS goes, greatest(0.05, least(start_s - lag(end_s) OVER w, 0.3)) AS rest
  FROM x WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id)),
f AS (SELECT recording_id, rn, id, shift_ms, start_s + shift_ms / 1000 + len AS reached FROM n WHERE rn = 1
  UNION ALL SELECT recording_id, rn, id, s, start_s + s / 1000 + len FROM (
    SELECT n.*, CASE WHEN goes AND greatest(n.start_s - 3, f.reached + rest) < n.start_s + n.shift_ms / 1000 - 0.05 THEN floor((greatest(n.start_s - 3, f.reached + rest) - n.start_s) * 1000 + 0.5)::BIGINT ELSE n.shift_ms END AS s
    FROM f JOIN n ON n.recording_id = f.recording_id AND n.rn = f.rn + 1))
SELECT recording_id, id, shift_ms AS new_shift_ms FROM f""")
def pull_continuations(spark, d):
    rows = a.spans(spark, d).where("end_s > start_s")
    rows = rows.select("recording_id", "id", "start_s", "end_s", F.lit("one").alias("speaker"), ((F.col("id") * 37 % 11) * 150).alias("shift_ms"), ((F.col("end_s") - F.col("start_s")) * 0.8).alias("aligned_duration"), F.when(F.col("id") % 3 == 0, "done.").otherwise("goes on").alias("text"))
    return sequence.pull_continuations(rows).select("recording_id", "id", "new_shift_ms")


@register("win17_pitch_runs", f"""WITH {a.SPANS}, p AS (SELECT recording_id, id, CASE WHEN id % 5 <> 0 THEN 120.0::DOUBLE + (end_s - start_s) * 20 END AS pitch FROM spans),
b AS (SELECT *, lag(pitch) OVER (PARTITION BY recording_id ORDER BY id) AS last FROM p),
r AS (SELECT *, sum(CASE WHEN pitch IS NULL OR last IS NULL OR abs(pitch - last) / last > 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY id ROWS UNBOUNDED PRECEDING) AS run FROM b),
n AS (SELECT *, count(*) OVER (PARTITION BY recording_id, run) AS n FROM r WHERE pitch IS NOT NULL)
SELECT recording_id, id, floor(pitch * 1000 + 0.5) / 1000 AS pitch FROM n WHERE n >= 3""")
def pitch_runs(spark, d):
    pitch = F.when(F.col("id") % 5 != 0, 120 + (F.col("end_s") - F.col("start_s")) * 20)
    return sequence.pitch_runs(a.spans(spark, d).select("recording_id", "id", pitch.alias("pitch"))).select("recording_id", "id", r3("pitch"))


@register("win19_review_chunks", f"""WITH {a.SPANS}, n AS (SELECT recording_id, id, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, id) - 1 AS n, count(*) OVER (PARTITION BY recording_id) AS total FROM spans),
c AS (SELECT recording_id, id, n, unnest(range(0, greatest(0, ceil((total - 12) / 9)::BIGINT) + 1)) AS chunk FROM n)
SELECT recording_id, chunk, id FROM c WHERE n BETWEEN chunk * 9 AND chunk * 9 + 11""")
def review_chunks(spark, d):
    return sequence.review_chunks(a.spans(spark, d), size=12, overlap=3).select("recording_id", "chunk", "id")


@register("win20_context", f"""WITH {a.DIALOGUE} SELECT recording_id, id, coalesce(array_to_string(list(text) OVER (PARTITION BY recording_id ORDER BY start_s, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS context FROM dialogue""")
@register("win20_whole_context", f"""WITH {a.DIALOGUE} SELECT recording_id, id, coalesce(array_to_string(list(text) OVER (PARTITION BY recording_id ORDER BY start_s, id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), ' | '), '') AS context FROM dialogue""")
def whole_context(spark, d):
    """Whole texts of the rows before."""
    return sequence.context_before(a.dialogue(spark, d), rows=3).select("recording_id", "id", F.array_join("context", " | ").alias("context"))


@register("win22_passthrough_plan", f"WITH {a.DIALOGUE} SELECT recording_id, id, floor(start_s * 1000 + 0.5) / 1000 AS aligned_start, 0 AS shift_ms, floor(tts_duration * 1000 + 0.5) / 1000 AS effective, tts_duration > end_s - start_s AS needs_shorten FROM dialogue")
def passthrough(spark, d):
    return a.dialogue(spark, d).select("recording_id", "id", places(F.col("start_s"), 3).alias("aligned_start"), F.lit(0).alias("shift_ms"), places(F.col("tts_duration"), 3).alias("effective"), (F.col("tts_duration") > F.col("end_s") - F.col("start_s")).alias("needs_shorten"))


@register("win23_spoken_windows", f"""WITH {a.DIALOGUE}, c AS (SELECT *, CASE WHEN id % 4 <> 3 THEN tts_duration * 0.9::DOUBLE END AS aligned, CASE WHEN id % 5 <> 4 THEN tts_duration END AS raw, (id % 3) * 40 AS shift FROM dialogue)
SELECT recording_id, id, floor((start_s + shift / 1000) * 1000 + 0.5) / 1000 AS start_s, floor((start_s + shift / 1000 + coalesce(aligned, raw)) * 1000 + 0.5) / 1000 AS end_s FROM c WHERE coalesce(aligned, raw) > 0""")
def spoken_windows(spark, d):
    rows = a.dialogue(spark, d).withColumn("aligned", F.when(F.col("id") % 4 != 3, F.col("tts_duration") * 0.9)).withColumn("raw", F.when(F.col("id") % 5 != 4, F.col("tts_duration")))
    start = F.col("start_s") + (F.col("id") % 3) * 40 / 1000
    return rows.where(F.coalesce("aligned", "raw") > 0).select("recording_id", "id", places(start, 3).alias("start_s"), places(start + F.coalesce("aligned", "raw"), 3).alias("end_s"))


@register("win24_speech_windows", f"""WITH {a.SEGMENTS}, v AS (SELECT * FROM turns WHERE recording_id % 3 <> 0)
SELECT recording_id, id, 'detected' AS kind FROM v UNION ALL SELECT recording_id, id, 'slot' FROM segments WHERE recording_id NOT IN (SELECT recording_id FROM v)""")
def speech_windows(spark, d):
    seen = a.turns(spark, d).where("recording_id % 3 <> 0")
    rest = a.segments(spark, d).join(seen.select("recording_id").distinct(), "recording_id", "left_anti")
    return seen.select("recording_id", "id", F.lit("detected").alias("kind")).unionByName(rest.select("recording_id", "id", F.lit("slot").alias("kind")))


@register("snk06_voice_track", f"""WITH {a.SPANS}, n AS (SELECT recording_id, id, start_s, floor(start_s * 100 + 0.5) AS want, greatest(0, floor((end_s - start_s) * 100 + 0.5)) AS n FROM spans),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY recording_id ORDER BY start_s, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n),
p AS (SELECT *, max(want - before) OVER (PARTITION BY recording_id ORDER BY start_s, id ROWS UNBOUNDED PRECEDING) + before AS placed FROM b)
SELECT recording_id, id, placed::BIGINT AS placed, placed > want AS collided FROM p""")
def voice_track(spark, d):
    return sequence.voice_track(a.spans(spark, d), rate=100)


_WINDOWS = f"""WITH {a.SEGMENTS}, k AS (SELECT recording_id, start_s, end_s, unnest(range(ceil((start_s - 0.25) / 0.5)::BIGINT, floor((end_s + 0.25) / 0.5)::BIGINT + 1)) AS tick FROM segments),
dep AS (SELECT recording_id, tick, max(greatest(0, least(1, (tick * 0.5 - (start_s - 0.25)) / 0.25, (end_s + 0.25 - tick * 0.5) / 0.25))) AS depth FROM k GROUP BY 1, 2)
"""


@register("mth08_duck_envelope", _WINDOWS + "SELECT recording_id, tick, floor((1 + (pow(10, -18.0 / 20) - 1) * depth) * 1e6 + 0.5) / 1e6 AS gain FROM dep")
def duck_envelope(spark, d):
    depth = intervals.depth_on_grid(a.segments(spark, d), 0.5, 0.25)
    return depth.select("recording_id", "tick", places(1 + F.lit(10 ** (-18 / 20) - 1) * F.col("depth"), 6).alias("gain"))


@register("snk08_presence_envelope", _WINDOWS + "SELECT recording_id, tick, floor((1 - pow(10, -20.0 / 20)) * depth * 1e6 + 0.5) / 1e6 AS gain FROM dep")
def presence_envelope(spark, d):
    depth = intervals.depth_on_grid(a.segments(spark, d), 0.5, 0.25)
    return depth.select("recording_id", "tick", places(F.lit(1 - 10 ** (-20 / 20)) * F.col("depth"), 6).alias("gain"))


@register("stm01_speech_regions", f"""WITH fr AS (SELECT user_id AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS frame_id, value / 100 AS p FROM events),
n AS (SELECT recording_id, max(frame_id) + 1 AS frames FROM fr GROUP BY 1), l AS (SELECT *, lag(frame_id) OVER (PARTITION BY recording_id ORDER BY frame_id) AS last FROM fr WHERE p >= 0.5),
r AS (SELECT *, sum(CASE WHEN last IS NULL OR frame_id - last - 1 >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY frame_id ROWS UNBOUNDED PRECEDING) AS run FROM l),
g AS (SELECT recording_id, run, min(frame_id) AS a, max(frame_id) AS z, any_value(frames) AS frames FROM r JOIN n USING (recording_id) GROUP BY 1, 2),
c AS (SELECT *, CASE WHEN frames - z - 1 < 2 THEN frames ELSE z + 1 END AS e FROM g),
p AS (SELECT recording_id, greatest(0, a * 0.1::DOUBLE - 0.06::DOUBLE) AS start_s, least(frames * 0.1::DOUBLE, e * 0.1::DOUBLE + 0.06::DOUBLE) AS end_s FROM c WHERE (e - a) * 0.1::DOUBLE >= 0.2::DOUBLE - 1e-9),
m AS (SELECT *, max(end_s) OVER (PARTITION BY recording_id ORDER BY start_s, end_s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM p),
i AS (SELECT *, sum(CASE WHEN reached IS NULL OR start_s - reached > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY start_s, end_s ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT recording_id, floor(min(start_s) * 1000 + 0.5) / 1000 AS start_s, floor(max(end_s) * 1000 + 0.5) / 1000 AS end_s FROM i GROUP BY recording_id, island""")
def speech_regions(spark, d):
    events = a.table(spark, d, "events")
    frame = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    frames = events.select(F.col("user_id").alias("recording_id"), frame.cast("long").alias("frame_id"), (F.col("value") / 100).alias("p"))
    return sequence.speech_regions(frames, frame=0.1).select("recording_id", r3("start_s"), r3("end_s"))
