"""Queries over lengths, rates, reviews, voices, costs and progress."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import numbers as nb
from cuegrid.functions.numbers import places
from cuegrid.operators import changes, progress, speech
from cuegrid.plans.registry import Registry
from cuegrid.sources import adapters as a

register = Registry()
RATE, OVERHEAD, TOLERANCE, FLOOR = 15.0, 0.26, 0.15, 0.25


def r(x: str, n: int = 3) -> str:
    return f"floor(({x}) * {10**n} + 0.5) / {10**n}"


EST = f"({OVERHEAD}::DOUBLE + length(text) / {RATE}::DOUBLE)"
WITHIN = f"abs({EST} - slot) <= greatest(slot * {TOLERANCE}::DOUBLE, {FLOOR}::DOUBLE)"


@register("mth01_speech_seconds", f"WITH {a.DIALOGUE} SELECT recording_id, id, {r(EST)} AS seconds, {r(f'{EST} / slot')} AS ratio, {WITHIN} AS within FROM dialogue")
def speech_seconds(spark, d):
    est = nb.speech_seconds(F.length("text"), RATE, OVERHEAD)
    return a.dialogue(spark, d).select("recording_id", "id", places(est, 3).alias("seconds"), places(nb.length_ratio(est, F.col("slot")), 3).alias("ratio"), nb.within_length(est, F.col("slot"), TOLERANCE, FLOOR).alias("within"))


def _target(tol: str) -> str:
    return f"greatest(1, floor(greatest(0, slot - {OVERHEAD}::DOUBLE) * {RATE}::DOUBLE * {tol} + 0.5))::BIGINT"


@register("mth03_char_budgets", f"""WITH {a.DIALOGUE} SELECT recording_id, id, {_target('1.0::DOUBLE')} AS target, least({_target('1.0::DOUBLE')}, greatest(8, floor(length(text) * 0.8::DOUBLE + 0.5)))::BIGINT AS bounded,
  {_target('(1.0::DOUBLE - 0.15::DOUBLE)')} AS least, {_target('(1.0::DOUBLE + 0.15::DOUBLE)')} AS most, greatest(4, floor(greatest(0, slot * 1.25::DOUBLE - {OVERHEAD}::DOUBLE) * {RATE}::DOUBLE + 0.5))::BIGINT AS shortened FROM dialogue""")
def char_budgets(spark, d):
    out = speech.budgets(a.dialogue(spark, d), rate=RATE, overhead=OVERHEAD, tolerance=0.15, most_tempo=1.25, cap=0.8)
    return out.select("recording_id", "id", *[F.col(c).cast("long").alias(c) for c in ("target", "bounded", "least", "most", "shortened")])


@register("mth22_chars_outside", f"""WITH {a.DIALOGUE}, b AS (SELECT recording_id, id, length(text) AS n, {_target('(1.0::DOUBLE - 0.15::DOUBLE)')} AS lo, {_target('(1.0::DOUBLE + 0.15::DOUBLE)')} AS hi FROM dialogue)
SELECT recording_id, id, CASE WHEN n > hi THEN n - hi WHEN n < lo THEN n - lo ELSE 0 END::BIGINT AS outside FROM b""")
def chars_outside(spark, d):
    out = speech.budgets(a.dialogue(spark, d), rate=RATE, overhead=OVERHEAD, tolerance=0.15, most_tempo=1.25, cap=0.8)
    return out.select("recording_id", "id", speech.chars_outside(F.length("text"), F.col("least"), F.col("most")).cast("long").alias("outside"))


_MISS = f"CASE WHEN {WITHIN} THEN 0 WHEN {EST} > slot THEN {EST} - slot ELSE (slot - {EST}) / 3 END"


@register("mth06_miss_by", f"WITH {a.DIALOGUE} SELECT recording_id, id, {r(_MISS)} AS miss FROM dialogue")
def miss_by(spark, d):
    est = nb.speech_seconds(F.length("text"), RATE, OVERHEAD)
    return a.dialogue(spark, d).select("recording_id", "id", places(nb.miss_by(est, F.col("slot"), TOLERANCE, FLOOR), 3).alias("miss"))


@register("mth09_db_to_linear", f"WITH {a.SPANS} SELECT id, {r('pow(10.0, (id % 61 - 40) / 20.0)', 9)} AS gain FROM spans")
def db_to_linear(spark, d):
    return a.spans(spark, d).select("id", places(nb.db_to_linear(F.col("id") % 61 - 40), 9).alias("gain"))


@register("mth10_atempo_chain", f"""WITH {a.SPANS}, t AS (SELECT id, 0.2::DOUBLE + (id % 60) / 10.0 AS tempo FROM spans), s AS (SELECT id, tempo, greatest(1, ceil(abs(log2(tempo)) - 1e-9))::INT AS n, CASE WHEN tempo > 1 THEN 2.0 ELSE 0.5 END::DOUBLE AS lim FROM t)
SELECT id, n::BIGINT AS steps, {r('tempo / pow(lim, n - 1)', 9)} AS last FROM s""")
def atempo_chain(spark, d):
    rows = a.spans(spark, d).select("id", nb.atempo_chain(F.lit(0.2) + (F.col("id") % 60) / 10.0).alias("c"))
    return rows.select("id", F.size("c").cast("long").alias("steps"), places(F.element_at("c", -1), 9).alias("last"))


@register("mth20_byte_ranges", "SELECT doc_id, i AS part, i * (n_chars // 4) AS first, CASE WHEN i = 3 THEN n_chars ELSE (i + 1) * (n_chars // 4) END - 1 AS last FROM documents, range(0, 4) AS t(i)")
def byte_ranges(spark, d):
    docs = a.table(spark, d, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("part"))
    step = F.floor(F.col("n_chars") / 4)
    return docs.select("doc_id", "part", (F.col("part") * step).alias("first"), (F.when(F.col("part") == 3, F.col("n_chars")).otherwise((F.col("part") + 1) * step) - 1).alias("last"))


@register("agg02_length_fit_stats", f"""WITH {a.DIALOGUE} SELECT recording_id, count(*) AS total, count(*) FILTER ({WITHIN}) AS within, count(*) FILTER (NOT ({WITHIN}) AND {EST} / slot > 1) AS too_long,
  count(*) FILTER (NOT ({WITHIN}) AND {EST} / slot <= 1) AS too_short, count(*) FILTER ({WITHIN}) / count(*) >= 0.9 AS passed FROM dialogue WHERE text IS NOT NULL GROUP BY 1""")
def length_fit_stats(spark, d):
    return speech.length_stats(a.dialogue(spark, d), rate=RATE, tolerance=TOLERANCE, floor=FLOOR, overhead=OVERHEAD)


@register("agg07_speech_rate_ols", f"""WITH {a.DIALOGUE}, u AS (SELECT recording_id, length(trim(text))::DOUBLE AS x, tts_duration AS y FROM dialogue WHERE text <> '' AND tts_duration > 0.2),
s AS (SELECT recording_id, count(*) AS n, regr_slope(y, x) AS b, regr_intercept(y, x) AS i, sum(x) / sum(y) AS m FROM u GROUP BY 1)
SELECT recording_id, n, CASE WHEN n < 8 THEN NULL WHEN b > 0 AND 1 / b BETWEEN 5 AND 40 THEN {r('1 / b', 2)} WHEN m BETWEEN 5 AND 30 THEN {r('m', 2)} END AS rate,
  CASE WHEN n < 8 THEN NULL WHEN b > 0 AND 1 / b BETWEEN 5 AND 40 THEN {r('greatest(0, least(2, i))')} WHEN m BETWEEN 5 AND 30 THEN 0.0 END AS overhead FROM s""")
def speech_rate(spark, d):
    return speech.speech_rate(a.dialogue(spark, d))


@register("agg13_overlong_share", f"""WITH {a.DIALOGUE} SELECT recording_id, count(*) FILTER (tts_duration > slot * 1.25::DOUBLE) AS overlong, floor(count(*) FILTER (tts_duration > slot * 1.25::DOUBLE) * 100.0 / count(*) + 0.5)::BIGINT AS percent FROM dialogue GROUP BY 1""")
def overlong(spark, d):
    over = F.count_if(F.col("tts_duration") > F.col("slot") * 1.25)
    return a.dialogue(spark, d).groupBy("recording_id").agg(over.alias("overlong"), nb.whole(over * 100 / F.count(F.lit(1))).cast("long").alias("percent"))


@register("top05_misfits", f"""WITH {a.DIALOGUE}, m AS (SELECT recording_id, id, length(text) AS n, CASE WHEN {EST} / slot > 1 THEN 'shorten' ELSE 'expand' END AS action,
  least({_target('1.0::DOUBLE')}, greatest(8, floor(length(text) * 2.0::DOUBLE + 0.5)))::BIGINT AS target FROM dialogue WHERE NOT ({WITHIN}))
SELECT recording_id, id, action, target FROM m WHERE action = 'shorten' OR n < target""")
def misfits(spark, d):
    out = speech.misfits(a.dialogue(spark, d), rate=RATE, overhead=OVERHEAD, tolerance=TOLERANCE, floor=FLOOR, cap=2.0)
    return out.select("recording_id", "id", "action", F.col("target").cast("long").alias("target"))


@register("flt06_intake_verdicts", "SELECT o_orderkey, CASE WHEN NOT o_totalprice > 0 OR miss <= 1 OR miss / o_totalprice <= 0.01 THEN 'ok' WHEN miss / o_totalprice > 0.25 THEN 'broken' ELSE 'warn' END AS verdict FROM (SELECT *, o_totalprice - o_totalprice * (1 - (o_orderkey % 40) / 100.0) AS miss FROM orders)")
def intake(spark, d):
    total = F.col("o_totalprice")
    return a.table(spark, d, "orders").select("o_orderkey", nb.intake_verdict(total, total * (1 - (F.col("o_orderkey") % 40) / 100.0)).alias("verdict"))


@register("flt07_fits_length", f"WITH {a.DIALOGUE} SELECT recording_id, id, tts_duration <= slot + greatest(0.3, slot * 0.1) AS fits FROM dialogue")
def fits_length(spark, d):
    return a.dialogue(spark, d).select("recording_id", "id", nb.fits_length(F.col("tts_duration"), F.col("slot")).alias("fits"))


@register("flt04_usable_rates", "SELECT p_partkey FROM part WHERE p_retailprice / 60 BETWEEN 5 AND 30")
def usable_rates(spark, d):
    return a.table(spark, d, "part").where(nb.usable_rate(F.col("p_retailprice") / 60)).select("p_partkey")


def _proposed(spark, d) -> DataFrame:
    """Every third row twice, once for an unknown id, as it is, emptied, or with a changed length."""
    rows = a.dialogue(spark, d).where("id % 3 <> 2")
    new = F.when(F.col("id") % 5 == 0, F.col("text")).when(F.col("id") % 7 == 3, F.lit("")).when(F.col("id") % 2 == 0, F.substring("text", 1, 40)).otherwise(F.concat("text", F.lit(" and more of it")))
    first = rows.select("recording_id", "id", F.lit(0).alias("ord"), new.alias("new_text"))
    second = rows.select("recording_id", F.when(F.col("id") == 0, F.col("id") + 1000).otherwise(F.col("id")).alias("id"), F.lit(1).alias("ord"), F.lit("late").alias("new_text"))
    return first.unionByName(second)


_REVIEW = f"""WITH {a.DIALOGUE}, raw AS (SELECT recording_id, id, 0 AS ord, CASE WHEN id % 5 = 0 THEN text WHEN id % 7 = 3 THEN '' WHEN id % 2 = 0 THEN substr(text, 1, 40) ELSE text || ' and more of it' END AS t FROM dialogue WHERE id % 3 <> 2
  UNION ALL SELECT recording_id, CASE WHEN id = 0 THEN id + 1000 ELSE id END, 1, 'late' FROM dialogue WHERE id % 3 <> 2),
ch AS (SELECT recording_id, id, trim(arg_min(t, ord)) AS after FROM raw GROUP BY 1, 2),
j AS (SELECT ch.*, d.slot, trim(d.text) AS before FROM ch LEFT JOIN dialogue d USING (recording_id, id)),
e AS (SELECT *, {OVERHEAD}::DOUBLE + length(before) / {RATE}::DOUBLE AS eb, {OVERHEAD}::DOUBLE + length(after) / {RATE}::DOUBLE AS ea, greatest(slot * {TOLERANCE}::DOUBLE, {FLOOR}::DOUBLE) AS tol FROM j),
m AS (SELECT *, CASE WHEN abs(eb - slot) <= tol THEN 0 WHEN eb > slot THEN eb - slot ELSE (slot - eb) * (1 / 3::DOUBLE) END AS mb, CASE WHEN abs(ea - slot) <= tol THEN 0 WHEN ea > slot THEN ea - slot ELSE (slot - ea) * (1 / 3::DOUBLE) END AS ma FROM e),
w AS (SELECT *, CASE WHEN slot IS NULL THEN 'unknown_id' WHEN after = '' THEN 'empty' WHEN after = before THEN 'same' WHEN before <> '' AND ma > mb + 0.05 THEN 'worse_fit' ELSE 'applied' END AS why FROM m),
g AS (SELECT recording_id, count(*) FILTER (why = 'applied') AS done FROM w GROUP BY 1), n AS (SELECT recording_id, count(*) FILTER (trim(text) <> '') AS texts FROM dialogue GROUP BY 1),
jr AS (SELECT w.recording_id, w.id, coalesce(before, '') AS before, after, CASE WHEN texts >= 5 AND done > 0 AND done / texts > 0.5 THEN 'discarded' ELSE why END AS verdict,
  CASE WHEN slot IS NULL THEN 0 ELSE {r('mb', 2)} END AS miss_before, CASE WHEN slot IS NULL OR after = '' THEN 0 ELSE {r('ma', 2)} END AS miss_after FROM w JOIN g USING (recording_id) LEFT JOIN n USING (recording_id))
"""


def _review(spark, d) -> DataFrame:
    return speech.review(a.dialogue(spark, d), _proposed(spark, d), rate=RATE, overhead=OVERHEAD, tolerance=TOLERANCE, floor=FLOOR, most_share=0.5, least_rows=5)


@register("jon11_review_apply", _REVIEW + "SELECT d.recording_id, d.id, CASE WHEN verdict = 'applied' THEN after ELSE text END AS text, coalesce(verdict = 'applied', false) AS changed FROM dialogue d LEFT JOIN jr USING (recording_id, id)")
def review_apply(spark, d):
    done = _review(spark, d).where("verdict = 'applied'").select("recording_id", "id", "after")
    out = a.dialogue(spark, d).join(done, ["recording_id", "id"], "left")
    return out.select("recording_id", "id", F.coalesce("after", "text").alias("text"), F.col("after").isNotNull().alias("changed"))


@register("agg12_review_journal", _REVIEW + "SELECT * FROM jr")
def review_journal(spark, d):
    return _review(spark, d)


@register("str30_refit_lines", _REVIEW + f"SELECT recording_id, id, greatest(0, length(after) - greatest(1, floor(greatest(0, slot - {OVERHEAD}::DOUBLE) * {RATE}::DOUBLE + 0.5)))::BIGINT AS overflow FROM jr JOIN dialogue USING (recording_id, id) WHERE verdict = 'worse_fit'")
def refit_lines(spark, d):
    bad = _review(spark, d).where("verdict = 'worse_fit'").join(a.dialogue(spark, d), ["recording_id", "id"])
    return bad.select("recording_id", "id", F.greatest(F.lit(0), F.length("after") - nb.target_chars(F.col("slot"), RATE, 0.0, OVERHEAD)).cast("long").alias("overflow"))


@register("set01_first_wins", "SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def first_wins(spark, d):
    return changes.first_wins(a.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("set03_last_wins", "SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def last_wins(spark, d):
    return changes.last_wins(a.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey")


@register("set02_review_merge", f"""WITH {a.SPANS}, n AS (SELECT recording_id, id, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, id) - 1 AS n, count(*) OVER (PARTITION BY recording_id) AS t FROM spans)
SELECT recording_id, id, least(greatest(0, ceil((n - 11) / 9)), greatest(0, ceil((t - 12) / 9)))::BIGINT AS chunk FROM n""")
def review_merge(spark, d):
    from cuegrid.operators import sequence

    return changes.first_wins(sequence.review_chunks(a.spans(spark, d), size=12, overlap=3), ["recording_id", "id"], ["chunk"]).select("recording_id", "id", "chunk")


@register("set04_new_names", "SELECT l_orderkey AS key FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A'")
def new_names(spark, d):
    rows = a.table(spark, d, "lineitem")
    after, before = (rows.where(F.col("l_returnflag") == f).select(F.col("l_orderkey").alias("key")) for f in ("R", "A"))
    return changes.added(after, before, ["key"])


@register("set05_map_changes", "SELECT coalesce(x.user_id, y.user_id) AS key, x.v AS before, y.v AS after FROM (SELECT user_id, max(event_type) AS v FROM events WHERE event_id % 3 = 0 GROUP BY 1) x FULL JOIN (SELECT user_id, max(event_type) AS v FROM events WHERE event_id % 3 = 1 AND user_id % 9 <> 4 GROUP BY 1) y ON x.user_id = y.user_id WHERE x.v IS DISTINCT FROM y.v")
def map_changes(spark, d):
    events = a.table(spark, d, "events")
    side = lambda cond: events.where(cond).groupBy(F.col("user_id").alias("key")).agg(F.max("event_type").alias("v"))
    return changes.map_changes(side("event_id % 3 = 0"), side("event_id % 3 = 1 AND user_id % 9 <> 4"))


@register("jon12_snapshot_diff", f"""WITH {a.DIALOGUE}, o AS (SELECT recording_id, id, sha256(speaker || chr(0) || text) AS k FROM dialogue WHERE id % 6 <> 5), n AS (SELECT recording_id, id, sha256(CASE WHEN id % 4 = 1 THEN 'x' ELSE speaker END || chr(0) || text) AS k FROM dialogue WHERE id % 7 <> 6)
SELECT recording_id, id, CASE WHEN o.k IS NULL THEN 'new' WHEN n.k IS NULL THEN 'gone' ELSE 'changed' END AS what FROM o FULL JOIN n USING (recording_id, id) WHERE o.k IS DISTINCT FROM n.k""")
def snapshot_diff(spark, d):
    rows = a.dialogue(spark, d)
    key = lambda who: F.sha2(F.concat(who, F.lit("\x00"), F.col("text")), 256).alias("k")
    old = rows.where("id % 6 <> 5").select("recording_id", "id", key(F.col("speaker")))
    new = rows.where("id % 7 <> 6").select("recording_id", "id", key(F.when(F.col("id") % 4 == 1, "x").otherwise(F.col("speaker"))))
    return changes.snapshot_diff(old, new, ["recording_id", "id"])


_GENDER = "CASE WHEN f0 IS NULL OR p25 IS NULL OR v < 0.6 OR (v < 1.5 AND f0 BETWEEN 120 AND 260) THEN 'unknown' WHEN p25 < 150 AND f0 < 275 THEN 'm' WHEN p25 >= 155 AND f0 > 175 THEN 'f' ELSE 'unknown' END"


@register("flt11_classify_gender", f"SELECT event_id, {_GENDER} AS gender FROM (SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN 80 + value * 3 END AS f0, 70 + value * 2.8::DOUBLE AS p25, (event_id % 30) / 10.0 AS v FROM events)")
def classify_gender(spark, d):
    f0 = F.when(F.col("event_id") % 9 != 0, 80 + F.col("value") * 3)
    return a.table(spark, d, "events").select("event_id", speech.gender_of(f0, (F.col("event_id") % 30) / 10.0, 70 + F.col("value") * 2.8).alias("gender"))


_PROFILE = f"""WITH {a.SPANS}, s AS (SELECT recording_id, speaker, 80 + floor((end_s - start_s) * 40) AS hz FROM spans),
n AS (SELECT *, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY hz) - 1 AS i, count(*) OVER (PARTITION BY recording_id, speaker) AS n FROM s),
q AS (SELECT recording_id, speaker, max(hz) FILTER (i = floor(n * 0.5)) AS f0, max(hz) FILTER (i = floor(n * 0.25)) AS p25, max(hz) FILTER (i = floor(n * 0.75)) AS p75, {r('max(n) * 0.1::DOUBLE')} AS v FROM n GROUP BY 1, 2)
"""


def _profiles(spark, d) -> DataFrame:
    hz = (80 + F.floor((F.col("end_s") - F.col("start_s")) * 40)).cast("double")
    return speech.profiles(a.spans(spark, d).select("recording_id", "speaker", hz.alias("hz")), frame=0.1)


@register("agg05_pitch_profiles", _PROFILE + f"SELECT recording_id, speaker, f0, p25, p75, v AS voiced, {_GENDER} AS gender FROM q")
def pitch_profiles(spark, d):
    return _profiles(spark, d).withColumn("voiced", places(F.col("voiced"), 3))


@register("flt09_effective_gender", _PROFILE + f""", e AS (SELECT recording_id, speaker, {_GENDER} AS pitch, CASE WHEN recording_id % 3 = 0 THEN 'm' WHEN recording_id % 3 = 1 THEN 'f' ELSE 'unknown' END AS told FROM q)
SELECT recording_id, speaker, CASE WHEN pitch <> 'unknown' THEN pitch ELSE told END AS gender, pitch <> 'unknown' AND told <> 'unknown' AND pitch <> told AS disputed FROM e""")
def effective_gender(spark, d):
    told = F.when(F.col("recording_id") % 3 == 0, "m").when(F.col("recording_id") % 3 == 1, "f").otherwise("unknown")
    return _profiles(spark, d).select("recording_id", "speaker", speech.effective_gender(F.col("gender"), told).alias("gender"), speech.disputed(F.col("gender"), told).alias("disputed"))


@register("jon09_pitch_in_spans", f"""WITH {a.SEGMENTS}, s AS (SELECT recording_id, start_s AS t, 80 + floor((end_s - start_s) * 40) AS hz FROM turns),
p AS (SELECT g.recording_id, g.id, hz FROM segments g JOIN s ON g.recording_id = s.recording_id AND s.t BETWEEN g.start_s AND g.end_s)
SELECT recording_id, id, count(*) AS n, min(hz) AS lowest FROM p GROUP BY 1, 2""")
def pitch_in_spans(spark, d):
    from cuegrid.operators.intervals import overlap_join

    samples = a.turns(spark, d).select("recording_id", "start_s", F.col("start_s").alias("end_s"), (80 + F.floor((F.col("end_s") - F.col("start_s")) * 40)).cast("double").alias("hz"))
    return overlap_join(a.segments(spark, d), samples, by=["recording_id"]).groupBy("recording_id", "id").agg(F.count(F.lit(1)).alias("n"), F.min("r_hz").alias("lowest"))


_CANDIDATES = f"""WITH {a.DIALOGUE}, {a.SPANS}, tn AS (SELECT recording_id, start_s, end_s, speaker FROM spans), fl AS (SELECT *, coalesce(start_s < lag(end_s) OVER w - 1e-6, false) OR coalesce(lead(start_s) OVER w < end_s - 1e-6, false) AS ov FROM dialogue WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id)),
f AS (SELECT *, end_s - start_s AS sec, length(trim(text)) / (end_s - start_s) AS rate FROM fl WHERE NOT ov AND length(trim(text)) > 8 AND end_s - start_s BETWEEN 1.5 AND 10),
k AS (SELECT f.recording_id, f.id FROM f LEFT JOIN tn ON f.recording_id = tn.recording_id AND tn.end_s > f.start_s AND tn.start_s < f.end_s GROUP BY 1, 2 HAVING count(DISTINCT tn.speaker) <= 1),
c AS (SELECT f.recording_id, f.id, speaker, start_s, {r('sec', 2)} AS seconds, {r('rate', 1)} AS rate, sec BETWEEN 3 AND 8 AND f.rate BETWEEN 8 AND 20 AS good FROM f JOIN k USING (recording_id, id)),
rk AS (SELECT recording_id, id, speaker, seconds, rate, good, row_number() OVER (PARTITION BY recording_id, speaker ORDER BY good DESC, abs(seconds - 5), start_s, id) AS rank FROM c)
"""


def _candidates(spark, d) -> DataFrame:
    return speech.reference_candidates(a.dialogue(spark, d), a.spans(spark, d), low=8.0, high=20.0)


@register("jon08_reference_candidates", _CANDIDATES + "SELECT * FROM rk")
def reference_candidates(spark, d):
    return _candidates(spark, d)


@register("top02_picked_references", _CANDIDATES + "SELECT recording_id, speaker, CASE WHEN recording_id % 5 <> 0 THEN id END AS id FROM rk WHERE rank = 1")
@register("top02_all_picked_references", _CANDIDATES + "SELECT recording_id, speaker, CASE WHEN recording_id % 5 <> 0 THEN id END AS id FROM rk WHERE rank = 1")
def all_picked_references(spark, d):
    """Every recording; those divisible by 5 have a choice of off, which gives a row without a segment."""
    said = a.dialogue(spark, d)
    choices = said.where("recording_id % 5 = 0").select("recording_id", "speaker", F.lit("off").alias("chosen")).distinct()
    return speech.picked_references(_candidates(spark, d), said, choices)


@register("jon15_cost_estimate", f"SELECT l_orderkey, count(*) AS n, {r('sum(l_quantity * (0.25::DOUBLE * p_retailprice + 0.3::DOUBLE * p_retailprice * 2)) / 1000')} AS cost FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 0 GROUP BY 1")
def cost_estimate(spark, d):
    rows = a.table(spark, d, "lineitem").join(a.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).where("l_quantity > 0")
    cost = speech.whole_cost(F.col("l_quantity"), F.lit(0.25), F.lit(0.3), F.col("p_retailprice"), F.col("p_retailprice") * 2)
    return rows.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), places(F.sum(cost) / 1000, 3).alias("cost"))


@register("mth21_usage_cost", f"SELECT l_orderkey, l_linenumber, {r('CASE WHEN l_tax > 0.04 THEN l_tax ELSE coalesce(l_quantity * p_retailprice + l_quantity * p_retailprice * 2, 0) END', 4)} AS cost FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size > 10")
def usage_cost(spark, d):
    rows = a.table(spark, d, "lineitem").join(a.table(spark, d, "part").where("p_size > 10"), F.col("l_partkey") == F.col("p_partkey"), "left")
    cost = F.when(F.col("l_tax") > 0.04, F.col("l_tax")).otherwise(F.coalesce(F.col("l_quantity") * F.col("p_retailprice") + F.col("l_quantity") * F.col("p_retailprice") * 2, F.lit(0.0)))
    return rows.select("l_orderkey", "l_linenumber", places(cost, 4).alias("cost"))


@register("agg09_usage_totals", "SELECT l_suppkey, sum(l_quantity)::BIGINT AS tokens, count(*) AS requests FROM lineitem GROUP BY 1")
def usage_totals(spark, d):
    return a.table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum(F.coalesce("l_quantity", F.lit(0.0))).cast("long").alias("tokens"), F.count(F.lit(1)).alias("requests"))


@register("agg10_token_rates", f"""WITH u AS (SELECT l_suppkey, l_returnflag = 'R' AS review, l_quantity * 100 AS chars, l_extendedprice AS tokens, row_number() OVER (PARTITION BY l_suppkey, l_returnflag = 'R' ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) AS rn FROM lineitem WHERE l_quantity * 100 >= 500 AND l_extendedprice > 0)
SELECT l_suppkey, review, {r('tokens / chars', 6)} AS rate FROM u WHERE rn = 1""")
def token_rates(spark, d):
    rows = a.table(spark, d, "lineitem").select("l_suppkey", (F.col("l_returnflag") == "R").alias("review"), (F.col("l_quantity") * 100).alias("chars"), F.col("l_extendedprice").alias("tokens"), "l_shipdate", "l_orderkey", "l_linenumber")
    latest = changes.last_wins(rows.where("chars >= 500 AND tokens > 0"), ["l_suppkey", "review"], ["l_shipdate", "l_orderkey", "l_linenumber"])
    return latest.select("l_suppkey", "review", places(F.col("tokens") / F.col("chars"), 6).alias("rate"))


@register("flt05_filter_catalogue", "SELECT p_partkey, p_name FROM part WHERE (contains(lower(p_name), 'a') OR contains(lower(p_type), 'brass')) AND p_size < 20")
def filter_catalogue(spark, d):
    return a.table(spark, d, "part").where((F.lower("p_name").contains("a") | F.lower("p_type").contains("brass")) & (F.col("p_size") < 20)).select("p_partkey", "p_name")


@register("top04_best_format", "SELECT p_brand, arg_max(p_partkey, (coalesce(p_size, 0), p_partkey)) AS best FROM part WHERE p_retailprice > 0 GROUP BY 1")
def best_format(spark, d):
    return changes.last_wins(a.table(spark, d, "part").where("p_retailprice > 0").withColumn("height", F.coalesce("p_size", F.lit(0))), ["p_brand"], ["height", "p_partkey"]).select("p_brand", F.col("p_partkey").alias("best"))


@register("stm02_progress_totals", """WITH e AS (SELECT user_id, ts, event_id, floor(value)::BIGINT AS b, lag(floor(value)::BIGINT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
SELECT user_id, event_id, (b + sum(CASE WHEN b < p THEN p ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total FROM e""")
def progress_totals(spark, d):
    rows = a.table(spark, d, "events").select("user_id", "ts", "event_id", F.floor("value").cast("long").alias("bytes"))
    return progress.totals(rows, ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "total")


@register("stm03_stage_timeline", """WITH e AS (SELECT user_id, event_id, event_type AS stage, ts, lag(event_type) OVER w AS last, max(epoch_us(ts)) OVER (PARTITION BY user_id) AS job_end FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT * FROM e WHERE last IS DISTINCT FROM stage) SELECT user_id, event_id, stage, epoch_us(ts) AS opened, coalesce(lead(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id), job_end) AS closed FROM o""")
def stage_timeline(spark, d):
    events = a.table(spark, d, "events")
    rows = events.select("user_id", "event_id", F.col("event_type").alias("stage"), a.micros(events, "ts").alias("at"))
    return progress.stages(rows, ["user_id"], ["at", "event_id"]).select("user_id", "event_id", "stage", "opened", "closed")


@register("stm05_latest_state", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND event_type <> 'purchase'")
def latest_state(spark, d):
    return changes.last_wins(a.table(spark, d, "events"), ["user_id"], ["ts", "event_id"]).where("event_type <> 'purchase'").select("user_id", "event_type", "event_id")


@register("jon14_known_voices", "SELECT o_custkey, o_orderkey, 'kept' AS what FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT o_custkey, o_orderkey, 'dropped' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10)")
def known_voices(spark, d):
    known = a.table(spark, d, "customer").where("c_nationkey < 10").select(F.col("c_custkey").alias("o_custkey"))
    kept, dropped = changes.known_or_not(a.table(spark, d, "orders").select("o_custkey", "o_orderkey"), known, ["o_custkey"])
    return kept.withColumn("what", F.lit("kept")).unionByName(dropped.withColumn("what", F.lit("dropped")))


@register("jon17_effective_voice", f"""WITH {a.DIALOGUE} SELECT recording_id, id, coalesce(CASE WHEN recording_id % 4 = 0 THEN 'edited' END, CASE WHEN speaker = 'user' THEN 'mapped' END, CASE WHEN id % 2 = 0 THEN 'automatic' END, 'default') AS voice FROM dialogue""")
def effective_voice(spark, d):
    return a.dialogue(spark, d).select("recording_id", "id", F.coalesce(F.when(F.col("recording_id") % 4 == 0, F.lit("edited")), F.when(F.col("speaker") == "user", F.lit("mapped")), F.when(F.col("id") % 2 == 0, F.lit("automatic")), F.lit("default")).alias("voice"))


@register("stm09_unsettled_batches", f"""WITH {a.SPANS}, b AS (SELECT recording_id, id, (row_number() OVER (PARTITION BY recording_id ORDER BY start_s, id) - 1) // 5 AS batch FROM spans)
SELECT recording_id, batch, count(*) AS n FROM b GROUP BY 1, 2 HAVING bool_or(id % 13 = 0)""")
def unsettled(spark, d):
    nth = F.row_number().over(Window.partitionBy("recording_id").orderBy("start_s", "id")) - 1
    rows = a.spans(spark, d).withColumn("batch", F.floor(nth / 5))
    settled = a.spans(spark, d).where("id % 13 <> 0").select("recording_id", "id")
    return changes.unsettled(rows, settled, ["recording_id", "id"], ["recording_id", "batch"])
