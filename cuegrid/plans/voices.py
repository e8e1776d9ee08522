"""Queries over voices, replies of models, requests to them, and built segments."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from cuegrid.functions import text as tx
from cuegrid.functions.numbers import places, target_chars
from cuegrid.operators import changes, fingerprints, intervals, replies, segments, voices, words
from cuegrid.plans.records import WORDS, spoken
from cuegrid.plans.registry import Registry
from cuegrid.plans.speech import _GENDER, _PROFILE, _profiles
from cuegrid.plans.texts import SAID_SQL, said
from cuegrid.sources import adapters as a
from cuegrid.sources import readers

register = Registry()
VOICES = (("v_low", "m", 95.0, False), ("v_mid", "m", 140.0, True), ("v_high", "f", 210.0, False), ("v_top", "f", 250.0, True), ("v_plain", "f", None, False))
_VOICES = ", ".join(f"('{n}', {'NULL' if f is None else f}, {str(x).lower()})" for n, _, f, x in VOICES)


@register("jon19_nearest_voices", _PROFILE + f""", vo AS (SELECT * FROM (VALUES {_VOICES}) AS t(name, vf, accent)), p AS (SELECT recording_id, speaker, name, accent, abs(vf - f0) AS d FROM q JOIN vo ON vf IS NOT NULL),
b AS (SELECT recording_id, speaker, min(d) AS d, arg_min(name, (d, name)) AS n, min(d) FILTER (NOT accent) AS cd, arg_min(name, (d, name)) FILTER (NOT accent) AS cn FROM p GROUP BY 1, 2)
SELECT recording_id, speaker, CASE WHEN cd <= d + 25 THEN cn ELSE n END AS voice FROM b""")
def nearest_voices(spark, d):
    known = spark.createDataFrame([(n, f, x) for n, _, f, x in VOICES], "name string, f0 double, accent boolean")
    return voices.nearest_voice(_profiles(spark, d), known)


@register("jon18_assigned_voices")
def assigned_voices(spark, d):
    return voices.assigned(_profiles(spark, d), list(VOICES))


@register("jon16_speaker_voices", f"WITH {a.DIALOGUE} SELECT recording_id, id, CASE WHEN speaker = 'user' THEN 'v_low' ELSE 'v_plain' END AS voice FROM dialogue")
def speaker_voices(spark, d):
    known = F.create_map(F.lit("user"), F.lit("v_low"))
    return a.dialogue(spark, d).select("recording_id", "id", voices.voice_of(F.col("speaker"), known, "v_plain").alias("voice"))


@register("jon20_speaking_genders", _PROFILE + f""", pr AS (SELECT recording_id, speaker, {_GENDER} AS gender FROM q), c AS (SELECT DISTINCT recording_id, CASE WHEN recording_id % 4 = 0 THEN 'guest' ELSE speaker END AS speaker, 'f' AS g FROM spans WHERE recording_id % 2 = 0 AND speaker = 'view')
SELECT coalesce(pr.recording_id, c.recording_id) AS recording_id, coalesce(pr.speaker, c.speaker) AS speaker, coalesce(g, gender, 'unknown') AS gender, g IS NOT NULL AS firm FROM pr FULL JOIN c ON pr.recording_id = c.recording_id AND pr.speaker = c.speaker""")
def speaking_genders(spark, d):
    chosen = a.spans(spark, d).where("recording_id % 2 = 0 AND speaker = 'view'").select("recording_id", F.when(F.col("recording_id") % 4 == 0, "guest").otherwise(F.col("speaker")).alias("speaker"), F.lit("f").alias("voice_gender")).distinct()
    return voices.speaking_genders(_profiles(spark, d).select("recording_id", "speaker", "gender"), chosen)


@register("flt13_stage_complete", "SELECT conv_id AS recording_id, bool_or(turn % 9 <> 8) AND bool_and(text = '' OR turn % 9 NOT IN (7, 8)) AS complete FROM conversations GROUP BY 1")
def stage_complete(spark, d):
    talk = a.table(spark, d, "conversations")
    rows = talk.select(F.col("conv_id").alias("recording_id"), "text", F.when(F.col("turn") % 9 != 8, F.concat("conv_id", F.lit("/"), "turn")).alias("clip"))
    files = talk.where("turn % 9 <> 7").select(F.concat("conv_id", F.lit("/"), "turn").alias("file"))
    return voices.stage_complete(rows, files, "text", "clip")


@register("flt14_judged_translations", f"""WITH {SAID_SQL}, t AS (SELECT recording_id, CASE WHEN recording_id % 4 = 0 THEN '' WHEN recording_id % 4 = 1 THEN 'Да' ELSE text END AS text FROM said),
n AS (SELECT recording_id, count(*) FILTER (trim(text) = '') AS m, count(*) FILTER (trim(text) <> '' AND NOT regexp_matches(text, '[а-яёА-ЯЁ]')) AS f FROM t GROUP BY 1)
SELECT recording_id, m = 0 AND f = 0 AS ok, CASE WHEN m > 0 THEN 'missing ' || m WHEN f > 0 THEN 'foreign ' || f END AS reason FROM n""")
def judged_translations(spark, d):
    new = F.when(F.col("recording_id") % 4 == 0, "").when(F.col("recording_id") % 4 == 1, "Да").otherwise(F.col("text"))
    return voices.judged_translation(said(spark, d).select("recording_id", new.alias("text")))


@register("flt15_stale_versions", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE date_diff('day', o_orderdate::DATE, DATE '1998-06-01') > 45 END AS stale FROM orders")
def stale_versions(spark, d):
    version = F.when(F.col("o_orderkey") % 5 == 0, "nightly").otherwise(F.concat(F.date_format("o_orderdate", "yyyy.MM.dd"), F.lit(".1")))
    return a.table(spark, d, "orders").select("o_orderkey", voices.stale(version, date(1998, 6, 1)).alias("stale"))


@register("flt17_usable_token_rates", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > 0 AND l_tax > 0 AND l_quantity * 20 >= 500")
def usable_token_rates(spark, d):
    return a.table(spark, d, "lineitem").where(voices.usable_token_rate(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") * 20)).select("l_orderkey", "l_linenumber")


@register("jon21_side_by_side", """WITH o AS (SELECT conv_id // 3 AS comparison, conv_id % 3 AS m, turn AS pos, text FROM conversations), f AS (SELECT DISTINCT comparison, pos FROM o WHERE m = (SELECT min(m) FROM o x WHERE x.comparison = o.comparison))
SELECT comparison, pos, string_agg('m' || m || ': ' || text, ' | ' ORDER BY m, text) AS texts FROM f JOIN o USING (comparison, pos) GROUP BY 1, 2""")
@register("jon21_all_side_by_side", """WITH o AS (SELECT conv_id // 3 AS comparison, conv_id % 3 AS m, turn AS pos, text FROM conversations), f AS (SELECT DISTINCT comparison, pos FROM o WHERE m = (SELECT min(m) FROM o x WHERE x.comparison = o.comparison))
SELECT comparison, pos, string_agg('m' || m || ': ' || text, ' | ' ORDER BY m, text) AS texts FROM f JOIN o USING (comparison, pos) GROUP BY 1, 2""")
def all_side_by_side(spark, d):
    """Whole texts of all conversations, each three of them as models of one comparison."""
    k = F.col("conv_id")
    out = a.table(spark, d, "conversations").select(F.floor(k / 3).alias("comparison"), F.concat(F.lit("m"), k % 3).alias("model"), F.col("turn").alias("pos"), "text")
    both = voices.side_by_side(out, "comparison")
    return both.select("comparison", "pos", F.array_join(F.transform("texts", lambda x: F.concat(x["model"], F.lit(": "), x["text"])), " | ").alias("texts"))


@register("jon13_library_listing", "SELECT c_custkey, o.id AS project, coalesce(o.stages, 0) AS stages FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderkey) AS id, arg_min(o_orderkey % 8, o_orderkey) AS stages FROM orders GROUP BY 1) o ON c_custkey = o_custkey")
def library_listing(spark, d):
    media = a.table(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("path"))
    projects = a.table(spark, d, "orders").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 8).alias("stages"))
    return voices.listing(media, projects).drop("path")


@register("top03_ranked_models", "SELECT o_custkey AS recording_id, o_orderkey AS model, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus = 'F' DESC, o_totalprice DESC, o_orderkey) AS rank FROM orders")
def ranked_models(spark, d):
    rows = a.table(spark, d, "orders").select(F.col("o_custkey").alias("recording_id"), F.col("o_orderkey").alias("model"), (F.col("o_orderstatus") == "F").alias("ok"), F.col("o_totalprice").alias("share"))
    return voices.ranked(rows).select("recording_id", "model", "rank")


@register("agg11_last_calibrations", "SELECT user_id AS voice, arg_max(value, (ts, event_id)) AS rate FROM events WHERE value > 10 GROUP BY 1")
def last_calibrations(spark, d):
    return changes.last_wins(a.table(spark, d, "events").where("value > 10"), ["user_id"], ["ts", "event_id"]).select(F.col("user_id").alias("voice"), F.col("value").alias("rate"))


@register("agg15_sizes_by_folder", "SELECT source, sum(octet_length(encode(text)))::BIGINT AS bytes FROM documents GROUP BY 1")
def sizes_by_folder(spark, d):
    return a.table(spark, d, "documents").groupBy("source").agg(F.sum(F.octet_length("text")).alias("bytes"))


@register("str24_extracted_json", "SELECT conv_id, turn, '{\"id\":' || turn || ',\"t\":\"a}b\"}' AS json FROM conversations")
def extracted_json(spark, d):
    reply = F.concat(F.lit('Sure: ```json\n{"id":'), F.col("turn").cast("string"), F.lit(',"t":"a}b"}\n``` and {more}'))
    return a.table(spark, d, "conversations").select("conv_id", "turn", replies.extracted_json(reply).alias("json"))


@register("str25_parsed_translations", f"WITH {a.DIALOGUE} SELECT recording_id, id, CASE WHEN id % 3 = 0 THEN 'again' ELSE 'x' || id END AS text FROM dialogue WHERE id % 5 <> 4")
def parsed_translations(spark, d):
    rows = a.dialogue(spark, d)
    item = F.struct(F.col("id").cast("string").alias("id"), F.when(F.col("id") % 5 == 4, " ").otherwise(F.concat(F.lit(" x"), "id")).alias("text_ru"))
    late = F.struct(F.when(F.col("id") % 3 == 0, F.col("id").cast("string")).otherwise("nope").alias("id"), F.when(F.col("id") % 5 != 4, "again").alias("text_ru"))
    body = rows.groupBy("recording_id").agg(F.to_json(F.struct(F.concat(F.collect_list(item), F.collect_list(late)).alias("items"))).alias("j"))
    return replies.translations(body.select("recording_id", F.concat(F.lit("Here: "), "j").alias("reply")), rows)


@register("str28_batch_requests", f"""WITH {a.DIALOGUE}, n AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w > 3 OR lag(end_s) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM dialogue WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id)),
s AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY start_s, id ROWS UNBOUNDED PRECEDING) AS scene FROM n),
p AS (SELECT *, (row_number() OVER (PARTITION BY recording_id, scene ORDER BY start_s, id) - 1) // 2 AS part FROM s),
q AS (SELECT *, dense_rank() OVER (PARTITION BY recording_id ORDER BY scene, part) - 1 AS batch FROM p),
l AS (SELECT *, '{{"id":' || id || ',"slot_seconds":' || regexp_replace((floor(slot * 100 + 0.5) / 100)::VARCHAR, '\\.0$', '') || ',"target_chars":'
  || least(greatest(1, floor(greatest(0, slot - 0.26::DOUBLE) * 15.0::DOUBLE + 0.5)), greatest(8, floor(length(text) * 1.1::DOUBLE + 0.5)))::BIGINT
  || CASE speaker WHEN 'user' THEN ',"speaker":"female"' WHEN 'assistant' THEN ',"speaker":"male"' ELSE '' END || ',"text":' || to_json(text)::VARCHAR || '}}' AS line FROM q)
SELECT recording_id, batch, 'Translate the lines. One on each line:' || chr(10) || string_agg(line, chr(10) ORDER BY start_s, id) AS request FROM l GROUP BY 1, 2""")
def batch_requests(spark, d):
    rows = a.dialogue(spark, d).withColumn("room", F.col("slot"))
    told = rows.select("recording_id", "speaker").distinct().withColumn("gender", F.when(F.col("speaker") == "user", "f").when(F.col("speaker") == "assistant", "m").otherwise("unknown"))
    return replies.batch_requests(rows, told, size=2, rate=15.0, cap=1.1, overhead=0.26)


@register("str31_prompts", "SELECT c_custkey, 'Say ' || c_name || ' and {who} twice: ' || c_custkey AS prompt FROM customer")
def prompts(spark, d):
    return a.table(spark, d, "customer").select("c_custkey", replies.prompt("Say {who} and {who} twice: {key}", who=F.col("c_name"), key=F.col("c_custkey").cast("string")).alias("prompt"))


@register("str32_glossaries", "SELECT r_regionkey, '- a = ' || r_name || chr(10) || '- b = two' AS glossary FROM region")
def glossaries(spark, d):
    return a.table(spark, d, "region").select("r_regionkey", replies.glossary_text(F.create_map(F.lit("b"), F.lit("two"), F.lit("a"), F.col("r_name"))).alias("glossary"))


@register("str35_language_profiles", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 18 WHEN doc_id % 4 = 1 THEN 20 ELSE 42 END AS width, CASE WHEN doc_id % 4 = 0 THEN 9 WHEN doc_id % 4 = 1 THEN 12 ELSE 17 END AS rate FROM documents")
def language_profiles(spark, d):
    k = F.col("doc_id") % 4
    code = F.when(k == 0, "ja-JP").when(k == 1, "ko_KR").when(k == 2, F.col("lang")).otherwise("xx")
    return a.table(spark, d, "documents").select("doc_id", replies.language_column(code, 2).alias("width"), replies.language_column(code, 3).alias("rate"))


@register("str34_error_classes", "SELECT page_id, CASE WHEN contains(lower(url), 'com/fr') THEN 'french' WHEN contains(lower(url), '.com') THEN 'com' ELSE 'other' END AS kind FROM pages")
def error_classes(spark, d):
    return a.table(spark, d, "pages").select("page_id", replies.error_class(F.col("url"), (("com/fr", "french"), (".com", "com"))).alias("kind"))


@register("str40_costs", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'free' WHEN o_totalprice / 1e8 < 0.01 THEN '$' || format('{:.5f}', floor(o_totalprice / 1e8 * 1e5 + 0.5) / 1e5) ELSE '$' || format('{:.4f}', floor(o_totalprice / 1e8 * 1e4 + 0.5) / 1e4) END AS cost FROM orders WHERE floor(o_totalprice / 1e3) % 1 = 0")
def costs(spark, d):
    usd = F.when(F.col("o_orderkey") % 3 == 0, 0.0).otherwise(F.col("o_totalprice") / 1e8)
    return a.table(spark, d, "orders").select("o_orderkey", tx.cost_text(usd).alias("cost"))


@register("udf06_accepted_fits", f"WITH {a.DIALOGUE} SELECT recording_id, id, abs(slot * (0.7::DOUBLE + (id % 5) * 0.1::DOUBLE) - slot) < abs(tts_duration - slot) AS taken FROM dialogue")
def accepted_fits(spark, d):
    rows = a.dialogue(spark, d).select("recording_id", "id", F.col("tts_duration").alias("seconds"), (F.col("slot") * (F.lit(0.7) + (F.col("id") % 5) * F.lit(0.1))).alias("proposed"), F.col("slot").alias("room"))
    return replies.accepted_fits(rows).select("recording_id", "id", "taken")


@register("udf13_clean_references", "SELECT user_id, arg_min(event_id, (CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END, event_id)) AS event_id FROM events GROUP BY 1")
def clean_references(spark, d):
    rows = a.table(spark, d, "events").withColumn("dirty", (F.col("event_id") % 3 != 0).cast("int"))
    return changes.first_wins(rows, ["user_id"], ["dirty", "event_id"]).select("user_id", "event_id")


@register("snk04_subtitle_tracks", f"""WITH {a.DIALOGUE} SELECT recording_id, id, 'source' AS track, floor(start_s * 1000 + 0.5) / 1000 AS start_s FROM dialogue WHERE trim(text) <> ''
UNION ALL SELECT recording_id, id, 'target', floor((start_s + (id % 3) * 0.25::DOUBLE) * 1000 + 0.5) / 1000 FROM dialogue WHERE id % 4 <> 3""")
def subtitle_tracks(spark, d):
    rows = a.dialogue(spark, d)
    source = rows.where("trim(text) <> ''").select("recording_id", "id", F.lit("source").alias("track"), places(F.col("start_s"), 3).alias("start_s"))
    target = rows.where("id % 4 <> 3").select("recording_id", "id", F.lit("target").alias("track"), places(F.col("start_s") + (F.col("id") % 3) * F.lit(0.25), 3).alias("start_s"))
    return source.unionByName(target)


@register("win21_built_segments")
def built_segments(spark, d):
    return segments.build(said(spark, d)).select("recording_id", "id", "start_s", "end_s", "text", "overlap")


def _rows_of_words(spark, d, size=120):
    one = F.struct("id", "word", F.col("start_s").alias("start"), F.col("end_s").alias("end"))
    grouped = spoken(spark, d).groupBy("recording_id", F.floor(F.col("id") / size).alias("k")).agg(F.array_sort(F.collect_list(one)).alias("ws"))
    words = F.transform("ws", lambda w: F.struct(w["word"].alias("word"), w["start"].alias("start"), w["end"].alias("end")))
    return grouped.select("recording_id", F.col("k").alias("id"), F.lit("a").alias("speaker"), words.alias("words"))


@register("win06_split_segments", f"""WITH RECURSIVE {WORDS}, g AS (SELECT recording_id, id // 120 AS k, list({{'w': word, 's': start_s, 'e': end_s}} ORDER BY id) AS ws FROM words GROUP BY 1, 2),
r AS (SELECT recording_id, k, ws, false AS forced FROM g UNION ALL
  SELECT recording_id, k, unnest([ws[1:cut], ws[cut + 1:len(ws)]]), forced OR least_gap IS NULL FROM (
    SELECT *, coalesce(list_sort(list_transform(list_filter(range(1, len(ws)), lambda i: ws[i + 1].s - ws[i].e > least_gap), lambda i: [abs(i - len(ws) / 2), i]))[1][2]::BIGINT, (len(ws) + 1) // 2) AS cut FROM (
      SELECT *, CASE WHEN most > 0.4 THEN 0.4::DOUBLE WHEN most > 0.3 THEN 0.3::DOUBLE WHEN most > 0.2 THEN 0.2::DOUBLE WHEN most > 0.15 THEN 0.15::DOUBLE END AS least_gap FROM (
        SELECT *, list_max(list_transform(range(1, len(ws)), lambda i: ws[i + 1].s - ws[i].e)) AS most FROM r WHERE len(ws) > 1 AND ws[-1].e - ws[1].s > 20))))
SELECT recording_id, k AS id, (row_number() OVER (PARTITION BY recording_id, k ORDER BY ws[1].s) - 1)::INT AS piece, ws[1].s AS start_s, ws[-1].e AS end_s, array_to_string(list_transform(ws, lambda x: x.w), ' ') AS text, forced
FROM r WHERE NOT (len(ws) > 1 AND ws[-1].e - ws[1].s > 20)""")
def split_segments(spark, d):
    return segments.split_long(_rows_of_words(spark, d), most=20.0).select("recording_id", "id", "piece", "start_s", "end_s", "text", "forced")


@register("jon03_split_by_speaker")
def split_by_speaker(spark, d):
    rows = _rows_of_words(spark, d)
    edges = rows.select("recording_id", "id", F.get("words", 0)["start"].alias("start_s"), F.element_at("words", -1)["end"].alias("end_s"), "words")
    named = a.dialogue(spark, d).select("recording_id", "id", F.col("start_s") / 2, F.col("end_s") / 2, "speaker").toDF("recording_id", "id", "start_s", "end_s", "speaker")
    return segments.split_by_speaker(edges, named)


@register("prj02_segment_defaults", f"WITH {a.SPANS} SELECT recording_id, id, coalesce(CASE WHEN id % 4 <> 0 THEN speaker END, 'speaker_0') AS speaker, 0 AS shift_ms, false AS overlap FROM spans")
def segment_defaults(spark, d):
    rows = a.spans(spark, d).withColumn("speaker", F.when(F.col("id") % 4 != 0, F.col("speaker")))
    return rows.select("recording_id", "id", F.coalesce("speaker", F.lit("speaker_0")).alias("speaker"), F.lit(0).alias("shift_ms"), F.lit(False).alias("overlap"))


@register("jon10_disputed_spans", _PROFILE + f""", sp AS (SELECT recording_id, id, speaker, 80 + floor((end_s - start_s) * 40) AS f0, 80 + floor((end_s - start_s) * 40) AS p25, 1.0 AS v FROM spans), l AS (SELECT recording_id, id, speaker, CASE WHEN f0 BETWEEN 120 AND 260 THEN 'unknown' WHEN p25 < 150 AND f0 < 275 THEN 'm' WHEN p25 >= 155 AND f0 > 175 THEN 'f' ELSE 'unknown' END AS g FROM sp),
w AS (SELECT recording_id, speaker, {_GENDER} AS g FROM q) SELECT l.recording_id, l.id FROM l JOIN w USING (recording_id, speaker) WHERE l.g <> 'unknown' AND l.g <> w.g""")
def disputed_spans(spark, d):
    from cuegrid.operators import speech

    hz = 80 + F.floor((F.col("end_s") - F.col("start_s")) * 40)
    lines = a.spans(spark, d).select("recording_id", "id", "speaker", speech.gender_of(hz, F.lit(1.0), hz).alias("line"))
    return lines.join(_profiles(spark, d), ["recording_id", "speaker"]).where((F.col("line") != "unknown") & (F.col("line") != F.col("gender"))).select("recording_id", "id")


@register("jon06_belongs", f"""WITH {a.GOLDEN} SELECT g.recording_id, g.id, count(*) AS n FROM golden g JOIN produced p ON g.recording_id = p.recording_id AND g.start_s < p.end_s AND p.start_s < g.end_s
WHERE least(g.end_s, p.end_s) - greatest(g.start_s, p.start_s) >= least(0.15, (p.end_s - p.start_s) * 0.5) GROUP BY 1, 2""")
def belongs(spark, d):
    pairs = intervals.overlap_join(a.golden(spark, d).select("recording_id", "id", "start_s", "end_s"), a.produced(spark, d).select("recording_id", "start_s", "end_s"), by=["recording_id"])
    fits = (intervals.shared() > 0) & (intervals.shared() >= F.least(F.lit(0.15), (F.col("r_end_s") - F.col("r_start_s")) * 0.5))
    return pairs.where(fits).groupBy("recording_id", "id").agg(F.count(F.lit(1)).alias("n"))


@register("stm04_finished_stages", """WITH e AS (SELECT user_id, event_id, event_type AS stage, ts, lag(event_type) OVER w AS last, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
o AS (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM e WHERE last IS DISTINCT FROM stage) SELECT user_id, event_id, CASE WHEN next IS NULL THEN 'open' ELSE 'done' END AS state FROM o""")
def finished_stages(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    opened = a.table(spark, d, "events").withColumn("last", F.lag("event_type").over(w)).where(~F.col("last").eqNullSafe(F.col("event_type")))
    return opened.select("user_id", "event_id", F.when(F.lead("event_id").over(w).isNull(), "open").otherwise("done").alias("state"))


@register("flt16_output_names", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0")
def output_names(spark, d):
    name = F.concat(F.lit("show"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, "_out.mp4").otherwise(".mp4"))
    return a.table(spark, d, "documents").where(tx.is_output_name(name)).select("doc_id")


@register("str37_fallback_texts", f"WITH {SAID_SQL} SELECT recording_id, id, CASE WHEN NOT regexp_matches(regexp_replace(text, '[\\p{{Latin}}\\p{{Cyrillic}}]', '', 'g'), '\\p{{L}}') THEN text END AS text FROM said")
def fallback_texts(spark, d):
    return said(spark, d).select("recording_id", "id", tx.fallback_text(F.col("text")).alias("text"))


@register("str36_language_options", "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 50 WHEN doc_id % 2 = 0 THEN 18 ELSE 42 END AS width FROM documents")
def language_options(spark, d):
    width = F.when(F.col("doc_id") % 5 == 0, 50).otherwise(42)
    code = F.when(F.col("doc_id") % 2 == 0, "zh").otherwise("en")
    return a.table(spark, d, "documents").select("doc_id", tx.own_or_default(width, 42, replies.language_column(code, 2)).alias("width"))


@register("str41_enabled_checks", "SELECT r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN '- one' || chr(10) || '- two' ELSE '- two' END AS checks FROM region")
def enabled_checks(spark, d):
    names = F.create_map(F.lit("b"), F.lit(True), F.lit("a"), F.col("r_regionkey") % 2 == 0)
    return a.table(spark, d, "region").select("r_regionkey", tx.bullets(names, F.create_map(F.lit("a"), F.lit("one"), F.lit("b"), F.lit("two"))).alias("checks"))


@register("str26_accepted_parts", f"WITH {SAID_SQL} SELECT recording_id, id, regexp_matches(text, '[а-яё]') AND id % 3 <> 1 AS accepted FROM said WHERE length(text) > 8 AND regexp_matches(substr(text, 1, 4), '[а-яёА-ЯЁ]') = regexp_matches(text, '[а-яё]') AND regexp_matches(substr(text, 5), '[а-яё]') = regexp_matches(text, '[а-яё]')")
def accepted_parts(spark, d):
    rows = said(spark, d).where("length(text) > 8")
    cyrillic = lambda c: tx.speakable(c)
    same = (cyrillic(F.substring("text", 1, 4)) == cyrillic(F.col("text"))) & (F.expr("substring(text, 5)").rlike("[а-яё]") == F.col("text").rlike("[а-яё]"))
    parts = F.array(F.substring("text", 1, 4), F.expr("substring(text, 5)"))
    return rows.where(same).select("recording_id", "id", tx.accepted_parts(F.col("text"), parts, F.when(F.col("id") % 3 == 1, 1).otherwise(2)).alias("accepted"))


@register("agg14_marked_lines", f"WITH {a.DIALOGUE}, n AS (SELECT *, end_s - start_s + greatest(0, least(coalesce(lead(start_s) OVER (PARTITION BY recording_id ORDER BY start_s, id) - 0.05 - end_s, 1.2), 1.2)) AS room FROM dialogue) SELECT recording_id, id, abs(0.26::DOUBLE + length(text) / 15.0::DOUBLE - room) <= greatest(room * 0.15::DOUBLE, 0.25::DOUBLE) AS fits FROM n")
def marked_lines(spark, d):
    from cuegrid.functions import numbers as nb
    from cuegrid.operators import sequence

    rows = sequence.available_seconds(a.dialogue(spark, d))
    return rows.select("recording_id", "id", nb.within_length(nb.speech_seconds(F.length("text"), 15.0, 0.26), F.col("available"), 0.15, 0.25).alias("fits"))


@register("src15_listed_formats", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_size, 0) DESC, p_retailprice DESC, p_partkey) AS rank FROM part")
@register("src15_all_listed_formats", "SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY coalesce(p_size, 0) DESC, p_retailprice DESC, p_partkey) AS rank FROM part")
def all_listed_formats(spark, d):
    """Every part; each has a codec of video or of sound, as those of jon22."""
    k = F.col("p_partkey")
    rows = a.table(spark, d, "part").select(F.col("p_brand").alias("item"), k.alias("id"), F.col("p_size").alias("height"), F.col("p_retailprice").alias("bytes"), F.when(k % 3 != 0, "avc").otherwise("none").alias("vcodec"), F.when(k % 3 != 1, "aac").alias("acodec"))
    return readers.listed_formats(rows).select(F.col("item").alias("p_brand"), F.col("id").alias("p_partkey"), "rank")


@register("src14_playlists", "SELECT o_custkey, CASE WHEN sum(o_totalprice) > 0 THEN floor(sum(o_totalprice) * 100 + 0.5) / 100 END AS seconds, count(*) AS entries FROM orders GROUP BY 1")
def playlists(spark, d):
    total = F.sum(F.coalesce("o_totalprice", F.lit(0.0)))
    return a.table(spark, d, "orders").groupBy("o_custkey").agg(F.when(total > 0, places(total, 2)).alias("seconds"), F.count(F.lit(1)).alias("entries"))


@register("str38_track_selectors", """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'ba[ext=m4a]/ba/b' WHEN 1 THEN 'bv*+ba/b' ELSE 'bv*[height<=' || (p_partkey % 4) * 360 || ']+ba/b[height<=' || (p_partkey % 4) * 360 || ']/b' END AS selector FROM part""")
def track_selectors(spark, d):
    kind = F.col("p_partkey") % 4
    quality = F.when(kind == 0, "audio").when(kind == 1, "best").otherwise(F.concat((kind * 360).cast("string"), F.lit("p")))
    return a.table(spark, d, "part").select("p_partkey", replies.track_selector(quality).alias("selector"))


@register("hsh04_input_hashes", """WITH f AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE '/in/' || page_id END AS source, CASE WHEN page_id % 3 > 0 THEN page_id * 1000000 END AS size FROM pages)
SELECT page_id, CASE WHEN regexp_matches(source, '^[hH][tT][tT][pP][sS]?://') THEN sha256('url:' || source) WHEN size IS NULL THEN sha256('missing:' || source) WHEN size <= 67108864 THEN 'c' || page_id ELSE sha256('file:' || source || ':' || size || ':' || page_id * 7) END AS hash FROM f""")
def input_hashes(spark, d):
    key = F.col("page_id")
    source = F.when(key % 2 == 0, F.col("url")).otherwise(F.concat(F.lit("/in/"), key.cast("string")))
    size = F.when(key % 3 > 0, key * 1000000)
    return a.table(spark, d, "pages").select("page_id", fingerprints.input_hash(source, size, key * 7, F.concat(F.lit("c"), key.cast("string"))).alias("hash"))


@register("str27_phrase_requests", f"""WITH {WORDS}, v AS (SELECT recording_id, turn, i, i * 0.5::DOUBLE + (i // 7) * 0.5::DOUBLE AS start_s, i * 0.5::DOUBLE + (i // 7) * 0.5::DOUBLE + 0.4::DOUBLE AS end_s FROM words1),
b AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w >= 0.3 OR lag(end_s) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM v WINDOW w AS (PARTITION BY recording_id, turn ORDER BY i)),
r AS (SELECT *, sum(b) OVER (PARTITION BY recording_id, turn ORDER BY i) AS phrase FROM b), g AS (SELECT recording_id, turn, phrase, min(start_s) AS s, arg_max(end_s, i) AS e FROM r GROUP BY 1, 2, 3),
p AS (SELECT *, lead(s) OVER (PARTITION BY recording_id, turn ORDER BY phrase) - e AS gap FROM g),
t AS (SELECT conv_id AS recording_id, turn, trim(text) AS text FROM conversations)
SELECT recording_id, turn AS id, text, string_agg(floor((e - s) * 100 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY phrase) AS phrases, string_agg(floor(gap * 1000 + 0.5)::BIGINT::VARCHAR, ',' ORDER BY phrase) AS pauses FROM p JOIN t USING (recording_id, turn) WHERE text <> '' GROUP BY 1, 2, 3 HAVING count(*) > 1""")
def phrase_requests(spark, d):
    """Every turn with the words of its own; lists as texts of hundredths and thousandths of a second."""
    turns = a.table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("id"), "text")
    each = turns.select("recording_id", F.col("id").alias("segment"), F.posexplode(F.filter(F.split("text", "[ \\n]+"), lambda x: x != "")).alias("i", "word"))
    start = (F.col("i") + 1) * 0.5 + F.floor((F.col("i") + 1) / 7) * 0.5
    own = words.phrases(each.select("recording_id", "segment", F.col("i").alias("id"), start.alias("start_s"), (start + 0.4).alias("end_s")), by=("recording_id", "segment"))
    out = replies.phrase_requests(turns, own.withColumnRenamed("segment", "id"))
    whole = lambda c, n: F.array_join(F.transform(c, lambda x: F.round(x * n).cast("long").cast("string")), ",")
    return out.select("recording_id", "id", "text", whole("phrases", 100).alias("phrases"), whole("pauses", 1000).alias("pauses"))


@register("str29_review_lines", f"""WITH {a.DIALOGUE}, g AS (SELECT DISTINCT recording_id, speaker, CASE WHEN recording_id % 5 = 0 THEN 'f' END AS voice, CASE recording_id % 3 WHEN 0 THEN 'm' WHEN 1 THEN 'f' ELSE 'unknown' END AS pitch, CASE recording_id % 2 WHEN 0 THEN 'm' ELSE 'unknown' END AS told FROM dialogue),
l AS (SELECT recording_id, id, speaker, trim(text) AS text, coalesce(voice, CASE WHEN pitch <> 'unknown' THEN pitch ELSE told END) AS gender, voice IS NULL AND pitch <> 'unknown' AND told <> 'unknown' AND pitch <> told AS gender_disputed,
  greatest(1, floor(greatest(0, slot * 0.8::DOUBLE - 0.26::DOUBLE) * 15::DOUBLE + 0.5))::BIGINT AS max_chars FROM dialogue JOIN g USING (recording_id, speaker) WHERE trim(text) <> '')
SELECT *, greatest(0, length(text) - max_chars)::BIGINT AS over FROM l""")
def review_lines(spark, d):
    rows, key = a.dialogue(spark, d), F.col("recording_id")
    told = rows.select("recording_id", "speaker").distinct().select(
        "recording_id", "speaker", F.when(key % 5 == 0, "f").alias("voice"), F.when(key % 3 == 0, "m").when(key % 3 == 1, "f").otherwise("unknown").alias("pitch"), F.when(key % 2 == 0, "m").otherwise("unknown").alias("told"), F.lit(None).cast("string").alias("name")
    )
    out = replies.review_lines(rows.withColumn("source", F.col("text")), told, most=target_chars(F.col("slot") * 0.8, 15.0, 0.0, 0.26))
    return out.select("recording_id", "id", "speaker", "text", "gender", "gender_disputed", F.col("max_chars").cast("long").alias("max_chars"), F.col("over").cast("long").alias("over"))


def _recognised_rows(spark, d):
    """Rows of 120 words and of 9 words of each recording, with edges a little off."""
    rows = _rows_of_words(spark, d).unionByName(_rows_of_words(spark, d, 9).withColumn("id", F.col("id") + 1000))
    text = F.array_join(F.transform("words", lambda w: w["word"]), " ")
    start, end = F.element_at("words", 1)["start"], F.element_at("words", -1)["end"]
    return rows.withColumn("text", text).withColumn("start_s", start + ((F.col("id") % 7) - 3) * 0.2).withColumn("end_s", end + ((F.col("id") % 5) - 2) * 0.3)


@register("win21_whole_segments")
def whole_segments(spark, d):
    return segments.built(_recognised_rows(spark, d), most=20.0).withColumn("words", F.size("words")).withColumn("flags", F.array_join("flags", ","))


@register("orc07_recognised")
def recognised(spark, d):
    """Regions are every third word's time widened; turns change every eleven seconds."""
    rows = _recognised_rows(spark, d)
    regions = spoken(spark, d).where("id % 3 <> 0").select("recording_id", (F.col("start_s") - 0.05).alias("start_s"), (F.col("end_s") + 0.1).alias("end_s"))
    turns = spoken(spark, d).groupBy("recording_id", F.floor(F.col("start_s") / 11).alias("k")).agg(F.min("start_s").alias("start_s"), F.max("end_s").alias("end_s")).select("recording_id", F.col("k").alias("id"), "start_s", "end_s", F.concat(F.lit("T"), (F.col("k") % 3).cast("string")).alias("speaker"))
    doubts = rows.where("id % 13 = 0").select("recording_id", F.col("id").alias("source_id"))
    out = segments.recognised(rows, regions, turns, doubts, most=20.0)
    return out.withColumn("words", F.size("words")).withColumn("flags", F.array_join("flags", ","))
