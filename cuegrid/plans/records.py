"""Queries over parsed records, words, pauses and fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid import plugins
from cuegrid.functions.numbers import places
from cuegrid.operators import fingerprints, sequence, signal, words
from cuegrid.plans.registry import Registry
from cuegrid.sources import adapters as a
from cuegrid.sources import readers

register = Registry()

#: A conversation's words, spoken evenly from its start; every seventh is followed by a pause of half a second.
WORDS = """words0 AS (SELECT conv_id AS recording_id, turn, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS ws FROM conversations),
words1 AS (SELECT recording_id, turn, i, ws[i] AS word FROM words0, unnest(range(1, len(ws) + 1)) AS t(i)),
words2 AS (SELECT recording_id, word, row_number() OVER (PARTITION BY recording_id ORDER BY turn, i) AS id FROM words1),
words AS (SELECT recording_id, id, word, id * 0.5::DOUBLE + (id // 7) * 0.5::DOUBLE AS start_s, id * 0.5::DOUBLE + (id // 7) * 0.5::DOUBLE + 0.4::DOUBLE AS end_s FROM words2)"""


def spoken(spark, d) -> DataFrame:
    # Words are numbered by the turns' sizes, so that texts meet by recording and not words. Turns of one number take turns word by word.
    talk = a.table(spark, d, "conversations").select(F.col("conv_id").alias("recording_id"), "turn", F.filter(F.split("text", "[ \\n]+"), lambda x: x != "").alias("ws"))
    by, equal = Window.partitionBy("recording_id"), Window.partitionBy("recording_id", "turn")
    size = F.greatest(F.size("ws"), F.lit(0)).cast("long")
    talk = talk.withColumn("before", F.sum(size).over(by.orderBy("turn")) - F.sum(size).over(equal)).withColumn("sizes", F.collect_list(size).over(equal.orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    talk = talk.withColumn("nth", F.row_number().over(equal.orderBy("turn")))
    rows = talk.select("recording_id", "before", "sizes", "nth", F.posexplode("ws").alias("i", "word"))
    i = F.col("i").cast("long")
    dealt = F.aggregate("sizes", F.lit(0).cast("long"), lambda s, n: s + F.least(n, i)) + F.aggregate(F.slice("sizes", F.lit(1), F.col("nth") - 1), F.lit(0).cast("long"), lambda s, n: s + (n > i).cast("long"))
    id_ = (F.col("before") + 1 + F.when(F.size("sizes") == 1, i).otherwise(dealt)).cast("long")
    rows = rows.select("recording_id", id_.alias("id"), "word")
    start = F.col("id") * 0.5 + F.floor(F.col("id") / 7) * 0.5
    return rows.select("recording_id", "id", "word", start.alias("start_s"), (start + 0.4).alias("end_s"))


@register("win08_original_pauses", f"WITH {WORDS}, n AS (SELECT *, lead(start_s) OVER (PARTITION BY recording_id ORDER BY id) AS n FROM words) SELECT recording_id, id, floor(end_s * 1000 + 0.5) / 1000 AS start_s, floor(n * 1000 + 0.5) / 1000 AS end_s FROM n WHERE n - end_s >= 0.3")
def original_pauses(spark, d):
    return words.pauses(spoken(spark, d)).select("recording_id", "id", places(F.col("start_s"), 3).alias("start_s"), places(F.col("end_s"), 3).alias("end_s"))


@register("win09_source_phrases", f"""WITH {WORDS}, b AS (SELECT *, CASE WHEN start_s - lag(end_s) OVER w >= 0.3 OR lag(end_s) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY id)),
r AS (SELECT *, sum(b) OVER (PARTITION BY recording_id ORDER BY id) AS phrase FROM b), g AS (SELECT recording_id, phrase, min(start_s) AS start_s, arg_max(end_s, id) AS end_s FROM r GROUP BY 1, 2),
p AS (SELECT *, lead(start_s) OVER (PARTITION BY recording_id ORDER BY phrase) - end_s AS gap, count(*) OVER (PARTITION BY recording_id) AS n FROM g)
SELECT recording_id, phrase::BIGINT AS phrase, floor(start_s * 1000 + 0.5) / 1000 AS start_s, floor(end_s * 1000 + 0.5) / 1000 AS end_s, coalesce(floor(gap * 1000 + 0.5) / 1000, 0) AS pause_after FROM p WHERE n > 1""")
def source_phrases(spark, d):
    return words.phrases(spoken(spark, d)).select("recording_id", "phrase", places(F.col("start_s"), 3).alias("start_s"), places(F.col("end_s"), 3).alias("end_s"), "pause_after")


@register("win05_sentences", f"""WITH RECURSIVE {WORDS}, p AS (SELECT *, coalesce(regexp_matches(lag(word) OVER w, '[.!?…]["»”)\\]]*$') OR start_s - lag(end_s) OVER w > 0.7, true) AS cut FROM words WINDOW w AS (PARTITION BY recording_id ORDER BY id)),
f AS (SELECT recording_id, id, start_s AS begun, 0 AS sentence FROM p WHERE id = 1
  UNION ALL SELECT p.recording_id, p.id, CASE WHEN cut OR end_s - begun > 4 THEN start_s ELSE begun END, sentence + CASE WHEN cut OR end_s - begun > 4 THEN 1 ELSE 0 END FROM f JOIN p ON p.recording_id = f.recording_id AND p.id = f.id + 1)
SELECT recording_id, id, sentence FROM f""")
def sentences(spark, d):
    return sequence.sentences(spoken(spark, d), most_seconds=4.0).select("recording_id", "id", "sentence")


@register("str02_refined_edges", f"""WITH {WORDS}, s AS (SELECT recording_id, id // 10 AS part, min(start_s) AS a, max(end_s) AS z FROM words GROUP BY 1, 2), e AS (SELECT *, a + ((part % 7) - 3) * 0.15::DOUBLE AS start_s, z + ((part % 5) - 2) * 0.2::DOUBLE AS end_s FROM s),
r AS (SELECT *, CASE WHEN abs(a - start_s) <= 0.25 THEN a ELSE start_s END AS rs, CASE WHEN abs(z - end_s) <= 0.25 THEN z ELSE end_s END AS re FROM e)
SELECT recording_id, part, floor(CASE WHEN re > rs THEN rs ELSE start_s END * 1000 + 0.5) / 1000 AS refined_start, floor(CASE WHEN re > rs THEN re ELSE end_s END * 1000 + 0.5) / 1000 AS refined_end FROM r""")
def refined_edges(spark, d):
    own = F.array_sort(F.collect_list(F.struct(F.col("start_s").alias("start"), F.col("end_s").alias("end"))))
    rows = spoken(spark, d).groupBy("recording_id", F.floor(F.col("id") / 10).alias("part")).agg(F.min("start_s").alias("a"), F.max("end_s").alias("z"), own.alias("words"))
    rows = rows.withColumn("start_s", F.col("a") + ((F.col("part") % 7) - 3) * 0.15).withColumn("end_s", F.col("z") + ((F.col("part") % 5) - 2) * 0.2)
    out = words.refined(rows, window=0.25)
    return out.select("recording_id", "part", places(F.col("refined_start"), 3).alias("refined_start"), places(F.col("refined_end"), 3).alias("refined_end"))


@register("top01_spread_plan", f"""WITH {a.SPANS}, l AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY end_s - start_s DESC, start_s) AS n, (recording_id % 10) * 0.1::DOUBLE AS slack FROM spans),
c AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY start_s, end_s) AS k, count(*) OVER (PARTITION BY recording_id) AS m FROM l WHERE n <= 2 AND slack > 0.08),
s AS (SELECT *, least(0.4, slack / m) AS share FROM c)
SELECT recording_id, floor((start_s + end_s) / 2 * 1000 + 0.5) / 1000 AS at, floor(share * 1000 + 0.5) / 1000 AS seconds FROM s WHERE share >= 0.08""")
def spread_plan(spark, d):
    return words.spread(a.spans(spark, d).select("recording_id", "start_s", "end_s"), (F.col("recording_id") % 10) * 0.1)


#: Words of one JSON text.
BLOCK_WORDS = 400


def _blocks(spark, d, body) -> DataFrame:
    """One JSON text for each block of a recording's words, with the place of its first word."""
    first = F.floor((F.col("id") - 1) / BLOCK_WORDS) * BLOCK_WORDS
    rows = spoken(spark, d).groupBy("recording_id", first.alias("first")).agg(F.array_sort(F.collect_list(F.struct("id", body.alias("x")))).alias("xs"))
    return rows.withColumn("xs", F.transform("xs", lambda x: x["x"]))


def _plain_item():
    return F.struct("word", F.col("start_s").alias("start"), (F.col("end_s") + F.col("id") % 4).alias("end"))


def _plain(items: DataFrame) -> DataFrame:
    return items.withColumn("json", F.to_json(F.struct(F.col("xs").alias("words")))).drop("xs")


@register("src05_plain_words", f"WITH {WORDS} SELECT recording_id, id - 1 AS pos, word, start_s, least(end_s + (id % 4), start_s + 2.5) AS end_s FROM words WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]')")
@register("src05_all_plain_words", f"WITH {WORDS} SELECT recording_id, id - 1 AS pos, word, start_s, least(end_s + (id % 4), start_s + 2.5) AS end_s FROM words WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]')")
def all_plain_words(spark, d):
    return readers.plain_words(_plain(_blocks(spark, d, _plain_item())))


@register("src04_stamped_words", f"""WITH {WORDS}, t AS (SELECT *, CASE WHEN id % 3 <> 0 THEN floor(start_s * 100) / 100 + 0.05::DOUBLE END AS stamp FROM words), n AS (SELECT *, lead(stamp) OVER (PARTITION BY recording_id ORDER BY id) AS later FROM t WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]'))
SELECT recording_id, id - 1 AS pos, word, floor(coalesce(stamp, start_s) * 1000 + 0.5) / 1000 AS start_s, floor(CASE WHEN stamp IS NULL THEN least(end_s, start_s + 2.5) ELSE
  least(coalesce(least(CASE WHEN end_s > stamp THEN end_s END, CASE WHEN later > stamp THEN later END), stamp + 0.3), stamp + 2.5) END * 1000 + 0.5) / 1000 AS end_s FROM n""")
@register("src04_all_stamped_words", f"""WITH {WORDS}, t AS (SELECT *, CASE WHEN id % 3 <> 0 THEN floor(start_s * 100) / 100 + 0.05::DOUBLE END AS stamp FROM words), n AS (SELECT *, lead(stamp) OVER (PARTITION BY recording_id ORDER BY id) AS later FROM t WHERE regexp_matches(word, '[\\p{{L}}\\p{{N}}]'))
SELECT recording_id, id - 1 AS pos, word, floor(coalesce(stamp, start_s) * 1000 + 0.5) / 1000 AS start_s, floor(CASE WHEN stamp IS NULL THEN least(end_s, start_s + 2.5) ELSE
  least(coalesce(least(CASE WHEN end_s > stamp THEN end_s END, CASE WHEN later > stamp THEN later END), stamp + 0.3), stamp + 2.5) END * 1000 + 0.5) / 1000 AS end_s FROM n""")
def all_stamped_words(spark, d):
    return _stamped(_blocks(spark, d, _stamped_item()))


def _stamped_item():
    stamp = F.when(F.col("id") % 3 != 0, F.array(F.struct((F.floor(F.col("start_s") * 100) + 5).cast("double").alias("t_dtw")), F.struct(F.lit(-1.0).alias("t_dtw"))))
    return F.struct(F.col("word").alias("text"), F.struct((F.col("start_s") * 1000).alias("from"), (F.col("end_s") * 1000).alias("to")).alias("offsets"), stamp.alias("tokens"))


def _stamped(items: DataFrame) -> DataFrame:
    files = items.withColumn("json", F.to_json(F.struct(F.col("xs").alias("transcription")))).drop("xs")
    return readers.stamped_words(files).select("recording_id", "pos", "word", places(F.col("start_s"), 3).alias("start_s"), places(F.col("end_s"), 3).alias("end_s"))


@register("src06_cached_turns", f"WITH {a.SPANS}, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY id) - 1 AS pos FROM spans WHERE recording_id % 3 = 1) SELECT recording_id, pos, speaker FROM n WHERE end_s > start_s")
def cached_turns(spark, d):
    own = F.transform(F.array_sort(F.collect_list(F.struct("id", "start_s", "end_s", "speaker"))), lambda x: F.struct(x["start_s"].alias("start"), x["end_s"].alias("end"), x["speaker"].alias("speaker")))
    files = a.spans(spark, d).groupBy("recording_id").agg(own.alias("turns")).select("recording_id", F.to_json(F.struct((F.col("recording_id") % 3).cast("string").alias("fingerprint"), "turns")).alias("json"))
    return readers.cached_turns(files, F.lit("1")).select("recording_id", F.col("pos").cast("long").alias("pos"), "speaker")


@register("src12_parse_catalogue", "SELECT 'm' || p_partkey AS id, p_name AS name, p_size::BIGINT AS context, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_retailprice END AS prompt_price, CASE WHEN p_partkey % 7 = 0 THEN 0 ELSE p_size END::DOUBLE AS completion_price, p_partkey % 35 = 0 AS free FROM part WHERE p_partkey % 4 <> 3")
def parse_catalogue(spark, d):
    price = F.struct(F.when(F.col("p_partkey") % 5 == 0, "none").otherwise(F.col("p_retailprice").cast("string")).alias("prompt"), F.when(F.col("p_partkey") % 7 == 0, F.lit(None)).otherwise(F.col("p_size").cast("string")).alias("completion"))
    out = F.when(F.col("p_partkey") % 4 == 1, F.array(F.lit("text"))).when(F.col("p_partkey") % 4 == 3, F.array(F.lit("text"), F.lit("image")))
    item = F.struct(F.concat(F.lit("m"), "p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("context_length"), price.alias("pricing"), F.struct(out.alias("output_modalities")).alias("architecture"))
    return readers.catalogue(a.table(spark, d, "part").select(F.to_json(F.struct(F.array(item).alias("data"))).alias("json")))


@register("jon22_download_estimate", """WITH f AS (SELECT p_brand AS item, p_partkey AS ord, p_size AS height, CASE WHEN p_partkey % 9 <> 0 THEN (p_retailprice * 100)::BIGINT END AS bytes, p_partkey % 3 <> 0 AS v, p_partkey % 3 <> 1 AS au FROM part),
b AS (SELECT item, arg_max({'h': height, 'b': bytes}, (coalesce(height, 0), ord)) FILTER (au AND NOT v) AS a, arg_max({'h': height, 'b': bytes}, (coalesce(height, 0), ord)) FILTER (v AND NOT au AND height <= 30) AS v, arg_max({'h': height, 'b': bytes}, (coalesce(height, 0), ord)) FILTER (v AND au) AS m FROM f GROUP BY 1)
SELECT item, CASE WHEN v IS NOT NULL THEN v.h ELSE m.h END AS height, CASE WHEN v IS NOT NULL THEN v.b + a.b ELSE m.b END AS bytes FROM b""")
def download_estimate(spark, d):
    k = F.col("p_partkey")
    rows = a.table(spark, d, "part").select(F.col("p_brand").alias("item"), k.alias("ord"), F.col("p_size").alias("height"), F.when(k % 9 != 0, (F.col("p_retailprice") * 100 + F.lit(0.5)).cast("long")).alias("bytes"), (k % 3 != 0).alias("has_video"), (k % 3 != 1).alias("has_audio"))
    return readers.download_estimate(rows, 30)


@register("src18_media_info", "SELECT o_orderkey AS recording_id, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS duration, o_orderkey % 4 = 1 AS has_video, o_orderkey % 5 <> 0 AS has_audio, CASE WHEN o_orderkey % 5 <> 0 THEN 2 END AS channels, CASE WHEN o_orderkey % 5 <> 0 THEN 48000 END AS rate FROM orders")
def media_info(spark, d):
    k = F.col("o_orderkey")
    length = F.when(k % 3 == 0, F.lit('"n/a"')).otherwise(F.concat(F.lit('"'), F.col("o_totalprice").cast("string"), F.lit('"')))
    video = F.concat(F.lit('{"codec_type":"video","disposition":{"attached_pic":'), F.when(k % 4 == 1, "0").otherwise("1"), F.lit("}}"))
    sound = F.when(k % 5 != 0, F.lit(',{"codec_type":"audio","channels":2,"sample_rate":"48000"},{"codec_type":"audio","channels":6,"sample_rate":"44100"}')).otherwise(F.lit(""))
    return readers.media_info(a.table(spark, d, "orders").select(k.alias("recording_id"), F.concat(F.lit('{"format":{"duration":'), length, F.lit('},"streams":['), video, sound, F.lit("]}")).alias("json")))


@register("src03_overrides", "SELECT c_custkey AS recording_id, CASE WHEN c_custkey % 3 <> 0 THEN 1 ELSE 0 END AS voices, 1 AS names, CASE c_custkey % 3 WHEN 0 THEN 'off' WHEN 1 THEN '7' END AS ref FROM customer")
def overrides(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit('{"voices":{"a":"'), F.when(k % 3 == 0, "  ").otherwise(" low "), F.lit('"},"names":{"a":"Ann   B"},"refs":{"a":"'), F.when(k % 3 == 0, "off").when(k % 3 == 1, "7").otherwise("-2"), F.lit('"}}'))
    out = readers.overrides(a.table(spark, d, "customer").select(k.alias("recording_id"), text.alias("json")))
    ref = F.col("refs")["a"]
    return out.select("recording_id", F.size("voices").alias("voices"), F.size("names").alias("names"), F.when(ref["off"], "off").otherwise(ref["id"].cast("string")).alias("ref"))


@register("hsh09_chained_fingerprints", "SELECT p_partkey, sha256(sha256(sha256('s|' || p_name) || '|' || p_type) || '|' || p_brand) AS hash FROM part")
def chained(spark, d):
    first = F.sha2(F.concat(F.lit("s|"), F.col("p_name")), 256)
    return a.table(spark, d, "part").select("p_partkey", fingerprints.chained(first, F.array("p_type", "p_brand")).alias("hash"))


@register("hsh06_turn_fingerprints", "SELECT doc_id, sha256(text) || '|large|4' AS print FROM documents WHERE text IS NOT NULL")
def turn_fingerprints(spark, d):
    return a.table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", fingerprints.diarization(F.sha2("text", 256), "large", 4).alias("print"))


@register("hsh10_stage_inputs", """WITH j AS (SELECT conv_id, turn, '{"turn":' || turn || ',"role":"' || role || '"}' AS j FROM conversations), b AS (SELECT conv_id, turn // 1000 AS b, sha256(string_agg(j, chr(10) ORDER BY turn)) AS j FROM j GROUP BY 1, 2)
SELECT conv_id, sha256(string_agg(j, chr(10) ORDER BY b)) AS hash FROM b GROUP BY 1""")
def stage_inputs(spark, d):
    return fingerprints.rows_hash(a.table(spark, d, "conversations"), ["conv_id"], ["turn"], ["turn", "role"])


def _fold_sql(k: int) -> str:
    """y{k}: the logarithms moved towards the centre c{k}; c{k + 1}: their upper median."""
    return f"""y{k} AS (SELECT l.*, CASE WHEN abs(x - c - 1) <= 2 / 12::DOUBLE THEN x - 1 WHEN abs(x - c + 1) <= 2 / 12::DOUBLE THEN x + 1 ELSE x END AS y FROM l JOIN c{k} USING (recording_id, speaker)),
c{k + 1} AS (SELECT recording_id, speaker, list_sort(list(y))[count(*) // 2 + 1] AS c FROM y{k} GROUP BY 1, 2)"""


@register("agg06_octaves_folded", f"""WITH {a.SPANS}, l AS (SELECT recording_id, speaker, log2((100 + floor((end_s - start_s) * 4) + CASE WHEN id % 17 = 0 THEN 110 WHEN id % 19 = 0 THEN 330 ELSE 0 END)::DOUBLE) AS x FROM spans),
t AS (SELECT recording_id, speaker, floor(x * 12 + 0.5) AS tone, count(*) AS k FROM l GROUP BY 1, 2, 3),
m AS (SELECT t.recording_id, t.speaker, t.tone, 2 * t.k + coalesce(u.k, 0) + coalesce(o.k, 0) AS mass FROM t LEFT JOIN t u ON u.recording_id = t.recording_id AND u.speaker = t.speaker AND u.tone = t.tone - 1 LEFT JOIN t o ON o.recording_id = t.recording_id AND o.speaker = t.speaker AND o.tone = t.tone + 1),
c0 AS (SELECT recording_id, speaker, arg_min(tone, [-mass, tone]) / 12::DOUBLE AS c FROM m GROUP BY 1, 2),
{", ".join(_fold_sql(k) for k in range(4))}
SELECT recording_id, speaker, floor(pow(2, y) * 1000 + 0.5)::BIGINT AS mhz FROM y3""")
def octaves_folded(spark, d):
    """Pitches of which some lie an octave off and others two; thousandths of a Hz."""
    hz = 100 + F.floor((F.col("end_s") - F.col("start_s")) * 4) + F.when(F.col("id") % 17 == 0, 110).when(F.col("id") % 19 == 0, 330).otherwise(0)
    out = signal.octaves_folded(a.spans(spark, d).select("recording_id", "speaker", hz.cast("double").alias("hz")))
    return out.select("recording_id", "speaker", F.floor(F.col("hz") * 1000 + 0.5).cast("long").alias("mhz"))


@register("udf04_translated")
@register("udf04_all_translated")
def all_translated(spark, d):
    """Every text of every conversation."""
    rows = a.table(spark, d, "conversations")
    return plugins.translated(rows.select(F.col("conv_id").alias("recording_id"), F.col("turn").alias("id"), F.floor(F.col("turn") / 4).alias("batch"), "text"))
