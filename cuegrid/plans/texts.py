"""Queries over texts: filters, repairs, cues, subtitles, gender told by words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import fixed, text
from cuegrid.functions.numbers import places
from cuegrid.operators import cues, gender
from cuegrid.plans.registry import Registry
from cuegrid.sources import adapters as a

register = Registry()

#: Lines that the tables don't hold, put in the place of the dialogue's own in turn.
SAID = (
    "[music]", "(applause)", "...", "Thanks for watching", "Я сказал это вчера, Анна", "Ты пришла поздно, Иван", "Я рада. Ты должен идти", "see www.example.com now", "자막은",
    "hello there hello there hello there", "Subtitles by someone", "Я пошла домой — Пётр", "Thank you for watching!", "Plain words of a line.", "ha ha ha ha ha ha", "Ты сам мог",
)
_SAID = "[" + ", ".join("'" + s.replace("'", "''") + "'" for s in SAID) + "]"
SAID_SQL = f"{a.DIALOGUE}, said AS (SELECT * REPLACE ({_SAID}[(recording_id * 7 + id) % {len(SAID)} + 1] AS text) FROM dialogue)"


def said(spark, d) -> DataFrame:
    return a.dialogue(spark, d).withColumn("text", F.element_at(F.array(*[F.lit(s) for s in SAID]), ((F.col("recording_id") * 7 + F.col("id")) % len(SAID) + 1).cast("int")))


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


@register("prj03_normalized_text", f"WITH {a.LINES} SELECT recording_id, id, trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS text FROM lines")
def normalized(spark, d):
    return a.lines(spark, d).select("recording_id", "id", text.collapsed(F.col("text")).alias("text"))


@register("flt01_speech_lines", f"""WITH {SAID_SQL} SELECT recording_id, id, text FROM said
WHERE NOT (trim(text) = '' OR regexp_matches(trim(text), '{fixed.NON_SPEECH}') OR NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]'))""")
def speech_lines(spark, d):
    return said(spark, d).where(~text.is_non_speech(F.col("text"))).select("recording_id", "id", "text")


_MADE_UP = " OR ".join(f"regexp_matches(t, '{p}')" for p in (*fixed.MADE_UP_PATTERNS, "^by\\s+[\\p{Hangul}\\p{Han}\\p{Hiragana}\\p{Katakana}\\p{Cyrillic}]"))


@register("flt02_made_up_lines", f"""WITH {SAID_SQL}, n AS (SELECT *, trim(text) AS t, lower(regexp_replace(regexp_replace(trim(text), '[\\p{{P}}\\s]+$', ''), '(\\p{{Hangul}})(은|는|이|가|을|를|도|만)$', '\\1')) AS bare,
  trim(regexp_replace(regexp_replace(lower(trim(text)), '[\\p{{P}}\\p{{S}}]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS norm FROM said)
SELECT recording_id, id, text FROM n WHERE bare IN ({_quoted(fixed.MADE_UP_FRAGMENTS)}) OR norm IN ({_quoted(fixed.MADE_UP_LINES)}) OR {_MADE_UP}""")
def made_up_lines(spark, d):
    return said(spark, d).where(text.is_made_up(F.col("text"))).select("recording_id", "id", "text")


@register("flt03_speakable", f"WITH {SAID_SQL} SELECT recording_id, id FROM said WHERE regexp_matches(text, '[а-яёА-ЯЁ]')")
def speakable(spark, d):
    return said(spark, d).where(text.speakable(F.col("text"))).select("recording_id", "id")


@register("flt08_continues_phrase", f"""WITH {a.DIALOGUE}, p AS (SELECT recording_id, id, start_s - lag(end_s) OVER w AS gap, trim(lag(text) OVER w) AS told FROM dialogue WINDOW w AS (PARTITION BY recording_id ORDER BY start_s, id))
SELECT recording_id, id, coalesce(gap <= 0.6 AND told <> '' AND NOT regexp_matches(told, '[.!?…]["»”)\\]]*$'), false) AS continues FROM p""")
def continues(spark, d):
    w = Window.partitionBy("recording_id").orderBy("start_s", "id")
    told = F.trim(F.lag("text").over(w))
    fits = (F.col("start_s") - F.lag("end_s").over(w) <= 0.6) & (told != "") & ~told.rlike('[.!?…]["»”)\\]]*$')
    return a.dialogue(spark, d).select("recording_id", "id", F.coalesce(fits, F.lit(False)).alias("continues"))


@register("str01_trim_loop", f"""WITH {SAID_SQL}, w AS (SELECT recording_id, id, trim(text) AS t, string_split_regex(trim(text), '[ \\t]+') AS w FROM said),
s AS (SELECT recording_id, id, t, w, unnest(range(1, greatest(2, len(w) // 3 + 1))) AS s FROM w WHERE len(w) >= 6),
f AS (SELECT recording_id, id, min(s) AS s FROM s WHERE len(w) % s = 0 AND w[1:len(w) - s] = w[s + 1:] AND s <= len(w) // 3 GROUP BY 1, 2)
SELECT w.recording_id, w.id, coalesce(array_to_string(w.w[1:f.s], ' '), w.t) AS text FROM w LEFT JOIN f USING (recording_id, id)""")
def trim_loop(spark, d):
    return said(spark, d).select("recording_id", "id", text.trim_loop(F.col("text")).alias("text"))


@register("str03_dropped_brackets", f"""WITH RECURSIVE {a.DIALOGUE}, b AS (SELECT recording_id, id, list_transform(string_split(text, ' '), lambda x, i: CASE WHEN (i + id) % 7 = 0 THEN '(' WHEN (i + id) % 11 = 0 THEN '[' ELSE '' END || x || CASE WHEN (i + id) % 5 = 0 THEN '),' WHEN (i * id) % 13 = 1 THEN ']' ELSE '' END) AS ws FROM dialogue),
j AS (SELECT recording_id, id, i, ws[i] AS w, CASE WHEN regexp_matches(ws[i], '^[\\[({{]') THEN list_min(list_filter(range(i, least(len(ws), i + 7) + 1), lambda k: regexp_matches(ws[k], '[\\])}}][^\\p{{L}}\\p{{N}}]*$'))) END AS c FROM b, unnest(range(1, len(ws) + 1)) AS t(i)),
r AS (SELECT recording_id, id, 1::BIGINT AS i FROM b UNION ALL SELECT r.recording_id, r.id, coalesce(j.c, r.i) + 1 FROM r JOIN j ON j.recording_id = r.recording_id AND j.id = r.id AND j.i = r.i),
k AS (SELECT recording_id, id, string_agg(w, ' ' ORDER BY i) AS text FROM r JOIN j USING (recording_id, id, i) WHERE c IS NULL GROUP BY 1, 2)
SELECT recording_id, id, coalesce(k.text, '') AS text FROM b LEFT JOIN k USING (recording_id, id)""")
def dropped_brackets(spark, d):
    """Texts into which brackets are put by the number of the word."""
    n = lambda i: i + 1 + F.col("id")
    open_ = lambda i: F.when(n(i) % 7 == 0, "(").when(n(i) % 11 == 0, "[").otherwise("")
    close = lambda i: F.when(n(i) % 5 == 0, "),").when(((i + 1) * F.col("id")) % 13 == 1, "]").otherwise("")
    words = F.transform(F.split("text", " "), lambda x, i: F.concat(open_(i), x, close(i)))
    return a.dialogue(spark, d).select("recording_id", "id", F.array_join(text.bracketless(words), " ").alias("text"))


@register("str04_same_text", f"""WITH {a.LINES}, p AS (SELECT *, lag(text) OVER (PARTITION BY recording_id ORDER BY id) AS last FROM lines)
SELECT recording_id, id, coalesce(lower(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) = lower(trim(regexp_replace(last, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))), false) AS same FROM p""")
def same_text(spark, d):
    last = F.lag("text").over(Window.partitionBy("recording_id").orderBy("id"))
    rows = a.lines(spark, d).withColumn("last", last)
    return rows.select("recording_id", "id", F.coalesce(text.same_text(F.col("text"), F.col("last")), F.lit(False)).alias("same"))


@register("str05_reading_seconds", f"""WITH {a.LINES}, n AS (SELECT recording_id, id, length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS chars FROM lines)
SELECT recording_id, id, chars, floor(chars / 17::DOUBLE * 1000 + 0.5) / 1000 AS seconds FROM n""")
def reading_seconds(spark, d):
    return a.lines(spark, d).select("recording_id", "id", text.char_count(F.col("text")).alias("chars"), places(text.reading_seconds(F.col("text"), 17), 3).alias("seconds"))


_STAMP = """lpad((floor(greatest(0, {0}))::BIGINT // 3600)::VARCHAR, 2, '0') || ':' || lpad((floor(greatest(0, {0}))::BIGINT % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((floor(greatest(0, {0}))::BIGINT % 60)::VARCHAR, 2, '0') || ',' ||
  lpad(floor((greatest(0, {0}) - floor(greatest(0, {0}))) * 1000 + 0.5)::BIGINT::VARCHAR, greatest(3, length(floor((greatest(0, {0}) - floor(greatest(0, {0}))) * 1000 + 0.5)::BIGINT::VARCHAR))::INT, '0')"""


@register("str09_timestamps", f"WITH {a.DIALOGUE} SELECT recording_id, id, {_STAMP.format('start_s')} AS start_t, {_STAMP.format('end_s')} AS end_t FROM dialogue")
def timestamps(spark, d):
    return a.dialogue(spark, d).select("recording_id", "id", text.timestamp(F.col("start_s")).alias("start_t"), text.timestamp(F.col("end_s")).alias("end_t"))


@register("snk02_srt_export", f"""WITH {a.DIALOGUE}, n AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY id) AS n FROM dialogue)
SELECT recording_id, string_agg(n || chr(10) || {_STAMP.format('start_s')} || ' --> ' || {_STAMP.format('end_s')} || chr(10) || CASE WHEN speaker <> 'user' THEN '[' || speaker || '] ' ELSE '' END || text || chr(10), chr(10) ORDER BY n) AS srt FROM n GROUP BY 1""")
def srt_export(spark, d):
    return cues.srt(a.dialogue(spark, d), unnamed="user")


@register("str22_break_points", f"""WITH {a.LINES}, p AS (SELECT recording_id, id, text, unnest(range(1, greatest(length(text), 1))) AS i FROM lines)
SELECT recording_id, id, count(*) AS n, min(i) AS first, max(i) AS last FROM p WHERE substr(text, i, 1) IN ('.', ',', '!', '?', ';', ':', '…', '—') AND substr(text, i + 1, 1) = ' ' GROUP BY 1, 2""")
def break_points(spark, d):
    rows = a.lines(spark, d).withColumn("p", cues.break_points(F.col("text"))).where("size(p) > 0")
    return rows.select("recording_id", "id", F.size("p").cast("long").alias("n"), F.get("p", 0).cast("long").alias("first"), F.element_at("p", -1).cast("long").alias("last"))


@register("str08_split_long")
def split_long(spark, d):
    return a.lines(spark, d).select("recording_id", "id", F.posexplode(text.split_long(F.col("text"), 84)).alias("part", "text"))


@register("win15_plan_cues")
def plan_cues(spark, d):
    return cues.plan(a.dialogue(spark, d)).select("recording_id", "n", "id", places(F.col("start_s"), 3).alias("start_s"), places(F.col("end_s"), 3).alias("end_s"), "lines")


@register("win16_cue_problems", f"""WITH {a.LINES}, c AS (SELECT recording_id, id, start_s, end_s, text, length(text) AS chars, lead(start_s) OVER (PARTITION BY recording_id ORDER BY start_s, id) AS next_s FROM lines)
SELECT recording_id, id, array_to_string(list_filter([CASE WHEN end_s - start_s <= 0 OR end_s - start_s + 0.001 < 1 THEN 'too_short' END, CASE WHEN end_s - start_s > 7.001 THEN 'too_long' END,
  CASE WHEN end_s > start_s AND length(trim(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) / (end_s - start_s) > 17.5 THEN 'too_fast' END, CASE WHEN chars > 42 THEN 'line_overflow' END, CASE WHEN end_s > next_s THEN 'overlap' END], lambda x: x IS NOT NULL), ',') AS problems FROM c""")
def cue_problems(spark, d):
    return cues.problems(a.lines(spark, d).withColumn("lines", F.array("text"))).select("recording_id", "id", F.array_join("problems", ",").alias("problems"))


@register("snk03_cue_srt")
def cue_srt(spark, d):
    return cues.cue_srt(cues.plan(a.dialogue(spark, d)))


@register("src11_parse_srt", f"""WITH {a.DIALOGUE} SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY id) AS n, {_STAMP.format('start_s')} AS start_t,
  trim(regexp_replace(CASE WHEN speaker <> 'user' THEN '[' || speaker || '] ' ELSE '' END || text, chr(10) || '+', ' ', 'g')) AS text FROM dialogue""")
def parse_srt(spark, d):
    back = cues.parse_srt(cues.srt(a.dialogue(spark, d).withColumn("text", F.regexp_replace("text", "\n+", "\n")), unnamed="user"))
    return back.select("recording_id", "n", text.timestamp(F.col("start_s")).alias("start_t"), F.trim(F.array_join("lines", " ")).alias("text"))


def _mark(w: str) -> str:
    lower, core = f"lower({w})", f"CASE WHEN length({w}) > 4 AND regexp_matches(lower({w}), 'с[яь]$') THEN left(lower({w}), length({w}) - 2) ELSE lower({w}) END"
    return f"""CASE WHEN {lower} IN ({_quoted(f for _, f in fixed.SHORT_FORMS)}) THEN 'f' WHEN {lower} IN ({_quoted(m for m, _ in fixed.SHORT_FORMS)}) THEN 'm' WHEN {lower} IN ({_quoted(fixed.NOT_VERBS)}) THEN NULL
  WHEN {core} IN ({_quoted(text.MALE)}) THEN 'm' WHEN {core} IN ({_quoted(text.FEMALE)}) THEN 'f' WHEN length({w}) > 3 AND regexp_matches({lower}, 'ла(сь)?$') THEN 'f' WHEN length({w}) > 2 AND regexp_matches({lower}, 'л(ся)?$') THEN 'm' END"""


_HITS = f"""{SAID_SQL}, ws AS (SELECT recording_id, id, speaker, start_s, end_s, text, regexp_extract_all(text, '[а-яёА-ЯЁ]+') AS ws FROM said),
wi AS (SELECT recording_id, id, speaker, unnest(range(1, len(ws) + 1)) AS i, ws FROM ws), nx AS (SELECT recording_id, id, speaker, i, j, ws[i] AS p, ws[j] AS w FROM wi, unnest(range(i + 1, least(i + 3, len(ws)) + 1)) AS t(j) WHERE lower(ws[i]) IN ('я', 'ты')),
mk AS (SELECT *, {_mark('w')} AS g FROM nx), hits AS (SELECT recording_id, id, speaker, i, lower(p) AS pronoun, arg_min(g, j) AS gender, arg_min(p || ' ' || w, j) AS fragment FROM mk WHERE g IS NOT NULL GROUP BY ALL)"""


@register("str10_gender_hits", f"WITH {_HITS} SELECT recording_id, id, pronoun, gender, fragment FROM hits")
def gender_hits(spark, d):
    return gender.hits(said(spark, d)).select("recording_id", "id", "pronoun", "gender", "fragment")


@register("str11_word_marks", f"WITH {SAID_SQL}, w AS (SELECT recording_id, id, unnest(regexp_extract_all(text, '[а-яёА-ЯЁ]+')) AS word FROM said) SELECT recording_id, id, word, {_mark('word')} AS mark FROM w")
def word_marks(spark, d):
    words = said(spark, d).select("recording_id", "id", F.explode(F.regexp_extract_all("text", F.lit("[а-яёА-ЯЁ]+"), 0)).alias("word"))
    return words.withColumn("mark", text.mark_of(F.col("word")))


@register("str12_vocatives", f"WITH {SAID_SQL} SELECT recording_id, id, unnest(regexp_extract_all(text, '[,—-]\\s*([А-ЯЁ][а-яё]{{2,}})', 1)) AS name FROM said")
def vocatives(spark, d):
    return said(spark, d).select("recording_id", "id", F.explode(text.vocatives(F.col("text"))).alias("name"))


_NAMES = (("user", "Анна"), ("assistant", "Иван"))
_ADDRESSEE = f"""{_HITS}, nm AS (SELECT * FROM (VALUES ('user', 'Анна'), ('assistant', 'Иван')) AS t(who, name)),
vo AS (SELECT recording_id, id, speaker, v, j FROM (SELECT *, regexp_extract_all(text, '[,—-]\\s*([А-ЯЁ][а-яё]{{2,}})', 1) AS vs FROM said), unnest(vs) WITH ORDINALITY AS t(v, j)),
na AS (SELECT recording_id, id, arg_min(who, j) AS named FROM vo JOIN nm ON lower(v) = lower(name) AND who <> speaker GROUP BY 1, 2),
ot AS (SELECT s.recording_id, s.id, min(o.speaker) AS a, max(o.speaker) AS z FROM said s JOIN said o ON s.recording_id = o.recording_id AND o.speaker <> s.speaker AND o.end_s > s.start_s - 8 AND o.start_s < s.end_s + 8 GROUP BY 1, 2),
ad AS (SELECT s.recording_id, s.id, s.speaker, coalesce(named, CASE WHEN a = z THEN a END) AS addressee FROM said s LEFT JOIN na USING (recording_id, id) LEFT JOIN ot USING (recording_id, id))"""


@register("jon07_addressees", f"WITH {_ADDRESSEE} SELECT recording_id, id, addressee FROM ad")
def addressees(spark, d):
    return gender.addressees(said(spark, d), dict(_NAMES)).select("recording_id", "id", "addressee")


@register("agg08_gender_by_text", f"""WITH {_ADDRESSEE}, v AS (SELECT recording_id, speaker AS who, pronoun, gender FROM hits WHERE pronoun = 'я'
  UNION ALL SELECT h.recording_id, addressee, pronoun, gender FROM hits h JOIN ad USING (recording_id, id) WHERE pronoun = 'ты' AND addressee IS NOT NULL)
SELECT recording_id, who AS speaker, CASE WHEN count(*) FILTER (gender = 'm') >= 2 AND count(*) FILTER (gender = 'f') = 0 THEN 'm' WHEN count(*) FILTER (gender = 'f') >= 2 AND count(*) FILTER (gender = 'm') = 0 THEN 'f' ELSE 'unknown' END AS gender,
  count(*) FILTER (pronoun = 'я') AS self, count(*) FILTER (pronoun = 'ты') AS address FROM v GROUP BY 1, 2""")
def gender_by_text(spark, d):
    return gender.by_text(said(spark, d), dict(_NAMES)).select("recording_id", "speaker", "gender", "self", "address")


@register("str17_sound", f"WITH {SAID_SQL}, w AS (SELECT recording_id, id, unnest(regexp_extract_all(lower(text), '[а-яё]+')) AS word FROM said) SELECT recording_id, id, word, translate(word, 'эиыйеоаяю', 'иииииааау') AS sound FROM w")
def sounds(spark, d):
    words = said(spark, d).select("recording_id", "id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[а-яё]+"), 0)).alias("word"))
    return words.withColumn("sound", text.sound(F.col("word")))


_PAIRS = f"""{a.LINES}, wd AS (SELECT recording_id, id, lower(string_split(text, ' ')[1]) AS w, lower(string_split(text, ' ')[2]) AS v FROM lines WHERE text LIKE '% %')"""


def _pairs(spark, d) -> DataFrame:
    words: Column = F.split("text", " ")
    return a.lines(spark, d).where("text LIKE '% %'").select("recording_id", "id", F.lower(words[0]).alias("w"), F.lower(words[1]).alias("v"))


@register("str19_distance", f"WITH {_PAIRS} SELECT recording_id, id, levenshtein(w, v) AS distance FROM wd WHERE regexp_matches(w || v, '^[a-z]*$')")
def distance(spark, d):
    return _pairs(spark, d).where(F.concat("w", "v").rlike("^[a-z]*$")).select("recording_id", "id", F.levenshtein("w", "v").alias("distance"))


@register("str18_same_word", f"""WITH {_PAIRS}, l AS (SELECT recording_id, id, w, v, least(length(w), length(v)) AS s, greatest(length(w), length(v)) AS g FROM wd WHERE regexp_matches(w || v, '^[a-z]*$'))
SELECT recording_id, id, w = v OR (s > 2 AND ((left(w, greatest(4, s - 2)::INT) = left(v, greatest(4, s - 2)::INT) AND s >= greatest(4, s - 2)) OR levenshtein(w, v) <= greatest(1, floor(g * 0.3)))) AS same FROM l""")
def same_word(spark, d):
    return _pairs(spark, d).where(F.concat("w", "v").rlike("^[a-z]*$")).select("recording_id", "id", text.same_word(F.col("w"), F.col("v")).alias("same"))


@register("hsh05_clip_keys", f"WITH {a.DIALOGUE} SELECT recording_id, id, substr(sha256('e1' || chr(0) || speaker || chr(0) || trim(text)), 1, 16) AS key FROM dialogue")
def clip_keys(spark, d):
    return a.dialogue(spark, d).select("recording_id", "id", text.clip_key(F.col("speaker"), F.col("text"), F.lit("e1")).alias("key"))


@register("hsh01_content_hash", "SELECT doc_id, sha256(coalesce(text, '')) AS hash FROM documents")
def content_hash(spark, d):
    return a.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash"))


@register("str39_sizes", "SELECT doc_id, CASE WHEN n_chars * 97 < 1024 THEN (n_chars * 97)::VARCHAR || ' B' WHEN n_chars * 97 < 1048576 THEN format('{:.1f} KB', floor(n_chars * 97 / 1024 * 10 + 0.5) / 10) WHEN n_chars * 97 < 1073741824 THEN format('{:.1f} MB', floor(n_chars * 97 / 1048576 * 10 + 0.5) / 10) ELSE format('{:.1f} GB', floor(n_chars * 97 / 1073741824 * 10 + 0.5) / 10) END AS size FROM documents")
def sizes(spark, d):
    return a.table(spark, d, "documents").select("doc_id", text.bytes_text(F.col("n_chars") * 97).alias("size"))


@register("str33_tidy_reasons", f"""WITH {a.DIALOGUE}, m AS (SELECT recording_id, id, CASE id % 3 WHEN 0 THEN '[s3] gateway said 500: {{"error":{{"message":"no   room"}}}}' WHEN 1 THEN '[s5]  ' || text ELSE 'plain' END AS t FROM dialogue),
c AS (SELECT recording_id, id, trim(regexp_replace(CASE WHEN id % 3 = 0 THEN 'gateway said 500: no   room' ELSE regexp_replace(t, '^\\[s\\d\\]\\s*', '') END, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS t FROM m)
SELECT recording_id, id, CASE WHEN length(t) > 160 THEN left(t, 157) || '…' ELSE t END AS reason FROM c""")
def tidy_reasons(spark, d):
    nested = '[s3] gateway said 500: {"error":{"message":"no   room"}}'
    message = F.when(F.col("id") % 3 == 0, F.lit(nested)).when(F.col("id") % 3 == 1, F.concat(F.lit("[s5]  "), "text")).otherwise("plain")
    return a.dialogue(spark, d).select("recording_id", "id", text.tidy_reason(message).alias("reason"))


@register("str15_agreed_lines")
def agreed_lines(spark, d):
    """Lines made to agree with a woman's and a man's voice, with their phrases; lists as texts."""
    rows = said(spark, d).withColumn("phrases", F.split("text", "(?<=[,.!?…]) "))
    voices = rows.select("recording_id", "speaker").distinct().withColumn("gender", F.when(F.col("speaker") == "user", "f").when(F.col("speaker") == "assistant", "m").otherwise("unknown"))
    log = gender.agreed_with_voices(rows, voices, dict(_NAMES))
    fixes = F.array_join(F.transform("fixes", lambda f: F.concat(f["old"], F.lit(">"), f["new"])), ",")
    return log.select("recording_id", "id", "before", "after", fixes.alias("fixes"), F.array_join("phrases", "|").alias("phrases"))
