"""Quotation linking of messages, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import small, stored

#: Positions within a conversation are counted in blocks of so many turns.
BLOCK = 1024
#: Rows of one thread and block of turns that one task may order; more are split by turn, role and text.
CELL = 64 * BLOCK
_BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def plain(text: Column) -> Column:
    """Lower case, white space as single spaces."""
    return F.lower(F.trim(F.regexp_replace(text, _BLANK, " ")))


def _level(line: Column) -> Column:
    mark = F.regexp_extract(line, "^([> \\t]*)", 1)
    return F.length(mark) - F.length(F.replace(mark, F.lit(">"), F.lit("")))


def _body(line: Column) -> Column:
    return F.regexp_replace(line, "^[> \\t]*", "")


def _messages(messages: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    lines = F.split(F.coalesce(F.col(f"`{text}`"), F.lit("")), "\\r?\\n")
    own = F.array_join(F.filter("lines", lambda x: _level(x) == 0), "\n")
    named = messages.select(F.col(f"`{conv}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), lines.alias("lines"))
    return named.select("conv", "turn", "role", "lines", F.trim(own, F.lit(" \t\n\r")).alias("text"))


def links(messages: DataFrame) -> DataFrame:
    """(conv, turn, level, line, original): each quoted line of an earlier message, by itself or within its passage. original is the first turn of the conversation that holds the passage as text of its own."""
    keyed = messages.where("conv is not null and turn is not null")
    quoting = keyed.where(F.exists("lines", lambda x: _level(x) > 0)).select("conv", "turn", F.md5(F.array_join("lines", "\n")).alias("copy"), "lines").distinct()
    rows = quoting.select("conv", "turn", "copy", F.posexplode("lines").alias("line", "raw")).select("conv", "turn", "copy", "line", _level(F.col("raw")).alias("level"), plain(_body(F.col("raw"))).alias("body"))
    message = Window.partitionBy("conv", "turn", "copy").orderBy("line")
    broken = F.coalesce(F.lag("level").over(message) != F.col("level"), F.lit(True)).cast("int")
    runs = rows.withColumn("broken", broken).withColumn("run", F.sum("broken").over(message)).where("level > 0 and body <> ''")
    run = ["conv", "turn", "copy", "run", "level"]
    whole = runs.groupBy(*run).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), " ").alias("passage"))
    lines = runs.join(whole, run).select("conv", "turn", "copy", "level", "line", F.explode(F.array_distinct(F.array(F.sha2("body", 256), F.sha2("passage", 256)))).alias("hash"))
    parts = F.concat(F.split("text", "\\n"), F.split("text", "\\n[ \\t]*\\n"), F.array("text"))
    talks = quoting.select("conv").distinct()
    owned = keyed.join(talks, "conv", "left_semi").select("conv", "turn", F.explode(F.array_distinct(F.transform(parts, plain))).alias("passage")).where("passage <> ''")
    first = owned.groupBy("conv", F.sha2("passage", 256).alias("hash")).agg(F.min("turn").alias("original"))
    found = lines.join(first, ["conv", "hash"]).where("original < turn")
    return found.groupBy("conv", "turn", "copy", "level", "line").agg(F.min("original").alias("original"))


def _threads(parents: DataFrame) -> DataFrame:
    """(conv, turn, root_turn, depth) from (conv, turn, reply_to), by pointer doubling."""
    known = stored(parents.select("conv", "turn", F.col("reply_to").alias("up"), F.lit(1).cast("long").alias("steps")))
    while True:
        above = known.select("conv", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("steps").alias("steps2"))
        next_ = known.join(above, ["conv", "up"], "left").select("conv", "turn", F.coalesce("up2", "up").alias("up"), (F.col("steps") + F.coalesce("steps2", F.lit(0))).alias("steps"), F.col("up2").isNotNull().alias("moved"))
        next_ = stored(next_)
        if next_.where("moved").isEmpty():
            return next_.select("conv", "turn", F.col("up").alias("root_turn"), F.col("steps").alias("depth"))
        known = next_.drop("moved")


def _before(counts: DataFrame, levels: list[list[str]]) -> DataFrame:
    """counts (keys, n) with ``before``: the rows of the first level's keys that stand before each row's own, in order of the further levels. Each level is summed over those below it, so a window sees only one level's keys."""
    keys, done = list(levels[0]), None
    for level in levels[1:]:
        outer, keys = keys, [*keys, *level]
        earlier = F.sum("n").over(Window.partitionBy(*outer).orderBy(*level).rowsBetween(Window.unboundedPreceding, -1))
        sums = counts.groupBy(*keys).agg(F.sum("n").alias("n")).select(*keys, F.coalesce(earlier, F.lit(0)).alias("here"))
        if done is not None:
            sums = sums.join(done, outer).select(*keys, (F.col("here") + F.col("before")).alias("here"))
        done = sums.withColumnRenamed("here", "before")
    return done


def _positions(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """rows with ``position``, from 0 within (cn, ck), by (tn, rk, bk), then turn, role and copy. heads are the same rows with only the columns that say where they stand."""
    place = ["cn", "ck", "tn", "rb", "rk", "bk"]
    blocks = stored(heads.groupBy(*place).agg(F.count(F.lit(1)).alias("n")))
    before = _before(blocks, [["cn", "ck"], ["tn", "rb"], ["rk"], ["bk"]])
    out = rows.join(before, place)
    crowded = blocks.where(F.col("n") > CELL)
    if crowded.isEmpty():
        return out.withColumn("position", F.col("before") + F.row_number().over(Window.partitionBy(*place).orderBy("turn", "role", "copy")) - 1)
    hot = small(crowded.select(*place, F.lit(True).alias("hot")))
    # Rows of a crowded block are told apart by turn, role and the first digits of their text's digest, which keep the order.
    fine = ["ft", "fr", "fn", "fc"]
    of = [F.col("turn"), F.col("role").isNotNull(), F.col("role").cast("string"), F.substring("copy", 1, 3)]
    none = [F.lit(-1), F.lit(False), F.lit(""), F.lit("")]

    def split(df: DataFrame) -> DataFrame:
        return df.join(hot, place, "left").select("*", *(F.coalesce(F.when(F.col("hot"), x), y).alias(c) for c, x, y in zip(fine, of, none, strict=True)))

    finer = split(heads).where("hot").groupBy(*place, *fine).agg(F.count(F.lit(1)).alias("n"))
    inside = _before(finer, [place, ["ft", "fr", "fn"], ["fc"]]).withColumnRenamed("before", "inside")
    order = Window.partitionBy(*place, *fine).orderBy("turn", "role", "copy")
    out = split(out).join(inside, [*place, *fine], "left")
    return out.withColumn("position", F.col("before") + F.coalesce("inside", F.lit(0)) + F.row_number().over(order) - 1)


def linked(messages: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, turn, role, text, n_quoted, n_linked, quote_depth, reply_to, root_turn, depth, position) for each message.

    A line's quote level is the number of ``>`` before its text; a passage is a run of lines of one level. Passages and
    their lines are normalised and hashed, and joined to the first earlier message of the conversation that holds them as
    a line, a paragraph or the whole of its own text. A message replies to the latest message that its outermost linked
    level quotes. text is without quoted lines. Messages stand in reply order: by their thread's first turn, then turn;
    ``position`` counts from 0 within the conversation.

    Conversations are joined by (conversation, hash), grouped before. Positions are running sums of counts by blocks of
    first turns, then first turns, then blocks of turns, and a block that holds many rows is split by turn, role and text,
    so one conversation, or messages without turn, may hold most rows. Only rows that are equal in all four columns are
    numbered in one task, which spills. A null text is empty. A message with a null conversation or turn loses its
    quotes but links with nothing; its position is among such rows. Rows that share conversation and turn reply as one
    message and stay as rows. An empty table gives none. Only the four named columns are read.
    """
    all_ = _messages(messages, conv_col, turn_col, role_col, text_col)
    found = stored(links(all_))
    lowest = found.groupBy("conv", "turn").agg(F.min("level").alias("level"))
    replies = found.join(lowest, ["conv", "turn", "level"]).groupBy("conv", "turn").agg(F.max("original").alias("reply_to"))
    per = found.groupBy("conv", "turn", "copy").agg(F.count(F.lit(1)).alias("n_linked"))
    threads = _threads(stored(replies)).join(replies, ["conv", "turn"])
    body = all_.select(
        "conv", "turn", "role", "text", F.md5(F.array_join("lines", "\n")).alias("copy"),
        F.size(F.filter("lines", lambda x: (_level(x) > 0) & (plain(_body(x)) != ""))).cast("long").alias("n_quoted"),
        F.coalesce(F.array_max(F.transform("lines", _level)), F.lit(0)).cast("long").alias("quote_depth"),
    )
    out = body.join(threads, ["conv", "turn"], "left").join(per, ["conv", "turn", "copy"], "left")
    out = out.withColumn("root_turn", F.coalesce("root_turn", "turn"))
    root = F.coalesce("root_turn", "turn", F.lit(-1))
    where = [F.col("conv").isNull().alias("cn"), F.coalesce(F.col("conv").cast("string"), F.lit("")).alias("ck"), F.col("turn").isNull().alias("tn"), F.floor(root / BLOCK).alias("rb"), root.alias("rk"), F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1)).alias("bk")]
    # The few columns that say where a message stands are counted apart from the texts.
    heads = all_.select("conv", "turn", "role", F.md5(F.array_join("lines", "\n")).alias("copy")).join(threads.select("conv", "turn", "root_turn"), ["conv", "turn"], "left")
    out = _positions(out.select("*", *where), heads.select("turn", "role", "copy", *where))
    return out.select("conv", "turn", "role", "text", "n_quoted", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "quote_depth", "reply_to", "root_turn", F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), F.col("position").cast("long").alias("position"))


def op1_quotes(spark, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/conversations.parquet")).withColumnRenamed("conv", "conv_id")


OP1_SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, role, row_number() OVER () AS uid, md5(array_to_string(string_split_regex(coalesce(text, ''), '\r?\n'), chr(10))) AS copy,
         string_split_regex(coalesce(text, ''), '\r?\n') AS lines FROM conversations),
l AS (SELECT conv_id, turn, uid, copy, i AS line, lines[i] AS raw, regexp_extract(lines[i], '^([> \t]*)', 1) AS mark
      FROM m, unnest(range(1, len(lines) + 1)) AS t(i)),
v AS (SELECT *, length(mark) - length(replace(mark, '>', '')) AS level,
             lower(trim(regexp_replace(regexp_replace(raw, '^[> \t]*', ''), '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS body FROM l),
o AS (SELECT uid, trim(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (level = 0), ''), ' ' || chr(9) || chr(10) || chr(13)) AS text,
             count(*) FILTER (level > 0 AND body <> '') AS n_quoted, coalesce(max(level), 0) AS quote_depth FROM v GROUP BY uid),
q AS (SELECT *, sum(b) OVER (PARTITION BY uid ORDER BY line) AS run FROM (
        SELECT *, CASE WHEN lag(level) OVER (PARTITION BY uid ORDER BY line) = level THEN 0 ELSE 1 END AS b FROM v)),
r AS (SELECT uid, run, string_agg(body, ' ' ORDER BY line) AS passage FROM q WHERE level > 0 AND body <> '' GROUP BY uid, run),
x AS (SELECT DISTINCT q.conv_id, q.turn, q.copy, q.level, q.line, unnest([q.body, r.passage]) AS passage
      FROM q JOIN r USING (uid, run) WHERE q.level > 0 AND q.body <> ''),
w AS (SELECT m.conv_id, m.turn, lower(trim(regexp_replace(p, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS passage
      FROM m JOIN o USING (uid), unnest(list_concat(list_concat(string_split(o.text, chr(10)), string_split_regex(o.text, '\n[ \t]*\n')), [o.text])) AS t(p)),
f AS (SELECT conv_id, passage, min(turn) AS original FROM w WHERE passage <> '' GROUP BY 1, 2),
k AS (SELECT x.conv_id, x.turn, x.copy, x.level, x.line, min(f.original) AS original FROM x JOIN f USING (conv_id, passage)
      WHERE f.original < x.turn GROUP BY ALL),
p AS (SELECT k.conv_id, k.turn, max(original) AS reply_to FROM k
      JOIN (SELECT conv_id, turn, min(level) AS level FROM k GROUP BY 1, 2) USING (conv_id, turn, level) GROUP BY 1, 2),
t AS (SELECT conv_id, turn, reply_to AS up, 1 AS steps FROM p
      UNION ALL SELECT t.conv_id, t.turn, p.reply_to, steps + 1 FROM t JOIN p ON p.conv_id = t.conv_id AND p.turn = t.up),
d AS (SELECT conv_id, turn, min(up) AS root_turn, max(steps) AS depth FROM t GROUP BY 1, 2),
n AS (SELECT conv_id, turn, copy, count(*) AS n_linked FROM k GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, o.text, o.n_quoted, coalesce(n.n_linked, 0) AS n_linked, o.quote_depth, p.reply_to,
       coalesce(d.root_turn, m.turn) AS root_turn, coalesce(d.depth, 0) AS depth,
       row_number() OVER (PARTITION BY m.conv_id ORDER BY coalesce(d.root_turn, m.turn), m.turn // 1024, m.turn, m.role, m.copy) - 1 AS position
FROM m JOIN o USING (uid) LEFT JOIN p USING (conv_id, turn) LEFT JOIN d USING (conv_id, turn) LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn AND n.copy = m.copy
"""
