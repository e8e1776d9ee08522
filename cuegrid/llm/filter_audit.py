"""Filter interaction audit: what each of five filters removes in every order they could be applied in."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import small, stored

#: The filters' letters; a document's mask has the bit of each filter that it fails.
FILTERS = "ABCDE"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_SPACE = r"[\x20\x09-\x0D]+"


def _failures(text: Column, words: Column) -> Column:
    """The bits of A to D, which follow from the text alone."""
    n, distinct = F.size(words).cast("long"), F.size(F.array_distinct(words)).cast("long")
    length = F.length(text).cast("long")
    upper = length - F.length(F.translate(text, UPPER, ""))
    failed = (n < 200, 100 * distinct < 50 * n, 100 * upper > 2 * length, text.rlike("[#$%&*|]"))
    return sum((F.when(f, F.lit(1 << k)).otherwise(F.lit(0)) for k, f in enumerate(failed)), F.lit(0))


def masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, part, mask) of each row of docs: which of the five filters its whole text fails.

    A: fewer than 200 words. B: fewer distinct words than half of the words. C: more than 2 capitals A-Z in 100 code
    points. D: one of ``#$%&*|``. E: a smaller id has the same text, by its SHA-256; only digests that repeat are joined
    back, so a text that a third of all rows share is one row of that side.

    Null texts count as empty, a null source as the empty source. A null id is never smaller or greater than another,
    so such a row never fails E; nor do rows that repeat the smallest id. An empty table gives none.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    read = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{source_col}`").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    taken = read.select("*", F.array_remove(F.split("text", _SPACE), "").alias("words"))
    rows = stored(taken.select("id", "part", _failures(F.col("text"), F.col("words")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    copy = F.coalesce(F.col("id") > F.col("first"), F.lit(False))
    return rows.join(small(stored(first)), "digest", "left").select("id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"))


def cells(docs: DataFrame, labels: DataFrame, *, label_id_col: str = "doc_id", **columns: str) -> DataFrame:
    """(part, mask, n, good, toxic): how many rows of a part have each mask, and how many of them carry a label.

    Labels that repeat an id count once: good if any row says quality 1, toxic if any says toxic 1. A label without an
    id counts for nothing.
    """
    marks = labels.groupBy(F.col(f"`{label_id_col}`").alias("id")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"))
    marked = masks(docs, **columns).join(small(stored(marks.where("id is not null and (good or toxic)"))), "id", "left")
    return marked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))


def audit(counted: DataFrame) -> DataFrame:
    """Counts of every part, order of the filters and step, from ``cells``.

    Each cell is unpivoted against the steps of the orders. A running bit-or over the earlier steps of its order says
    whether an earlier filter removes the cell; conditional sums over the cells of a part give the counts of a step, and
    the sum over all orders and places of a filter its ``shapley``. A part has at most 32 cells, so a window never holds
    more than five rows and a sum never more than 32, however many documents a part has.
    """
    orders = F.array(*[F.lit("".join(p)) for p in permutations(FILTERS)])
    spread = counted.select("*", F.explode(orders).alias("filter_order")).repartition("part", "filter_order")
    long = spread.select("*", F.posexplode(F.split("filter_order", "")).alias("at", "letter")).where("letter <> ''")
    bit = F.expr(f"shiftleft(1, instr('{FILTERS}', letter) - 1)")
    steps = long.select("*", (F.col("at") + 1).cast("int").alias("step"), bit.alias("bit")).withColumn("failed", F.col("mask").bitwiseAND(F.col("bit")))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    seen = steps.withColumn("earlier", F.coalesce(F.bit_or("failed").over(before), F.lit(0)))
    fails, gone = F.col("failed") != 0, F.col("earlier") != 0
    total = lambda when, what="n": F.sum(F.when(when, F.col(what)).otherwise(F.lit(0))).cast("long")
    by = seen.groupBy("part", "filter_order", "step", "letter").agg(
        total(~fails & ~gone).alias("kept"),
        total(fails & ~gone).alias("removed"),
        total(fails & gone).alias("redundant"),
        total(F.col("mask") == F.col("bit")).alias("unique_fails"),
        total(fails & ~gone, "good").alias("good_lost"),
        total(fails & ~gone, "toxic").alias("toxic_lost"),
    )
    return by.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "letter"))).drop("letter")


def op12_filter_audit(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    counted = stored(cells(read("documents"), read("labels")))
    return audit(counted)


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.doc_id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b,
         100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
         coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY t), false) AS e
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM x p, x q, x r, x s, x t
      WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5),
g AS (SELECT part, [CASE WHEN a THEN 'A' END, CASE WHEN b THEN 'B' END, CASE WHEN c THEN 'C' END, CASE WHEN d THEN 'D' END,
                    CASE WHEN e THEN 'E' END] AS fails, count(*) AS n, count(*) FILTER (good) AS good,
             count(*) FILTER (toxic) AS toxic FROM m GROUP BY 1, 2),
k AS (SELECT part, n, good, toxic, o, step, o[step] AS f, list_contains(fails, o[step]) AS hit,
             len(list_filter(fails, lambda z: z IS NOT NULL)) = 1 AS lone,
             len(list_intersect(o[1:step - 1], fails)) > 0 AS gone
      FROM g, o, range(1, 6) AS i(step)),
c AS (SELECT part, array_to_string(o, '') AS filter_order, step::INT AS step, f,
             coalesce(sum(n) FILTER (NOT hit AND NOT gone), 0)::BIGINT AS kept,
             coalesce(sum(n) FILTER (hit AND NOT gone), 0)::BIGINT AS removed,
             coalesce(sum(n) FILTER (hit AND gone), 0)::BIGINT AS redundant,
             coalesce(sum(n) FILTER (hit AND lone), 0)::BIGINT AS unique_fails,
             coalesce(sum(good) FILTER (hit AND NOT gone), 0)::BIGINT AS good_lost,
             coalesce(sum(toxic) FILTER (hit AND NOT gone), 0)::BIGINT AS toxic_lost
      FROM k GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley FROM c
"""
