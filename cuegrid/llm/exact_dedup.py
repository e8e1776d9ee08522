"""Exact dedup by skew-safe combining of digest groups, comparing full contents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import rows_left, small, stored

SALTS = 32
_SPACE = "[ \\t\\n\\x0B\\f\\r]+"


def normalised(text: Column) -> Column:
    """The text without the characters 0x20 and 0x09-0x0D; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), _SPACE, "")


def sha256(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def _best() -> Column:
    """Most code points first, then the smallest id, null last."""
    return F.struct((-F.col("len")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id").alias("keep_id"))


def classes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256
) -> DataFrame:
    """One row for each row of docs: id, len, row (a number of its own), digest, content (empty unless texts with equal
    digests differ), keep_id, group_size, kept.

    Of equal texts the row with the most code points stays, then the smallest id (null last), then the first row.
    Digests are counted with salts first: a digest that occurs once has nothing to be compared with, and its text goes
    nowhere. Texts of repeated digests are combined within their input partition, then by (digest, salt, text), then by
    (digest, text): the whole text is a key of every one of these steps, which carry the winner so far with them. So
    texts whose digests collide stay apart, and one text may be a third of all rows.

    Null and empty texts are equal. Repeated rows are rows of their own, of which one stays. An empty table gives none.
    Only the two named columns are read, so other columns cannot clash.
    """
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    facts = docs.select(id_.alias("id"), F.length(text).cast("long").alias("len"), normalised(text).alias("norm")).withColumn("digest", digest(F.col("norm")))
    rows = stored(facts.select(F.monotonically_increasing_id().alias("row"), "id", "len", "digest"))
    salted = rows.groupBy("digest", (F.xxhash64("row") % SALTS).alias("salt")).agg(F.count(F.lit(1)).alias("n"))
    repeated = stored(salted.groupBy("digest").agg(F.sum("n").alias("n")).where("n > 1").select("digest"))
    texts = facts.join(small(repeated), "digest", "left_semi").withColumn("salt", F.xxhash64("id", "len") % SALTS)
    # Spark runs the first of these groupings within each input partition before its shuffle.
    won = texts.groupBy("digest", "salt", "norm").agg(F.min(_best()).alias("w"), F.count(F.lit(1)).alias("n"))
    won = won.groupBy("digest", "norm").agg(F.min("w").alias("w"), F.sum("n").alias("group_size"))
    whole = stored(won.select("digest", "norm", "group_size", "w.keep_id", (-F.col("w.neg")).alias("keep_len")))
    clash = stored(whole.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("digest"))
    content = F.lit("")
    if not clash.isEmpty():
        # Only texts whose digests collide go on beside their rows.
        whole = whole.join(clash.withColumn("hit", F.lit(True)), "digest", "left")
        content = F.when(F.col("hit"), F.col("norm")).otherwise(F.lit(""))
        numbered = facts.select(F.monotonically_increasing_id().alias("row"), "*").join(clash.withColumn("hit", F.lit(True)), "digest", "left")
        rows = stored(numbered.select("row", "id", "len", "digest", content.alias("content")))
    else:
        rows = rows.withColumn("content", content)
    many = whole.where("group_size > 1").select("digest", content.alias("content"), "group_size", "keep_id", "keep_len")
    return _placed(rows, stored(many))


def _placed(rows: DataFrame, many: DataFrame) -> DataFrame:
    """Each row beside the winner of its group; of rows that equal the winner in length and id the first one is kept."""
    key = ["digest", "content"]
    equal = rows.join(small(many), key).where(F.col("len").eqNullSafe(F.col("keep_len")) & F.col("id").eqNullSafe(F.col("keep_id")))
    first = stored(equal.groupBy(*key).agg(F.min("row").alias("keep_row")))
    out = rows.join(small(stored(many.join(first, key))), key, "left")
    lone = F.col("group_size").isNull()
    return out.select("id", "len", "row", "digest", "content", F.when(lone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (lone | (F.col("keep_row") == F.col("row"))).alias("kept"))


def keep(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose text another row has: the columns of docs, nothing else.

    Of equal texts the row with the most code points stays, then the smallest id (null last). Rows leave by an anti-join
    on (id, length, digest), whose side is broadcast only if it is counted and small. Of rows that repeat all three the
    one of least hash over all its columns stays.
    """
    named = stored(classes(docs, id_col=id_col, text_col=text_col))
    key = ["id_key", "len", "digest"]
    id_key = lambda c: F.coalesce(F.concat(F.lit("i"), c.cast("string")), F.lit("n")).alias("id_key")
    stay = named.where("kept and group_size > 1").select(id_key(F.col("id")), "len", "digest")
    lost = stored(named.where("not kept").select(id_key(F.col("id")), "len", "digest").distinct())
    twice = stored(lost.join(stay, key, "left_semi"))
    gone = stored(lost.join(twice, key, "left_anti")) if not twice.isEmpty() else lost
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), id_key(F.col(f"`{id_col}`")), F.length(text).cast("long").alias("len"), sha256(normalised(text)).alias("digest"))
    return rows_left(whole, key, gone, twice)


def op10_exact_dedup(spark, sf_dir: str) -> DataFrame:
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)
"""
