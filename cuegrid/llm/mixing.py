"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import bucket_of, stored

WEIGHTS = (5, 2, 1)
#: Rows of one source and size class are dealt to so many buckets at least, so that no source is counted through in one task; beyond, a bucket for each so many rows of the table.
SALTS, SALT_ROWS = 32, 1 << 21


def salts_for(rows: int) -> int:
    """A power of two, so that tables of one order of size are dealt alike."""
    return max(SALTS, 1 << max(0, math.ceil(math.log2(max(1, rows / SALT_ROWS)))))


def _sized(docs: DataFrame, carry: list[str], id_col: str, text_col: str, source_col: str, salts: int) -> DataFrame:
    size = F.coalesce(F.expr(f"regexp_count(`{text_col}`, '[^\\\\x20\\\\x09-\\\\x0D]+')"), F.lit(0)).cast("long")
    out = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(F.concat(F.lit("s"), F.col(f"`{source_col}`")), F.lit("z")).alias("skey"),
        size.alias("size"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("tie"),
        # Rows without an id are dealt by their texts.
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.md5(F.col(f"`{text_col}`")), F.lit("")).alias("own"),
    )
    bits = F.length(F.bin("size"))
    level = bits * 8 + F.expr("shiftright(size, greatest(length(bin(size)) - 4, 0)) % 8")
    return out.select("*", level.cast("long").alias("level"), bucket_of(F.col("own"), salts).alias("salt")).drop("own")


def _targets(cells: DataFrame, weights: tuple[int, ...], budget: float, cap: float) -> DataFrame:
    """Per source: size and target. The table has a row for each source; the level of the water comes from running sums over it."""
    by = cells.groupBy("skey").agg(F.sum("words").alias("source_size"))
    order = Window.orderBy("skey")
    weighted = by.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    everything = weighted.crossJoin(F.broadcast(by.agg(F.sum("source_size").alias("all_words"))))
    tight = Window.orderBy(F.col("most") / F.col("w"), "skey")
    before = tight.rowsBetween(Window.unboundedPreceding, -1)
    after = tight.rowsBetween(0, Window.unboundedFollowing)
    level = everything.withColumn("most", F.col("source_size") * F.lit(float(cap))).select(
        "*", ((F.col("all_words") * F.lit(float(budget)) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)).alias("water")
    )
    free = level.where(F.col("water") * F.col("w") <= F.col("most")).agg(F.min_by("water", F.struct(F.col("most") / F.col("w"), F.col("skey"))).alias("level"))
    share = F.least(F.col("most"), F.coalesce(F.col("level") * F.col("w"), F.col("most")))
    return level.crossJoin(F.broadcast(free)).select("skey", "source_size", share.alias("target"))


def mixed(
    docs: DataFrame,
    carry: list[str],
    *,
    weights: tuple[int, ...] = WEIGHTS,
    budget: float = 1.5,
    cap: float = 2.0,
    seed: int = 20,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Every row of docs with the copies that the mix takes of it.

    Returns ``row`` (a struct of the columns in ``carry``), size, source_size, target, expected (copies
    before rounding) and copies. Sources by code point, null last, get ``weights`` in turn; together they
    share ``budget`` times all words, none beyond ``cap`` times its own, the excess shared again by weight.

    Systematic sampling: documents of a source stand in an order by size class; the running sum of their
    expected copies plus one offset of the source crosses an integer once for each copy. The running sum
    is the count of earlier cells (source, size class, salt) plus a row number within the cell, so one
    source may hold most rows; salts grow with the table, and rows without an id are salted by text. The offset comes from the md5 of the source and ``seed``: reruns agree.

    Null and empty texts have size 0. Repeated rows are rows of their own. An empty table gives none.
    Columns are carried in a struct, so names cannot clash.
    """
    sized = _sized(docs, carry, id_col, text_col, source_col, salts_for(docs.count()))
    cells = stored(sized.groupBy("skey", "level", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words")))
    targets = _targets(cells, weights, budget, cap)
    order = Window.partitionBy("skey").orderBy("level", "salt").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("skey"))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    known = cells.select("skey", "level", "salt", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("earlier")).join(targets, "skey").select("*", offset.alias("offset"))
    within = Window.partitionBy("skey", "level", "salt").orderBy("size", "id", "tie")
    placed = sized.join(known, ["skey", "level", "salt"]).withColumn("k", F.row_number().over(within) + F.col("earlier"))
    expected = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    placed = placed.withColumn("expected", expected)
    copies = F.floor(F.col("expected") * F.col("k") + F.col("offset")) - F.floor(F.col("expected") * (F.col("k") - 1) + F.col("offset"))
    return placed.select("row", "size", "source_size", "target", "expected", copies.cast("long").alias("copies"))


def emit(docs: DataFrame, **options) -> DataFrame:
    """docs with each row as often as the mix takes it: the columns of docs, nothing else."""
    out = mixed(docs, docs.columns, **options).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    out = mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"), ["doc_id"])
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce('s' || source, 'z') AS skey, coalesce(doc_id::VARCHAR, md5(text), '') AS own FROM documents),
b AS (
  SELECT *, length(bin(size)) * 8 + (size >> greatest(length(bin(size)) - 4, 0)) % 8 AS level,
         coalesce(('0x' || substr(md5(own), 1, 8))::BIGINT % 32, 0) AS salt FROM d),
s AS (SELECT skey, sum(size)::BIGINT AS source_size FROM b GROUP BY skey),
w AS (SELECT *, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY skey) - 1) % 3 + 1]::DOUBLE AS w, source_size * 2.0::DOUBLE AS most,
             (SELECT sum(source_size) FROM s)::DOUBLE AS all_words FROM s),
l AS (SELECT *, (all_words * 1.5::DOUBLE
               - coalesce(sum(most) OVER (ORDER BY most / w, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (ORDER BY most / w, skey ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS water FROM w),
f AS (SELECT water AS level FROM l WHERE water * w <= most ORDER BY most / w, skey LIMIT 1),
t AS (SELECT skey, source_size, least(most, coalesce((SELECT level FROM f) * w, most)) AS target,
             ('0x' || substr(md5('20:' || skey), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS u FROM l),
k AS (SELECT *, row_number() OVER (PARTITION BY skey ORDER BY level, salt, size, doc_id) AS k FROM b),
e AS (SELECT k.doc_id, k.size, t.source_size, t.target, k.k, t.u,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS e FROM k JOIN t USING (skey))
SELECT doc_id, size, source_size, target,
       (floor(e * k + u) - floor(e * (k - 1) + u))::BIGINT * size AS taken FROM e
"""
