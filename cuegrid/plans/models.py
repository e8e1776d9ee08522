"""Queries of requests to models; rules that SQL can repeat stand in for the models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import models
from cuegrid.plans.registry import Registry
from cuegrid.plans.speech import EST, FLOOR, OVERHEAD, RATE, TOLERANCE, WITHIN, _target, r
from cuegrid.sources import adapters as a

register = Registry()
MEASURE = {"rate": RATE, "overhead": OVERHEAD, "tolerance": TOLERANCE, "floor": FLOOR}
#: Lines whose room is four fifths to one and a half of their slot, so that some are too long and some too short.
_ROOMS = f"WITH {a.DIALOGUE}, v AS (SELECT recording_id, id, text, slot * (0.8::DOUBLE + (id % 6) * 0.14::DOUBLE) AS slot FROM dialogue)"


def _rooms(spark, d):
    return a.dialogue(spark, d).select("recording_id", "id", "text", (F.col("slot") * (F.lit(0.8) + (F.col("id") % 6) * F.lit(0.14))).alias("slot"))


def _refitter(asked):
    """Cuts or fills a text to its target, but doubles every fifth one; every third chunk and every seventh row has no answer."""
    new = F.when(F.col("id") % 5 == 0, F.concat("text", "text")).otherwise(F.rpad(F.substring(F.col("text"), F.lit(1), F.col("target").cast("int")), F.col("target").cast("int"), F.lit(".")))
    return asked.where("chunk % 3 <> 2 AND id % 7 <> 0").select("recording_id", "id", new.alias("text"))


@register("udf06_fitted_lengths", f"""{_ROOMS}, m AS (SELECT *, CASE WHEN {EST} / slot > 1 THEN 'shorten' ELSE 'expand' END AS action, least({_target('1.0::DOUBLE')}, greatest(8, floor(length(text) * 2.0::DOUBLE + 0.5)))::BIGINT AS target FROM v WHERE NOT ({WITHIN})),
q AS (SELECT *, (row_number() OVER (PARTITION BY recording_id ORDER BY id) - 1) // 2 AS chunk FROM m WHERE action = 'shorten' OR length(text) < target),
p AS (SELECT recording_id, id, slot, text AS old, CASE WHEN id % 5 = 0 THEN text || text ELSE rpad(substring(text, 1, target), target::INT, '.') END AS text FROM q WHERE chunk % 3 <> 2 AND id % 7 <> 0),
t AS (SELECT recording_id, id, text AS new FROM p WHERE text <> '' AND abs({EST} - slot) < abs({EST.replace('text', 'old')} - slot))
SELECT recording_id, id, coalesce(new, text) AS text, new IS NOT NULL AS fitted FROM v LEFT JOIN t USING (recording_id, id)""")
def fitted_lengths(spark, d):
    return models.fitted_lengths(_rooms(spark, d), _refitter, size=2, cap=2.0, **MEASURE).select("recording_id", "id", "text", "fitted")


def _as_it_is(rows):
    return rows.select("recording_id", "id", F.col("text").alias("text_tgt"), F.length("text").alias("prompt_tokens"), F.length("text").alias("completion_tokens"))


def _short(rows):
    return rows.select("recording_id", "id", F.substring("text", 1, 40).alias("text_tgt"), F.lit(0.25).alias("cost"))


def _wordy(rows):
    return rows.where("id % 7 <> 0").select("recording_id", "id", F.concat("text", F.lit(" "), "text").alias("text_tgt"))


def _broken(rows):
    raise ConnectionError("no such model")


_MODELS = {"as it is": _as_it_is, "short": _short, "wordy": _wordy, "broken": _broken}
_ANSWERS = f"""{_ROOMS}, t AS (SELECT 'as it is' AS model, recording_id, id, slot, text, length(text) AS tokens, 0.0 AS reported FROM v
UNION ALL SELECT 'short', recording_id, id, slot, substring(text, 1, 40), 0, 0.25 FROM v
UNION ALL SELECT 'wordy', recording_id, id, slot, CASE WHEN id % 7 <> 0 THEN text || ' ' || text END, 0, 0.0 FROM v)"""


def _compared(spark, d):
    return models.compared(_rooms(spark, d), _MODELS, prices={"as it is": (0.5, 2.0), "short": (9.0, 9.0)}, **MEASURE)


@register("udf08_model_report", f"""{_ANSWERS} SELECT model, true AS ok, NULL AS error, count(text) AS total, count(*) FILTER ({WITHIN}) AS within, {r(f'count(*) FILTER ({WITHIN})::DOUBLE / count(text)', 6)} AS share,
  count(*) FILTER (NOT ({WITHIN}) AND {EST} / slot > 1) AS too_long, count(*) FILTER (NOT ({WITHIN}) AND {EST} / slot <= 1) AS too_short, count(*) FILTER ({WITHIN}) / count(text) >= 0.9 AS passed,
  sum(tokens)::BIGINT AS prompt_tokens, sum(tokens)::BIGINT AS completion_tokens, CASE WHEN sum(reported) > 0 THEN sum(reported) ELSE sum(tokens) * 2.5 END::DOUBLE AS cost FROM t GROUP BY 1
UNION ALL SELECT 'broken', false, 'no such model', 0, 0, 0, 0, 0, false, 0, 0, 0""")
def model_report(spark, d):
    from cuegrid.functions.numbers import places

    return _compared(spark, d)[0].drop("seconds").withColumn("share", places(F.col("share"), 6))


@register("udf08_model_lines", f"{_ANSWERS} SELECT model, recording_id, id, {r('slot', 2)} AS slot, text AS text_tgt, coalesce({WITHIN}, false) AS fits FROM t")
def model_lines(spark, d):
    return _compared(spark, d)[1].drop("text")
