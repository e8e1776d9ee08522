"""Requests to models over whole tables: one pass that fits lengths, and models compared on the same rows.

A model is a function from DataFrame to DataFrame, so what it does runs in Spark's tasks.
"""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.errors import PythonException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cuegrid.functions.numbers import places, speech_seconds, within_length
from cuegrid.operators import replies, speech
from cuegrid.operators.rounds import KEY, kept

Model = Callable[[DataFrame], DataFrame]
MODELS = "model string, ok boolean, error string, seconds double, prompt_price double, completion_price double"
USAGE = {"prompt_tokens": "long", "completion_tokens": "long", "cost": "double"}


def fitted_lengths(df: DataFrame, refitter: Model, *, size: int, rate: float, overhead: float, tolerance: float, floor: float, cap: float) -> DataFrame:
    """df (recording_id, id, text, slot) after one corrective request for each chunk of misfits, with ``fitted``.

    The misfits of a recording are asked for in the order of their ids, ``size`` to a chunk: ``refitter`` gets
    (recording_id, chunk, id, action, target, text, slot) and returns (recording_id, id, text) of what it rewrote. A chunk
    without an answer stays as it is. A rewritten text counts if it is strictly nearer the slot, measured as it was asked
    for; so the pass never makes a row worse. Of two answers for a row the least text counts; answers to rows that were
    not asked for, empty and null ones do not. Rows without a text are not sent. An empty table gives none.
    """
    chunk = F.floor((F.row_number().over(Window.partitionBy("recording_id").orderBy("id")) - 1) / size).cast("long")
    wrong = speech.misfits(df, rate=rate, overhead=overhead, tolerance=tolerance, floor=floor, cap=cap)
    asked = kept(wrong.select("recording_id", chunk.alias("chunk"), "id", "action", F.col("target").cast("long").alias("target"), "text", "slot"))
    told = refitter(asked).where("text <> ''").groupBy(*KEY).agg(F.min("text").alias("rewritten"))
    both = asked.join(told, KEY).withColumnRenamed("slot", "room")
    both = both.withColumn("seconds", speech_seconds(F.length("text"), rate, overhead)).withColumn("proposed", speech_seconds(F.length("rewritten"), rate, overhead))
    better = replies.accepted_fits(both).where("taken").select(*KEY, "rewritten")
    out = df.join(better, KEY, "left")
    return out.select(*(F.coalesce("rewritten", "text").alias("text") if c == "text" else c for c in df.columns), F.col("rewritten").isNotNull().alias("fitted"))


@contextmanager
def _budget(spark: SparkSession, seconds: float) -> Iterator[None]:
    """Jobs begun within are cancelled when so many seconds have passed."""
    context, group, late = spark.sparkContext, f"model-{uuid.uuid4().hex}", threading.Event()
    before = {k: context.getLocalProperty(k) for k in ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")}

    def stop() -> None:
        late.set()
        context.cancelJobGroup(group)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    # Tasks end as they next look whether they shall, a Python worker is stopped; threads are not interrupted amid other work.
    context.setJobGroup(group, "one model of a comparison", interruptOnCancel=False)
    timer.start()
    try:
        yield
    except Exception as e:
        if late.is_set():
            raise TimeoutError(f"more than {seconds:g} s") from e
        raise
    finally:
        timer.cancel()
        for k, v in before.items():
            context.setLocalProperty(k, v)
    if late.is_set():
        raise TimeoutError(f"more than {seconds:g} s")


def _line(e: Exception) -> str:
    """The line of an error that says what happened: the last one of a worker's trace, else the first."""
    lines = [x.strip(": ") for x in str(e).split("JVM stacktrace:")[0].splitlines() if x.strip() and not x.startswith("An error occurred while calling")]
    return (lines or [type(e).__name__])[-1 if isinstance(e, PythonException) else 0]


def compared(rows: DataFrame, models: dict[str, Model], *, rate: float, overhead: float, tolerance: float, floor: float, prices: dict[str, tuple[float, float]] | None = None, budget_s: float = 180.0) -> tuple[DataFrame, DataFrame]:
    """(report, lines): the same rows (recording_id, id, text, slot) through each model, which returns (recording_id, id, text_tgt) and, if it likes, prompt_tokens, completion_tokens and cost.

    report has a row for each model: model, ok, error, seconds, total (rows answered), within, share, too_long, too_short,
    passed (a share of 0.9 or more), prompt_tokens, completion_tokens, cost: the reported one, else tokens times
    ``prices`` (prompt, completion). lines has a row for each model that ended well and each row: model, recording_id, id,
    slot, text, text_tgt, fits, by the same measure as the report. Each model is a job of its own within ``budget_s``
    seconds; one that raises or takes longer has ok = false, its error's line and zeros, and stops no other. Of two
    answers for a row the least text counts; a row without one does not fit.
    """
    spark, told, parts = rows.sparkSession, [], []
    source = kept(rows.select(*KEY, "text", "slot"))
    for name, model in models.items():
        began, error = time.monotonic(), None
        try:
            with _budget(spark, budget_s):
                said = model(source)
                usage = [(F.col(c) if c in said.columns else F.lit(None)).cast(t).alias(c) for c, t in USAGE.items()]
                one = said.select(*KEY, "text_tgt", *usage).groupBy(*KEY).agg(F.min("text_tgt").alias("text_tgt"), *(F.sum(c).alias(c) for c in USAGE))
                parts.append(kept(source.join(one, KEY, "left").select(F.lit(name).alias("model"), "*")))
        except Exception as e:  # whatever a model raises is its own failure
            error = _line(e)
        told.append((name, error is None, error, time.monotonic() - began, *map(float, (prices or {}).get(name, (0.0, 0.0)))))
    schema = f"model string, {', '.join(f'{c} {source.schema[c].dataType.simpleString()}' for c in source.columns)}, text_tgt string, {', '.join(f'{c} {t}' for c, t in USAGE.items())}"
    answers = spark.createDataFrame([], schema)
    for part in parts:
        answers = answers.unionByName(part)
    seconds = speech_seconds(F.length("text_tgt"), rate, overhead)
    fits = F.coalesce(within_length(seconds, F.col("slot"), tolerance, floor), F.lit(False))
    counted = answers.select("model", F.col("text_tgt").alias("text"), "slot", *USAGE)
    used = counted.groupBy("model").agg(*(F.coalesce(F.sum(c), F.lit(0)).cast(t).alias(c) for c, t in USAGE.items()))
    stats = speech.length_stats(counted.withColumnRenamed("model", "recording_id"), rate=rate, tolerance=tolerance, floor=floor, overhead=overhead).withColumnRenamed("recording_id", "model")
    # One row for each model on every side.
    report = spark.createDataFrame(told, MODELS).join(stats, "model", "left").join(used, "model", "left")
    zero = lambda c, t="long": F.coalesce(c, F.lit(0)).cast(t)
    priced = F.col("prompt_tokens") * F.col("prompt_price") + F.col("completion_tokens") * F.col("completion_price")
    report = report.select(
        "model", "ok", "error", "seconds", *(zero(F.col(c)).alias(c) for c in ("total", "within")), zero(F.col("within") / F.col("total"), "double").alias("share"), *(zero(F.col(c)).alias(c) for c in ("too_long", "too_short")),
        F.coalesce("passed", F.lit(False)).alias("passed"), *(zero(F.col(c)).alias(c) for c in ("prompt_tokens", "completion_tokens")), zero(F.when(F.col("cost") > 0, F.col("cost")).otherwise(priced), "double").alias("cost"),
    )
    return report, answers.select("model", *KEY, places(F.col("slot"), 2).alias("slot"), "text", "text_tgt", fits.alias("fits"))
