"""op9 works out once what many words share, with the same scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cuegrid.llm import mixlm

TEXTS = [" ".join(f"{head}{tail}{i % 5}" for head in ("win", "sum", "é") for tail in ("ter", "mer", "", "ningly")) + " a an of " * (i % 3) for i in range(60)]


def _model(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    topics = mixlm.learnt_topics(rows)
    counts = mixlm.word_counts(rows.selectExpr("text", "true AS learn"), topics).cache()
    own, bits = mixlm.word_trees(counts), [18] * 6
    return counts, mixlm.for_scoring(mixlm.fresh(topics, own, bits, mixlm.tables(counts, rows, 2, topics, own, bits)))


def test_first_bytes_and_held_rests_are_scored_once(spark, monkeypatch):
    counts, model = _model(spark)
    part, made, plain = mixlm.Part(pa.array(TEXTS), model.topics), [], mixlm.Bits.__init__
    beginnings = {(t, bytes(part.data[s:e])[: mixlm.HEAD], e - s >= mixlm.HEAD) for s, e, t in zip(part.starts, part.ends, part.topics, strict=True)}
    want = mixlm.Scorer(model).scores(part, len(TEXTS))
    held = mixlm.held_rests(counts, spark.sparkContext.broadcast(model))
    monkeypatch.setattr(mixlm.Bits, "__init__", lambda self, data, starts, *more, **named: made.append(len(starts)) or plain(self, data, starts, *more, **named))
    got = mixlm.Scorer(model, held).scores(part, len(TEXTS))
    assert np.abs(got - want).max() < 1e-9
    assert sum(made) == len(beginnings) < len(part.starts)
    made.clear()
    mixlm.Learner(mixlm.replace(model, tables=[np.zeros(1 << 18, np.uint16)] * 6)).pairs(part)
    assert sum(made) == len(beginnings)
