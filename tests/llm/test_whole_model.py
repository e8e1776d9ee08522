"""op9's kinds, weights and map follow from all texts to learn from."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from cuegrid.llm import mixlm


def test_kinds_follow_from_texts_beyond_those_they_begin_with(spark, monkeypatch):
    monkeypatch.setattr(mixlm, "TOPIC_TEXTS", 4)
    texts = [f"x{i} x{i} y{i} of" for i in range(60)]
    topics = mixlm.learnt_topics(spark.createDataFrame([(t,) for t in texts], "text string"))
    used = np.unique(mixlm.Words(pa.array(texts)).hashes() % np.uint64(mixlm.TOPIC_FEATURES)).astype(np.int64)
    unused = np.setdiff1d(np.arange(mixlm.TOPIC_FEATURES), used)[0]
    assert all((topics.logs[f] != topics.logs[unused]).any() for f in used if f != int(mixlm.Words(pa.array(["of"])).hashes()[0]) % mixlm.TOPIC_FEATURES)


def test_all_occurrences_and_words_are_learned_from(spark, monkeypatch):
    """Every first byte's decision is in the cells and every later one in the map's mass, of texts to learn from and no others."""
    seen, plain = [], mixlm.with_before
    monkeypatch.setattr(mixlm, "with_before", lambda m, mass, hits, cells: seen.append((m, mass, cells)) or plain(m, mass, hits, cells))
    rows = [(i, f"the winter{i % 7} and summer{i} the winter{i % 7} " * (1 + i % 3), i % 4 > 0) for i in range(200)] + [(900, None, True), (901, "", True)]
    mixlm.scored(spark.createDataFrame(rows, "doc_id long, text string, learn boolean")).collect()
    (m, mass, cells), = seen
    part = mixlm.Part(pa.array([t for _, t, learn in rows if learn and t is not None]), m.topics)
    head, whole = (np.diff(part.bits(m.trees, most).first)[part.at].sum() for most in (mixlm.HEAD, 1 << 62))
    assert cells.sum() == head and abs(mass.sum() - (whole - head)) < 1e-6 * whole
