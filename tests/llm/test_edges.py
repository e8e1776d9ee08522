"""Nulls in every column, empty and long texts, ties, repeated rows, empty tables and clashing names, for each operator and stage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuegrid.llm import bpe, exact_dedup, langid, minhash, mixing, mixlm, pii, projections, quotes, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, row long, digest string, bucket long, size long, skey string, learn string, kept string, component string"
LONG = "lorem ipsum dolor sit amet " * 8000
ROWS = [
    (1, "the cat sat on the mat and it purred", "en", "a"),
    (1, "the cat sat on the mat and it purred", "en", "a"),
    (2, "The  cat sat on the mat and it purred", "en", "a"),
    (3, "der hund und die katze sind im haus", "de", None),
    (4, None, "de", "b"),
    (5, "", None, "b"),
    (None, "ein text ohne nummer", None, None),
    (6, LONG, "en", "a"),
    (7, "123 ... !!!", "en", "c"),
    (None, None, None, None),
]


def docs(spark, rows=ROWS):
    return spark.createDataFrame([(*r, None if r[1] is None else len(r[1]), *[None] * 9) for r in rows], DOCS)


def pages(spark, urls_):
    return spark.createDataFrame([(i, u, "x", None, 1) for i, u in enumerate(urls_)], "page_id long, url string, id string, host string, verdict long")


def talks(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, level long, original string")


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0, 0) for i, v, lab in rows], "vec_id long, embedding array<float>, label int, node long, row long")


def lang(d):
    return langid.labelled(d, langid.train(d))


MAPS = {
    "langid": lang, "bpe": bpe.encoded, "bpe_digests": bpe.digests, "pii": lambda d: pii.found(d, pii.train(d)), "minhash": minhash.near_duplicates, "exact": exact_dedup.classes,
    "mixlm": lambda d: mixlm.scored(d.withColumn("learn", F.lit(True))), "mixing": lambda d: mixing.mixed(d, ["doc_id"]),
}


@pytest.mark.parametrize("name", MAPS)
def test_documents_keep_every_row(name, spark):
    assert len(MAPS[name](docs(spark)).collect()) == len(ROWS)
    assert MAPS[name](docs(spark, [])).count() == 0


@pytest.mark.parametrize("k", range(len(corpus_pipeline.STAGES)))
def test_stages(k, spark):
    name, stage = corpus_pipeline.STAGES[k]
    for d in (docs(spark), docs(spark, [])):
        out = stage(spark, d, "/nowhere")
        if k + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == d.columns
        out.collect()


def test_pages(spark):
    many = ["https://A.example.org/es/x?y", "http://b.com/de/1", "http://b.com/fr/1", "ftp://x.org", None, "", "no scheme", "http://x.net/en/" + "9" * 50_000, "http://b.com/de/1", "://", "http://example.org/en/12#z"]
    out = {r.id: r for r in urls.judged(pages(spark, many)).collect()}
    assert len(out) == len(many)
    assert (out[0].host, out[0].path, out[0].rule, out[0].verdict) == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert (out[1].verdict, out[2].verdict, out[3].rule, out[10].rule) == ("block", "allow", "org/" if out[3].path.startswith("/") else None, "example.org/en/1")
    assert (out[4].host, out[4].path, out[6].host, out[9].host) == ("", "", "", "")
    assert urls.judged(pages(spark, [])).count() == 0
    assert {r.verdict for r in urls.judged(pages(spark, [None, "x"])).collect()} == {"allow"}


def test_messages(spark):
    rows = [(1, 0, "user", "Hello there\nsecond line"), (1, 1, "assistant", "> Hello there\nHi"), (1, 2, "user", ">> Hello there\n> Hi\nThanks"), (1, 2, "user", ">> Hello there\n> Hi\nThanks"), (1, None, None, "> Hello there"), (None, 1, "user", None), (2, 0, "user", ""), (2, 1, None, "> never said")]
    out = quotes.linked(talks(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {(r.conv, r.turn): r for r in out}
    assert (by[1, 1].reply_to, by[1, 1].text, by[1, 1].n_linked) == (0, "Hi", 1)
    assert (by[1, 2].reply_to, by[1, 2].depth, by[1, 2].root_turn, by[1, 2].quote_depth) == (1, 2, 0, 2)
    assert by[2, 1].reply_to is None and by[2, 1].n_quoted == 1
    assert quotes.linked(talks(spark, [])).count() == 0


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.1], 1), (4, [1.0, 0.0], 2), (5, [0.0, 0.0], 1), (6, None, 1), (7, [nan, 1.0], 1), (8, [1.0, None], 1), (9, [1.0, 0.0], None), (10, [float("inf"), 0.0], 1), (None, [1.0, 0.0], 1), (11, [], 1), (12, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1)]
    out = projections.near_duplicates(vectors(spark, rows)).collect()
    assert len(out) == len(rows)
    links = {r.id: (r.n_links, r.component_id, r.kept) for r in out}
    assert links[1] == (3, 1, True) and links[3] == (3, 1, False) and links[4] == (0, 4, True)
    assert all(links[i] == (0, i, True) for i in (5, 6, 7, 8, 9, 10, 11, 12))
    assert projections.near_duplicates(vectors(spark, [])).count() == 0


def test_vectors_that_share_an_id(spark):
    """Each row's links follow from its own vector and label."""
    out = projections.near_duplicates(vectors(spark, [(1, [1.0, 0.0, 0.0], 1), (1, [0.0, 1.0, 0.0], 1), (2, [1.0, 0.1, 0.0], 1)])).collect()
    assert sorted((r.id, r.n_links, r.component_id, r.kept) for r in out) == [(1, 0, 1, True), (1, 1, 1, True), (2, 1, 1, False)]
    out = projections.near_duplicates(vectors(spark, [(1, [1.0, 0.0, 0.0], 1), (1, [1.0, 0.0, 0.0], 2), (2, [1.0, 0.1, 0.0], 1)])).collect()
    assert sorted((r.id, r.n_links, r.component_id) for r in out) == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]
    named = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [1.0, 0.01], "a"), (3, [1.0, 0.0], "b")], "vec_id long, embedding array<double>, label string")
    assert sorted((r.id, r.n_links) for r in projections.near_duplicates(named).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_vectors_of_any_size(spark):
    """Vectors whose squares leave the range of doubles link by their angle like others."""
    rows = [(1, [1e160, 0.0], 1), (2, [1e160, 1e158], 1), (3, [1e-170, 0.0], 1), (4, [5e-324, 0.0], 1), (5, [0.0, 1e300], 1), (6, [0.0, 2.0], 1), (7, [0.0, 0.0], 1), (8, [float("inf"), 1.0], 1)]
    out = {r.id: (r.n_links, r.component_id) for r in projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert out == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (1, 5), 7: (0, 7), 8: (0, 8)}


def test_bpe_encodes_a_run_once_among_many():
    codec = bpe.Codec(bpe.vocabulary_text())
    runs = [f"q{k:x}z" for k in range(100_000)]
    first = codec.encode(" ".join(runs))
    missed = codec.missed
    assert codec.encode(" ".join(runs)) == first and codec.missed == missed
