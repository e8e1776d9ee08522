"""The whole pipeline against plain Python, stage by stage, on documents with copies."""

from __future__ import annotations

import math
import os
import random
import re
from hashlib import md5

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from cuegrid.llm import langid

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """300 documents: given ones, exact copies with other white space, near copies, and junk without letters."""
    rng = random.Random(7)
    base = [(r.text, r.lang, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").collect() if 40 < len(r.text) < 8000][:150]
    rows = [(i, *r) for i, r in enumerate(base)]
    while len(rows) < 280:
        text, lang, source = rng.choice(base)
        words = text.split(" ")
        kind = rng.randrange(3)
        if kind == 0:
            text = "  ".join(words) + "\n"
        elif kind == 1:
            words[rng.randrange(len(words))] = "changed"
            text = " ".join(words)
        else:
            text = " ".join(w if rng.random() < 0.7 else "other" for w in words)
        rows.append((len(rows), text, lang, rng.choice([source, "src0", None])))
    rows += [(len(rows) + k, t, None, "src1") for k, t in enumerate([None, "", "123 456", "... !!!", None, "   "] * 3)]
    path = tmp_path_factory.mktemp("pipeline")
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(5).write.parquet(f"{path}/documents.parquet")
    return str(path)


def exact(rows):
    best: dict = {}
    for i, t, s in rows:
        key = re.sub("[\x20\x09-\x0d]", "", t or "")
        best[key] = min(best.get(key, (math.inf,)), (-len(t or ""), i, t, s))
    return [x[1:] for x in best.values()]


def near(rows):
    top = brute.near_components([(i, t) for i, t, _ in rows], 5, 80)
    return [r for r in rows if top[r[0]][1] == r[0]]


def mixed(rows):
    """Copies of each row by systematic sampling, as the mixing operator states it."""
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    named = {i: "z" if s is None else f"s{s}" for i, _, s in rows}
    total: dict = {}
    for i, k in named.items():
        total[k] = total.get(k, 0) + size[i]
    weight = {k: (5, 2, 1)[n % 3] for n, k in enumerate(sorted(total))}
    budget, target, left = 1.5 * sum(total.values()), {}, dict(weight)
    while left:
        level = (budget - sum(target.values())) / sum(left.values())
        over = [k for k in left if level * left[k] > 2.0 * total[k]]
        if not over:
            target |= {k: level * w for k, w in left.items()}
            break
        k = min(over, key=lambda k: (2.0 * total[k] / weight[k], k))
        target[k] = 2.0 * total[k]
        del left[k]
    copies = {}
    for k in total:
        own = [i for i in named if named[i] == k]
        bits = {i: bin(size[i])[2:] for i in own}
        order = sorted(own, key=lambda i: (len(bits[i]) * 8 + (size[i] >> max(len(bits[i]) - 4, 0)) % 8, int(md5(str(i).encode()).hexdigest()[:8], 16) % 32, size[i], i))
        e = target[k] / total[k] if total[k] else 0.0
        u = int(md5(f"20:{k}".encode()).hexdigest()[:8], 16) / 4294967296.0
        for n, i in enumerate(order, 1):
            copies[i] = math.floor(e * n + u) - math.floor(e * (n - 1) + u)
    return copies


def test_run_equals_plain_python(spark, folder):
    import sys

    from tokenizers import Tokenizer

    sys.path.insert(0, "/opt/tokenizers")
    import public_tokenizers

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = [(r.doc_id, r.text, r.source) for r in langid.keep(docs).collect()]
    assert 250 < len(first) <= 280  # junk goes, nearly all else stays
    rows = near(exact(first))
    assert len(rows) < len(first) - 40
    copies = mixed(rows)
    own = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    own.no_truncation()
    own.no_padding()
    want = sorted((i, tuple(own.encode(t or "", add_special_tokens=False).ids)) for i, t, _ in rows for _ in range(copies[i]))
    got = sorted((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and got == want


def test_run_leaves_one_table(spark, folder):
    """Only the table that the last stage reads is left in the shared folder."""
    top = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    tables = lambda: {n for n in os.listdir(top) if n.startswith("table-")}
    before = tables()
    out = corpus_pipeline.run(spark, folder)
    assert len(tables() - before) == 1
    assert out.count() > 100 and out.where(F.size("ids") != F.col("n_tokens")).count() == 0

