"""Operators on tables where one key holds most rows."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cuegrid.llm import pii, quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def _messages() -> list[tuple]:
    rng, rows = random.Random(5), []
    said = [f"line {i} of {rng.randint(0, 9)}" for i in range(40)]
    for turn in range(40):  # one long conversation with threads
        quote = f"> {said[rng.randrange(turn)]}\n" if turn and rng.random() < 0.6 else ""
        rows.append((1, turn, rng.choice(["user", "bot"]), quote + said[turn]))
    rows += [(1, None, rng.choice(["user", "bot", None]), rng.choice(["a", "b", "c", "", None])) for _ in range(60)]
    rows += [(1, 7, rng.choice(["user", "bot", None]), rng.choice(["x", "y", "> z"])) for _ in range(40)]
    rows += [(None, rng.choice([None, 1, 2, -3]), "user", rng.choice(["p", "q"])) for _ in range(30)]
    return [*rows, (2, 0, "user", "alone")]


@pytest.mark.parametrize(("cell", "block"), [(3, 4), (1, 1), (64 * 1024, 1024)])
def test_positions_are_the_same_however_far_a_conversation_is_split(spark, monkeypatch, cell, block):
    monkeypatch.setattr(quotes, "CELL", cell)
    monkeypatch.setattr(quotes, "BLOCK", block)
    rows = _messages()
    out = quotes.linked(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    copies = {t: hashlib.md5((t or "").encode()).hexdigest() for *_, t in rows}
    own = {(t or "").split("\n")[-1]: copies[t] for *_, t in rows}
    talks = defaultdict(list)
    for r in out:
        talks[r.conv].append(r)
    for own_rows in talks.values():
        assert sorted(r.position for r in own_rows) == list(range(len(own_rows)))
        keys = [(r.turn is None, r.root_turn or 0, r.turn or 0, r.role is not None, r.role or "", own[r.text] if r.n_quoted == 0 else "") for r in sorted(own_rows, key=lambda r: r.position)]
        plain = [k for k in keys if k[-1]]
        assert plain == sorted(plain)
        assert [k[:5] for k in keys] == sorted(k[:5] for k in keys)


def test_prefix_sums_by_levels_equal_one_running_sum(spark):
    rng = random.Random(8)
    cells = sorted({(rng.randint(0, 2), rng.randint(0, 3), rng.randint(-2, 3), rng.randint(0, 3)) for _ in range(90)})
    rows = [(*c, rng.randint(1, 9)) for c in cells]
    got = {tuple(r)[:4]: r.before for r in quotes._before(spark.createDataFrame(rows, "a long, b long, c long, d long, n long"), [["a"], ["b"], ["c"], ["d"]]).collect()}
    want, at = {}, defaultdict(int)
    for *c, n in rows:
        want[tuple(c)] = at[c[0]]
        at[c[0]] += n
    assert got == want


@pytest.mark.parametrize("parts", [1, 5])
def test_a_sample_is_of_the_regions_of_least_hash(spark, parts):
    """Tasks that drop what is not among their least ones give the sample of the whole table."""
    rng = random.Random(2)
    texts = [None, "", "no numbers here"]
    for i in range(300):
        texts.append(f"write to u{rng.randint(0, 90)}@mail{i % 7}.org " + "and so on " * 12 + f"or take {rng.randint(100, 400)} of them" + " now and then" * 9)
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
    found = {t[a:b] for t in texts if t for a, b in pii.regions(t) if b - a <= pii.MEMO_CHARS}
    hashed = {r.x: r.h for r in spark.createDataFrame([(x,) for x in found], "x string").select("x", F.xxhash64("x").alias("h")).collect()}
    want = []
    for held in (True, False):
        want += sorted((x for x in found if bool(pii.base_spans(x)) == held), key=lambda x: (hashed[x], x))[:10]
    assert len(want) == 20 and len(found) > 200
    assert pii.sample(docs, most=20) == want
