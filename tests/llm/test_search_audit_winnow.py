"""Ranked search, filter audit and winnowing: brute force, edge cases and skew."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pyarrow as pa
import pytest

from cuegrid.llm import filter_audit, lexical, winnowing

DOCS = "doc_id long, text string, source string, id long, part string, mask long, key string, words long, n long, terms string, window string, item string, digest string, block int"
ITEMS = "item_id long, text string, id string, rank int, score long, n_words long"


def docs(spark, rows):
    return spark.createDataFrame([(*(r if len(r) == 3 else (*r, "a")), *[None] * 11) for r in rows], DOCS)


def items(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 4) for r in rows], ITEMS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def ranked(rows, asked, k=20):
    """Every row of items (item, rank, doc, score) by the formula, in Python's own integers."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    own = [(i, Counter(terms(t))) for i, t, *_ in rows]
    own = [(i, c) for i, c in own if c]
    n, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in asked:
        found = []
        for place, (i, c) in enumerate(own):
            m = 75 + 25 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, place))
        out += [(item, r, None if x[1] else x[2], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return out


TEXTS = ["the cat sat on the mat", "The CAT-sat; on_the mat", "dogs 42 bark", "ein Größe und über", "", None, "!!! ???", "the the the the", "a" * 70_000, "the " * 9000 + "rare"]


def test_search_equals_the_formula(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(60)] + ["Über", "ß", "42", "x_y", "a-b"]
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for i in range(150)]
    rows += [(500, "tie here"), (499, "tie here"), (499, "tie here"), (None, "tie here"), (None, None)]
    asked = [(1, "the cat"), (2, "THE the the w1 w2 w3 w3"), (3, ""), (4, None), (5, "not in any"), (5, "tie here"), (5, "tie here"), (6, "über ß größe x y"), (None, "rare w7"), (7, " ".join(vocab))]
    for size in (1, 1 << 20):  # each item a block of its own, and all in one
        got = [tuple(r) for r in lexical.search(docs(spark, rows), items(spark, asked), item_bytes=size).collect()]
        key = lambda x: tuple((v is None, v or 0) for v in x)
        assert sorted(got, key=key) == sorted(ranked(rows, asked), key=key)
    few = lexical.search(docs(spark, rows), items(spark, asked), k=2).collect()
    assert sorted((tuple(r) for r in few), key=key) == sorted(ranked(rows, asked, 2), key=key)


def test_search_of_nothing(spark):
    assert lexical.search(docs(spark, []), items(spark, [(1, "a")])).count() == 0
    assert lexical.search(docs(spark, [(1, "a")]), items(spark, [])).count() == 0
    assert lexical.search(docs(spark, [(1, "..."), (2, None)]), items(spark, [(1, "a")])).count() == 0
    assert lexical.search(docs(spark, [(1, "a b")]), items(spark, [(1, None)])).columns == ["item_id", "rank", "id", "score"]


def test_terms_are_compared_whole():
    """A word whose hash equals a term's is no match unless its bytes are the same."""
    own = lexical.item_matrix([(1, "alpha beta")])
    words = lexical.Words(pa.array(["beta gamma alpha"]), lexical.SIGNS)
    swapped = lexical.Items(**{**own.__dict__, "hashes": np.sort(words.hashes()[[0, 1]])})
    place, term = lexical._known(words, swapped)
    assert all(bytes(words.data[words.starts[p] : words.ends[p]]) == bytes(swapped.data[swapped.starts[t] : swapped.starts[t] + swapped.sizes[t]]) for p, t in zip(place, term, strict=True))
    assert 1 not in place


def test_best_of_ties_and_blocks():
    rng = np.random.default_rng(5)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        scores, ids, none = rng.integers(1, 5, n), rng.integers(0, 30, n), rng.random(n) < 0.2
        got = lexical._best(scores, ids, none, 7)
        want = sorted(range(n), key=lambda i: (-scores[i], none[i], ids[i]))[:7]
        assert [(scores[i], none[i], ids[i]) for i in got] == [(scores[i], none[i], ids[i]) for i in want]


def audited(rows, marks):
    """All counts of all parts, orders and steps, one document after another."""
    good, toxic = ({i for i, q, t in marks if i is not None and (q, t)[k] == 1} for k in (0, 1))
    fails = []
    for i, t, s in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        f = "".join(n for n, x in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), re.search(r"[#$%&*|]", t), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows)), strict=True) if x)
        fails.append((s or "", f, i in good, i in toxic))
    out = {}
    for part in {x[0] for x in fails}:
        own = [x[1:] for x in fails if x[0] == part]
        shapley = Counter()
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                hit = [x for x in own if letter in x[0]]
                gone = [x for x in hit if not set(order[:k]) & set(x[0])]
                shapley[letter] += len(gone)
                kept = sum(not set(order[: k + 1]) & set(x[0]) for x in own)
                out[part, order, k + 1] = [kept, len(gone), len(hit) - len(gone), sum(x[0] == letter for x in hit), sum(x[1] for x in gone), sum(x[2] for x in gone), letter]
        for key, v in out.items():
            if key[0] == part:
                v[-1] = shapley[v[-1]]
    return {k: tuple(v) for k, v in out.items()}


def test_audit_equals_a_loop(spark):
    rng = random.Random(8)
    long = " ".join(f"w{i}" for i in range(220))
    base = ["", None, "x", "A B C", "pay $5", long, long + " #", "SHOUT " * 250, "a a " * 150, long.replace("w", "W"), "\t\n", "x" * 60_000, "ß 😀 " * 120]
    rows = [(i if rng.random() < 0.9 else rng.choice([None, 3]), rng.choice(base), rng.choice(["s", "t", "", None])) for i in range(120)]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 120, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1)]
    labels = spark.createDataFrame([(*m, 5, "z") for m in marks], "doc_id long, quality int, toxic int, n long, part string")
    got = {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in filter_audit.audit(filter_audit.cells(docs(spark, rows), labels)).collect()}
    assert got == audited(rows, marks)
    assert len(got) == 3 * 600


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = filter_audit.audit(filter_audit.cells(docs(spark, []), labels))
    assert out.count() == 0
    assert out.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    one = filter_audit.audit(filter_audit.cells(docs(spark, [(1, "A", None)]), labels)).collect()
    assert len(one) == 600 and {r.part for r in one} == {""}
    assert all(r.kept == (r.step <= min(map(r.filter_order.index, "AC"))) for r in one)  # "A" fails A and C


def hit(rows, asked, span=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    windows = {}
    for item, text in asked:
        w = words(text)
        n = min(span, len(w))
        for s in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if item is None else str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text in rows:
        w, inside, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (t := tuple(w[s : s + n])) in windows:
                    inside |= set(range(s, s + n))
                    found |= windows[t]
        out.append((i, len(w), len(inside), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(inside)))
    return out


@pytest.mark.parametrize("vocabulary", [3, 12, 400])
def test_winnowing_equals_all_windows(vocabulary, spark):
    """A small vocabulary makes many repeated grams, ties of hashes and hits that overlap."""
    rng = random.Random(vocabulary)
    vocab = ["a", "Bee", "über", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(vocabulary - 3)]]
    sentence = lambda n: rng.choice([" ", ", ", " 7 ", "\n"]).join(rng.choices(vocab, k=n))
    asked = [(i, sentence(rng.choice([1, 3, 5, 9, 10, 11, 30]) if vocabulary > 3 else rng.choice([10, 12, 30]))) for i in range(25)] + [(3, sentence(15)), (None, sentence(20)), (50, ""), (51, None), (52, "12 34")]
    rows = [(i, sentence(rng.randint(0, 60))) for i in range(60)]
    for i in range(60):
        parts = [sentence(rng.randint(0, 8))]
        for _ in range(rng.randint(1, 3)):
            text = (rng.choice(asked)[1] or "").split(" ")
            cut = rng.randint(0, max(0, len(text) - 4))
            parts += [" ".join(text[cut : cut + rng.randint(4, 40)]), sentence(rng.randint(0, 8))]
        rows.append((100 + i, " ".join(parts)))
    rows += [(5, rows[70][1]), (5, rows[70][1]), (None, rows[71][1]), (None, None), (300, ""), (301, "1 2 3"), (302, " ".join([asked[0][1]] * 900) + " " + sentence(3000))]
    got = [tuple(r) for r in winnowing.contaminated(docs(spark, rows), items(spark, asked)).collect()]
    assert sorted(got, key=repr) == sorted(hit(rows, asked), key=repr)


def test_winnowing_of_nothing(spark):
    assert winnowing.contaminated(docs(spark, []), items(spark, [(1, "a b c")])).count() == 0
    none = winnowing.contaminated(docs(spark, [(1, "a b"), (None, None)]), items(spark, [(1, "1 2"), (2, None)])).collect()
    assert sorted((r.n_words, r.n_hit, r.n_items, r.contaminated, r.items_sha256) for r in none) == [(n, 0, 0, False, hashlib.sha256(b"").hexdigest()) for n in (0, 2)]


def test_every_shared_span_leaves_a_common_fingerprint(spark):
    """Whatever stands around ten shared words, one of the fingerprints is the same."""
    rng = random.Random(4)
    rows = []
    for i in range(40):
        shared = [f"s{rng.randint(0, 5)}" for _ in range(10)]
        around = lambda: [f"x{rng.randint(0, 5)}" for _ in range(rng.randint(0, 9))]
        rows += [(i, 0, around() + shared + around()), (i, 1, around() + shared + around())]
    df = spark.createDataFrame(rows, "pair long, side long, words array<string>")
    prints = {(r.pair, r.side): {x["print"] for x in r.runs} for r in winnowing.fingerprints(df, [10], 5).collect()}
    assert all(prints[i, 0] & prints[i, 1] for i in range(40))
