"""Results against brute force, round trips and held-out rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import struct
import unicodedata
from collections import defaultdict

import brute
import pytest
from pyspark.sql import functions as F

from cuegrid.llm import bpe, components, exact_dedup, langid, minhash, mixing, mixlm, pii, projections, queries, urls

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(name, spark, same):
    same(queries.queries()[name](spark, SMALL), queries.oracle_sql()[name])


def test_near_duplicates_on_documents(docs):
    for width, percent in ((3, 85), (5, 80)):
        got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(docs, width=width, percent=percent).collect()}
        assert got == brute.near_components([(r.doc_id, r.text) for r in docs.collect()], width, percent)


def test_near_duplicates_of_one_text(spark):
    """A group of edited copies, many of them too far from the text they were made from."""
    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocab) for _ in range(60)]
    rows = []
    for i in range(200):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(60)] = rng.choice(vocab)
        rows.append((i, " ".join(own)))
    got = {r.id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=3, percent=85).collect()}
    assert got == brute.near_components(rows, 3, 85)


def test_rows_that_share_an_id(spark):
    """Results follow each row's own text, in any order of the rows."""
    a, b = "one two three four five six seven eight nine ten", "red blue green black white pink brown grey gold teal"
    rows = [(1, a), (1, b), (2, a), (3, b), (1, a), (4, "x y z")]
    for own in (rows, rows[::-1], [rows[i] for i in (1, 0, 3, 2, 5, 4)]):
        df = spark.createDataFrame(own, "doc_id long, text string")
        got = sorted((r.id, r.component_id, r.kept) for r in minhash.near_duplicates(df, width=3, percent=85).collect())
        assert got == [(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
        assert sorted(tuple(r) for r in minhash.keep(df, width=3, percent=85).collect()) == [(1, a), (1, b), (4, "x y z")]
    for own in ([(5, "a b c d"), (5, "a  b  c   d"), (6, "a b c d")], [(6, "a b c d"), (5, "a  b  c   d"), (5, "a b c d")]):
        df = spark.createDataFrame(own, "doc_id long, text string")
        assert [tuple(r) for r in exact_dedup.keep(df).collect()] == [(5, "a  b  c   d")]
        assert sorted((r.id, r.len, r.keep_id, r.kept) for r in exact_dedup.classes(df).collect()) == [(5, 7, 5, False), (5, 11, 5, True), (6, 7, 5, False)]
    mixed = spark.createDataFrame([(None, "q"), ("null", "q"), ("null", "q"), (None, "r"), (None, None)], "doc_id string, text string")
    assert sorted(map(str, (tuple(r) for r in exact_dedup.keep(mixed).collect()))) == sorted(map(str, [("null", "q"), (None, "r"), (None, None)]))


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 140)] + [(1, i) for i in range(2, 40)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 141)}, **{i: 1 for i in range(1, 40)}}


def test_exact_dedup_with_colliding_digests(spark):
    rows = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "ba"), (5, "c"), (6, None), (7, " ")]
    got = {r.id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), digest=lambda c: F.length(c).cast("string")).collect()}
    assert got == {1: (3, 3, False), 2: (3, 3, False), 3: (3, 3, True), 4: (4, 1, True), 5: (5, 1, True), 6: (7, 2, False), 7: (7, 2, True)}


def test_bpe_equals_the_library(docs):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(4)
    odd = ["".join(rng.choice("aAbB 'strééßİ日本1²\t\n.,<|>endoftext\U0001f600Σσς") for _ in range(rng.randint(0, 60))) for _ in range(400)] + ["", "x" * 3000, "<|endoftext|> a<|startoftext|>b", "ẞ ͅ", "don't we'll", "a\u0301\u08d1b \u0301\u1abf x\u0558y \u1c89\U00016ea0 \U000187f8z \U0001246f1"]
    codec = bpe.Codec(bpe.vocabulary_text())
    for t in [r.text for r in docs.limit(60).collect() if r.text] + odd:
        ids = lib.encode(t, add_special_tokens=False).ids
        mine = codec.encode(t)
        assert list(struct.unpack(f"<{len(mine) // 4}I", mine)) == ids, t[:80]
        assert codec.decode(mine) == lib.decode(ids, skip_special_tokens=False)
    row = bpe.digests(docs).orderBy("id").first()
    text = docs.orderBy("doc_id").first().text
    ids = lib.encode(text, add_special_tokens=False).ids
    assert row.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and row.n_tokens == len(ids)
    assert unicodedata.is_normalized("NFC", text)


def test_another_vocabulary_is_refused():
    import public_tokenizers

    with pytest.raises((ValueError, KeyError)):
        bpe.Codec(bpe.vocabulary_text(public_tokenizers.path("byte_bpe_50k.json")))


def test_bpe_equals_the_library_on_all_characters():
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    codec = bpe.Codec(bpe.vocabulary_text())
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}" for c in every[i : i + 64]) for i in range(0, len(every), 64)]
    rng = random.Random(9)
    marks = [c for c in every if unicodedata.combining(c)]
    texts += ["a" + "".join(rng.choice(marks) for _ in range(4)) for _ in range(3000)]
    for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False), strict=True):
        mine = codec.encode(t)
        assert list(struct.unpack(f"<{len(mine) // 4}I", mine)) == want.ids, ascii(t)


def test_rules_of_personal_data_equal_plain_patterns():
    fixed = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    rng = random.Random(5)
    for _ in range(20_000):
        t = "".join(rng.choice("0123456789..  --++()@@ab%_1٣") for _ in range(rng.randint(0, 40)))
        want = []
        for k, p in fixed.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                fits = {"email": True, "ip": k == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(d) <= 19 and pii.luhn(d), "phone": 9 <= len(d) <= 15}[k]
                want += [(k, m.start(), m.end())] if fits else []
        assert sorted(want, key=lambda s: (s[1], pii.KINDS.index(s[0]))) == [(s.kind, s.start, s.end) for s in pii.base_spans(t)]


def test_personal_data_that_rules_miss():
    rng = random.Random(6)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = "4" + digits(14)
        return next(body + c for c in "0123456789" if pii.luhn(body + c))

    kinds = [lambda: f"mail ann.{digits(2)}@host{digits(1)}.example.com now", lambda: f"at 10.{rng.randrange(256)}.{rng.randrange(256)}.7 up", lambda: f"pay {card()} soon", lambda: f"ring +1 ({digits(3)}) 555-{digits(4)} then", lambda: f"in {digits(4)} there were {digits(3)} of them", lambda: f'token = "{rng.randbytes(20).hex()}" kept']
    finder = pii.Finder(pii.fit([rng.choice(kinds)() for _ in range(400)]))
    hidden = ["call (743) 555-3824 now", "write john.doe at example dot com please", "write john [at] mail5 [dot] example [dot] com ok", "host 227[.]5[.]221[.]1 is up"]
    assert all(finder.spans(t) for t in hidden)
    clean = ["it is at dot the end", "in 2021 and 2022, 14.50 and 1,000,000 of it", "no data here at all", "order 123 of 456", 'token = "24be64439e3e49cf46b2d7c90f360"']
    assert not [t for t in clean if finder.spans(t)]
    assert pii.Finder(pii.fit([])).spans("a@b.cc") == [pii.Span("email", 0, 6, True)]


def test_segmentation_is_the_best_of_all():
    """Best segmentation, chances of candidates and expected steps against all segmentations, one by one."""
    rng = random.Random(8)
    for _ in range(120):
        n = rng.randint(1, 14)
        spans = [(a, b) for a in range(n) for b in range(a, min(n, a + 3))]
        cands = [pii.Candidate(rng.randrange(4), a, b, ()) for a, b in rng.sample(spans, min(len(spans), 9))]
        scores = [rng.uniform(-1.5, 2) for _ in cands]
        steps = [[(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(4)] for _ in range(5)]

        def all_of(t: int, chosen: tuple = (), n=n, cands=cands):
            if t >= n:
                yield chosen
                return
            yield from all_of(t + 1, chosen)
            for x, c in enumerate(cands):
                if c.first == t:
                    yield from all_of(c.last + 1, (*chosen, x))

        def keys(chosen: tuple, cands=cands) -> list[tuple[int, int, int]]:
            own = [cands[x] for x in chosen]
            return [(4, own[0].kind, 0), *[(a.kind, b.kind, int(b.first - a.last - 1 > pii.NEAR)) for a, b in zip(own, own[1:], strict=False)]] if own else []

        value = {ch: sum(scores[x] for x in ch) + sum(steps[p][k][far] for p, k, far in keys(ch)) for ch in all_of(0)}
        best = tuple(cands.index(c) for c in pii._best(n, cands, scores, steps))
        assert abs(value[best] - max(value.values())) < 1e-9
        mass = sum(math.exp(v) for v in value.values())
        chances, expected = pii._posterior(n, cands, scores, steps)
        for x, p in enumerate(chances):
            assert abs(p - sum(math.exp(v) for ch, v in value.items() if x in ch) / mass) < 1e-9
        want: dict = defaultdict(float)
        for ch, v in value.items():
            for key in keys(ch):
                want[key] += math.exp(v) / mass
        assert all(abs(want[k] - expected.get(k, 0.0)) < 1e-9 for k in {*want, *expected})
        assert {k: v for k, v in pii._taken(cands, [x in best for x in range(len(cands))]).items()} == {k: keys(best).count(k) for k in keys(best)}


def test_steps_between_spans_are_learned():
    """The kind before tells: the same doubtful number counts after a kind that it follows in the rows learned from."""
    rng = random.Random(4)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    model = pii.fit([f"ann{digits(2)}@host.example.com +1 ({digits(3)}) 555-{digits(4)}" for _ in range(200)])
    email, phone = pii.KINDS.index("email"), pii.KINDS.index("phone")
    steps = model.steps()
    assert steps[email][phone][0] > steps[phone][phone][0] and steps[email][phone][0] > steps[phone][email][0]


def test_language_of_held_out_documents(spark):
    rows = langid.op2_langid(spark, SMALL).join(spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id").where("held_out AND n_chars > 200").collect()
    assert len(rows) > 20
    assert sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.95


def test_words_of_code_switched_text(spark, docs):
    model = langid.train(docs)
    by = defaultdict(list)
    for r in docs.where("lang IS NOT NULL AND n_chars > 400").orderBy("doc_id").collect():
        by[r.lang].append(r.text.split())
    mixed, want = [], []
    for lang in ("en", "de", "fr", "es"):
        piece = by[lang][0][:15]
        mixed += piece
        want += [lang] * len(piece)
    got = langid.labelled(spark.createDataFrame([(1, " ".join(mixed))], "doc_id long, text string"), model, per_word=True).first().labels
    assert sum(g == w for g, w in zip(got, want, strict=True)) / len(want) > 0.8


def test_forward_backward_equals_a_sum_over_paths():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    scores, moves = rng.normal(size=(4, 1, 3)), rng.normal(size=(3, 3))
    marginal, _, z = langid.forward_backward(scores, np.array([4]), moves)
    weight = {p: math.exp(sum(scores[t, 0, y] for t, y in enumerate(p)) + sum(moves[a, b] for a, b in zip(p, p[1:], strict=False))) for p in itertools.product(range(3), repeat=4)}
    total = sum(weight.values())
    assert abs(z[0] - math.log(total)) < 1e-6
    for t in range(4):
        for y in range(3):
            assert abs(marginal[t, 0, y] - sum(w for p, w in weight.items() if p[t] == y) / total) < 1e-6


def test_a_long_text_equals_one_chain():
    """Texts that are cut into chains have the marginals of an uncut pass."""
    import numpy as np
    import pyarrow as pa

    from cuegrid.llm.textnum import Words

    rng = random.Random(2)
    vocab = {"x": [f"ax{i}" for i in range(40)], "y": [f"by{i}" for i in range(40)], "z": [f"cz{i}" for i in range(40)]}
    text = lambda lang, n: " ".join(rng.choice(vocab[lang]) for _ in range(n))
    model = langid.fit([text(k, 60) for k in "xyz" for _ in range(20)], [k for k in "xyz" for _ in range(20)], epochs=2)
    words = Words(pa.array([" ".join(text(rng.choice("xyz"), 30) for _ in range(100)), text("y", 5), "", " ".join(rng.choice(sum(vocab.values(), [])) for _ in range(700))]))
    whole, cut = langid.word_marginals(words, model, 10_000), langid.word_marginals(words, model, 64)
    assert np.abs(whole - cut).max() < 1e-4 and len(words) == 3705


def test_every_language_is_learned(spark, monkeypatch):
    rows = [(i, f"w{i % 7} v{i}", f"l{i % 300:03d}") for i in range(1200)]
    monkeypatch.setattr(langid, "FIT_ALL", 600)
    texts, langs = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(set(langs)) == 300 and len(texts) <= 600


def test_mix_comes_near_its_targets(docs):
    rows = mixing.mixed(docs, ["doc_id"]).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        key = (r.source_size, r.target)
        taken[key] += r.copies * r.size
        target[key] = r.target
        most[key] = max(most[key], r.size)
        assert r.copies <= 2
    assert all(abs(taken[k] - target[k]) <= 2 * most[k] + 0.05 * target[k] for k in target)
    assert rows == mixing.mixed(docs, ["doc_id"]).collect() or sorted(map(str, rows)) == sorted(map(str, mixing.mixed(docs, ["doc_id"]).collect()))


def test_rows_without_ids_are_dealt_out(spark):
    """No task of the window gets much more than its share, with null ids alone and one source; reruns agree."""
    rows = spark.range(60_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("words "), F.col("id").cast("string")).alias("text"), F.lit("one").alias("source"))
    cells = mixing._sized(rows, ["doc_id"], "doc_id", "text", "source", mixing.salts_for(60_000)).groupBy("skey", "level", "salt").count()
    n = [r["count"] for r in cells.collect()]
    assert len(n) == 32 and max(n) < 1.2 * sum(n) / len(n)
    out = mixing.mixed(rows, ["text"])
    first = {r.row.text: r.copies for r in out.collect()}
    assert first == {r.row.text: r.copies for r in mixing.mixed(rows.repartition(7), ["text"]).collect()} and abs(sum(first.values()) - 1.5 * 60_000) < 2
    assert mixing.salts_for(10) == 32 and mixing.salts_for(10**10) == 8192


def test_links_of_vectors_equal_a_loop(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in centres[i % 6] + rng.normal(size=16) * 0.22], int(i % 2)) for i in range(240)]
    got = {r.id: r.n_links for r in projections.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = np.array([v for _, v, _ in rows])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.93) & (np.arange(240)[:, None] % 2 == np.arange(240)[None, :] % 2)
    want = near.sum(axis=1) - 1
    assert sum(got.values()) >= 0.99 * want.sum()
    assert all(got[i] <= want[i] for i in range(240))


def test_links_of_planted_groups(spark):
    """Tight groups (one ball each), broad ones (several balls, links from ball to ball), chains and equal vectors against all pairs."""
    import numpy as np

    rng = np.random.default_rng(5)
    rows = []
    for spread, size in ((0.03, 150), (0.09, 120), (0.16, 120), (0.2, 60), (0.0, 4), (0.05, 2)):
        base = rng.standard_normal(16)
        rows += [base + spread * np.linalg.norm(base) / 4 * rng.standard_normal(16) * (spread > 0) for _ in range(size)]
    a, b = rng.standard_normal((2, 16))
    rows += [math.cos(t) * a / np.linalg.norm(a) + math.sin(t) * b / np.linalg.norm(b) for t in np.linspace(0, 3, 40)]
    x = np.array(rows)
    label = np.arange(len(x)) % 7 == 0
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    table = spark.createDataFrame([(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(rows, label, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.id: r for r in projections.near_duplicates(table.repartition(5)).collect()}
    degree = near.sum(axis=1) - 1
    mine = np.array([got[i].n_links for i in range(len(x))])
    assert (mine <= degree).all() and mine.sum() >= 0.999 * degree.sum()
    seen = np.arange(len(x))
    while True:
        step = np.where(near, seen[None, :], len(x)).min(axis=1)
        if (step == seen).all():
            break
        seen = step
    assert np.mean([got[i].component_id == seen[i] for i in range(len(x))]) >= 0.99
    assert all(r.kept == (r.component_id == r.id) for r in got.values())


def test_base_scores_equal_counts(spark, docs):
    rows = {r.doc_id: r for r in mixlm.op9_mixlm(spark, SMALL).collect()}
    held = {i: r.held_out for i, r in rows.items()}
    counts: dict[str, int] = defaultdict(int)
    texts = {r.doc_id: [*brute.words(r.text), ""] for r in docs.collect()}
    for i, ws in texts.items():
        for w in ws if not held[i] else ():
            counts[w] += 1
    total, kinds = sum(counts.values()), len(counts)
    for i, ws in texts.items():
        assert rows[i].n_tokens == len(ws) and rows[i].n_known == sum(w in counts for w in ws) and rows[i].train_tokens == total
        assert abs(rows[i].base_score - sum(math.log10((counts.get(w, 0) + 1) / (total + kinds + 1)) for w in ws)) < 1e-6 * len(ws)
        assert rows[i].score < 0


def test_model_predicts_better_than_the_base(spark):
    rows = mixlm.op9_mixlm(spark, SMALL.replace("0.001", "0.01")).where("held_out").collect()
    score, base = (sum(r[k] for r in rows) for k in ("score", "base_score"))
    assert score > 0.98 * base and sum(r.bits_per_byte * r.n_bytes for r in rows) / sum(r.n_bytes for r in rows) < 2.5


def test_hosts_paths_and_rules_equal_a_loop(spark):
    rng = random.Random(12)
    rows = [(i, "".join(rng.choice(["http", "://", "://", "/", "?", "#", "a.", "org", "com", "example.", "es/", "en/1", "fr/", "de/", "O", "/", "x"]) for _ in range(rng.randint(0, 9)))) for i in range(600)] + [(1000, None)]

    def plain(url):
        head, mark, rest = (url or "").partition("://")
        rest = rest if mark else ""
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [(len(r), r, v) for v, r in urls.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/"):])]
        return (host, path, *(max(fits)[1:] if fits else (None, None)))

    for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect():
        want = plain(dict(rows)[r.id])
        assert (r.host, r.path, r.rule) == want[:3] and r.verdict in ({want[3]} if want[3] else {"allow", "block"})


def test_trees_judge_urls_without_a_rule(spark):
    """Labelled URLs that differ in length and digits; the same kinds under a host that no rule names."""
    rng = random.Random(13)
    make = lambda host, bad: f"http://{host}" + ("".join(str(rng.randrange(10)) for _ in range(40)) if bad else rng.choice(["about", "news", "team"]))
    rows = [(i, make(f"h{i % 9}.com/{'de' if i % 2 else 'fr'}/", i % 2)) for i in range(400)] + [(1000 + i, make("shop.net/", i % 2)) for i in range(100)]
    out = {r.id: r.verdict for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert sum(out[1000 + i] == ("block" if i % 2 else "allow") for i in range(100)) > 90


def test_quotes_equal_the_sql(spark, tmp_path):
    """Generated threads with nested quotes: links, threads and positions against the SQL."""
    import duckdb

    from cuegrid.llm import quotes

    rng = random.Random(14)
    rows = []
    for conv in range(12):
        said: list[str] = []
        for turn in range(rng.randint(1, 14)):
            lines = []
            if said and rng.random() < 0.8:
                for _ in range(rng.randint(1, 3)):
                    old = rng.choice(said)
                    lines += [rng.choice(["> ", ">", ">> ", "> > "]) + x for x in rng.sample(old.split("\n"), k=min(2, len(old.split("\n"))))]
            lines += [f"{rng.choice(['Yes', 'No', 'Well'])} {rng.choice('abcdef')} {rng.randint(0, 30)}" for _ in range(rng.randint(0, 3))]
            rng.random() < 0.3 and lines.append("> never said")
            said.append("\n".join(lines))
            rows.append((conv, turn, rng.choice(["user", "assistant"]), said[-1]))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = quotes.linked(df).withColumnRenamed("conv", "conv_id")
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    found = con.execute(quotes.OP1_SQL)
    names = [x[0] for x in found.description]
    want = sorted(map(repr, (tuple(r[names.index(c)] for c in out.columns) for r in found.fetchall())))
    got = [tuple(r) for r in out.collect()]
    assert sorted(map(repr, got)) == want
    at = {c: i for i, c in enumerate(out.columns)}
    assert sum(r[at["n_linked"]] > 0 for r in got) > 30 and max(r[at["depth"]] for r in got) > 3 and max(r[at["quote_depth"]] for r in got) > 1
    text = {(c, t): x for c, t, _, x in rows}
    for r in got:  # a reply quotes a line or passage that the message it replies to has of its own
        if r[at["reply_to"]] is not None:
            own = " ".join(x for x in text[r[at["conv_id"]], r[at["reply_to"]]].lower().split("\n") if not x.startswith(">"))
            assert any(x.lstrip("> ").lower() in own for x in text[r[at["conv_id"]], r[at["turn"]]].split("\n") if x.startswith(">"))


def test_trees_follow_their_labels(spark):
    rows = [(i, f"http://h{i % 9}.{'com/de' if i % 2 else 'com/fr'}/{i}") for i in range(200)] + [(1000 + i, f"http://h{i}.net/{'de' if i % 2 else 'fr'}/{i}") for i in range(40)]
    out = {r.id: r for r in urls.judged(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert all(out[i].verdict == ("block" if i % 2 else "allow") and out[i].rule for i in range(200))
    assert all(out[1000 + i].rule is None and out[1000 + i].verdict in ("allow", "block") and 0 <= out[1000 + i].score <= 1 for i in range(40))


def test_rare_words_reach_their_texts_by_a_join(spark, monkeypatch):
    rows = spark.createDataFrame([(i, f"the the w{i} w{i % 3} é", i % 4 > 0) for i in range(40)] + [(99, None, True)], "doc_id long, text string, learn boolean")
    want = sorted(tuple(r) for r in mixlm.scored(rows).select("id", "n_tokens", "n_known", F.round("base_score", 6)).collect())
    monkeypatch.setattr(mixlm, "FREQUENT", 3)
    assert sorted(tuple(r) for r in mixlm.scored(rows).select("id", "n_tokens", "n_known", F.round("base_score", 6)).collect()) == want


def test_known_words_are_scored_in_their_context(spark):
    """Words that the corpus holds, in the order that it holds and in another: no word stands twice in a text."""
    rows = [(i, "the quick brown fox jumps over a lazy dog", True) for i in range(30)] + [(100, "the quick brown fox jumps over a lazy dog", False), (101, "dog lazy a over jumps fox brown quick the", False)]
    out = {r.id: r for r in mixlm.scored(spark.createDataFrame(rows, "doc_id long, text string, learn boolean")).collect()}
    assert out[100].n_known == out[101].n_known == 10 and abs(out[100].base_score - out[101].base_score) < 1e-9
    assert out[100].bits_per_byte < 0.5 * out[101].bits_per_byte


def _small_model(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    topics = mixlm.learnt_topics(rows)
    counts = mixlm.word_counts(rows.withColumn("learn", F.lit(True)), topics).cache()
    own, bits = mixlm.word_trees(counts), [18] * 6
    return rows, counts, mixlm.fresh(topics, own, bits, mixlm.tables(counts, rows, 2, topics, own, bits))


def _topic(topics, before):
    """The topic after some words, word by word; the number of kinds where there is none."""
    import numpy as np
    import pyarrow as pa

    if not before:
        return len(topics.prior)
    said = topics.prior.copy()
    for w in before:
        said = said + topics.logs[int(mixlm.Words(pa.array([w.decode()])).hashes()[0]) % mixlm.TOPIC_FEATURES]
    return int(np.argmax(np.round(said, 6)))


def _paths(model, word):
    """[(bytes so far, node, bit)] of a word with its end, bit by bit along the trees."""
    out, stream = [], word + (b" " if word else b"\0")
    for i, byte in enumerate(stream):
        two = 32 << 8 if i == 0 else word[i - 1] << 8 | (32 if i == 1 else word[i - 2])
        begin, n = divmod(int(model.trees.path[model.trees.of[two] * 256 + byte]), 32)
        out += [(stream[:i], d, int(x) >> 4, int(x) & 1) for d, x in enumerate(model.trees.decisions[begin : begin + n])]
    return out


def test_scores_equal_a_loop_over_bits(spark):
    """A small model's counts and scores against dictionaries and a loop, decision by decision."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    vocab = ["a", "of", "the", "cat", "dogs", "house", "running", "é", "x1"]
    texts = [" ".join(rng.choice(vocab) for _ in range(rng.randint(0, 12))) for _ in range(40)]
    _, _, model = _small_model(spark, texts)
    seen: dict = defaultdict(lambda: [0, 0])

    def steps(text):
        before, earlier = None, []
        for w in [*text.encode().split(), b""]:
            topic = _topic(model.topics, earlier)
            for so_far, depth, place, bit in _paths(model, w):
                padded = b"\0" * 3 + b" " + so_far
                node = (place, depth)
                keys = [("last2", padded[-2:], node), ("last4", padded[-4:], node), ("kind", topic, padded[-3:], node), ("word", so_far, node), ("topic", topic, so_far, node), ("before", before, so_far, node) if len(so_far) < mixlm.HEAD else None]
                yield keys, depth, bit
            before = w
            earlier.append(w)

    for t in texts:
        for keys, _, bit in steps(t):
            for k in keys:
                seen[k][bit] += k is not None
    learner = mixlm.Learner(model)
    learner.learn(mixlm.Part(pa.array(texts), model.topics))
    model = mixlm.merged(model, learner.sums())
    probe = [*texts[:8], "the unseen cat", "", "zzz of of"]
    got = mixlm.Scorer(mixlm.for_scoring(model)).scores(mixlm.Part(pa.array(probe), model.topics), len(probe))
    for t, have in zip(probe, got, strict=True):
        want = 0.0
        for keys, depth, bit in steps(t):
            pairs = [int(mixlm.coded(np.array(seen[k][0]))) * 256 + int(mixlm.coded(np.array(seen[k][1]))) if k in seen and k else 0 for k in keys]
            chosen = 4 * (pairs[3] != 0) + 2 * (pairs[4] != 0) + (pairs[5] != 0)
            place = chosen * 8 + min(depth, 7)
            mixed = model.bias[place]
            for o, p in enumerate(pairs):
                state = mixlm.STATE[p]
                mixed += model.weights[o][chosen * 16 + model.levels[state]] * model.stretched[state]
            p = 0.5 * np.interp(mixed, np.linspace(-8, 8, 33), model.refined[place]) + 0.5 / (1 + math.exp(-mixed))
            want += math.log10(p if bit else 1 - p)
        assert abs(have - want) < 0.02 * abs(want) + 0.05, t


def test_probabilities_of_all_bytes_add_up_to_one(spark):
    """Every byte has a path, and the paths of a tree fill it."""
    _, _, model = _small_model(spark, ["one two", "three"])
    length = (model.trees.path & 31).reshape(-1, 256)
    assert length.min() > 0 and abs((0.5 ** length).sum(axis=1) - 1).max() < 1e-9


def test_counts_are_whole(spark, monkeypatch):
    """Counts beyond 2 ** 31 add up, tables grow with the words, and blocks that are handed out early lose nothing."""
    import numpy as np

    assert mixlm.table_bits(1 << 22)[3] == mixlm.table_bits(1 << 21)[3] + 1
    assert len({*mixlm.coded(np.array([1 << 24, 1 << 26, 1 << 31, 3 << 31, 1 << 37])).tolist()}) == 5
    for w in (np.array([5_000_000_000, 3, 0]), np.array([1] * 1000), np.zeros(2, np.int64)):
        parts = list(mixlm.shares(w, 1 << 20))
        assert sum(parts, np.zeros(len(w), np.int64)).tolist() == w.tolist() and all(p.sum() <= 1 << 20 for p in parts)
    rows, counts, model = _small_model(spark, ["a b a", "b " * 500, "c a b"])
    topic = counts.where(F.col("token") == F.lit(b"a")).agg(F.min("topic")).first()[0]
    many = counts.withColumn("trained", F.when(F.col("token") == F.lit(b"a"), F.when(F.col("topic") == topic, F.lit(6_000_000_000)).otherwise(0)).otherwise(F.col("trained")))
    bits = model.bits
    word = mixlm.tables(many, rows, 2, model.topics, model.trees, bits)[3]
    assert max(int(x) for x in mixlm.coded(np.array([6_000_000_000]))) in {*(word >> 8).tolist(), *(word & 255).tolist()}
    monkeypatch.setitem(mixlm.FULL, 2, 3)
    early = mixlm.tables(counts, rows, 2, model.topics, model.trees, bits)
    assert all(np.array_equal(x, y) for x, y in zip(early, model.tables, strict=True)) and early[5].any()


def test_weights_of_several_tasks_are_near_those_of_one(spark):
    """The uses that tasks add up are those of every decision to learn from."""
    import copy

    import pyarrow as pa

    texts = [f"w{i} x{i % 7} of the w{i % 11}" for i in range(3000)]
    rows, _, model = _small_model(spark, texts)
    one = mixlm.Learner(copy.deepcopy(model))
    one.learn(mixlm.Part(pa.array(texts), model.topics))
    several = mixlm.fitted(rows, 4, model)  # four learners
    assert one.mass.sum() > 3000 * 5 and abs(several.weights - one.model.weights).mean() < 0.1


def test_scores_do_not_depend_on_the_split(spark):
    rows = [(i, f"the w{i % 9} and der x{i % 5} " * (1 + i % 4), i % 5 > 0) for i in range(300)] + [(900, None, True), (901, "", False)]
    table = spark.createDataFrame(rows, "doc_id long, text string, learn boolean")
    one, seven = ({r.id: r for r in mixlm.scored(table.repartition(n)).collect()} for n in (1, 7))
    assert one.keys() == seven.keys()
    assert all(abs(one[i].score - seven[i].score) < 1e-6 and abs(one[i].base_score - seven[i].base_score) < 1e-9 for i in one)


def test_topics_follow_the_words(spark):
    """Two kinds of texts without a word in common: from its first words a text has the topic of its kind."""
    import pyarrow as pa

    rng = random.Random(2)
    texts = [" ".join(rng.choice([f"{'ab'[i % 2]}{k}" for k in range(40)]) for _ in range(30)) for i in range(200)]
    topics = mixlm.learnt_topics(spark.createDataFrame([(t,) for t in texts] + [(None,), ("",)], "text string"))
    words = mixlm.Words(pa.array(texts))
    now, last = topics.running(words.hashes(), words.first)
    kinds = [set(last[k::2].tolist()) for k in (0, 1)]
    assert kinds[0].isdisjoint(kinds[1]) and set(now[words.first[:-1]].tolist()) == {len(topics.prior)}
    second = now[words.first[:-1] + 3]
    assert all(second[i] in kinds[i % 2] for i in range(200))


def test_own_occurrences_are_taken_out():
    import numpy as np

    pairs = np.array([3 << 8 | 2, 0 << 8 | 1, 200 << 8 | 5, 15 << 8 | 15])
    assert mixlm.without(pairs, np.array([1, 1, 0, 0]), np.array([1, 1, 3, 20])).tolist() == [3 << 8 | 1, 0, 200 << 8 | 5, 15]


def test_one_url_many_times_leaves_both_verdicts(spark, monkeypatch):
    """The URL of least hash fills a sample that counts repeats; suffixes outside the sample have their counts too."""
    from pyspark.sql import functions as F

    names = [f"http://h{i}.{'com/de' if i % 2 else 'com/fr'}/{i}" for i in range(60)]
    least = spark.createDataFrame([(u,) for u in names], "url string").orderBy(F.xxhash64("url")).first().url
    monkeypatch.setattr(urls, "FIT_URLS", 40)
    every = [*names, *[least] * 60, *[f"http://n{i}.net/{'de' if i % 2 else 'fr'}/{i}" for i in range(20)]]
    out = {r.id: r for r in urls.judged(spark.createDataFrame(list(enumerate(every)), "page_id long, url string")).collect()}
    assert len(out) == len(every) and {0.0, 1.0}.isdisjoint({out[i].score for i in range(120, 140)})
    assert urls._quotas({"allow": 1000, "block": 1}, 40) == {"allow": 39, "block": 1} and urls._quotas({"allow": 30, "block": 9}, 40) == {"allow": 30, "block": 9}


def test_exact_sql_deletes_all_space(spark, tmp_path):
    """The six kinds of space within texts: one class, in SQL and in the operator."""
    import duckdb

    rows = [(i, f"a{c}b") for i, c in enumerate(" \t\n\x0b\f\r")] + [(9, "a-b")]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = {r[0]: tuple(r) for r in con.execute(f"SELECT doc_id, keep_id, group_size, kept FROM ({exact_dedup.OP10_SQL})").fetchall()}
    got = {r.id: (r.id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(table).collect()}
    assert got == want and want[0][2] == 6
