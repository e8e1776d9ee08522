"""Language ID of words and texts by a linear-chain conditional random field."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import crc_mod, small, stored
from cuegrid.llm.textnum import Words, freed, mix64, pieces

SLOTS = 1 << 17
#: The model is fitted on at most so many labelled texts of each language and so many consecutive words of each.
FIT_TEXTS, FIT_WORDS = 400, 96
#: A word is in the lexicon if the fitted texts hold it so often.
LEXICON_COUNT = 3
#: Texts of all languages together on which the model is fitted at most; with more than 250 languages each has fewer.
FIT_ALL = 100_000
#: Words of a chain. A longer text is several chains that hand their messages on, so the cuts change no result.
CHAIN = 256
#: Chains side by side and bytes of texts at once, which bound a worker's memory.
SIDE, TEXT_BYTES = 512, 1 << 20
UNDETERMINED = "und"


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # (SLOTS, langs): affixes, n-grams and lexicon words by hash
    moves: np.ndarray  # (langs, langs): transitions
    lexicon: np.ndarray  # sorted hashes of the lexicon's words


def _hashed(tag: int, x: np.ndarray) -> np.ndarray:
    return (mix64(x + np.uint64((tag * 0x9FB21C651E98DF25) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(47)).astype(np.int64)


def features(words: Words, which: np.ndarray, hashes: np.ndarray, lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first): feature slots of the words numbered ``which``, one word after another, and where each begins.

    Byte bigrams and trigrams with the word's borders, prefixes and suffixes of 2 and 4 bytes, and the word itself if it is in the lexicon.
    """
    starts, n = words.starts[which], words.ends[which] - words.starts[which]
    width = n + 2
    begin = np.concatenate(([0], np.cumsum(width)))
    owner = np.repeat(np.arange(len(which)), width)
    at = np.arange(begin[-1]) - begin[owner]
    c = np.zeros(begin[-1] + 2, np.uint64)
    inside = (at > 0) & (at <= n[owner])
    c[:-2][inside] = words.data[starts[owner[inside]] + at[inside] - 1]
    c[:-2][at == 0], c[:-2][at == n[owner] + 1] = 256, 257
    two = c[:-1] * np.uint64(258) + c[1:]
    three = two[:-1] * np.uint64(258) + c[2:]
    cols = [(1, two[: begin[-1]], at <= n[owner]), (2, three[: begin[-1]], at < n[owner])]
    slots = [(_hashed(tag, x[ok]), owner[ok]) for tag, x, ok in cols]
    for k in (2, 4):
        ok = np.flatnonzero(n >= k)
        for tag, from_ in ((10 + k, begin[ok] + 1), (20 + k, begin[ok] + 1 + n[ok] - k)):
            x = np.zeros(len(ok), np.uint64)
            for j in range(k):
                x = x * np.uint64(258) + c[from_ + j]
            slots.append((_hashed(tag, x), ok))
    place = np.searchsorted(lexicon, hashes)
    known = np.flatnonzero(lexicon[np.minimum(place, len(lexicon) - 1)] == hashes) if len(lexicon) else np.zeros(0, np.int64)
    slots.append((_hashed(30, hashes[known]), known))
    slot, own = np.concatenate([s for s, _ in slots]), np.concatenate([o for _, o in slots])
    order = np.argsort(own, kind="stable")
    return slot[order], np.concatenate(([0], np.cumsum(np.bincount(own, minlength=len(which)))))


def word_scores(words: Words, model: Model) -> np.ndarray:
    """(words, langs): the summed weights of each word's features; each distinct word is looked up once."""
    hashes = words.hashes()
    distinct, which, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    out = np.empty((len(distinct), len(model.langs)), np.float32)
    for i in range(0, len(distinct), 1 << 15):
        slot, first = features(words, which[i : i + (1 << 15)], distinct[i : i + (1 << 15)], model.lexicon)
        out[i : i + (1 << 15)] = np.add.reduceat(model.weights[slot], first[:-1]) if len(slot) else 0
    return out[inverse]


def forward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward messages of chains that lie side by side: scores (steps, chains, labels), lengths falling, start (chains, labels) what the first step is weighted by.

    Returns (messages scaled to sum 1, exponentiated scores, log of the scale of each chain's last message).
    """
    top = scores.max(axis=2, keepdims=True)
    psi = np.exp(scores - top)
    go = np.exp(moves).astype(psi.dtype)
    alpha, z = np.zeros_like(psi), np.zeros(scores.shape[1])
    for t, m in enumerate(_live(lengths, len(scores))):
        a = psi[t, :m] * (alpha[t - 1, :m] @ go) if t else psi[t, :m] if start is None else psi[t, :m] * start[:m]
        s = a.sum(axis=1, keepdims=True)
        alpha[t, :m] = a / s
        z[:m] += np.log(s[:, 0]) + top[t, :m, 0]
    return alpha, psi, z


def _live(lengths: np.ndarray, steps: int) -> np.ndarray:
    """How many chains are longer than each step."""
    return np.searchsorted(-lengths, -np.arange(steps), "left")


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: np.ndarray | None = None, end: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of chains that lie side by side: scores (steps, chains, labels), lengths falling; start and end (chains, labels) are the messages that come from before and after a chain.

    Returns marginals (steps, chains, labels), the summed pair marginals (labels, labels) and log-partition of each chain.
    """
    steps, _, k = scores.shape
    alpha, psi, z = forward(scores, lengths, moves, start)
    go = np.exp(moves).astype(psi.dtype)
    live = _live(lengths, steps)
    beta, pair = np.ones_like(psi), np.zeros((k, k))
    if end is not None:
        beta[lengths - 1, np.arange(len(lengths))] = end
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        right = psi[t + 1, :m] * beta[t + 1, :m]
        b = right @ go.T
        joint = alpha[t, :m] * b
        total = joint.sum(axis=1, keepdims=True)
        pair += (alpha[t, :m] / total).T @ right * go
        beta[t, :m] = b / b.sum(axis=1, keepdims=True)
    both = alpha * beta
    return both / np.maximum(both.sum(axis=2, keepdims=True), 1e-30), pair, z


def _chains(first: np.ndarray, size: int = CHAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, text) of the chains of all texts, in the order of the texts."""
    n = np.diff(first)
    count = -(-n // size)
    owner = np.repeat(np.arange(len(n)), count)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    start = first[:-1][owner] + k * size
    return start, np.minimum(size, first[1:][owner] - start), owner


def _side_by_side(starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chains, their lengths, words (steps, chains)) of SIDE chains at a time, longest first."""
    order = np.argsort(-lengths, kind="stable")
    for i in range(0, len(order), SIDE):
        own = order[i : i + SIDE]
        n = lengths[own]
        yield own, n, starts[own][None, :] + np.minimum(np.arange(n[0])[:, None], n[None, :] - 1)


def _messages(scores: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owner: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each chain: what its neighbours in the same text send, ones at a text's borders.

    A chain is a matrix from the label before it to the label at its end; one forward pass from each label gives its
    rows, and the few chains of a text are then multiplied one after another.
    """
    k = scores.shape[1]
    go = np.exp(moves)
    start, end = np.ones((len(starts), k)), np.ones((len(starts), k))
    several = np.flatnonzero(np.bincount(owner, minlength=1)[owner] > 1)
    if not len(several):
        return start, end
    through, alone = np.empty((len(starts), k, k)), np.empty((len(starts), k))
    for part, n, at in _side_by_side(starts[several], lengths[several]):
        own, x, last = several[part], scores[at], (n - 1, np.arange(len(n)))
        rows = []
        for i in range(k):
            alpha, _, z = forward(x, n, moves, np.broadcast_to(go[i], (len(own), k)))
            rows.append((alpha[last], z))
        top = np.max([z for _, z in rows], axis=0)
        for i, (a, z) in enumerate(rows):
            through[own, i] = a * np.exp(z - top)[:, None]
        alone[own] = forward(x, n, moves)[0][last]
    for j, c in enumerate(several):
        if j and owner[several[j - 1]] == owner[c]:
            start[c] = came @ go  # noqa: F821
            came = came @ through[c]  # noqa: F821
        else:
            came = alone[c]
        came = came / came.sum()
    for j in range(len(several) - 2, -1, -1):
        c, after = several[j], several[j + 1]
        if owner[c] == owner[after]:
            sent = through[after] @ end[after]
            end[c] = sent / sent.sum()
    return start, end


def word_marginals(words: Words, model: Model, size: int = CHAIN) -> np.ndarray:
    """(words, langs): the probability of each language at each word."""
    scores = word_scores(words, model)
    out = np.zeros_like(scores)
    starts, lengths, owner = _chains(words.first, size)
    start, end = _messages(scores, starts, lengths, owner, model.moves)
    for own, n, at in _side_by_side(starts, lengths):
        marginal, _, _ = forward_backward(scores[at], n, model.moves, start[own].astype(scores.dtype), end[own].astype(scores.dtype))
        inside = np.arange(n[0])[:, None] < n[None, :]
        out[at[inside]] = marginal[inside]
    return out


def fit(texts: list[str], labels: list[str], *, epochs: int = 6, seed: int = 5) -> Model:
    """A model from texts of one language each. Code-switched chains are spliced from runs of 4 to 40 words of random texts, so that transitions are learned as well."""
    langs = sorted(set(labels))
    k, rng = len(langs), np.random.default_rng(seed)
    words = Words(pa.array(texts, pa.string()))
    label = np.array([langs.index(x) for x in labels])[words.row] if len(words) else np.zeros(0, np.int64)
    hashes = words.hashes()
    distinct, counts = np.unique(hashes, return_counts=True)
    lexicon = distinct[counts >= LEXICON_COUNT]
    model = Model(langs, np.zeros((SLOTS, k), np.float32), np.zeros((k, k), np.float32), lexicon)
    if k < 2 or not len(words):
        return model
    slot, begin = features(words, np.arange(len(words)), hashes, lexicon)
    size = np.diff(begin)
    grad_w, grad_m = np.full((SLOTS, k), 1e-6, np.float32), np.full((k, k), 1e-6)
    full = np.flatnonzero(np.diff(words.first) > 0)
    steps, per = 64, 64
    for _ in range(epochs * max(1, len(words) // (steps * per))):
        at = np.empty((steps, per), np.int64)
        for j in range(per):
            t = 0
            while t < steps:
                text = full[rng.integers(len(full))]
                run = min(steps - t, int(rng.integers(4, 41)), words.first[text + 1] - words.first[text])
                from_ = words.first[text] + rng.integers(words.first[text + 1] - words.first[text] - run + 1)
                at[t : t + run, j] = np.arange(from_, from_ + run)
                t += run
        flat = at.reshape(-1)
        reps = size[flat]
        where = np.repeat(begin[flat] - np.concatenate(([0], np.cumsum(reps)[:-1])), reps) + np.arange(reps.sum())
        own, feats = np.repeat(np.arange(len(flat)), reps), slot[where]
        scores = np.zeros((len(flat), k), np.float32)
        np.add.at(scores, own, model.weights[feats])
        marginal, pair, _ = forward_backward(scores.reshape(steps, per, k), np.full(per, steps), model.moves)
        gold = label[at]
        error = marginal.reshape(-1, k).copy()
        error[np.arange(len(flat)), gold.reshape(-1)] -= 1
        used, inverse = np.unique(feats, return_inverse=True)
        g = np.stack([np.bincount(inverse, error[own, i], len(used)) for i in range(k)], axis=1).astype(np.float32) / per + 1e-5 * model.weights[used]
        grad_w[used] += g * g
        model.weights[used] -= 0.3 * g / np.sqrt(grad_w[used])
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:-1].reshape(-1), gold[1:].reshape(-1)), 1)
        gm = (pair - seen) / per
        grad_m += gm * gm
        model.moves -= (0.1 * gm / np.sqrt(grad_m)).astype(np.float32)
    return model


def sample(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = FIT_TEXTS, words: int = FIT_WORDS) -> tuple[list[str], list[str]]:
    """Runs of words from at most ``texts`` labelled texts of each language, the ones of least hash; at most ``words`` words of each from a hashed place in it.

    Only ids whose hash lies below a bound that follows from the language's counted texts, about four times as many as
    are wanted, are ranked, so a language's ranking stays small however many texts it has. No language is left out: with
    more than FIT_ALL / texts languages, each has fewer texts.
    """
    id_, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    named = docs.select(id_.alias("id"), lang.alias("lang"), text.alias("text")).where("lang is not null and text is not null and id is not null")
    counts = stored(named.groupBy("lang").count())
    texts = max(1, min(texts, FIT_ALL // max(1, counts.count())))
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)).cast("double") / (1 << 30)
    near = named.select("id", "lang").join(small(counts), "lang").where(share * F.col("count") <= 4 * texts + 16)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    ids = stored(near.select("id", "lang", rank.alias("rank")).where(F.col("rank") <= texts).select("id", "lang").distinct())
    some = named.join(small(ids), ["id", "lang"], "left_semi").withColumn("w", F.split(F.trim("text"), "[ \\t\\n\\x0B\\f\\r]+"))
    some = some.withColumn("from", (F.abs(F.xxhash64("id") % F.greatest(F.lit(1), F.size("w") - words)) + 1).cast("int"))
    parts = some.select("lang", "id", F.array_join(F.slice("w", F.col("from"), words), " ").alias("t"))
    rows = parts.groupBy("lang", "id").agg(F.min("t").alias("t")).orderBy("lang", "t").collect()  # at most FIT_ALL
    return [r.t for r in rows], [r.lang for r in rows]


def labelled(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", per_word: bool = False) -> DataFrame:
    """(id, lang_pred, score, shares) of each row: the language with the largest sum of word probabilities, its mean
    probability over the words that have letters, and the mean of each language; with per_word also ``labels``, the most likely language of each word.

    A null text and one without a letter are ``und`` with score 0, as is everything if nothing was labelled. All words of
    a text count in one chain; memory follows the longest text. Repeated rows and clashing columns
    do no harm: each row is read by itself and only two columns are read.
    """
    return _mapped(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")), model, None, per_word)


def _mapped(named: DataFrame, model: Model, field: str | None, per_word: bool = False) -> DataFrame:
    """labelled() of (id, text), or of (id) where id is a struct that holds the text in a field, so that it travels once."""
    shipped = named.sparkSession.sparkContext.broadcast(model)  # fixed number of slots
    kind = named.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        k = len(own.langs)
        names = np.array([*own.langs, UNDETERMINED], dtype=object)
        letter = np.zeros(256, bool)
        letter[97:123], letter[128:] = True, True
        for batch in batches:
            if field is not None:
                batch = pa.RecordBatch.from_arrays([batch.column("id"), pc.struct_field(batch.column("id"), field)], ["id", "text"])
            for piece in pieces(batch, limit=TEXT_BYTES):
                words = Words(piece.column("text"))
                rows = piece.num_rows
                marginal = word_marginals(words, own) if k and len(words) else np.zeros((len(words), max(k, 1)), np.float32)
                lettered = np.concatenate(([0], np.cumsum(letter[words.data])))
                weight = (lettered[words.ends] > lettered[words.starts]).astype(np.float64)
                total = np.bincount(words.row, weight, rows)
                share = np.stack([np.bincount(words.row, weight * marginal[:, i], rows) for i in range(k)], axis=1) / np.maximum(total, 1)[:, None] if k else np.zeros((rows, 1))
                ascii_ = np.concatenate(([0], np.cumsum((words.data >= 97) & (words.data <= 122))))
                plain = np.zeros(rows, bool)
                np.logical_or.at(plain, words.row, ascii_[words.ends] > ascii_[words.starts])
                texts = piece.column("text")
                has = np.array([bool(p) or (k > 0 and t > 0 and any(ch.isalpha() for ch in texts[i].as_py())) for i, (p, t) in enumerate(zip(plain, total, strict=True))], bool)
                best = np.where(has & (k > 0), share.argmax(axis=1), k)
                score = np.where(best < k, share.max(axis=1), 0.0)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * share.shape[1]), pa.array(share.reshape(-1)))
                columns = [piece.column("id"), pa.array(names[best], pa.string()), pa.array(np.clip(score, 0, 1)), lists]
                if per_word:
                    tags = names[marginal.argmax(axis=1)] if k else np.full(len(words), UNDETERMINED, object)
                    columns.append(pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), pa.array(tags, pa.string())))
                yield pa.RecordBatch.from_arrays(columns, ["id", "lang_pred", "score", "shares", *["labels"] * per_word])
        freed()

    return named.mapInArrow(run, f"id {kind}, lang_pred string, score double, shares array<double>" + ", labels array<string>" * per_word)


def train(docs: DataFrame, **columns) -> Model:
    """A model from the rows of docs; the fit is on the driver, over a sample bounded by FIT_TEXTS and FIT_WORDS."""
    return fit(*sample(docs, **columns))


def keep(docs: DataFrame, *, least: float = 0.3, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs whose language is recognised: not ``und``, and a mean word probability of at least ``least``. The columns of docs, nothing else.

    The rows travel beside their prediction in one pass, so no join is needed.
    """
    train_on = docs.where(crc_mod(F.col(f"`{id_col}`"), 4) != 2)
    model = train(train_on, id_col=id_col, text_col=text_col, lang_col=lang_col)
    found = _mapped(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("id")), model, text_col)
    return found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least)).select("id.*")


def op2_langid(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = crc_mod(F.col("doc_id"), 4) == 2
    model = train(docs.where(~held_out))
    return labelled(docs, model).select(F.col("id").alias("doc_id"), (crc_mod(F.col("id"), 4) == 2).alias("held_out"), "lang_pred", "score")
