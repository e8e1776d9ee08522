"""Language model scores by logistic context mixing over bits.

A text is its words, each followed by one end byte, then an end of text. A byte is a few binary decisions, the path to it
in a Huffman tree that the last two bytes within the word choose; a path's decisions give every byte a probability,
whatever the trees are. Several predictors, each a table of bit counts under a hashed context, give a probability for each
decision: the last two and four bytes, the word so far, the last three bytes and the word so far with the text's topic as it
stands before the word, and, for a word's first bytes, the word so far with the whole word before it. A weight set, chosen by which of the longer
contexts the corpus holds, combines them in the logistic domain, and a map refines the result. Every byte of every text is
scored so, whether the corpus holds its word or not.

A text's topic is what all its words so far speak for, so it adapts as the text is read: the most likely of a few kinds of
texts. Kinds begin as a mixture of some texts and are then fitted in rounds over all texts to learn from. Of the contexts within a word, and of those with the topic, counts follow
from the distinct words of a topic and how often each occurs, and a scorer looks each of them up once in a piece of texts;
what spans two words is counted and looked up at each occurrence.

Counts, kinds, weights and map are over all rows to learn from. Weights and map are a few thousand numbers; as they are
learned, what a text itself has added to a count is taken out first, so that counts are trusted as far as they hold for
texts that were not counted. The weights of a word without the word before it follow from the distinct words of a topic,
dealt to learners by hash. Then every occurrence's first bytes are counted by what the word itself gives, by the state of
the counts under the word before and by the bit, and the weights of the word before follow from these few counts. So
scores don't depend on how the table is split.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import crc_mod, discard, short_batches, stored
from cuegrid.llm.textnum import Words, freed, mix64, pieces, powers

#: Predictors: those within a word, then those across words.
WITHIN, ACROSS = ("last2", "last4", "kind", "word", "topic"), ("before",)
ORDERS = (*WITHIN, *ACROSS)
#: Slots of a table for each distinct word to learn from, and log2 of the fewest and the most slots. At the most slots a
#: table is 2 ** 26 bytes to a scorer; in a corpus with more words contexts then share slots, but every count still counts.
WORD_SLOTS, LEAST_BITS, MOST_BITS = 4, 22, 26
#: The two last bytes are so few contexts that this many bits hold them; the last four need so many bits less than others.
LAST2_BITS, LAST4_LESS = 20, 3
#: Each of the learners, whose results are averaged by use, has about so many rows of words and takes so many in a step; a
#: row stands for at most so many occurrences. Learners' sums are added up in so many groups.
LEARNER_ROWS, STEP_ROWS, ROW_TIMES, SUM_GROUPS = 1 << 17, 1024, 64, 64
#: Steps of what a word itself gives, to a unit and in all, as occurrences are counted.
_FOLD, _FOLDS = 4, 64
#: Kinds of texts, the features that words are hashed to for them, the texts that they begin with at most, and the rounds over all texts.
TOPICS, TOPIC_FEATURES, TOPIC_TEXTS, TOPIC_ROUNDS = 8, 1 << 14, 3000, 2
#: Trees of their own have at most so many pairs of bytes, the most frequent ones; others have the tree of their last byte.
TREES = 512
#: Counts up to 15 are kept exactly, greater ones on a scale of sevenths of octaves, which reaches 2 ** 38.
_EXACT = 16
#: Every scorer holds the counts of at most so many words, the most frequent ones, by their 64-bit hashes (16 bytes a word);
#: base scores of all others reach their texts by a join.
FREQUENT = 1 << 19
#: Rests of at most so many words of a topic, the most frequent ones, are scored once for all scorers (16 bytes each); those of others in every piece that holds them.
RESTS = 1 << 19
END = b" "
#: Bytes of a word's beginning that the word before it foretells.
HEAD = 3
_LEVELS, _STEPS, _SETS, _DEPTHS = 8, 33, 8, 8
#: Steps of the table that a scorer reads probabilities from, and its range to each side.
_FINE, _RANGE = 1024, 10.0
#: Bytes of text taken apart at once, and words that go through the predictors at once; memory follows these or the longest text.
PART_BYTES, CHUNK = 1 << 21, 1 << 12
#: Counts in a block of the summed tables; words to learn from of one task; the count at which a task hands a block out, by bytes of a count.
BLOCK, TASK_WORDS, FULL = 1 << 12, 1 << 24, {2: 1 << 15, 4: 1 << 31}
#: Odd factors of the orders' hashes, and of what stands before the word.
_FACTOR = dict(zip(ORDERS, map(np.uint64, (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)), strict=True))
_BEFORE = {"before": np.uint64(0x589965CC75374CC3)}
_TOPIC = np.uint64(0x8EBC6AF09C88C6E3)


@dataclass
class Topics:
    """Kinds of texts: of each feature of a word what it says for each kind, and what is said before the first word."""

    logs: np.ndarray  # (TOPIC_FEATURES, kinds)
    prior: np.ndarray

    def running(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(topic before each word, topic at the end of each text) of texts whose words begin at ``first``; before any word it is the number of kinds."""
        kinds = self.logs.shape[1]
        feature = (hashes % np.uint64(len(self.logs))).astype(np.int64)
        n, size = np.diff(first), len(hashes)
        best, said = np.full(size + len(n), -1, np.int64), np.full(size + len(n), -np.inf)
        now, better, sums = np.empty(size + len(n)), np.empty(size + len(n), bool), np.zeros(size + 1)
        for k in range(kinds):
            np.cumsum(self.logs[:, k].take(feature), out=sums[1:])
            head = sums[first[:-1]]
            np.subtract(sums[:-1], np.repeat(head, n), out=now[:size])
            np.subtract(sums[first[1:]], head, out=now[size:])
            now += self.prior[k]
            # What is said is rounded to millionths, so that it doesn't depend on what stands before the text.
            now *= 1e6
            np.rint(now, out=now)
            np.greater(now, said, out=better)
            np.copyto(best, k, where=better)
            np.maximum(now, said, out=said)
        best[first[:-1][n > 0]] = kinds
        best[size:][n == 0] = kinds
        return best[:size], best[size:]


    def of_texts(self, feature: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The topic at the end of each text, from the features of its words."""
        said, sums = np.empty((len(first) - 1, self.logs.shape[1])), np.zeros(len(feature) + 1)
        for k in range(said.shape[1]):
            np.cumsum(self.logs[:, k].take(feature), out=sums[1:])
            said[:, k] = sums[first[1:]] - sums[first[:-1]] + self.prior[k]
        return np.round(said, 6).argmax(axis=1)


def kinds_of(weight: np.ndarray, mass: np.ndarray) -> Topics:
    """Kinds of texts from how often each has each feature, and how many texts it has."""
    all_ = weight.sum(axis=1)
    common = (all_ + 0.1) / (all_.sum() + 0.1 * len(all_))
    logs = np.log((weight + 500 * common[:, None]) / (weight.sum(axis=0) + 500) / common[:, None])
    return Topics(np.clip(np.round(logs, 9), -4, 4), np.round(np.log((mass + 1) / (mass.sum() + len(mass))), 9))


def mixture(features: list[np.ndarray], counts: list[np.ndarray], kinds: int, rounds: int = 25) -> Topics:
    """Kinds of texts from texts as numbers of features: a mixture of word distributions by expectation maximisation, begun at texts that are far apart."""
    size = np.array([len(x) for x in features], np.int64)
    if not size.sum():
        return Topics(np.zeros((TOPIC_FEATURES, 1)), np.zeros(1))
    keep = size > 0
    flat, n = np.concatenate(features), np.concatenate(counts).astype(float)
    size = size[keep]
    row, at = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    length = np.add.reduceat(n, at)
    common = (np.bincount(flat, n, TOPIC_FEATURES) + 0.1) / (n.sum() + 0.1 * TOPIC_FEATURES)
    rng, norm = np.random.default_rng(9), np.sqrt(np.add.reduceat(n * n, at))
    near, seeds = np.zeros(len(size)), []
    while len(seeds) < min(kinds, len(size)):
        chance = (1 - np.minimum(near, 1)) ** 2 * np.minimum(length, 100) + 1e-9
        s = int(rng.choice(len(size), p=chance / chance.sum()))
        seeds.append(s)
        vector = np.zeros(TOPIC_FEATURES)
        vector[flat[at[s] : at[s] + size[s]]] = n[at[s] : at[s] + size[s]] / norm[s]
        near = np.maximum(near, np.add.reduceat(n * vector[flat], at) / norm)
    share = np.zeros((len(size), len(seeds)))
    share[seeds, np.arange(len(seeds))] = 1
    for _ in range(rounds):
        weight = np.stack([np.bincount(flat, n * share[row, k], TOPIC_FEATURES) for k in range(len(seeds))], axis=1)
        mass = share.sum(axis=0)
        logs = np.log((weight + 500 * common[:, None]) / (weight.sum(axis=0) + 500) / common[:, None])
        prior = np.log((mass + 1) / (mass.sum() + len(seeds)))
        said = np.stack([np.add.reduceat(n * logs[flat, k], at) for k in range(len(seeds))], axis=1) + prior
        share = np.exp(said - said.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    return Topics(np.clip(np.round(logs, 9), -4, 4), np.round(prior, 9))


def table_bits(words: int) -> list[int]:
    """log2 of each table's slots for so many distinct words to learn from."""
    grown = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(1, WORD_SLOTS * words)))))
    return [min(LAST2_BITS, grown), *[max(LEAST_BITS, grown - LAST4_LESS)] * 2, grown, grown, grown]


def coded(n: np.ndarray) -> np.ndarray:
    """Counts as one byte each."""
    big = np.maximum(n, 1)
    return np.where(n < _EXACT, n, np.minimum(255, _EXACT + np.floor(7 * (np.log2(big) - 4) + 1e-9))).astype(np.uint8)

_COUNT = np.where(np.arange(256) < _EXACT, np.arange(256.0), 2.0 ** (4 + (np.arange(256.0) - _EXACT) / 7))


def _pair_tables() -> tuple[np.ndarray, np.ndarray]:
    """Of a pair of coded counts, 256 * zeros + ones: its stretched probability and its level."""
    n0, n1 = _COUNT[:, None], _COUNT[None, :]
    total = n0 + n1
    level = np.where(total < 0.5, 0, np.minimum(_LEVELS - 1, 1 + np.floor(np.log2(np.maximum(total, 1)) * 0.7))).astype(np.int64)
    sure = np.minimum(n0, n1) == 0  # only one of the bits was seen
    return np.log((n1 + 0.12) / (n0 + 0.12)).astype(np.float32).ravel(), (level * 2 + sure).astype(np.int64).ravel()

STRETCH, LEVEL = _pair_tables()
#: At 16 * code + n a coded count less n occurrences.
_LEFT = np.maximum(_COUNT[:, None] - np.arange(16), 0)
LESS = np.where(_LEFT < _EXACT, np.round(_LEFT), _EXACT + np.round(7 * (np.log2(np.maximum(_LEFT, 1)) - 4))).astype(np.uint8).ravel()


def without(pairs: np.ndarray, bit: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Pairs of coded counts without the ``times`` occurrences of the bit that a text has itself; 15 at most are taken out."""
    shift = np.where(bit, 0, 8)
    own = (pairs >> shift) & 255
    return pairs + ((LESS.take(16 * own + np.minimum(times, 15)).astype(np.int64) - own) << shift)


def _states() -> np.ndarray:
    """Of each pair of coded counts one of at most 256 states: its level and its stretched probability in steps; state 0 is the pair without counts."""
    step = np.clip(np.round(STRETCH * 2), -16, 16).astype(np.int64) + 16
    _, state = np.unique(np.where(LEVEL < 2, 0, LEVEL * 33 + step), return_inverse=True)
    return state.astype(np.uint8) if state.max() < 256 else np.zeros(0, np.uint8)

STATE = _states()


def _left_states() -> np.ndarray:
    """At times << 17 | bit << 16 | pair of coded counts: the state without so many occurrences of the bit."""
    pair = np.arange(1 << 16)
    return np.concatenate([STATE[without(pair, np.full(len(pair), bit), np.full(len(pair), times))] for times in range(16) for bit in (0, 1)])

LEFT = _left_states()


@dataclass
class Trees:
    """Huffman trees: ``of`` the tree of two bytes, ``path`` 32 * begin + length of each (tree, byte), ``decisions`` along all paths: place in a block of slots * 16 + 2 * depth + bit."""

    of: np.ndarray
    path: np.ndarray
    decisions: np.ndarray


def _huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, codes) of a tree over 256 bytes; bytes without a count have a small one, which bounds the depth."""
    heap = [(float(max(c, (counts.sum() + 1) / (1 << 14))), i) for i, c in enumerate(counts.tolist())]
    heapq.heapify(heap)
    kids: list[tuple[int, int]] = []
    while len(heap) > 1:
        (x, a), (y, b) = heapq.heappop(heap), heapq.heappop(heap)
        kids.append((a, b))
        heapq.heappush(heap, (x + y, 255 + len(kids)))
    length, code = np.zeros(256, np.int64), np.zeros(256, np.int64)
    todo = [(heap[0][1], 0, 0)]
    while todo:
        node, n, c = todo.pop()
        if node < 256:
            length[node], code[node] = n, c
        else:
            a, b = kids[node - 256]
            todo += [(a, n + 1, 2 * c), (b, n + 1, 2 * c + 1)]
    return length, code


def trees(pairs: dict[int, np.ndarray], singles: np.ndarray) -> Trees:
    """Trees from counts of bytes: of the last two bytes in ``pairs``, of the last one in singles (256, 256)."""
    rows = [*pairs.values(), *singles]
    of = len(pairs) + (np.arange(1 << 16) >> 8)
    of[list(pairs)] = np.arange(len(pairs))
    path, parts, at = np.zeros(len(rows) * 256, np.int64), [], 0
    for r, row in enumerate(rows):
        length, code = _huffman(row)
        end = np.cumsum(length)
        rest = np.repeat(end, length) - np.arange(end[-1])
        depth = np.repeat(length, length) - rest
        whole = np.repeat(code, length)
        node = (whole >> rest) | (1 << depth)
        # Four decisions in a row stand in one block of 16 slots, which their first node chooses.
        low = (node & ((1 << (depth & 3)) - 1)) | (1 << (depth & 3))
        place = ((((node >> (depth & 3)) * 0x9E3779B1) >> 3) & ((1 << MOST_BITS) - 1) & ~15) ^ low
        parts.append((place << 4 | np.minimum(depth, _DEPTHS - 1) << 1 | ((whole >> (rest - 1)) & 1)).astype(np.uint32))
        path[r * 256 : r * 256 + 256] = (at + end - length) << 5 | length
        at += int(end[-1])
    return Trees(of, path, np.concatenate(parts))


def _laid_out(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, most: int = 1 << 62) -> tuple[np.ndarray, ...]:
    """(bytes, first, size, at, window): words with their ends, or their first ``most`` bytes, each after four bytes of padding; where each begins, its bytes, the place of each byte, and the four bytes before that."""
    inside = np.minimum(ends - starts, most)
    size = np.minimum(ends - starts + 1, most)
    first = np.cumsum(size + 4) - size
    d = np.zeros(int((size + 4).sum()), np.uint8)
    d[first - 1] = END[0]
    done = size > inside
    d[(first + inside)[done]] = np.where(inside[done] > 0, END[0], 0)
    begin = np.cumsum(inside) - inside
    put = np.arange(int(inside.sum()))
    d[np.repeat(first - begin, inside) + put] = data[np.repeat(starts - begin, inside) + put]
    at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    return d, first, size, at, np.ndarray(max(0, len(d) - 3), np.uint32, d.tobytes(), 0, (1,))[at - 4].astype(np.uint64)


def _pairs_before(window: np.ndarray) -> np.ndarray:
    """The last two bytes within the word before each byte: what stands before the word is left out."""
    two = (window >> np.uint64(16)).astype(np.int64)
    two[(two >> 8) == END[0]] = END[0] << 8
    return two


class Bits:
    """The decisions of some words, of their first ``most`` bytes or without their first ``skip`` bytes, one word after another, with the contexts before each byte. ``data`` holds the words' bytes at ``starts`` to ``ends``, ``topics`` the topic before each; an empty word is the end of a text."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, topics: np.ndarray, own: Trees, most: int = 1 << 62, skip: int = 0):
        d, first, size, at, window = _laid_out(data, starts, ends, most)
        power, inverse = powers(len(d) + 1)
        sums = np.zeros(len(d) + 1, np.uint64)
        np.cumsum((d + np.uint64(1)) * power[: len(d)], out=sums[1:])
        start = np.repeat(first, size)
        if skip:
            rest = at - start >= skip
            at, start, window, size = at[rest], start[rest], window[rest], np.maximum(size - skip, 0)
        so_far = (sums[at] - sums[start]) * inverse[start]
        #: The contexts before each byte.
        topic = np.repeat((topics.astype(np.uint64) + np.uint64(1)) * _TOPIC, size)
        self.contexts = {"last2": window >> np.uint64(16), "last4": window, "kind": ((window >> np.uint64(8)) + topic) * _TOPIC, "word": so_far + np.uint64(7), "topic": so_far + topic, "before": so_far}
        path = own.path.take(own.of.take(_pairs_before(window)) * 256 + d[at])
        self.each = path & 31
        end = np.cumsum(self.each)
        place = np.repeat((path >> 5) - (end - self.each), self.each)
        place += np.arange(len(place))
        step = own.decisions.take(place)
        self.bit, self.depth, self.place = (step & 1).astype(np.int64), (step >> 1 & 7).astype(np.int64), step >> 4
        #: Where each word's decisions begin, and its bytes.
        self.first = np.concatenate(([0], end))[np.concatenate(([0], np.cumsum(size)))]
        self.size = size
        #: Decisions of each word's first bytes, which the word before it foretells.
        self.head = size * 0 if skip or not len(size) else np.add.reduceat(np.where(at - start < HEAD, self.each, 0), np.cumsum(size) - size)

    def slots(self, order: str, bits: int) -> np.ndarray:
        """The slot of each decision in the table of an order within words."""
        h = ((self.contexts[order] * _FACTOR[order]) >> np.uint64(64 - bits)).astype(np.uint32)
        return (np.repeat(h, self.each) ^ (self.place & np.uint32((1 << bits) - 1))).astype(np.int64)

    def carried(self, order: str) -> np.ndarray:
        """The part of each decision's hash, in an order across words, that its own word gives."""
        return np.repeat(((self.contexts[order] * _FACTOR[order]) >> np.uint64(32)).astype(np.uint32), self.each)

    def low(self, bits: int) -> np.ndarray:
        """The part of each decision's slot, in an order across words, that its node gives."""
        return self.place & np.uint32((1 << bits) - 1)


class Part:
    """The words of some texts: ``starts`` and ``ends`` in ``data`` of each distinct word of a topic, the last ones empty for the ends of texts; ``at`` the word, ``row`` the text and ``before`` the word before (or -1) of each occurrence, equal words together."""

    def __init__(self, col: pa.Array, topics: Topics, across: bool = True):
        words = Words(col)
        hashes = words.hashes()
        kinds = topics.logs.shape[1] + 1
        now, last = topics.running(hashes, words.first)
        keys = hashes + now.astype(np.uint64) * _TOPIC
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        new = np.concatenate((np.ones(min(1, len(order)), bool), ranked[1:] != ranked[:-1]))
        which, of = order[new], np.empty(len(order), np.int64)
        grouped = np.cumsum(new) - 1
        of[order] = grouped
        ends = np.zeros(kinds, np.int64)
        self.sent = np.append(hashes[which], ends.astype(np.uint64))  # each word's hash, 0 for the end of a text
        self.keys = ranked[new]  # of each word but the ends, in order
        self.topics = np.append(now[which], np.arange(kinds))
        self.data, self.starts, self.ends = words.data, np.append(words.starts[which], ends), np.append(words.ends[which], ends)
        self.at = np.concatenate((grouped, len(which) + last))
        self.row = np.concatenate((words.row[order], np.arange(len(col))))
        if not across:
            return
        n, end = np.diff(words.first), words.first[1:]
        place, head = np.arange(len(of)), np.repeat(words.first[:-1], n)
        found = np.concatenate(([-1], place))  # the word before each place
        own = np.where(found[:-1] >= head, of[found[:-1]], -1) if len(of) else of
        final = np.where(found[end] >= words.first[:-1], np.append(of, -1)[found[end]], -1)
        self.came = {"before": np.concatenate((own[order], final))}

    def times(self, before: bool = False) -> np.ndarray:
        """How often each occurrence's text holds its word of a topic, or holds it with the same word before; equal words stand together, by text."""
        size = len(self.at)
        new = np.concatenate((np.ones(min(1, size), bool), (self.at[1:] != self.at[:-1]) | (self.row[1:] != self.row[:-1])))
        run = np.cumsum(new) - 1
        out = np.bincount(run, minlength=1)[run]
        if before:
            again = np.flatnonzero(out > 1)
            _, which, n = np.unique(run[again] * (len(self.starts) + 1) + self.came["before"][again] + 1, return_inverse=True, return_counts=True)
            out[again] = n[which]
        return out

    def bits(self, own: Trees, most: int = 1 << 62, some: slice | np.ndarray = slice(None), skip: int = 0) -> Bits:
        """Of all distinct words, or some."""
        return Bits(self.data, self.starts[some], self.ends[some], self.topics[some], own, most, skip)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """(one word of each topic and first HEAD bytes, the number of that word for each word): what a word's first bytes are scored by is the same for all words that begin with them."""
        size, key = self.ends - self.starts, self.topics.astype(np.int64)
        padded = np.append(self.data, np.zeros(HEAD, np.uint8))
        for i in range(HEAD):
            key = key * 257 + np.where(size > i, padded[self.starts + i].astype(np.int64) + 1, 0)
        _, first, head = np.unique(key, return_index=True, return_inverse=True)
        return first, head

    def walk(self, first: np.ndarray, at: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """(occurrences, number of decisions of each, the decisions) of CHUNK occurrences at a time, if the decisions of each of ``at`` begin at ``first``."""
        many = np.diff(first)
        for low in range(0, len(at), CHUNK):
            some = at[low : low + CHUNK]
            n = many.take(some)
            place = np.repeat(first.take(some) - (np.cumsum(n) - n), n)
            place += np.arange(len(place))
            yield slice(low, low + CHUNK), n, place

    def slots(self, order: str, size: int, carried: np.ndarray, low: np.ndarray, some: slice, n: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The slots of the decisions ``place`` in the table of an order across words, from what their own words give and their places in a block."""
        came = self.came[order][some]
        h = carried.take(place)
        h += np.repeat((np.where(came < 0, np.uint64(0), self.sent.take(came)) * _BEFORE[order] >> np.uint64(32)).astype(np.uint32), n)
        h >>= np.uint32(32 - size)
        h ^= low.take(place)
        return h.astype(np.int64)


@dataclass
class Model:
    topics: Topics
    trees: Trees
    bits: list[int]  # log2 of each table's slots
    tables: list[np.ndarray]  # 256 * coded zeros + coded ones of each slot; states in a scorer's model
    weights: np.ndarray  # (orders, sets * 2 * levels)
    bias: np.ndarray  # (sets * depths,)
    refined: np.ndarray  # (sets * depths, steps): the map
    stretched: np.ndarray  # of each state the mean stretched probability of its slots
    levels: np.ndarray  # of each state


def fresh(topics: Topics, own: Trees, bits: list[int], tables: list[np.ndarray]) -> Model:
    used = sum(np.bincount(x, minlength=1 << 16) for x in tables) + 1e-9
    mass = np.bincount(STATE, used)
    levels = np.zeros(len(mass), np.int64)
    levels[STATE] = LEVEL
    grid = np.linspace(-8, 8, _STEPS)
    return Model(topics, own, bits, tables, np.full((len(ORDERS), _SETS * 2 * _LEVELS), 0.3), np.zeros(_SETS * _DEPTHS), np.tile(_sigmoid(grid), (_SETS * _DEPTHS, 1)), np.bincount(STATE, used * STRETCH) / mass, levels)


def _chosen(word: np.ndarray, topic: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The weight set of counts under the longer contexts."""
    return 4 * (word != 0) + 2 * (topic != 0) + (before != 0)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Scorer:
    """The model with weights, stretched probabilities and map multiplied out; its tables hold states."""

    def __init__(self, model: Model, held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0))):
        """``held`` are keys of words of a topic, ascending, and the log10 probability of the rest of each."""
        m = self.model = model
        self.held = held
        self.part = []
        for w in m.weights:
            table = np.zeros((_SETS, 256), np.float32)
            table[:, : len(m.levels)] = w.reshape(_SETS, -1)[:, m.levels] * m.stretched
            self.part.append(table.ravel())
        self.bias = m.bias.astype(np.float32)
        x, grid = np.linspace(-_RANGE, _RANGE, _FINE), np.linspace(-8, 8, _STEPS)
        p = np.clip(np.stack([0.5 * np.interp(x, grid, r) + 0.5 * _sigmoid(x) for r in m.refined]), 1e-6, 1 - 1e-6)
        self.logs = np.log10(np.stack([1 - p, p], axis=2)).astype(np.float32).ravel()

    def _logs(self, mixed: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Running sums of log10 probabilities, with a 0 in front; head is where a decision's own row of the table begins."""
        spot = mixed + _RANGE
        spot *= (_FINE - 1) / (2 * _RANGE)
        spot += 0.5
        step = np.clip(spot, 0, _FINE - 1, out=spot).astype(np.int64)
        step <<= 1
        step += head
        out = np.zeros(len(step) + 1)
        np.cumsum(self.logs.take(step), dtype=np.float64, out=out[1:])
        return out

    def scores(self, part: Part, rows: int) -> np.ndarray:
        """log10 probability of each text with its end."""
        m, b = self.model, len(WITHIN)
        # After a word's first bytes no word before speaks, so its rest is looked up once for all its occurrences.
        rest, left = np.zeros(len(part.starts)), part.ends - part.starts >= HEAD
        names, logs = self.held
        if len(names):
            at = np.minimum(np.searchsorted(names, part.keys), len(names) - 1)
            found = np.flatnonzero(names.take(at) == part.keys)
            rest[found], left[found] = logs.take(at[found]), False
        left = np.flatnonzero(left)
        for low in range(0, len(left), CHUNK // 2):
            some = left[low : low + CHUNK // 2]
            rest[some] = self.rests(part.data, part.starts[some], part.ends[some], part.topics[some])
        out = np.bincount(part.row, rest.take(part.at), rows)
        # The words' first bytes, whose part of all words that begin with them is looked up once in both cases.
        which, head = part.heads()
        bits = part.bits(m.trees, HEAD, which)
        states, known, row = self._within(bits)
        cases = np.stack([self._given(states, known, row, case) for case in range(2)], axis=1).ravel()
        row = row * (2 * _FINE) + bits.bit
        carried, small = bits.carried("before"), bits.low(m.bits[b])
        for some, n, place in part.walk(bits.first, head.take(part.at)):
            before = m.tables[b].take(part.slots("before", m.bits[b], carried, small, some, n, place))
            case = (before != 0).astype(np.int64)
            mixed = cases.take(place * 2 + case)
            mixed += self.part[b].take((known.take(place) + case) << 8 | before)
            sums = self._logs(mixed, row.take(place) + case * (_DEPTHS * 2 * _FINE))
            end = np.cumsum(n)
            out += np.bincount(part.row[some], sums[end] - sums[end - n], rows)
        return out

    def rests(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, topics: np.ndarray) -> np.ndarray:
        """log10 probability of each word, in a topic, after its first HEAD bytes."""
        bits = Bits(data, starts, ends, topics, self.model.trees, skip=HEAD)
        states, known, row = self._within(bits)
        silent = self._given(states, known, row, 0)
        silent += self.part[len(WITHIN)].take(known << 8)
        sums = self._logs(silent, row * (2 * _FINE) + bits.bit)
        return sums[bits.first[1:]] - sums[bits.first[:-1]]

    def _within(self, bits: Bits) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(states under the orders within words, weight set if the word before says nothing, row of the map) of each decision."""
        m = self.model
        states = [m.tables[q].take(bits.slots(o, m.bits[q])) for q, o in enumerate(WITHIN)]
        known = _chosen(*states[3:], np.zeros(1)).astype(np.int64)
        return states, known, known * _DEPTHS + bits.depth

    def _given(self, states: list[np.ndarray], known: np.ndarray, row: np.ndarray, case: int) -> np.ndarray:
        """What the word itself gives to each decision, if the word before gives nothing (case 0) or something (1)."""
        chosen = (known + case) << 8
        out = self.bias.take(row + case * _DEPTHS)
        for table, state in zip(self.part, states, strict=False):
            out += table.take(chosen | state)
        return out


def _decisions(first: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where the decisions of each of ``at`` begin, with the end; the decisions), if those of each word begin at ``first``."""
    many = np.diff(first)[at]
    begun = np.concatenate(([0], np.cumsum(many)))
    place = np.repeat(first[at] - begun[:-1], many)
    place += np.arange(len(place))
    return begun, place


def _on_map(mixed: np.ndarray, at: np.ndarray, mass: np.ndarray, hits: np.ndarray) -> list[np.ndarray]:
    """Mass and hits on the map, each shared between the steps next to it."""
    spot = (np.clip(mixed, -7.999, 7.999) + 8) * ((_STEPS - 1) / 16)
    low = spot.astype(np.int64)
    share, low, size = spot - low, low + at * _STEPS, _SETS * _DEPTHS * _STEPS
    return [np.bincount(low, x * (1 - share), size) + np.bincount(low + 1, x * share, size) for x in (mass, hits)]


class Learner:
    """Weights learned online over texts, with what a text itself has added taken out of its counts, and the sums that the map follows from."""

    def __init__(self, model: Model):
        m = self.model = model
        self.grown = {k: np.full(getattr(m, k).shape, 1e-3) for k in ("weights", "bias")}
        self.uses = {k: np.zeros(getattr(m, k).shape) for k in ("weights", "bias")}
        self.mass, self.hits = np.zeros(m.refined.size), np.zeros(m.refined.size)

        self.kind = np.eye(2 * _LEVELS)[m.levels]  # (states, levels)
        #: How often each (longer contexts that are known, depth, step of what the word gives, state under the word before, bit) occurs.
        self.cells = np.zeros(_SETS // 2 * _DEPTHS * _FOLDS * 512, np.int64)

    def _move(self, name: str, at, g: np.ndarray, uses: np.ndarray, rate: float, n: int) -> None:
        g = g / max(n, 16)
        self.grown[name][at] += g * g
        getattr(self.model, name)[at] -= rate * g / np.sqrt(self.grown[name][at])
        self.uses[name][at] += uses

    def _given(self) -> list[np.ndarray]:
        """What each order within words gives, by set and state."""
        m = self.model
        return [(w.reshape(_SETS, -1)[:, m.levels] * m.stretched).ravel() for w in m.weights[: len(WITHIN)]]

    def learn(self, part: Part) -> None:
        """All of a part: its words, then its occurrences."""
        key = part.at * 16 + np.minimum(part.times(), 15)
        item, n = np.unique(key, return_counts=True)
        at = item >> 4
        self.words(part.data, part.starts[at], part.ends[at], part.topics[at], item & 15, n)
        self.pairs(part)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, topics: np.ndarray, own: np.ndarray, times: np.ndarray) -> None:
        """Words of a topic that occur ``times`` in texts that hold each ``own`` times: one step down the gradient for STEP_ROWS of them."""
        m, known, places = self.model, len(self.kind), _SETS * _DEPTHS
        for low in range(0, len(starts), STEP_ROWS):
            some = slice(low, low + STEP_ROWS)
            bits = Bits(data, starts[some], ends[some], topics[some], m.trees)
            many = np.diff(bits.first)
            n, count = np.repeat(times[some].astype(float), many), int(times[some] @ many) // 3 + 1
            left = np.repeat(own[some] << 17, many) | bits.bit << 16
            states = [LEFT.take(left | m.tables[q].take(bits.slots(o, m.bits[q]))) for q, o in enumerate(WITHIN)]
            chosen = _chosen(*states[3:], np.zeros(1)).astype(np.int64)
            at = chosen * _DEPTHS + bits.depth
            keys = [chosen * known + x for x in states]
            mixed = m.bias.take(at)
            for given, key in zip(self._given(), keys, strict=True):
                mixed += given.take(key)
            error = (_sigmoid(mixed) - bits.bit) * n
            for o, key in enumerate(keys):
                missed, uses = (np.bincount(key, x, _SETS * known).reshape(_SETS, known) for x in (error, n))
                self._move("weights", o, ((missed * m.stretched) @ self.kind).ravel(), (uses @ self.kind).ravel(), 0.03, count)
            self._move("bias", slice(None), np.bincount(at, error, places), np.bincount(at, n, places), 0.01, count)
            rest = np.arange(len(n)) >= np.repeat(bits.first[:-1] + bits.head, many)  # the map of first bytes follows from occurrences
            for sums, x in zip((self.mass, self.hits), _on_map(mixed[rest], at[rest], n[rest], (n * bits.bit)[rest]), strict=True):
                sums += x

    def pairs(self, part: Part) -> None:
        """Counts the first bytes of all occurrences in cells. What the word itself gives is worked out once for each beginning of a topic's words and how often a text holds the word."""
        m, given = self.model, self._given()
        words, both = (np.minimum(x, 15) for x in (part.times(), part.times(True)))
        which, head = part.heads()
        bits = part.bits(m.trees, HEAD, which)
        key = head.take(part.at) * 16 + words
        item = np.flatnonzero(np.bincount(key, minlength=16 * len(which)))
        number = np.zeros(16 * len(which), np.int64)
        number[item] = np.arange(len(item))
        first, place = _decisions(bits.first, item >> 4)
        bit, depth = bits.bit.take(place), bits.depth.take(place)
        left = np.repeat((item & 15) << 17, np.diff(first)) | bit << 16
        states = [LEFT.take(left | m.tables[q].take(bits.slots(o, m.bits[q])).take(place)) for q, o in enumerate(WITHIN)]
        chosen = _chosen(*states[3:], np.zeros(1)).astype(np.int64)
        mixed = m.bias.take(chosen * _DEPTHS + depth)
        for x, state in zip(given, states, strict=True):
            mixed += x.take(chosen * len(self.kind) + state)
        step = np.clip(np.round((mixed + 8) * _FOLD), 0, _FOLDS - 1).astype(np.int64)
        base = (((chosen >> 1) * _DEPTHS + depth) * _FOLDS + step) * 512 + bit
        bit <<= 16
        carried, low = bits.carried("before").take(place), bits.low(m.bits[-1]).take(place)
        for some, many, spot in part.walk(first, number.take(key)):
            before = m.tables[-1].take(part.slots("before", m.bits[-1], carried, low, some, many, spot))
            state = LEFT.take(np.repeat(both[some] << 17, many) | bit.take(spot) | before).astype(np.int64)
            np.add.at(self.cells, base.take(spot) + 2 * state, 1)

    def sums(self) -> np.ndarray:
        """What is added up over tasks."""
        return np.concatenate([x.ravel() for k, u in self.uses.items() for x in (getattr(self.model, k) * u, u)] + [self.mass, self.hits, self.cells])


def averaged(m: Model, sums: np.ndarray) -> tuple[Model, np.ndarray]:
    """(the fresh model m with each weight's mean by its uses, what is left of the added Learner.sums)."""
    at, out = 0, {}
    for k in ("weights", "bias"):
        own = getattr(m, k)
        total, uses = (sums[at + i * own.size : at + (i + 1) * own.size].reshape(own.shape) for i in (0, 1))
        out[k] = np.where(uses > 0, total / np.maximum(uses, 1), own)
        at += 2 * own.size
    return replace(m, **out), sums[at:]


def merged(m: Model, sums: np.ndarray) -> Model:
    """The fresh model m with added Learner.sums."""
    m, rest = averaged(m, sums)
    return with_before(m, *np.split(rest, [m.refined.size, 2 * m.refined.size]))


def with_before(m: Model, mass: np.ndarray, hits: np.ndarray, cells: np.ndarray) -> Model:
    """The model m with the weights of the word before from counted cells, and with the map from the mass and hits of words' rests and from the cells, with 40 occurrences of the plain curve.

    Where the word before speaks, the word itself gives as much as where it does not times one factor, and a weight for
    each level of the word before and a shift for each depth are added: a logistic regression by Newton's steps, held near
    the fresh weights as by a few occurrences.
    """
    weights, bias, wide = m.weights.copy(), m.bias.copy(), 2 * _LEVELS
    for k, own in enumerate(cells.reshape(_SETS // 2, _DEPTHS, _FOLDS, 256, 2)):
        depth, step, state = np.nonzero(own.any(axis=3))
        n, hit = own[depth, step, state].sum(axis=1).astype(float), own[depth, step, state, 1].astype(float)
        x, said = step / _FOLD - 8, state > 0
        design = np.concatenate((x[:, None], np.eye(wide)[m.levels[state]] * m.stretched[state][:, None], np.eye(_DEPTHS)[depth]), axis=1)
        now = begun = np.concatenate(([1.0], np.full(wide, 0.3), np.zeros(_DEPTHS)))
        for _ in range(12):
            p = _sigmoid(design[said] @ now)
            steep = (design[said] * (n[said] * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ design[said]
            down = design[said].T @ (hit[said] - n[said] * p) - 4 * (now - begun)
            now = now + np.clip(np.linalg.solve(steep + 4 * np.eye(len(now)), down), -1, 1)
        even, odd = slice(2 * k * wide, (2 * k + 1) * wide), slice((2 * k + 1) * wide, (2 * k + 2) * wide)
        weights[:-1, odd], weights[-1, odd] = now[0] * weights[:-1, even], now[1 : wide + 1]
        bias[(2 * k + 1) * _DEPTHS : (2 * k + 2) * _DEPTHS] = now[0] * bias[2 * k * _DEPTHS : (2 * k + 1) * _DEPTHS] + now[wide + 1 :]
        more = _on_map(np.where(said, design @ now, x), (2 * k + said) * _DEPTHS + depth, n, hit)
        mass, hits = mass + more[0], hits + more[1]
    return replace(m, weights=weights, bias=bias, refined=((hits.reshape(m.refined.shape) + 40 * m.refined) / (mass.reshape(m.refined.shape) + 40)))


def for_scoring(m: Model) -> Model:
    """The model with states in its tables, which are half as large."""
    return Model(m.topics, m.trees, m.bits, [STATE[x] for x in m.tables], m.weights, m.bias, m.refined, m.stretched, m.levels)


def _binary(part: Part, which: np.ndarray) -> pa.Array:
    """Distinct words of a part as one binary array."""
    size = (part.ends - part.starts)[which]
    offset = np.concatenate(([0], np.cumsum(size)))
    put = np.arange(offset[-1])
    data = part.data[np.repeat(part.starts[which] - offset[:-1], size) + put] if len(put) else np.zeros(0, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def learnt_topics(docs: DataFrame) -> Topics:
    """Kinds of texts, fitted in TOPIC_ROUNDS rounds over all texts. They begin as a mixture of at most TOPIC_TEXTS distinct texts, those of the least hashes, whose words the driver gets as numbers."""
    found = docs.where("text is not null").select("text", F.xxhash64("text").alias("hash"))
    share = max(1, docs.count() // (4 * TOPIC_TEXTS))
    some = found.where(F.pmod("hash", F.lit(share)) == 0).dropDuplicates(["hash"]).orderBy("hash").limit(TOPIC_TEXTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = Words(batch.column("text"))
            key = words.row * TOPIC_FEATURES + (words.hashes() % np.uint64(TOPIC_FEATURES)).astype(np.int64)
            key, n = np.unique(key, return_counts=True)
            ends = np.searchsorted(key, np.arange(batch.num_rows + 1) * TOPIC_FEATURES)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(x.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), lists(key % TOPIC_FEATURES), lists(n)], ["hash", "features", "counts"])

    rows = some.mapInArrow(run, "hash long, features array<int>, counts array<int>").toArrow().sort_by("hash")
    topics = mixture([np.array(x.values, np.int64) for x in rows.column("features")], [np.array(x.values) for x in rows.column("counts")], TOPICS)
    for _ in range(TOPIC_ROUNDS):
        topics = refitted(docs, topics)
    return topics


def refitted(docs: DataFrame, topics: Topics) -> Topics:
    """Kinds of texts from all texts, each of the kind that topics give it. Whole numbers are added up, so the split doesn't matter; the driver gets TOPICS * TOPIC_FEATURES of them."""
    sent, kinds = docs.sparkSession.sparkContext.broadcast(topics), topics.logs.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((TOPIC_FEATURES + 1) * kinds, np.int64)
        for piece in (x for batch in batches for x in pieces(batch, "text", PART_BYTES)):
            words = Words(piece.column("text"))
            feature = (words.hashes() % np.uint64(TOPIC_FEATURES)).astype(np.int64)
            kind = sent.value.of_texts(feature, words.first)
            sums += np.bincount(feature * kinds + kind[words.row], minlength=len(sums))
            sums[-kinds:] += np.bincount(kind[np.diff(words.first) > 0], minlength=kinds)
        rows = [sums[i : i + BLOCK].tobytes() for i in range(0, len(sums), BLOCK)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int64()), pa.array(rows, pa.binary())], ["block", "sums"])
        freed()

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in table.column("sums"))
        return pa.table({"block": table.column("block").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = docs.where("text is not null").mapInArrow(run, "block long, sums binary").groupBy("block").applyInArrow(add, "block long, sums binary").orderBy("block").collect()
    sums = np.frombuffer(b"".join(r.sums for r in rows), np.int64).reshape(-1, kinds) if rows else np.zeros((TOPIC_FEATURES + 1, kinds), np.int64)
    sent.destroy()
    return kinds_of(sums[:-1], sums[-1])


def word_counts(docs: DataFrame, topics: Topics) -> DataFrame:
    """(token, hash, topic, times, trained, all): how often each word occurs in a topic in the rows to learn from and in all rows of (text, learn), apart by how often a text holds it in the topic (15 is 15 or more); the end of a text is an empty token. Each piece is counted before the shuffle."""
    sent = docs.sparkSession.sparkContext.broadcast(topics)  # TOPICS * TOPIC_FEATURES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in (x for batch in batches for x in pieces(batch, "text", PART_BYTES)):
            part = Part(piece.column("text"), sent.value, across=False)
            learn = piece.column("learn").to_numpy(zero_copy_only=False).astype(bool)
            key = part.at * 16 + np.minimum(part.times(), 15)
            every = np.bincount(key)
            trained = np.bincount(key[learn[part.row]], minlength=len(every))
            item = np.flatnonzero(every)
            some = item >> 4
            yield pa.RecordBatch.from_arrays([_binary(part, some), pa.array(part.sent.view(np.int64)[some]), pa.array(part.topics[some].astype(np.int32)), pa.array((item & 15).astype(np.int32)), pa.array(trained[item]), pa.array(every[item])], ["token", "hash", "topic", "times", "trained", "all"])
        freed()

    part = docs.mapInArrow(run, "token binary, hash long, topic int, times int, trained long, all long")
    return part.groupBy("token", "hash", "topic", "times").agg(F.sum("trained").alias("trained"), F.sum("all").alias("all"))


def _bytes_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, ends) of a column of words."""
    ends = np.cumsum(np.asarray(pc.binary_length(col).to_numpy(zero_copy_only=False), np.int64))
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8), np.concatenate(([0], ends[:-1])) if len(col) else ends, ends


def word_trees(counts: DataFrame) -> Trees:
    """Trees from how often each byte follows two others in the words to learn from. At most TREES * 256 counts of pairs and 65,536 of single bytes reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, _, size, at, window = _laid_out(*_bytes_of(batch.column("token")))
            key, of = np.unique(_pairs_before(window) * 256 + d[at], return_inverse=True)
            n = np.zeros(len(key), np.int64)
            np.add.at(n, of, np.repeat(batch.column("trained").to_numpy(), size))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    found = stored(counts.where("trained > 0").select("token", "trained").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    by = found.select(F.shiftright("key", 8).alias("two"), (F.col("key") % 256).alias("byte"), "n")
    top = by.groupBy("two").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), "two").limit(TREES)
    singles, pairs = np.zeros((256, 256), np.int64), {}
    for r in by.groupBy(F.shiftright("two", 8).alias("one"), "byte").agg(F.sum("n").alias("n")).collect():
        singles[r.one, r.byte] = r.n
    for r in by.join(F.broadcast(top), "two").orderBy(F.desc("all"), "two").collect():
        pairs.setdefault(r.two, np.zeros(256, np.int64))[r.byte] = r.n
    discard(found)
    return trees(pairs, singles)


class _Counts:
    """Counts of bits in some tables, handed out as blocks. A block that holds a count of FULL or more is handed out at once and begins anew, so no count is cut."""

    def __init__(self, sizes: list[int], kind: type, base: int):
        self.flat, self.width = [np.zeros(2 << b, kind) for b in sizes], np.dtype(kind).itemsize
        #: All that was added to each table; no count is greater.
        self.added = [0] * len(sizes)
        self.base = base + np.concatenate(([0], np.cumsum([(2 << b) // BLOCK for b in sizes])))

    def add(self, table: int, at: np.ndarray, n) -> Iterator[pa.RecordBatch]:
        flat = self.flat[table]
        np.add.at(flat, at, flat.dtype.type(n) if np.isscalar(n) else n.astype(flat.dtype))
        self.added[table] += n * len(at) if np.isscalar(n) else int(n.sum())
        if self.added[table] >= FULL[self.width] and len(at) and (held := flat.take(at)).max() >= FULL[self.width]:
            yield from self._out(table, np.unique(at[held >= FULL[self.width]] // BLOCK))

    def _out(self, table: int, which: np.ndarray) -> Iterator[pa.RecordBatch]:
        blocks = self.flat[table].reshape(-1, BLOCK)
        for i in range(0, len(which), 256):
            some = which[i : i + 256]
            own = [blocks[k].astype(np.uint8) if self.width > 1 and blocks[k].max() < 256 else blocks[k] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(self.base[table] + some, pa.int64()), pa.array([x.itemsize for x in own], pa.int32()), pa.array([pa.compress(x.tobytes(), "zstd", asbytes=True) for x in own], pa.binary())], ["block", "width", "sums"])
        blocks[which] = 0

    def rest(self) -> Iterator[pa.RecordBatch]:
        for table, flat in enumerate(self.flat):
            yield from self._out(table, np.flatnonzero(flat.reshape(-1, BLOCK).any(axis=1)))


def shares(weights: np.ndarray, room: int) -> Iterator[np.ndarray]:
    """Weights in parts that add up to them, each with a sum of at most ``room``."""
    left = weights.astype(np.int64)
    while (live := np.count_nonzero(left)) > 0:
        now = np.minimum(left, max(1, room // live))
        yield now
        left = left - now


def tables(counts: DataFrame, docs: DataFrame, parts: int, topics: Topics, own: Trees, bits: list[int]) -> list[np.ndarray]:
    """The predictors' tables, 256 * coded zeros + coded ones of each slot, from all words (token, topic, trained) and texts to learn from.

    Each task counts the bits of its rows in tables of its own and hands out the blocks that it touched; words come in
    order, as those that begin alike share slots, which then are in the cache. Blocks are summed as 64-bit numbers, one after another in the order of their numbers. The driver gets the tables, one at a time.
    """
    n = len(WITHIN)
    half = sum((2 << b) // BLOCK for b in bits[:n])
    kinds = "block long, width int, sums binary"

    def of_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(bits[:n], np.uint32, 0)
        for batch in batches:
            part = Bits(*_bytes_of(batch.column("token")), batch.column("topic").to_numpy(), own)
            for now in shares(batch.column("trained").to_numpy(), FULL[4] // 64):
                weight = np.repeat(now, np.diff(part.first))
                for q, o in enumerate(WITHIN):
                    yield from held.add(q, 2 * part.slots(o, bits[q]) + part.bit, weight)
        yield from held.rest()
        del held
        freed()

    def counted(col: pa.Array, held: _Counts) -> Iterator[pa.RecordBatch]:
        part = Part(col, topics)
        which, head = part.heads()
        made = part.bits(own, HEAD, which)
        carried, low = {o: made.carried(o) for o in ACROSS}, [made.low(b) for b in bits[n:]]
        for some, many, place in part.walk(made.first, head.take(part.at)):
            bit = made.bit.take(place)
            for q, o in enumerate(ACROSS):
                slot = part.slots(o, bits[n + q], carried[o], low[q], some, many, place)
                slot <<= 1
                slot |= bit
                yield from held.add(q, slot, 1)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Counts(bits[n:], np.uint16, half)
        for piece in (x for batch in batches for x in pieces(batch, "text", PART_BYTES)):
            yield from counted(piece.column("text"), held)
        yield from held.rest()
        del held
        freed()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, np.zeros(BLOCK, np.int64)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([coded(total).tobytes()], pa.binary())], ["block", "pairs"])
        for batch in batches:
            for block, width, sums in zip(batch.column("block").to_pylist(), batch.column("width").to_pylist(), batch.column("sums"), strict=True):
                if block != now:
                    if now is not None:
                        yield done()
                    now, total = block, np.zeros(BLOCK, np.int64)
                total += np.frombuffer(pa.decompress(sums.as_buffer(), BLOCK * width, "zstd"), {1: np.uint8, 2: np.uint16, 4: np.uint32}[width])
        if now is not None:
            yield done()

    each = counts.where("trained > 0").select("token", "topic", "trained").coalesce(parts).sortWithinPartitions("token", "topic").mapInArrow(of_words, kinds).unionByName(docs.coalesce(parts).mapInArrow(of_texts, kinds))
    summed = stored(each.repartition("block").sortWithinPartitions("block").mapInArrow(add, "block long, pairs binary"))
    out, first = [], 0
    for b in bits:
        blocks = (2 << b) // BLOCK
        pairs = np.zeros((blocks, BLOCK // 2), np.uint16)
        found = summed.where((F.col("block") >= first) & (F.col("block") < first + blocks)).toArrow()
        for chunk in found.to_batches():
            pairs[chunk.column("block").to_numpy() - first] = np.frombuffer(b"".join(chunk.column("pairs").to_pylist()), ">u2").reshape(-1, BLOCK // 2)
        out.append(pairs.ravel())
        first += blocks
    discard(summed)
    return out


def fitted(docs: DataFrame, learners: int, model: Model, words: DataFrame | None = None) -> Model:
    """The fresh model with weights and map learned over all texts; ``words`` are their word_counts.

    Words are dealt to so many learners by hash, frequent ones as several rows; a learner reads its rows in the order of
    their hashes, begins with the fresh weights, and results are merged by use. Then all occurrences are counted in cells.
    The driver gets a few tens of KB of each of SUM_GROUPS groups of learners, and the cells.
    """
    sc = docs.sparkSession.sparkContext
    shipped = sc.broadcast(model)
    words = word_counts(docs.select("text", F.lit(True).alias("learn")), model.topics) if words is None else words
    learned = len(Learner(model).sums()) - len(Learner(model).cells)

    def of_words(table: pa.Table) -> pa.Table:
        rows = table.sort_by([("hash", "ascending"), ("token", "ascending"), ("topic", "ascending"), ("times", "ascending"), ("n", "ascending")])
        learner = Learner(replace(shipped.value, weights=shipped.value.weights.copy(), bias=shipped.value.bias.copy()))
        for batch in rows.combine_chunks().to_batches(max_chunksize=1 << 13):
            learner.words(*_bytes_of(batch.column("token")), *(batch.column(c).to_numpy() for c in ("topic", "times", "n")))
        freed()
        return pa.table({"learner": table.column("learner").slice(0, 1), "sums": pa.array([learner.sums()[:learned].tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer()) for x in table.sort_by("learner").column("sums"))
        return pa.table({"part": table.column("part").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    rows = F.ceil(F.col("trained") / ROW_TIMES)
    each = words.where("trained > 0").select("token", "topic", F.col("times").cast("long").alias("times"), "trained", rows.alias("rows"), F.explode(F.sequence(F.lit(0).cast("long"), rows - 1)).alias("i"))
    n = F.floor(F.col("trained") / F.col("rows")) + (F.col("i") < F.col("trained") % F.col("rows")).cast("long")
    key = F.xxhash64("token", "topic", "times", "i")
    dealt = each.select("token", "topic", "times", n.alias("n"), key.alias("hash"), F.pmod(F.shiftright(key, 20), F.lit(learners)).alias("learner"))
    sums = dealt.groupBy("learner").applyInArrow(of_words, "learner long, sums binary").withColumn("part", F.col("learner") % SUM_GROUPS)
    total = np.zeros(learned)
    for row in sums.groupBy("part").applyInArrow(add, "part long, sums binary").orderBy("part").collect():
        total += np.frombuffer(row.sums)
    shipped.destroy()
    model, rest = averaged(model, total)
    sent = sc.broadcast(model)

    def of_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learner = Learner(sent.value)
        for piece in (x for batch in batches for x in pieces(batch, "text", PART_BYTES)):
            learner.pairs(Part(piece.column("text"), sent.value.topics))
        some = np.flatnonzero(learner.cells)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(learner.cells[some])], ["cell", "n"])
        del learner
        freed()

    cells = np.zeros(len(Learner(model).cells), np.int64)
    counted = docs.where("text is not null").select("text").mapInArrow(of_texts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    cells[counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    sent.destroy()
    return with_before(model, *np.split(rest, 2), cells)


def _least(counts: DataFrame, most: int) -> int:
    """The least count of which at most so many rows have it or more."""
    held = 0
    for r in counts.groupBy("all").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("all")).toLocalIterator():  # as many rows as different counts
        held += r.n
        if held > most:
            return r["all"] + 1
    return 0


def held_rests(by_topic: DataFrame, shipped) -> tuple[np.ndarray, np.ndarray]:
    """(keys in order, log10 probability of the rest) of at most RESTS words of a topic, those that most texts hold once, by a broadcast model for scoring."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shipped.value)
        for batch in batches:
            topic = batch.column("topic").to_numpy()
            key = batch.column("hash").to_numpy().view(np.uint64) + topic.astype(np.uint64) * _TOPIC
            for i in range(0, len(key), CHUNK):
                data, starts, ends = _bytes_of(batch.column("token").slice(i, CHUNK))
                yield pa.RecordBatch.from_arrays([pa.array(key[i : i + CHUNK].view(np.int64)), pa.array(scorer.rests(data, starts, ends, topic[i : i + CHUNK]))], ["key", "rest"])
        del scorer
        freed()

    once = by_topic.where((F.col("times") == 1) & (F.octet_length("token") >= HEAD))
    rows = once.where(F.col("all") >= _least(once, RESTS)).select("token", "hash", "topic").mapInArrow(run, "key long, rest double").toArrow()
    key = rows.column("key").to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], rows.column("rest").to_numpy()[order]


def scored(docs: DataFrame, *, learn: str = "learn", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, learn, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of each row.

    ``learn`` is an SQL condition on docs that says which rows to learn from. base_score is the add-one unigram score,
    score the mixing model's, both log10 of the whole text's probability; a text's end is a token of its own.

    Counts cover all rows to learn from, and scores are the same however the table is split. Base scores of at most FREQUENT words, the most frequent ones, go to every task;
    occurrences of other words are joined by the word's 64-bit hash, where no word is frequent enough to be a hot key.

    A null or empty text has the end as its only token. Repeated rows are rows of their own. An empty table gives none.
    Only the named columns are read.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.expr(learn), F.lit(False)).alias("learn"))
    learnt = named.where("learn").select("text")
    topics = learnt_topics(learnt)
    by_topic = stored(word_counts(named.select("text", "learn"), topics))
    counts = stored(by_topic.groupBy("token", "hash").agg(F.sum("trained").alias("trained"), F.sum("all").alias("all")))
    total = counts.agg(F.sum("trained").alias("n"), F.count(F.when(F.col("trained") > 0, 1)).alias("v")).first()
    n, v = int(total.n or 0), int(total.v or 0)
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(n / TASK_WORDS))
    bits, own = table_bits(v), word_trees(counts)
    model = fresh(topics, own, bits, tables(by_topic, learnt, parts, topics, own, bits))
    rows = int(by_topic.agg(F.sum(F.ceil(F.col("trained") / ROW_TIMES))).first()[0] or 0)
    model = fitted(learnt, math.ceil(max(1, rows) / LEARNER_ROWS), model, by_topic)
    shipped = spark.sparkContext.broadcast(for_scoring(model))  # the tables of table_bits
    del model
    rests = spark.sparkContext.broadcast(held_rests(by_topic, shipped))
    discard(by_topic)
    top = counts.where(F.col("all") >= _least(counts, FREQUENT)).select("hash", "trained").toArrow().sort_by("hash")
    frequent = spark.sparkContext.broadcast((top.column("hash").to_numpy(), top.column("trained").to_numpy()))
    kind = named.schema["id"].dataType.simpleString()
    norm = math.log10(n + v + 1)

    def looked_up(piece: pa.RecordBatch, scorer: Scorer, row: int) -> pa.RecordBatch:
        names, trained = frequent.value
        rows = piece.num_rows
        part = Part(piece.column("text"), scorer.model.topics)
        score = scorer.scores(part, rows)
        at = np.searchsorted(names, part.sent.view(np.int64))
        at = np.where(np.append(names, 0)[at] == part.sent.view(np.int64), at, -1) if len(names) else at - 1
        count = np.append(trained, 0)[at]
        base, known = np.where(at < 0, 0.0, np.log10(count + 1.0) - norm), (count > 0).astype(np.float64)
        per = lambda x: np.bincount(part.row, x[part.at], rows)
        rare = np.flatnonzero(at[part.at] < 0)
        key, times = np.unique(part.row[rare] * len(at) + part.at[rare], return_counts=True)
        m = len(key)
        whole = lambda x: pa.concat_arrays([pa.array(x.astype(np.int64)), pa.nulls(m, pa.int64())])
        summed = lambda x, kind: pa.array(np.concatenate((x, np.zeros(m))).astype(kind))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate((np.arange(row, row + rows), row + key // len(at)))), pa.concat_arrays([piece.column("id"), pa.nulls(m, piece.schema.field("id").type)]), pa.concat_arrays([piece.column("learn"), pa.nulls(m, pa.bool_())]),
             whole(np.bincount(part.row, minlength=rows)), summed(per(known), np.int64), summed(per(base), np.float64), summed(score, np.float64), whole(per(part.ends - part.starts + 1)),
             pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(part.sent.view(np.int64)[key % len(at)])]), pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(times.astype(np.int64))])],
            ["row", "id", "learn", "n_tokens", "n_known", "base", "score", "n_bytes", "hash", "times"],
        )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        scorer = Scorer(shipped.value, rests.value)
        row = TaskContext.get().partitionId() << 36
        for piece in (x for batch in batches for x in pieces(batch, "text", PART_BYTES)):
            yield looked_up(piece, scorer, row)
            row += piece.num_rows
        del scorer
        freed()

    looked = stored(named.mapInArrow(look, f"row long, id {kind}, learn boolean, n_tokens long, n_known long, base double, score double, n_bytes long, hash long, times long"))
    shipped.destroy()
    rests.destroy()
    rare = looked.where("hash is not null").select("row", "hash", "times").join(counts.select("hash", "trained"), "hash")
    base = F.log10(F.col("trained") + F.lit(1.0)) - F.lit(norm)
    more = rare.groupBy("row").agg(F.sum(F.when(F.col("trained") > 0, F.col("times")).otherwise(0)).alias("more_known"), F.sum(F.col("times") * base).alias("more_base"))
    out = looked.where("hash is null").join(more, "row", "left")
    return out.select(
        "id", "learn", "n_tokens", (F.col("n_known") + F.coalesce("more_known", F.lit(0))).cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"), "score", "n_bytes", (-F.col("score") / F.lit(math.log10(2)) / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op9_mixlm(spark, sf_dir: str) -> DataFrame:
    short_batches(spark, 1500)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("learn", crc_mod(F.col("doc_id"), 7) != 2)
    return scored(docs).select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte")
