"""Personal data in texts: rules, and a semi-Markov conditional random field that adds spans which the rules miss.

The rules give the base spans. The field scores whole candidate spans (their digit groups, separators, check digits,
borders and the word before) and the step from one span to the next (both kinds, and whether the gap is short), and
dynamic programming over the tokens of a region, with segments of at most MOST_TOKENS tokens, chooses boundaries and
types together. It learns from the rules' own spans in a bounded sample, some of them
rewritten the way people hide them (without the plus, with other separators, with "at" and "dot" spelled out).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.llm.common import discard, stored
from cuegrid.llm.textnum import pieces

#: The kinds in the order of reports, and the rules' patterns.
KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")  # no match can begin inside a run of digits: a whole run fits or fails
_CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: The field is fitted on at most so many regions, those of least hash.
FIT_REGIONS = 2000
#: Bounds of a segment, and of a region's context around what makes it hot.
MOST_TOKENS, MOST_DIGITS, REACH = 24, 19, 64
#: Tokens outside between two segments whose gap is short; the weight of a step depends on it.
NEAR = 4
#: Regions that one Python worker remembers at most, none longer than MEMO_CHARS.
REMEMBERED, MEMO_CHARS = 50_000, 400
_HOT = re.compile(r"[0-9@]+|[\[({] ?(?:at|dot) ?[\])}]|\bdot\b", re.IGNORECASE)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|[^\w\s]|_|\d")
_CUES = {"at", "dot"}
_BRACKETS = frozenset("[](){}")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    base: bool


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number fits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join([c for c in text if "0" <= c <= "9"])


def base_spans(text: str) -> list[Span]:
    """The rules' spans by start, then kind. Each kind is matched leftmost without overlaps; matches that fail a test are dropped. Linear in the text."""
    out = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        end = at + 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = last = m.end()
            out.append(Span("email", start, end, True))
        at = text.find("@", end)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append(Span("ip", m.start(), m.end(), True))
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append(Span("card", m.start(), m.end(), True))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                out.append(Span("phone", m.start(), m.end(), True))
    return sorted(out, key=lambda s: (s.start, KINDS.index(s.kind)))


def regions(text: str) -> list[tuple[int, int]]:
    """(start, end) of the parts of a text that can hold a candidate: digits, @, or a spelled-out at or dot, with their context.

    Elsewhere the best segmentation has no entity, so the parts can be solved each by itself.
    """
    out: list[list[int]] = []
    for m in _HOT.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        left, right = text[a : m.start()], text[m.end() : b]
        own = left.rsplit(None, 3)
        a += len(own[0]) if len(own) > 3 else 0
        cut = right.split(None, 3)
        b = m.end() + (len(right) - len(cut[-1]) if len(cut) > 3 else len(right))
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Candidate(NamedTuple):
    kind: int
    first: int  # token
    last: int  # token, inclusive
    features: tuple[str, ...]


def _kind_of(c: str) -> str:
    if not c:
        return "edge"
    if "0" <= c <= "9":
        return "digit"
    return "letter" if c.isalpha() else "space" if c.isspace() else c


def candidates(region: str) -> tuple[list[tuple[int, int]], list[Candidate]]:
    """(tokens, candidates) of a region: spans of at most MOST_TOKENS tokens that pass their kind's cheap gate."""
    tokens = [(m.start(), m.end()) for m in _TOKEN.finditer(region)]
    words = [region[a:b] for a, b in tokens]
    number = ["0" <= w[0] <= "9" for w in words]
    letter = [w[0].isalpha() for w in words]
    out: list[Candidate] = []
    for i, w in enumerate(words):
        if number[i] or w in "+(":
            _numbers(region, tokens, words, number, letter, i, out)
        if number[i] or letter[i]:
            _addresses(region, tokens, words, number, letter, i, out)
    return tokens, out


def _borders(region: str, start: int, end: int, words: list[str], i: int) -> list[str]:
    before = words[i - 1].lower() if i and words[i - 1][0].isalpha() else _kind_of(words[i - 1][0]) if i else "edge"
    return [f"left={_kind_of(region[start - 1 : start])}", f"right={_kind_of(region[end : end + 1])}", f"before={before}"]


def _numbers(region: str, tokens: list, words: list[str], number: list[bool], letter: list[bool], i: int, out: list[Candidate]) -> None:
    """Candidates of digits and separators that begin at token i."""
    groups: list[str] = []
    marks: set[str] = set()
    total = 0
    start = tokens[i][0]
    for j in range(i, min(len(words), i + MOST_TOKENS)):
        gap = region[tokens[j - 1][1] : tokens[j][0]] if j > i else ""
        if letter[j] and words[j].lower() != "dot" or len(gap) > 2 or "\n" in gap:
            return
        if gap:
            marks.add("space" if gap == " " else "gap")
        if not number[j]:
            if words[j] not in "+()-./[]{}:" and words[j].lower() != "dot":
                return
            marks.add(words[j].lower())
            continue
        groups.append(words[j])
        total += len(words[j])
        if total > MOST_DIGITS:
            return
        if total < 4:
            continue
        end = tokens[j][1]
        digits = "".join(groups)
        shape = "-".join(str(len(g)) for g in groups)
        common = [f"shape={shape}", f"digits={total}", f"groups={min(len(groups), 8)}", f"opens={words[i] if words[i] in '+(' else 'digit'}", "marks=" + " ".join(sorted(marks)), *[f"mark={m}" for m in marks], *_borders(region, start, end, words, i)]
        if len(groups) == 4 and total <= 12:
            small = all(int(g) <= 255 for g in groups)
            out.append(Candidate(1, i, j, ("bias", f"octets={small}", f"octets={small}&" + " ".join(sorted(marks)), *common)))
        if total >= 12:
            out.append(Candidate(2, i, j, ("bias", f"luhn={luhn(digits)}", f"luhn={luhn(digits)}&left={_kind_of(region[start - 1 : start])}&right={_kind_of(region[end : end + 1])}", *common)))
        if 7 <= total <= 15:
            out.append(Candidate(3, i, j, ("bias", f"plus={'+' in marks}", f"plus={'+' in marks}&digits={total}", f"tail={shape[-3:]}", f"zeros={digits.startswith('00')}", *common)))


def _addresses(region: str, tokens: list, words: list[str], number: list[bool], letter: list[bool], i: int, out: list[Candidate]) -> None:
    """Candidates with an at sign, or a word for it, and a dot, or a word for it, that begin at token i."""
    at = dots = 0
    marks: set[str] = set()
    start = tokens[i][0]
    for j in range(i, min(len(words), i + MOST_TOKENS)):
        w = words[j].lower()
        if j > i and (gap := region[tokens[j - 1][1] : tokens[j][0]]):
            near = {words[j - 1].lower(), w} & (_CUES | {"@"}) or (words[j - 1] in _BRACKETS or w in _BRACKETS) and j + 1 < len(words) and {words[j - 2].lower(), words[j + 1].lower()} & _CUES
            if not near or len(gap) > 1 or gap == "\n":
                return
            marks.add("space")
        if w == "@" or w == "at" and j > i:
            at += 1
            marks.add(w if w == "@" or words[j - 1] not in _BRACKETS else "[at]")
        elif at and (w == "." or w == "dot"):
            if words[j - 1].lower() in ("at", "@", "dot"):
                return
            dots += 1
            marks.add(w if w == "." or words[j - 1] not in _BRACKETS else "[dot]")
        elif not (number[j] or letter[j] or w in "._%+-" or w in _BRACKETS):
            return
        if at > 1:
            return
        if at and dots and letter[j] and w not in _CUES and len(w) >= 2:
            end = tokens[j][1]
            out.append(Candidate(0, i, j, ("bias", f"suffix={len(w)}", f"dots={min(dots, 4)}", f"local={min(j - i, 12)}", "marks=" + " ".join(sorted(marks)), *[f"mark={m}" for m in marks], f"sure={'@' in marks or '[at]' in marks}", f"spelled={'dot' in marks}", *_borders(region, start, end, words, i), f"next={words[j + 1].lower() if j + 1 < len(words) and words[j + 1].lower() in ('.', 'dot', '-', '[', '(') else 'else'}")))


@dataclass
class Model:
    """Weights of (kind, feature), and of (kind before, kind, whether the gap between them is short)."""

    weights: dict[str, float] = field(default_factory=dict)

    def score(self, c: Candidate) -> float:
        k, get = c.kind, self.weights.get
        return sum([get(f"{k}:{f}", 0.0) for f in c.features])

    def steps(self) -> list[list[tuple[float, float]]]:
        """steps[p][k]: the weights of kind k after kind p (len(KINDS): the region's first), by a short and by a long gap."""
        return [[tuple(self.weights.get(_step(p, k, far), 0.0) for far in (0, 1)) for k in range(len(KINDS))] for p in range(len(KINDS) + 1)]


def _step(before: int, kind: int, far: int) -> str:
    return f"{before}>{kind}:{far}"


def _ends_and_begins(cands: list[Candidate], use: list[int]) -> tuple[dict[int, list[int]], dict[int, list[int]]]:
    ends: dict[int, list[int]] = {}
    begins: dict[int, list[int]] = {}
    for x in use:
        ends.setdefault(cands[x].last + 1, []).append(x)
        begins.setdefault(cands[x].first, []).append(x)
    return ends, begins


def _best(n: int, cands: list[Candidate], scores: list[float], steps: list[list[tuple[float, float]]]) -> list[Candidate]:
    """The segmentation of greatest score: each token is outside (0) or in one chosen candidate, and each chosen candidate adds its step from the one before.

    A candidate whose score cannot make up for the worst change of steps around it is in no best segmentation and is left out.
    """
    flat = [w for row in steps for pair in row for w in pair]
    slack = 2 * max(0.0, max(flat)) - min(0.0, min(flat))
    use = [x for x in range(len(cands)) if scores[x] + slack > 0]
    if not use:
        return []
    ends, begins = _ends_and_begins(cands, use)
    top: dict[int, float] = {}
    back: dict[int, int] = {}
    far: dict[int, int] = {}  # of each kind the best candidate that ends a long gap ago
    for t in range(n):
        for y in ends.get(t - NEAR - 1, ()):
            k = cands[y].kind
            if k not in far or top[y] > top[far[k]]:
                far[k] = y
        for x in begins.get(t, ()):
            k = cands[x].kind
            ways = [(steps[-1][k][0], -1), *[(top[y] + steps[p][k][1], y) for p, y in far.items()]]
            ways += [(top[y] + steps[cands[y].kind][k][0], y) for e in range(t - NEAR, t + 1) for y in ends.get(e, ())]
            gain, back[x] = max(ways)
            top[x] = gain + scores[x]
    value, x = max((v, x) for x, v in top.items())
    if value <= 0:
        return []
    out = []
    while x >= 0:
        out.append(cands[x])
        x = back[x]
    return out[::-1]


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -1e300 else a


def _posterior(n: int, cands: list[Candidate], scores: list[float], steps: list[list[tuple[float, float]]]) -> tuple[list[float], dict[tuple[int, int, int], float]]:
    """The probability of each candidate, and the expected number of each step (before, kind, far), by the semi-Markov forward-backward sums."""
    kinds, none = range(len(KINDS)), -math.inf
    ends, begins = _ends_and_begins(cands, list(range(len(cands))))
    go, rest = [none] * len(cands), [0.0] * len(cands)
    sums = [[none] * len(kinds)] * len(cands)
    far = [none] * len(kinds)
    for t in range(n):
        for y in ends.get(t - NEAR - 1, ()):
            far[cands[y].kind] = _add(far[cands[y].kind], go[y])
        for x in begins.get(t, ()):
            k, sums[x] = cands[x].kind, list(far)
            s = steps[-1][k][0]
            for p in kinds:
                s = _add(s, far[p] + steps[p][k][1])
            for e in range(t - NEAR, t + 1):
                for y in ends.get(e, ()):
                    s = _add(s, go[y] + steps[cands[y].kind][k][0])
            go[x] = s + scores[x]
    later = [none] * len(kinds)
    for t in range(n, 0, -1):
        for z in begins.get(t + NEAR + 1, ()):
            later[cands[z].kind] = _add(later[cands[z].kind], scores[z] + rest[z])
        for x in ends.get(t, ()):
            k, s = cands[x].kind, 0.0
            for q in kinds:
                s = _add(s, later[q] + steps[k][q][1])
            for b in range(t, t + NEAR + 1):
                for z in begins.get(b, ()):
                    s = _add(s, scores[z] + rest[z] + steps[k][cands[z].kind][0])
            rest[x] = s
    total = 0.0
    for s in go:
        total = _add(total, s)
    expected: dict[tuple[int, int, int], float] = {}

    def meet(key: tuple[int, int, int], log: float) -> None:
        expected[key] = expected.get(key, 0.0) + math.exp(min(0.0, log - total))

    for x, c in enumerate(cands):
        after, k = scores[x] + rest[x], c.kind
        meet((len(KINDS), k, 0), steps[-1][k][0] + after)
        for p in kinds:
            if sums[x][p] > none:
                meet((p, k, 1), sums[x][p] + steps[p][k][1] + after)
        for e in range(c.first - NEAR, c.first + 1):
            for y in ends.get(e, ()):
                meet((cands[y].kind, k, 0), go[y] + steps[cands[y].kind][k][0] + after)
    return [math.exp(min(0.0, go[x] + rest[x] - total)) for x in range(len(cands))], expected


def _taken(cands: list[Candidate], hit: list[bool]) -> dict[tuple[int, int, int], float]:
    """How often each step is taken by the candidates that are hit."""
    out: dict[tuple[int, int, int], float] = {}
    last = None
    for c in sorted((c for c, y in zip(cands, hit, strict=True) if y), key=lambda c: c.first):
        key = (len(KINDS), c.kind, 0) if last is None else (last.kind, c.kind, int(c.first - last.last - 1 > NEAR))
        out[key] = out.get(key, 0.0) + 1
        last = c
    return out


def _rewritten(kind: str, text: str, rng: random.Random) -> str:
    """The same data as people write it to evade rules."""
    if kind == "email":
        at, dot = rng.choice(((" at ", " dot "), ("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), (" [at] ", "."), (" @ ", ".")))
        local, _, domain = text.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == "ip":
        return text.replace(".", rng.choice(("[.]", "(.)", " . ", " dot ")))
    digits = _digits(text)
    if kind == "card":
        mark = rng.choice((".", "/", "  ", " - "))
        return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    own, area, mid, end = digits[:-10], digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice((f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}", f"00{own} {area} {mid} {end}", f"{own}-{area}-{mid}-{end}", f"{area} {mid} {end}")) if len(digits) >= 10 else text


def _spoiled(kind: str, text: str, rng: random.Random) -> str:
    """What looks like the kind and is none: a part too great, a wrong check digit, too few digits, no domain."""
    if kind == "email":
        return text.partition("@")[0] + rng.choice(("@", " @ ", " at ")) + text.partition("@")[2].partition(".")[0]
    if kind == "ip":
        parts = text.split(".")
        parts[rng.randrange(4)] = str(rng.randint(256, 999))
        return ".".join(parts[: rng.choice((3, 4, 4))])
    if kind == "card":
        at = max(i for i, c in enumerate(text) if c != " " and c != "-")
        return text[:at] + str((int(text[at]) + rng.randint(1, 9)) % 10)
    return text.replace("+", "")[: rng.randint(3, 8)].rstrip(" ()-.")


def examples(rows: list[str], seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Regions with their spans: each as it is, and each that holds base spans once more with these rewritten, and once with these spoiled and no spans."""
    rng, out = random.Random(seed), []
    for region in rows:
        own: list[Span] = []
        for s in base_spans(region):
            if all(s.start >= o.end for o in own):
                own.append(s)
        out.append((region, own))
        if own:
            text, spans, at = "", [], 0
            for s in own:
                text += region[at : s.start]
                new = _rewritten(s.kind, region[s.start : s.end], rng)
                spans.append(Span(s.kind, len(text), len(text) + len(new), False))
                text, at = text + new, s.end
            out.append((text + region[at:], spans))
            text, at = "", 0
            for s in own:
                text, at = text + region[at : s.start] + _spoiled(s.kind, region[s.start : s.end], rng), s.end
            if not base_spans(text + region[at:]):
                out.append((text + region[at:], []))
    return out


def fit(rows: list[str], *, epochs: int = 4, seed: int = 3) -> Model:
    """A model from regions by AdaGrad on the log-likelihood of their segmentations; without regions it adds nothing."""
    model, grad = Model(), {}
    weights = model.weights
    data = []
    for region, spans in examples(rows, seed):
        tokens, cands = candidates(region)
        gold = {(KINDS.index(s.kind), s.start, s.end) for s in spans}
        if cands:
            names = [tuple(f"{c.kind}:{f}" for f in c.features) for c in cands]
            hit = [(c.kind, tokens[c.first][0], tokens[c.last][1]) in gold for c in cands]
            data.append((len(tokens), cands, names, hit))
    rng = random.Random(seed)

    def move(f: str, g: float, start: float) -> None:
        w = weights.get(f, start)
        d = g - 1e-4 * w
        grad[f] = grad.get(f, 1e-4) + d * d
        weights[f] = w + 0.25 * d / math.sqrt(grad[f])

    for _ in range(epochs):
        rng.shuffle(data)
        for n, cands, names, hit in data:
            scores = [sum([weights.get(f, -0.3 if f.endswith(":bias") else 0.0) for f in fs]) for fs in names]
            chances, steps = _posterior(n, cands, scores, model.steps())
            for fs, p, y in zip(names, chances, hit, strict=True):
                if abs(y - p) >= 1e-3:
                    for f in fs:
                        move(f, y - p, -0.3 if f.endswith(":bias") else 0.0)
            taken = _taken(cands, hit)
            for key in {**steps, **taken}:
                g = taken.get(key, 0.0) - steps.get(key, 0.0)
                if abs(g) >= 1e-3:
                    move(_step(*key), g, 0.0)
    return model


class Finder:
    """Spans of texts with one model; regions seen before are remembered."""

    def __init__(self, model: Model):
        self.model, self.steps = model, model.steps()
        self.known: dict[str, list[tuple[int, int, int]]] = {}

    def _solved(self, region: str) -> list[tuple[int, int, int]]:
        found = self.known.get(region)
        if found is None:
            tokens, cands = candidates(region)
            best = _best(len(tokens), cands, [self.model.score(c) for c in cands], self.steps) if cands else []
            found = [(c.kind, tokens[c.first][0], tokens[c.last][1]) for c in best]
            if len(region) <= MEMO_CHARS:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                self.known[region] = found
        return found

    def spans(self, text: str) -> list[Span]:
        """All spans by start, then kind: the base ones, and of the model's those that overlap none of them."""
        base = base_spans(text)
        if not self.model.weights:
            return base
        more, taken, i = [], sorted((s.start, s.end) for s in base), 0
        reach: list[int] = []  # the greatest end so far
        for _, e in taken:
            reach.append(max(e, reach[-1] if reach else 0))
        starts = [s for s, _ in taken]
        for a, b in regions(text):
            for k, s, e in self._solved(text[a:b]):
                while i < len(starts) and starts[i] < a + e:
                    i += 1
                j = i
                while j and starts[j - 1] >= a + e:
                    j -= 1
                if not j or reach[j - 1] <= a + s:
                    more.append(Span(KINDS[k], a + s, a + e, False))
        return sorted([*base, *more], key=lambda s: (s.start, KINDS.index(s.kind), s.end)) if more else base


class _Least:
    """The ``most`` distinct texts of least hash of those given so far."""

    def __init__(self, most: int):
        self.most, self.bound, self.kept = most, None, {}

    def wants(self, h: int) -> bool:
        return self.most > 0 and (self.bound is None or h <= self.bound)

    def add(self, h: int, text: str) -> None:
        self.kept[text] = h
        if len(self.kept) > 4 * self.most:
            self.prune()

    def prune(self) -> None:
        if len(self.kept) > self.most:
            rows = sorted((h, text) for text, h in self.kept.items())[: self.most]
            self.kept, self.bound = {text: h for h, text in rows}, rows[-1][0]


def sample(docs: DataFrame, *, text_col: str = "text", most: int = FIT_REGIONS) -> list[str]:
    """At most ``most`` distinct regions of the texts, those of least hash; half of them with base spans if there are so many. Regions of more than ``MEMO_CHARS`` characters are not in it. Each task hands on its own least ones only, among which those of all the rows are."""
    named = docs.select(F.col(f"`{text_col}`").alias("text")).where("text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        halves = [_Least(most // 2), _Least(most // 2)]
        for batch in batches:
            for piece in pieces(batch):
                for text in piece.column("text").to_pylist():
                    for region in {text[a:b] for a, b in regions(text) if b - a <= MEMO_CHARS}:
                        h = xxhash.xxh64_intdigest(region.encode("utf-8", "surrogatepass"), seed=42)
                        h -= (h >> 63) << 64  # signed, as in Spark
                        if any(half.wants(h) for half in halves) and (half := halves[bool(base_spans(region))]).wants(h):
                            half.add(h, region)
        for held, half in enumerate(halves):
            half.prune()
            rows = list(half.kept.items())
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in rows], pa.string()), pa.array([bool(held)] * len(rows), pa.bool_()), pa.array([h for _, h in rows], pa.int64())], ["region", "held", "h"])

    found = stored(named.mapInArrow(run, "region string, held boolean, h long"))
    halves = [found.where("held"), found.where("not held")]
    out = [r.region for half in halves for r in half.select("h", "region").distinct().orderBy("h", "region").limit(most // 2).collect()]
    discard(found)
    return out


def train(docs: DataFrame, *, text_col: str = "text", most: int = FIT_REGIONS) -> Model:
    """A model from a sample of at most ``most`` regions; the fit is on the driver."""
    return fit(sample(docs, text_col=text_col, most=most))


def _mapped(docs: DataFrame, model: Model, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = named.schema["id"].dataType.simpleString()
    shipped = docs.sparkSession.sparkContext.broadcast(model)  # the weights of the sample's features

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(shipped.value)
        for batch in batches:
            for piece in pieces(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                names, arrays = columns(texts, [finder.spans(t) if t else [] for t in texts])
                yield pa.RecordBatch.from_arrays([piece.column("id"), *arrays], ["id", *names])

    return named.mapInArrow(run, f"id {kind}, {schema}")


def _redact(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for s in spans:
        if s.end > at:
            out += [text[at : max(at, s.start)], f"<{s.kind}>" if s.start >= at else ""]
            at = s.end
    return "".join([*out, text[at:]])


def found(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, spans, redacted) of each row: spans as array<struct<kind,start,end,base>> in code points, end exclusive, by start then kind; redacted is the text with each span's kind in its place.

    base marks the rules' spans, which always stay; spans of the model that overlap one of them are dropped. Whole texts
    are read; memory follows the longest one. A null or empty text has no spans and is redacted to an empty one. Repeated
    rows are rows of their own, an empty table gives none, and columns other than the two named are not read.
    """
    kind = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def columns(texts: list[str], spans: list[list[Span]]) -> tuple[list[str], list[pa.Array]]:
        rows = pa.array([[s._asdict() for s in own] for own in spans], pa.list_(kind))
        return ["spans", "redacted"], [rows, pa.array([_redact(t, own) for t, own in zip(texts, spans, strict=True)], pa.string())]

    return _mapped(docs, model, id_col, text_col, "spans array<struct<kind:string,start:int,end:int,base:boolean>>, redacted string", columns)


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def digests(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans): counts of the base spans, their digest, all spans as text, and how many of them the field added and there are in all."""

    def columns(texts: list[str], spans: list[list[Span]]) -> tuple[list[str], list[pa.Array]]:
        base = [[s for s in own if s.base] for own in spans]
        counts = [pa.array([sum(s.kind == k for s in own) for own in base], pa.int64()) for k in KINDS]
        sha = pa.array([hashlib.sha256(_joined(own).encode()).hexdigest() for own in base], pa.string())
        return [*(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", "n_spans"], [*counts, sha, pa.array([_joined(own) for own in spans], pa.string()), pa.array([sum(not s.base for s in own) for own in spans], pa.int64()), pa.array([len(own) for own in spans], pa.int64())]

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return _mapped(docs, model, id_col, text_col, f"{counts}, base_sha256 string, spans string, n_added long, n_spans long", columns)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digests(docs, train(docs)).withColumnRenamed("id", "doc_id")
