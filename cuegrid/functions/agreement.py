"""Words made to agree with a speaker's gender, and clips checked against what was heard: small rules that Spark runs in batches."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid.functions import fixed
from cuegrid.functions.text import PAST

_TO = {"f": {}, "m": {}}
for _m, _f in (*fixed.PAST_WORDS, *((p + m, p + f) for m, f in fixed.PAST_STEMS for p in fixed.PAST_PREFIXES), *fixed.SHORT_FORMS):
    _TO["f"].setdefault(_m, _f)
    _TO["m"].setdefault(_f, _m)
_SHORT = {w: g for m, f in fixed.SHORT_FORMS for w, g in ((m, "m"), (f, "f"))}
_MALE, _FEMALE = {m for m, _ in PAST}, {f for _, f in PAST}
#: Words that join predicates, other subjects, and words that stress a subject.
JOINERS = {"и", "а", "но", "или", "потом", "затем"}
PERSONS = {"он", "она", "оно", "они", "я", "ты", "вы", "мы"}
SUBJECTS = PERSONS | {"это", "кто", "что"}
STRESS = {"сам", "сама"}
#: Latin letters by sound, longest first.
LATIN = (("sch", "ш"), ("sh", "ш"), ("ch", "ч"), ("th", "т"), ("ph", "ф"), ("zh", "ж"), ("kh", "х"), ("oo", "у"), ("ee", "и"), ("ya", "я"), ("yu", "ю"), ("yo", "ё"), *zip("abcdefghi", "абкдефгхи", strict=True), ("j", "дж"), *zip("klmnopqrstuvw", "клмнопкрстувв", strict=True), ("x", "кс"), ("y", "и"), ("z", "з"))
_LATIN = re.compile("|".join(a for a, _ in LATIN))


def mark(word: str) -> str | None:
    w = word.lower()
    if w in _SHORT:
        return _SHORT[w]
    if w in fixed.NOT_VERBS:
        return None
    core = w[:-2] if len(w) > 4 and w.endswith(("ся", "сь")) else w
    if core in _MALE or core in _FEMALE:
        return "m" if core in _MALE else "f"
    if len(w) > 3 and w.endswith(("ла", "лась")):
        return "f"
    return "m" if len(w) > 2 and w.endswith(("л", "лся")) else None


def flip(word: str, to: str) -> str | None:
    """The word in the other gender, with its reflexive ending and case; None if it tells none or fits already."""
    w = word.lower()
    if mark(w) in (None, to):
        return None
    reflexive = len(w) > 4 and w.endswith(("ся", "сь"))
    core = w[:-2] if reflexive else w
    out = _TO[to].get(core) or (core[:-2] + "ела" if to == "f" and core.endswith("ёл") else core + "а" if to == "f" and core.endswith("л") else core[:-1] if to == "m" and core.endswith("ла") else None)
    if out is None:
        return None
    out += {"f": "сь", "m": "ся"}[to] if reflexive else ""
    return out.upper() if word.isupper() and len(word) > 1 else out.capitalize() if word[0].isupper() else out


def agreed(text: str, pronoun: str, to: str) -> str:
    return agreed_with_fixes(text, pronoun, to)[0]


def agreed_with_fixes(text: str, pronoun: str, to: str) -> tuple[str, list[tuple[str, str]]]:
    """(text, fixes): the words that were replaced, as pairs; text with the predicates of a pronoun in its gender: the first telling word of three, those joined to it, and stressing words, up to another subject or the sentence's end."""
    out, at, fixes = [], 0, []
    for sentence in re.finditer(r"[^.!?;…]+", text):
        words = list(re.finditer(r"[а-яёА-ЯЁ]+", sentence[0]))
        low = [w[0].lower() for w in words]
        change: set[int] = set()
        for p in (i for i, w in enumerate(low) if w == pronoun):
            last, look, reach = p, p + 1, 3
            while True:
                own = next((i for i in range(look, len(low)) if low[i] in SUBJECTS), len(low))
                hit = next((i for i in range(look, min(look + reach, own)) if mark(low[i])), None)
                if hit is None:
                    break
                change.add(hit)
                last = look = hit
                if hit + 1 < len(low) and low[hit + 1] in _SHORT:
                    change.add(look := hit + 1)
                if look + 1 >= len(low) or low[look + 1] not in JOINERS:
                    break
                look, reach = look + 2, 2
            stop = next((i for i in range(last + 1, len(low)) if low[i] in PERSONS), len(low))
            change |= {i for i in range(last + 1, stop) if low[i] in STRESS}
        for i in sorted(change):
            a, b = sentence.start() + words[i].start(), sentence.start() + words[i].end()
            new = flip(text[a:b], to)
            fixes += [(text[a:b], new)] if new else []
            out += [text[at:a], new or text[a:b]]
            at = b
    return "".join([*out, text[at:]]), fixes


def replayed(text: str, fixes: list[tuple[str, str]]) -> str:
    """text with each fix's first whole word replaced, one fix after another."""
    for old, new in fixes:
        text = re.sub(f"(?<![а-яёА-ЯЁ]){re.escape(old)}(?![а-яёА-ЯЁ])", lambda _, w=new: w, text, count=1)
    return text


FIXES = "array<struct<old:string,new:string>>"


def agree_with_fixes(text: Column, pronoun: str, gender: Column) -> Column:
    """(text, fixes): agree() with the list of replaced words."""

    @F.pandas_udf(f"text string, fixes {FIXES}")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, genders in batches:
            told = [agreed_with_fixes(t, pronoun, g) if isinstance(t, str) and g in ("m", "f") else (t, []) for t, g in zip(texts, genders, strict=True)]
            yield pd.DataFrame({"text": [t for t, _ in told], "fixes": [[{"old": a, "new": b} for a, b in f] for _, f in told]})

    # So marked, Spark does not work it out once more, in a worker of its own, for a filter that names it.
    return run.asNondeterministic()(text, gender)


def replay(texts: Column, fixes: Column) -> Column:
    """A list of texts with the fixes replayed on each of them."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lists, changes in batches:
            yield pd.Series([None if xs is None else [replayed(x, [(f["old"], f["new"]) for f in fs]) if isinstance(x, str) else None for x in xs] for xs, fs in zip(lists, changes, strict=True)])

    return run(texts, fixes)


def agree_and_replay(text: Column, pronoun: str, gender: Column, before: Column, texts: Column) -> Column:
    """(text, fixes, phrases): agree_with_fixes() with the fixes made ``before`` in front, all of them replayed on the list ``texts``; in one pass, so a task has one worker for both."""

    @F.pandas_udf(f"text string, fixes {FIXES}, phrases array<string>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for told, genders, made, lists in batches:
            out = []
            for t, g, old, xs in zip(told, genders, made, lists, strict=True):
                new, own = agreed_with_fixes(t, pronoun, g) if isinstance(t, str) and g in ("m", "f") else (t, [])
                fixes = [(f["old"], f["new"]) for f in old] + own
                out.append((new, [{"old": x, "new": y} for x, y in fixes], None if xs is None else [replayed(x, fixes) if isinstance(x, str) else None for x in xs]))
            yield pd.DataFrame(out, columns=["text", "fixes", "phrases"])

    return run.asNondeterministic()(text, gender, before, texts)


def agree(text: Column, pronoun: str, gender: Column) -> Column:
    """Texts made to agree with a gender of m or f; another gender leaves them."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for texts, genders in batches:
            yield pd.Series([agreed(t, pronoun, g) if isinstance(t, str) and g in ("m", "f") else t for t, g in zip(texts, genders, strict=True)])

    return run(text, gender)


def heard_words(text: str) -> list[str]:
    """Words for comparison: lower case, Latin letters by sound, without soft and hard signs."""
    words = re.sub(r"[^\w]|_", " ", text.lower().replace("ё", "е")).split()
    return [_LATIN.sub(lambda m: dict(LATIN)[m[0]], w).replace("ё", "е").translate({ord("ь"): None, ord("ъ"): None}) for w in words]


_SOUND = str.maketrans("эиыйеоаяю", "иииииааау")


def _edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike(a: str, b: str) -> bool:
    x, y = a.translate(_SOUND), b.translate(_SOUND)
    short = min(len(x), len(y))
    stem = max(4, short - 2)
    return x == y or short > 2 and (short >= stem and x[:stem] == y[:stem] or _edits(x, y) <= max(1, int(0.3 * max(len(x), len(y)))))


def aligned(expected: list[str], heard: list[str]) -> list[tuple[int, int]]:
    """The longest list of pairs of like words in order; a word of five letters may have been heard as two."""
    n, m = len(expected), len(heard)
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (m + 3) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            own = max(best[i + 1][j], best[i][j + 1], key=lambda v: v[0])
            for width in (1, 2):
                if j + width <= m and (width == 1 or len(expected[i]) >= 5) and alike(expected[i], "".join(heard[j : j + width])):
                    own = max((best[i + 1][j + width][0] + 1, ((i, j), best[i + 1][j + width][1])), own, key=lambda v: v[0])
            best[i][j] = own
    out, chain = [], best[0][0][1]
    while chain:
        out.append(chain[0])
        chain = chain[1]
    return out


def judged(text: str, heard_text: str) -> tuple[bool, float, float, list[str]]:
    """(ok, score, coverage, problems) of a clip: the share of words of three letters that were heard, less what is wrong at its ends."""
    expected, heard = heard_words(text), heard_words(heard_text)
    telling = lambda ws: any(len(w) >= 3 for w in ws)
    if not telling(expected):
        return True, 1.0, 1.0, []
    if not heard:
        return False, 0.0, 0.0, ["garbled"]
    pairs = aligned(expected, heard)
    counted = [len(w) >= 3 for w in expected]
    coverage = sum(counted[i] for i, _ in pairs) / sum(counted)
    glued = len(heard[0]) >= len(expected[0]) + 3 and heard[0].endswith(expected[0])
    found = {"junk-start": glued or bool(pairs) and pairs[0][0] == 0 and telling(heard[: pairs[0][1]]), "lost-start": bool(pairs) and telling(expected[int(glued) : pairs[0][0]]), "lost-end": bool(pairs) and telling(expected[pairs[-1][0] + 1 :]), "garbled": coverage < 0.75}
    problems = [k for k, v in found.items() if v]
    price = sum({"junk-start": 0.5, "garbled": 0.0}.get(p, 0.3) for p in problems)
    return not problems, round(coverage - price, 3), round(coverage, 3), problems


def clip_verdict(text: Column, heard: Column) -> Column:
    """struct<ok,score,coverage,problems> of clips."""

    @F.pandas_udf("ok boolean, score double, coverage double, problems array<string>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, heards in batches:
            yield pd.DataFrame([judged(t or "", h or "") for t, h in zip(texts, heards, strict=True)], columns=["ok", "score", "coverage", "problems"])

    return run(text, heard)


def split_by_pauses(text: str, shares: list[float], least: int = 4) -> list[str] | None:
    """A translation cut at its marks, each pause of the source at the nearest free one; None where a part would be too short or not speakable."""
    t = text.strip()
    free = [m.end() for m in re.finditer(r"[.,!?;:…—](?= )", t) if m.end() >= least and len(t) - m.end() >= least]
    cuts = []
    for s in shares:
        if free:
            cuts.append(min(free, key=lambda p: abs(p / len(t) - s)))
            free.remove(cuts[-1])
    parts = [t[a:b].strip() for a, b in zip([0, *sorted(cuts)], [*sorted(cuts), len(t)], strict=True)]
    return parts if cuts and all(len(p) >= least and re.search("[а-яёА-ЯЁ]", p) for p in parts) else None
