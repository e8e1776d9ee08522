"""Column functions on texts of cues and lines."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid.functions import fixed
from cuegrid.functions.numbers import places

BLANK = "[ \\t\\n\\x0B\\f\\r]+"


def collapsed(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def char_count(text: Column) -> Column:
    return F.length(collapsed(text))


def reading_seconds(text: Column, rate: float) -> Column:
    return char_count(text) / F.lit(max(1.0, float(rate)))


def same_text(a: Column, b: Column) -> Column:
    return F.lower(collapsed(a)) == F.lower(collapsed(b))


def is_non_speech(text: Column) -> Column:
    """Nothing, only the name of a sound, or no letter and no digit."""
    t = F.trim(F.coalesce(text, F.lit("")))
    return (t == "") | t.rlike(fixed.NON_SPEECH) | ~t.rlike("[\\p{L}\\p{N}]")


def is_made_up(text: Column) -> Column:
    """A line that recognisers make up over silence: a known line, a known fragment, or one of the patterns."""
    t = F.trim(F.coalesce(text, F.lit("")))
    bare = F.lower(F.regexp_replace(F.regexp_replace(t, "[\\p{P}\\s]+$", ""), "(\\p{IsHangul})(은|는|이|가|을|를|도|만)$", "$1"))
    norm = F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), "[\\p{P}\\p{S}]", " "), BLANK, " "))
    hit = bare.isin(*fixed.MADE_UP_FRAGMENTS) | norm.isin(*fixed.MADE_UP_LINES)
    for pattern in (*fixed.MADE_UP_PATTERNS, "^by\\s+[\\p{IsHangul}\\p{IsHan}\\p{IsHiragana}\\p{IsKatakana}\\p{IsCyrillic}]"):
        hit = hit | t.rlike(pattern)
    return (t != "") & hit


def speakable(text: Column) -> Column:
    """Holds a Cyrillic letter."""
    return F.coalesce(text.rlike("[а-яёА-ЯЁ]"), F.lit(False))


def trim_loop(text: Column) -> Column:
    """One copy of a text that is three or more copies of its beginning (six words at least), else the text."""
    words = F.split(F.trim(text), BLANK)
    n = F.size(words)
    whole = lambda s: (n % s == 0) & F.forall(F.sequence(s + 1, n), lambda i: F.element_at(words, i) == F.element_at(words, i - s))
    sizes = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.floor(n / 3).cast("int"))), whole)
    return F.when((n >= 6) & (F.size(sizes) > 0), F.array_join(F.slice(words, F.lit(1), F.element_at(sizes, 1)), " ")).otherwise(F.trim(text))


def timestamp(seconds: Column) -> Column:
    """HH:MM:SS,mmm; not before 0."""
    s = F.greatest(F.lit(0.0), seconds)
    total = F.floor(s)
    ms = F.floor((s - total) * 1000 + F.lit(0.5))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    return F.concat(two(F.floor(total / 3600)), F.lit(":"), two(F.floor(total % 3600 / 60)), F.lit(":"), two(total % 60), F.lit(","), F.when(ms < 1000, F.lpad(ms.cast("string"), 3, "0")).otherwise(ms.cast("string")))


def _packed(parts: Column, capacity: int) -> Column:
    """Parts joined by spaces in turn as long as they fit; a part that is longer stands alone."""
    empty = F.expr("named_struct('done', CAST(array() AS array<string>), 'now', '')")

    def step(s: Column, x: Column) -> Column:
        fits = (s["now"] == "") | (F.length(s["now"]) + 1 + F.length(x) <= capacity)
        joined = F.when(s["now"] == "", x).otherwise(F.concat(s["now"], F.lit(" "), x))
        return F.struct(F.when(fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))).alias("done"), F.when(fits, joined).otherwise(x).alias("now"))

    return F.aggregate(parts, empty, step, lambda s: F.when(s["now"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["now"]))))


def split_long(text: Column, capacity: int, enders: str = ".!?…") -> Column:
    """A text as parts that fit a cue: sentences packed, and words of a sentence that is too long."""
    t = collapsed(text)
    own = F.filter(F.transform(F.regexp_extract_all(t, F.lit(f"[^{enders}]+[{enders}]*\\s*"), 0), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.flatten(F.transform(_packed(F.when(F.size(own) > 0, own).otherwise(F.array(t)), capacity), lambda p: F.when(F.length(p) <= capacity, F.array(p)).otherwise(_packed(F.split(p, " "), capacity))))
    return F.when(t == "", F.expr("CAST(array() AS array<string>)")).when(F.length(t) <= capacity, F.array(t)).otherwise(parts)


def _wrapped(text: str, width: int, most: int) -> list[str]:
    """Lines of one cue, broken where they balance and no small word is left at an end."""
    out: list[str] = []
    words = text.split()
    while words:
        line, left = " ".join(words), most - len(out)
        if len(line) <= width or left <= 1:
            return [*out, line]
        goal = len(line) / min(left, -(-len(line) // width))
        best, cut, used = float("inf"), 0, -1
        for i, word in enumerate(words[:-1], 1):
            used += len(word) + 1
            if used > width:
                break
            small = "".join(c for c in word.lower() if c.isalpha()) in fixed.CLINGING
            over = len(line) - used - 1 > width * (left - 1)
            price = abs(used - goal) + width * (small + over) - (width / 3 if word[-1] in ".!?…,;:—" else 0)
            if price < best:
                best, cut = price, i
        cut = cut or 1
        out.append(" ".join(words[:cut]))
        words = words[cut:]
    return out


def wrapped(text: Column, width: int = 42, most: int = 2) -> Column:
    """Lines of a cue's text; a search over break points, in batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: _wrapped(t or "", width, most))

    return run(text)


def _without_groups(words: list[str], most: int) -> list[str]:
    out, i = [], 0
    while i < len(words):
        end = next((j for j in range(i, min(i + most, len(words))) if re.search(r"[\])}][\W_]*$", words[j])), None) if words[i] and words[i][0] in "[({" else None
        if end is None:
            out.append(words[i])
            end = i
        i = end + 1
    return out


def bracketless(words: Column, most: int = 8) -> Column:
    """Words without the groups from an opening bracket to a closing one at most so many words on; an unclosed bracket stays. A skip that carries state, in batches."""

    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            yield rows.map(lambda ws: _without_groups([w or "" for w in ws], most) if ws is not None else None)

    return run(words)


PAST = tuple({(p + m, p + f) for m, f in fixed.PAST_STEMS for p in fixed.PAST_PREFIXES} | set(fixed.PAST_WORDS) | set(fixed.SHORT_FORMS))
MALE, FEMALE = sorted({m for m, _ in PAST}), sorted({f for _, f in PAST})


def mark_of(word: Column) -> Column:
    """m or f for a word that tells its subject's gender: short forms, irregular past tenses, and endings."""
    w = F.lower(word)
    core = F.when((F.length(w) > 4) & w.rlike("с[яь]$"), F.left(w, F.length(w) - 2)).otherwise(w)
    return (
        F.when(w.isin(*[f for _, f in fixed.SHORT_FORMS]), "f").when(w.isin(*[m for m, _ in fixed.SHORT_FORMS]), "m").when(w.isin(*fixed.NOT_VERBS), None)
        .when(core.isin(*MALE), "m").when(core.isin(*FEMALE), "f")
        .when((F.length(w) > 3) & (w.endswith("лась") | w.endswith("ла")), "f").when((F.length(w) > 2) & (w.endswith("лся") | w.endswith("л")), "m")
    )


def gender_hits(text: Column, pronoun: str, window: int = 3) -> Column:
    """array<struct<gender,fragment>>: for each such pronoun the first telling word of the next few Cyrillic words."""
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[а-яёА-ЯЁ]+"), 0)

    def hit(word: Column, i: Column) -> Column:
        told = F.filter(F.slice(words, i + 2, window), lambda w: mark_of(w).isNotNull())
        first = F.get(told, 0)
        return F.when((F.lower(word) == pronoun) & first.isNotNull(), F.struct(mark_of(first).alias("gender"), F.concat(word, F.lit(" "), first).alias("fragment")))

    return F.filter(F.transform(words, hit), lambda x: x.isNotNull())


def vocatives(text: Column) -> Column:
    """Capitalised names after a comma or a dash."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[,—-]\\s*([А-ЯЁ][а-яё]{2,})"), 1)


def sound(word: Column) -> Column:
    """Vowels that sound alike as one."""
    return F.translate(word, "эиыйеоаяю", "иииииааау")


def same_word(first: Column, second: Column) -> Column:
    """Words that may be one another misheard: alike by sound, with a common beginning, or few edits apart."""
    a, b = sound(first), sound(second)
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    stem = F.greatest(F.lit(4), short - 2)
    alike = (F.left(a, stem) == F.left(b, stem)) & (short >= stem)
    return (a == b) | ((short > 2) & (alike | (F.levenshtein(a, b) <= F.greatest(F.lit(1), F.floor(long * 0.3)))))


def tidy_reason(message: Column, most: int = 160) -> Column:
    """An error as one line: without a stage's prefix, a nested message in place of its JSON, cut."""
    text = F.regexp_replace(message, "^\\[s\\d\\]\\s*", "")
    json = F.regexp_extract(text, "(?s)(\\{.*)$", 1)
    inner = F.coalesce(F.get_json_object(json, "$.error.message"), F.get_json_object(json, "$.error"), F.get_json_object(json, "$.message"))
    line = collapsed(F.when((json != "") & inner.isNotNull(), F.concat(F.left(text, F.length(text) - F.length(json)), inner)).otherwise(text))
    return F.when(F.length(line) > most, F.concat(F.left(line, F.lit(most - 3)), F.lit("…"))).otherwise(line)


def bytes_text(n: Column) -> Column:
    """A size in B, KB, MB or GB."""
    one = lambda x, unit: F.concat(F.format_string("%.1f", x), F.lit(unit))
    return F.when(n < 1024, F.concat(n.cast("long").cast("string"), F.lit(" B"))).when(n < 1024**2, one(n / 1024, " KB")).when(n < 1024**3, one(n / 1024**2, " MB")).otherwise(one(n / 1024**3, " GB"))


def cost_text(usd: Column) -> Column:
    shown = lambda n: F.concat(F.lit("$"), F.format_string(f"%.{n}f", places(usd, n)))
    return F.when(usd == 0, "free").when(usd < 0.01, shown(5)).otherwise(shown(4))


def clip_key(voice: Column, text: Column, engine: Column) -> Column:
    """16 hex digits that name a clip by engine, voice and text."""
    return F.substring(F.sha2(F.concat(engine, F.lit("\x00"), voice, F.lit("\x00"), F.trim(text)), 256), 1, 16)


def is_output_name(name: Column, suffix: str = "_out") -> Column:
    """Whether a file's name carries the suffix of what the engine writes."""
    return name.rlike(f"{suffix}(\\.[a-z0-9]+)?$")


def fallback_text(text: Column) -> Column:
    """A source text that may stand in for a translation: Latin and Cyrillic letters only, else null."""
    return F.when(~F.regexp_replace(text, "[\\p{IsLatin}\\p{IsCyrillic}]", "").rlike("\\p{L}"), text)


def own_or_default(value: Column, standard: int, of_language: Column) -> Column:
    """A setting that a language may change only where it is still the standard one."""
    return F.when(value == standard, of_language).otherwise(value)


def bullets(names: Column, texts: Column) -> Column:
    """Lines of the texts of those names that are on (a map of names to booleans)."""
    on = F.map_keys(F.map_filter(names, lambda _, v: v))
    return F.array_join(F.transform(F.array_sort(on), lambda k: F.concat(F.lit("- "), F.try_element_at(texts, k))), "\n")


def accepted_parts(text: Column, parts: Column, phrases: Column) -> Column:
    """Whether parts of a text may be spoken apart: no more than phrases, all speakable, and together the text but for case and blanks."""
    joined = lambda c: F.lower(F.regexp_replace(c, BLANK, ""))
    return (F.size(parts) <= phrases) & F.forall(parts, speakable) & (joined(F.array_join(parts, "")) == joined(text))
