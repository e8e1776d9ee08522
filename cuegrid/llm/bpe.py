"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word the BPE result has one last token, so one token for each prefix stores all of them.
A token that ends at a prefix is that last token if it may follow the last token of the prefix before it; an automaton
with suffix links names all tokens that end at each place, and the pair test asks whether any merge would cross the
border between two tokens. Back-pointers from the whole word give its ids.
"""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from cuegrid.llm.textnum import freed, pieces

END = "</w>"
#: The first code point of the letters that stand for a word's last byte.
_LAST = 0x4000
#: Words that one task remembers at most, and runs of words and pairs of tokens.
REMEMBERED, RUNS = 80_000, 240_000
#: Bytes of text taken at once.
PIECE = 1 << 20
#: Fixed values of the vocabulary: how it splits a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Where the public tokenizers library follows another version of Unicode than Python and ``regex``.
#: Combining marks that its NFC takes for letters that combine with nothing; letters and numbers that it takes for signs.
LATE_MARKS = """
07FD 0898-089F 08CA-08D3 09FE 0C3C 0D3B-0D3C 0EBA 1715 1ABF-1ACE 1DF6-1DFA A82C 10D24-10D27 10EAB-10EAC 10EFD-10EFF 10F46-10F50 10F82-10F85 11070
1133B 1145E 11839-1183A 1193D-1193E 11943 119E0 11A34 11A47 11A99 11D42 11D44-11D45 11D97 11F41-11F42 16FF0-16FF1 1E08F 1E130-1E136 1E2AE 1E2EC-1E2EF
1E4EC-1E4EF
"""
NO_LETTERS = """
0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A
11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6
1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD
323B0-33479 3D000-3FC3F
"""
NO_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
#: Its lower-case letters of capitals (first-last+offset, or capital=letter) that Python leaves alone.
LATE_CAPITALS = "1C89+1 A7CB=0264 A7CC+1 A7CE+1 A7D2+1 A7D4+1 A7DA+1 A7DC=019B 10D50-10D65+20 16EA0-16EB8+1B"
#: Settings of a vocabulary file that this codec follows.
FOLLOWED = ("NFC", "Replace", "Lowercase", "Split", "ByteLevel", END)


def _class_of(ranges: str) -> str:
    """The inside of a character class."""
    return "".join("-".join(chr(int(x, 16)) for x in r.split("-")) for r in ranges.split())


def _lower_case() -> dict[int, int]:
    out = {}
    for entry in LATE_CAPITALS.split():
        if "=" in entry:
            a, b = entry.split("=")
            out[int(a, 16)] = int(b, 16)
        else:
            span, offset = entry.split("+")
            first, last = (span.split("-") * 2)[:2]
            out |= {c: c + int(offset, 16) for c in range(int(first, 16), int(last, 16) + 1)}
    return out


_LOWER = _lower_case()
_MARKS = regex.compile(f"([{_class_of(LATE_MARKS)}])")
_LATE = regex.compile(f"[{_class_of(LATE_MARKS + NO_LETTERS + NO_NUMBERS)}{''.join(map(chr, _LOWER))}]")
_LATE_WORDS = regex.compile(rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}--[{_class_of(NO_LETTERS)}]]+|[\p{{N}}--[{_class_of(NO_NUMBERS)}]]|(?:[^\s\p{{L}}\p{{N}}]|[{_class_of(NO_LETTERS + NO_NUMBERS)}])+")
_SEPARATORS = regex.compile(r"[\x1c-\x1f]")
_UNICODE_SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


def byte_letters() -> list[str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Codec:
    """A vocabulary with word ends, from the text of its JSON file."""

    def __init__(self, vocabulary: str):
        spec = json.loads(vocabulary)
        steps = [x["type"] for k in ("normalizer", "pre_tokenizer") for x in (spec.get(k) or {}).get("normalizers", (spec.get(k) or {}).get("pretokenizers", []))]
        if (*steps, spec["model"].get("end_of_word_suffix")) != FOLLOWED or spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") != WORDS:
            raise ValueError("this vocabulary splits texts in another way")
        ids: dict[str, int] = spec["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.text_of = {i: s for s, i in ids.items()} | {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS)
        letters = byte_letters()
        self.inner = {b: letters[b] for b in range(256)}
        self.missed = 0
        self.known_words: dict[str, bytes] = {}
        # Merges by both symbols in one number, and of each merged token its two symbols and the merge, in arrays.
        merges = [tuple(p) if isinstance(p, list) else tuple(p.split(" ")) for p in spec["model"]["merges"]]
        self.rank = {ids[x] << 32 | ids[y]: m for m, (x, y) in enumerate(merges)}
        top = max(ids.values(), default=0) + 1
        self.made = [array("i", [-1]) * top, array("i", [-1]) * top]
        self.merge = array("i", [-1]) * top
        for m, (x, y) in enumerate(merges):
            c = ids[x + y]
            if self.merge[c] < 0:
                self.made[0][c], self.made[1][c], self.merge[c] = ids[x], ids[y], m
        del merges, spec
        self.automaton = ahocorasick.Automaton()
        self.size: dict[int, int] = {}
        for s, i in ids.items():
            body = s[: -len(END)] if s.endswith(END) and s != END else s
            if body == "" or any(ch not in letters for ch in set(body)):
                continue
            if self.merge[i] >= 0 and self._crosses(self.made[0][i], self.made[1][i], self.merge[i]):
                continue  # no text encodes to it
            key = body[:-1] + chr(_LAST + ord(body[-1])) if s != body else body
            self.automaton.add_word(key, i)
            self.size[i] = len(key)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The symbols that stand at a token's right (1) or left (0) border while it is built, each with the rank of the merge that ends it."""
        out, merge, made = [(token, len(self.rank) + 1)], self.merge, self.made[side]
        while merge[token] >= 0:
            out.append((made[token], merge[token]))
            token = made[token]
        return out

    def _crosses(self, a: int, b: int, before: int) -> bool:
        """Whether a merge of rank less than ``before`` joins the right border of a with the left border of b.

        Of two equal merges that share a symbol the left one comes first, so at equal ranks a's own merge wins and b's loses.
        """
        left = self._spine(b, 0)
        for x, x_ends in self._spine(a, 1):
            for y, y_ends in left:
                m = self.rank.get(x << 32 | y)
                if m is not None and m < before and m < x_ends and m <= y_ends:
                    return True
        return False

    def follows(self, a: int, b: int) -> bool:
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= RUNS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = not self._crosses(a, b, len(self.rank) + 1)
        return known

    def word(self, word: str) -> bytes:
        """The ids of one word as the vocabulary splits them (already normalised)."""
        out = self.known_words.get(word)
        if out is not None:
            return out
        s = word.encode().decode("latin-1").translate(self.inner)
        s = s[:-1] + chr(_LAST + ord(s[-1]))
        last, pairs, size = [-1] * (len(s) + 1), self.pairs.get, self.size
        for at, i in self.automaton.iter(s):
            at += 1
            if last[at] < 0:
                n = size[i]
                if at == n:
                    last[at] = i
                elif (p := last[at - n]) >= 0:
                    fits = pairs(p << 32 | i)
                    if fits if fits is not None else self.follows(p, i):
                        last[at] = i
        at = len(s)
        ids = []
        while at:
            ids.append(last[at])
            at -= size[last[at]]
        out = struct.pack(f"<{len(ids)}I", *ids[::-1])
        if len(self.known_words) < REMEMBERED and len(word) <= 32:
            self.known_words[word] = out
        return out

    def _run(self, run: str) -> bytes:
        """The ids of a text without white space, as little-endian unsigned 32-bit integers."""
        if run.isascii():
            words = self.words.findall(run.lower())
        elif _LATE.search(run):
            plain = "".join([unicodedata.normalize("NFC", x) for x in _MARKS.split(run)])
            words = _LATE_WORDS.findall(plain.replace("Σ", "σ").translate(_LOWER).lower())
        else:
            words = self.words.findall(unicodedata.normalize("NFC", run).replace("Σ", "σ").lower())
        out = b"".join([self.word(word) for word in words])
        self.missed += 1
        if self.missed > 8 * REMEMBERED:  # the first words of a text are its frequent ones; after long, texts may be others
            self.missed = 0
            self.known.clear()
            self.known_words.clear()
        if len(self.known) < RUNS and len(run) <= 48:
            self.known[run] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers. Words are separated by white space in any text, so each run between is encoded once and remembered."""
        if self.special and "<|" in text:
            parts = self.split_special.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self._plain(p) for p in parts)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        runs = [x for x in _UNICODE_SPACE.split(text) if x] if _SEPARATORS.search(text) else text.split()
        known = self.known.get
        return b"".join([known(x) or self._run(x) for x in runs])

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with a space between, as a vocabulary without a decoder gives them; special ones stay."""
        text_of = self.text_of
        return " ".join([text_of[i] for i in np.frombuffer(ids, "<u4").tolist()])


def vocabulary_text(path: str | None = None) -> str:
    """The text of a vocabulary file; without a path the public word_bpe_49k.json of the installed package."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def encoded(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids, decoded) of each row: the ids as array<int> and the text that they decode to.

    A null text counts as empty: no ids, an empty text. Repeated rows are rows of their own; other columns are not read.
    Memory is bounded by the longest text and a fixed number of remembered words, and given back when the task ends.
    """
    return _mapped(docs, id_col, text_col, path, "ids array<int>, decoded string")


def token_ids(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids): encoded() where nothing is to be decoded."""
    return _mapped(docs, id_col, text_col, path, "ids array<int>")


def digests(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encoded() with digests in place of ids and text, for tables whose ids are to be compared rather than kept."""
    return _mapped(docs, id_col, text_col, path, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, id_col: str, text_col: str, path: str | None, schema: str) -> DataFrame:
    from pyspark.sql import functions as F

    named = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary_text(path))  # a few MB whatever the input
    kind = named.schema["id"].dataType.simpleString()

    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Codec(shipped.value)
        for batch in batches:
            for piece in pieces(batch, limit=PIECE):
                ids = [own.encode(t) if t else b"" for t in piece.column("text").to_pylist()]
                columns = [piece.column("id")]
                if "ids" in names:
                    ends = pa.array(np.concatenate(([0], np.cumsum([len(x) // 4 for x in ids]))).astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"))))
                if "decoded" in names:
                    columns.append(pa.array([own.decode(x) for x in ids], pa.string()))
                if "n_tokens" in names:
                    columns += [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["id", *names])
        del own
        freed()

    return named.mapInArrow(run, f"id {kind}, {schema}")


def op4_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumnRenamed("id", "doc_id")
