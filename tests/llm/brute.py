"""Brute-force versions that the operators are held against."""

from __future__ import annotations

import re


def words(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def shingles(text: str | None, width: int) -> set:
    w = words(text)
    if not w:
        return set()
    return {tuple(w)} if len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near_components(rows: list[tuple[int, str | None]], width: int, percent: int) -> dict[int, tuple[int, int]]:
    """id -> (set size, component)."""
    sets = {i: shingles(t, width) for i, t in rows}
    up = {i: i for i in sets}

    def top(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    index: dict = {}
    for i, s in sets.items():
        for x in s:
            index.setdefault(x, []).append(i)
    for i, s in sets.items():
        for j in {j for x in s for j in index[x] if j > i}:
            t = sets[j]
            if 100 * len(s & t) >= percent * len(s | t):
                a, b = sorted((top(i), top(j)))
                up[b] = a
    return {i: (len(s), top(i)) for i, s in sets.items()}
