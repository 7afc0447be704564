"""Licence scans by patience alignment.

A text and a template are aligned on the words that occur once in each: of these anchors the longest increasing
subsequence is kept, and the gaps between them are aligned in the same way. Coverage is the number of aligned words as a share
of the template's words or, if they are more, of the words from the first aligned one to the last. Only stretches around two adjacent words of a template are looked at, and of these only such that hold as many pairs of adjacent template words as the coverage implies.

Templates are short notices, and the headers and whole texts in the folder `licenses`. A paragraph of a text is a template of its own, so that a
part of a licence is found; it is not listed within a place where its whole text is.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame

from .rows import map_texts

#: Notices that are looked for, version numbers left out.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache": "Licensed under the Apache License, Version",
    "cc-by-nc": "Licensed under CC BY-NC",
    "gpl": "This work is licensed under the GNU General Public License, version",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
}
#: Coverage from which a template counts as found.
COVERAGE = 0.8
#: Fewest words of a paragraph that is looked for by itself.
PART_WORDS = 20
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Lower-cased words and their places in code points."""
    found = list(_WORD.finditer(text))
    return [m[0].lower() for m in found], [m.span() for m in found]


def rising(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    heads: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        pile = bisect_left(tops, v)
        if pile:
            before[i] = heads[pile - 1]
        tops[pile : pile + 1] = [v]
        heads[pile : pile + 1] = [i]
    out, at = [], heads[-1] if heads else -1
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal words, rising on both sides."""
    pairs, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            pairs.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            pairs.append((a1, b1))
        if a0 >= a1 or b0 >= b1:
            continue
        once_a, once_b = _once(a, a0, a1), _once(b, b0, b1)
        anchors = [(i, once_b[w]) for w, i in once_a.items() if w in once_b]
        kept = [anchors[k] for k in rising([j for _, j in anchors])]
        for (i, j), (after_i, after_j) in zip([(a0 - 1, b0 - 1), *kept], [*kept, (a1, b1)]):
            if kept:
                gaps.append((i + 1, after_i, j + 1, after_j))
        pairs += kept
    return sorted(pairs)


def _once(words: list[str], start: int, end: int) -> dict[str, int]:
    """Words that occur once in the stretch, by place."""
    seen: dict[str, int] = {}
    for i in range(start, end):
        seen[words[i]] = -1 if words[i] in seen else i
    return {w: i for w, i in seen.items() if i >= 0}


@lru_cache(maxsize=1)
def known_templates() -> dict[str, str]:
    """The notices, the texts by the name of their file, and their paragraphs as name/1, name/2 and so on."""
    found = dict(TEMPLATES)
    for file in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = found[file.stem] = file.read_text(encoding="utf-8")
        parts = re.split(r"\n\s*\n", text.strip())
        if len(parts) > 1:
            found |= {f"{file.stem}/{i}": p for i, p in enumerate(parts, 1) if len(words_of(p)[0]) >= PART_WORDS}
    return found


def _without_lesser(found: list[tuple[str, int, int, float]]) -> list[tuple[str, int, int, float]]:
    """`found`, sorted by start, without paragraphs inside their whole text, and of two that share most of their place without the one less covered."""
    lost, open_ = set(), []
    for i, (name, start, end, share) in enumerate(found):
        open_ = [k for k in open_ if found[k][2] > start]
        for k in open_:
            other, begin, stop, its = found[k]
            common = min(end, stop) - start
            if ("/" in name) != ("/" in other):
                part, whole = (i, k) if "/" in name else (k, i)
                inside = found[whole][1] <= found[part][1] and found[part][2] <= found[whole][2]
                if inside and found[part][0].split("/")[0] == found[whole][0]:
                    lost.add(part)
            elif share != its and 2 * common > max(end - start, stop - begin):
                lost.add(i if share < its else k)
        open_.append(i)
    return [f for i, f in enumerate(found) if i not in lost]


class Scanner:
    def __init__(self, templates: dict[str, str], coverage: float):
        if not 0 < coverage <= 1:
            raise ValueError("coverage is over 0 and at most 1")
        self.coverage = coverage
        self.templates = {name: words for name, text in sorted(templates.items()) if (words := words_of(text)[0])}
        self.hints: dict[tuple[str, ...], list[str]] = {}
        for name, words in self.templates.items():
            for pair in set(zip(words, words[1:])) or {(words[0],)}:
                self.hints.setdefault(pair, []).append(name)
        self.single = any(len(k) == 1 for k in self.hints)

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) by start; of one template no two overlap, of much alike ones the best covered is named."""
        words, places = words_of(text)
        met: dict[str, list[int]] = {}
        for i, pair in enumerate(zip(words, [*words[1:], ""])):
            for name in self.hints.get(pair, ()):
                met.setdefault(name, []).append(i)
            if self.single:
                for name in self.hints.get((pair[0],), ()):
                    met.setdefault(name, []).append(i)
        out = []
        for name, at in met.items():
            out += self._of_template(name, at, words, places) if len(at) >= self.needed(name) else ()
        out.sort(key=lambda f: (f[1], f[2], f[0]))
        return _without_lesser(out)

    def needed(self, name: str) -> int:
        """Fewest pairs of adjacent words that an alignment of this coverage keeps: of A aligned words, no more than the others on either side lose theirs."""
        return max(1, int(len(self.templates[name]) * (3 * self.coverage - 2) - 1 - 1e-9))

    def _of_template(self, name: str, at: list[int], words: list[str], places: list[tuple[int, int]]) -> list[tuple[str, int, int, float]]:
        template, needed, out, free, k = self.templates[name], self.needed(name), [], 0, 0
        step = max(1, len(template) // 32)  # a window has room for that beside the longest stretch
        while k < len(at):
            i, k = at[k], k + 1
            if i < free:
                continue
            low = max(free, i - len(template))
            if bisect_right(at, i + len(template)) - bisect_left(at, low) < needed:
                continue
            found = align(words[low : i + len(template) + 1], template)
            if found:
                first, last = low + found[0][0], low + found[-1][0]
                share = len(found) / max(len(template), last - first + 1)
                if share >= self.coverage:
                    out.append((name, places[first][0], places[last][1], share))
                    free = last + 1
                    continue
            k = max(k, bisect_left(at, i + step))
        return out


def scan(
    df: DataFrame, templates: dict[str, str] | None = None, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, n_matches, licenses, coverage, spans) of every whole text.

    `licenses` are the names found, sorted, joined by commas; `spans` name:start:end by start; `coverage` the largest found, 0
    without any. Null and empty texts find nothing. Ids may be null or repeat; each row is scanned by itself. Other columns
    are not read; an empty table gives an empty result. The templates are few and go to the tasks with the code.
    """
    known = dict(known_templates() if templates is None else templates)

    def work():
        scanner = Scanner(known, coverage)

        def scanned(texts: list[str]) -> list[pa.Array]:
            made = [scanner.find(t) for t in texts]
            return [
                pa.array(map(len, made), pa.int64()), pa.array([",".join(sorted({f[0] for f in m})) for m in made], pa.string()),
                pa.array([max((f[3] for f in m), default=0.0) for m in made], pa.float64()), pa.array([",".join(f"{n}:{a}:{b}" for n, a, b, _ in m) for m in made], pa.string()),
            ]

        return scanned

    return map_texts(df, [id_col], text_col, "n_matches bigint, licenses string, coverage double, spans string", work)
