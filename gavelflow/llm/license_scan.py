"""License notices in texts, by patience alignment with templates.

Text and template are word sequences without case and punctuation. Inside a range, the words that
occur once in both are anchors; the longest run of anchors in the same order on both sides is kept,
and the gaps between kept anchors are aligned in the same way. Where a range has no such word, equal
words at its two ends are matched and the first occurrence of each template word anchors instead.
Coverage is the share of template words aligned; from ``min_coverage`` on, the notice is reported
with the span from its first to its last aligned word. Coverage alone would let the one word be wrong
that names the license, so inside that span also the distinguishing word runs of the template (name,
variant, version) must stand unbroken.

Where to look: more than 1 - ``min_coverage`` of a template's words are marked, the longest first, so
that a notice of enough coverage holds at least one of them. Around every marked word of a text, the
range that a whole notice could take is aligned; ranges that touch are one. A range is read from left
to right, two template lengths at a time: behind a notice the search goes on, without one it moves by
half a template. Of overlapping notices the one with most words aligned stays, then the one with the
best coverage.

Defined cases: a missing text is empty and has no notice; repeated rows give repeated results; of
equal notices the leftmost stays; an empty table gives none; a very long text is searched whole, alignment
only runs around marked words; columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from gavelflow.llm.common import DOC_KEY, doc_key, whole
from gavelflow.llm.license_texts import DISTINGUISHING, TEMPLATES

MIN_COVERAGE = 0.8
_WORD = re.compile(r"\w+(?:[.\-']\w+)*")


def word_list(text: str) -> list[tuple[str, int, int]]:
    return [(m.group().lower(), m.start(), m.end()) for m in _WORD.finditer(text)]


def increasing(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence."""
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tails, v)
        before.append(at[k - 1] if k else -1)
        if k == len(tails):
            tails.append(v)
            at.append(i)
        else:
            tails[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Pairs (place in text, place in template), both ascending."""
    pairs: list[tuple[int, int]] = []
    ranges = [(0, len(text), 0, len(template))]
    while ranges:
        a, b, c, d = ranges.pop()
        while a < b and c < d and text[a] == template[c]:
            pairs.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            pairs.append((b - 1, d - 1))
            b, d = b - 1, d - 1
        if a >= b or c >= d:
            continue
        once: dict[str, int] = {}
        for j in range(c, d):
            once[template[j]] = -1 if template[j] in once else j
        first: dict[str, int] = {}
        again = set()
        for i in range(a, b):
            if text[i] in first:
                again.add(text[i])
            else:
                first[text[i]] = i
        shared = [(first[w], j) for w, j in once.items() if j >= 0 and w in first]
        anchors = sorted(x for x in shared if text[x[0]] not in again) or sorted(shared)
        kept = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not kept:
            continue
        i0, j0 = a, c
        for i, j in [*kept, (b, d)]:
            ranges.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
        pairs += kept
    return sorted(pairs)


class Template:
    def __init__(self, name: str, text: str, min_coverage: float, tells: list[str] = ()) -> None:
        self.tells = [[f" {w} " for w in t.split("|")] for t in tells]
        self.name, self.words = name, [w for w, _, _ in word_list(text)]
        self.need = math.ceil(min_coverage * len(self.words) - 1e-9)
        spare, marked = len(self.words) - self.need, set()
        for w in sorted(set(self.words), key=lambda w: (-len(w), w)):
            if sum(x in marked for x in self.words) > spare:
                break
            marked.add(w)
        self.marked = marked

    def told(self, words: list[str]) -> bool:
        inside = f" {' '.join(words)} "
        return all(any(w in inside for w in t) for t in self.tells)

    def notices(self, words: list[str], places: list[int]) -> list[tuple[float, int, int]]:
        """``(coverage, first word, last word)`` around the places of marked words."""
        n = len(self.words)
        ranges: list[list[int]] = []
        for p in places:
            a, b = max(0, p - n), min(len(words), p + n + 1)
            if ranges and a <= ranges[-1][1]:
                ranges[-1][1] = b
            else:
                ranges.append([a, b])
        out: list[tuple[float, int, int]] = []
        for a, b in ranges:
            while b - a >= self.need:
                low, pairs = a, align(words[a:min(b, a + 2 * n + 1)], self.words)
                if len(pairs) < self.need:
                    a += max(1, n // 2)
                    continue
                while len(before := align(words[low:low + pairs[0][0]], self.words)) >= self.need:
                    pairs = before  # the leftmost first
                if pairs[-1][0] - pairs[0][0] > n + n // 2:  # the end may belong to a second notice
                    nearer = align(words[low + pairs[0][0]:low + pairs[0][0] + n + 1], self.words)
                    if len(nearer) >= self.need:
                        low, pairs = low + pairs[0][0], nearer
                if not self.told(words[low + pairs[0][0]:low + pairs[-1][0] + 1]):
                    a = low + pairs[0][0] + 1
                    continue
                out.append((len(pairs) / n, low + pairs[0][0], low + pairs[-1][0]))
                a = out[-1][2] + 1
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES, min_coverage: float = MIN_COVERAGE) -> None:
        self.templates = [Template(n, t, min_coverage, DISTINGUISHING.get(n, []) if t == TEMPLATES.get(n) else []) for n, t in templates.items()]
        self.marked = {w for t in self.templates for w in t.marked}

    def notices(self, text: str) -> list[tuple[str, int, int, float]]:
        """License, start, end (code points) and coverage of every notice."""
        low = text.lower()
        present = {w for w in self.marked if w in low}
        if not present:
            return []
        spans = word_list(text)
        words = [w for w, _, _ in spans]
        where: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w in present:
                where.setdefault(w, []).append(i)
        found: list[tuple[float, float, int, int, str]] = []
        for t in self.templates:
            places = sorted(p for w in t.marked for p in where.get(w, ()))
            if places:
                found += [(-c * len(t.words), -c, a, b, t.name) for c, a, b in t.notices(words, places)]
        taken: list[tuple[int, int, str, float]] = []
        for _, c, a, b, name in sorted(found):
            k = bisect_left(taken, (a,))
            if (k == 0 or taken[k - 1][1] < a) and (k == len(taken) or taken[k][0] > b):
                taken.insert(k, (a, b, name, -c))
        return [(name, spans[a][1], spans[b][2], c) for a, b, name, c in taken]


def _scan(templates: dict[str, str], min_coverage: float):
    def run(frames):
        import pandas as pd

        scanner = Scanner(templates, min_coverage)
        for pdf in frames:
            rows = [(name, key, *hit) for name, key, text in pdf.itertuples(index=False) for hit in scanner.notices(text)]
            yield pd.DataFrame(rows, columns=[*DOC_KEY, "license", "start", "end", "coverage"], dtype="object")

    return run


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Key, ``license``, ``start``, ``end`` and ``coverage`` of every notice in every row."""
    rows = docs.select(*doc_key(), whole().alias("_text"))
    kind = f"{DOC_KEY[0]} {docs.schema['doc_id'].dataType.simpleString()}, {DOC_KEY[1]} long, license string, start long, end long, coverage double"
    return rows.mapInPandas(_scan(TEMPLATES if templates is None else templates, min_coverage), kind)
