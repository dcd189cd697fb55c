"""Benchmark passages in documents, found with a bounded number of edits.

An item of m characters may differ by k = floor(m * error_rate) edits. Cut into k+1 pieces, one of
them must stand in the document unchanged (pigeonhole). All pieces of all items are searched in one
pass (Aho-Corasick); around each hit, Myers' bit-parallel recurrence gives the edit distance of the
item to the best substring. Letters are compared without case, and every white-space character as
one space; that keeps the length, so offsets hold in the document as it is.

The items are a query set: they are read in blocks of bounded size, and every document is tested
against every block.

Defined cases: missing texts and items are empty; an item shorter than ``min_chars`` proves nothing
and is not searched; items that repeat an id are searched each, and the best counts; repeated
documents give repeated hits; empty tables give no hits; a very long text is searched whole; other columns
are not read.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import DOC_KEY, doc_key, packed_rows, same_doc, whole

ERROR_RATE = 0.05
MIN_CHARS = 16
BLOCK_CHARS = 4_000_000
HIT = "item_id long, start long, end long, distance long"

_SPACES = {ord(c): " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0   　"}


def normal(text: str) -> str:
    """Lower case and plain spaces, the same number of characters."""
    low = text.lower()
    if len(low) != len(text):
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_SPACES)


def best_match(pattern: str, text: str, most: int) -> tuple[int, int] | None:
    """``(distance, end)`` of the substring of ``text`` closest to ``pattern``, the leftmost end of
    the least distance, or None above ``most`` edits. Myers 1999, the bits in one Python integer."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = (m, 0) if m <= most else (most + 1, -1)
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return None if at < 0 else (best, at)


def _start(pattern: str, text: str, end: int, distance: int) -> int:
    """Latest start of a substring that ends at ``end`` and has this distance."""
    back = text[max(0, end - len(pattern) - distance):end][::-1]
    m, column = len(pattern), list(range(len(pattern) + 1))
    if column[m] == distance:
        return end
    turned = pattern[::-1]
    for j, c in enumerate(back, 1):  # plain recurrence: the substring must begin at ``end``
        left, column[0] = column[0], j
        for i in range(1, m + 1):
            left, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, left + (turned[i - 1] != c))
        if column[m] == distance:
            return end - j
    return max(0, end - len(back))


def pieces(pattern: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 pieces of nearly equal length with their offsets."""
    cuts = [round(i * len(pattern) / (errors + 1)) for i in range(errors + 2)]
    return [(a, pattern[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Matcher:
    """The pieces of a block of items, ready for search."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float) -> None:
        import ahocorasick

        self.items = [(i, t, math.floor(len(t) * error_rate)) for i, t in items]
        self.automaton = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for n, (_, t, k) in enumerate(self.items):
            for offset, piece in pieces(t, k):
                where.setdefault(piece, []).append((n, offset))
        for piece, uses in where.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if where:
            self.automaton.make_automaton()
        self._seen: dict[tuple[int, str], tuple[int, int] | None] = {}

    def _verified(self, n: int, window: str) -> tuple[int, int] | None:
        """Windows of common passages repeat, so their answers are kept, up to a bound."""
        key = (n, window)
        if key not in self._seen:
            if len(self._seen) >= 20_000:
                self._seen.clear()
            _, t, k = self.items[n]
            self._seen[key] = best_match(t, window, k)
        return self._seen[key]

    def hits(self, text: str) -> list[tuple[int | None, int, int, int]]:
        """Best match per item: id, start, end, distance."""
        if not self.items or not text:
            return []
        spots: dict[int, set[int]] = {}
        for last, (size, uses) in self.automaton.iter(text):
            for n, offset in uses:
                spots.setdefault(n, set()).add(last + 1 - size - offset)
        best: dict[int | None, tuple[int, int, int]] = {}
        for n, diagonals in spots.items():
            item, t, k = self.items[n]
            for low, high in _merged(sorted(diagonals), len(t)):
                a, b = max(0, low - k), min(len(text), high + len(t) + 2 * k)
                found = self._verified(n, text[a:b])
                if found and (found[0], a + found[1], n) < best.get(item, (k + 1,)):
                    best[item] = (found[0], a + found[1], n)
        return [(item, _start(self.items[n][1], text, end, d), end, d) for item, (d, end, n) in best.items()]


def _merged(diagonals: list[int], reach: int):
    """Ranges of diagonals close to each other, so that windows do not overlap much."""
    low = high = diagonals[0]
    for d in diagonals[1:]:
        if d - high > reach:
            yield low, high
            low = d
        high = d
    yield low, high


_MATCHERS: dict[str, Matcher] = {}


def _search(block, name: str, error_rate: float):
    """``block`` is the broadcast list of items; its automaton is built once per worker."""

    def run(frames):
        import pandas as pd

        if name not in _MATCHERS:
            _MATCHERS.clear()
            _MATCHERS[name] = Matcher(block.value, error_rate)
        matcher = _MATCHERS[name]
        for pdf in frames:
            rows = []
            for key_id, key_hash, text in pdf.itertuples(index=False):
                rows += [(key_id, key_hash, *hit) for hit in matcher.hits(normal(text))]
            yield pd.DataFrame(rows, columns=[*DOC_KEY, "item_id", "start", "end", "distance"], dtype="object")

    return run


def benchmark_hits(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_chars: int = MIN_CHARS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Key of the document, ``item_id``, ``start``, ``end``, ``distance``: the best match of every
    item in every document, within the item's budget of edits."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id"), whole().alias("text")).where(F.length("text") >= min_chars)
    total = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_chars))
    of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    rows = docs.select(*doc_key(), whole().alias("_text"))
    kind = f"{DOC_KEY[0]} {docs.schema['doc_id'].dataType.simpleString()}, {DOC_KEY[1]} long, {HIT}"
    out = None
    for b in range(blocks):
        held = [(r.item_id, normal(r.text)) for r in items.where(of == b).orderBy("item_id", "text").toLocalIterator()]
        block = spark.sparkContext.broadcast(held)  # about block_chars characters
        found = rows.mapInPandas(_search(block, uuid.uuid4().hex, error_rate), kind)
        out = found if out is None else out.unionByName(found)
    if blocks > 1:  # an id may stand in several blocks
        best = F.min(F.struct("distance", "end", "start")).alias("_b")
        out = out.groupBy(*DOC_KEY, "item_id").agg(best).select(
            *DOC_KEY, "item_id", "_b.start", "_b.end", "_b.distance")
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item."""
    hit = benchmark_hits(docs, benchmark, **options).select(*DOC_KEY).distinct()
    rows = packed_rows(docs)
    return rows.join(hit, same_doc(rows, hit), "left_anti").select("_gf_row.*")
