"""Word runs that already stand earlier in the corpus, cut from every later place.

A window is ``WINDOW`` consecutive words of one document. Every word inside a window whose word
sequence also starts earlier (smaller id, or the same document further left) is removed; the first
place keeps it. Windows are judged on the input.

The corpus is its own reference, as in relative Lempel-Ziv parsing, and the index of its phrases is
dealt out in blocks by hash. To keep that index small, a phrase is indexed only if it can have a
second place at all: every window has an anchor, the least hash among its ``ANCHOR``-word grams
(winnowing), and equal windows have equal anchors, so an anchor that stands once in the corpus
settles all its windows. The windows of the other anchors go to the blocks; a block gives the first
place of each phrase. A document is then parsed from left to right: a factor begins at the first
window that is found earlier and goes on as long as the next window is found too; since windows
overlap word by word, those across the border of two copied passages are looked up like any other.
Factors are thus at least ``WINDOW`` words long and may join passages copied from different places.

Parsing every document against every block, as the plain method does, costs documents times blocks,
which no cluster finishes; the lookup by hash meets the same phrases in every block in one shuffle.

A document whose whole text stands under an earlier id is a copy: all its windows are found there, so
it is cut whole and its phrases stay out of the index.

A phrase is named by 96 bits of hash. Defined cases: a missing text has no words; rows that repeat
id and text are one document; among different texts of one id, the smaller text hash is the earlier;
a missing id is before all others; an empty table gives an empty result; a text counts whole, up to 2^28
words; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import DOC_KEY, doc_key, whole

WINDOW = 20
ANCHOR = 6
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(base: int, n: int):
    import numpy as np

    with np.errstate(over="ignore"):
        return np.cumprod(np.r_[np.uint64(1), np.full(n, base, dtype=np.uint64)], dtype=np.uint64)


class Phrases:
    """Hashes of word runs. Powers are kept for the longest document so far."""

    def __init__(self) -> None:
        self._size = 0
        self._tables: list = []

    def _table(self, n: int):
        if n > self._size:
            self._size = 2 * n
            self._tables = [(_powers(b, self._size), _powers(pow(b, -1, 1 << 64), self._size)) for b in _BASES]
        return self._tables

    def runs(self, words, length: int, which: int):
        """Polynomial hash of every run of ``length`` words, mod 2^64."""
        import numpy as np

        n = len(words)
        up, down = self._table(n + length)[which]
        total = np.r_[np.uint64(0), np.cumsum(words * down[:n], dtype=np.uint64)]
        h = (total[length:] - total[:-length]) * up[length - 1:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))


def split(text: str) -> list[bytes]:
    return text.encode().split()  # on bytes: ASCII white space only


def word_hashes(words: list[bytes]):
    import numpy as np
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def anchors(phrases: Phrases, hashes):
    """Hashes of all anchor grams and, per window, where its anchor begins."""
    import numpy as np

    grams = phrases.runs(hashes, ANCHOR, 0)
    span = WINDOW - ANCHOR + 1
    views = np.lib.stride_tricks.sliding_window_view(grams, span)
    return grams, views.argmin(axis=1) + np.arange(len(views))


def _anchor_rows(frames):
    import numpy as np
    import pandas as pd

    phrases = Phrases()
    for pdf in frames:
        ids, ats, found = [], [], []
        for name, tag, text in zip(pdf["_gf_id"].tolist(), pdf["_tag"].tolist(), pdf["_text"].tolist(), strict=True):
            words = split(text)
            if len(words) < WINDOW:
                continue
            grams, of = anchors(phrases, word_hashes(words))
            places = np.unique(of)
            found.append(grams[places].view(np.int64))
            ats.append(places + tag)
            ids += [name] * len(places)
        if found:
            yield pd.DataFrame({"a": np.concatenate(found), "_gf_id": pd.array(ids, dtype="Int64"), "at": np.concatenate(ats)})


def _open_windows(phrases: Phrases, words, settled):
    """Starts of the windows whose anchor has another place, and the word hashes."""
    import numpy as np

    hashes = word_hashes(words)
    _, of = anchors(phrases, hashes)
    return np.nonzero(~np.isin(of, settled))[0], hashes


def _places(values):
    import numpy as np

    return np.zeros(0, dtype=np.int64) if values is None else np.asarray(values, dtype=np.int64) & ((1 << 28) - 1)


def _window_rows(frames):
    import numpy as np
    import pandas as pd

    phrases = Phrases()
    for pdf in frames:
        ids, ats, one, two = [], [], [], []
        for name, tag, text, settled in zip(pdf["_gf_id"].tolist(), pdf["_tag"].tolist(), pdf["_text"].tolist(), pdf["_settled"].tolist(), strict=True):
            words = split(text)
            if len(words) < WINDOW:
                continue
            starts, hashes = _open_windows(phrases, words, _places(settled))
            if len(starts):
                one.append(phrases.runs(hashes, WINDOW, 0)[starts].view(np.int64))
                two.append((phrases.runs(hashes, WINDOW, 1)[starts] >> np.uint64(33)).astype(np.int32))
                ats.append(starts + tag)
                ids += [name] * len(starts)
        if one:
            yield pd.DataFrame({"h1": np.concatenate(one), "h2": np.concatenate(two), "_gf_id": pd.array(ids, dtype="Int64"), "at": np.concatenate(ats)})


def parse(n_words: int, found):
    """Factors ``(start, length)`` from the sorted starts of windows that are found earlier."""
    import numpy as np

    found = np.asarray(found, dtype=np.int64)
    if not len(found):
        return []
    # a factor ends where the next found window would leave a word between them
    last = np.nonzero(np.r_[np.diff(found) > WINDOW, True])[0]
    first = np.r_[0, last[:-1] + 1]
    return [(int(found[a]), int(found[b] + WINDOW - found[a])) for a, b in zip(first, last, strict=True)]


def _cut(frames):
    import numpy as np
    import pandas as pd

    phrases = Phrases()
    for pdf in frames:
        rows = []
        for name, key, text, first, settled, original in zip(
                pdf["_gf_id"].tolist(), pdf["_gf_hash"].tolist(), pdf["_text"].tolist(), pdf["_first"].tolist(), pdf["_settled"].tolist(), pdf["_original"].tolist(), strict=True):
            words, factors = split(text), []
            if len(words) >= WINDOW and first is not True:
                factors = [(0, len(words))]
            elif len(words) >= WINDOW:
                starts, _ = _open_windows(phrases, words, _places(settled))
                factors = parse(len(words), starts[~np.isin(starts, _places(original))])
            keep = np.ones(len(words), dtype=bool)
            for a, n in factors:
                keep[a:a + n] = False
            kept = b" ".join(w for w, k in zip(words, keep.tolist(), strict=True) if k).decode()
            rows.append((name, key, len(words), int(len(words) - keep.sum()), kept, [{"start": a, "length": n} for a, n in factors]))
        yield pd.DataFrame(rows, columns=["_gf_id", "_gf_hash", "n_words", "n_removed", "kept", "factors"], dtype="object")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per row: key, ``n_words``, ``n_removed``, ``kept`` text and ``factors`` (start and length in
    words)."""
    # 35 bits of text hash over 28 bits of position: places of one id in order, in one number; where no
    # id repeats, the hash says nothing and only makes the shuffles larger
    unique = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    tag = F.shiftleft(F.col("_gf_hash").bitwiseAND(F.lit(0 if unique else (1 << 35) - 1)), 28)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole().alias("text"))
    rows = rows.select(*doc_key(), F.col("text").alias("_text")).withColumn("_tag", tag)

    def by_document(places: DataFrame, name: str) -> DataFrame:
        owner = F.shiftright("at", 28).alias("_owner")
        return places.groupBy(F.col("_gf_id").alias("_of"), owner).agg(F.collect_list("at").alias(name))

    def with_places(left: DataFrame, places: DataFrame, name: str) -> DataFrame:
        own = by_document(places, name)
        on = left["_gf_id"].eqNullSafe(own["_of"]) & (F.shiftright(left["_tag"], 28) == own["_owner"])
        return left.join(own, on, "left").drop("_of", "_owner")

    # the first of all rows with one text; as a list of firsts, so that no text is a join key
    texts = rows.groupBy("_gf_hash", F.hash("_text").alias("_h2"), F.length("_text").alias("_n")).agg(
        F.min(F.struct("_gf_id", "_tag")).alias("f")).select("f.*")
    firsts = texts.select(F.col("_gf_id").alias("_of"), F.shiftright("_tag", 28).alias("_owner"), F.lit(True).alias("_first"))
    on = rows["_gf_id"].eqNullSafe(firsts["_of"]) & (F.shiftright(rows["_tag"], 28) == firsts["_owner"])
    rows = rows.join(firsts, on, "left").drop("_of", "_owner")

    grams = rows.where("_first").mapInPandas(_anchor_rows, "a long, _gf_id long, at long")
    alone = grams.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("_gf_id").alias("_gf_id"), F.min("at").alias("at"))
    known = with_places(rows, alone.where("n = 1"), "_settled")
    # all columns, so that this and the last step read one exchange of the texts
    windows = known.where("_first").mapInPandas(_window_rows, "h1 long, h2 int, _gf_id long, at long")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("_gf_id", "at")).alias("f")).select("f.*")
    judged = with_places(known, first, "_original")
    kind = f"{DOC_KEY[0]} long, {DOC_KEY[1]} long, n_words long, n_removed long, kept string, factors array<struct<start:long,length:long>>"
    return judged.select("_gf_id", "_gf_hash", "_text", "_first", "_settled", "_original").mapInPandas(_cut, kind)
