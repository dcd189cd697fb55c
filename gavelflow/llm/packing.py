"""Packing of token ids into windows of fixed length, with little padding.

Every partition keeps ``open_windows`` windows open. The rest of a document (what is left after its
full windows) goes into the open window where it leaves the least room. When it fits none, the
fullest is closed: its gap is first filled with the head of the rest, unless the gap is under
``min_piece`` ids, which is left as padding. Windows still open at the end of a partition are merged
with those of other partitions, 64 partitions at a time, and so on upwards; the last few are filled
one after the other. So a task holds 64 times ``open_windows`` windows at most, whatever the corpus.

Pieces carry their ids as little-endian unsigned 32-bit bytes. A sequence number holds the level of
merging, the task and a counter; numbers are unique, not gapless. ``sequences`` puts windows together
and pads them to the window length, except where their length is a power of two.

Defined cases: a missing text is empty and gives the end id alone; a document longer than a window
is cut; repeated rows are packed each; an empty table gives no pieces; columns other than id and
text are not read.
"""

from __future__ import annotations

from bisect import bisect_right, insort

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import stored, whole
from gavelflow.llm.ids import batches, encoder

WINDOW = 2048
END_ID = 1
FAN_IN = 64
PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, leftover boolean"


class OpenWindows:
    """Bounded-space best fit. ``closed`` gets ``(window number, pieces)`` as windows close; a piece
    is ``(document, start, ids, offset)`` with ids as bytes."""

    def __init__(self, size: int, window: int = WINDOW, min_piece: int = 16) -> None:
        self.size, self.window, self.min_piece = size, window, min_piece
        self.order: list[tuple[int, int]] = []  # (used, number), sorted
        self.held: dict[int, list] = {}
        self.used: dict[int, int] = {}
        self.numbers = 0
        self.closed: list[tuple[int, list]] = []

    def _number(self) -> int:
        self.numbers += 1
        return self.numbers - 1

    def _put(self, number: int, document, start: int, ids: bytes) -> None:
        used = self.used[number]
        self.held[number].append((document, start, ids, used))
        self.used[number] = used + len(ids) // 4
        insort(self.order, (self.used[number], number))

    def _close(self, number: int) -> None:
        self.closed.append((number, self.held.pop(number)))
        del self.used[number]

    def add(self, document, start: int, ids: bytes) -> None:
        full = self.window * 4
        while len(ids) >= full:
            self.closed.append((self._number(), [(document, start, ids[:full], 0)]))
            ids, start = ids[full:], start + self.window
        while ids:
            n = len(ids) // 4
            at = bisect_right(self.order, (self.window - n, float("inf"))) - 1
            if at >= 0:  # the fullest of those with room
                self._put(self.order.pop(at)[1], document, start, ids)
                return
            if len(self.order) < self.size:
                number = self._number()
                self.held[number], self.used[number] = [], 0
                self._put(number, document, start, ids)
                return
            used, number = self.order.pop()
            gap = self.window - used
            if gap >= self.min_piece:
                self._put(number, document, start, ids[:4 * gap])
                self.order.remove((self.window, number))
                ids, start = ids[4 * gap:], start + gap
            self._close(number)

    def leftovers(self):
        """What is still open, fullest first."""
        return [(number, self.held[number]) for _, number in reversed(self.order)]


def _frame(windows, base: int, leftover: bool, names):
    import pandas as pd

    rows = [(*doc[0], start, len(ids) // 4, ids, doc[1], base + number, offset, leftover)
            for number, pieces in windows for doc, start, ids, offset in pieces]
    return pd.DataFrame(rows, columns=names, dtype="object")


def _packer(path: str, open_windows: int, end_id: int, window: int, min_piece: int, names):
    def run(frames):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 32
        end = end_id.to_bytes(4, "little")
        state, encode = OpenWindows(open_windows, window, min_piece), encoder(path).encode
        for pdf in frames:
            texts, ids = pdf["_text"].tolist(), pdf["doc_id"].tolist()
            for a, b in batches(texts):
                for doc, made in zip(ids[a:b], encode(texts[a:b]), strict=True):
                    made += end
                    state.add(((doc,), len(made) // 4), 0, made)
                yield _frame(state.closed, base, False, names)
                state.closed = []
        yield _frame(state.leftovers(), base, True, names)

    return run


def _merger(level: int, last: bool, open_windows: int, window: int, min_piece: int, names):
    def run(key, pdf):
        import pandas as pd

        base = (level << 56) | (int(key[0]) << 32)
        pdf = pdf.sort_values(["length", "sequence_id", "offset"], ascending=[False, True, True])
        state = OpenWindows(open_windows, window, min_piece)
        for doc, start, ids, n in zip(pdf["doc_id"].tolist(), pdf["start"].tolist(), pdf["ids"].tolist(), pdf["doc_tokens"].tolist(), strict=True):
            state.add(((doc,), n), start, ids)
        out = [_frame(state.closed, base, False, names)]
        if last:  # fill one window after the other
            rest, state.order, state.size, state.closed = state.leftovers(), [], 1, []
            state.held, state.used = {}, {}
            for _, pieces in rest:
                for doc, start, ids, _ in pieces:
                    state.add(doc, start, ids)
            out += [_frame(state.closed, base, False, names), _frame(state.leftovers(), base, False, names)]
        else:
            out.append(_frame(state.leftovers(), base, True, names))
        return pd.concat(out)

    return run


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, open_windows: int = 16, min_piece: int = 16, end_id: int = END_ID) -> DataFrame:
    """Pieces: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``."""
    rows = docs.select("doc_id", whole().alias("_text"))
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {PIECE}"
    names = [c.split()[0] for c in kind.split(", ")]
    first = stored(rows.mapInPandas(_packer(tokenizer, open_windows, end_id, window, min_piece, names), kind), "pieces")
    done, left, level = [first.where(~F.col("leftover"))], first.where("leftover"), 0
    task = F.shiftrightunsigned("sequence_id", 32).bitwiseAND(F.lit((1 << 24) - 1))
    tasks = (left.agg(F.max(task)).first()[0] or 0) + 1
    while True:
        level, tasks = level + 1, -(-tasks // FAN_IN)
        merge = _merger(level, tasks == 1, open_windows, window, min_piece, names)
        made = stored(left.groupBy(F.floor(task / FAN_IN).alias("_to")).applyInPandas(merge, kind), "pieces")
        done.append(made.where(~F.col("leftover")))
        if tasks == 1:
            break
        left = made.where("leftover")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("leftover")


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """One row per window: ``sequence_id, ids, n_tokens, doc_ids, lengths``; ids are padded to the
    window length, except where ``n_tokens`` is a power of two."""
    part = F.struct("offset", "length", "doc_id", "ids")
    rows = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    joined = F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["ids"])), ""))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(window) - F.col("n_tokens")).cast("int")))
    rows = rows.withColumn("n_tokens", n)
    exact = F.bit_count("n_tokens") == 1
    return rows.select(
        "sequence_id", F.when(exact, joined).otherwise(F.concat(joined, pad)).alias("ids"), "n_tokens",
        F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"), F.transform("p", lambda x: x["length"]).alias("lengths"))
