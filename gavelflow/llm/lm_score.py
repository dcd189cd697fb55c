"""Log probability of texts by a log-bilinear model, trained by noise-contrastive estimation.

Words are counted over all training texts. The ``WORDS`` commonest are symbols of the model, each with
a vector; the other ``HEAD`` common ones share a symbol per octave of their count, all the rest share
one, and the end of a text is one. The model predicts a symbol from the two before it: their vectors,
weighted by position, give the predicted vector, whose product with a symbol's vector, plus its bias, is the
symbol's score. A word is its symbol's probability times the word's share of that symbol, so the
probabilities of all known words, and of one unknown word, sum to one after any context.

Training: runs of three symbols are counted over all training texts, which keeps every text and
grows with them, and the tasks that hold the counts each train a copy of the model in numpy, on
noise shared by a batch; after each round the copies are averaged by weight. Scoring: one matrix
product for the unseen contexts of a batch gives their normalisers, which a worker keeps in a table of
contexts; scores are then exact log probabilities. Words outside the head meet their counts in a
join, since no worker can hold them all.

Bounds: a worker holds the head (``HEAD`` words of at most ``LONGEST`` bytes), the model and a
normaliser for each pair of symbols; the driver holds the head and the model. Texts of any length are
read in pieces. Sums of doubles may differ in their last digits between runs; training is seeded by
partition, so scores depend a little on how the counts are dealt out.

Defined cases: a text without words (a missing one too) is the end alone; a document without an id
has the empty text as its id and so is held out; repeated rows are scored and counted each;
without training texts every count is zero and the end has probability one half or more; an empty table gives
an empty result; columns other than id and text are not read.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import stored, whole

HEAD = 1 << 16
LONGEST = 64
WORDS = 1000
SIZE = 32
NOISE = 256
ROUNDS = 3
SMOOTH = 0.1

PIECE = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0d]")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10 == 0


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, A-Z lower-cased, in lists of bounded length (one word at least)."""
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            gap = _SPACE.search(text, end)
            end = gap.start() if gap else len(text)
        yield text[at:end].lower().split()
        at = end


def _texts(batch):
    for text in batch.column("text"):
        yield memoryview(text.as_buffer()).tobytes()


# --- counts ----------------------------------------------------------------------------------------
def _counted(batches: Iterator):
    import pyarrow as pa

    found: Counter = Counter()

    def out():
        return pa.RecordBatch.from_arrays(
            [pa.array(found.keys(), pa.binary()), pa.array(found.values(), pa.int64())], ["word", "n"])

    for batch in batches:
        for text in _texts(batch):
            for words in pieces(text):
                found.update(words)
            found[b""] += 1  # the end
            if len(found) >= 150_000:
                yield out()
                found.clear()
    if found:
        yield out()


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, c`` over ``texts(text)``; the empty word is the end of a text."""
    return texts.select("text").mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("c"))


@dataclass
class Vocabulary:
    """The head: words by falling count, and the symbol of each. ``tokens`` and ``types`` are those
    of all training texts, the end included."""

    words: list
    counts: list
    ends: int
    tokens: int
    types: int
    own: int

    def __post_init__(self) -> None:
        import numpy as np

        n = np.array(self.counts, dtype=np.int64)
        place = np.arange(len(n))
        octave = np.floor(np.log2(np.maximum(n, 1))).astype(np.int64)
        shared = sorted(set(octave[self.own:].tolist()))
        first = min(self.own, len(n))
        self.symbol = np.where(place < self.own, place, first + np.searchsorted(shared, octave)).astype(np.int64)
        self.rest = first + len(shared)
        self.end, self.start = self.rest + 1, self.rest + 2
        self.symbols = self.rest + 2
        of = np.bincount(self.symbol, weights=n, minlength=self.symbols)
        self.share = np.log10(n) - np.log10(of[self.symbol]) if len(n) else np.zeros(0)
        self.rest_tokens = self.tokens - self.ends - int(n.sum())
        self.rest_types = self.types - (self.ends > 0) - len(n)
        of[self.rest], of[self.end] = self.rest_tokens, self.ends
        self.noise = (of + 1.0) / (of + 1.0).sum()
        self.below = np.log10(self.tokens + SMOOTH * (self.types + 1))
        self.base = np.log10(n + SMOOTH) - self.below
        self.rest_below = np.log10(self.rest_tokens + SMOOTH * (self.rest_types + 1))
        self.index = None

    def numbers(self) -> dict:
        if self.index is None:
            self.index = {w: i for i, w in enumerate(self.words)}
        return self.index

    def read(self, text: bytes):
        """``(head number of every word, -1 outside the head; Counter of the words outside)``."""
        import numpy as np

        get, parts, rest = self.numbers().get, [], Counter()
        for words in pieces(text):
            got = np.fromiter(map(get, words, repeat(-1)), dtype=np.int64, count=len(words))
            rest.update([words[i] for i in np.nonzero(got < 0)[0].tolist()])
            parts.append(got)
        return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64), rest

    def codes(self, numbers):
        """One number for each symbol with the two before it, the end last."""
        import numpy as np

        s = np.empty(len(numbers) + 3, dtype=np.int64)
        s[:2], s[-1] = self.start, self.end
        s[2:-1] = np.where(numbers < 0, self.rest, self.symbol[numbers] if len(self.symbol) else 0)
        k = self.symbols + 1
        return (s[:-2] * k + s[1:-1]) * k + s[2:]


_HELD: dict = {}


class Shared:
    """A value broadcast to the workers; a process keeps it, with what it has worked out from it."""

    def __init__(self, sc, value) -> None:
        self.key, self.broadcast = uuid.uuid4().hex, sc.broadcast(value)

    def value(self):
        if self.key not in _HELD:
            _HELD.clear()
            _HELD[self.key] = self.broadcast.value
        return _HELD[self.key]


def vocabulary(counts: DataFrame, own: int = WORDS, head: int = HEAD) -> Vocabulary:
    total = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.length("word") == 0, F.col("c"))).alias("e")).first()
    top = counts.where((F.length("word") > 0) & (F.length("word") <= LONGEST)).orderBy(F.desc("c"), "word").limit(head).toArrow()
    return Vocabulary(top["word"].to_pylist(), top["c"].to_pylist(), total["e"] or 0, total["n"] or 0, total["v"], own)


def run_counts(texts: DataFrame, vocabulary: Shared) -> DataFrame:
    """``code, n``: how often each symbol follows each two before it."""

    def runs(batches: Iterator):
        import numpy as np
        import pyarrow as pa

        v, held, size = vocabulary.value(), [], 0

        def out():
            code, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(code, pa.int64()), pa.array(n, pa.int64())], ["code", "n"])

        for batch in batches:
            for text in _texts(batch):
                held.append(v.codes(v.read(text)[0]))
                size += len(held[-1])
                if size >= 1_500_000:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    return texts.select("text").mapInArrow(runs, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


# --- the model -------------------------------------------------------------------------------------
class Model:
    """``context`` and ``target`` vectors, a bias per symbol, a weight vector per position; all in one
    flat array, so that copies can be averaged."""

    BATCH = 1024
    HEAVIEST = 32
    RATE = 0.1

    def __init__(self, vocabulary: Vocabulary, size: int, flat=None, rate: float = RATE) -> None:
        import numpy as np

        k = vocabulary.symbols
        self.k, self.size, self.rate = k, size, rate
        cuts = np.cumsum([(k + 1) * size, k * size, k, 2 * size])
        if flat is None:
            rng = np.random.default_rng(11)
            flat = np.concatenate([
                rng.normal(0, 0.1, int(cuts[1])), np.log(vocabulary.noise), np.ones(size), np.full(size, 0.5)])
        self.flat = flat.astype(np.float32)
        a, b, c, _ = cuts.tolist()
        self.context, self.target = self.flat[:a].reshape(k + 1, size), self.flat[a:b].reshape(k, size)
        self.bias, self.position = self.flat[b:c], self.flat[c:].reshape(2, size)
        self.norm = None

    def parts(self, code):
        return code // (self.k + 1) ** 2, code // (self.k + 1) % (self.k + 1), code % (self.k + 1)

    def predicted(self, far, near):
        return self.context[near] * self.position[0] + self.context[far] * self.position[1]

    def train(self, batches: Iterator, noise, rng, samples: int) -> float:
        """One pass over ``(codes, counts)``; the weight of what was seen. A heavy row is met in
        several batches."""
        import numpy as np

        rates = [np.full_like(x, 1.0) for x in (self.context, self.target, self.bias, self.position)]
        level = np.log(samples * noise).astype(np.float32)
        cum = np.cumsum(noise)
        seen = 0.0
        for code, n in batches:
            times = -(-n // self.HEAVIEST)
            row = rng.permutation(np.repeat(np.arange(len(n)), times))
            share = (n / times).astype(np.float32)
            for at in range(0, len(row), self.BATCH):
                pick = row[at:at + self.BATCH]
                drawn = np.minimum(np.searchsorted(cum, rng.random(samples)), self.k - 1)
                self._step(*self.parts(code[pick]), share[pick], drawn, level, rates)
            seen += float(n.sum())
        return seen

    def _step(self, far, near, symbol, weight, drawn, level, rates) -> None:
        import numpy as np

        weight = weight[:, None] / weight.mean()
        u, w = self.context[near], self.context[far]
        q = u * self.position[0] + w * self.position[1]
        t, noise = self.target[symbol], self.target[drawn]
        true = (q * t).sum(1) + self.bias[symbol] - level[symbol]
        false = q @ noise.T + self.bias[drawn] - level[drawn]
        up = weight / (1.0 + np.exp(np.minimum(true, 60.0)))[:, None]
        down = -weight / (1.0 + np.exp(np.minimum(-false, 60.0)))
        into_q = up * t + down @ noise
        self._add(self.target, rates[1], np.concatenate([symbol, drawn]), np.concatenate([up * q, down.T @ q]))
        self._add(self.bias, rates[2], np.concatenate([symbol, drawn]), np.concatenate([up[:, 0], down.sum(0)]))
        step = np.stack([(into_q * u).sum(0), (into_q * w).sum(0)])
        self._add(self.context, rates[0], np.concatenate([near, far]), np.concatenate([into_q * self.position[0], into_q * self.position[1]]))
        self._add(self.position, rates[3], np.arange(2), step)

    def _add(self, table, rate, rows, step) -> None:
        import numpy as np

        order = np.argsort(rows, kind="stable")
        rows = rows[order]
        first = np.nonzero(np.r_[True, rows[1:] != rows[:-1]])[0]
        step = np.add.reduceat(step[order], first, axis=0)
        rows = rows[first]
        rate[rows] += step * step
        table[rows] += self.rate * step / np.sqrt(rate[rows])

    def log10(self, code):
        """Log probability of each symbol after its context, normalised over all symbols."""
        import numpy as np

        if self.norm is None:
            self.norm = np.full((self.k + 1) ** 2, np.nan, dtype=np.float64)
        code, back = np.unique(code, return_inverse=True)
        far, near, symbol = self.parts(code)
        pair = far * (self.k + 1) + near
        fresh = np.unique(pair[np.isnan(self.norm[pair])])
        for at in range(0, len(fresh), 1024):
            some = fresh[at:at + 1024]
            scores = self.predicted(some // (self.k + 1), some % (self.k + 1)) @ self.target.T + self.bias
            top = scores.max(1)
            self.norm[some] = top + np.log(np.exp(scores - top[:, None]).sum(1, dtype=np.float64))
        own = (self.predicted(far, near) * self.target[symbol]).sum(1) + self.bias[symbol]
        return ((own - self.norm[pair]) / np.log(10.0))[back]


def train_model(runs: DataFrame, v: Vocabulary, vocabulary: Shared, size: int = SIZE, rounds: int = ROUNDS, samples: int = NOISE):
    """The parameters after ``rounds`` of training on the tasks that hold ``runs(code, n)``."""
    import numpy as np

    sc = runs.sparkSession.sparkContext
    flat = Model(v, size).flat
    for r in range(rounds):
        shared = sc.broadcast(flat)

        def trained(batches: Iterator, shared=shared, r=r):
            import pyarrow as pa
            from pyspark import TaskContext

            known = vocabulary.value()
            model = Model(known, size, shared.value.copy(), Model.RATE / (1 + r))
            rng = np.random.default_rng([r, TaskContext.get().partitionId()])
            each = ((b.column("code").to_numpy(), b.column("n").to_numpy()) for b in batches)
            weight = model.train(each, known.noise, rng, samples)
            if weight:
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(-1, len(model.flat)), pa.int32()),
                    pa.array(weight * np.r_[1.0, model.flat.astype(np.float64)], pa.float64())], ["slot", "total"])

        made = runs.mapInArrow(trained, "slot int, total double").groupBy("slot").agg(F.sum("total").alias("total")).toArrow()
        total = np.zeros(len(flat) + 1)
        total[made["slot"].to_numpy() + 1] = made["total"].to_numpy()
        shared.unpersist()
        if not total[0]:
            break
        flat = (total[1:] / total[0]).astype(np.float32)
    return flat


# --- scoring ----------------------------------------------------------------------------------------
def _head_scores(vocabulary: Shared, parameters, size: int, kind):
    def scored(batches: Iterator):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        v = vocabulary.value()
        if getattr(v, "model", None) is None:
            v.model = Model(v, size, parameters.value)
        row = TaskContext.get().partitionId() << 33
        docs: list = []
        tokens = 0

        def out():
            nonlocal row, docs, tokens
            codes = np.concatenate([v.codes(got) for _, _, got, _ in docs])
            length = np.array([len(got) + 1 for _, _, got, _ in docs], dtype=np.int64)
            first = np.cumsum(length) - length
            score = np.add.reduceat(v.model.log10(codes), first)
            base, known = np.empty(len(docs)), np.empty(len(docs), dtype=np.int64)
            for i, (_, _, got, _) in enumerate(docs):
                in_head = got[got >= 0]
                score[i] += v.share[in_head[in_head >= v.own]].sum()
                base[i] = v.base[in_head].sum() + np.log10(v.ends + SMOOTH) - v.below
                known[i] = len(in_head) + (v.ends > 0)
            cut = np.cumsum([0, *(len(rest) for *_, rest in docs)]).astype(np.int32)
            listed = lambda values, t: pa.ListArray.from_arrays(cut, pa.array(values, t))
            made = pa.RecordBatch.from_arrays([
                pa.array(np.arange(row, row + len(docs)), pa.int64()), pa.array([d for d, *_ in docs], kind),
                pa.array([h for _, h, *_ in docs], pa.bool_()), pa.array(length, pa.int64()), pa.array(known, pa.int64()),
                pa.array(base, pa.float64()), pa.array(score, pa.float64()),
                listed([w for *_, rest in docs for w in rest], pa.binary()),
                listed([n for *_, rest in docs for n in rest.values()], pa.int64())],
                ["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "words", "often"])
            row, docs, tokens = row + len(docs), [], 0
            return made

        for batch in batches:
            for name, held, text in zip(batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist(), _texts(batch), strict=True):
                got, rest = v.read(text)
                docs.append((name, held, got, rest))
                tokens += len(got) + 1
                if tokens >= 400_000:
                    yield out()
        if docs:
            yield out()

    return scored


def score_texts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", own: int = WORDS, head: int = HEAD, size: int = SIZE,
    rounds: int = ROUNDS, samples: int = NOISE,
) -> DataFrame:
    """``_gf_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row; the model
    learns from the rows that are not held out."""
    from pyspark.sql.pandas.types import to_arrow_type

    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), whole(text).alias("text"))
    training = rows.where(~F.col("held_out")).select("text")
    counts = stored(word_counts(training), "words")
    v = vocabulary(counts, own, head)
    shared = Shared(sc, v)
    runs = stored(run_counts(training, shared), "runs")
    parameters = sc.broadcast(train_model(runs, v, shared, size, rounds, samples))

    id_type = docs.schema[doc_id].dataType
    schema = (
        f"row long, doc_id {id_type.simpleString()}, held_out boolean, n_tokens long, known long, base double, score double, "
        "words array<binary>, often array<long>")
    scored = stored(rows.mapInArrow(_head_scores(shared, parameters, size, to_arrow_type(id_type)), schema), "scores")
    rest = scored.select(F.col("row").alias("_row"), F.inline(F.arrays_zip("words", "often")))
    seen = rest.join(counts.select(F.col("word").alias("_word"), "c"), F.col("words") == F.col("_word"), "left")
    per_row = seen.groupBy("_row").agg(
        F.sum("often").alias("_n"), F.sum(F.when(F.col("c").isNotNull(), F.col("often"))).alias("_known"),
        F.sum(F.col("often") * F.log10(F.coalesce("c", F.lit(0)) + F.lit(SMOOTH))).alias("_x"))
    n, x = F.coalesce("_n", F.lit(0)), F.coalesce("_x", F.lit(0.0))
    return scored.join(per_row, F.col("row") == F.col("_row"), "left").select(
        F.col("doc_id").alias("_gf_id"), "held_out", "n_tokens", (F.col("known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
        F.lit(v.tokens).cast("long").alias("train_tokens"), (F.col("base") + x - n * F.lit(float(v.below))).alias("base_score"),
        (F.col("score") + x - n * F.lit(float(v.rest_below))).alias("score"))
