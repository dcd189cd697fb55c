"""Ranked search of a corpus for a set of texts, by pipelined term partitioning.

Documents and items are both dealt into blocks, and a block is turned round: a row for each term of the
block, with the places it stands at and how often. Terms are owned by a few stages, rare ones first, by
their share of all postings. A bundle is an item of one item block in one document block, with a
sparse accumulator (document places and scores so far). Bundles visit the owners in turn: in each
stage they meet the owner's postings of their document block in a cogroup, every term adds its whole
number to the documents that hold it, and the bundle goes on. Since frequent terms come last,
bundles stay sparse until the stage that fills them, which picks the best documents of its block
before anything is shuffled; the best of the blocks are then ranked per item.

Bounds: a block holds ``BLOCK_DOCS`` documents or ``BLOCK_CHARS`` bytes (one document at least), an item
block ``BLOCK_ITEMS`` items; a group of the cogroup is one pair of blocks, so a term or an item that meets a
third of the corpus is spread over all document blocks. Terms that no item holds never leave their
first task's join; whether the items' terms are broadcast or the postings shuffled for that join is
left to Spark's own size limit. A text of any length is read in pieces.

Defined cases: a missing text, an empty one or one without terms counts neither as a document nor
as a hit; repeated rows of documents are documents of their own; documents without an id come after
equal scores with one; items that repeat id and text are one item, items that share only the id are
ranked apart; an empty table of either kind gives an empty result; columns other than id and text are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gavelflow.llm.common import stored, whole

HITS = 50
OWNERS = 4
BLOCK_DOCS = 2048
BLOCK_ITEMS = 256
BLOCK_CHARS = 8_000_000
PIECE = 1 << 20

#: ASCII other than letters and digits parts terms; A-Z become a-z; all else stays.
_FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).lower()


def term_counts(text: bytes) -> Counter:
    """How often each term stands in a text of UTF-8 bytes."""
    found: Counter = Counter()
    if len(text) <= PIECE:
        found.update(text.translate(_FOLDED).split())
        return found
    at = 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):  # a piece ends where a term does
            gap = re.compile(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]").search(text, end)
            end = gap.start() if gap else len(text)
        found.update(text[at:end].translate(_FOLDED).split())
        at = end
    return found


def _turned(block: int, ids: list, kind, counts: list[Counter]):
    """The rows of one block: its members with their lengths, then one row for each term."""
    import numpy as np
    import pyarrow as pa

    sizes = np.array([c.total() for c in counts], dtype="<i8")
    terms = pa.array([t for c in counts for t in c], pa.binary()).dictionary_encode()
    code = terms.indices.to_numpy()
    place = np.repeat(np.arange(len(counts), dtype="<u4"), [len(c) for c in counts])
    often = np.fromiter((v for c in counts for v in c.values()), dtype="<i8", count=len(code))
    order = np.argsort(code, kind="stable")
    cuts = np.searchsorted(code[order], np.arange(len(terms.dictionary) + 1))
    cut = lambda x, width: pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [
        None, pa.py_buffer((cuts * width).astype("<i4").tobytes()), pa.py_buffer(x[order].tobytes())])
    n = len(cuts) - 1
    yield pa.RecordBatch.from_arrays([
        pa.array([block], pa.int64()), pa.array([None], pa.string()), pa.array([ids], pa.list_(kind)), pa.array([None], pa.binary()),
        pa.array([sizes.tobytes()], pa.binary())], names=["block", "term", "ids", "places", "often"])
    yield pa.RecordBatch.from_arrays([
        pa.array(np.full(n, block), pa.int64()), terms.dictionary.cast(pa.string()), pa.nulls(n, pa.list_(kind)),
        cut(place, 4), cut(often, 8)], names=["block", "term", "ids", "places", "often"])


def _blocks(kind, most: int, batches: Iterator):
    from pyspark import TaskContext

    block = TaskContext.get().partitionId() << 32
    ids, counts, size = [], [], 0

    for batch in batches:
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = memoryview(text.as_buffer()).tobytes()
            found = term_counts(data)
            if not found:
                continue
            ids.append(name)
            counts.append(found)
            size += len(data)
            if len(ids) >= most or size >= BLOCK_CHARS:
                yield from _turned(block, ids, kind, counts)
                block, ids, counts, size = block + 1, [], [], 0
    if ids:
        yield from _turned(block, ids, kind, counts)


def turned(rows: DataFrame, most: int) -> DataFrame:
    """``block, term, ids, places, often`` of ``rows(id, text)``: per block a row without term that has the ids
    and the lengths of its members, and a row per term with their places and how often it stands there."""
    from functools import partial

    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["id"].dataType
    schema = f"block long, term string, ids array<{kind.simpleString()}>, places binary, often binary"
    return rows.select("id", "text").mapInArrow(partial(_blocks, to_arrow_type(kind), most), schema)


def _longs(packed: Column) -> Column:
    return F.length(packed) / 8


def owners(terms: DataFrame, stages: int) -> Column:
    """The stage that owns a term of ``terms(df)``. Terms are ordered by the octave of their document
    frequency and dealt out by their share of all postings."""
    octave = F.floor(F.log2("df")).cast("int")
    share = {r["o"]: r["n"] for r in terms.groupBy(octave.alias("o")).agg(F.sum("df").alias("n")).collect()}  # 64 rows at most
    all_, before, out = sum(share.values()), 0, F.lit(stages - 1)
    for o in sorted(share):
        out = F.when(octave == o, min(stages - 1, stages * before // all_)).otherwise(out)
        before += share[o]
    return out


def _gathered(key, bundles, postings, *, average: int, texts: int, most: int | None, kind):
    """One pair of blocks in one stage. Accumulators are spread out here and leave as sparse ones, or,
    in the last stage, as the ``most`` best documents of each item."""
    import numpy as np
    import pyarrow as pa

    has_term = postings.column("term").is_valid().to_numpy()
    members = postings.filter(pa.array(~has_term))
    ids = members.column("ids")[0].values
    length = np.frombuffer(members.column("often")[0].as_buffer(), "<i8")
    slope = 20 * (50 + 50 * length * texts // average)
    acc: dict[int, object] = {}

    def of(item: int):
        if item not in acc:
            acc[item] = np.zeros(len(ids), dtype=np.int64)
        return acc[item]

    for item, places, scores in zip(*(bundles.column(c) for c in ("item", "places", "scores")), strict=True):
        of(item.as_py())[np.frombuffer(places.as_buffer(), "<u4")] = np.frombuffer(scores.as_buffer(), "<i8")
    own = postings.filter(pa.array(has_term))
    for weight, items, places, often in zip(*(own.column(c) for c in ("weight", "items", "places", "often")), strict=True):
        at, tf = np.frombuffer(places.as_buffer(), "<u4"), np.frombuffer(often.as_buffer(), "<i8")
        adds = weight.as_py() * (1_000_000_000 * tf // (1000 * tf + slope[at]))
        for item in np.frombuffer(items.as_buffer(), "<u4").tolist():
            of(item)[at] += adds
    iblock, block = (k.as_py() for k in key)
    if most is None:
        found = [(item, np.nonzero(scores)[0], scores) for item, scores in acc.items()]
        return pa.table({
            "iblock": pa.array([iblock] * len(found), pa.int64()), "block": pa.array([block] * len(found), pa.int64()),
            "item": pa.array([item for item, _, _ in found], pa.int32()),
            "places": pa.array([at.astype("<u4").tobytes() for _, at, _ in found], pa.binary()),
            "scores": pa.array([scores[at].astype("<i8").tobytes() for _, at, scores in found], pa.binary())})
    item_, place_, score_ = [], [], []
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    rank = np.empty(len(ids), dtype=np.int64)  # by id, those without one last
    rank[pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()] = np.arange(len(ids))
    for item, scores in acc.items():
        at = np.nonzero(scores)[0]
        if len(at) > most:
            bar = np.partition(scores[at], len(at) - most)[len(at) - most]
            at = at[scores[at] >= bar]
        at = at[np.lexsort((rank[at], missing[at], -scores[at]))][:most]
        item_.append(np.full(len(at), item))
        place_.append(at)
        score_.append(scores[at])
    place = np.concatenate(place_) if place_ else np.empty(0, dtype=np.int64)
    whole_ = lambda xs: np.concatenate(xs) if xs else np.empty(0, dtype=np.int64)
    return pa.table({
        "iblock": pa.array(np.full(len(place), iblock), pa.int64()), "item": pa.array(whole_(item_), pa.int32()),
        "doc_id": ids.take(pa.array(place)).cast(kind), "score": pa.array(whole_(score_), pa.int64())})


def ranked(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text",
    hits: int = HITS, stages: int = OWNERS,
) -> DataFrame:
    """``item_id, item_text, rank, doc_id, score``: the ``hits`` best documents of every item."""
    import pyarrow.compute  # noqa: F401
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = docs.schema[doc_id].dataType
    asked = items.select(F.col(item_id).alias("item_id"), whole(text).alias("text")).distinct()
    asked = asked.select(F.struct("item_id", F.col("text").alias("item_text")).alias("_k"), "text")
    # the items' own blocks; an item is named by its block and place
    named = stored(turned(asked.select(F.to_json("_k", {"ignoreNullFields": "false"}).alias("id"), "text"), BLOCK_ITEMS), "items")
    queries = named.where("term is not null").select(F.col("block").alias("iblock"), "term", F.col("places").alias("items"))
    vocabulary = stored(queries.select("term").distinct(), "terms")

    rows = docs.select(F.col(doc_id).alias("id"), whole(text).alias("text"))
    each = turned(rows, BLOCK_DOCS)
    known = vocabulary.select(F.col("term").alias("_t"))
    # a row without term has the members of a block; it stays, whatever the items hold
    postings = stored(each.join(known, F.col("term") == F.col("_t"), "left").where("term is null or _t is not null").drop("_t"), "postings")
    members = postings.where("term is null").select("block", "ids", "often")
    total = members.select(F.aggregate("ids", F.lit(0).cast("long"), lambda a, _: a + 1).alias("n"), "often")
    texts = total.agg(F.sum("n")).first()[0] or 0
    lengths = members.select("often").mapInArrow(_summed, "words long").agg(F.sum("words")).first()[0] or 0
    if not texts:
        blank = f"item_id {items.schema[item_id].dataType.simpleString()}, item_text string, rank int, doc_id {id_type.simpleString()}, score long"
        return docs.sparkSession.createDataFrame([], blank)

    df = postings.where("term is not null").groupBy("term").agg(F.sum(_longs(F.col("places")) * 2).cast("long").alias("df"))
    df = stored(df, "frequencies")
    weight = F.floor(1000 * F.log(F.lit(2.0 * texts + 2) / (2.0 * F.col("df") + 1))).cast("long")
    owned = stored(df.select(F.col("term").alias("_t"), weight.alias("weight"), owners(df, stages).alias("owner")), "owners")
    asks = queries.join(owned, F.col("term") == F.col("_t")).select("iblock", "_t", "items", "weight", "owner")
    met = postings.where("term is not null").join(asks, F.col("term") == F.col("_t")).select(
        "iblock", "block", "owner", "term", "weight", "items", "places", "often", F.lit(None).cast(postings.schema["ids"].dataType).alias("ids"))
    met = stored(met, "met")  # one row per term and pair of blocks
    pairs = met.select("iblock", "block").distinct()
    heads = members.join(pairs, "block").select(
        "iblock", "block", F.lit(None).cast("int").alias("owner"), F.lit(None).cast("string").alias("term"),
        F.lit(None).cast("long").alias("weight"), F.lit(None).cast("binary").alias("items"),
        F.lit(None).cast("binary").alias("places"), "often", "ids")

    carried = "iblock long, block long, item int, places binary, scores binary"
    bundles = docs.sparkSession.createDataFrame([], carried)
    last = f"iblock long, item int, doc_id {id_type.simpleString()}, score long"
    for stage in range(stages):
        final = stage == stages - 1
        gather = _stage(lengths, texts, hits if final else None, to_arrow_type(id_type))
        own = met.where(F.col("owner") == stage).unionByName(heads)
        bundles = bundles.groupBy("iblock", "block").cogroup(own.groupBy("iblock", "block")).applyInArrow(gather, last if final else carried)
    order = W.partitionBy("iblock", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = bundles.where("score > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= hits)
    names = named.where("term is null").select(
        F.col("block").alias("_b"), F.posexplode("ids").alias("_p", "_json"))
    key = F.from_json("_json", asked.schema["_k"].dataType)
    names = names.select("_b", "_p", key.alias("_k"))
    return best.join(names, (F.col("iblock") == F.col("_b")) & (F.col("item") == F.col("_p"))).select("_k.item_id", "_k.item_text", "rank", "doc_id", "score")


def _stage(average: int, texts: int, most: int | None, kind):
    def gather(key, left, right):
        return _gathered(key, left, right, average=average, texts=texts, most=most, kind=kind)

    return gather


def _summed(batches: Iterator):
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        words = [int(np.frombuffer(x.as_buffer(), "<i8").sum()) for x in batch.column(0)]
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.int64())], ["words"])
