"""SimHash fingerprints, links between fingerprints at a few differing bits, and their components.

Equal fingerprints are one node. Nodes meet in shards: the 64 bits are cut into six blocks, and two
fingerprints that differ in at most four bits agree on at least two whole blocks, so they share the
shard of that pair of blocks. Inside a shard, fingerprints are sorted by population count and cut
into tiles; tiles are compared exactly (exclusive-or and bit count in numpy), and a pair of tiles is
skipped when the population counts are further apart than the radius. A shard gives the edges of a
spanning forest of its links, never all pairs.

Why shards at all: tiles over the whole corpus, with nothing but population counts to skip by,
compare more than half of all pairs, which no cluster finishes at 10^10 documents.

Defined cases: a missing or empty text has no words and fingerprint zero, linked like any other;
with fewer than four words the whole sequence is the one shingle; a component without any id has no
component_id; repeated rows give repeated result rows; a very long text counts whole, with a hash per shingle
in memory; columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import DOC_KEY, doc_key, packed_rows, same_doc, stored, whole
from gavelflow.llm.graph import components

SHINGLE = 4
RADIUS = 4
BLOCKS = [(0, 11), (11, 11), (22, 11), (33, 11), (44, 10), (54, 10)]
TILE = 1024


def fingerprint(text: str) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    import numpy as np
    import xxhash

    w = text.encode().lower().split()  # bytes: A-Z and ASCII space only
    if not w:
        return 0
    shingles = [b" ".join(w)] if len(w) < SHINGLE else map(b" ".join, zip(*[w[k:] for k in range(SHINGLE)], strict=False))
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    majority = 2 * bits.sum(axis=0, dtype=np.int64) > len(hashes)
    return int(np.packbits(majority).view(">u8")[0])


def _fingerprints(frames):
    import numpy as np

    for pdf in frames:
        marks = np.array([fingerprint(t) for t in pdf.pop("_text")], dtype=np.uint64).view(np.int64)
        yield pdf.assign(fp=marks)


def fingerprints(docs: DataFrame) -> DataFrame:
    """Key and ``fp`` of every row. Written once, since links and result both read it."""
    rows = docs.select(*doc_key(), whole().alias("_text"))
    kind = f"{DOC_KEY[0]} {docs.schema['doc_id'].dataType.simpleString()}, {DOC_KEY[1]} long, fp long"
    return stored(rows.mapInPandas(_fingerprints, kind), "fingerprints")


def _roots(n: int):
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    return parent, find


def shard_links(marks, radius: int = RADIUS, tile: int = TILE) -> list[tuple[int, int]]:
    """Index pairs of a spanning forest over all pairs of ``marks`` within ``radius``."""
    import numpy as np

    pops = np.bitwise_count(marks).astype(np.int64)
    order = np.argsort(pops, kind="stable")
    a, p = marks[order], pops[order]
    parent, find = _roots(len(a))
    roots = np.arange(len(a))
    found = []
    for i in range(0, len(a), tile):
        rows = a[i:i + tile]
        for j in range(i, len(a), tile):
            if p[j] - p[min(i + tile, len(a)) - 1] > radius:
                break  # counts only grow from here on
            near = np.bitwise_count(rows[:, None] ^ a[None, j:j + tile]) <= radius
            x, y = np.nonzero(near)
            x, y = x + i, y + j
            open_ = (x < y) & (roots[x] != roots[y])
            if not open_.any():
                continue
            x, y = x[open_], y[open_]
            for u, v in zip(x.tolist(), y.tolist(), strict=True):
                r, s = find(u), find(v)
                if r != s:
                    parent[max(r, s)] = min(r, s)
                    found.append((int(order[u]), int(order[v])))
            roots = np.array([find(k) for k in range(len(a))])
    return found


def _small_shards(keys, marks, radius: int):
    """Links inside runs of equal ``keys`` of a few rows each, all runs at once by distance in the run."""
    import numpy as np

    out, step = [], 1
    while step < len(keys):
        same = np.nonzero(keys[step:] == keys[:-step])[0]
        if not len(same):
            break
        hit = same[np.bitwise_count(marks[same] ^ marks[same + step]) <= radius]
        out += [np.stack([hit, hit + step], axis=1)]
        step += 1
    return np.concatenate(out) if out else np.empty((0, 2), dtype=np.int64)


SMALL = 32


def _links_of(frames: Iterator) -> Iterator:
    """Frames of one partition, sorted by shard; a shard may reach over several frames."""
    import numpy as np
    import pandas as pd

    def edges(key, mark):
        first = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        length = np.diff(np.r_[first, len(key)])
        small = np.repeat(length <= SMALL, length)
        k, m = key[small], mark[small]
        pairs = _small_shards(k, m, RADIUS)
        yield m[pairs[:, 0]], m[pairs[:, 1]]
        for at, n in zip(first[length > SMALL].tolist(), length[length > SMALL].tolist(), strict=True):
            part = mark[at:at + n]
            made = np.array(shard_links(part), dtype=np.int64).reshape(-1, 2)
            yield part[made[:, 0]], part[made[:, 1]]

    def frame(key, mark):
        for a, b in edges(key, mark):
            if len(a):
                yield pd.DataFrame({"a": np.minimum(a.view(np.int64), b.view(np.int64)), "b": np.maximum(a.view(np.int64), b.view(np.int64))})

    held: list = []
    for pdf in frames:
        key, mark = pdf["key"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
        if not len(key):
            continue
        if held and held[0][0][-1] != key[0]:
            yield from frame(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held = []
        cut = int(np.searchsorted(key, key[-1]))  # the last shard may go on in the next frame
        if cut:
            held.append((key[:cut], mark[:cut]))
            yield from frame(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
            held = []
        held.append((key[cut:], mark[cut:]))
    if held:
        yield from frame(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))


def links(nodes: DataFrame) -> DataFrame:
    """Distinct links ``a, b`` that connect all fingerprints of ``nodes(fp)`` within the radius."""
    fp = F.col("fp")
    keys = []
    for i in range(len(BLOCKS)):
        for j in range(i + 1, len(BLOCKS)):
            part = [F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << size) - 1)) for at, size in (BLOCKS[i], BLOCKS[j])]
            keys.append(F.lit((i * len(BLOCKS) + j) << 22).bitwiseOR(F.shiftleft(part[0], 11)).bitwiseOR(part[1]))
    sharded = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    placed = sharded.repartition("key").sortWithinPartitions("key")
    return placed.mapInPandas(_links_of, "a long, b long").distinct()


def simhash_components(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: key, ``fp`` and ``component_id``."""
    marks = fingerprints(docs)
    nodes = marks.groupBy("fp").agg(F.min(DOC_KEY[0]).alias("_least"))
    roots = components(links(nodes.select("fp")))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    of = stored(named.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id"), "components")
    return marks.join(of, marks["fp"] == of["_fp"]).select(*DOC_KEY, "fp", "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: one row of each component, the one with the
    smallest id (then text hash)."""
    found = simhash_components(docs)
    first = found.where(F.col(DOC_KEY[0]).eqNullSafe(F.col("component_id"))).groupBy("component_id").agg(
        F.min(F.struct(*DOC_KEY)).alias("_k")).select("_k.*")
    return keep_rows(docs, first)


def keep_rows(docs: DataFrame, first: DataFrame) -> DataFrame:
    """One row of ``docs`` for each document key of ``first``."""
    rows = packed_rows(docs)
    kept = rows.join(first, same_doc(rows, first), "left_semi")
    # exact repeats of a kept row share its key; only they are put in order
    repeated = stored(docs.groupBy(*doc_key()).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*DOC_KEY), "repeated")
    if repeated.isEmpty():
        return kept.select("_gf_row.*")
    once = kept.join(repeated, same_doc(kept, repeated), "left_anti").select("_gf_row.*")
    many = kept.join(repeated, same_doc(kept, repeated), "left_semi")
    least = many.groupBy(*DOC_KEY).agg(F.min_by("_gf_row", F.to_json("_gf_row")).alias("_gf_row")).select("_gf_row.*")
    return once.unionByName(least)
