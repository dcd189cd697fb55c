"""Whitening, scoring and ranked search against brute force on small rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gavelflow.llm import lexical_search, lm_score, whitening
from gavelflow.llm.queries import queries


def clashing(df):
    return df.withColumns({"x": F.lit("clash"), "_v": F.lit(1), "index": F.lit(None).cast("int"), "term": F.lit("t"), "score": F.lit(0)})


# --- whitening ---------------------------------------------------------------------------------------
def vectors(spark, rows):
    return clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))


def test_whitening_equals_numpy(spark):
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(300, 7)) @ rng.normal(size=(7, 7))).astype(np.float32)
    x = np.concatenate([x, np.repeat(x[:1], 150, axis=0)])  # a third of all rows is one vector
    bad = [(1000, None), (1001, []), (1002, [1.0] * 6 + [None]), (1003, [float("nan")] + [0.0] * 6), (1004, [float("inf")] + [0.0] * 6),
           (1005, [1.0] * 6), (None, x[5].tolist())]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + bad + [(7, x[7].tolist())]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert Counter(r["_gf_id"] for r in got) == Counter([*range(len(x)), None, 7])
    grid = np.floor(256 * x.astype(float)).astype(np.int64)
    fit = np.unique(grid, axis=0)
    n, total = len(fit), fit.sum(axis=0)
    centred = fit - total / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    signs = {}
    for r in got:
        at = 5 if r["_gf_id"] is None else r["_gf_id"]
        assert r["n"] == n and int(r["deviation"]) == int(((n * grid[at] - total) ** 2).sum()) and r["identity_error"] < 1e-9
        assert [a["component"] for a in r["axes"]] == [1, 2, 3, 4]
        for k, a in enumerate(r["axes"]):
            want = (grid[at] - total / n) @ axes[:, k] / math.sqrt(values[k])
            if abs(want) > 1e-6:
                assert signs.setdefault(k, np.sign(want) == np.sign(a["whitened"])) == (np.sign(want) == np.sign(a["whitened"]))
            assert abs(abs(a["whitened"]) - abs(want)) < 1e-7
            assert abs(a["explained"] - values[k] / values.sum()) < 1e-10


def test_whitening_without_variance_or_rows(spark):
    assert whitening.whiten(vectors(spark, [])).count() == 0
    assert whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    flat = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [7.0, 2.0])])).collect()
    assert [len(r["axes"]) for r in flat] == [1, 1, 1]
    huge = whitening.whiten(vectors(spark, [(1, [1e30, 2.0]), (2, [3.0, 2.0]), (3, [7.0, 9.0])])).collect()
    assert len(huge) == 3 and [r["deviation"] for r in huge] == [None] * 3


def test_blocks_of_several_rows_and_columns(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", 40)
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 3)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 5)).astype(np.float32)
    got = sorted(whitening.whiten(vectors(spark, [(i, v.tolist()) for i, v in enumerate(x)])).collect(), key=lambda r: r["_gf_id"])
    z = np.array([[a["whitened"] for a in r["axes"]] for r in got])
    assert np.abs(np.cov(z.T, bias=True) - np.eye(4)).max() < 1e-9


# --- ranked search ------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_ranking(docs, items, hits):
    counts = [(d, Counter(terms(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, all_ = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = {}
    for item, text in set(items):
        scored = []
        for d, c in counts:
            m = 50 + (50 * c.total() * n_docs) // all_
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out[item, text or ""] = [(None if none else d, -s) for s, none, d in sorted(scored)[:hits]]
    return {k: v for k, v in out.items() if v}


@pytest.mark.parametrize("blocks", [(2048, 256, 4), (5, 2, 3), (1, 1, 1)])
def test_ranking_equals_all_pairs(spark, monkeypatch, blocks):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", blocks[0])
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", blocks[1])
    rng = random.Random(7)
    word = lambda: rng.choice(["alpha", "Beta", "ñandú", "x1", "the", "the", "the", "É", "zz_9", f"w{rng.randrange(40)}"])
    text = lambda n: "".join(word() + rng.choice([" ", "\n", ", ", "-"]) for _ in range(n))
    docs = [(i, text(rng.randrange(60))) for i in range(70)] + [(200, None), (201, ""), (202, "... !"), (None, text(20)), (3, "alpha beta"), (3, "alpha beta")]
    items = [(i, text(6)) for i in range(9)] + [(20, None), (21, ""), (22, "nowhere"), (4, "alpha"), (None, "beta the"), (None, "beta the")]
    df = clashing(spark.createDataFrame(docs, "doc_id long, text string"))
    got = {}
    for r in lexical_search.ranked(df, clashing(spark.createDataFrame(items, "item_id long, text string")), hits=7, stages=blocks[2]).collect():
        got.setdefault((r.item_id, r.item_text), []).append((r["rank"], r.doc_id, r.score))
    want = plain_ranking(docs, items, 7)
    assert {k: [x[1:] for x in sorted(v, key=lambda x: x[0])] for k, v in got.items()} == want
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_ranking_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.ranked(docs.limit(0), items).count() == 0
    assert lexical_search.ranked(docs, items.limit(0)).count() == 0
    assert lexical_search.ranked(docs.withColumn("text", F.lit("!!")), items).count() == 0


def test_a_long_text_is_read_in_pieces(monkeypatch):
    text = (" ".join(f"Wort{i % 97}ß" for i in range(5000)) + " " + "x" * 4000).encode()
    whole = lexical_search.term_counts(text)
    assert {k.decode(): n for k, n in whole.items()} == Counter(terms(text.decode())) and whole.total() == 5001
    monkeypatch.setattr(lexical_search, "PIECE", 50)
    assert lexical_search.term_counts(text) == whole
    words = [w for part in lm_score.pieces(text) for w in part]
    monkeypatch.setattr(lm_score, "PIECE", 50)
    assert [w for part in lm_score.pieces(text) for w in part] == words and len(words) == 5001


# --- scoring ------------------------------------------------------------------------------------------
def sentences(n, seed=3):
    """Two made-up languages, whose words follow one another in a fixed way most of the time."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang, at, w = rng.randrange(2), rng.randrange(30), []
        for _ in range(rng.randrange(5, 60)):
            w.append(f"{'ab'[lang]}{at}")
            at = (at + 1) % 30 if rng.random() < 0.8 else rng.randrange(30)
        out.append((i, " ".join(w) + (f" rare{i}" if i % 3 == 0 else "")))
    return out


def test_base_scores_are_exact_and_the_model_beats_them_on_held_out_texts(spark):
    rows = [*sentences(900), (5000, None), (5001, ""), (None, "a1 a2"), (5002, "a1 A1\x0ba2 unseen unseen"), (5002, "a1 A1\x0ba2 unseen unseen")]
    df = clashing(spark.createDataFrame(rows, "doc_id long, text string"))
    got = lm_score.score_texts(df, own=40, head=55, rounds=4).collect()
    words = {i: (t or "").encode().lower().split() + [None] for i, t in rows}
    held = {i: zlib.crc32(("" if i is None else str(i)).encode()) % 10 == 0 for i in words}
    train = Counter(w for i, t in rows if not held[i] for w in (t or "").encode().lower().split() + [None])
    n, v = train.total(), len(train)
    assert len(got) == len(rows)
    gains = []
    for r in got:
        w = words[r["_gf_id"]]
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[r["_gf_id"]], len(w), sum(x in train for x in w), n)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0
        if r.held_out:
            gains.append((r.score - r.base_score) / len(w))
    assert len(gains) > 50 and sum(gains) / len(gains) > 0.2
    same = [r.score for r in got if r["_gf_id"] == 5002]
    assert abs(same[0] - same[1]) < 1e-9


def test_probabilities_sum_to_one():
    counts = Counter({b"w%d" % i: 200 // (i + 1) + 1 for i in range(60)})
    top = counts.most_common(40)
    v = lm_score.Vocabulary([w for w, _ in top], [c for _, c in top], 9, counts.total() + 9, len(counts) + 1, 10)
    model = lm_score.Model(v, 8)
    k = v.symbols + 1
    for far, near in ((v.start, v.start), (0, 3), (v.rest, v.end)):
        symbols = 10.0 ** model.log10((far * k + near) * k + np.arange(v.symbols))
        assert abs(symbols.sum() - 1) < 1e-5
        words = sum(symbols[v.symbol[i]] * (10.0 ** v.share[i] if i >= v.own else 1.0) for i in range(40))
        tail = sum(counts[w] + 0.1 for w in counts if w not in dict(top)) + 0.1  # and one unknown word
        rest = symbols[v.rest] * tail / 10.0 ** v.rest_below
        assert abs(words + rest + symbols[v.end] - 1) < 1e-5


def test_scores_without_training_texts_or_rows(spark):
    none = spark.createDataFrame([(None, "a b"), (None, None)], "doc_id long, text string")
    got = lm_score.score_texts(none).collect()
    assert [(r.held_out, r.n_known, r.train_tokens) for r in got] == [(True, 0, 0)] * 2
    assert all(abs(r.base_score) < 1e-9 and r.score <= 0 for r in got)
    assert lm_score.score_texts(none.limit(0)).count() == 0


def test_the_queries_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    made = queries()
    white = made["op11_whitening"](spark, sf)
    assert white.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    assert dict(white.dtypes) | {"n": "bigint"} == dict(white.dtypes) and white.count() == 4 * spark.read.parquet(f"{sf}/embeddings.parquet").count()
    scores = made["op12_lm_scores"](spark, sf)
    assert scores.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and scores.count() == 200
    best = made["op13_lexical_search"](spark, sf)
    assert dict(best.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
