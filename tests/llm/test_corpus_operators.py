"""Operators that compare, cut, pack and write documents, against brute force on small rows."""

import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gavelflow.llm import decontaminate, ids, license_scan, packing, simhash, simple8b, substring_dedup, token_files
from gavelflow.llm.graph import components

DOCS = "doc_id long, text string"
BYTES = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).withColumns({"start": F.lit("clash"), "_text": F.lit(1), "length": F.lit(None).cast("int")})


# --- near-duplicates ---------------------------------------------------------------------------
def plain_fingerprint(text):
    import xxhash

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks):
    parent = list(range(len(marks)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(marks)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(marks))]


def test_simhash_equals_all_pairs(spark):
    rng = random.Random(2)
    base = [" ".join(rng.choice("abcdefgh") + rng.choice("xyz") for _ in range(300)) for _ in range(6)]
    texts = [None, "", " \x0b", "One", "one", "two WORDS", "Ä B c", "ä b c"]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = "edit"
            texts.append(" ".join(w))
    rows = list(enumerate(texts)) + [(3, texts[3])]
    got = simhash.simhash_components(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    marks = [plain_fingerprint(t) for t in texts]
    assert {r["_gf_id"]: r["fp"] % 2**64 for r in got} == dict(enumerate(marks))
    assert {r["_gf_id"]: r["component_id"] for r in got} == dict(enumerate(plain_components(marks)))
    kept = simhash.keep_one(docs(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(plain_components(marks)))
    assert kept.columns == docs(spark, rows).columns
    nameless = simhash.simhash_components(docs(spark, [(None, "solo"), (None, "a b c d"), (7, "a b c d")])).collect()
    assert sorted((r["_gf_id"] or -1, r["component_id"] or -1) for r in nameless) == [(-1, -1), (-1, 7), (7, 7)]
    assert simhash.simhash_components(docs(spark, [])).count() == 0


def test_tiles_and_shards_lose_no_link(spark):
    rng = np.random.default_rng(5)
    centre = rng.integers(0, 2**63, 8, dtype=np.uint64)
    marks = np.concatenate([c ^ (np.uint64(1) << rng.integers(0, 64, (150, 2), dtype=np.uint64)).sum(axis=1, dtype=np.uint64) for c in centre])
    marks = np.unique(np.r_[marks, rng.integers(0, 2**63, 400, dtype=np.uint64)])
    rng.shuffle(marks)
    want = plain_components([int(m) for m in marks])
    for tile in (7, 64, 5000):
        parent = list(range(len(marks)))

        def find(i):
            while parent[i] != i:  # noqa: B023
                i = parent[i]  # noqa: B023
            return i

        for a, b in simhash.shard_links(marks, tile=tile):
            assert (int(marks[a]) ^ int(marks[b])).bit_count() <= 4
            r, s = find(a), find(b)
            assert r != s  # a forest
            parent[max(r, s)] = min(r, s)
        assert len({find(i) for i in range(len(marks))}) == len(set(want))
    signed = marks.view(np.int64).tolist()
    found = components(simhash.links(spark.createDataFrame([(m,) for m in signed], "fp long"))).collect()
    root = {r.node: r.root for r in found}
    groups = {}
    for m, w in zip(signed, want, strict=True):
        groups.setdefault(w, set()).add(root.get(m, m))
    assert all(len(g) == 1 for g in groups.values()) and len(set.union(*groups.values())) == len(groups)


# --- decontamination ------------------------------------------------------------------------------
def edit_match(pattern, text, most):
    column, best = list(range(len(pattern) + 1)), (len(pattern), 0)
    for j, c in enumerate(text, 1):
        left, column[0] = column[0], 0
        for i in range(1, len(pattern) + 1):
            left, column[i] = column[i], min(column[i] + 1, column[i - 1] + 1, left + (pattern[i - 1] != c))
        if column[-1] < best[0]:
            best = (column[-1], j)
    return best if best[0] <= most else None


def test_benchmark_hits_equal_dynamic_programming(spark):
    rng = random.Random(4)
    letters = "abcde \n"
    items = [(i, "".join(rng.choice(letters) for _ in range(rng.randint(16, 120)))) for i in range(6)]
    items += [(6, None), (7, "short"), (1, items[2][1]), (None, "an item that has no id at all")]
    rows = []
    for d in range(60):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 80)))
        if d % 2:
            x = list(rng.choice(items[:6])[1].upper())
            for _ in range(rng.randint(0, 6)):
                at = rng.randrange(len(x) + 1)
                x[at:at + rng.randint(0, 1)] = rng.choice(["", "Z", "zz"])
            text = text[:30] + "".join(x) + text[30:]
        rows.append((d, text))
    rows += [(100, None), (101, ""), (102, "İ AN ITEM\tTHAT HAS NO ID AT ALL"), (None, items[0][1]), (3, rows[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("end", F.lit(0))
    want = {}
    for d, text in rows:
        for i, item in items:
            if item and len(item) >= 16:
                p = decontaminate.normal(item)
                m = edit_match(p, decontaminate.normal(text or ""), math.floor(len(p) * 0.05))
                if m and m < want.get((d, i), (99,)):
                    want[d, i] = m
    for block in (10_000, 100):
        got = decontaminate.benchmark_hits(docs(spark, rows), bench, block_chars=block).collect()
        assert {(r["_gf_id"], r["item_id"]): (r["distance"], r["end"]) for r in got} == want
        assert all(0 <= r["start"] <= r["end"] for r in got)
    assert want and (102, None) in want
    clean = decontaminate.drop_contaminated(docs(spark, rows), bench)
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(d) for d, _ in rows if d not in {k[0] for k in want})
    assert decontaminate.benchmark_hits(docs(spark, []), bench).count() == 0
    assert decontaminate.benchmark_hits(docs(spark, rows), bench.limit(0)).count() == 0


# --- ids, packing, files -----------------------------------------------------------------------------
ODD = [
    "", "  ", "a  b\n\n c", "\tq", "İ Σας ΣΑΣ 's don't", "a" * 300, "<|endoftext|> x", "é ́x", "🙂 🙂🙂  a", "\n\n\n", "x \n y", "don't X''t .'t 't 12ab3's a'B",
    "日本a b", "abcé ª µx", "a\x1cb c", "a   b", " x 　 y", "it's 'tis", "_a1_b'll'LL", "Ünï 12,345.67%", "a\x0bb\x0c c\r\n",
]


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_ids_in_pieces_equal_ids_of_the_whole(path):
    rng = random.Random(9)
    texts = ODD + ["".join(rng.choice(["a", "B", "é", "'", "s", "t", " ", "  ", "\n", "1", ".", ",", "日", " ", "_", "ll"]) for _ in range(60)) for _ in range(800)]
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    for remember in (50, 10_000):
        made = []
        encoder = ids.IdEncoder(path, remember)
        for a, b in ids.batches(texts, 500):
            made += encoder.encode(texts[a:b])
        assert [np.frombuffer(x, "<u4").tolist() for x in made] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_fresh_runs_of_letters_skip_the_whole_tokenizer():
    encoder = ids.IdEncoder(BYTES)
    asked = []
    whole = encoder._encoded
    encoder._encoded = lambda texts: asked.extend(texts) or whole(texts)
    texts = ["Plain words, 12 of them", "Été ÀÉ naïve\n\nx  y it's"]
    made = encoder.encode(texts)
    plain = Tokenizer.from_file(BYTES)
    assert [np.frombuffer(x, "<u4").tolist() for x in made] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    assert not {"Plain", " words", " of", " them", "Été", " ÀÉ", " naïve"} & set(asked) and {",", " 12"} <= set(asked)


def test_packing_places_every_id_once(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "Gamma", "é"]) for _ in range(rng.choice([0, 3, 40, 300, 900])))) for i in range(150)]
    rows += [(500, None), (501, ""), (502, "long " * 9000), (None, "no id"), (7, rows[7][1])]
    df = docs(spark, rows).repartition(7)
    for window, most in ((2048, 0.05), (64, 0.2)):
        pieces = packing.pack(df, BYTES, window=window, open_windows=4)
        got = pieces.collect()
        plain = Tokenizer.from_file(BYTES)
        want = {}
        for d, t in rows:
            want.setdefault(d, []).append([*plain.encode(t or "", add_special_tokens=False).ids, 1])
        parts, windows = {}, {}
        for r in got:
            assert len(r.ids) == 4 * r.length > 0
            parts.setdefault(r.doc_id, []).append(r)
            windows.setdefault(r.sequence_id, []).append(r)
        for d, texts in want.items():
            n = len(texts)  # a repeated row is packed twice
            seen = sorted((r.start, r.length, np.frombuffer(r.ids, "<u4").tolist()) for r in parts[d])
            assert all(r.doc_tokens == len(texts[0]) for r in parts[d])
            assert all(x == texts[0][s:s + k] for s, k, x in seen) and sum(k for _, k, _ in seen) == n * len(texts[0])
        for w in windows.values():
            w.sort(key=lambda r: r.offset)
            assert [r.offset for r in w] == [sum(x.length for x in w[:i]) for i in range(len(w))]
            assert sum(r.length for r in w) <= window
        filled = sum(r.length for r in got)
        assert 1 - filled / (window * len(windows)) < most
        full = packing.sequences(pieces, window).collect()
        assert {r.sequence_id for r in full} == set(windows)
        assert all(len(r.ids) == 4 * (r.n_tokens if r.n_tokens.bit_count() == 1 else window) for r in full)
    assert packing.pack(docs(spark, []), BYTES).count() == 0


def test_leftovers_merge_over_several_levels(spark, monkeypatch):
    monkeypatch.setattr(packing, "FAN_IN", 2)
    df = docs(spark, [(i, "word " * (i % 50)) for i in range(200)]).repartition(9)
    got = packing.pack(df, BYTES, window=128, open_windows=3).collect()
    assert sum(r.length for r in got) == sum(n for n in {r.doc_id: r.doc_tokens for r in got}.values())
    assert len({(r.sequence_id, r.offset) for r in got}) == len(got)


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 5000])
def test_simple8b_round_trip(n):
    rng = np.random.default_rng(n)
    for top in (1, 2, 9, 300, 50_000, 2**20, 2**21, 2**63):
        x = rng.integers(0, top, n, dtype=np.uint64)
        x[rng.random(n) < 0.3] = 0
        words, first, places, escapes, first_escape = simple8b.encode_blocks(x)
        assert len(first) == -(-n // simple8b.BLOCK) + 1
        back = simple8b.decode_blocks(words, first, places.astype(np.int64), escapes, first_escape, n)
        assert (back == x).all()
        assert len(escapes) == (x >> np.uint64(simple8b.WIDEST) > 0).sum()
    zeros = simple8b.encode_blocks(np.zeros(2560, dtype=np.uint64))[0]
    assert len(zeros) == 10 * 5  # 60 ids a word


def test_token_files_hold_every_document_in_order(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i * 7 % 101, " ".join(rng.choice(["Alpha", "beta,", "é", "12"]) for _ in range(rng.randint(0, 90)))) for i in range(101)]
    rows += [(200, None), (201, ""), (202, "x " * 30_000), (None, "nameless"), (5, "second text of five")]
    plain = Tokenizer.from_file(WORDS)
    got = token_files.through_files(docs(spark, rows), WORDS).collect()
    got.sort(key=lambda r: r.start)
    start = 0
    hashed = {r.t: r.h for r in spark.createDataFrame([(t or "",) for _, t in rows], "t string").select("t", F.xxhash64("t").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashed[r[1] or ""]))
    for r, (d, t) in zip(got, order, strict=True):
        made = [*plain.encode(t or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens) == (d, start, len(made))
        assert zlib.crc32(r.ids) == zlib.crc32(np.array(made, "<u4").tobytes())
        start += len(made)
    assert token_files.through_files(docs(spark, []), WORDS).count() == 0


# --- repeated passages, licenses ---------------------------------------------------------------------------
def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: rng.choice("abcdefghijklmnop") + rng.choice("xyz")
    passage = [word() for _ in range(60)]
    rows = []
    for d in range(40):
        w = [word() for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randrange(40)
            w += passage[a:a + rng.randint(10, 50)]
        if d % 9 == 0:
            w = w + w
        rows.append((d, rng.choice([" ", "\n", "\x0b \t"]).join(w)))
    rows += [(50, None), (51, ""), (52, "same " * 200), (53, " ".join(passage)), (-3, " ".join(passage)), (54, "é " * 25)]
    got = {r["_gf_id"]: r for r in substring_dedup.remove_repeats(docs(spark, rows)).collect()}
    seen, n_removed = set(), 0
    for d, t in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        keep = [True] * len(w)
        for i in range(len(w) - 19):
            if tuple(w[i:i + 20]) in seen:
                keep[i:i + 20] = [False] * 20
            seen.add(tuple(w[i:i + 20]))
        r = got[d]
        assert (r["n_words"], r["n_removed"], r["kept"]) == (len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k))
        assert sorted(i for f in r["factors"] for i in range(f["start"], f["start"] + f["length"])) == [i for i, k in enumerate(keep) if not k]
        n_removed += keep.count(False)
    assert n_removed > 300 and got[-3]["n_removed"] == 0
    twice = substring_dedup.remove_repeats(docs(spark, [(1, " ".join(passage)), (1, " ".join(passage)), (None, "n " * 5)])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0, 0]  # repeated rows are one document
    assert substring_dedup.remove_repeats(docs(spark, [])).count() == 0


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            left, row[j] = row[j], left + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_alignment_is_a_common_subsequence():
    rng = random.Random(1)
    for _ in range(300):
        template = [rng.choice("abcdefghijklmno") for _ in range(rng.randint(1, 25))]
        text = [w for w in template if rng.random() < 0.8] if rng.random() < 0.5 else [rng.choice("abcdefghijklmnoxyz") for _ in range(rng.randint(0, 40))]
        pairs = license_scan.align(text, template)
        assert all(text[i] == template[j] for i, j in pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(pairs, pairs[1:], strict=False))
        assert len(pairs) <= common_length(text, template)
    distinct = [str(i) for i in range(40)]
    for _ in range(50):  # with unique words, patience finds the longest
        text = [w for w in distinct if rng.random() < 0.7]
        assert len(license_scan.align(text, distinct)) == common_length(text, distinct)
    values = [rng.randrange(50) for _ in range(200)]
    assert [values[i] for i in license_scan.increasing(values)] == sorted({values[i] for i in license_scan.increasing(values)})


def test_near_miss_lines_are_not_taken_for_their_neighbours():
    named = lambda t: [x[0] for x in license_scan.Scanner().notices(t)]
    for text, want in {
        "Released under the BSD License.": ["bsd-line"], "Released under the Foo License.": [], "Released under the MIT License": ["mit-line"],
        "Licensed under CC BY-ND 4.0.": ["cc-by-nd-line"], "Licensed under CC BY 4.0.": ["cc-by-short"], "Licensed under CC BY-NC 3.0.": [],
        "Licensed under the Apache License, Version 1.1.": ["apache-1.1-line"], "Licensed under the Apache License, Version 1.0.": [],
        "This work is licensed under the GNU General Public License, version 2.": ["gpl-2.0-line"],
        "This work is licensed under the GNU Lesser General Public License, version 3.": [],
        "Released under the Foo License. Released under the MIT License.": ["mit-line"],
    }.items():
        assert named(text) == want, text
    for name, text in license_scan.TEMPLATES.items():
        assert named(f"before it {text} after it") == [name]


def test_notices_in_documents(spark):
    apache, mit, gpl = (license_scan.TEMPLATES[k] for k in ("apache-2.0-header", "mit-line", "gpl-3.0-line"))
    changed = apache.replace("limitations", "limits").replace("compliance", "accord").upper()
    rows = [
        (0, None), (1, ""), (2, "plain words about a license and rights"), (3, f"Top.\n{mit}\nmiddle\n{mit} {mit}"), (4, "x " * 3000 + changed + " y" * 3000),
        (5, f"{gpl}\nAll rights\nreserved"), (None, mit), (6, "license " * 20_000), (3, f"Top.\n{mit}\nmiddle\n{mit} {mit}")]
    got = license_scan.license_notices(docs(spark, rows)).collect()
    by = {}
    for r in got:
        by.setdefault(r["_gf_id"], []).append((r["license"], dict(rows)[r["_gf_id"]][r["start"]:r["end"]], r["coverage"]))
    assert set(by) == {3, 4, 5, None}
    assert by[3] == [("mit-line", mit.rstrip("."), 1.0)] * 6  # three notices, two rows
    assert [x[0] for x in by[4]] == ["apache-2.0-header"] and 0.9 < by[4][0][2] < 1
    assert sorted(x[0] for x in by[5]) == ["all-rights-reserved", "gpl-3.0-line"]
    assert license_scan.license_notices(docs(spark, [])).count() == 0




# --- near copies by word runs ----------------------------------------------------------------------
def plain_runs(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_near_copies_equal_all_pairs(spark):
    import corpus_pipeline

    rng = random.Random(5)
    word = lambda: rng.choice("bcdfgklmn") + rng.choice("aeiou") + rng.choice("rstz") + rng.choice("aeiou")
    texts = [None, "", " \x0b", "One", "one", "two WORDS", "Ä b c", "ä b c"]
    for n in [5, 6, 9, 14, 20, 40, 90, 300]:
        base = [word() for _ in range(n)]
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randrange(1 + max(1, n // 25))):
                w[rng.randrange(len(w))] = word()
            cut = rng.randrange(1 + n // 6)
            texts.append(" ".join(w[cut:] if rng.random() < 0.5 else w + [word() for _ in range(cut)]))
    rows = [(i if i % 9 else i + 10_000, t) for i, t in enumerate(texts)]
    sets = [plain_runs(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    wide = 0
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 9 * shared >= 4 * (len(sets[i]) + len(sets[j])):
                wide += (plain_fingerprint(rows[i][1]) ^ plain_fingerprint(rows[j][1])).bit_count() > 4
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), doc), doc)
    assert wide > 50 and 20 < len(least) < len(rows)
    kept = corpus_pipeline.near_duplicates(spark, docs(spark, rows), "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(least.values())


def test_texts_left_apart_in_a_mark_are_all_compared(spark):
    from gavelflow.llm import near_copies as nc

    rng = random.Random(6)
    sets = {}
    for i in range(30):
        base = rng.sample(range(1 << 40), rng.choice([5, 30, 200]))
        sets[2 * i], sets[2 * i + 1] = base, [*base, rng.randrange(1 << 40)]
    table = spark.createDataFrame([(k, len(g), g) for k, g in sets.items()], "node long, n long, runs array<long>")
    rest = spark.createDataFrame([(1, k, 0 if k in (0, 2, 4) else k) for k in sets], "mark long, node long, root long")
    for tile, tile_runs in ((256, 250_000), (8, 300)):
        got = nc._rest_of_links(rest, table, tile, tile_runs).collect()
        assert sorted((r.a, r.b) for r in got) == [(2 * i, 2 * i + 1) for i in range(30)]


def test_a_bucket_is_agreed_on_by_every_close_pair():
    from gavelflow.llm.near_copies import bucket_marks

    rng = np.random.default_rng(3)
    for n in [*range(1, 60), 100, 333, 1000, 4000]:
        for grow in (0, n // 4):
            common = rng.integers(0, 2**64, n, dtype=np.uint64)
            most = (n + grow) - math.ceil(0.8 * (n + grow) - 1e-9)
            a, b = np.unique(common), common
            if grow:  # one holds the other
                b = np.r_[b, rng.integers(0, 2**64, grow, dtype=np.uint64)]
            else:  # both sides changed, as far as 0.8 allows
                k = most // 2
                b = np.r_[b[k:], rng.integers(0, 2**64, k, dtype=np.uint64)]
            b = np.unique(b)
            shared = len(np.intersect1d(a, b))
            if 9 * shared >= 4 * (len(a) + len(b)):
                assert np.intersect1d(bucket_marks(a), bucket_marks(b)).size, (n, grow)
