"""Item identity: tokens, model numbers, keys, families, similarity.

Everything is a native column expression: one regular-expression pass per token list, so no
Python worker is involved. Patterns use look-around to keep filter logic inside that pass.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from gavelflow import lexicon as lx

_EDGE_L, _EDGE_R = r"(?<![\w\-])", r"(?![\w\-])"
SIGNIFICANT_PATTERN = (
    _EDGE_L + "(?!(?:" + "|".join(lx.STOPWORDS) + ")" + _EDGE_R + r")[\w\-]{2,}"
)
MODEL_PATTERN = (
    _EDGE_L + r"(?=[a-z\-]*[0-9])(?!(?:19|20)\d\d" + _EDGE_R + ")(?!" + lx.MEASURE
    + _EDGE_R + r")[a-z0-9][a-z0-9\-]{2,}" + _EDGE_R
)
FAMILY_PATTERN = r"^(.+:)([a-z]*[0-9][a-z0-9]*?)[a-z]{1,2}$"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str, list[tuple[str, str]]]:
    """Compatibility decomposition to ASCII, derived from the Unicode database.

    Letters that decompose to one ASCII character go through ``translate``; the few common signs
    that become several characters are replaced one by one; the rest is dropped.
    """
    src, dst, multi = [], [], []
    for cp in [*range(0x80, 0x3100), *range(0xFB00, 0x10000)]:
        ch = chr(cp)
        flat = unicodedata.normalize("NFKD", ch).encode("ascii", "ignore").decode("ascii")
        if len(flat) == 1:
            src.append(ch)
            dst.append(flat)
        elif len(flat) > 1 and ch in "½¼¾…™℠ﬀﬁﬂﬃﬄĳĲ№℃℉":
            multi.append((ch, flat))
    return "".join(src), "".join(dst), multi


def ascii_fold(c: Column | str) -> Column:
    src, dst, multi = fold_table()
    raw = F.coalesce(as_col(c), F.lit(""))
    folded = raw
    for ch, flat in multi:
        folded = F.replace(folded, F.lit(ch), F.lit(flat))
    folded = F.regexp_replace(F.translate(folded, src, dst), r"[^\x00-\x7F]", "")
    return F.when(raw.rlike(r"[^\x00-\x7F]"), folded).otherwise(raw)


def folded_lower(c: Column | str) -> Column:
    return F.lower(ascii_fold(c))


def tokenize(c: Column | str) -> Column:
    return F.regexp_extract_all(folded_lower(c), F.lit(r"[\w\-]+"), 0)


def _significant(folded: Column, limit: int | None) -> Column:
    every = F.regexp_extract_all(folded, F.lit(SIGNIFICANT_PATTERN), 0)
    return every if limit is None else F.slice(every, 1, limit)


def _models(folded: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(folded, F.lit(MODEL_PATTERN), 0))


def significant_tokens(c: Column | str, limit: int | None = None) -> Column:
    """Words that are no stopwords, in text order: all, or the first ``limit``."""
    return _significant(folded_lower(c), limit)


def model_set(c: Column | str) -> Column:
    """Distinct model-like tokens in text order."""
    return _models(folded_lower(c))


def extract_model_numbers(c: Column | str) -> Column:
    """Distinct model-like tokens, longest first, then alphabetical."""
    keyed = F.transform(model_set(c), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    return F.transform(F.array_sort(keyed), lambda s: s["t"])


def _top_model(models: Column) -> Column:
    return F.array_min(
        F.transform(models, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))
    )["t"]


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def normalize_item_key(
    title: Column | str, brand: Column | str | None = None,
    model: Column | str | None = None, upc: Column | str | None = None,
) -> Column:
    none = F.lit(None).cast("string")
    title, brand, model, upc = (none if c is None else as_col(c) for c in (title, brand, model, upc))
    brand_token = F.coalesce(_first(significant_tokens(brand, 1)), F.lit(""))
    model_token = F.coalesce(
        _top_model(model_set(model)), _first(significant_tokens(model, 1)), _top_model(model_set(title))
    )
    digits = F.regexp_replace(F.coalesce(upc, F.lit("")), r"[^0-9]", "")
    words = significant_tokens(title, 5)
    with_brand = F.when(
        (brand_token != "") & ~F.array_contains(words, brand_token),
        F.slice(F.concat(F.array(brand_token), words), 1, 5),
    ).otherwise(words)
    return (
        F.when(F.length(digits) >= 8, F.concat(F.lit("upc:"), digits))
        .when(model_token.isNotNull() & (brand_token != ""), F.concat_ws(":", F.lit("bm"), brand_token, model_token))
        .when(model_token.isNotNull(), F.concat(F.lit("m:"), model_token))
        .when(F.size(with_brand) > 0, F.concat(F.lit("t:"), F.array_join(F.array_sort(with_brand), "-")))
        .otherwise(F.lit("t:unknown"))
    )


def key_family(key: Column | str) -> Column:
    key = as_col(key)
    stem = F.regexp_extract(key, FAMILY_PATTERN, 2)
    return F.when(
        ~key.startswith("upc:") & (F.length(stem) >= 4),
        F.concat(F.regexp_extract(key, FAMILY_PATTERN, 1), stem),
    ).otherwise(key)


def key_stem_length(key: Column | str) -> Column:
    """Shortest prefix of a key that can be somebody's family: up to the last colon plus two."""
    key = as_col(key)
    return F.length(F.regexp_extract(key, r"^(.*:)", 1)) + F.lit(2)


def search_query(title: Column | str, brand: Column | str | None = None, model: Column | str | None = None) -> Column:
    none = F.lit(None).cast("string")
    title, brand, model = (none if c is None else as_col(c) for c in (title, brand, model))
    brand_part = F.coalesce(significant_tokens(brand, 1), F.array().cast("array<string>"))
    top = F.coalesce(_top_model(model_set(model)), _top_model(model_set(title)))
    model_part = F.when(top.isNotNull(), F.array(top)).otherwise(F.array().cast("array<string>"))
    lead = F.concat(brand_part, model_part)
    rest = F.array_except(significant_tokens(title, 5), lead)
    return F.array_join(F.slice(F.concat(lead, rest), 1, 5), " ")


def url_plus(c: Column | str) -> Column:
    return F.url_encode(as_col(c))


def search_url(site: str, query: Column | str) -> Column:
    before, after = lx.SEARCH_URLS[site].split("{q}")
    return F.concat(F.lit(before), url_plus(query), F.lit(after))


def title_features(c: Column | str) -> Column:
    """(models, words) struct so a title is tokenised once however often it is compared."""
    folded = folded_lower(c)
    return F.struct(
        _models(folded).alias("models"),
        F.array_distinct(_significant(folded, 12)).alias("words"),
    )


def feature_similarity(a: Column, b: Column) -> Column:
    """Similarity of two ``title_features`` structs."""
    shared = F.size(F.array_intersect(a["words"], b["words"])).cast("double")
    union = F.size(a["words"]) + F.size(b["words"]) - shared
    both = (F.size(a["models"]) > 0) & (F.size(b["models"]) > 0)
    return (
        F.when(both & F.arrays_overlap(a["models"], b["models"]), F.lit(1.0))
        .when(both, F.lit(0.15))
        .when((F.size(a["words"]) == 0) | (F.size(b["words"]) == 0), F.lit(0.0))
        .otherwise(shared / union)
    )


def title_similarity(a: Column | str, b: Column | str) -> Column:
    return feature_similarity(title_features(a), title_features(b))


def score_similarity(title: Column | str, other: Column | str) -> Column:
    other = as_col(other)
    return F.when(F.coalesce(other, F.lit("")) == "", F.lit(0.6)).otherwise(title_similarity(title, other))


def multipack_count(title: Column | str) -> Column:
    n = F.regexp_extract(F.lower(as_col(title)), lx.MULTIPACK, 1)
    n = n.try_cast("int")
    return F.when(n.between(2, 24), n).otherwise(F.lit(1))


def any_term(text: Column, terms: list[str]) -> Column:
    return text.rlike(term_pattern(terms))


def term_pattern(terms: list[str]) -> str:
    return r"\b(?:" + "|".join(terms) + r")\b"


def first_term(text: Column, terms: list[str]) -> Column:
    """Alphabetically first lexicon term found as whole words; null when none is."""
    hits = [F.when(text.rlike(term_pattern([t])), F.lit(t)) for t in sorted(terms)]
    return F.coalesce(*hits)
