"""Removal of lines that are spread over many sites.

Each distinct line gets a HyperLogLog sketch of the sites it stands on; sketches merge in the
aggregation. Where the estimate is close to the threshold, the sites are counted exactly. A line on
``min_sites`` sites or more is boilerplate: it is cut from every document but the first that holds
it (smallest id, then text hash, then position), so that copies of one page do not erase each other.

Lines are compared without the white space around them; a line of one word counts like any other, lines
without words are left alone (``min_words`` leaves more alone). A line is named by 96 bits of hash.

Defined cases: a missing text is empty; a missing site counts as none; repeated rows (same id and
text) are one document and get the same result; a long text counts whole, its lines a row each; without
rows there is no result. Result columns
replace columns of the input that have the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import DOC_KEY, SPACE_CHARS, doc_key, packed_rows, same_doc, whole, with_columns_replaced, words

LINE = ["_h1", "_h2"]
SALTS = 32


def _lines(docs: DataFrame, site: str, min_words: int) -> DataFrame:
    """One row per line worth a look: document key, position, line hash, site."""
    rows = docs.select(*doc_key(), F.col(site).alias("_site"), F.posexplode(F.split(whole(), "\n")).alias("_pos", "_line"))
    line = F.btrim(F.col("_line"), F.lit(SPACE_CHARS))
    return rows.where(F.size(words(F.col("_line"))) >= min_words).select(
        *DOC_KEY, "_pos", "_site", F.xxhash64(line).alias("_h1"), F.hash(line).alias("_h2"))


def spread_lines(docs: DataFrame, site: str = "source", min_sites: int = 8, min_words: int = 1, lg_k: int = 12, band: float = 0.25) -> DataFrame:
    """Hashes of the boilerplate lines with the first place of each (``_first``).

    A sketch of 2^12 registers is off by 1.6 % (one sigma); ``band`` is far wider, so that only lines
    inside it can be on the wrong side, and those are counted exactly.
    """
    lines = _lines(docs, site, min_words)
    known = lines.groupBy(*LINE).agg(
        F.count(F.lit(1)).alias("_n"), F.hll_sketch_agg(F.col("_site").cast("string"), lg_k).alias("_sites"),
        F.min(F.struct(*DOC_KEY, "_pos")).alias("_first"))
    known = known.where(F.col("_n") >= min_sites).withColumn("_about", F.hll_sketch_estimate("_sites"))
    known = known.where(F.col("_about") >= min_sites * (1 - band)).select(*LINE, "_first", "_about")
    sure = F.col("_about") > min_sites * (1 + band)
    near = known.where(~sure)
    exact = lines.where(F.col("_site").isNotNull()).join(near.select(*LINE), LINE, "left_semi")
    exact = exact.select(*LINE, F.col("_site").cast("string")).distinct().groupBy(*LINE).agg(F.count(F.lit(1)).alias("_exact"))
    proven = near.join(exact.where(F.col("_exact") >= min_sites).select(*LINE), LINE, "left_semi")
    return known.where(sure).unionByName(proven).select(*LINE, "_first")


def strip_boilerplate(docs: DataFrame, site: str = "source", min_words: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines cut from ``text``, and ``n_lines``, ``n_removed``."""
    spread = spread_lines(docs, site, min_words=min_words, **options)
    # a common line would be one key: both sides carry a salt, the short one all of them
    spread = spread.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lines = _lines(docs, site, min_words).drop("_site").withColumn("_salt", F.pmod(F.hash("_gf_hash", "_pos"), F.lit(SALTS)))
    here = F.struct(*DOC_KEY, "_pos")
    cut = lines.join(spread, [*LINE, "_salt"]).where(~here.eqNullSafe(F.col("_first")))
    cut = cut.groupBy(*DOC_KEY).agg(F.collect_set("_pos").alias("_cut"))
    rows = packed_rows(docs)
    joined = rows.join(cut, same_doc(rows, cut), "left").select("_gf_row", "_cut")
    text = F.coalesce(F.col("_gf_row.text").cast("string"), F.lit(""))
    pieces = F.split(text, "\n")
    keep = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(pieces) - 1), F.col("_cut")))
    left = F.array_join(F.transform(F.arrays_zip(F.array(pieces).alias("p"), F.array(keep).alias("k")), lambda z: F.array_join(
        F.transform(z["k"], lambda i: F.get(z["p"], i)), "\n")), "")
    return joined.select(*with_columns_replaced("_gf_row", docs.columns, {
        "text": F.when(F.col("_cut").isNull(), F.col("_gf_row.text")).otherwise(left),
        "n_lines": F.size(pieces).cast("long"),
        "n_removed": F.coalesce(F.size("_cut"), F.lit(0)).cast("long"),
    }))
