"""Quality rules per document, and per host.

A document fails by its own counts. Failures are summed per host, the failure rate of a host is
shrunk towards the corpus by a beta prior fitted to all hosts (moments), and every document of a
host whose shrunk rate is above ``max_host_rate`` is rejected too.

Defined cases: a missing text is an empty one (no words, so it fails); a document without a host is
judged by its own counts; repeated rows count each and get the same verdict; an empty table gives
an empty result; a very long text counts whole, in one row; columns of the input other than id, text and
host are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.llm.common import DOC_KEY, SPACE_CHARS, WORD, let, packed_rows, same_doc, stored, whole, words

SYMBOLS = "#*$%&|<>"
RUN = 5
SALTS = 64
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _repeat_words(w: Column) -> Column:
    """Words inside a run of ``RUN`` words that is found twice or more in ``w``."""
    starts = F.size(w) - (RUN - 1)
    runs = F.transform(
        F.sequence(F.lit(0), starts - 1), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(RUN)]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda at, j: F.least(F.lit(RUN), F.coalesce(F.get(p, j + 1) - at, F.lit(RUN))))
        return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

    def repeated(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda v, i: F.struct(v.alias("h"), i.alias("i"))))
        places = let(ordered, lambda s: F.sort_array(F.filter(
            F.transform(s, lambda e, j: F.when(
                e["h"].eqNullSafe(F.get(s, j - 1)["h"]) | e["h"].eqNullSafe(F.get(s, j + 1)["h"]), e["i"])),
            lambda i: i.isNotNull())))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(places, covered))

    return F.when(starts < 2, F.lit(0)).otherwise(let(runs, repeated))


def text_counts(text: Column) -> Column:
    """The counts that the rules look at, as one struct."""
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    return let(words(text), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate(text, SPACE_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        let(lines, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long")).alias("n_dup_lines"),
        _repeat_words(w).cast("long").alias("n_repeat_words"),
    ))


def rule_failures(docs: DataFrame, host: str = "source", min_words: int = 10, max_repeat_percent: int = 20) -> DataFrame:
    """One small row per document: key, host, counts and ``base_failed``. Written to the shared
    root, since the host rates and the verdicts both read it."""
    out = docs.select(
        F.col("doc_id").alias(DOC_KEY[0]), F.xxhash64(whole()).alias(DOC_KEY[1]), F.col(host).alias("_gf_host"),
        text_counts(whole()).alias("c"))
    c = F.col("c")
    failed = (c["n_words"] < min_words) | (100 * c["n_repeat_words"] > max_repeat_percent * c["n_words"])
    return stored(out.select(*DOC_KEY, "_gf_host", *[c[n].alias(n) for n in COUNTS], failed.alias("base_failed")), "rules")


def host_rates(failures: DataFrame) -> DataFrame:
    """Failure rate per host, raw and shrunk.

    With mean m and variance v of the rates, both weighted by documents, the prior is
    Beta(m k, (1-m) k) with k = m (1-m) / v - 1. Equal rates (v = 0) or a spread as wide as a coin's
    give k = ``inf`` or 0: full shrinkage or none.
    """
    hosts = failures.where(F.col("_gf_host").isNotNull()).groupBy("_gf_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed"))
    mean = hosts.agg(F.sum("n").alias("_n"), F.sum("failed").alias("_f")).select(
        "_n", F.try_divide(F.col("_f").cast("double"), F.col("_n")).alias("_m"))
    rated = hosts.crossJoin(F.broadcast(mean)).withColumn("rate", F.col("failed") / F.col("n"))  # one row
    spread = rated.agg((F.sum(F.col("n") * (F.col("rate") - F.col("_m")) ** 2) / F.first("_n")).alias("_v"))
    m, v = F.col("_m"), F.col("_v")
    k = F.when(v > 0, F.greatest(m * (1 - m) / v - 1, F.lit(0.0)))
    shrunk = F.when(k.isNull(), m).otherwise((F.col("failed") + m * k) / (F.col("n") + k))
    return rated.crossJoin(F.broadcast(spread)).select(  # one row
        "_gf_host", "n", "failed", "rate", shrunk.alias("shrunk_rate"))


def quality_verdicts(docs: DataFrame, host: str = "source", max_host_rate: float = 0.5, **rules) -> DataFrame:
    """Per row of ``docs``: key, counts, ``base_failed`` and ``kept``."""
    failures = rule_failures(docs, host, **rules)
    # a host may hold a third of all documents: the short side carries every salt
    bad = host_rates(failures).where(F.col("shrunk_rate") > max_host_rate).select(
        F.col("_gf_host").alias("_bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    salt = F.pmod(F.hash(failures["_gf_hash"], failures["_gf_id"]), F.lit(SALTS))
    judged = failures.join(bad, (failures["_gf_host"] == bad["_bad"]) & (salt == bad["_salt"]), "left")
    return judged.select(
        *DOC_KEY, *COUNTS, "base_failed", (~F.col("base_failed") & F.col("_bad").isNull()).alias("kept"))


def keep_good(docs: DataFrame, **rules) -> DataFrame:
    """The rows of ``docs``, all columns, without the rejected ones."""
    rejected = quality_verdicts(docs, **rules).where(~F.col("kept")).select(*DOC_KEY).distinct()
    rows = packed_rows(docs)
    return rows.join(rejected, same_doc(rows, rejected), "left_anti").select("_gf_row.*")
