"""The queries of this subpackage; see the operator modules for what they do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import oracle
from gavelflow.llm.common import documents, let
from gavelflow.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    return run


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_line_dedup(spark, sf_dir):
    """Lines found on eight sites or more, cut from all documents but the first."""
    from gavelflow.llm.line_dedup import strip_boilerplate

    out = strip_boilerplate(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


@query
def op2_packing(spark, sf_dir):
    """Pieces of all documents in windows of 2048 ids."""
    from gavelflow.llm.packing import pack

    out = pack(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op3_chat_format(spark, sf_dir):
    """All conversations and one that holds control strings, formatted and read back."""
    from gavelflow.llm import chat_format as chat
    from gavelflow.llm.common import stored

    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    turn = F.col("id")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), turn.alias("turn"), F.when(turn == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"))
    made = chat.format_chats(chat.records(given.unionByName(own)), "record").select("conv_id", "segments")
    back = stored(made, "chats").withColumn("whole", chat.formatted(F.col("segments")))
    turns = chat.parsed(F.col("whole"))
    listed = lambda ts: F.array_join(F.transform(ts, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    digest = let(turns, lambda ts: F.struct(F.size(ts).cast("long").alias("n"), F.sha2(listed(ts), 256).alias("sha")))
    loss = let(chat.learned(F.col("segments")), lambda x: F.struct(F.length(x).cast("long").alias("n"), F.sha2(x, 256).alias("sha")))
    return back.select("conv_id", digest.alias("d"), loss.alias("l"), F.length("whole").cast("long").alias("formatted_chars")).select(
        "conv_id", F.col("d.n").alias("n_turns"), F.col("d.sha").alias("turns_sha256"), F.col("l.n").alias("loss_chars"),
        F.col("l.sha").alias("loss_sha256"), "formatted_chars")


@query
def op4_license_scan(spark, sf_dir):
    """License notices in all documents."""
    from gavelflow.llm.license_scan import license_notices

    return license_notices(documents(spark, sf_dir)).withColumnRenamed("_gf_id", "doc_id").drop("_gf_hash")


@query
def op5_personal_data(spark, sf_dir):
    """Personal data of every document, and the words that give it away."""
    from gavelflow.llm import pii

    out = pii.find_personal_data(documents(spark, sf_dir))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return out.select(
        F.col("_gf_id").alias("doc_id"), *counts, F.sha2(pii.listed(pii.KINDS), 256).alias("base_sha256"),
        pii.listed([*pii.KINDS, "term"]).alias("spans"))


@query
def op6_decontamination(spark, sf_dir):
    """Best match of every benchmark item in every document, within 5 % of edits."""
    from gavelflow.llm.decontaminate import benchmark_hits

    hits = benchmark_hits(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return hits.select(F.col("_gf_id").alias("doc_id"), "item_id", "start", "end", "distance")


@query
def op7_token_files(spark, sf_dir):
    """All documents written to Simple-8b files and read back."""
    from gavelflow.llm.token_files import through_files

    back = through_files(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op8_substring_dedup(spark, sf_dir):
    """Every document without the word runs that stand earlier."""
    from gavelflow.llm.substring_dedup import remove_repeats

    out = remove_repeats(documents(spark, sf_dir))
    return out.select(F.col("_gf_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_quality_rules(spark, sf_dir):
    """Counts of every document and the verdict of its own rules and its host's."""
    from gavelflow.llm.quality_rules import COUNTS, quality_verdicts

    out = quality_verdicts(documents(spark, sf_dir))
    return out.select(F.col("_gf_id").alias("doc_id"), *COUNTS, "base_failed", "kept")


@query
def op10_simhash(spark, sf_dir):
    """Fingerprint and component of every document."""
    from gavelflow.llm.simhash import simhash_components

    out = simhash_components(documents(spark, sf_dir))
    return out.select(
        F.col("_gf_id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op11_whitening(spark, sf_dir):
    """Every usable embedding on the four axes of most variance, whitened."""
    from gavelflow.llm.whitening import whiten

    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select("_gf_id", "n", "deviation", "identity_error", F.inline("axes")).select(
        F.col("_gf_id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("long").alias("deviation"), "whitened",
        "explained", "identity_error")


@query
def op12_lm_scores(spark, sf_dir):
    """Log probability of every text by unigram counts and by the log-bilinear model."""
    from gavelflow.llm.lm_score import score_texts

    out = score_texts(documents(spark, sf_dir))
    return out.select(
        F.col("_gf_id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op13_lexical_search(spark, sf_dir):
    """The 50 best documents of every benchmark item."""
    from gavelflow.llm.lexical_search import ranked

    return ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


@query
def pipeline(spark, sf_dir):
    """The stages of ``corpus_pipeline.py`` over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
