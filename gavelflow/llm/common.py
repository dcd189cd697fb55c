"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gavelflow.session import shared_dir

#: Words and the space between them, the same in Java, Python and SQL.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

DOC_KEY = ("_gf_id", "_gf_hash")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once. The optimizer copies a projected expression
    into every place that uses it, also into the lambda of a higher-order function, where it would
    be repeated for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def whole(text: str = "text") -> Column:
    """The text, a missing one read as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def doc_key(doc_id: str = "doc_id", text: str = "text") -> list[Column]:
    """Names a document by id and text hash, so that rows that share an id, or have none, stay
    apart unless they repeat each other. Joins on it must be null-safe (``same_doc``)."""
    return [F.col(doc_id).alias(DOC_KEY[0]), F.xxhash64(whole(text)).alias(DOC_KEY[1])]


def packed_rows(docs: DataFrame) -> DataFrame:
    """The whole row in one struct, next to its key: columns of the input cannot clash with ours."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_gf_row"), *doc_key())


def same_doc(left: DataFrame, right: DataFrame) -> Column:
    """Null-safe equality on the document key."""
    return left["_gf_id"].eqNullSafe(right["_gf_id"]) & (left["_gf_hash"] == right["_gf_hash"])


def on_doc(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join by document key, null-safe, with the key of the left side; also for tables that come from
    one another."""
    other = right.withColumnsRenamed({"_gf_id": "_gf_id2", "_gf_hash": "_gf_hash2"})
    on = F.col("_gf_id").eqNullSafe(F.col("_gf_id2")) & (F.col("_gf_hash") == F.col("_gf_hash2"))
    return left.join(other, on, how).drop("_gf_id2", "_gf_hash2")


def with_columns_replaced(row: str, names: Sequence[str], new: dict[str, Column]) -> list[Column]:
    """The fields of struct ``row`` in order; those named in ``new`` are replaced in place, the
    others of ``new`` are appended."""
    kept = [(new[c].alias(c) if c in new else F.col(f"{row}.`{c}`")) for c in names]
    return kept + [c.alias(n) for n, c in new.items() if n not in names]


def stored(df: DataFrame, what: str, compression: str = "zstd") -> DataFrame:
    """The rows written as Parquet to a new folder under the shared root and read back. It cuts the
    lineage as ``checkpoint()`` does, but in one pass; a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gavelflow-llm/{what}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
