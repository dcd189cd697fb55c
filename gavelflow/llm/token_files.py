"""Whole texts as token ids in Simple-8b files, in ascending order of document.

Defined cases: a missing text is empty and gives the end id alone; documents that share an id follow
each other by text hash; documents without an id come first and stay without; an empty table gives a
folder without shards that reads back as no rows; a very long text is encoded whole; columns other than id
and text are not read.
"""

from __future__ import annotations

import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gavelflow.llm import simple8b
from gavelflow.llm.common import whole
from gavelflow.session import shared_dir

cloudpickle.register_pickle_by_value(simple8b)  # Spark plans the source in a process of its own


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = 1) -> None:
    """Writes ``doc_id`` and ids of every row to ``path``, a new folder."""
    spark = docs.sparkSession
    spark.dataSource.register(simple8b.Simple8b)
    rows = docs.select(F.col("doc_id").cast("long"), whole().alias("text"))
    # ranges of small keys: their sample goes to the driver
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed.write.format("simple8b").option("tokenizer", tokenizer).option("end_id", end_id).mode("append").save(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ``start`` counts all ids before it."""
    spark.dataSource.register(simple8b.Simple8b)
    return spark.read.format("simple8b").load(path)


def through_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes to a new folder under the shared root and reads it back."""
    path = f"{shared_dir(docs.sparkSession).rstrip('/')}/gavelflow-llm/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, tokenizer, path)
    return read_token_files(docs.sparkSession, path)
