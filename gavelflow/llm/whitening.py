"""Embedding whitening with Spark's block matrices.

Entries become whole numbers on a grid, so that sums and deviations are exact and equal vectors are
equal in every bit. Each distinct vector is fitted once, so a vector that makes up a third of the
table weighs as much as any other. The centred rows get dense numbers and become a BlockMatrix A; the
transpose of A times A, with the middle dimension dealt out, is the scatter; its eigenvectors are found on
the driver (a matrix of dimensions by dimensions); A times the whitening matrix projects the rows.

Bounds: the driver holds the scatter and the sums, both of a size set by the vectors' length; Spark
plans a product from a list of the blocks, of ``BLOCK_ENTRIES`` entries each.

Defined cases: rows whose vector is missing, empty or holds a missing or non-finite entry are left
out, and so are vectors of another length than the commonest (the longer one at a tie); repeated rows give
repeated result rows; components without variance are left out, so a table of equal vectors, like an
empty one, gives an empty result; columns other than id and vector are not read. ``deviation`` is a
decimal, missing where it has over 38 digits. A text has no part here.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from gavelflow.llm.common import stored

GRID = 256
COMPONENTS = 4
BLOCK_ENTRIES = 1 << 19
BLOCK_COLUMNS = 1024


def grid_rows(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """``_gf_id, x`` of the rows with a whole vector; ``x`` has whole numbers."""
    finite = F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.select(F.col(vec_id).alias("_gf_id"), F.col(vector).cast("array<double>").alias("_v"))
    rows = rows.where(F.col("_v").isNotNull() & (F.size("_v") > 0)).where(finite)
    return rows.select("_gf_id", F.transform("_v", lambda c: F.floor(c * GRID)).alias("x"))


def numbered(rows: DataFrame, what: str) -> DataFrame:
    """The rows written out, with ``index`` from 0 without gaps."""
    kept = stored(rows.withColumn("_at", F.monotonically_increasing_id()), what)
    part = F.shiftright("_at", 33)
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))  # a row per partition
    place = F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return kept.join(starts, part == F.col("_part")).select(*rows.columns, place.alias("index"))


def _product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left.multiply(right)``, the blocks of the middle dimension dealt to ``splits`` tasks; Python's own
    method leaves them to one task for each block of the result."""
    made = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(made, left.rowsPerBlock, right.colsPerBlock)


def local_blocks(spark: SparkSession, matrix, rows_per_block: int) -> BlockMatrix:
    """A small local matrix of one block of columns."""
    n, k = matrix.shape
    cut = [(i, matrix[i:i + rows_per_block]) for i in range(0, n, rows_per_block)]
    blocks = [((i // rows_per_block, 0), DenseMatrix(len(m), k, m.flatten(order="F"))) for i, m in cut]
    return BlockMatrix(spark.sparkContext.parallelize(blocks, 1), rows_per_block, k, n, k)


def principal_axes(covariance, most: int):
    """``(falling eigenvalues, their unit vectors as columns)``; without those that rounding alone gives."""
    import numpy as np

    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = int((values > max(values[0], 0.0) * len(values) * np.finfo(float).eps * 8).sum()) if len(values) else 0
    return values[:min(most, real)], vectors[:, :min(most, real)]


def whiten(table: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``_gf_id, x, n, deviation, axes, identity_error`` of every usable row; ``axes`` has the whitened value
    and the explained share of each component, most variance first."""
    import numpy as np

    spark = table.sparkSession
    name = table.schema[vec_id].dataType.simpleString()
    rows = grid_rows(table, vec_id, vector)
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    axis = "struct<component:int,whitened:double,explained:double>"
    empty = spark.createDataFrame(
        [], f"_gf_id {name}, x array<bigint>, n long, deviation decimal(38,0), axes array<{axis}>, identity_error double")
    if not common:
        return empty
    d = common[0]["d"]
    rows = rows.where(F.size("x") == d)
    fit = numbered(rows.select("x").distinct(), "vectors")
    each = fit.select(F.posexplode("x").alias("i", "c")).groupBy("i").agg(F.sum(F.col("c").cast("decimal(20,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    sums = {r["i"]: int(r["s"]) for r in each.collect()}  # one row per dimension
    n = fit.count()
    total = [sums[i] for i in range(d)]
    mean = F.array(*[F.lit(s / n) for s in total])

    centred = fit.select("index", array_to_vector(F.zip_with("x", mean, lambda c, m: c.cast("double") - m)).alias("vector"))
    tall = max(1, BLOCK_ENTRIES // d)
    indexed = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(centred, "vector"), n, d)
    a = indexed.toBlockMatrix(tall, BLOCK_COLUMNS)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scatter = _product(a.transpose(), a, max(1, min(tasks, -(-n // tall)))).toLocalMatrix().toArray()
    covariance = scatter / n
    values, vectors = principal_axes(covariance, components)
    if not len(values):
        return empty
    explained = (values / np.trace(covariance)).tolist()

    made = _product(a, local_blocks(spark, vectors / np.sqrt(values), BLOCK_COLUMNS), 1)
    out = callMLlibFunc("getIndexedRows", made.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    out = MLUtils.convertVectorColumnsToML(out, "vector").select(F.col("index").alias("_i"), vector_to_array("vector").alias("_w"))
    known = stored(fit.join(out, F.col("index") == F.col("_i")).select(F.col("x").alias("_x"), "_w"), "whitened")

    k = len(values)
    errors = [F.abs(F.covar_pop(F.col("_w")[i], F.col("_w")[j]) - float(i == j)) for i in range(k) for j in range(i, k)]
    worst = F.broadcast(known.agg(F.array_max(F.array(*errors)).alias("identity_error")))  # one row
    exact = lambda v: F.lit(str(v)).try_cast("decimal(38,0)")
    add = lambda acc, c: F.try_add(acc, c)
    none = F.lit(0).cast("bigint")
    squares = F.aggregate(F.transform("x", lambda c: F.try_multiply(c, c)), none, add).cast("decimal(38,0)")
    listed = F.array(*[F.lit(str(s)).try_cast("bigint") for s in total])
    crossed = F.aggregate(F.zip_with("x", listed, lambda c, s: F.try_multiply(c, s)), none, add).cast("decimal(38,0)")
    # the sum over (n x - S)^2, from three exact sums
    deviation = F.try_add(F.try_subtract(
        F.try_multiply(exact(n * n), squares), F.try_multiply(exact(2 * n), crossed)).cast("decimal(38,0)"), exact(sum(s * s for s in total))).cast("decimal(38,0)")
    axes = F.transform(F.array(*[F.lit(e) for e in explained]), lambda e, i: F.struct(
        (i + 1).alias("component"), F.get("_w", i).alias("whitened"), e.alias("explained")))
    found = rows.join(known, F.col("x") == F.col("_x"))
    return found.join(worst).select(
        "_gf_id", "x", F.lit(n).cast("long").alias("n"), deviation.alias("deviation"), axes.alias("axes"), "identity_error")
