"""Whitening of embedding vectors with distributed block matrices."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window, functions as F

from curalens.llm.common import landed, prepare

SCALE, SHIFT = 64, 1_000_000
WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def scaled(vector: Column) -> Column:
    """Entries as whole numbers: floor(64 c) + 1,000,000."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE) + F.lit(SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    """Neither null nor empty, without null or non-finite entries."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & F.coalesce(finite, F.lit(False))


def indexed(rows: DataFrame, name: str) -> DataFrame:
    """The rows, landed, with a gapless ``index`` from 0: the place in a part after the rows of the parts before it."""
    at = landed(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), name)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (at.groupBy("_part").agg(F.count("*").alias("_n"))          # one row per part
              .select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return at.join(starts, "_part").withColumn("index", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def block_matrix(rows: DataFrame, n: int, width: int, block_rows: int) -> BlockMatrix:
    """``rows`` (index, values) as blocks of ``block_rows`` whole rows."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("values").alias("vector")), "vector")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(block_rows, width)


def scatter(matrix: BlockMatrix, parallelism: int) -> np.ndarray:
    """Transpose times matrix, brought to the driver: a square of the vector length.

    The product has one block, so the long middle dimension is cut: each group of at most 64 block
    rows is multiplied in a task of its own and the small products are added.
    """
    n_blocks = -(-matrix.numRows() // matrix.rowsPerBlock)
    splits = max(-(-n_blocks // 64), min(n_blocks, parallelism))
    left, right = matrix.transpose()._java_matrix_wrapper._java_model, matrix._java_matrix_wrapper._java_model
    product = BlockMatrix(left.multiply(right, splits), matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def project(matrix: BlockMatrix, axes: np.ndarray) -> DataFrame:
    """Rows times ``axes`` as (index, values)."""
    spark_context = matrix.blocks.context
    block = DenseMatrix(axes.shape[0], axes.shape[1], axes.reshape(-1, order="F").tolist())
    right = BlockMatrix(spark_context.parallelize([((0, 0), block)], 1), axes.shape[0], axes.shape[1])
    product = matrix.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("values"))


def whiten(vectors: DataFrame, components: int = 32, block_rows: int = 2048, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Whitened coordinates of every usable vector, one row per vector and component.

    Vectors become whole numbers x, are centred by the exact mean S/n and cut into a block matrix;
    its transpose times itself is the scatter, whose eigenvectors over the roots of their
    eigenvalues project the rows. ``deviation`` is exact in 64-bit integers; a sum beyond them is an
    error, not a wrong number. ``identity_error`` is measured on the projected rows.

    Vectors that are null, empty or hold null or non-finite entries are left out, as are vectors of
    another length than the most frequent one (the shorter of equally frequent ones): they have no
    place in one covariance. Directions without variance (eigenvalue within rounding of 0) are no
    components, so equal vectors, a single one or an empty table give no rows. Ids may be null or
    repeated; each row is a vector of its own. Other columns are ignored.
    """
    spark = prepare(vectors.sparkSession)
    vector = F.col(vector_col)
    rows = indexed(vectors.where(usable(vector)).select(F.col(id_col).cast("long").alias("vec_id"), scaled(vector).alias("x")), "scaled")
    lengths = rows.groupBy(F.size("x").alias("length")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "length").first()
    nothing = spark.createDataFrame([], WHITENED)
    if lengths is None:
        return nothing
    width, n = lengths["length"], lengths["n"]
    if n < rows.count():                                 # odd lengths: number the others anew, without gaps
        rows = indexed(rows.where(F.size("x") == width).drop("index"), "of_one_length")
    sums = [0] * width
    for r in rows.select(F.posexplode("x").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("s")).collect():
        sums[r["at"]] = r["s"]
    apart = F.zip_with("x", F.array(*[F.lit(s).cast("long") for s in sums]), lambda x, s: x * F.lit(n).cast("long") - s)
    centred = rows.select("index", F.transform(apart, lambda d: d.cast("double") / F.lit(float(n))).alias("values"))

    matrix = block_matrix(centred, n, width, block_rows)
    parallelism = spark.sparkContext.defaultParallelism
    values, axes = np.linalg.eigh(scatter(matrix, parallelism) / n)
    values, axes = values[::-1], axes[:, ::-1]
    total = float(values.sum())
    used = min(components, int((values > total * width * np.finfo(float).eps).sum()))
    if total <= 0 or not used:
        return nothing
    projected = landed(project(matrix, axes[:, :used] / np.sqrt(values[:used])), "whitened")

    means = [0.0] * used
    for r in projected.select(F.posexplode("values").alias("at", "v")).groupBy("at").agg(F.avg("v").alias("m")).collect():
        means[r["at"]] = r["m"]
    again = projected.select("index", F.zip_with("values", F.array(*map(F.lit, means)), lambda v, m: v - m).alias("values"))
    error = float(np.abs(scatter(block_matrix(again, n, used, block_rows), parallelism) / n - np.eye(used)).max())

    shares = F.array(*[F.lit(float(v) / total) for v in values[:used]])
    square = F.aggregate(F.transform(apart, lambda d: d * d), F.lit(0).cast("long"), lambda a, b: a + b)
    return (rows.select("index", "vec_id", square.alias("deviation")).join(projected, "index")
            .select("vec_id", "deviation", F.posexplode("values").alias("_at", "whitened"))
            .select("vec_id", (F.col("_at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                    F.element_at(shares, F.col("_at") + 1).alias("explained"), F.lit(error).alias("identity_error")))
