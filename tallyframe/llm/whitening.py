"""Whitening of vectors on distributed block matrices of Spark MLlib.

Centred rows are cut into blocks inside their own tasks and indexed by them, so no row is shuffled to
be numbered. The scatter matrix is the transpose times the blocks: its long middle dimension is split,
so no task gathers more than a few blocks, and one square matrix of the vectors' dimension reaches
the driver, where its eigenvectors are found. For the projection the same blocks are laid out in a
square grid and multiplied by a block-diagonal of whitening matrices: MLlib deals its products out by
grid, and a single column of blocks would meet in the square root of the partitions only.

Sums, means and distances are exact integers; centring comes before any product, so a common offset
of the vectors costs no digits. Bounds: the driver holds a few dimension x dimension matrices, and the
multiplication lists the numbers of the blocks there, one for each 2^20 entries (8 MB).
"""

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix, MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DataType,
    DecimalType,
    DoubleType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from tallyframe.session import materialise

BLOCK_ENTRIES = 1 << 20
# Blocks of either side that meet in one task of a scatter product.
BLOCKS_IN_TASK = 4
# Entries from here on are no exact whole numbers as doubles.
LARGEST = 2.0**53
EXACT = DecimalType(38, 0)
LONG_SAFE = 2**62


def quantise(vectors: DataFrame, column: str, scale: float, shift: int) -> DataFrame:
    """``vec_id`` and whole-number points ``x``: the floor of ``scale`` times each entry, plus ``shift``.

    Rows whose vector is null or holds null or non-finite entries go; so do entries beyond 2^53
    after scaling, which have no exact floor. Empty vectors go too. All other columns are left out.
    """
    entries = F.col(column).cast("array<double>")
    scaled = vectors.select("vec_id", F.transform(entries, lambda c: c * F.lit(float(scale))).alias("v"))
    usable = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(LARGEST)))
    return scaled.where((F.size("v") > 0) & usable).select(
        "vec_id", F.transform("v", lambda c: F.floor(c) + F.lit(int(shift)).cast("bigint")).alias("x")
    )


def _matrix_values(matrix: dict) -> np.ndarray:
    """Rows and columns of a dense matrix as Arrow hands it over."""
    rows, columns = matrix["numRows"], matrix["numCols"]
    values = np.asarray(matrix["values"], float)
    return values.reshape(rows, columns) if matrix["isTransposed"] else values.reshape(columns, rows).T


def _dense_fields(values: np.ndarray) -> dict:
    """Fields of a dense matrix, stored row by row."""
    rows, columns = values.shape
    return {
        "type": 1, "numRows": rows, "numCols": columns, "colPtrs": None, "rowIndices": None,
        "values": np.ascontiguousarray(values).ravel(), "isTransposed": True,
    }


def _map_blocks(df: DataFrame, schema: StructType, work) -> DataFrame:
    """``work`` maps an iterator of rows (as dicts) to dicts of ``schema``, one task at a time."""

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)

        def rows():
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {
                        name: _plain(batch.column(k)[i]) for k, name in enumerate(batch.schema.names)
                    }

        for made in work(rows()):
            yield pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) for f in target], schema=target
            )

    return df.mapInArrow(run, schema)


def _plain(value: pa.Scalar):
    """Python value of a scalar; lists of numbers as arrays, matrices as dicts that hold one."""
    if isinstance(value, pa.StructScalar):
        return {name: _plain(value[name]) for name in value.type.names} if value.is_valid else None
    if isinstance(value, pa.ListScalar) and value.is_valid and pa.types.is_floating(value.type.value_type):
        return value.values.to_numpy(zero_copy_only=False)
    return value.as_py()


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """Exact n * x - S; Python integers where 64 bits would not hold them."""
    if not len(x):
        return x
    bound = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
    if bound < LONG_SAFE:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def deviations(spread: np.ndarray) -> list[Decimal | None]:
    """Exact sums of squares per row; None beyond 38 digits."""
    if not len(spread):
        return []
    top = max(abs(int(spread.max())), abs(int(spread.min())))
    wide = spread if top * top * spread.shape[1] < LONG_SAFE else spread.astype(object)
    totals = [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]
    return [v if v < 10**38 else None for v in totals]


def centred_blocks(
    points: DataFrame, n: int, sums: list[int], rows: int, per_part: int
) -> DataFrame:
    """Blocks of ``rows`` centred points, numbered by task and place; zeros fill the last of a task.

    ``points`` must be stored: its partitions are read again and must hold the same rows.
    """
    ids = ArrayType(points.schema["vec_id"].dataType)
    schema = StructType(
        [StructField("block", LongType()), StructField("ids", ids),
         StructField("deviations", ArrayType(EXACT)), StructField("matrix", MatrixUDT())]
    )
    width = len(sums)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        number = TaskContext.get().partitionId() * per_part
        held_ids, held, size = [], [], 0

        def block():
            spread = centred(np.concatenate(held)[:rows], n, sums)
            values = np.zeros((rows, width))
            values[: len(spread)] = spread / n
            made = {"block": [number], "ids": [held_ids[:rows]], "deviations": [deviations(spread)],
                    "matrix": [_dense_fields(values)]}
            return pa.RecordBatch.from_arrays(
                [pa.array(made[f.name], f.type) for f in target], schema=target
            )

        for batch in batches:
            held_ids += batch["vec_id"].to_pylist()
            held.append(batch["x"].flatten().to_numpy().reshape(-1, width))
            size += batch.num_rows
            while size >= rows:
                yield block()
                held_ids, held, size = held_ids[rows:], [np.concatenate(held)[rows:]], size - rows
                number += 1
        if size:
            yield block()

    return points.select("vec_id", "x").mapInArrow(run, schema)


def block_matrix(
    blocks: DataFrame, across: int, rows: int, columns: int, count: int
) -> BlockMatrix:
    """Blocks numbered below ``count`` as a matrix with ``across`` blocks to a row of blocks."""
    place = F.struct(
        F.floor(F.col("block") / across).cast("bigint"),
        F.pmod("block", F.lit(across)).cast("bigint"),
    )
    down = math.ceil(count / across)
    java = callMLlibFunc(
        "createBlockMatrix", blocks.select(place, "matrix"), rows, columns, down * rows, across * columns
    )
    return BlockMatrix(java, rows, columns)


def scatter(blocks: DataFrame, rows: int, columns: int, count: int) -> np.ndarray:
    """Transpose times matrix, on the driver as a square array.

    Scala's multiplication takes the number of splits of the middle dimension, Python's wrapper of
    it does not; without them all blocks would meet in one task.
    """
    matrix = block_matrix(blocks, 1, rows, columns, count)
    splits = max(math.ceil(count / BLOCKS_IN_TASK), 1)
    product = matrix.transpose()._java_matrix_wrapper.call(
        "multiply", matrix._java_matrix_wrapper._java_model, splits
    )
    return BlockMatrix(product, columns, columns).toLocalMatrix().toArray()


def principal_axes(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Falling eigenvalues and their unit vectors; those that are zero but for rounding are left out."""
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1], axes[:, ::-1]
    floor = max(values[0], 0) * len(values) * np.finfo(float).eps * 8
    kept = min(int((values > floor).sum()), components)
    return values[:kept], axes[:, :kept]


def project(blocks: DataFrame, axes: np.ndarray, rows: int, count: int) -> DataFrame:
    """Every block times ``axes``, by its number: block multiplication in a square grid."""
    spark = blocks.sparkSession
    width, kept = axes.shape
    across = math.ceil(math.sqrt(count))
    diagonal = spark.sparkContext.parallelize(
        [((j, j), DenseMatrix(width, kept, axes.ravel(order="F"))) for j in range(across)],
        min(across, spark.sparkContext.defaultParallelism),
    )
    axes_matrix = BlockMatrix(diagonal, width, kept, across * width, across * kept)
    product = block_matrix(blocks, across, rows, width, count).multiply(axes_matrix)
    return callMLlibFunc("getMatrixBlocks", product._java_matrix_wrapper._java_model).select(
        (F.col("_1._1") * F.lit(across) + F.col("_1._2")).cast("bigint").alias("block"),
        F.col("_2").alias("matrix"),
    )


def identity_error(projected: DataFrame, rows: int, kept: int, count: int, n: int) -> float:
    """Largest absolute entry of the projected rows' own covariance minus the identity."""
    size = F.size("ids").alias("n_ids")

    def totals(rows_):
        for row in rows_:
            yield {"component": list(range(kept)),
                   "total": _matrix_values(row["matrix"])[: row["n_ids"]].sum(axis=0)}

    schema = StructType([StructField("component", IntegerType()), StructField("total", DoubleType())])
    sums = _map_blocks(projected.select(size, "matrix"), schema, totals)
    means = np.zeros(kept)
    for row in sums.groupBy("component").agg(F.sum("total").alias("total")).collect():
        means[row.component] = row.total / n

    def shifted(rows_):
        for row in rows_:
            values = np.zeros((rows, kept))
            part = _matrix_values(row["matrix"])[: row["n_ids"]]
            values[: len(part)] = part - means
            yield {"block": [row["block"]], "matrix": [_dense_fields(values)]}

    schema = StructType([StructField("block", LongType()), StructField("matrix", MatrixUDT())])
    shifted_blocks = _map_blocks(projected.select("block", size, "matrix"), schema, shifted)
    covariance = scatter(shifted_blocks, rows, kept, count) / n
    return float(np.abs(covariance - np.eye(kept)).max())


def result_schema(vec_id: DataType) -> StructType:
    return StructType(
        [StructField("vec_id", vec_id), StructField("component", IntegerType()),
         StructField("n", LongType()), StructField("deviation", EXACT),
         StructField("whitened", DoubleType()), StructField("explained", DoubleType()),
         StructField("identity_error", DoubleType())]
    )


def whiten(points: DataFrame, components: int = 32) -> DataFrame:
    """Whitened components of every point; one row per point and component.

    ``points`` has ``vec_id`` and whole numbers ``x`` (see ``quantise``). All rows are fitted and
    projected, repeated rows and ids as often as they come, null ids too. ``deviation`` is the exact
    squared distance of n * x from the sum of all points (null beyond 38 digits), ``explained`` the
    component's share of the variance, ``identity_error`` the largest difference of the whitened
    rows' covariance from the identity. Components without variance are left out, so equal points,
    a single one and an empty table give no rows. Vectors of another length than the commonest (of
    equally common ones the longest) are no points of this space and are left out. Other columns
    are ignored.
    """
    spark = points.sparkSession
    points = materialise(points.select("vec_id", "x"))
    schema = result_schema(points.schema["vec_id"].dataType)
    lengths = points.groupBy(F.size("x").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("width")).first()
    if common is None:
        return spark.createDataFrame([], schema)
    width, n = common.width, common.n
    points = points.where(F.size("x") == width)
    summed = points.select(F.posexplode("x").alias("place", "v")).groupBy("place").agg(F.sum("v").alias("s"))
    sums = [0] * width
    for row in summed.collect():
        sums[row.place] = row.s
    largest = points.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    rows = min(max(BLOCK_ENTRIES // width, 1), largest)
    per_part = math.ceil(largest / rows)
    count = points.rdd.getNumPartitions() * per_part
    blocks = materialise(centred_blocks(points, n, sums, rows, per_part))
    covariance = scatter(blocks, rows, width, count) / n
    values, axes = principal_axes(covariance, components)
    kept = len(values)
    if not kept:
        return spark.createDataFrame([], schema)
    matrices = project(blocks, axes / np.sqrt(values), rows, count)
    projected = materialise(blocks.drop("matrix").join(matrices, "block"))
    error = identity_error(projected, rows, kept, count, n)
    explained = values / np.trace(covariance)

    def result(rows_):
        for row in rows_:
            part = _matrix_values(row["matrix"])[: len(row["ids"])]
            size = len(part) * kept
            yield {
                "vec_id": [i for i in row["ids"] for _ in range(kept)],
                "component": np.tile(np.arange(1, kept + 1, dtype=np.int32), len(part)),
                "n": np.full(size, n),
                "deviation": [d for d in row["deviations"] for _ in range(kept)],
                "whitened": part.ravel(),
                "explained": np.tile(explained, len(part)),
                "identity_error": np.full(size, error),
            }

    return _map_blocks(projected.select("ids", "deviations", "matrix"), schema, result)
