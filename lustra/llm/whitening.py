"""Whitening of embeddings by MLlib's BlockMatrix.

The entries are made whole numbers, so sums and centring are exact whatever the order of the rows. Centred
rows are numbered into blocks of a fixed number of rows, filled up with rows of zeros, and written once. The
product of the transposed block matrix with the matrix itself is the scatter, of which one small matrix
reaches the driver for ``eigh``; another product with the whitening matrix projects all rows.

MLlib would give all blocks to one task for the scatter, as the product is one block. The middle dimension
is therefore split, so that each task adds up the products of its own blocks first.

Cases: rows whose vector is null, empty or holds a null or non-finite entry are left out, and so are those of
another length than most (the shorter one of two that are as frequent). Repeated rows and ids
count as often as they occur. Components without any variance (below ``LEAST_SHARE`` of the largest) cannot be
whitened and are left out, so a single row, or rows that are all equal, have none and give no rows. An empty table gives no
rows. A ``deviation`` beyond a long is null. Columns that are not named are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from py4j.java_gateway import JavaObject
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import MatrixUDT
from pyspark.mllib.linalg.distributed import BlockMatrix
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lustra.llm.ranks import dense
from lustra.session import materialize

#: Entries become floor(SCALE * entry) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
#: Bytes of a block, and of the blocks that one task multiplies.
BLOCK_BYTES = 1 << 20
TASK_BYTES = 32 << 20
#: Variance below this share of the largest cannot be told from rounding.
LEAST_SHARE = 1e-10
INT64_MAX = (1 << 63) - 1


@dataclass(frozen=True)
class Fit:
    """What the rows have in common: their number, sums by dimension, and the whitening matrix."""

    rows: int
    sums: np.ndarray
    variances: np.ndarray
    vectors: np.ndarray

    @property
    def explained(self) -> np.ndarray:
        """Share of each kept component in the whole variance."""
        kept = self.vectors.shape[1]
        return self.variances[:kept] / self.variances.sum()

    @property
    def matrix(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.variances[: self.vectors.shape[1]])


@dataclass(frozen=True)
class Whitened:
    """The fit, the projected rows, and how far their covariance is from the identity."""

    fit: Fit
    rows: DataFrame
    identity_error: float


def _whole(vectors: DataFrame, id_col: str, vec_col: str, scale: int, offset: int) -> DataFrame:
    """``id, x`` of the rows that can be used."""

    def finite(c: Column) -> Column:
        return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))

    doubles = F.col(vec_col).cast("array<double>")
    usable = (F.size(doubles) > 0) & F.forall(doubles, finite)
    whole = F.transform(doubles, lambda c: F.floor(c * scale) + offset)
    return vectors.filter(F.coalesce(usable, F.lit(False))).select(F.col(id_col).alias("id"), whole.alias("x"))


def _matrix(column: pa.ListArray, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length that occurs: rows, and sums by dimension."""
    totals: dict[int, tuple[int, np.ndarray]] = {}
    for batch in batches:
        x = batch.column("x")
        lengths = np.diff(x.offsets.to_numpy())
        for length in np.unique(lengths).tolist():
            part = _matrix(x.filter(pa.array(lengths == length)), length)
            n, sums = totals.get(length, (0, 0))
            totals[length] = (n + len(part), sums + part.sum(axis=0))
    for length, (n, sums) in totals.items():
        yield pa.RecordBatch.from_pydict({"length": [length], "n": [n], "sums": [sums.tolist()]}, _SUMS)


_SUMS = pa.schema([("length", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def _count(whole: DataFrame) -> tuple[int, np.ndarray] | None:
    """Rows and sums of the most frequent length; one number for each dimension reaches the driver."""
    parts = materialize(whole.select("x").mapInArrow(_sums, "length int, n long, sums array<long>"), "whitening-sums")
    lengths = parts.groupBy("length").agg(F.sum("n").alias("n"))
    most = lengths.orderBy(F.desc("n"), "length").first()
    if most is None:
        return None
    found = (
        parts.filter(F.col("length") == most["length"])
        .select(F.posexplode("sums").alias("at", "sum"))
        .groupBy("at")
        .agg(F.sum("sum").alias("sum"))
        .orderBy("at")
        .collect()
    )
    return most["n"], np.array([r["sum"] for r in found], np.int64)


def _deviations(d: np.ndarray) -> list[int | None]:
    """Sums of squares by row, exact; None beyond a long."""
    largest = float(np.abs(d).max(initial=0))
    if largest * largest * d.shape[1] < INT64_MAX:
        return (d * d).sum(axis=1).tolist()
    exact = (sum(v * v for v in row) for row in d.tolist())
    return [v if v <= INT64_MAX else None for v in exact]


def _blocks(whole: DataFrame, n: int, sums: np.ndarray, height: int) -> DataFrame:
    """``block, ids, deviations, values``: the centred rows in numbered blocks, column by column."""
    width = len(sums)
    id_type = whole.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("ids", T.ArrayType(id_type)),
            T.StructField("deviations", T.ArrayType(T.LongType())),
            T.StructField("values", T.ArrayType(T.DoubleType())),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        held = 0

        def block(part: pa.Table) -> pa.RecordBatch:
            d = n * _matrix(part.column("x").combine_chunks(), width) - sums
            values = np.zeros((height, width))
            values[: len(d)] = d / n
            ids = pa.ListArray.from_arrays([0, len(d)], part.column("id").combine_chunks())
            columns = [ids, pa.array([_deviations(d)], pa.list_(pa.int64())), pa.array([values.ravel(order="F")])]
            return pa.RecordBatch.from_arrays(columns, names=["ids", "deviations", "values"])

        for batch in batches:
            lengths = np.diff(batch.column("x").offsets.to_numpy())
            batch = batch.filter(pa.array(lengths == width))
            kept.append(batch)
            held += len(batch)
            if held >= height:
                rows = pa.Table.from_batches(kept)
                full = held - held % height
                for first in range(0, full, height):
                    yield block(rows.slice(first, height))
                kept, held = rows.slice(full).to_batches(), held - full
        if held:
            yield block(pa.Table.from_batches(kept))

    cut_up = whole.mapInArrow(cut, schema).withColumn("block", F.monotonically_increasing_id())
    return dense(materialize(cut_up, "whitening-blocks"), "block")


def _block_matrix(blocks: DataFrame, count: int, height: int, width: int) -> BlockMatrix:
    """The distributed matrix of ``block, values``; its blocks are made in the JVM."""
    none = F.lit(None).cast("array<int>")
    matrix = F.struct(
        F.lit(1).cast("tinyint").alias("type"),
        F.lit(height).alias("numRows"),
        F.lit(width).alias("numCols"),
        none.alias("colPtrs"),
        none.alias("rowIndices"),
        F.col("values"),
        F.lit(False).alias("isTransposed"),
    )
    place = F.struct(F.col("block").alias("row"), F.lit(0).cast("long").alias("column")).alias("place")
    plain = blocks.select(place, matrix.alias("matrix"))
    # SQL cannot name MLlib's matrix type, but batches that pass through Python can be declared to hold it.
    schema = T.StructType([plain.schema["place"], T.StructField("matrix", MatrixUDT())])
    java = callMLlibFunc("createBlockMatrix", plain.mapInArrow(_same, schema), height, width, count * height, width)
    return BlockMatrix(java, height, width)


def _same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield from batches


def _model(matrix: BlockMatrix) -> JavaObject:
    return matrix._java_matrix_wrapper._java_model


def _scatter(rows: BlockMatrix, tasks: int) -> np.ndarray:
    """Transposed rows times rows, the middle dimension split over the tasks."""
    product = _model(rows.transpose()).multiply(_model(rows), tasks)
    return BlockMatrix(product, rows.colsPerBlock, rows.colsPerBlock).toLocalMatrix().toArray()


def _components(scatter: np.ndarray, n: int, sums: np.ndarray, components: int) -> Fit:
    values, vectors = np.linalg.eigh(scatter / n)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    kept = int(np.count_nonzero(values[:components] > LEAST_SHARE * values[0])) if values[0] > 0 else 0
    return Fit(n, sums, values, vectors[:, :kept])


def _project(rows: BlockMatrix, blocks: DataFrame, fit: Fit) -> DataFrame:
    """``ids, deviations, values``: blocks of the rows times the whitening matrix, column by column."""
    spark = blocks.sparkSession
    height, width, kept = rows.rowsPerBlock, rows.colsPerBlock, fit.matrix.shape[1]
    one = spark.createDataFrame([(0, fit.matrix.ravel(order="F").tolist())], "block long, values array<double>")
    product = rows.multiply(_block_matrix(one, 1, width, kept))
    found = callMLlibFunc("getMatrixBlocks", _model(product)).toDF("place", "matrix")

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place, matrix = batch.columns
            for block, m in zip(place.field(0).to_pylist(), matrix.to_pylist(), strict=True):
                # MLlib may lay a product out row by row.
                z = np.asarray(m["values"]).reshape((height, kept), order="C" if m["isTransposed"] else "F")
                yield pa.RecordBatch.from_pydict({"block": [block], "values": [z.ravel(order="F")]})

    projected = found.mapInArrow(values, "block long, values array<double>")
    meta = blocks.select("block", "ids", "deviations")
    return materialize(meta.join(projected.hint("merge"), "block").drop("block"), "whitened-blocks")


def _identity_error(blocks: DataFrame, n: int, kept: int) -> float:
    """Largest entry of the covariance of the projected rows, less the identity."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((kept + 1, kept))
        for batch in batches:
            for ids, values in zip(batch.column("ids"), batch.column("values"), strict=True):
                z = np.asarray(values.values).reshape(kept, -1)[:, : len(ids)]
                total[:kept] += z @ z.T
                total[kept] += z.sum(axis=1)
        yield pa.RecordBatch.from_pydict({"at": np.arange(total.size), "part": total.ravel()})

    parts = blocks.select("ids", "values").mapInArrow(moments, "at long, part double")
    found = parts.groupBy("at").agg(F.sum("part").alias("sum")).orderBy("at").collect()
    total = np.array([r["sum"] for r in found]).reshape(kept + 1, kept) / n
    covariance = total[:kept] - np.outer(total[kept], total[kept])
    return float(np.abs(covariance - np.eye(kept)).max())


def _rows(blocks: DataFrame, fit: Fit, identity_error: float) -> DataFrame:
    """One row for each vector and component."""
    kept = fit.matrix.shape[1]
    id_type = blocks.schema["ids"].dataType.elementType
    schema = T.StructType(
        [
            T.StructField("id", id_type),
            T.StructField("component", T.IntegerType()),
            T.StructField("n", T.LongType()),
            T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()),
            T.StructField("explained", T.DoubleType()),
            T.StructField("identity_error", T.DoubleType()),
        ]
    )
    explained, n = fit.explained, fit.rows

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                ids, deviations, values = (c.slice(at, 1).flatten() for c in batch.columns)
                rows = len(ids)
                z = values.to_numpy().reshape(kept, -1)[:, :rows]
                each = pa.array(np.repeat(np.arange(rows), kept))
                columns = [
                    ids.take(each),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), rows)),
                    pa.array(np.full(rows * kept, n)),
                    deviations.take(each),
                    pa.array(z.T.ravel()),
                    pa.array(np.tile(explained, rows)),
                    pa.array(np.full(rows * kept, identity_error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return blocks.select("ids", "deviations", "values").mapInArrow(spread, schema)


def whiten(
    vectors: DataFrame,
    id_col: str,
    vec_col: str,
    components: int = COMPONENTS,
    scale: int = SCALE,
    offset: int = OFFSET,
    block_bytes: int = BLOCK_BYTES,
) -> Whitened:
    """Centre, fit and project all usable rows.

    ``rows`` has ``id, component`` (from 1, by falling variance), ``n``, ``deviation`` (sum of squares of n * x less the sums),
    ``whitened``, ``explained`` and ``identity_error``. The dimensions bound what is held at once: a
    matrix of dimensions squared on the driver, and blocks of about ``block_bytes``.
    """
    spark = vectors.sparkSession
    whole = _whole(vectors, id_col, vec_col, scale, offset)
    counted = _count(whole)
    if counted is None:
        return _nothing(spark, whole, np.zeros(0, np.int64), 0)
    n, sums = counted
    height = max(1, block_bytes // (8 * len(sums)))
    blocks = _blocks(whole, n, sums, height)
    count = blocks.count()
    rows = _block_matrix(blocks, count, height, len(sums))
    tasks = max(1, math.ceil(count * block_bytes / TASK_BYTES), spark.sparkContext.defaultParallelism)
    fit = _components(_scatter(rows, tasks), n, sums, components)
    if not fit.matrix.size:
        return _nothing(spark, whole, sums, n)
    projected = _project(rows, blocks, fit)
    error = _identity_error(projected, n, fit.matrix.shape[1])
    return Whitened(fit, _rows(projected, fit, error), error)


def _nothing(spark: SparkSession, whole: DataFrame, sums: np.ndarray, n: int) -> Whitened:
    """A fit without components, and no rows."""
    none = np.zeros((len(sums), 0))
    empty = whole.filter(F.lit(False)).select(
        "id",
        F.lit(0).alias("component"),
        F.lit(0).cast("long").alias("n"),
        F.lit(0).cast("long").alias("deviation"),
        *[F.lit(0.0).alias(c) for c in ("whitened", "explained", "identity_error")],
    )
    return Whitened(Fit(n, sums, np.zeros(0), none), empty, 0.0)
