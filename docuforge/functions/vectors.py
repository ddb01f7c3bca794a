"""Vector functions.  Stored as floats, computed as doubles.

The column forms suit short vectors and stay on the JVM; ``cosine_batch`` multiplies
blocks of vectors and of queries as matrices, for long vectors or many queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_literal(v) -> Column:
    return F.array(*[F.lit(float(x)) for x in v]) if len(v) else F.array().cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """0 if the lengths differ."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    same = F.size(a) == F.size(b)
    return F.when(same, F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)).otherwise(0.0)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Clamped to [-1, 1]; 0 if the lengths differ or a norm is 0."""
    length = norm(a) * norm(b)
    return F.when((F.size(a) != F.size(b)) | (length == 0), 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(length == 0, 1.0).otherwise(length))))


def score(a: Column, b: Column, mode: str = "cosine") -> Column:
    return {"dot": dot, "cosine": cosine}[mode](a, b)


def hybrid(vector: Column, keyword: Column, metadata: Column, weights: tuple[float, float, float]) -> Column:
    """Weighted mean of the scores, clamped to [0, 1]; 0 if the weights sum to 0 or less."""
    total = float(sum(weights))
    if total <= 0:
        return F.lit(0.0)
    mean = (vector * F.lit(float(weights[0])) + keyword * F.lit(float(weights[1])) + metadata * F.lit(float(weights[2]))) / F.lit(total)
    return F.least(F.greatest(mean, F.lit(0.0)), F.lit(1.0))


def normalized(a: Column) -> Column:
    return F.when(norm(a) == 0, a.cast("array<double>")).otherwise(F.transform(a.cast("array<double>"), lambda x: x / norm(a)))


def to_bytes(v) -> bytes:
    """Little-endian 32-bit floats."""
    return np.asarray(v, "<f4").tobytes()


def from_bytes(blob: bytes) -> list[float]:
    if len(blob) % 4:
        raise ValueError(f"invalid vector byte length {len(blob)}")
    return np.frombuffer(blob, "<f4").tolist()


def centroids(vectors: DataFrame, key: str, vector_col: str) -> DataFrame:
    """(key, centroid array<double>): the mean vector of each key.

    One row a dimension goes into a map-side combined mean, so a hot key costs one
    partial row a task and dimension.  Where lengths differ within a key, longer vectors count up to
    the shortest; null and empty vectors are left out.
    """
    rows = vectors.where(F.size(vector_col) > 0)
    parts = rows.select(key, F.size(vector_col).alias("_n"), F.posexplode(F.col(vector_col)).alias("_i", "_x"))
    means = parts.groupBy(key, "_i").agg(F.avg(F.col("_x").cast("double")).alias("_m"), F.min("_n").alias("_n"))
    whole = means.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_i", "_m"))).alias("_c"), F.min("_n").alias("_n"))
    return whole.select(key, F.transform(F.slice("_c", 1, F.col("_n")), lambda x: x["_m"]).alias("centroid"))


#: A block holds at most this many rows, and about this many bytes.
BLOCK_ROWS, BLOCK_BYTES = 1 << 10, 1 << 22
#: Blocks of each side that meet in one task, on average.
BLOCKS_A_TASK = 2
#: Rows of one Arrow batch of results.
RESULT_ROWS = 1 << 16


def cosine_batch(vectors: DataFrame, queries, vector_col: str, keep: list[str], digits: int | None = None) -> DataFrame:
    """(keep..., query int, cosine) for each vector and query: one matrix product for each slice of a pair of blocks.

    ``queries``: a table (query, ``vector_col``), or a sequence of vectors, numbered from 0.  Both sides are packed in
    blocks, each pair of which meets in one task; neither side is collected or broadcast, and what a worker holds depends on the
    size of a block and of a batch of results, not on either table.  Null vectors, zero vectors and those of another length score 0.
    ``digits``: cosines are rounded to so many decimal places, halves away from 0.
    """
    if not isinstance(queries, DataFrame):
        numbered = [(i, None if v is None else [float(x) for x in v]) for i, v in enumerate(queries)]
        queries = vectors.sparkSession.createDataFrame(numbered, f"query int, `{vector_col}` array<double>")
    queries = queries.select(F.col("query").cast("int"), vector_col)
    n_vectors, n_queries = (max(1, -(-df.count() // (BLOCK_ROWS * BLOCKS_A_TASK))) for df in (vectors, queries))
    left = _blocks(vectors.select(*keep, vector_col), "vectors", n_vectors)
    right = _blocks(queries.repartition(n_queries), "queries", n_queries)  # dealt before, as few rows of a scan may be queries
    schema = vectors.select(*keep).schema.add("query", "integer").add("cosine", "double")
    pairs = left.hint("shuffle_replicate_nl").crossJoin(right)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(*batch.columns):
                yield from _cosines(pa.ipc.open_stream(a.as_buffer()).read_next_batch(), pa.ipc.open_stream(b.as_buffer()).read_next_batch(), digits)

    return pairs.mapInArrow(run, schema)


def _blocks(rows: DataFrame, name: str, parts: int) -> DataFrame:
    """The rows as blocks, Arrow streams of one batch, dealt to ``parts`` partitions; in a fixed order, so that a repeated task packs the same blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            step = max(1, min(BLOCK_ROWS, BLOCK_BYTES * batch.num_rows // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, step))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=[name])

    return rows.sortWithinPartitions(*rows.columns).mapInArrow(run, f"{name} binary").repartition(parts)


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length 1 as rows, filled up with zeros, and their numbers of components (null: -1)."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    m = np.zeros((len(sizes), max(0, sizes.max(initial=0))))
    m[np.arange(m.shape[1]) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length != 0), sizes


def _cosines(vectors: pa.RecordBatch, queries: pa.RecordBatch, digits: int | None) -> Iterator[pa.RecordBatch]:
    """All pairs of two blocks, whose last columns are the vectors, in batches of RESULT_ROWS or one vector's."""
    n, names = vectors.num_columns - 1, [*vectors.schema.names[:-1], "query", "cosine"]
    (a, sizes), (b, wanted) = _units(vectors.column(n)), _units(queries.column(1))
    width = min(a.shape[1], b.shape[1])  # what lies beyond has no partner of its length
    a, b, ids = a[:, :width], b[:, :width].T, queries.column(0).to_numpy(zero_copy_only=False)
    step = max(1, RESULT_ROWS // len(ids))
    for at in range(0, len(a), step):
        cos = np.clip(a[at : at + step] @ b, -1, 1)
        cos[sizes[at : at + step, None] != wanted] = 0.0
        if digits is not None:
            cos = np.copysign(np.floor(np.abs(cos) * 10.0**digits + 0.5), cos) / 10.0**digits
        of = pa.array(np.repeat(np.arange(at, at + len(cos)), len(ids)))
        yield pa.RecordBatch.from_arrays([*(c.take(of) for c in vectors.columns[:n]), pa.array(np.tile(ids, len(cos))), pa.array(cos.ravel())], names=names)
