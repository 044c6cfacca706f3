"""Exact vector search for batches of queries.

Queries and vectors are packed into blocks of bounded size, and each pair of
blocks is scored as one matrix product; only each block's best rows leave Python,
and a window keeps the best of all. Neither side is broadcast or collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.sources.tables import cut, modest_batches

#: Queries and vectors of a block.
BLOCK, ROWS = 1024, 4096
#: Pairs whose differences are held at a time.
PAIRS = 1 << 15


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def score(a: Column, b: Column, distance: str) -> Column:
    """Cosine (0 if a norm is 0), dot product, or 1 / (1 + Euclidean distance)."""
    if distance == "cosine":
        both = norm(a) * norm(b)
        return F.when(both > 0, dot(a, b) / both).otherwise(0.0)
    if distance == "dotproduct":
        return dot(a, b)
    if distance == "euclidean":
        gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
        return 1 / (1 + norm(gap))
    raise ValueError(f"unknown distance: {distance}")


def normalised(value: Column, distance: str) -> Column:
    """Scores on one scale for fusion."""
    if distance == "cosine":
        return (value + 1) / 2
    if distance == "dotproduct":
        return F.when(value <= 0, 0.0).otherwise(value / (1 + value))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def distance_score(distance: Column, kind: str) -> Column:
    """The score of a distance: one less it for cosine, its negative for dot products, 1 / (1 + it) for Euclidean ones."""
    if kind == "cosine":
        return 1 - distance
    if kind == "dotproduct":
        return -distance
    if kind == "euclidean":
        return 1 / (1 + distance)
    raise ValueError(f"unknown distance: {kind}")


def index_choice(index: str) -> dict:
    """What a collection policy's index asks for: exact search, or an approximate index and its parameters; ``neighbours.index_of`` builds it."""
    found = {"flat": {"kind": "exact"}, "quantizedflat": {"kind": "ivfflat", "lists": 100}, "diskann": {"kind": "hnsw", "m": 16, "ef_construction": 64}}.get(index.lower())
    if found is None:
        raise ValueError(f"unknown index: {index}")
    return found


def valid(vector: Column, dims: int) -> Column:
    return vector.isNotNull() & (F.size(vector) == dims) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))


def _scores(vectors: np.ndarray, queries: np.ndarray, distance: str) -> np.ndarray:
    """Scores of pairs; of Euclidean distance the negative squares, which have rounding errors (see ``_least``)."""
    product = vectors @ queries.T
    if distance == "dotproduct":
        return product
    a, b = (vectors**2).sum(axis=1), (queries**2).sum(axis=1)
    if distance == "cosine":
        both = a[:, None] * b[None, :]
        np.sqrt(both, out=both)
        product[both <= 0] = 0
        return np.divide(product, both, out=product, where=both > 0)
    product *= 2
    product -= a[:, None]
    product -= b[None, :]
    return np.minimum(product, 0, out=product)


def _least(edge: np.ndarray, vectors: np.ndarray, queries: np.ndarray, distance: str, digits: int) -> np.ndarray:
    """The least of ``_scores`` by query that can be among the best whose last one is ``edge``, scores being ordered when rounded."""
    tie = 1.001 * 10.0**-digits
    if distance != "euclidean":
        return edge - tie
    error = 4 * (vectors.shape[1] + 4) * np.finfo(float).eps * ((vectors**2).sum(axis=1).max() + (queries**2).sum(axis=1))
    low = 1 / (1 + np.sqrt(error - edge)) - tie
    far = np.divide(1, low, out=np.full_like(low, np.inf), where=low > 0) - 1
    return -(far**2) - error


def _near(vectors: np.ndarray, queries: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean scores of pairs of rows, from their differences."""
    found = np.empty(len(a))
    for at in range(0, len(a), PAIRS):
        part = slice(at, at + PAIRS)
        found[part] = 1 / (1 + np.sqrt(((vectors[a[part]] - queries[b[part]]) ** 2).sum(axis=1)))
    return found


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows of a list column of ``dims`` numbers each, without nulls: its values as they lie."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _packed(rows: DataFrame, size: int, dims: int, prefix: str) -> DataFrame:
    """Blocks of rows with id, grp and vector: arrays of ids and groups, and the vectors' doubles as bytes."""
    kinds = [rows.schema[c].dataType.simpleString() for c in ("id", "grp")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                body = _matrix(part.column(2), dims).astype("<f8").tobytes()
                lists = [pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column(k)) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([body], pa.binary())], names=[f"{prefix}_ids", f"{prefix}_grps", f"{prefix}_body"])

    return rows.select("id", "grp", "vector").mapInArrow(run, f"{prefix}_ids array<{kinds[0]}>, {prefix}_grps array<{kinds[1]}>, {prefix}_body binary")


def _best(values: np.ndarray, k: int, least: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of each column's best ``k`` values; ties at the edge stay in, so that a window can order them."""
    most = min(k, len(values))
    edge = np.partition(values, len(values) - most, axis=0)[len(values) - most]
    return np.nonzero(values >= least(edge))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, distance: str = "cosine", dims: int = 64, min_score: float | None = None, id_column: str = "id", vector_column: str = "vector", group_column: str | None = None, digits: int = 9) -> DataFrame:
    """query_id, id, score and rank (score down, rounded to ``digits``, then id) of each query's best vectors, and with ``group_column`` the group: the best of each group.

    ``queries`` has query_id and vector. All is one pass over the vectors.
    """
    modest_batches(vectors.sparkSession)  # a pair of blocks is 2.5 MB
    group = F.lit(0) if group_column is None else F.col(group_column)
    good = vectors.filter(valid(F.col(vector_column), dims)).select(F.col(id_column).alias("id"), group.alias("grp"), F.col(vector_column).cast("array<double>").alias("vector"))
    asked = queries.filter(valid(F.col("vector"), dims)).select(F.col("query_id").alias("id"), F.lit(0).alias("grp"), F.col("vector").cast("array<double>").alias("vector"))
    # the queries' blocks are written once: each task of the vectors reads them
    blocks = cut(_packed(asked.coalesce(1), BLOCK, dims, "q"))
    pairs = _packed(good, ROWS, dims, "v").join(blocks, how="cross")
    found = _scored(pairs, good, asked, k, distance, dims, digits)
    if min_score is not None:
        found = found.filter(F.col("score") >= min_score)
    by = ["query_id"] if group_column is None else ["query_id", "grp"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.round("score", digits).desc(), "id"))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.drop("grp") if group_column is None else ranked.withColumnRenamed("grp", group_column)


def _scored(pairs: DataFrame, good: DataFrame, asked: DataFrame, k: int, distance: str, dims: int, digits: int) -> DataFrame:
    """query_id, id, grp and score of the best of each pair of blocks, group by group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(name).slice(n, 1) for name in batch.schema.names}
                ids, groups, names = (row[c].flatten() for c in ("v_ids", "v_grps", "q_ids"))
                v, q = (np.frombuffer(row[c][0].as_py(), "<f8").reshape(-1, dims) for c in ("v_body", "q_body"))
                values = _scores(v, q, distance)
                at, query = [], []
                kinds, place = np.unique(groups.to_numpy(zero_copy_only=False), return_inverse=True)
                for kind in range(len(kinds)):
                    own = np.flatnonzero(place == kind)
                    rows, columns = _best(values[own], k, lambda edge, own=own: _least(edge, v[own], q, distance, digits))
                    at.append(own[rows])
                    query.append(columns)
                a, b = np.concatenate(at), np.concatenate(query)
                scores = _near(v, q, a, b) if distance == "euclidean" else values[a, b]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(b)), ids.take(pa.array(a)), groups.take(pa.array(a)), pa.array(scores)], names=["query_id", "id", "grp", "score"])

    kind = lambda df, c: df.schema[c].dataType.simpleString()
    columns = ["v_ids", "v_grps", "v_body", "q_ids", "q_body"]
    return pairs.select(*columns).mapInArrow(run, f"query_id {kind(asked, 'id')}, id {kind(good, 'id')}, grp {kind(good, 'grp')}, score double")
