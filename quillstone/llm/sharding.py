"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix.

How many rows of each partition go to each shard is drawn first, with the law that
a uniform shuffle of all rows gives these numbers: row sums are the partitions'
sizes, column sums the shards'. Rows are then permuted within their partition by
dealing out its numbers in random order, exchanged, and permuted again within
their shard. No step sees all rows, and the sizes are exact without counting.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quillstone.llm.common import materialise, unused

#: Rows of a shard that are put in order by one task, about.
SLICE_ROWS = 8192
#: Above so many rows numpy draws no hypergeometric numbers.
NUMPY_MOST = 10**9
#: Bits of ``monotonically_increasing_id`` below the partition's number.
POSITION_BITS = 33


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Of ``draws`` out of good + bad rows without replacement, how many are good."""
    if good + bad < NUMPY_MOST:
        return int(rng.hypergeometric(good, bad, draws))
    low, high = max(0, draws - bad), min(good, draws)
    total = good + bad
    deviation = (draws * (good / total) * (bad / total) * ((total - draws) / max(1, total - 1))) ** 0.5
    mode = min(max((draws + 1) * (good + 1) // (total + 2), low), high)
    reach = int(15 * deviation) + 50  # what lies beyond weighs less than one rounding of the sum
    a, b = max(low, mode - reach), min(high, mode + reach)
    x = np.arange(a, b, dtype=np.float64)
    rising = np.log(good - x) + np.log(draws - x) - np.log(x + 1) - np.log(bad - draws + x + 1)
    weights = np.concatenate([[0.0], np.cumsum(rising)])
    chances = np.cumsum(np.exp(weights - weights.max()))
    return a + int(np.searchsorted(chances, rng.random() * chances[-1], "right"))


def drawn(rng: np.random.Generator, sizes: np.ndarray, draws: int) -> np.ndarray:
    """How many of ``draws`` rows fall on each of the shards with so many places left, one after another."""
    found, left = np.zeros_like(sizes), int(sizes.sum())
    for k, size in enumerate(sizes.tolist()):
        left -= size
        found[k] = hypergeometric(rng, size, left, draws) if draws else 0
        draws -= int(found[k])
    return found


def matrix_row(counts: np.ndarray, sizes: np.ndarray, part: int, seed: int) -> np.ndarray:
    """One partition's row of the matrix: down a binary tree over the partitions, whose nodes are drawn alike by every task that passes them.

    counts: rows of each partition, sizes: of each shard, of equal sums.
    """
    sums = np.concatenate([[0], np.cumsum(counts)])
    low, high, places = 0, len(counts), sizes.astype(np.int64)
    while high - low > 1:
        middle = (low + high) // 2
        left = drawn(np.random.default_rng([seed, 0, low, high]), places, int(sums[middle] - sums[low]))
        low, high, places = (low, middle, left) if part < middle else (middle, high, places - left)
    return places


def shard_sizes(rows: int, shards: int) -> np.ndarray:
    """Sizes that differ by one at most, the first ones larger."""
    return rows // shards + (np.arange(shards) < rows % shards)


def shuffled(docs: DataFrame, shards: int = 16, seed: int = 1, shard_column: str = "shard", slot_column: str = "slot", slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``docs`` with shard and slot, gapless from 0 in each shard: a uniform shuffle of all rows, equal ones too, into shards whose sizes differ by one at most.

    The rows are written once, which fixes partitions and order within them, so
    that lost executors redo the same draws. One number per partition comes to
    the driver and goes to the tasks. Whole rows move once, by shard and slice of
    it. Nothing looks at values: nulls, ties, long texts and further columns are
    of no effect; columns of the two new names are replaced. An empty table gives
    no rows.
    """
    docs = docs.drop(shard_column, slot_column)
    names = docs.columns
    row, slice_, key = (unused(n, [*names, shard_column, slot_column]) for n in ("row_", "slice_", "key_"))
    written = materialise(docs.withColumn(row, F.monotonically_increasing_id()), "shuffle-rows")
    part = F.shiftright(row, POSITION_BITS)
    sizes = sorted(written.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    places = {r.part: k for k, r in enumerate(sizes)}
    counts = np.array([r.n for r in sizes], np.int64)
    total = int(counts.sum())
    capacities = shard_sizes(total, shards)
    slices = max(1, -(-total // (shards * slice_rows)))
    mask = (1 << POSITION_BITS) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, labels, keys = None, None, None
        for batch in batches:
            ids = batch.column(row).to_numpy()
            shard, random = np.zeros(len(ids), np.int32), np.zeros(len(ids), np.int64)
            parts = ids >> POSITION_BITS
            for p in np.unique(parts):
                if p != held:
                    held, place = p, places[int(p)]
                    rng = np.random.default_rng([seed, 1, place])
                    labels = rng.permutation(np.repeat(np.arange(shards, dtype=np.int32), matrix_row(counts, capacities, place, seed)))
                    keys = rng.integers(0, 1 << 62, len(labels))
                own = parts == p
                shard[own], random[own] = labels[ids[own] & mask], keys[ids[own] & mask]
            # a random number's upper bits choose the slice
            sliced = ((random >> 31) * slices >> 31).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(sliced), pa.array(random)], names=[*batch.schema.names, shard_column, slice_, key])

    def dealt(rows: DataFrame) -> DataFrame:
        schema = T.StructType([*rows.schema.fields, T.StructField(shard_column, T.IntegerType()), T.StructField(slice_, T.IntegerType()), T.StructField(key, T.LongType())])
        return rows.mapInArrow(run, schema)

    # ids alone tell how many rows each slice gets, and so where it begins
    held = dealt(written.select(row)).groupBy(shard_column, slice_).agg(F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(shard_column).orderBy(slice_)) - F.col("n_")
    begins = held.select(shard_column, slice_, before.alias("begin_"))
    order = Window.partitionBy(shard_column, slice_).orderBy(key, row)
    placed = dealt(written).withColumn(slot_column, F.row_number().over(order).cast("bigint"))
    begin = unused("begin_", placed.columns)
    placed = placed.join(begins.withColumnRenamed("begin_", begin), [shard_column, slice_])
    return placed.withColumn(slot_column, F.col(begin) + F.col(slot_column) - 1).select(*names, shard_column, slot_column)


def write(docs: DataFrame, path: str, shards: int = 16, seed: int = 1) -> None:
    """The shuffled rows as a folder per shard, with their slots."""
    shuffled(docs, shards, seed).write.partitionBy("shard").parquet(path)
