"""Embedding near-dedup by binary codes after randomised rotations.

A unit vector is rotated at random and coded by its coordinates' signs; with the
stored inner product of vector and code as correction factor, the code gives
unbiased estimates of inner products and their confidence bounds. Groups of bits
of several rotations form buckets in which vectors meet; in a bucket the
estimates' upper bounds tell which pairs may reach the threshold, and just those
are computed again from the vectors.

Equal vectors are one class. Large buckets are cut into blocks, which meet in
pairs in tasks of their own. A link is counted in the first bucket that its
vectors share; buckets give sums and trees, never lists of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.common import materialise, runs_of
from quillstone.llm.components import components

#: Chance that a pair at the threshold shares no bucket; deviations within which an estimate is trusted; rows of a block.
MISS, DEVIATIONS, BLOCK = 1e-4, 4.0, 512


def rotations(dims: int, count: int, seed: int = 5) -> np.ndarray:
    rng = np.random.default_rng(seed)
    found = [np.linalg.qr(rng.standard_normal((dims, dims)))[0] for _ in range(count)]
    return np.concatenate(found) if found else np.zeros((0, dims))


def tables_for(largest: int, threshold: float) -> tuple[int, int]:
    """Bits of a bucket, so that chance meetings stay few, and the tables that the allowed misses take."""
    bits = int(np.clip(math.ceil(math.log2(max(largest, 1) / 8 + 1)), 6, 24))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISS) / math.log1p(-agree))


def _bits(unit: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Each vector's bucket in each table."""
    dims = unit.shape[1]
    signs = unit @ rotations(dims, -(-tables * bits // dims))[: tables * bits].T > 0
    return (signs.reshape(len(unit), tables, bits) * (1 << np.arange(bits))).sum(axis=2)


def _columns(rows: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    vectors = np.stack([np.frombuffer(x, "<f8") for x in rows.column("vec").to_pylist()])
    buckets = np.stack([np.frombuffer(x, "<i4") for x in rows.column("buckets").to_pylist()])
    plain = (rows.column(c).to_numpy() for c in ("table", "low", "high", "block", "cls", "copies"))
    return (*plain, vectors, buckets)


def _meet(group: tuple[np.ndarray, ...], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Classes of a bucket that link, each with the vectors first met here and the least class it is joined to."""
    table, low, high, block, cls, copies, x, buckets = group
    norm = np.linalg.norm(x, axis=1)
    unit = x / norm[:, None]
    dims = x.shape[1]
    turned = unit @ rotations(dims, 1).T
    code = np.where(turned > 0, 1.0, -1.0) / math.sqrt(dims)
    factor = (turned * code).sum(axis=1)
    estimate = code @ turned.T / factor[:, None]
    error = DEVIATIONS / math.sqrt(max(dims - 1, 1)) * np.sqrt(np.maximum(1 - factor**2, 0)) / factor
    maybe = np.triu(estimate + error[:, None] >= threshold, 1)
    if low[0] != high[0]:
        maybe &= block[:, None] != block[None, :]
    a, b = np.nonzero(maybe)
    cosine = np.empty(len(a))
    for at in range(0, len(a), 1 << 16):
        i, j = a[at : at + (1 << 16)], b[at : at + (1 << 16)]
        cosine[at : at + (1 << 16)] = np.einsum("ij,ij->i", x[i], x[j]) / (norm[i] * norm[j])
    linked = cosine >= threshold
    a, b = a[linked], b[linked]
    if not len(a):
        return None
    first = ~(buckets[a, : table[0]] == buckets[b, : table[0]]).any(axis=1)
    met = np.bincount(a[first], copies[b[first]], len(cls)) + np.bincount(b[first], copies[a[first]], len(cls))
    least = cls.copy()
    while True:
        before = least.copy()
        np.minimum.at(least, a, least[b])
        np.minimum.at(least, b, least[a])
        if (least == before).all():
            break
    in_link = np.zeros(len(cls), bool)
    in_link[a] = in_link[b] = True
    return cls[in_link], met[in_link].astype(np.int64), least[in_link]


def dedup(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str | None = "label", threshold: float = 0.98) -> DataFrame:
    """Per row: id, n_links, component_id and kept.

    Two rows link if their labels are equal and not null and the cosine of their
    vectors, of equal length, is the threshold at least. Null, empty and zero
    vectors and those with null or non-finite components link with nothing.
    Repeated rows are vectors of their own and link. The component is named by its
    smallest id, a null id being larger than any other; kept tells whether that is
    the row's own. Vectors are of any length, further columns are ignored. An
    empty table gives no rows.

    A pair just at the threshold shares no bucket with a chance of ``MISS``, and
    its estimate is off by more than ``DEVIATIONS`` with one of 1 in 16,000; pairs
    of a higher cosine are missed less. Every pair found is computed exactly.
    """
    label = F.lit("") if label_column is None else F.col(label_column).cast("string")
    picked = vectors.select(F.col(id_column).alias("id"), label.alias("label"), F.col(vector_column).cast("array<double>").alias("v"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    kind = picked.schema["id"].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [None if v is None else np.asarray(v, "<f8").tobytes() for v in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], names=["id", "label", "vec"])

    rows = picked.select("id", "label", F.when(good, F.col("v")).alias("v")).mapInArrow(pack, f"id {kind}, label string, vec binary")
    rows = materialise(rows, "vectors")
    usable = rows.filter(F.col("vec").isNotNull())
    classes = materialise(usable.groupBy("label", "vec").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")).withColumn("cls", F.monotonically_increasing_id()), "vector-classes")
    largest = classes.groupBy("label", F.octet_length("vec")).count().agg(F.max("count")).first()[0] or 0
    bits, tables = tables_for(largest, threshold)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list = [None] * batch.num_rows
            raw = batch.column("vec").to_pylist()
            for size in {len(x) for x in raw}:
                at = [k for k, x in enumerate(raw) if len(x) == size]
                x = np.stack([np.frombuffer(raw[k], "<f8") for k in at])
                for k, row in zip(at, _bits(x / np.linalg.norm(x, axis=1)[:, None], tables, bits).astype("<i4"), strict=True):
                    found[k] = row
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("vec"), batch.column("copies"), batch.column("cls"), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([x.tolist() for x in found], pa.list_(pa.int32()))], names=["label", "vec", "copies", "cls", "buckets", "each"])

    coded = classes.select("label", "vec", "copies", "cls").mapInArrow(code, "label string, vec binary, copies bigint, cls bigint, buckets binary, each array<int>")
    coded = materialise(coded.withColumn("space", F.xxhash64("label", F.octet_length("vec"))), "vector-codes")
    placed = coded.select("space", "cls", "copies", F.posexplode("each").alias("table", "bucket"))
    sizes = placed.groupBy("space", "table", "bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").withColumn("blocks", F.when(F.col("n") > 2 * BLOCK, F.ceil(F.col("n") / BLOCK)).otherwise(F.lit(1)).cast("int"))
    sizes = materialise(sizes, "vector-buckets")

    # the vectors go only to buckets that others share
    placed = coded.select("space", "cls", "copies", "vec", "buckets", F.posexplode("each").alias("table", "bucket")).join(sizes, ["space", "table", "bucket"])
    placed = placed.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    placed = placed.withColumn("meeting", F.xxhash64("space", "table", "bucket", "low", "high"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches):
            found = _meet(_columns(rows), threshold)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["cls", "met", "least"])

    columns = ["meeting", "table", "low", "high", "block", "cls", "copies", "vec", "buckets"]
    met = placed.select(*columns).repartition("meeting").sortWithinPartitions("meeting").mapInArrow(meet, "cls bigint, met bigint, least bigint")
    met = materialise(met, "vector-links")
    joined = components(met.filter("cls <> least").select(F.col("cls").alias("a"), F.col("least").alias("b")))
    links = met.groupBy("cls").agg(F.sum("met").alias("met"))
    named = classes.join(links, "cls", "left").join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    named = materialise(named, "vector-named")
    lowest = named.groupBy("component").agg(F.min("first").alias("component_id"))
    named = named.join(lowest, "component").select("label", "vec", (F.coalesce("met", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    result = rows.join(named, ["label", "vec"], "left")
    component = F.coalesce("component_id", "id")
    return result.select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
