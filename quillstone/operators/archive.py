"""Archives of a tenant in chunks, each hashed over the one before.

Tables go in a stated order and their rows in the order of their keys, so that
chunk by chunk an archive is the same however it was partitioned when written. A
chunk that was changed, swapped, added or lost is named, as is a manifest that was
tampered with. A restore into record logs goes on where it was broken off.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

from quillstone.operators.canonical import row_hash
from quillstone.plans.fold import fold
from quillstone.sources.log import Log
from quillstone.sources.tables import cut

#: Rows of a chunk, and chunks that a restore takes at a time.
CHUNK_ROWS, AT_ONCE = 10_000, 64
_POSITION, _CHUNK = "position_", "chunk_"


def _numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their position in ``order``, which is total: counts of partitions tell where each begins."""
    placed = cut(cut(rows).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id()))
    part = F.shiftright("at_", 33)
    sizes = placed.groupBy(part.alias("part_")).agg(F.count(F.lit(1)).alias("n_"))
    begins = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("begin_"))
    found = placed.withColumn("part_", part).join(begins, "part_")
    return found.withColumn(_POSITION, F.col("begin_") + F.col("at_") - F.shiftleft("part_", 33)).drop("at_", "part_", "begin_", "n_")


def _contents(rows: DataFrame) -> DataFrame:
    """chunk, n_rows and content_hash of an archived table's chunks."""
    plain = rows.drop(_POSITION, _CHUNK)
    hashes = F.transform(F.sort_array(F.collect_list(F.struct(_POSITION, row_hash(plain).alias("hash")))), lambda x: x["hash"])
    return rows.groupBy(F.col(_CHUNK).alias("chunk")).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.array_join(hashes, ""), 256).alias("content_hash"))


def _chained(chunks: DataFrame) -> DataFrame:
    """Chunks (tenant, table_no, table, chunk, n_rows, content_hash) with chain: one after another, with the last hash alone in memory."""

    def step(last: str, row: dict) -> tuple[str, dict]:
        text = "|".join((last, row["table"], str(row["chunk"]), str(row["n_rows"]), row["content_hash"]))
        now = hashlib.sha256(text.encode()).hexdigest()
        return now, {"chain": now}

    return fold(chunks, ["tenant"], ["table_no", "chunk"], str, step, "chain string")


def _read(spark: SparkSession, path: str, name: str, schema: StructType) -> DataFrame:
    return spark.read.schema(StructType([*schema.fields, StructField(_POSITION, LongType()), StructField(_CHUNK, LongType())])).parquet(f"{path}/{name}")


def export(tables: dict[str, tuple[DataFrame, list[str]]], tenant: str, path: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Write the tenant's rows of tables, each with the columns that order it, and give the manifest: tenant, table_no, table, chunk, n_rows, content_hash and chain."""
    spark, parts = next(iter(tables.values()))[0].sparkSession, []
    for number, (name, (table, order)) in enumerate(tables.items()):
        rows = _numbered(table.filter(F.col("tenant") == tenant), order).withColumn(_CHUNK, F.floor(F.col(_POSITION) / chunk_rows))
        rows.write.mode("overwrite").partitionBy(_CHUNK).parquet(f"{path}/{name}")
        found = _contents(_read(spark, path, name, table.schema))
        parts.append(found.select(F.lit(tenant).alias("tenant"), F.lit(number).alias("table_no"), F.lit(name).alias("table"), "chunk", "n_rows", "content_hash"))
    chunks = parts[0]
    for more in parts[1:]:
        chunks = chunks.unionByName(more)
    _chained(cut(chunks)).write.mode("overwrite").parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def root(manifest: DataFrame) -> str:
    """The last hash of the chain, which stands for the whole archive."""
    last = manifest.orderBy(F.col("table_no").desc(), F.col("chunk").desc()).select("chain").first()
    return last[0] if last else ""


def problems(spark: SparkSession, path: str, schemas: dict[str, StructType], expected: str | None = None) -> DataFrame:
    """table, chunk and problem of an archive: missing, unexpected, swapped or changed chunks, a chain that does not hold, another root than ``expected``."""
    manifest = spark.read.parquet(f"{path}/manifest")
    parts = []
    for name, schema in schemas.items():
        parts.append(_contents(_read(spark, path, name, schema)).select(F.lit(name).alias("table"), "chunk", F.col("n_rows").alias("n_found"), F.col("content_hash").alias("found")))
    held = parts[0]
    for more in parts[1:]:
        held = held.unionByName(more)
    both = manifest.join(held, ["table", "chunk"], "full_outer")
    elsewhere = manifest.select("table", F.col("content_hash").alias("found")).distinct().withColumn("known", F.lit(True))
    both = both.join(elsewhere, ["table", "found"], "left")
    same = (F.col("found") == F.col("content_hash")) & (F.col("n_found") == F.col("n_rows"))
    problem = F.when(F.col("found").isNull(), "missing").when(F.col("content_hash").isNull(), "unexpected").when(~same & F.col("known"), "swapped").when(~same, "changed")
    wrong = both.select("table", "chunk", problem.alias("problem"))
    again = _chained(manifest.withColumnRenamed("chain", "said")).filter("chain <> said")
    wrong = wrong.unionByName(again.select("table", "chunk", F.lit("chain").alias("problem")))
    if expected is not None and root(manifest) != expected:
        wrong = wrong.unionByName(spark.createDataFrame([("manifest", None, "root")], "table string, chunk bigint, problem string"))
    return wrong.filter("problem IS NOT NULL")


def read(spark: SparkSession, path: str, schemas: dict[str, StructType], expected: str | None = None) -> dict[str, DataFrame]:
    """The archived tables; an archive with problems is refused, and the error names the first ones."""
    wrong = problems(spark, path, schemas, expected).orderBy("table", "chunk").limit(5).collect()
    if wrong:
        raise ValueError("; ".join(f"{r.table} chunk {r.chunk}: {r.problem}" for r in wrong))
    return {name: _read(spark, path, name, schema).drop(_POSITION, _CHUNK) for name, schema in schemas.items()}


def restore(path: str, logs: dict[str, Log], schemas: dict[str, StructType], expected: str | None = None, at_once: int = AT_ONCE) -> int:
    """Append an archive's rows to logs by table, some chunks at a time, and say how many appends it took; what was appended before is passed over."""
    spark = next(iter(logs.values())).spark
    read(spark, path, schemas, expected)
    manifest, done = spark.read.parquet(f"{path}/manifest"), 0
    mark = root(manifest)
    last = {r.table: r.last for r in manifest.groupBy("table").agg(F.max("chunk").alias("last")).collect()}
    for name, log in logs.items():
        rows = _read(spark, path, name, schemas[name])
        for first in range(0, last.get(name, -1) + 1, at_once):
            before = log.version()
            some = rows.filter(F.col(_CHUNK).between(first, first + at_once - 1)).drop(_POSITION, _CHUNK)
            done += log.append(some, f"{mark}-{first}") > before
    return done
