"""Shared pieces of the training-data operators."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space. ``bytes.split()`` cuts UTF-8 text in just these words.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master without that setting gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/quillstone-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _drop_quietly(spark: SparkSession, path: str) -> None:
    try:
        drop_path(spark, path)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def staged_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/quillstone/{tag}-{uuid.uuid4().hex}"
    atexit.register(_drop_quietly, spark, path)
    return path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Cut the lineage with a table in the shared folder, which outlives lost executors."""
    path = staged_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Remove tables made by ``materialise`` that no later step reads."""
    for df in tables:
        for path in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            drop_path(df.sparkSession, path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it until no column is called so, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Rows of an Arrow batch that carries texts, at most.
BATCH_ROWS = 2000


def modest_batches(spark: SparkSession) -> None:
    """From now on this session hands Python fewer rows at a time, unless it hands fewer already: a batch of whole texts is held several times over, by the executor and its workers."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def rows_of(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    """Python rows of Arrow batches; the text in ``body`` comes as UTF-8 bytes, a null one as empty. Some rows at a time are turned into Python values."""
    for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
        values = []
        for name in columns:
            column = batch.column(name)
            if name == "body":
                column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
                values.append([x or b"" for x in column.to_pylist()])
            else:
                values.append(column.to_pylist())
        yield from zip(*values, strict=True)


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each run of equal values in the first column, which may cross batches; runs of one row are left out."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks().to_batches()[0]
        first = rows.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(first[1:] != first[:-1]) + 1])
        sizes = np.diff(cuts)
        for k in np.flatnonzero(sizes > 1):
            yield rows.slice(cuts[k], sizes[k])
        held = rows.slice(cuts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def in_blocks(members: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """``members`` with ``meeting``, ``low``, ``high`` and ``block``: groups of up to two blocks of rows meet as they are, larger ones in pairs of blocks, each pair a meeting of its own."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("n_")).filter("n_ > 1")
    sizes = sizes.select(F.col(group), F.when(F.col("n_") > 2 * block, F.ceil(F.col("n_") / block)).otherwise(F.lit(1)).cast("int").alias("blocks_"))
    placed = members.join(sizes, group).withColumn("block", F.pmod(F.xxhash64(member), "blocks_").cast("int"))
    placed = placed.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    placed = placed.withColumns({"low": F.least("block", "other_"), "high": F.greatest("block", "other_")}).drop("other_", "blocks_")
    return placed.withColumn("meeting", F.xxhash64(group, "low", "high"))


class Out:
    """Collects rows and gives them as Arrow batches of bounded size."""

    def __init__(self, schema: pa.Schema, most: int = 4096):
        self.schema, self.most, self.rows = schema, most, []

    def add(self, *row) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.most:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in self.schema]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema)
