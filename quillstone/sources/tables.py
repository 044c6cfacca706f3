"""Tables between steps of an iteration, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: The most bytes of an Arrow batch for Python.
BATCH_BYTES = 16 << 20
#: The most rows of one whose rows hold arrays: Spark looks at a batch's size at each row, which takes the longer the more arrays it holds.
ARRAY_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = f"file:///tmp/checkpoints/quillstone-{uuid.uuid4().hex}"
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def _drop(spark: SparkSession, path: str) -> None:
    try:
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session may have ended before the interpreter
        pass


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path in the shared folder, removed when the driver's interpreter ends."""
    path = f"{shared_folder(spark)}/{kind}/{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage: written once, read from then on."""
    path = scratch(df.sparkSession, "steps")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def modest_batches(spark: SparkSession) -> None:
    """Bytes of a batch that goes to Python are bounded, in the session, unless they are lower: rows may be blocks of numbers or long texts."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if held > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@contextmanager
def few_rows(spark: SparkSession) -> Iterator[None]:
    """Batches that go to Python in what runs meanwhile have ``ARRAY_ROWS`` rows at most."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    held = spark.conf.get(key)
    spark.conf.set(key, str(ARRAY_ROWS if int(held) <= 0 else min(ARRAY_ROWS, int(held))))
    try:
        yield
    finally:
        spark.conf.set(key, held)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of its name, whoever else tries at the same time: whole or not at all."""
    jvm = spark.sparkContext._jvm
    target, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    system = target.getFileSystem(conf)
    out = system.create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if system.getScheme() == "file":  # its rename looks first and moves then; a link is made in one step
            paths = jvm.java.nio.file.Paths
            jvm.java.nio.file.Files.createLink(paths.get(target.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0)), paths.get(new.toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.String, 0)))
        else:
            options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(new, target, options)
        return True
    except Py4JJavaError as error:
        if "AlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        system.delete(new, False)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder, none if there is no folder."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []
