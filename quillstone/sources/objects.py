"""Objects by key, and literal search through texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def from_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files as objects: key, length, etag (SHA-256 of the content) and time."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("key"), F.col("length"), F.sha2("content", 256).alias("etag"), F.col("modificationTime").alias("time"))


def listing(objects: DataFrame, prefix: str = "", limit: int = 100, offset: int = 0) -> DataFrame:
    """Keys with the prefix, sorted, with length and etag of the content column ``body``."""
    found = objects.filter(F.col("key").startswith(prefix)).select("key", "body").orderBy("key").offset(offset).limit(limit)
    return found.select("key", F.octet_length("body").cast("bigint").alias("length"), F.sha2(F.col("body").cast("binary"), 256).alias("etag"))


def _etag(body: Column) -> Column:
    return F.sha2(body.cast("binary"), 256)


def put_status(current: DataFrame, puts: DataFrame) -> DataFrame:
    """created, replaced or precondition_failed for each put (key, body, if_match, if_none_match)."""
    now = current.select("key", _etag(F.col("body")).alias("current_etag"))
    joined = puts.join(now, "key", "left")
    exists = F.col("current_etag").isNotNull()
    refused = (F.col("if_none_match") & exists) | (F.col("if_match").isNotNull() & ~F.coalesce(F.col("if_match") == F.col("current_etag"), F.lit(False)))
    return joined.select("key", F.when(F.coalesce(refused, F.lit(False)), "precondition_failed").when(exists, "replaced").otherwise("created").alias("status"))


def put(current: DataFrame, puts: DataFrame) -> DataFrame:
    """The objects (key, body) after puts, one a key; refused ones change nothing."""
    done = puts.join(put_status(current, puts).filter("status <> 'precondition_failed'").select("key"), "key", "left_semi").select("key", "body")
    return current.select("key", "body").join(done.select("key"), "key", "left_anti").unionByName(done)


def get(objects: DataFrame, keys: DataFrame) -> DataFrame:
    """found, length, etag and body of each key asked for."""
    held = objects.select("key", "body", F.lit(True).alias("there"))
    body = F.col("body")
    return keys.select("key").distinct().join(held, "key", "left").select("key", F.coalesce("there", F.lit(False)).alias("found"), F.octet_length(body).cast("bigint").alias("length"), _etag(body).alias("etag"), "body")


def delete_status(current: DataFrame, deletes: DataFrame) -> DataFrame:
    """deleted, missing or precondition_failed for each delete (key, if_match)."""
    joined = deletes.join(current.select("key", _etag(F.col("body")).alias("current_etag")), "key", "left")
    refused = F.col("if_match").isNotNull() & (F.col("if_match") != F.col("current_etag"))
    return joined.select("key", F.when(F.col("current_etag").isNull(), "missing").when(refused, "precondition_failed").otherwise("deleted").alias("status"))


def delete(current: DataFrame, deletes: DataFrame) -> DataFrame:
    """The objects after deletes."""
    return current.join(delete_status(current, deletes).filter("status = 'deleted'").select("key"), "key", "left_anti")


def matches(path: Column, globs: list[str]) -> Column:
    """Whether a path fits one of the globs: ``**`` any part of it, ``*`` and ``?`` within a folder."""
    test = F.lit(False)
    for glob in globs:
        parts = re.split(r"(\*\*/?|\*|\?)", glob)
        pattern = "".join({"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in parts)
        test = test | path.rlike(f"^{pattern}$")
    return test


def grep(texts: DataFrame, needle: str, path: Column, body: str = "text", case_sensitive: bool = True, limit: int | None = None, include: list[str] | None = None, exclude: list[str] | None = None, with_revision: bool = False) -> DataFrame:
    """path, line, column (from 1) and the line of each line's first match, in order, with ``truncated`` if limited and the text's hash as ``revision`` if asked for.

    The literal is tested against whole texts first, so that others' lines are never split.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    want = needle if case_sensitive else needle.lower()
    if include:
        texts = texts.filter(matches(path, include))
    if exclude:
        texts = texts.filter(~matches(path, exclude))
    revision = [_etag(F.col(body)).alias("revision")] if with_revision else []
    hit = texts.filter(fold(F.col(body)).contains(want)).select(path.alias("path"), *revision, F.posexplode(F.split(body, "\n")).alias("at", "content"))
    found = hit.withColumn("column", F.instr(fold(F.col("content")), want)).filter(F.col("column") > 0)
    found = found.select("path", (F.col("at") + 1).alias("line"), "column", "content", *(["revision"] if with_revision else []))
    if limit is None:
        return found
    probe = found.orderBy("path", "line", "column").limit(limit + 1)
    n = F.row_number().over(Window.orderBy("path", "line", "column"))
    rows = probe.withColumn("n", n).withColumn("truncated", F.max("n").over(Window.partitionBy()) > limit)
    return rows.filter(F.col("n") <= limit).drop("n")


def artifacts(manifest: DataFrame, objects: DataFrame) -> DataFrame:
    """Manifest entries (key, sha256) against the objects' bytes: ingested, hash_mismatch or missing; entries repeat without effect."""
    have = objects.select("key", F.sha2(F.col("body").cast("binary"), 256).alias("actual"))
    status = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("sha256"), "ingested").otherwise("hash_mismatch")
    return manifest.distinct().join(have, "key", "left").select("key", status.alias("status"))
