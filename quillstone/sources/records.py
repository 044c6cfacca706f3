"""Record collections as tables: writes as folds over keyed changes, snapshots, and views of tables as records.

A record table has partition_key, id, payload columns, revision, etag, created_at
and updated_at. There is no table format with transactions here: a write makes
the next state from the last one.
"""

from __future__ import annotations

import json
import math
import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

KEYS = ["partition_key", "id"]


def etag(revision: Column) -> Column:
    return F.concat(F.lit("rev:"), revision.cast("string"))


def upsert(state: DataFrame, changes: DataFrame, payload: list[str], order: str = "seq", at: str = "at") -> DataFrame:
    """The state after all changes: the last payload of a key wins, each change adds a revision, created_at stays.

    One shuffle on the key; changes are folded by partial aggregates.
    """
    last = changes.groupBy(*KEYS).agg(F.max_by(F.struct(*payload), order).alias("p"), F.count(F.lit(1)).alias("n"), F.min(at).alias("first_at"), F.max(at).alias("last_at"))
    joined = state.join(last, KEYS, "full_outer")
    revision = F.coalesce("revision", F.lit(0)) + F.coalesce("n", F.lit(0))
    new = [F.when(F.col("p").isNotNull(), F.col("p")[c]).otherwise(F.col(c)).alias(c) for c in payload]
    return joined.select(*KEYS, *new, revision.alias("revision"), etag(revision).alias("etag"), F.coalesce("created_at", "first_at").alias("created_at"), F.coalesce("last_at", "updated_at").alias("updated_at"))


def conditional(state: DataFrame, changes: DataFrame) -> DataFrame:
    """Status of each change, one a key: ``expected`` is null, "*" for any existing record, "none" for none, or an etag."""
    joined = changes.join(state.select(*KEYS, F.col("revision").alias("current"), F.col("etag").alias("current_etag")), KEYS, "left")
    exists = F.col("current").isNotNull()
    allowed = F.when(F.col("expected").isNull(), True).when(F.col("expected") == "*", exists).when(F.col("expected") == "none", ~exists).otherwise(F.coalesce(F.col("expected") == F.col("current_etag"), F.lit(False)))
    status = F.when(~allowed, "conflict").when(exists, "updated").otherwise("created")
    return joined.select(*changes.columns, status.alias("status"), F.when(allowed, F.coalesce("current", F.lit(0)) + 1).otherwise(F.col("current")).alias("revision"))


def batch(changes: DataFrame, error: Column, stop_on_error: bool, order: str = "seq", group: str = "batch") -> DataFrame:
    """Status of each item of each batch: written, failed with its error, or, after a failure that stops, skipped."""
    found = changes.withColumn("error", error)
    first = F.min(F.when(F.col("error").isNotNull(), F.col(order))).over(Window.partitionBy(group))
    status = F.when(F.col("error").isNotNull(), "failed").otherwise("written")
    if stop_on_error:
        status = F.when(F.col(order) > first, "skipped").otherwise(status)
    return found.withColumn("status", status).withColumn("error", F.when(F.col("status") == "failed", F.col("error")))


def delete(state: DataFrame, keys: DataFrame) -> DataFrame:
    return state.join(keys.select(*KEYS).distinct(), KEYS, "left_anti")


# A snapshot's record begins with these names in this order, null where a record has none, as these columns; the bodies are JSON.
SNAPSHOT = {"id": "id", "partitionKey": "partition_key", "type": "type", "schemaVersion": "schema_version", "metadata": "metadata", "content": "content", "sources": "sources", "vectors": "vectors", "etag": "etag", "revision": "revision", "createdAt": "created_at", "updatedAt": "updated_at"}
BODIES = ("metadata", "content", "sources", "vectors")


def snapshot(state: DataFrame, columns: list[str], most: int = 10_000, collection: str = "", policy: dict | None = None) -> DataFrame:
    """One row: record_count, truncated and content_hash of the first ``most`` records by key.

    The hash is that of one canonical JSON text of the collection's name, its
    policy and the records; columns that are not among ``SNAPSHOT`` follow in the
    order of ``columns``. Texts in the columns of ``BODIES`` are JSON themselves.
    """
    rows = state.orderBy(*KEYS).limit(most + 1).withColumn("n", F.row_number().over(Window.orderBy(*KEYS)))
    known = [F.col(c).alias(name) if c in columns else F.lit(None).cast("string").alias(name) for name, c in SNAPSHOT.items()]
    more = [F.col(c) for c in columns if c not in SNAPSHOT.values()]
    bodies = [name for name in BODIES if SNAPSHOT[name] in columns and state.schema[SNAPSHOT[name]].dataType.simpleString() == "string"]

    @F.pandas_udf("string")
    def line(texts):
        def one(text: str) -> str:
            record = json.loads(text)
            return canonical_json(record | {b: json.loads(record[b]) for b in bodies if record[b] is not None})

        return texts.map(one)

    inside = F.when(F.col("n") <= most, F.struct("n", line(F.to_json(F.struct(*known, *more), {"ignoreNullFields": "false"})).alias("line")))
    head = F.lit('{"collection":' + canonical_json(collection) + ',"policy":' + canonical_json(policy) + ',"records":[')
    text = F.concat(head, F.array_join(F.transform("lines", lambda x: x["line"]), ","), F.lit("]}"))
    found = rows.withColumn("inside", inside).agg(F.least(F.count(F.lit(1)), F.lit(most)).alias("record_count"), (F.count(F.lit(1)) > most).alias("truncated"), F.sort_array(F.collect_list("inside")).alias("lines"))
    return found.select("record_count", "truncated", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("content_hash"))


def import_check(snapshots: DataFrame, expected: DataFrame) -> DataFrame:
    """Joins found and declared counts and hashes of snapshots (name, record_count, content_hash) and says what is wrong."""
    declared = expected.select("name", F.col("record_count").alias("want_count"), F.col("content_hash").alias("want_hash"))
    problem = F.when(F.col("record_count") != F.col("want_count"), "record_count").when(F.col("content_hash") != F.col("want_hash"), "content_hash").otherwise("none")
    return snapshots.join(declared, "name").withColumn("problem", problem)


def canonical_json(value: object) -> str:
    """Compact JSON in ASCII, names in their order: marks that HTML minds are escaped, escapes are in upper case, numbers are the shortest that read back, with a capital E."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{canonical_json(str(k))}:{canonical_json(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list | tuple):
        return "[" + ",".join(map(canonical_json, value)) + "]"
    if isinstance(value, np.float32):
        if not np.isfinite(value):
            raise ValueError("a number is finite")
        return canonical_json(int(value)) if value == 0 and not np.signbit(value) else np.format_float_positional(value, unique=True, trim="-") if 1e-5 <= abs(value) < 1e9 or value == 0 else _exponent(np.format_float_scientific(value, unique=True, trim="-"))
    if isinstance(value, float):
        if not math.isfinite(value):
            raise ValueError("a number is finite")
        return repr(value).replace("e", "E")
    if isinstance(value, str):
        plain = json.dumps(value)
        return _ESCAPES.sub(lambda m: "\\u" + (m[1] or f"{ord(m[0]):04x}").upper(), plain)
    return json.dumps(value)


_ESCAPES = re.compile(r"\\u([0-9a-f]{4})|[<>&+'`]")


def _exponent(text: str) -> str:
    """An exponent as ``E-05`` or ``E+10``."""
    body, _, power = text.partition("e")
    return f"{body}E{int(power):+03d}"


def canonical(body: Column) -> Column:
    """JSON texts in canonical form; null stays null. No built-in function keeps the order of names and this form of numbers."""

    @F.pandas_udf("string")
    def run(texts):
        return texts.map(lambda t: None if t is None else canonical_json(json.loads(t)))

    return run(body)


def as_records(documents: DataFrame) -> DataFrame:
    """``documents`` as records: the source is the partition, lang and n_chars are promoted metadata."""
    return documents.select(F.col("source").alias("partition_key"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id"), F.col("lang"), F.col("n_chars"), F.col("text"))
