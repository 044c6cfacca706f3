"""Versioned documents with an outbox: commits, revisions, indexed queries, fences, event states and archives.

A tenant's transactions are judged in order: each is taken whole or refused
whole, and only what is taken changes documents, fences and the outbox. Where a
transaction is a single write without preconditions, its fate depends on the
write before it alone, and a window says it; all others go through a fold.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.plans.components import components
from quillstone.plans.fold import fold
from quillstone.sources.tables import cut

DOC = ["tenant", "document_type", "id"]
# The limits of a transaction and of what it carries.
MOST_MUTATIONS = MOST_FENCES = MOST_EVENTS = 100
MOST_BYTES = 1_048_576
RETRY_SECONDS = 5.0
#: A transaction's parts, as ``commit`` takes them.
MUTATIONS = "array<struct<operation:string,document_type:string,id:string,data:string,indexes:map<string,string>,expected_revision:bigint,must_exist:boolean,must_not_exist:boolean>>"
FENCES = "array<struct<operation:string,name:string,value:string,owner_type:string,owner_id:string>>"
EVENTS = "array<struct<topic:string,key:string,payload:string,max_attempts:int,id:string,headers:map<string,string>,not_before:timestamp>>"


class _Conflict(Exception):
    pass


def _apply(state: dict, row: dict) -> list[dict]:
    """The document states that a transaction makes, or a conflict; ``state`` changes only if all of it is taken."""
    heads, owners, made = {}, {}, []
    for operation, document_type, own_id, expected, must_exist, must_not_exist in row["mutations"]:
        name = (document_type, own_id)
        revision, deleted = heads.get(name) or state["heads"].get(name) or (0, False)
        there = revision > 0
        if must_not_exist and there or must_exist and not there:
            raise _Conflict("precondition")
        if expected is not None and (not there or expected != revision):
            raise _Conflict("precondition")
        gone = operation == "delete"
        if gone and (not there or deleted):
            raise _Conflict("missing_document")
        heads[name] = (revision + 1, gone)
        made.append({"document_type": document_type, "id": own_id, "operation": operation, "revision": revision + 1, "deleted": gone})
    for operation, fence, value, *owner in row["fences"]:
        name, owner = (fence, value), tuple(owner)
        held = owners[name] if name in owners else state["owners"].get(name)
        if operation == "claim":
            if held is not None and held != owner:
                raise _Conflict("fence_held")
            owners[name] = owner
        else:
            if held != owner:
                raise _Conflict("fence_not_owner")
            owners[name] = None
    state["heads"] |= heads
    for name, owner in owners.items():
        if owner is None:
            state["owners"].pop(name, None)
        else:
            state["owners"][name] = owner
    return made


def _too_large() -> Column:
    """Whether a transaction is beyond the limits."""
    many = lambda c, most: F.coalesce(F.size(c) > most, F.lit(False))
    long = lambda c, body: F.coalesce(F.exists(c, lambda x: F.coalesce(F.octet_length(x[body]) > MOST_BYTES, F.lit(False))), F.lit(False))
    return many("mutations", MOST_MUTATIONS) | many("fences", MOST_FENCES) | many("outbox", MOST_EVENTS) | long("mutations", "data") | long("outbox", "payload")


def _parts(column: pa.ListArray, names: tuple[str, ...]) -> Iterator[list[tuple]]:
    """For each row the fields named of its structs, of which whole columns become Python values."""
    flat = column.flatten()
    each = list(zip(*(flat.field(n).to_pylist() for n in names), strict=True))
    start = 0
    for n in pc.fill_null(pc.list_value_length(column), 0).to_pylist():
        yield each[start : start + n]
        start += n


def _read(large: str) -> Callable[[pa.RecordBatch], Iterator[dict]]:
    """What judging a transaction takes of it: no bodies, indexes or events."""

    def run(batch: pa.RecordBatch) -> Iterator[dict]:
        mutations = _parts(batch.column("mutations"), ("operation", "document_type", "id", "expected_revision", "must_exist", "must_not_exist"))
        fences = _parts(batch.column("fences"), ("operation", "name", "value", "owner_type", "owner_id"))
        plain = (batch.column(c).to_pylist() for c in (large, "idempotency_key", "hash"))
        for row in zip(*plain, mutations, fences, strict=True):
            yield dict(zip(("large", "idempotency_key", "hash", "mutations", "fences"), row, strict=True))

    return run


def commit(transactions: DataFrame) -> DataFrame:
    """``transactions`` with status, reason and documents.

    transactions: tenant, seq, idempotency_key, hash, and mutations, fences and
    outbox as in ``MUTATIONS``, ``FENCES`` and ``EVENTS``. A key that was taken
    before is replayed if the hash is the same and else a conflict; a refused
    transaction leaves its key free. Conflicts have a reason: idempotency_key,
    precondition, missing_document, fence_held, fence_not_owner; one beyond the
    limits is invalid. Transactions of a tenant that share no document, fence or
    key, even by others, cannot change each other's fate: those that hang together
    are serial, and a task holds what they touched.
    """

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        if row["large"]:
            return state, {"status": "invalid", "reason": "limits"}
        known = state["receipts"].get(row["idempotency_key"])
        if known is not None:
            same = known[0] == row["hash"]
            return state, {"status": "replayed" if same else "conflict", "reason": None if same else "idempotency_key", "documents": known[1] if same else None}
        try:
            made = _apply(state, row)
        except _Conflict as conflict:
            return state, {"status": "conflict", "reason": str(conflict)}
        state["receipts"][row["idempotency_key"]] = (row["hash"], made)
        return state, {"status": "committed", "documents": made}

    answers = "status string, reason string, documents array<struct<document_type:string,id:string,operation:string,revision:bigint,deleted:boolean>>"
    grouped = together(transactions)
    part = next(c for c in grouped.columns if c not in transactions.columns)
    large = f"large_{part}"
    judged = fold(grouped.withColumn(large, _too_large()), ["tenant", part], ["seq"], lambda: {"heads": {}, "owners": {}, "receipts": {}}, step, answers, _read(large))
    return judged.drop(part, large)


def together(transactions: DataFrame) -> DataFrame:
    """``transactions`` with the least seq of those of their tenant that they hang together with by documents, fences and keys.

    What is linked are documents, fences and keys, by hashes: a transaction ties
    its key to the others it touches, and ties that many transactions make are one.
    Two that share a hash by chance only make a larger group.
    """
    part = "part_"
    while part in transactions.columns:
        part += "_"
    some = lambda column, *names: F.transform(F.coalesce(column, F.array().cast(transactions.schema[column].dataType)), lambda x: F.xxhash64(F.lit(column), *(x[n] for n in names)))
    tenant, key = F.xxhash64("tenant"), F.xxhash64(F.lit("key"), F.col("idempotency_key").cast("string"))
    others = F.array_distinct(F.concat(some("mutations", "document_type", "id"), some("fences", "name", "value")))
    links = transactions.select(tenant.alias("tenant"), key.alias("a"), F.explode(others).alias("b")).distinct()
    found = components(cut(links), cut)
    first = transactions.groupBy(tenant.alias("tenant"), key.alias("node")).agg(F.min("seq").alias("seq"))
    placed = cut(first.join(found, ["tenant", "node"], "left").withColumn("component", F.coalesce("component", "node")))
    least = placed.groupBy("tenant", "component").agg(F.min("seq").alias(part))
    named = placed.join(least, ["tenant", "component"]).select(F.col("tenant").alias(f"tenant_{part}"), F.col("node").alias(f"node_{part}"), part)
    return transactions.withColumns({f"tenant_{part}": tenant, f"node_{part}": key}).join(named, [f"tenant_{part}", f"node_{part}"]).select(*transactions.columns, part)


def transaction_id(tenant: Column, key: Column) -> Column:
    return F.concat(F.lit("tx-"), F.substring(F.sha2(F.concat_ws("\n", tenant, key), 256), 1, 32))


def committed_revisions(committed: DataFrame) -> DataFrame:
    """Every revision that committed transactions made: tenant, seq, document_type, id, revision, operation, deleted, data, indexes."""
    each = committed.filter("status = 'committed'").select("tenant", "seq", F.explode(F.arrays_zip("documents", "mutations")).alias("x"))
    gone = F.col("x.documents.deleted")
    return each.select("tenant", "seq", "x.documents.document_type", "x.documents.id", "x.documents.revision", "x.documents.operation", gone.alias("deleted"), F.when(~gone, F.col("x.mutations.data")).alias("data"), F.when(~gone, F.col("x.mutations.indexes")).alias("indexes"))


def heads(revisions: DataFrame) -> DataFrame:
    """The last revision of each document."""
    last = revisions.groupBy(*DOC).agg(F.max_by(F.struct("revision", "deleted", "data", "indexes"), "revision").alias("s"))
    return last.select(*DOC, "s.revision", "s.deleted", "s.data", "s.indexes")


def committed_fences(committed: DataFrame) -> DataFrame:
    """tenant, name, value and owner of the fences that are held in the end."""
    each = committed.filter("status = 'committed'").select("tenant", "seq", F.posexplode("fences").alias("at", "f"))
    last = each.groupBy("tenant", "f.name", "f.value").agg(F.max_by("f", F.struct("seq", "at")).alias("f"))
    return last.filter("f.operation = 'claim'").select("tenant", "name", "value", "f.owner_type", "f.owner_id")


def committed_outbox(committed: DataFrame) -> DataFrame:
    """The events of committed transactions: tenant, transaction_id, event_id (its own, else its transaction's and a place of three digits), topic, key, payload, headers, not_before, max_attempts."""
    each = committed.filter("status = 'committed'").select("tenant", transaction_id(F.col("tenant"), F.col("idempotency_key")).alias("transaction_id"), F.posexplode("outbox").alias("at", "e"))
    made = F.concat("transaction_id", F.lit(":"), F.lpad(F.col("at").cast("string"), 3, "0"))
    return each.select("tenant", "transaction_id", F.coalesce(F.trim("e.id"), made).alias("event_id"), F.trim("e.topic").alias("topic"), F.trim("e.key").alias("key"), "e.payload", "e.headers", "e.not_before", "e.max_attempts")


def receipts(transactions: DataFrame) -> DataFrame:
    """status of transactions that nothing else can refuse: committed, replayed (same key and hash as the first of its key) or conflict."""
    first = transactions.groupBy("tenant", "idempotency_key").agg(F.min_by(F.struct("seq", "hash"), "seq").alias("first"))
    joined = transactions.join(first, ["tenant", "idempotency_key"])
    status = F.when(F.col("seq") == F.col("first.seq"), "committed").when(F.col("hash") == F.col("first.hash"), "replayed").otherwise("conflict")
    return joined.withColumn("status", status).drop("first")


def revisions(mutations: DataFrame) -> DataFrame:
    """Single writes without preconditions, with conflict, and revision and deleted of those that are taken.

    A delete is refused just if the write before it, taken or not, is a delete or
    missing: either way there is no document then. Only writes taken count.
    """
    order = Window.partitionBy(*DOC).orderBy("seq")
    conflict = (F.col("operation") == "delete") & (F.coalesce(F.lag("operation").over(order), F.lit("delete")) == "delete")
    judged = mutations.withColumn("conflict", conflict)
    taken = F.sum(F.when(F.col("conflict"), 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return judged.withColumn("revision", F.when(~F.col("conflict"), taken)).withColumn("deleted", F.when(~F.col("conflict"), F.col("operation") == "delete"))


def current(mutations: DataFrame) -> DataFrame:
    """The last state of each document that was ever written, of single writes without preconditions."""
    taken = revisions(mutations).filter(~F.col("conflict"))
    last = taken.groupBy(*DOC).agg(F.max_by(F.struct("deleted", "data", "indexes"), "seq").alias("s"), F.count(F.lit(1)).alias("revision"))
    gone = F.col("s.deleted")
    return last.select(*DOC, "revision", gone.alias("deleted"), F.when(~gone, F.col("s.data")).alias("data"), F.when(~gone, F.col("s.indexes")).alias("indexes"))


def query(documents: DataFrame, equals: dict[str, str], between: tuple[str, str | None, str | None] | None = None, order_by: str | None = None, descending: bool = False, limit: int = 100, after: tuple | None = None) -> DataFrame:
    """Live documents by string indexes, at most one range, in order of an index or of (document_type, id); ``after`` is the last row's keyset.

    Ordering by an index leaves out documents that lack it. Without one the
    direction is ignored.
    """
    if not 0 < limit <= 1000:
        raise ValueError("a query's limit is 1 to 1000")
    found = documents.filter(~F.col("deleted"))
    value = lambda name: F.try_element_at("indexes", F.lit(name))
    for name, wanted in equals.items():
        found = found.filter(value(name) == wanted)
    if between:
        name, low, high = between
        for bound, test in ((low, value(name) >= F.lit(low)), (high, value(name) <= F.lit(high))):
            found = found.filter(test) if bound is not None else found
    if order_by is None:
        keys = [F.col("document_type"), F.col("id")]
        ordered = found
        if after:
            ordered = ordered.filter(F.struct(*keys) > F.struct(*map(F.lit, after)))
        return ordered.orderBy(*keys).limit(limit)
    ordered = found.withColumn("order_value", value(order_by)).filter(F.col("order_value").isNotNull())
    if after:
        here, last = F.struct("order_value", "document_type", "id"), F.struct(*map(F.lit, after))
        ordered = ordered.filter(here < last if descending else here > last)
    keys = [F.col(c).desc() if descending else F.col(c).asc() for c in ("order_value", "document_type", "id")]
    return ordered.orderBy(*keys).limit(limit)


def fences(claims: DataFrame) -> DataFrame:
    """status of claims and releases of (tenant, name, value) in order of seq: claimed, held, released or not_owner.

    Refused ones change nothing; a claim by the owner stands as it is.
    """

    def step(owner: str | None, row: dict) -> tuple[str | None, dict]:
        asked = row["owner"]
        if row["operation"] == "claim":
            return (asked, {"status": "claimed"}) if owner in (None, asked) else (owner, {"status": "held"})
        return (None, {"status": "released"}) if owner == asked else (owner, {"status": "not_owner"})

    return fold(claims, ["tenant", "name", "value"], ["seq"], lambda: None, step, "status string")


def event_state(now: Column) -> Column:
    """delivered, dead_letter, leased, scheduled or ready; a lease goes before the time from which on an event is due."""
    return (
        F.when(F.col("delivered_at").isNotNull(), "delivered")
        .when(F.col("dead"), "dead_letter")
        .when(F.col("lease_until") > now, "leased")
        .when(F.col("not_before") > now, "scheduled")
        .otherwise("ready")
    )


def lease(outbox: DataFrame, now: Column, limit: int, seconds: int = 30) -> DataFrame:
    """The first ready events by (not_before, event_id), leased, with one delivery more; events without a time come first."""
    ready = outbox.filter(event_state(now) == "ready").orderBy("not_before", "event_id").limit(limit)
    return ready.withColumn("delivery_count", F.col("delivery_count") + 1).withColumn("lease_until", now + F.expr(f"INTERVAL {seconds} SECONDS"))


def acknowledge(outbox: DataFrame, answers: DataFrame, now: Column, seconds: int = 30) -> DataFrame:
    """The outbox after answers, in order of seq, and ``refused``, the seqs of those that changed nothing.

    outbox: event_id, not_before, delivered_at, dead, lease_until, lease_token,
    delivery_count, max_attempts, last_error, and more. answers: seq, event_id,
    answer (ack, nack, renew, replay), token, retry_seconds, error. All but a
    replay need the token of a lease that stands; a nack frees the event after
    its delay, or makes a dead letter of it at the last attempt; a replay frees a
    dead letter, its deliveries at zero. A repeated ack changes nothing and is
    not refused. An event's answers are folded as one array: they are few.
    """
    listed = answers.groupBy("event_id").agg(F.sort_array(F.collect_list(F.struct("seq", "answer", "token", "retry_seconds", "error"))).alias("answers"))
    joined = outbox.join(listed, "event_id", "left")
    kind = {f.name: f.dataType.simpleString() for f in outbox.schema}
    state = ("delivered_at", "dead", "lease_until", "lease_token", "not_before", "delivery_count", "last_error")
    seq_kind = answers.schema["seq"].dataType.simpleString()
    begin = F.struct(*(F.col(c).alias(c) for c in state), F.array().cast(f"array<{seq_kind}>").alias("refused"))

    def step(s: Column, a: Column) -> Column:
        answer, held = a["answer"], s["lease_token"].isNotNull() & (s["lease_token"] == a["token"])
        stands = held & (s["lease_until"] > now) & s["delivered_at"].isNull()
        is_ack, is_nack, is_renew, is_replay = (answer == x for x in ("ack", "nack", "renew", "replay"))
        works = F.coalesce((is_ack & (stands | held & s["delivered_at"].isNotNull())) | ((is_nack | is_renew) & stands) | (is_replay & s["dead"]), F.lit(False))
        spent = F.coalesce(s["delivery_count"] >= F.col("max_attempts"), F.lit(False))
        later = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.coalesce(a["retry_seconds"], F.lit(RETRY_SECONDS)).cast("decimal(18,6)"))
        none = lambda c: F.lit(None).cast(kind[c])
        after = {
            "delivered_at": F.when(is_ack, F.coalesce(s["delivered_at"], now)).otherwise(s["delivered_at"]),
            "dead": F.when(is_nack, spent | s["dead"]).when(is_replay, False).otherwise(s["dead"]),
            "lease_until": F.when(is_renew, now + F.expr(f"INTERVAL {seconds} SECONDS")).otherwise(none("lease_until")),
            "lease_token": F.when(is_nack | is_replay, none("lease_token")).otherwise(s["lease_token"]),
            "not_before": F.when(is_nack, F.when(spent, none("not_before")).otherwise(now + later)).when(is_replay, now).otherwise(s["not_before"]),
            "delivery_count": F.when(is_replay, 0).otherwise(s["delivery_count"]),
            "last_error": F.when(is_nack, a["error"]).when(is_replay, none("last_error")).otherwise(s["last_error"]),
        }
        fields = [F.when(works, value).otherwise(s[c]).cast(kind[c]).alias(c) for c, value in after.items()]
        refused = F.when(works, s["refused"]).otherwise(F.concat(s["refused"], F.array(a["seq"])))
        return F.struct(*fields, refused.alias("refused"))

    done = F.when(F.col("answers").isNull(), begin).otherwise(F.aggregate("answers", begin, step))
    found = joined.withColumn("after", done)
    return found.select(*(F.col(f"after.{c}").alias(c) if c in state else F.col(c) for c in outbox.columns), "after.refused")


def oldest_pending(outboxes: list[DataFrame]) -> DataFrame:
    """One row: the earliest created_at of what no outbox has delivered, null if all is."""
    waiting = [o.filter(F.col("delivered_at").isNull()).select("created_at") for o in outboxes]
    union = waiting[0]
    for more in waiting[1:]:
        union = union.unionByName(more)
    return union.agg(F.min("created_at").alias("oldest"))


def row_hash(table: DataFrame) -> Column:
    """A hash of a row's columns by name; maps go in order of their keys."""
    plain = lambda f: F.to_json(F.map_from_entries(F.sort_array(F.map_entries(f.name)))) if f.dataType.typeName() == "map" else F.col(f.name).cast("string")
    return F.sha2(F.concat_ws("|", *(F.coalesce(plain(f), F.lit("-")) for f in sorted(table.schema.fields, key=lambda f: f.name))), 256)


def archive(tables: dict[str, DataFrame], tenant: str) -> DataFrame:
    """table, rows and content_hash of a tenant's tables: sums of row hashes, so that no rows are gathered."""
    parts = []
    for name, table in tables.items():
        rows = table.filter(F.col("tenant") == tenant)
        digest = F.conv(F.substring(row_hash(rows), 1, 15), 16, 10).cast("decimal(38,0)")
        parts.append(rows.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("content_hash")).withColumn("table", F.lit(name)))
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union.select("table", "n_rows", "content_hash")


def export(tables: dict[str, DataFrame], tenant: str, path: str) -> DataFrame:
    """Write a tenant's tables under ``path``, with a manifest of rows and hashes, which is returned."""
    spark = next(iter(tables.values())).sparkSession
    for name, table in tables.items():
        table.filter(F.col("tenant") == tenant).write.mode("overwrite").parquet(f"{path}/{name}")
    written = {name: spark.read.schema(table.schema).parquet(f"{path}/{name}") for name, table in tables.items()}
    manifest = archive(written, tenant).withColumn("tenant", F.lit(tenant))
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return spark.read.schema("table string, n_rows bigint, content_hash string, tenant string").json(f"{path}/manifest")


def restore(current: dict[str, DataFrame], path: str) -> dict[str, DataFrame]:
    """The tables with the archived tenant's rows in place of its own; leases of its outbox are dropped.

    An archive whose rows do not give its manifest's hashes is an error.
    """
    spark = next(iter(current.values())).sparkSession
    manifest = {r.table: r for r in spark.read.schema("table string, n_rows bigint, content_hash string, tenant string").json(f"{path}/manifest").collect()}
    found = {name: spark.read.schema(table.schema).parquet(f"{path}/{name}") for name, table in current.items()}
    tenant = next(iter(manifest.values())).tenant
    for r in archive(found, tenant).collect():
        if (r.n_rows, r.content_hash) != (manifest[r.table].n_rows, manifest[r.table].content_hash):
            raise ValueError(f"the archive's {r.table} is not what its manifest says")
    restored = {}
    for name, table in current.items():
        rows = found[name]
        for c in ("lease_until", "lease_token"):
            if c in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(rows.schema[c].dataType))
        restored[name] = table.filter(F.col("tenant") != tenant).unionByName(rows)
    return restored
