"""Execution runs: folding their history, admission, claims, retries, leases, retention; and operation traces."""

from __future__ import annotations

import datetime as dt
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.plans import fold as sequential

# The states of a run that end it and those before, the most runs of a list, the names of fields that are not to leave.
TERMINAL = ("completed", "failed", "cancelled")
ACTIVE = ("queued", "waiting", "running")
MOST_LISTED = 200
SENSITIVE = ("apikey", "xapikey", "authorization", "password", "passwd", "secret", "clientsecret", "accesstoken", "refreshtoken", "privatekey", "credential", "credentials", "token", "authtoken")


def fold(history: DataFrame, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """The last status, and of each progress column the last value that is not null, by partial aggregates."""
    keep = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq)))
    return history.groupBy(run).agg(F.max_by("status", seq).alias("status"), keep("progress").alias("progress"), F.max(seq).alias("last_seq"), F.count(F.lit(1)).alias("n_events"))


def tail(history: DataFrame, n: int, run: str = "run_id", seq: str = "seq") -> DataFrame:
    """The last n events of each run, with their position from the oldest kept."""
    back = F.row_number().over(Window.partitionBy(run).orderBy(F.col(seq).desc()))
    kept = history.withColumn("back", back).filter(F.col("back") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(run).orderBy(seq))).drop("back")


def admit(requests: DataFrame, active: int, max_active: int = 100) -> DataFrame:
    """admitted, duplicate, conflict or queue_full for each request in order of seq; keys carry the request's hash.

    The first requests of their keys are admitted as long as there is room, and
    those without a key each; with no run made, a key's others find a full queue
    too. The last one admitted is found by a top-k.
    """
    own = F.coalesce(F.concat(F.lit("k"), F.col("idempotency_key")), F.concat(F.lit("s"), F.col("seq").cast("string")))
    keyed = requests.withColumn("own_", own)
    first = keyed.groupBy("own_").agg(F.min_by(F.struct("seq", "hash"), "seq").alias("first"))
    last = first.select("first.seq").orderBy("seq").limit(max(max_active - active, 0)).agg(F.max("seq").alias("last"))
    joined = keyed.join(first, "own_").join(F.broadcast(last))
    inside = F.coalesce(F.col("first.seq") <= F.col("last"), F.lit(False))
    status = F.when(~inside, "queue_full").when(F.col("seq") == F.col("first.seq"), "admitted").when(F.col("hash") == F.col("first.hash"), "duplicate").otherwise("conflict")
    return joined.withColumn("status", status).drop("first", "last", "own_")


def claims(runs: DataFrame, now: Column) -> DataFrame:
    """The runs that can be claimed at once, their attempt one higher: queued ones, and running ones whose lease is over.

    Runs without a concurrency key stand alone. Of a key one can be: its oldest
    queued run if none is running, or the one that is running if its lease is
    over. Keys are aggregates, never sorted.
    """
    over = (F.col("status") == "running") & (F.col("lease_until") <= now)
    free = F.coalesce(F.col("concurrency_key"), F.lit("")) == ""
    alone = runs.filter(free & ((F.col("status") == "queued") | over))
    keyed = runs.filter(~free)
    running = F.count(F.when(F.col("status") == "running", 1))
    oldest = F.min(F.when(F.col("status") == "queued", F.struct("created_at", "run_id")))["run_id"]
    chosen = keyed.groupBy("concurrency_key").agg(F.when(running == 0, oldest).when(running == 1, F.min(F.when(over, F.col("run_id")))).alias("run_id"))
    found = alone.unionByName(keyed.join(chosen.select("run_id").filter("run_id IS NOT NULL"), "run_id", "left_semi").select(*runs.columns))
    return found.withColumn("attempt", F.col("attempt") + 1)


def backoff(attempt: Column, initial: float = 1.0, multiplier: float = 2.0, most: float = 60.0) -> Column:
    return F.least(F.lit(most), initial * F.pow(F.lit(multiplier), attempt - 1))


def cancel(status: Column) -> Column:
    return F.when(status.isin("queued", "waiting"), "cancelled").when(status == "running", "cancel_requested").otherwise(status)


def recover(status: Column) -> Column:
    return F.when(status == "running", "queued").otherwise(status)


def recovered(runs: DataFrame, leases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs and leases after a crash: running runs are queued again, and what external workers held open is dropped."""
    kept = leases.filter((F.col("protocol") != "external-worker") | (F.col("state") == "completed"))
    return runs.withColumn("status", recover(F.col("status"))), kept


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def worker_leases(operations: DataFrame) -> DataFrame:
    """Operations of external workers on runs (run_id, seq, at, operation, token, ttl_seconds) with answer, attempt and lease_until.

    lease is given unless the last one stands or the run is done; heartbeat,
    report and wait need the token of the lease that stands, and wait gives it
    up; complete ends the run, and repeated with its token finds that it did.
    """

    def step(state: dict, row: dict) -> tuple[dict, dict]:
        stands = state["token"] is not None and state["until"] > row["at"]
        mine = stands and state["token"] == row["token"]
        until = row["at"] + dt.timedelta(seconds=row["ttl_seconds"] or 60.0)
        kind, answer = row["operation"], "not_active"
        if kind == "lease":
            if state["done"] is not None:
                answer = "done"
            elif stands:
                answer = "held"
            else:
                state, answer = {**state, "token": row["token"], "until": until, "attempt": state["attempt"] + 1}, "leased"
        elif kind == "complete" and state["done"] is not None:
            answer = "repeated" if state["done"] == row["token"] else "not_active"
        elif mine and kind == "heartbeat":
            state, answer = {**state, "until": until}, "renewed"
        elif mine and kind == "report":
            answer = "reported"
        elif mine and kind in ("wait", "complete"):
            state = {**state, "token": None, "until": None, "done": row["token"] if kind == "complete" else None}
            answer = "suspended" if kind == "wait" else "completed"
        return state, {"answer": answer, "attempt": state["attempt"], "lease_until": state["until"]}

    start = lambda: {"token": None, "until": None, "attempt": 0, "done": None}
    return sequential.fold(operations, ["run_id"], ["seq"], start, step, f"answer string, attempt int, lease_until {_kind(operations, 'at')}")


def _ttl_step(held: tuple | None, row: dict) -> tuple[tuple | None, dict]:
    if row["operation"] == "release":
        mine = held is not None and held[0] == row["owner"]
        return (None if mine else held), {"answer": "released" if mine else "not_owner"}
    if held is not None and held[1] > row["at"] and held[0] != row["owner"]:
        return held, {"answer": "refused"}
    until = row["at"] + dt.timedelta(seconds=row["ttl_seconds"])
    return (row["owner"], until), {"answer": "acquired", "lease_until": until}


def ttl_leases(operations: DataFrame) -> DataFrame:
    """Acquisitions and releases of leases (lease_key, seq, at, operation, owner, ttl_seconds) with answer and lease_until, of a table or a stream.

    A lease is refused while another owner's stands; the owner's own is renewed.
    A release by the owner ends it, over or not.
    """
    folded = sequential.fold_stream if operations.isStreaming else sequential.fold
    return folded(operations, ["lease_key"], ["seq"], lambda: None, _ttl_step, f"answer string, lease_until {_kind(operations, 'at')}")


def due(timers: DataFrame, now: Column) -> DataFrame:
    return timers.filter(~F.col("fired") & (F.col("due_at") <= now))


def activated(runs: DataFrame, waits: DataFrame, now: Column) -> DataFrame:
    """Runs that become runnable, with outcome: timer, timed_out, or scheduled for those that wait for their time alone.

    waits: run_id, kind (timer or external_event), name, fire_at; one a run.
    """
    waiting = runs.filter("status = 'waiting'")
    fired = waits.filter(F.col("fire_at") <= now).select("run_id", "name", F.when(F.col("kind") == "timer", "timer").otherwise("timed_out").alias("outcome"))
    by_wait = waiting.join(fired, "run_id").select("run_id", "name", "outcome")
    by_time = waiting.filter(F.col("scheduled_at") <= now).join(waits, "run_id", "left_anti")
    return by_wait.unionByName(by_time.select("run_id", F.lit(None).cast("string").alias("name"), F.lit("scheduled").alias("outcome")))


def resumed(waits: DataFrame, events: DataFrame) -> DataFrame:
    """Each wait (run_id, name, since) with the first event of its run and name at or after it."""
    matched = waits.join(events.select("run_id", "name", "event_id", "at"), ["run_id", "name"]).filter(F.col("at") >= F.col("since"))
    return matched.groupBy("run_id", "name").agg(F.min(F.struct("at", "event_id")).alias("e")).select("run_id", "name", "e.event_id", "e.at")


def wait_start() -> dict:
    """A run's open wait (kind, name, fire_at), outcomes that are there by kind and name, and events kept by name."""
    return {"open": None, "there": {}, "events": {}}


def end_wait(state: dict, at: object) -> tuple | None:
    """End the open wait if its time has come, and give it."""
    ended = state["open"]
    if ended is None or ended[2] is None or ended[2] > at:
        return None
    state["there"][ended[:2]] = ("timer" if ended[0] == "timer" else "timed_out", None)
    state["open"] = None
    return ended


def wait_step(state: dict, row: dict) -> tuple[dict, dict]:
    """A run's state and the answer after an operation, as ``waited`` says."""
    end_wait(state, row["at"])
    open_wait = state["open"]
    name = (row["kind"] or "external_event", row["name"])
    if row["operation"] == "raise":
        if open_wait is not None and open_wait[:2] == ("external_event", row["name"]):
            state["there"][open_wait[:2]] = ("external_event", row["event_id"])
            state["open"] = None
            return state, {"outcome": "resumed", "consumed": row["event_id"]}
        state["events"].setdefault(row["name"], []).append(row["event_id"])
        return state, {"outcome": "kept"}
    if name in state["there"]:
        outcome, event = state["there"].pop(name)
        return state, {"outcome": outcome, "consumed": event}
    if name[0] == "external_event" and state["events"].get(row["name"]):
        return state, {"outcome": "external_event", "consumed": state["events"][row["name"]].pop(0)}
    if row["fire_at"] is not None and row["fire_at"] <= row["at"]:
        return state, {"outcome": "timer" if name[0] == "timer" else "timed_out"}
    state["open"] = (*name, row["fire_at"])
    return state, {"outcome": "suspended"}


def waited(operations: DataFrame) -> DataFrame:
    """Waits and raised events of runs (run_id, seq, at, operation, kind, name, fire_at, event_id) with outcome and the event consumed.

    A wait takes the outcome that is there for its kind and name, else the oldest
    event of its name that no wait has consumed; a time that has come ends it at
    once; else the run is suspended, and its one open wait is that. An event
    resumes the open wait for its name and is consumed, else it is kept; before
    any operation an open wait whose time has come ends with a timer or time-out.
    """

    return sequential.fold(operations, ["run_id"], ["seq"], wait_start, wait_step, f"outcome string, consumed {_kind(operations, 'event_id')}")


def unconsumed(events: DataFrame, consumption: DataFrame) -> DataFrame:
    """Events that no row of ``consumption`` names."""
    return events.join(consumption.select("event_id").distinct(), "event_id", "left_anti")


def active_with_start(runs: DataFrame, outbox: DataFrame, limit: int = 100) -> DataFrame:
    """The oldest active runs whose start was delivered, each with the number of all of them."""
    started = outbox.filter((F.col("kind") == "start") & F.col("delivered_at").isNotNull()).select("run_id").distinct()
    found = runs.filter(F.col("status").isin(*ACTIVE)).join(started, "run_id", "left_semi")
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return found.orderBy("created_at", "run_id").limit(limit).join(F.broadcast(total))


def reconcile(runs: DataFrame, limit: int = 200) -> DataFrame:
    """The oldest queued runs, what a dry run of dispatch lists."""
    return runs.filter("status = 'queued'").select("run_id", "created_at").orderBy("created_at", "run_id").limit(limit)


def artifacts(writes: DataFrame, inline: int = 65_536) -> DataFrame:
    """Artifacts of runs (run_id, artifact_id, name, created_at, content) with size, content_hash, and the place of content that is too large to keep inside."""
    size = F.coalesce(F.octet_length("content"), F.lit(0)).cast("bigint")
    place = F.concat(F.lit("artifact://"), F.col("run_id").cast("string"), F.lit("/"), F.col("artifact_id").cast("string"))
    large = size > inline
    return writes.withColumns({"size": size, "content_hash": F.sha2(F.col("content").cast("binary"), 256), "uri": F.when(large, place), "content": F.when(~large, F.col("content"))})


def artifact(listed: DataFrame, references: DataFrame) -> DataFrame:
    """For each (run_id, ref) the newest artifact of the run with that id or name."""
    one = listed.withColumn("row", F.struct(*listed.columns))
    by_id = one.select("run_id", F.col("artifact_id").cast("string").alias("ref"), "created_at", "row")
    by_name = one.select("run_id", F.col("name").alias("ref"), "created_at", "row")
    newest = by_id.unionByName(by_name).join(references, ["run_id", "ref"]).groupBy("run_id", "ref").agg(F.max_by("row", F.struct("created_at", "row.artifact_id")).alias("row"))
    return newest.select("ref", "row.*")


def latest(table: DataFrame, keys: list[str], value: str, at: str) -> DataFrame:
    """Last write wins: checkpoints, leases, artifacts."""
    return table.groupBy(*keys).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))


def retain(runs: DataFrame, keep: int, limit: int, at: str = "updated_at", key: str = "run_id") -> DataFrame:
    """Terminal runs to prune: behind the newest ``keep``, at most ``limit``. A top-k, not a sort of all."""
    return runs.filter(F.col("status").isin(*TERMINAL)).orderBy(F.col(at).desc(), key).offset(keep).limit(limit)


def listing(runs: DataFrame, equals: dict[str, object], tags: dict[str, str] | None = None, limit: int = 50, after: dict[str, object] | None = None, before: dict[str, object] | None = None, include_result: bool = False) -> DataFrame:
    """Newest first, by equalities and open time bounds of columns; tags are tested behind the limit, as the contract has it. Results are left out unless asked for."""
    found = runs
    for name, value in equals.items():
        found = found.filter(F.col(name) == value)
    for bounds, test in ((after, lambda c, v: c > v), (before, lambda c, v: c < v)):
        for name, value in (bounds or {}).items():
            found = found.filter(test(F.col(name), F.lit(value)))
    found = found.orderBy(F.col("created_at").desc(), F.col("run_id").desc()).limit(min(limit, MOST_LISTED))
    for name, value in (tags or {}).items():
        found = found.filter(F.try_element_at("tags", F.lit(name)) == value)
    return found if include_result or "result" not in found.columns else found.drop("result")


def trace_summary(traces: DataFrame) -> DataFrame:
    """Per operation: n, first_at, last_at, n_adapters and mean duration."""
    return traces.groupBy("operation").agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_at"), F.max("created_at").alias("last_at"), F.countDistinct("adapter").alias("n_adapters"), F.round(F.avg("duration"), 6).alias("mean_duration"))


def value_counts(traces: DataFrame, column: str, most: int = 64, width: int = 128) -> DataFrame:
    """operation, value, n: values cut to ``width``; beyond the ``most`` first seen ones they count as ``_other``."""
    cut = traces.select("operation", F.substring(F.col(column), 1, width).alias("value"), "created_at", "trace_id")
    seen = cut.groupBy("operation", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("created_at", "trace_id")).alias("first"))
    order = F.row_number().over(Window.partitionBy("operation").orderBy("first"))
    named = seen.withColumn("value", F.when(order > most, "_other").otherwise(F.col("value")))
    return named.groupBy("operation", "value").agg(F.sum("n").alias("n"))


def trace_counts(traces: DataFrame, columns: list[str], most: int = 64, width: int = 128) -> DataFrame:
    """Per operation the counts of each of the columns' values, as maps ordered by count down, then value. The maps have ``most`` values and ``_other`` at most."""
    listed = None
    for column in columns:
        counted = value_counts(traces.filter(F.col(column).isNotNull()), column, most, width)
        part = counted.withColumn("kind", F.lit(column))
        listed = part if listed is None else listed.unionByName(part)
    entries = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("back"), "value", "n")))
    one = listed.groupBy("operation", "kind").agg(F.map_from_entries(F.transform(entries, lambda x: F.struct(x["value"], x["n"]))).alias("counts"))
    return one.groupBy("operation").agg(*(F.max(F.when(F.col("kind") == c, F.to_json("counts"))).alias(f"{c}_counts") for c in columns))


def trace_list(traces: DataFrame, operation: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, then by id."""
    if not 0 < limit <= 5000:
        raise ValueError("a trace list's limit is 1 to 5000")
    found = traces if operation is None else traces.filter(F.col("operation") == operation)
    return found.orderBy(F.col("created_at").desc(), "trace_id").limit(limit)


def unsafe_fields(traces: DataFrame, columns: dict[str, str]) -> DataFrame:
    """trace_id, path and reason of fields with a sensitive name, and of strings that are bearer tokens, at any depth of JSON texts.

    columns: from column to the name its paths begin with. A text is walked in
    Python: no built-in function visits all names of JSON.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, paths, reasons = [], [], []
            for row in batch.to_pylist():
                for column, name in columns.items():
                    try:
                        todo = [(name, json.loads(row[column] or "null"))]
                    except ValueError:
                        continue
                    for path, reason in _unsafe(todo):
                        ids.append(row["trace_id"])
                        paths.append(path)
                        reasons.append(reason)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("trace_id").type), pa.array(paths, pa.string()), pa.array(reasons, pa.string())], names=["trace_id", "path", "reason"])

    kind = traces.schema["trace_id"].dataType.simpleString()
    return traces.select("trace_id", *columns).mapInArrow(run, f"trace_id {kind}, path string, reason string")


def _unsafe(todo: list[tuple[str, object]]) -> Iterator[tuple[str, str]]:
    while todo:
        path, value = todo.pop()
        if isinstance(value, dict):
            for key, inner in value.items():
                if re.sub("[_-]", "", key).lower() in SENSITIVE:
                    yield f"{path}.{key}", "sensitive_field_name"
                todo.append((f"{path}.{key}", inner))
        elif isinstance(value, list):
            todo += [(f"{path}[{k}]", inner) for k, inner in enumerate(value)]
        elif isinstance(value, str) and value.lower().startswith("bearer "):
            yield path, "bearer_token_value"


def trace_export(traces: DataFrame, columns: dict[str, str], fields: list[str], operation: str | None = None, limit: int = 100, refuse_unsafe: bool = False) -> DataFrame:
    """One row: n_traces, n_warnings and content_hash of the listed traces' JSON lines, of the given fields, in order."""
    listed = trace_list(traces, operation, limit)
    warnings = unsafe_fields(listed, columns).agg(F.count(F.lit(1)).alias("n_warnings"))
    if refuse_unsafe and warnings.first()[0]:
        raise ValueError("the traces hold fields that are not to leave")
    place = F.row_number().over(Window.orderBy(F.col("created_at").desc(), "trace_id"))
    lines = F.sort_array(F.collect_list(F.struct("place", F.to_json(F.struct(*sorted(fields))).alias("line"))))
    found = listed.withColumn("place", place).agg(F.count(F.lit(1)).alias("n_traces"), F.sha2(F.concat_ws("\n", F.transform(lines, lambda x: x["line"])), 256).alias("content_hash"))
    return found.join(F.broadcast(warnings))


def trace_prune(traces: DataFrame, before: Column | None = None, operation: str | None = None, keep: int | None = None, limit: int = 100) -> DataFrame:
    """Traces to delete; at least one of the constraints is needed."""
    if before is None and operation is None and keep is None:
        raise ValueError("pruning takes a constraint")
    found = traces if operation is None else traces.filter(F.col("operation") == operation)
    found = found if before is None else found.filter(F.col("created_at") < before)
    return found.orderBy(F.col("created_at").desc(), "trace_id").offset(keep or 0).limit(limit)


def inspect_collection(records: DataFrame, vectors: DataFrame, dims: int, keys: list[str]) -> DataFrame:
    """One row: records, partitions, vector coverage and anomalies by kind."""
    held = vectors.select(*keys, F.size("vector").alias("dims"))
    joined = records.join(held, keys, "left")
    count = lambda test: F.count(F.when(test, 1))
    found = joined.agg(
        F.count(F.lit(1)).alias("n_records"),
        F.countDistinct("partition_key").alias("n_partitions"),
        count(F.col("dims").isNull()).alias("missing_vector"),
        count(F.col("dims") == 0).alias("empty_vector"),
        count((F.col("dims") > 0) & (F.col("dims") != dims)).alias("dimension_mismatch"),
    )
    return found.withColumn("coverage", F.when(F.col("n_records") > 0, 1 - F.col("missing_vector") / F.col("n_records")).otherwise(1.0))


def inspect_details(records: DataFrame, vectors: DataFrame, declared: dict[str, int], keys: list[str]) -> DataFrame:
    """kind, value, n of a collection (records: keys, type; vectors: keys, field, vector, provider, model): records by type, vectors by provider and model, and per field those present, missing, empty, of another size, and in fields that the policy does not declare."""
    spark = records.sparkSession
    counted = lambda df, c, kind: df.groupBy(F.coalesce(F.col(c), F.lit("(missing)")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")
    policy = spark.createDataFrame(list(declared.items()), "field string, want int")
    held = vectors.select(*keys, "field", F.size("vector").alias("size"))
    asked = records.select(*keys).join(F.broadcast(policy))
    met = asked.join(held, [*keys, "field"], "left").groupBy(F.col("field").alias("value")).agg(
        F.count("size").alias("present"),
        F.count(F.when(F.col("size").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("size") == 0, 1)).alias("empty"),
        F.count(F.when((F.col("size") > 0) & (F.col("size") != F.col("want")), 1)).alias("mismatched"),
    )
    fields = met.select("value", F.explode(F.array(*(F.struct(F.lit(f"{c}_vectors").alias("kind"), F.col(c).alias("n")) for c in ("present", "missing", "empty", "mismatched")))).alias("x")).select("x.kind", "value", "x.n")
    extra = counted(held.join(F.broadcast(policy), "field", "left_anti"), "field", "undeclared_field")
    parts = [counted(records, "type", "type"), counted(vectors, "provider", "provider"), counted(vectors, "model", "model"), fields, extra]
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union
