"""Versioned documents, runs, traces, inspection and event streams."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from quillstone.catalog.base import Registry, table
from quillstone.operators import archive, canonical, runs
from quillstone.sources.tables import cut, scratch
from quillstone.streaming import events as streams
from quillstone.streaming import waits

R = Registry()
NOW = "TIMESTAMP '2024-01-15 00:00:00'"

def _mutations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 4).cast("string").alias("tenant"), F.col("event_type").alias("document_type"), (F.col("user_id") % 50).cast("string").alias("id"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 6 == 0, "delete").otherwise("upsert").alias("operation"), F.col("props").alias("data"), F.create_map(F.lit("value"), F.lpad(F.floor("value").cast("string"), 6, "0"), F.lit("user"), F.col("user_id").cast("string")).alias("indexes"))


MUTATIONS = "SELECT CAST(user_id % 4 AS VARCHAR) AS tenant, event_type AS document_type, CAST(user_id % 50 AS VARCHAR) AS id, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN 'delete' ELSE 'upsert' END AS operation, props AS data, lpad(CAST(floor(value)::BIGINT AS VARCHAR), 6, '0') AS v, CAST(user_id AS VARCHAR) AS u FROM events"


#: Writes one after another: rev and live are a document's state after each.
WALKED = f"""m AS ({MUTATIONS}), n AS (SELECT *, row_number() OVER (PARTITION BY tenant, document_type, id ORDER BY seq) AS n FROM m),
walk AS (SELECT tenant, document_type, id, seq, operation, data, v, u, n, operation = 'delete' AS conflict, CASE WHEN operation = 'delete' THEN 0 ELSE 1 END::BIGINT AS rev, operation <> 'delete' AS live FROM n WHERE n = 1
UNION ALL SELECT n.tenant, n.document_type, n.id, n.seq, n.operation, n.data, n.v, n.u, n.n, n.operation = 'delete' AND NOT w.live, w.rev + CASE WHEN n.operation = 'delete' AND NOT w.live THEN 0 ELSE 1 END, n.operation <> 'delete' FROM walk w JOIN n ON n.tenant = w.tenant AND n.document_type = w.document_type AND n.id = w.id AND n.n = w.n + 1)"""


@R.query(f"WITH RECURSIVE {WALKED} SELECT tenant, document_type, id, seq, operation, CASE WHEN NOT conflict THEN rev END AS revision, conflict FROM walk")
def canonical_revisions(spark, sf_dir):
    return canonical.revisions(_mutations(spark, sf_dir)).select(*canonical.DOC, "seq", "operation", "revision", "conflict")


CURRENT = f"{WALKED}, cur AS (SELECT tenant, document_type, id, max(rev) AS revision, NOT arg_max(live, n) AS deleted, arg_max(data, n) FILTER (WHERE NOT conflict) AS data, arg_max(v, n) FILTER (WHERE NOT conflict) AS v, arg_max(u, n) FILTER (WHERE NOT conflict) AS u FROM walk GROUP BY ALL HAVING max(rev) > 0)"


@R.query(f"WITH RECURSIVE {CURRENT} SELECT tenant, document_type, id, revision, deleted, CASE WHEN NOT deleted THEN data END AS data FROM cur")
def canonical_current(spark, sf_dir):
    return canonical.current(_mutations(spark, sf_dir)).drop("indexes")


@R.query(f"WITH RECURSIVE {CURRENT} SELECT tenant, document_type, id, v AS order_value FROM cur WHERE NOT deleted AND tenant = '1' AND v >= '000010' ORDER BY v DESC, document_type DESC, id DESC LIMIT 20")
def canonical_query(spark, sf_dir):
    docs = canonical.current(_mutations(spark, sf_dir)).filter("tenant = '1'")
    return canonical.query(docs, {}, ("value", "000010", None), "value", True, 20).select(*canonical.DOC, "order_value")


@R.query("""WITH t AS (SELECT CAST(user_id % 4 AS VARCHAR) AS tenant, CAST(event_id % 300 AS VARCHAR) AS idempotency_key, event_type AS hash, event_id AS seq FROM events), f AS (SELECT *, min(seq) OVER (PARTITION BY tenant, idempotency_key) AS first_seq, arg_min(hash, seq) OVER (PARTITION BY tenant, idempotency_key) AS first_hash FROM t)
SELECT tenant, idempotency_key, seq, CASE WHEN seq = first_seq THEN 'committed' WHEN hash = first_hash THEN 'replayed' ELSE 'conflict' END AS status FROM f""")
def canonical_receipts(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    t = e.select((F.col("user_id") % 4).cast("string").alias("tenant"), (F.col("event_id") % 300).cast("string").alias("idempotency_key"), F.col("event_type").alias("hash"), F.col("event_id").alias("seq"))
    return canonical.receipts(t).select("tenant", "idempotency_key", "seq", "status")


FENCE_OPS = "SELECT CAST(user_id % 4 AS VARCHAR) AS tenant, CAST(event_id % 20 AS VARCHAR) AS name, CAST(user_id % 2 AS VARCHAR) AS value, CAST(user_id % 3 AS VARCHAR) AS owner, CASE WHEN event_type IN ('error', 'view') THEN 'release' ELSE 'claim' END AS operation, event_id AS seq FROM events"


@R.query(f"""WITH RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY tenant, name, value ORDER BY seq) AS n FROM ({FENCE_OPS})),
walk AS (SELECT tenant, name, value, n, seq, CASE WHEN operation = 'claim' THEN owner END AS held, CASE WHEN operation = 'claim' THEN 'claimed' ELSE 'not_owner' END AS status FROM ops WHERE n = 1
UNION ALL SELECT o.tenant, o.name, o.value, o.n, o.seq, CASE WHEN o.operation = 'claim' THEN COALESCE(w.held, o.owner) WHEN w.held = o.owner THEN NULL ELSE w.held END, CASE WHEN o.operation = 'claim' THEN CASE WHEN COALESCE(w.held, o.owner) = o.owner THEN 'claimed' ELSE 'held' END WHEN w.held = o.owner THEN 'released' ELSE 'not_owner' END
FROM walk w JOIN ops o ON o.tenant = w.tenant AND o.name = w.name AND o.value = w.value AND o.n = w.n + 1)
SELECT tenant, name, value, seq, status FROM walk""")
def canonical_fences(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    text = lambda c: c.cast("string")
    c = e.select(text(F.col("user_id") % 4).alias("tenant"), text(F.col("event_id") % 20).alias("name"), text(F.col("user_id") % 2).alias("value"), text(F.col("user_id") % 3).alias("owner"), F.when(F.col("event_type").isin("error", "view"), "release").otherwise("claim").alias("operation"), F.col("event_id").alias("seq"))
    return canonical.fences(c).select("tenant", "name", "value", "seq", "status")


def _transactions(spark, sf_dir):
    """A transaction per event: a write with a precondition now and then, and for some a second one, a fence or an event."""
    mutations = "array(named_struct('operation', IF(event_id % 6 = 0, 'delete', 'upsert'), 'document_type', event_type, 'id', CAST(user_id % 30 AS STRING), 'data', props, 'indexes', map('user', CAST(user_id AS STRING)), 'expected_revision', IF(event_id % 7 = 0, event_id % 5, NULL), 'must_exist', event_id % 11 = 0, 'must_not_exist', event_id % 13 = 0))"
    second = mutations.replace("event_id % 6 = 0", "false").replace("user_id % 30", "user_id % 3")
    fences = "IF(event_id % 3 = 0, array(named_struct('operation', IF(event_id % 2 = 0, 'claim', 'release'), 'name', 'n', 'value', CAST(event_id % 9 AS STRING), 'owner_type', 'o', 'owner_id', CAST(user_id % 2 AS STRING))), array())"
    outbox = "IF(event_id % 4 = 0, array(named_struct('topic', event_type, 'key', CAST(user_id AS STRING), 'payload', props, 'max_attempts', 3, 'id', IF(event_id % 8 = 0, concat(' own-', event_id), NULL), 'headers', map('by', event_type), 'not_before', IF(event_id % 16 = 0, ts, NULL))), array())"
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 4).cast("string").alias("tenant"),
        F.col("event_id").alias("seq"),
        (F.col("event_id") % 700).cast("string").alias("idempotency_key"),
        F.col("event_type").alias("hash"),
        F.expr(f"IF(event_id % 5 = 0, concat({mutations}, {second}), {mutations})").cast(canonical.MUTATIONS).alias("mutations"),
        F.expr(fences).cast(canonical.FENCES).alias("fences"),
        F.expr(outbox).cast(canonical.EVENTS).alias("outbox"),
    )


@R.query()
def canonical_commit(spark, sf_dir):
    return canonical.commit(_transactions(spark, sf_dir)).select("tenant", "seq", "idempotency_key", "status", "reason", "documents")


@R.query()
def canonical_committed_heads(spark, sf_dir):
    committed = cut(canonical.commit(_transactions(spark, sf_dir)))
    return canonical.heads(canonical.committed_revisions(committed)).drop("indexes")


@R.query()
def canonical_committed_fences(spark, sf_dir):
    return canonical.committed_fences(canonical.commit(_transactions(spark, sf_dir)))


@R.query()
def canonical_committed_outbox(spark, sf_dir):
    return canonical.committed_outbox(canonical.commit(_transactions(spark, sf_dir)))


def _outbox(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    when = lambda test, value: F.when(F.expr(test), value)
    return e.select("event_id", F.col("ts").alias("not_before"), when("event_id % 5 = 0", F.col("ts")).alias("delivered_at"), (F.col("event_id") % 7 == 0).alias("dead"), when("event_id % 3 = 0", F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("lease_until"), when("event_id % 3 = 0", F.concat(F.lit("t"), F.col("user_id").cast("string"))).alias("lease_token"), (F.col("event_id") % 6).cast("int").alias("delivery_count"), when("event_id % 4 > 0", F.lit(3)).alias("max_attempts"), F.lit(None).cast("string").alias("last_error"))


OUTBOX = "SELECT event_id, ts AS not_before, CASE WHEN event_id % 5 = 0 THEN ts END AS delivered_at, event_id % 7 = 0 AS dead, CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL 1 DAY END AS lease_until, CASE WHEN event_id % 3 = 0 THEN 't' || user_id END AS lease_token, (event_id % 6)::INTEGER AS delivery_count, CASE WHEN event_id % 4 > 0 THEN 3 END AS max_attempts, user_id FROM events"
STATE = f"CASE WHEN delivered_at IS NOT NULL THEN 'delivered' WHEN dead THEN 'dead_letter' WHEN lease_until > {NOW} THEN 'leased' WHEN not_before > {NOW} THEN 'scheduled' ELSE 'ready' END"


@R.query(f"WITH o AS ({OUTBOX}) SELECT {STATE} AS state, count(*) AS n FROM o GROUP BY 1")
def outbox_states(spark, sf_dir):
    return _outbox(spark, sf_dir).groupBy(canonical.event_state(F.expr(NOW)).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@R.query(f"WITH o AS ({OUTBOX}) SELECT event_id, not_before, delivery_count + 1 AS delivery_count, {NOW} + INTERVAL 30 SECOND AS lease_until FROM o WHERE {STATE} = 'ready' ORDER BY not_before, event_id LIMIT 25")
def outbox_lease(spark, sf_dir):
    return canonical.lease(_outbox(spark, sf_dir), F.expr(NOW), 25).select("event_id", "not_before", "delivery_count", "lease_until")


#: Two answers for each event, the second with a token that may be wrong; the time is early, so that some leases stand.
EARLY = "TIMESTAMP '2024-01-04 00:00:00'"
ANSWERS = """SELECT 2 * event_id + k AS seq, event_id, CASE (event_id + k * user_id) % 4 WHEN 0 THEN 'ack' WHEN 1 THEN 'nack' WHEN 2 THEN 'renew' ELSE 'replay' END AS answer, 't' || (user_id - (event_id + k) % 2) AS token, k, CASE WHEN event_id % 9 > 0 THEN 60.0 END AS retry FROM events, range(0, 2) AS g(k)"""
STEP = """SELECT event_id, seq, answer, not_before, delivered_at, dead, lease_until, lease_token, delivery_count, max_attempts, retry,
 COALESCE(CASE answer WHEN 'replay' THEN dead WHEN 'ack' THEN lease_token = token AND (delivered_at IS NOT NULL OR lease_until > {now}) ELSE lease_token = token AND delivered_at IS NULL AND lease_until > {now} END, false) AS works FROM {rows}"""
AFTER = """SELECT event_id, seq, works,
 CASE WHEN works AND answer = 'ack' THEN COALESCE(delivered_at, {now}) ELSE delivered_at END AS delivered_at,
 CASE WHEN works AND answer = 'nack' THEN dead OR COALESCE(delivery_count >= max_attempts, false) WHEN works AND answer = 'replay' THEN false ELSE dead END AS dead,
 CASE WHEN NOT works THEN lease_until WHEN answer = 'renew' THEN {now} + INTERVAL 30 SECOND END AS lease_until,
 CASE WHEN works AND answer IN ('nack', 'replay') THEN NULL ELSE lease_token END AS lease_token,
 CASE WHEN works AND answer = 'replay' THEN {now} WHEN works AND answer = 'nack' THEN CASE WHEN delivery_count >= max_attempts THEN NULL ELSE {now} + to_seconds(COALESCE(retry, 5.0)) END ELSE not_before END AS not_before,
 CASE WHEN works AND answer = 'replay' THEN 0 ELSE delivery_count END AS delivery_count, max_attempts FROM {rows}"""


@R.query(f"""WITH o AS ({OUTBOX}), a AS ({ANSWERS}), r1 AS ({STEP.format(now=EARLY, rows="(SELECT * FROM o JOIN a USING (event_id) WHERE k = 0)")}), s1 AS ({AFTER.format(now=EARLY, rows="r1")}),
r2 AS ({STEP.format(now=EARLY, rows="(SELECT s1.* EXCLUDE (seq, works), a.* EXCLUDE (event_id) FROM s1 JOIN a USING (event_id) WHERE k = 1)")}), s2 AS ({AFTER.format(now=EARLY, rows="r2")})
SELECT s2.event_id, s2.not_before, s2.delivered_at, s2.dead, s2.lease_until, s2.lease_token, s2.delivery_count, (NOT s1.works)::INT + (NOT s2.works)::INT AS n_refused FROM s1 JOIN s2 USING (event_id)""")
def outbox_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    kind = F.expr("CASE (event_id + k * user_id) % 4 WHEN 0 THEN 'ack' WHEN 1 THEN 'nack' WHEN 2 THEN 'renew' ELSE 'replay' END")
    token = F.concat(F.lit("t"), (F.col("user_id") - (F.col("event_id") + F.col("k")) % 2).cast("string"))
    answers = e.select((2 * F.col("event_id") + F.col("k")).alias("seq"), "event_id", kind.alias("answer"), token.alias("token"), F.when(F.col("event_id") % 9 > 0, 60.0).alias("retry_seconds"), F.lit("late").alias("error"))
    found = canonical.acknowledge(_outbox(spark, sf_dir), answers, F.expr(EARLY))
    return found.select("event_id", "not_before", "delivered_at", "dead", "lease_until", "lease_token", "delivery_count", F.size("refused").alias("n_refused"))


@R.query("SELECT min(ts) AS oldest FROM (SELECT ts FROM events WHERE event_type = 'error' AND event_id % 5 <> 0 UNION ALL SELECT ts FROM events WHERE event_type = 'click' AND event_id % 7 <> 0 UNION ALL SELECT ts FROM events WHERE event_type = 'view' AND event_id % 2 <> 0)")
def outbox_oldest_pending(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    of = lambda kind, n: e.filter(F.col("event_type") == kind).select(F.col("ts").alias("created_at"), F.when(F.col("event_id") % n == 0, F.col("ts")).alias("delivered_at"))
    return canonical.oldest_pending([of("error", 5), of("click", 7), of("view", 2)])


LINE_HASH = "CAST('0x' || substring(sha256({0}), 1, 15) AS BIGINT)"


INDEXED = """'{"user":"' || u || '","value":"' || v || '"}'"""


@R.query(f"WITH RECURSIVE {CURRENT}, a AS (SELECT 'mutations' AS t, {LINE_HASH.format("COALESCE(data, '-') || '|' || document_type || '|' || id || '|' || " + INDEXED + " || '|' || operation || '|' || seq || '|' || tenant")} AS h FROM m WHERE tenant = '2' UNION ALL SELECT 'documents', {LINE_HASH.format("CASE WHEN deleted THEN '-' ELSE data END || '|' || deleted || '|' || document_type || '|' || id || '|' || CASE WHEN deleted THEN '-' ELSE " + INDEXED + " END || '|' || revision || '|' || tenant")} FROM cur WHERE tenant = '2') SELECT t AS \"table\", count(*) AS n_rows, CAST(sum(h) AS VARCHAR) AS content_hash FROM a GROUP BY t")
def canonical_archive(spark, sf_dir):
    m = _mutations(spark, sf_dir)
    return canonical.archive({"mutations": m, "documents": canonical.current(m)}, "2")


ROW_TEXTS = {"mutations": "COALESCE(data, '-') || '|' || document_type || '|' || id || '|' || " + INDEXED + " || '|' || operation || '|' || seq || '|' || tenant", "documents": "CASE WHEN deleted THEN '-' ELSE data END || '|' || deleted || '|' || document_type || '|' || id || '|' || CASE WHEN deleted THEN '-' ELSE " + INDEXED + " END || '|' || revision || '|' || tenant"}


@R.query(f"""WITH RECURSIVE {CURRENT}, a AS (SELECT 0 AS no, 'mutations' AS t, row_number() OVER (ORDER BY seq) - 1 AS p, sha256({ROW_TEXTS["mutations"]}) AS h FROM m WHERE tenant = '2' UNION ALL SELECT 1, 'documents', row_number() OVER (ORDER BY document_type, id) - 1, sha256({ROW_TEXTS["documents"]}) FROM cur WHERE tenant = '2'),
k AS (SELECT no, t, p // 40 AS chunk, count(*) AS n, sha256(string_agg(h, '' ORDER BY p)) AS c, row_number() OVER (ORDER BY no, p // 40) AS i FROM a GROUP BY no, t, p // 40),
w AS (SELECT i, sha256('|' || t || '|' || chunk || '|' || n || '|' || c) AS chain FROM k WHERE i = 1 UNION ALL SELECT k.i, sha256(w.chain || '|' || t || '|' || chunk || '|' || n || '|' || c) FROM w JOIN k ON k.i = w.i + 1)
SELECT t AS "table", chunk, n AS n_rows, c AS content_hash, chain FROM k JOIN w USING (i)""")
def canonical_archive_chain(spark, sf_dir):
    """A tenant's tables in chunks, each hashed over the one before."""
    m = _mutations(spark, sf_dir)
    manifest = archive.export({"mutations": (m, ["seq"]), "documents": (canonical.current(m), ["document_type", "id"])}, "2", scratch(spark, "archive"), 40)
    return manifest.select("table", "chunk", "n_rows", "content_hash", "chain")


@R.query(f"WITH RECURSIVE {CURRENT} SELECT tenant, document_type, id, revision, deleted FROM cur WHERE tenant = '2' UNION ALL SELECT tenant, document_type, id, revision + 1, deleted FROM cur WHERE tenant <> '2'")
def canonical_restore(spark, sf_dir):
    """An archived tenant comes back in place of what it has become; others stay as they have."""
    now = cut(canonical.current(_mutations(spark, sf_dir)))
    folder = scratch(spark, "archive")
    canonical.export({"documents": now}, "2", folder)
    later = now.withColumn("revision", F.col("revision") + 1)
    return canonical.restore({"documents": later}, folder)["documents"].drop("data", "indexes")


@R.query(f"WITH RECURSIVE {CURRENT} SELECT tenant, document_type, id, revision FROM cur WHERE NOT deleted AND tenant = '1' AND u = '5' AND (document_type > 'click' OR document_type = 'click' AND id > '1') ORDER BY document_type, id LIMIT 10")
def canonical_query_equals_after(spark, sf_dir):
    docs = canonical.current(_mutations(spark, sf_dir)).filter("tenant = '1'")
    return canonical.query(docs, {"user": "5"}, limit=10, after=("click", "1")).select(*canonical.DOC, "revision")


STATUS = "CASE event_type WHEN 'signup' THEN 'queued' WHEN 'click' THEN 'running' WHEN 'view' THEN 'waiting' WHEN 'purchase' THEN 'completed' ELSE 'failed' END"
HISTORY = f"SELECT user_id AS run_id, event_id AS seq, {STATUS} AS status, CASE WHEN event_id % 3 = 0 THEN value END AS progress, ts FROM events"


def _history(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.expr(STATUS).alias("status"), F.when(F.col("event_id") % 3 == 0, F.col("value")).alias("progress"), "ts")


@R.query(f"WITH h AS ({HISTORY}) SELECT run_id, arg_max(status, seq) AS status, arg_max(progress, seq) FILTER (WHERE progress IS NOT NULL) AS progress, max(seq) AS last_seq, count(*) AS n_events FROM h GROUP BY run_id")
def run_fold(spark, sf_dir):
    return runs.fold(_history(spark, sf_dir))


@R.query(f"WITH h AS ({HISTORY}), b AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS back FROM h) SELECT run_id, seq, status, row_number() OVER (PARTITION BY run_id ORDER BY seq)::INTEGER AS position FROM b WHERE back <= 3")
def run_tail(spark, sf_dir):
    return runs.tail(_history(spark, sf_dir), 3).select("run_id", "seq", "status", "position")


KEY = "CASE WHEN event_id % 7 > 0 THEN CAST(event_id % 1500 AS VARCHAR(9)) END"
RUNS = f"SELECT event_id AS run_id, {STATUS} AS status, {KEY} AS concurrency_key, ts AS created_at, ts + INTERVAL 1 DAY AS lease_until, (event_id % 6 + 1)::INTEGER AS attempt, event_type AS tag FROM events"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 7 > 0, (F.col("event_id") % 1500).cast("string"))
    return e.select(F.col("event_id").alias("run_id"), F.expr(STATUS).alias("status"), key.alias("concurrency_key"), F.col("ts").alias("created_at"), (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("lease_until"), (F.col("event_id") % 6 + 1).cast("int").alias("attempt"), F.create_map(F.lit("kind"), F.col("event_type")).alias("tags"), F.col("props").alias("result"))


@R.query("""WITH t AS (SELECT CASE WHEN event_id % 9 > 0 THEN CAST(event_id % 400 AS VARCHAR) END AS k, event_type AS hash, event_id AS seq FROM events),
f AS (SELECT *, CASE WHEN k IS NULL THEN seq ELSE min(seq) OVER (PARTITION BY k) END AS fs, CASE WHEN k IS NULL THEN hash ELSE arg_min(hash, seq) OVER (PARTITION BY k) END AS fh FROM t),
g AS (SELECT *, sum((seq = fs)::INT) OVER (ORDER BY seq) AS turn FROM f), h AS (SELECT g.*, o.turn AS first_turn FROM g JOIN g o ON o.seq = g.fs)
SELECT seq, CASE WHEN first_turn > 90 THEN 'queue_full' WHEN seq = fs THEN 'admitted' WHEN hash = fh THEN 'duplicate' ELSE 'conflict' END AS status FROM h""")
def run_admission(spark, sf_dir):
    key = F.when(F.col("event_id") % 9 > 0, (F.col("event_id") % 400).cast("string"))
    e = table(spark, sf_dir, "events").select(key.alias("idempotency_key"), F.col("event_type").alias("hash"), F.col("event_id").alias("seq"))
    return runs.admit(e, 10).select("seq", "status")


@R.query(f"""WITH r AS (SELECT *, status = 'running' AND lease_until <= {NOW} AS over FROM ({RUNS})),
c AS (SELECT *, row_number() OVER (PARTITION BY concurrency_key ORDER BY created_at, run_id) AS turn FROM r WHERE (status = 'queued' OR over) AND NOT EXISTS (SELECT 1 FROM r o WHERE o.concurrency_key = r.concurrency_key AND o.run_id <> r.run_id AND o.status = 'running'))
SELECT run_id, concurrency_key, attempt + 1 AS attempt FROM c WHERE turn = 1 OR concurrency_key IS NULL""")
def run_claims(spark, sf_dir):
    return runs.claims(_runs(spark, sf_dir), F.expr(NOW)).select("run_id", "concurrency_key", "attempt")


WORK = "SELECT CAST(user_id AS BIGINT) AS run_id, event_id AS seq, ts AS moment, CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'report' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'wait' END ELSE 'lease' END AS operation, 't' || (event_id % 2) AS token FROM events"


@R.query(f"""WITH RECURSIVE ops AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS n FROM ({WORK})),
walk AS (SELECT run_id, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS answer, NULL::VARCHAR AS held, NULL::TIMESTAMP AS until, 0 AS attempt, NULL::VARCHAR AS done FROM (SELECT DISTINCT run_id FROM ops)
UNION ALL SELECT run_id, n, seq, answer, CASE WHEN answer = 'leased' THEN token WHEN answer IN ('suspended', 'completed') THEN NULL ELSE held END, CASE WHEN answer IN ('leased', 'renewed') THEN moment + INTERVAL 12 HOUR WHEN answer IN ('suspended', 'completed') THEN NULL ELSE until END, attempt + (answer = 'leased')::INT, CASE WHEN answer = 'completed' THEN token ELSE done END
FROM (SELECT o.*, w.held, w.until, w.attempt, w.done, CASE WHEN o.operation = 'lease' THEN CASE WHEN w.done IS NOT NULL THEN 'done' WHEN w.held IS NOT NULL AND w.until > o.moment THEN 'held' ELSE 'leased' END
 WHEN o.operation = 'complete' AND w.done IS NOT NULL THEN CASE WHEN w.done = o.token THEN 'repeated' ELSE 'not_active' END WHEN w.held = o.token AND w.until > o.moment THEN CASE o.operation WHEN 'heartbeat' THEN 'renewed' WHEN 'report' THEN 'reported' WHEN 'wait' THEN 'suspended' ELSE 'completed' END ELSE 'not_active' END AS answer
 FROM walk w JOIN ops o ON o.run_id = w.run_id AND o.n = w.n + 1))
SELECT run_id, seq, answer, attempt, until AS lease_until FROM walk WHERE n > 0""")
def run_worker_leases(spark, sf_dir):
    kind = "CASE event_type WHEN 'click' THEN 'heartbeat' WHEN 'view' THEN 'report' WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'complete' ELSE 'wait' END ELSE 'lease' END"
    ops = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.expr(kind).alias("operation"), F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("token"), F.lit(43200.0).alias("ttl_seconds"))
    return runs.worker_leases(ops).select("run_id", "seq", "answer", "attempt", "lease_until")


TTL_LEASES = """WITH RECURSIVE ops AS (SELECT CAST(user_id % 20 AS VARCHAR) AS lease_key, event_id AS seq, ts AS moment, event_type = 'error' AS lets_go, CAST(event_id % 3 AS VARCHAR) AS owner, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS n FROM events),
walk AS (SELECT lease_key, 0::BIGINT AS n, NULL::BIGINT AS seq, NULL::VARCHAR AS answer, NULL::VARCHAR AS held, NULL::TIMESTAMP AS until FROM (SELECT DISTINCT lease_key FROM ops)
UNION ALL SELECT o.lease_key, o.n, o.seq, CASE WHEN o.lets_go THEN CASE WHEN w.held = o.owner THEN 'released' ELSE 'not_owner' END WHEN w.held <> o.owner AND w.until > o.moment THEN 'refused' ELSE 'acquired' END,
 CASE WHEN o.lets_go THEN CASE WHEN w.held = o.owner THEN NULL ELSE w.held END WHEN w.held <> o.owner AND w.until > o.moment THEN w.held ELSE o.owner END,
 CASE WHEN o.lets_go OR w.held <> o.owner AND w.until > o.moment THEN w.until ELSE o.moment + INTERVAL 6 HOUR END FROM walk w JOIN ops o ON o.lease_key = w.lease_key AND o.n = w.n + 1)
SELECT lease_key, seq, answer, CASE WHEN answer = 'acquired' THEN until END AS lease_until FROM walk WHERE n > 0"""


def _lease_operations(events):
    return events.select((F.col("user_id") % 20).cast("string").alias("lease_key"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "release").otherwise("acquire").alias("operation"), (F.col("event_id") % 3).cast("string").alias("owner"), F.lit(21600.0).alias("ttl_seconds"))


@R.query(TTL_LEASES)
def run_ttl_leases(spark, sf_dir):
    return runs.ttl_leases(_lease_operations(table(spark, sf_dir, "events"))).select("lease_key", "seq", "answer", "lease_until")


@R.query(TTL_LEASES)
def stream_ttl_leases(spark, sf_dir):
    """Leases answered by a stream that keeps each key's state."""
    operations = _lease_operations(streams.read_events(spark, f"{sf_dir}/events.parquet*"))
    answered = runs.ttl_leases(operations).select("lease_key", "seq", "answer", "lease_until")
    return streams.drained(answered, scratch(spark, "streams"))


#: The state of every run after each of its operations: the open wait, outcomes that are there (th), events kept (ev), and what the operation and an ended wait gave.
WAITS = """
WITH RECURSIVE o AS (SELECT user_id AS run_id, event_id AS seq, ts, event_type IN ('signup', 'click') AS waits, CASE event_type WHEN 'signup' THEN 'timer' ELSE 'external_event' END AS kind, (event_id % 3)::VARCHAR AS name, CASE WHEN event_id % 2 = 0 THEN ts + INTERVAL 8 HOUR END AS fire_at, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
walk(run_id, rn, okind, oname, ofire, th, ev, seq, name, outcome, consumed, ended_name, ended_kind) AS (
 SELECT DISTINCT run_id, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::TIMESTAMP, []::STRUCT(k VARCHAR, o VARCHAR, e BIGINT)[], []::STRUCT(n VARCHAR, e BIGINT)[], NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT, NULL::VARCHAR, NULL::VARCHAR FROM o
 UNION ALL
 SELECT run_id, rn, CASE WHEN suspended THEN kind WHEN NOT resumed THEN okind END, CASE WHEN suspended THEN name WHEN NOT resumed THEN oname END, CASE WHEN suspended THEN fire_at WHEN NOT resumed THEN ofire END,
  CASE WHEN resumed THEN list_append(th, {'k': k, 'o': 'external_event', 'e': seq}) WHEN has_outcome THEN list_filter(th, lambda x: x.k <> k) ELSE th END,
  CASE WHEN NOT waits AND NOT resumed THEN list_append(ev, {'n': name, 'e': seq}) WHEN has_event THEN list_filter(ev, lambda x: x.e <> first_event) ELSE ev END,
  seq, name, CASE WHEN resumed THEN 'resumed' WHEN NOT waits THEN 'kept' WHEN has_outcome THEN held.o WHEN has_event THEN 'external_event' ELSE 'suspended' END,
  CASE WHEN resumed THEN seq WHEN has_outcome THEN held.e WHEN has_event THEN first_event END, ended_name, ended_kind
 FROM (SELECT *, waits AND NOT has_outcome AND NOT has_event AS suspended FROM (
  SELECT *, NOT waits AND COALESCE(okind = 'external_event' AND oname = name, false) AS resumed, held IS NOT NULL AS has_outcome, waits AND held IS NULL AND kind = 'external_event' AND first_event IS NOT NULL AS has_event FROM (
   SELECT *, CASE WHEN waits THEN list_filter(th, lambda x: x.k = k)[1] END AS held, list_filter(ev, lambda x: x.n = name)[1].e AS first_event FROM (
    SELECT run_id, rn, seq, waits, kind, name, fire_at, k, ev, CASE WHEN NOT ended THEN okind END AS okind, CASE WHEN NOT ended THEN oname END AS oname, CASE WHEN NOT ended THEN ofire END AS ofire,
     CASE WHEN ended THEN list_append(th, {'k': okind || ':' || oname, 'o': CASE okind WHEN 'timer' THEN 'timer' ELSE 'timed_out' END, 'e': NULL::BIGINT}) ELSE th END AS th, CASE WHEN ended THEN oname END AS ended_name, CASE WHEN ended THEN okind END AS ended_kind
    FROM (SELECT w.run_id, o.rn, o.seq, o.waits, o.kind, o.name, o.fire_at, o.kind || ':' || o.name AS k, w.okind, w.oname, w.ofire, w.th, w.ev, COALESCE(w.ofire <= o.ts, false) AS ended FROM walk w JOIN o ON o.run_id = w.run_id AND o.rn = w.rn + 1))))))
"""


def _wait_operations(events):
    wait = F.col("event_type").isin("signup", "click")
    kind = F.when(F.col("event_type") == "signup", "timer").when(wait, "external_event")
    return events.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.when(wait, "wait").otherwise("raise").alias("operation"), kind.alias("kind"), (F.col("event_id") % 3).cast("string").alias("name"), F.when(F.col("event_id") % 2 == 0, F.col("ts") + F.expr("INTERVAL 8 HOURS")).alias("fire_at"), "event_id")


@R.query(WAITS + "SELECT run_id, seq, outcome, consumed FROM walk WHERE rn > 0")
def run_waits(spark, sf_dir):
    """Waits for events and timers, and events raised, of each run in turn."""
    return runs.waited(_wait_operations(table(spark, sf_dir, "events"))).select("run_id", "seq", "outcome", "consumed")


@R.query(WAITS + """SELECT run_id, seq, outcome, name, consumed FROM walk WHERE rn > 0
UNION ALL SELECT run_id, NULL, CASE ended_kind WHEN 'timer' THEN 'timer' ELSE 'timed_out' END, ended_name, NULL FROM walk WHERE ended_name IS NOT NULL
UNION ALL SELECT run_id, NULL, CASE okind WHEN 'timer' THEN 'timer' ELSE 'timed_out' END, oname, NULL FROM walk JOIN (SELECT run_id, max(rn) AS rn FROM walk GROUP BY run_id) USING (run_id, rn) WHERE ofire <= (SELECT max(ts) - INTERVAL 2 HOUR FROM events)""")
def stream_waits(spark, sf_dir):
    """The same over a stream, whose timers end waits of runs that have no new row."""
    operations = _wait_operations(streams.read_events(spark, f"{sf_dir}/events.parquet*", at="ts"))
    with waits.with_timers(spark):
        found = streams.drained(waits.timed_waits(operations), scratch(spark, "streams"))
    return found.select("run_id", "seq", "outcome", "name", "consumed")


@R.query("""WITH w AS (SELECT event_id AS wait_id, user_id AS run_id, ts AS since FROM events WHERE event_type = 'signup'),
m AS (SELECT wait_id, min((e.ts, e.event_id)) AS first FROM w JOIN events e ON e.user_id = w.run_id AND e.event_type = 'click' AND e.ts >= since AND e.ts <= since + INTERVAL 8 HOUR GROUP BY wait_id)
SELECT wait_id, run_id, 'click' AS name, first[2] AS event_id, CASE WHEN first IS NULL THEN 'timed_out' ELSE 'resumed' END AS outcome FROM w LEFT JOIN m USING (wait_id) WHERE since <= (SELECT max(ts) - INTERVAL 24 HOUR FROM events)""")
def stream_resumed(spark, sf_dir):
    """Waits resumed by events of another stream or timed out, of those that the watermarks have closed for certain."""
    two = [streams.read_events(spark, f"{sf_dir}/events.parquet*", at="ts") for _ in range(2)]
    asked = two[0].filter("event_type = 'signup'").select(F.col("event_id").alias("wait_id"), F.col("user_id").alias("run_id"), F.lit("click").alias("name"), F.col("ts").alias("since"))
    raised = two[1].select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "event_id", F.col("ts").alias("at"))
    found = streams.drained(waits.resumed_in_time(asked, raised), scratch(spark, "streams"))
    closed = table(spark, sf_dir, "events").agg((F.max("ts") - F.expr("INTERVAL 24 HOURS")).cast("timestamp").alias("closed"))
    return found.join(F.broadcast(closed), F.col("since") <= F.col("closed")).select("wait_id", "run_id", "name", "event_id", "outcome")


@R.query(f"""WITH w AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'timer' ELSE 'external_event' END AS kind, event_type AS name, ts AS fire_at FROM events WHERE event_id % 3 = 0)
SELECT e.event_id AS run_id, w.name, CASE WHEN kind = 'timer' THEN 'timer' ELSE 'timed_out' END AS outcome FROM events e JOIN w USING (event_id) WHERE event_type = 'view' AND fire_at <= {NOW}
UNION ALL SELECT event_id, NULL, 'scheduled' FROM events WHERE event_type = 'view' AND event_id % 3 <> 0 AND ts <= {NOW}""")
def run_activation(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    waits = e.filter("event_id % 3 = 0").select(F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 2 == 0, "timer").otherwise("external_event").alias("kind"), F.col("event_type").alias("name"), F.col("ts").alias("fire_at"))
    return runs.activated(_runs(spark, sf_dir).withColumn("scheduled_at", F.col("created_at")), waits, F.expr(NOW))


@R.query(f"SELECT event_id AS timer_id FROM events WHERE event_id % 4 <> 0 AND ts <= {NOW}")
def run_due_timers(spark, sf_dir):
    timers = table(spark, sf_dir, "events").select(F.col("event_id").alias("timer_id"), F.col("ts").alias("due_at"), (F.col("event_id") % 4 == 0).alias("fired"))
    return runs.due(timers, F.expr(NOW)).select("timer_id")


@R.query("SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id * 2 FROM events)")
def run_unconsumed_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id")
    return runs.unconsumed(e, e.select((2 * F.col("event_id")).alias("event_id")))


@R.query(f"WITH r AS ({RUNS}), s AS (SELECT event_id * 3 AS run_id FROM events WHERE event_id % 5 <> 0), f AS (SELECT * FROM r WHERE status IN ('queued', 'waiting', 'running') AND run_id IN (SELECT run_id FROM s)) SELECT run_id, status, (SELECT count(*) FROM f) AS total FROM f ORDER BY created_at, run_id LIMIT 30")
def run_active_with_start(spark, sf_dir):
    outbox = table(spark, sf_dir, "events").select((3 * F.col("event_id")).alias("run_id"), F.lit("start").alias("kind"), F.when(F.col("event_id") % 5 != 0, F.col("ts")).alias("delivered_at"))
    return runs.active_with_start(_runs(spark, sf_dir), outbox, 30).select("run_id", "status", "total")


@R.query(f"SELECT run_id, created_at FROM ({RUNS}) WHERE status = 'queued' ORDER BY created_at, run_id LIMIT 40")
def run_reconcile(spark, sf_dir):
    return runs.reconcile(_runs(spark, sf_dir), 40)


@R.query(f"SELECT CASE WHEN status = 'running' THEN 'queued' ELSE status END AS status, count(*) AS n, count(*) FILTER (WHERE run_id % 2 = 0 OR status = 'completed') AS leases FROM ({RUNS}) GROUP BY 1")
def run_recovery(spark, sf_dir):
    found = _runs(spark, sf_dir)
    leases = found.select("run_id", F.when(F.col("run_id") % 2 == 0, "coordination").otherwise("external-worker").alias("protocol"), F.col("status").alias("state"))
    after, kept = runs.recovered(found, leases)
    return after.join(kept.select("run_id", F.lit(1).alias("lease")), "run_id", "left").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count("lease").alias("leases"))


def _artifacts(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select((F.col("page_id") % 20).alias("run_id"), F.col("page_id").alias("artifact_id"), F.concat(F.lit("name"), (F.col("page_id") % 7).cast("string")).alias("name"), F.col("page_id").alias("created_at"), F.col("html").alias("content"))


@R.query("SELECT page_id % 20 AS run_id, page_id AS artifact_id, octet_length(encode(html))::BIGINT AS size, sha256(html) AS content_hash, CASE WHEN octet_length(encode(html)) > 2000 THEN 'artifact://' || (page_id % 20) || '/' || page_id END AS uri, CASE WHEN octet_length(encode(html)) <= 2000 THEN html END AS content FROM pages")
def run_artifacts(spark, sf_dir):
    return runs.artifacts(_artifacts(spark, sf_dir), 2000).select("run_id", "artifact_id", "size", "content_hash", "uri", "content")


@R.query("SELECT run_id, ref, max(page_id) AS artifact_id FROM (SELECT page_id % 20 AS run_id, page_id, 'name' || (page_id % 7) AS ref FROM pages UNION ALL SELECT page_id % 20, page_id, CAST(page_id AS VARCHAR) FROM pages) WHERE (run_id, ref) IN (SELECT page_id % 20, 'name3' FROM pages UNION SELECT page_id % 20, CAST(page_id AS VARCHAR) FROM pages WHERE page_id % 5 = 0) GROUP BY ALL")
def run_artifact_lookup(spark, sf_dir):
    listed = _artifacts(spark, sf_dir)
    asked = listed.select("run_id", F.lit("name3").alias("ref")).distinct().unionByName(listed.filter("artifact_id % 5 = 0").select("run_id", F.col("artifact_id").cast("string").alias("ref")))
    return runs.artifact(listed, asked).select("run_id", "ref", "artifact_id")


@R.query(f"WITH r AS ({RUNS}) SELECT attempt, CASE WHEN status IN ('queued', 'waiting') THEN 'cancelled' WHEN status = 'running' THEN 'cancel_requested' ELSE status END AS after_cancel, CASE WHEN status = 'running' THEN 'queued' ELSE status END AS after_crash, least(60.0, 1.5 * pow(2.0, attempt - 1)) AS delay, count(*) AS n FROM r GROUP BY ALL")
def run_transitions(spark, sf_dir):
    found = _runs(spark, sf_dir).select("attempt", runs.cancel(F.col("status")).alias("after_cancel"), runs.recover(F.col("status")).alias("after_crash"), runs.backoff(F.col("attempt"), 1.5).alias("delay"))
    return found.groupBy("attempt", "after_cancel", "after_crash", "delay").agg(F.count(F.lit(1)).alias("n"))


@R.query(f"WITH r AS ({RUNS}) SELECT run_id, status FROM r WHERE status IN ('completed', 'failed', 'cancelled') ORDER BY created_at DESC, run_id LIMIT 50 OFFSET 200")
def run_retention(spark, sf_dir):
    return runs.retain(_runs(spark, sf_dir), 200, 50, "created_at").select("run_id", "status")


@R.query(f"SELECT run_id FROM (SELECT * FROM ({RUNS}) WHERE status = 'queued' AND created_at > TIMESTAMP '2024-01-05' AND created_at < {NOW} ORDER BY created_at DESC, run_id DESC LIMIT 50) WHERE tag = 'signup'")
def run_listing(spark, sf_dir):
    after, before = datetime.datetime(2024, 1, 5), datetime.datetime(2024, 1, 15)
    return runs.listing(_runs(spark, sf_dir), {"status": "queued"}, {"kind": "signup"}, after={"created_at": after}, before={"created_at": before}).select("run_id")


@R.query("SELECT w.user_id AS run_id, w.event_type AS name, arg_min(e.event_id, (e.ts, e.event_id)) AS event_id, min(e.ts) AS at FROM (SELECT user_id, event_type, min(ts) AS since FROM events GROUP BY ALL) w JOIN events e ON e.user_id = w.user_id AND e.event_type = w.event_type AND e.ts >= w.since + INTERVAL 1 HOUR GROUP BY ALL".replace(" AS at FROM", " AS \"at\" FROM"))
def run_resume(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("name"), "event_id", F.col("ts").alias("at"))
    waits = e.groupBy("run_id", "name").agg((F.min("at") + F.expr("INTERVAL 1 HOUR")).alias("since"))
    return runs.resumed(waits, e)


@R.query("SELECT user_id, event_type, arg_max(value, event_id) AS value, max(event_id) AS event_id FROM events GROUP BY ALL")
def checkpoint_latest(spark, sf_dir):
    return runs.latest(table(spark, sf_dir, "events"), ["user_id", "event_type"], "value", "event_id")


def _traces(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("operation"), F.concat(F.lit("a"), (F.col("user_id") % 5).cast("string")).alias("adapter"), F.col("value").alias("duration"), F.col("ts").alias("created_at"), F.col("props").alias("detail"))


@R.query("SELECT event_type AS operation, count(*) AS n, min(ts) AS first_at, max(ts) AS last_at, count(DISTINCT user_id % 5) AS n_adapters, round(avg(value), 6) AS mean_duration FROM events GROUP BY 1")
def trace_summary(spark, sf_dir):
    return runs.trace_summary(_traces(spark, sf_dir))


@R.query("""WITH s AS (SELECT event_type AS operation, substring(props, 1, 128) AS value, count(*) AS n, min((ts, event_id)) AS first FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY first) AS k FROM s)
SELECT operation, CASE WHEN k > 64 THEN '_other' ELSE value END AS value, sum(n)::BIGINT AS n FROM r GROUP BY 1, 2""")
def trace_values(spark, sf_dir):
    return runs.value_counts(_traces(spark, sf_dir), "detail")


@R.query("""WITH s AS (SELECT event_type AS operation, 'adapter' AS kind, 'a' || (user_id % 5) AS value, count(*) AS n FROM events GROUP BY ALL UNION ALL SELECT operation, 'detail', CASE WHEN k > 64 THEN '_other' ELSE value END, sum(n) FROM (SELECT *, row_number() OVER (PARTITION BY operation ORDER BY first) AS k FROM (SELECT event_type AS operation, substring(props, 1, 128) AS value, count(*) AS n, min((ts, event_id)) AS first FROM events GROUP BY 1, 2)) GROUP BY ALL),
t AS (SELECT operation, kind, '{' || string_agg(to_json(value) || ':' || n::BIGINT, ',' ORDER BY n DESC, value) || '}' AS counts FROM s GROUP BY ALL)
SELECT operation, max(counts) FILTER (WHERE kind = 'adapter') AS adapter_counts, max(counts) FILTER (WHERE kind = 'detail') AS detail_counts FROM t GROUP BY operation""")
def trace_counts(spark, sf_dir):
    return runs.trace_counts(_traces(spark, sf_dir), ["adapter", "detail"])


@R.query("SELECT event_id AS trace_id, event_type AS operation FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id LIMIT 100")
def trace_list(spark, sf_dir):
    return runs.trace_list(_traces(spark, sf_dir), "click").select("trace_id", "operation")


#: Requests in which some names and values are not to leave.
UNSAFE = """CASE event_id % 4 WHEN 0 THEN '{"a":[{"api_key":"x"},"Bearer abc"]}' WHEN 1 THEN '{"Pass-Word":{"k":1}}' ELSE props END"""


@R.query("""SELECT event_id AS trace_id, unnest(CASE event_id % 4 WHEN 0 THEN ['request.a[0].api_key', 'request.a[1]'] WHEN 1 THEN ['request.Pass-Word'] ELSE [] END) AS path, unnest(CASE event_id % 4 WHEN 0 THEN ['sensitive_field_name', 'bearer_token_value'] WHEN 1 THEN ['sensitive_field_name'] ELSE [] END) AS reason FROM events""")
def trace_unsafe_fields(spark, sf_dir):
    traces = _traces(spark, sf_dir).withColumn("request", F.expr(UNSAFE.replace("event_id", "trace_id").replace("props", "detail")))
    return runs.unsafe_fields(traces, {"request": "request", "detail": "resultSummary"})


@R.query("""WITH l AS (SELECT '{"adapter":"a' || (user_id % 5) || '","operation":"error","trace_id":' || event_id || '}' AS line, row_number() OVER (ORDER BY ts DESC, event_id) AS n FROM events WHERE event_type = 'error')
SELECT count(*) AS n_traces, (SELECT count(*) FROM events WHERE event_type = 'error' AND event_id % 4 = 1 AND event_id IN (SELECT event_id FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id LIMIT 50)) AS n_warnings, sha256(string_agg(line, chr(10) ORDER BY n)) AS content_hash FROM l WHERE n <= 50""")
def trace_export(spark, sf_dir):
    traces = _traces(spark, sf_dir).withColumn("detail", F.when(F.col("trace_id") % 4 == 1, '{"token": 1}').otherwise(F.col("detail")))
    return runs.trace_export(traces, {"detail": "resultSummary"}, ["adapter", "operation", "trace_id"], "error", 50)


@R.query(f"SELECT event_id AS trace_id FROM events WHERE event_type = 'error' AND ts < {NOW} ORDER BY ts DESC, event_id LIMIT 100 OFFSET 20")
def trace_prune(spark, sf_dir):
    return runs.trace_prune(_traces(spark, sf_dir), F.expr(NOW), "error", 20).select("trace_id")


@R.query("SELECT count(*) AS n_records, count(DISTINCT label) AS n_partitions, sum((vec_id % 10 = 0)::INT)::BIGINT AS missing_vector, sum((vec_id % 10 = 1)::INT)::BIGINT AS empty_vector, sum((vec_id % 10 = 2)::INT)::BIGINT AS dimension_mismatch, 1 - sum((vec_id % 10 = 0)::INT) / count(*) AS coverage FROM embeddings")
def collection_inspect(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("partition_key"), F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 10 == 1, F.array().cast("array<float>")).when(F.col("vec_id") % 10 == 2, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("vector"))
    return runs.inspect_collection(v.drop("vector"), v.filter("id % 10 <> 0"), 64, ["partition_key", "id"])
