"""Objects, snapshots, orders, handlers, streams and other parts of the platform."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quillstone.catalog.base import Registry, table
from quillstone.catalog.records import RECORDS, _docs
from quillstone.operators import context, evaluation, handlers, ingest, lexical, runs
from quillstone.plans import paging
from quillstone.plans.filters import Paths
from quillstone.sources import collections, objects, records
from quillstone.sources.tables import scratch
from quillstone.streaming import events as streams

R = Registry()


def _objects(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("body"))


def _some(df, *classes):
    """Every object, in one of three classes by the first digit of its body's hash."""
    return df.filter((F.ascii(F.sha2("body", 256)) % 3).isin(*classes))


CLASS = "ascii(sha256(html)) % 3"


@R.query(f"SELECT 'page/' || page_id AS key, CASE WHEN {CLASS} = 0 THEN 'created' WHEN {CLASS} = 1 THEN 'replaced' ELSE 'precondition_failed' END AS status FROM pages")
def object_put(spark, sf_dir):
    found = _objects(spark, sf_dir)
    puts = found.select("key", F.lit("new").alias("body"), F.lit(None).cast("string").alias("if_match"), ((F.ascii(F.sha2("body", 256)) % 3) == 2).alias("if_none_match"))
    return objects.put_status(_some(found, 1, 2), puts)


@R.query(f"SELECT 'page/' || page_id AS key, CASE WHEN {CLASS} = 2 THEN sha256(html) ELSE sha256('new') END AS etag FROM pages")
def object_put_state(spark, sf_dir):
    found = _objects(spark, sf_dir)
    puts = found.select("key", F.lit("new").alias("body"), F.when((F.ascii(F.sha2("body", 256)) % 3) == 2, "other").alias("if_match"), F.lit(False).alias("if_none_match"))
    after = objects.put(_some(found, 1, 2), puts)
    return after.select("key", F.sha2("body", 256).alias("etag"))


@R.query(f"SELECT 'page/' || page_id AS key, {CLASS} > 0 AS found, CASE WHEN {CLASS} > 0 THEN octet_length(encode(html)) END AS length, CASE WHEN {CLASS} > 0 THEN sha256(html) END AS etag FROM pages")
def object_get(spark, sf_dir):
    found = _objects(spark, sf_dir)
    return objects.get(_some(found, 1, 2), found.select("key")).drop("body")


@R.query(f"SELECT 'page/' || page_id AS key, CASE WHEN {CLASS} = 0 THEN 'missing' WHEN {CLASS} = 1 THEN 'precondition_failed' ELSE 'deleted' END AS status FROM pages")
def object_delete(spark, sf_dir):
    found = _objects(spark, sf_dir)
    deletes = found.select("key", F.when((F.ascii(F.sha2("body", 256)) % 3) == 1, "other").when((F.ascii(F.sha2("body", 256)) % 3) == 2, F.sha2("body", 256)).alias("if_match"))
    return objects.delete_status(_some(found, 1, 2), deletes)


@R.query(f"""WITH l AS (SELECT source || '/' || lang || '/doc-' || doc_id || '.txt' AS path, sha256(text) AS revision, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE contains(text, 'license') AND regexp_matches(source || '/' || lang || '/doc-' || doc_id || '.txt', '^src1[^/]/.*[.]txt$') AND NOT regexp_matches(source || '/' || lang || '/doc-' || doc_id || '.txt', '/doc-[^/]*7[.]txt$')),
h AS (SELECT path, line::INTEGER AS line, instr(content, 'license')::INTEGER AS "column", content, revision FROM l WHERE contains(content, 'license')), n AS (SELECT *, row_number() OVER (ORDER BY path, line, "column") AS k, count(*) OVER () > 20 AS truncated FROM h) SELECT path, line, "column", content, revision, truncated FROM n WHERE k <= 20""")
def text_search_globs(spark, sf_dir):
    path = F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return objects.grep(table(spark, sf_dir, "documents"), "license", path, limit=20, include=["src1?/**/*.txt"], exclude=["**/doc-*7.txt"], with_revision=True)


@R.query("SELECT event_id, '{\"k\":' || json_extract_string(props, '$.k') || ',\"t\":\"\\u003C' || event_type || '\\u003E\"}' AS body FROM events")
def snapshot_canonical(spark, sf_dir):
    body = F.concat(F.expr("substring(props, 1, length(props) - 1)"), F.lit(', "t": "<'), "event_type", F.lit('>"}'))
    return table(spark, sf_dir, "events").select("event_id", records.canonical(body).alias("body"))


@R.query("SELECT name, record_count, CASE name WHEN 'a' THEN 'none' WHEN 'b' THEN 'record_count' ELSE 'content_hash' END AS problem FROM (SELECT unnest(['a', 'b', 'c']) AS name, (SELECT count(*) FROM customer) AS record_count)")
def snapshot_import_check(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("partition_key"), F.col("c_name").alias("id"), "c_custkey")
    found = records.snapshot(customers, ["partition_key", "id", "c_custkey"], 10**6)
    named = found.withColumn("name", F.explode(F.array(*map(F.lit, "abc"))))
    expected = named.select("name", F.when(F.col("name") == "b", 0).otherwise(F.col("record_count")).alias("record_count"), F.when(F.col("name") == "c", "x").otherwise(F.col("content_hash")).alias("content_hash"))
    return records.import_check(named, expected).select("name", "record_count", "problem")


#: Values of several types, or none, by an event's type.
MIXED = """CASE event_type WHEN 'click' THEN props WHEN 'view' THEN '{"k": "' || user_id || '"}' WHEN 'error' THEN '{"k": true}' WHEN 'signup' THEN '{"k": null}' ELSE '{}' END"""


@R.query(f"""WITH m AS (SELECT event_id, event_type, user_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
o AS (SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 1 WHEN 'view' THEN 2 ELSE 0 END DESC, CASE event_type WHEN 'click' THEN k WHEN 'error' THEN 1.0 END DESC NULLS LAST, CASE event_type WHEN 'view' THEN CAST(user_id AS VARCHAR) END DESC NULLS LAST, event_id) AS position FROM m) SELECT event_id, position::INTEGER AS position FROM o WHERE position <= 50""")
def order_mixed(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "events").withColumn("body", F.expr(MIXED)).select("event_id", Paths({}, "body").variant("/k").alias("node"))
    order = [*paging.mixed_order(F.col("node"), descending=True), F.col("event_id")]
    top = e.orderBy(*order).limit(50)
    return top.select("event_id", F.row_number().over(Window.orderBy(*order)).alias("position"))


@R.query("SELECT event_id, v FROM (SELECT event_id, CASE WHEN event_type <> 'view' THEN value END AS v FROM events) ORDER BY v ASC NULLS LAST, event_id DESC NULLS LAST LIMIT 30")
def order_nulls_last(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("value")).alias("v"))
    return e.orderBy(*paging.order_columns([("v", "asc"), ("event_id", "desc")], (), nulls_last=True)).limit(30)


@R.query(f"""SELECT id, '/content/n' AS field, CAST(n_chars AS VARCHAR) AS text FROM ({RECORDS}) UNION ALL SELECT id, '/content/parts/0', lang FROM ({RECORDS}) WHERE lang IS NOT NULL UNION ALL SELECT id, '/content/parts/1/long', CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END FROM ({RECORDS}) UNION ALL SELECT id, '/id', id FROM ({RECORDS})""")
def leaf_flatten(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    body = F.concat(F.lit('{"content": {"n": '), F.col("n_chars").cast("string"), F.lit(', "parts": ["'), "lang", F.lit('", {"long": '), (F.col("n_chars") > 1000).cast("string"), F.lit(', "gone": null}]}, "id": "'), "id", F.lit('", "other": 1}'))
    return lexical.leaves(docs.select("id", body.alias("body")), ["id"])


@R.query("SELECT event_id, CASE event_type WHEN 'click' THEN '{\"k\":' || json_extract_string(props, '$.k') || '}' WHEN 'view' THEN 'plain' ELSE '' END AS text FROM events")
def text_extract(spark, sf_dir):
    inner = F.when(F.col("event_type") == "click", F.concat(F.lit('{"text": '), "props", F.lit("}"))).when(F.col("event_type") == "view", '{"text": "plain"}').otherwise('{"other": 1}')
    paths = Paths({}, "body")
    e = table(spark, sf_dir, "events").withColumn("body", inner)
    node = paths.variant("/text")
    plain = F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(node, "$", "string"))
    return e.select("event_id", context.text_of(plain, F.to_json(node)).alias("text"))


REGISTRY = handlers.Registry()


@REGISTRY.handler("payload.digest", max_attempts=2)
def _digest(payload: dict) -> dict:
    """The hash of a payload's canonical text; a ``k`` beyond 90 is refused."""
    if payload.get("k", 0) > 90:
        raise ValueError("too large")
    return {"contentHash": "sha256:" + hashlib.sha256(records.canonical_json(payload).encode()).hexdigest()}


@REGISTRY.handler("text.facts", max_attempts=2)
def _facts(payload: dict) -> dict:
    """The hash of a payload's canonical text, and the hash, length and first line of the text that it holds."""
    text = payload["text"]
    return {**_digest(payload), "textHash": "sha256:" + hashlib.sha256(text.encode()).hexdigest(), "textLength": len(text), "firstLine": next((line for line in text.split("\n") if line), text)}


@R.query("""WITH e AS (SELECT event_id, event_type, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, event_id % 2 + 1 AS attempt FROM events)
SELECT event_id, CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'view' THEN 'rejected' WHEN event_type = 'signup' THEN 'completed' WHEN k > 90 AND attempt = 2 THEN 'failed' WHEN k > 90 THEN 'queued' ELSE 'completed' END AS status,
CASE WHEN event_type = 'signup' THEN '{"contentHash":"sha256:' || sha256('{"text":"event ' || event_id || '\\nx"}') || '","textHash":"sha256:' || sha256('event ' || event_id || chr(10) || 'x') || '","textLength":' || length('event ' || event_id || chr(10) || 'x') || ',"firstLine":"event ' || event_id || '"}' WHEN event_type IN ('click', 'purchase') AND k <= 90 THEN '{"contentHash":"sha256:' || sha256('{"k":' || k || '}') || '"}' END AS result,
CASE WHEN event_type = 'error' THEN 'unknown_handler' WHEN event_type = 'view' THEN 'invalid_payload' WHEN event_type IN ('click', 'purchase') AND k > 90 THEN 'too large' END AS error FROM e""")
def handler_jobs(spark, sf_dir):
    kind = F.col("event_type")
    text = F.concat(F.lit('{"text": "event '), F.col("event_id").cast("string"), F.lit('\\nx"}'))
    runs = table(spark, sf_dir, "events").select("event_id", F.when(kind == "error", "none").when(kind == "signup", "text.facts").otherwise("payload.digest").alias("handler_id"), F.when(kind == "view", "[1]").when(kind == "signup", text).otherwise(F.col("props")).alias("payload"), (F.col("event_id") % 2 + 1).cast("int").alias("attempt"))
    return REGISTRY.execute(runs).select("event_id", "status", "result", "error")


@R.query("""WITH c AS (SELECT conv_id AS brief_id, turn AS claim_id, role, length(text) AS l FROM conversations)
SELECT brief_id, claim_id, 'blank_claim' AS problem FROM c WHERE role = 'user' AND l > 60 UNION ALL SELECT brief_id, claim_id, 'uncited_claim' FROM c WHERE role = 'assistant' UNION ALL SELECT brief_id, claim_id, 'unknown_citation' FROM c a WHERE role <> 'assistant' AND claim_id + 1 NOT IN (SELECT claim_id FROM c b WHERE b.brief_id = a.brief_id)""")
def evidence_briefs(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    name = F.col("turn").cast("string")
    claims = turns.select(F.col("conv_id").alias("brief_id"), F.col("turn").alias("claim_id"), F.when((F.col("role") == "user") & (F.length("text") > 60), " ").otherwise("claim").alias("text"), F.when(F.col("role") != "assistant", F.array(name)).alias("citation_ids"), F.when(F.col("role") != "assistant", F.array((F.col("turn") + 1).cast("string"))).alias("counter_ids"))
    return evaluation.brief_problems(claims, turns.select(F.col("conv_id").alias("brief_id"), name.alias("citation_id")))


def _stream(spark, sf_dir):
    return streams.read_events(spark, f"{sf_dir}/events.parquet*", at="ts")


def _folder(spark):
    return scratch(spark, "streams")


LAST = "(SELECT max(ts) - INTERVAL 2 HOUR FROM events)"


@R.query(f"SELECT * FROM (SELECT event_type, date_trunc('hour', ts) AS window_start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2) WHERE window_start + INTERVAL 1 HOUR <= {LAST}")
def stream_tumbling(spark, sf_dir):
    """Hourly counts of the windows that the watermark has closed, as a stream gives them."""
    found = streams.drained(streams.tumbling(_stream(spark, sf_dir)), _folder(spark))
    return found.withColumns({"window_start": F.col("window_start").cast("timestamp_ntz"), "total": F.round("total", 4)})


@R.query(f"""WITH m AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM m)
SELECT * FROM (SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, k) WHERE session_end <= {LAST}""")
def stream_sessions(spark, sf_dir):
    """Sessions that the watermark has closed."""
    found = streams.drained(streams.sessions(_stream(spark, sf_dir)), _folder(spark))
    return found.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@R.query("SELECT event_id, event_type FROM events")
def stream_first_seen(spark, sf_dir):
    """Events that each come twice, once."""
    once = _stream(spark, sf_dir)
    twice = once.unionByName(once)
    return streams.drained(streams.first_seen(twice).select("event_id", "event_type"), _folder(spark))


@R.query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def stream_outbox_pump(spark, sf_dir):
    folder = _folder(spark)
    events = streams.read_events(spark, f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type")
    query = streams.pump(events, f"{folder}/state", f"{folder}/checkpoint", "user_id", "event_id")
    query.awaitTermination()
    return streams.latest_state(spark, f"{folder}/state", events.schema, "user_id", "event_id").select("user_id", "event_id", "event_type")


@R.query(f"SELECT id, lang, n_chars FROM ({RECORDS}) WHERE (partition_key, id) IN (SELECT CASE WHEN length(c_name) % 2 = 0 THEN 'src3' ELSE 'src' || (c_custkey % 20) END, 'doc-' || c_custkey FROM customer)")
def point_lookups(spark, sf_dir):
    """Many records by their keys, one join."""
    source = F.when(F.length("c_name") % 2 == 0, "src3").otherwise(F.concat(F.lit("src"), (F.col("c_custkey") % 20).cast("string")))
    keys = table(spark, sf_dir, "customer").select(source.alias("partition_key"), F.concat(F.lit("doc-"), F.col("c_custkey").cast("string")).alias("id")).distinct()
    return _docs(spark, sf_dir).join(keys, ["partition_key", "id"], "left_semi").select("id", "lang", "n_chars")


@R.query(f"SELECT partition_key, id FROM ({RECORDS}) WHERE partition_key IN ('src1', 'src7')")
def partition_filter(spark, sf_dir):
    """Two partitions of a collection that is stored by them."""
    catalog = collections.Catalog(spark, _folder(spark))
    catalog.create(collections.Policy("docs", indexed=("/metadata/lang",)))
    catalog.write("docs", _docs(spark, sf_dir))
    return catalog.read("docs", ["src1", "src7"]).select("partition_key", "id")


@R.query(f"SELECT lang AS partition_key, id, CASE WHEN partition_key IN ('src1', 'src2') THEN 'new' ELSE 'old' END AS body FROM ({RECORDS})")
def snapshot_import(spark, sf_dir):
    """A collection after a snapshot of some of its records is imported under its name."""
    docs = _docs(spark, sf_dir).select("partition_key", "id", F.col("lang"), F.lit("old").alias("body"))
    catalog = collections.Catalog(spark, _folder(spark))
    policy = collections.Policy("docs")
    records_of = lambda df: df.select(F.col("lang").alias("partition_key"), "id", "body")
    catalog.import_snapshot("docs", policy, records_of(docs), ["partition_key", "id", "body"])
    changed = docs.filter(F.col("partition_key").isin("src1", "src2")).withColumn("body", F.lit("new"))
    other = collections.Policy("elsewhere")
    catalog.import_snapshot("docs", other, records_of(changed), ["partition_key", "id", "body"], allow_rename=True)
    return catalog.read("docs")


@R.query("""WITH r AS (SELECT vec_id, CASE WHEN label < 5 THEN 'low' END AS type FROM embeddings), v AS (SELECT vec_id, label, CASE WHEN label = 9 THEN 'other' ELSE 'main' END AS field, CASE label WHEN 1 THEN 0 WHEN 2 THEN 32 ELSE 64 END AS size, 'p' || (label % 2) AS provider FROM embeddings WHERE label <> 0)
SELECT 'type' AS kind, COALESCE(type, '(missing)') AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT 'provider', provider, count(*) FROM v GROUP BY ALL UNION ALL SELECT 'model', '(missing)', count(*) FROM v UNION ALL SELECT 'present_vectors', 'main', count(*) FROM v WHERE field = 'main' UNION ALL SELECT 'missing_vectors', 'main', (SELECT count(*) FROM r) - (SELECT count(*) FROM v WHERE field = 'main')
UNION ALL SELECT 'empty_vectors', 'main', count(*) FROM v WHERE field = 'main' AND size = 0 UNION ALL SELECT 'mismatched_vectors', 'main', count(*) FROM v WHERE field = 'main' AND size = 32 UNION ALL SELECT 'undeclared_field', field, count(*) FROM v WHERE field = 'other' GROUP BY ALL""")
def collection_details(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    found = e.select("vec_id", F.when(F.col("label") < 5, "low").alias("type"))
    body = F.when(F.col("label") == 1, F.slice("embedding", 1, 0)).when(F.col("label") == 2, F.slice("embedding", 1, 32)).otherwise(F.col("embedding"))
    held = e.filter("label <> 0").select("vec_id", F.when(F.col("label") == 9, "other").otherwise("main").alias("field"), body.alias("vector"), F.concat(F.lit("p"), (F.col("label") % 2).cast("string")).alias("provider"), F.lit(None).cast("string").alias("model"))
    return runs.inspect_details(found, held, {"main": 64}, ["vec_id"])


#: Results and expectations that know each other by aliases (a result's own id, and that of its label's first vector) or by a span of a source, in an order that is not that of their names; one counts in a collection alone.
ALIASED = """r AS (SELECT vec_id, label, vec_id % 50 AS query_id, row_number() OVER (PARTITION BY vec_id % 50 ORDER BY vec_id) AS rank, ['v' || vec_id, 'l' || label] AS refs FROM embeddings), e AS (SELECT DISTINCT vec_id % 50 AS query_id, label % 3 AS g, 'x' || (label % 3) AS ref, label % 3 + 1 AS relevance, (label % 3 * 2) % 3 AS p, ['l' || (label % 3), 'v' || (label % 3 + 100)] AS refs FROM embeddings)"""


@R.query(f"""WITH {ALIASED}, m AS (SELECT r.query_id, r.rank, arg_min(e.ref, (e.p, e.ref)) AS ref FROM r JOIN e ON r.query_id = e.query_id AND (g <> 2 OR vec_id % 4 < 3) AND (len(list_intersect(r.refs, e.refs)) > 0 OR label = 7 AND vec_id <= 200 + g * 50 AND vec_id + 300 >= 210) WHERE r.rank <= 10 GROUP BY ALL), h AS (SELECT m.query_id, count(DISTINCT m.ref) AS hits, min(rank) AS first, sum(relevance / log2(rank + 1.0)) AS dcg FROM m JOIN e USING (query_id, ref) GROUP BY m.query_id),
i AS (SELECT query_id, count(*) AS n_expected, sum(relevance / log2(p + 1.0)) AS ideal FROM (SELECT * EXCLUDE (p), row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC, ref) AS p FROM e) GROUP BY query_id)
SELECT query_id, n_expected, COALESCE(hits, 0) AS hits, round(COALESCE(1.0 / first, 0), 6) AS reciprocal_rank, round(COALESCE(dcg / ideal, 0), 6) AS ndcg FROM i LEFT JOIN h USING (query_id)""")
def evaluation_aliases(spark, sf_dir):
    from pyspark.sql.window import Window

    e = table(spark, sf_dir, "embeddings").withColumn("query_id", F.col("vec_id") % 50)
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    sources = lambda id_, begin, end: F.array(F.struct(id_, F.lit(None), F.lit(None), F.struct(begin, end, F.lit(None), F.lit(None), F.lit(None)))).cast(evaluation.SOURCES)
    results = e.select("query_id", F.row_number().over(Window.partitionBy("query_id").orderBy("vec_id")).alias("rank"), F.array(name("v", F.col("vec_id")), name("l", F.col("label"))).alias("refs"), F.when(F.col("vec_id") % 4 < 3, "main").otherwise("other").alias("collection"), sources(name("s", F.col("label")), F.col("vec_id"), F.col("vec_id") + 300).alias("sources"))
    group = F.col("label") % 3
    expected = e.select("query_id", group.alias("g")).distinct().select("query_id", name("x", F.col("g")).alias("ref"), (F.col("g") + 1).alias("relevance"), (F.col("g") * 2 % 3).alias("position"), F.array(name("l", F.col("g")), name("v", F.col("g") + 100)).alias("refs"), F.when(F.col("g") == 2, "main").alias("collection"), sources(F.lit("s7"), 200 + F.col("g") * 50, F.lit(210)).alias("sources"))
    found = evaluation.first_match(results, expected)
    return found.select("query_id", "n_expected", "hits", F.round("reciprocal_rank", 6).alias("reciprocal_rank"), F.round("ndcg", 6).alias("ndcg"))


@R.query("SELECT round(avg(CASE WHEN event_type <> 'view' THEN (event_type = 'error')::INT END), 6) AS rerank_fallback_rate FROM events")
def evaluation_fallbacks(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("event_type") != "view").alias("reranked"), (F.col("event_type") == "error").alias("fell_back"))
    return evaluation.fallback_rate(e)


@R.query("SELECT event_id, CASE WHEN event_type = 'click' THEN 'query: ' || props WHEN event_type = 'view' THEN 'query: x' ELSE 'query: ' || event_type END AS text FROM events")
def embed_purpose(spark, sf_dir):
    text = F.when(F.col("event_type") == "click", F.col("props")).when(F.col("event_type") == "view", "query: x").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", ingest.with_purpose(text, "query").alias("text"))
