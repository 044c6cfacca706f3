"""Records: scans, filters, pages, writes, snapshots, objects and literal search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.catalog.base import Registry, table
from quillstone.plans import filters, paging
from quillstone.sources import objects, records
from quillstone.sources.log import Records
from quillstone.sources.tables import scratch

R = Registry()
DOC_PATHS = filters.Paths({"/id": "id", "/partitionKey": "partition_key", "/metadata/lang": "lang", "/metadata/nChars": "n_chars", "/content/text": "text"})
EVENT_PATHS = filters.Paths({"/id": "event_id", "/type": "event_type"}, body="body")
RECORDS = "SELECT source AS partition_key, 'doc-' || CAST(doc_id AS VARCHAR) AS id, doc_id, lang, n_chars, text FROM documents"
#: Bodies in which k is a number, an explicit null or missing, by the event's id.
BODY = "CASE WHEN event_id % 5 = 0 THEN '{\"other\": 1}' WHEN event_id % 7 = 0 THEN '{\"k\": null}' ELSE props END"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.as_records(table(spark, sf_dir, "documents"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("body", F.expr(BODY))


@R.query("SELECT source AS partition_key, count(*) AS n, sum(n_chars)::BIGINT AS n_chars FROM documents GROUP BY source")
def collection_scan(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("partition_key").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("n_chars"))


@R.query(f"SELECT id, lang, n_chars FROM ({RECORDS}) WHERE partition_key = 'src3' AND id = 'doc-63'")
def point_lookup(spark, sf_dir):
    tree = {"all": [{"path": "/partitionKey", "value": "src3"}, {"path": "/id", "value": "doc-63"}]}
    return _docs(spark, sf_dir).filter(filters.build(tree, DOC_PATHS)).select("id", "lang", "n_chars")


@R.query(f"SELECT id, lang, n_chars FROM ({RECORDS}) WHERE (lang IN ('en', 'de') AND n_chars >= 500) AND (contains(text, 'tion') OR starts_with(id, 'doc-1')) AND lang <> 'fr'")
def filter_tree(spark, sf_dir):
    tree = {"all": [{"path": "/metadata/lang", "op": "in", "value": ["en", "de"]}, {"path": "$.metadata.nChars", "op": "gte", "value": 500}, {"any": [{"path": "/content/text", "op": "contains", "value": "tion"}, {"path": "/id", "op": "startsWith", "value": "doc-1"}]}, {"path": "/metadata/lang", "op": "neq", "value": "fr"}]}
    return _docs(spark, sf_dir).filter(filters.build(tree, DOC_PATHS)).select("id", "lang", "n_chars")


@R.query(f"SELECT event_id FROM (SELECT event_id, {BODY} AS body FROM events) WHERE json_type(body, '$.k') = 'NULL'")
def filter_eq_null(spark, sf_dir):
    return _events(spark, sf_dir).filter(filters.build({"path": "/k", "op": "eq", "value": None}, EVENT_PATHS)).select("event_id")


@R.query(f"SELECT event_id FROM (SELECT event_id, {BODY} AS body FROM events) WHERE json_type(body, '$.k') IS NULL")
def filter_missing(spark, sf_dir):
    return _events(spark, sf_dir).filter(filters.build({"path": "/k", "op": "exists", "value": False}, EVENT_PATHS)).select("event_id")


@R.query(f"SELECT event_id, event_type FROM (SELECT event_id, event_type, {BODY} AS body FROM events) WHERE TRY_CAST(json_extract_string(body, '$.k') AS DOUBLE) <> 50 AND TRY_CAST(json_extract_string(body, '$.k') AS DOUBLE) > 40 OR event_type = 'error'")
def filter_json_range(spark, sf_dir):
    tree = {"any": [{"all": [{"path": "/k", "op": "neq", "value": 50}, {"path": "/k", "op": "gt", "value": 40}]}, {"path": "/type", "value": "error"}]}
    return _events(spark, sf_dir).filter(filters.build(tree, EVENT_PATHS)).select("event_id", "event_type")


@R.query("SELECT event_id FROM events WHERE false")
def filter_in_empty(spark, sf_dir):
    return _events(spark, sf_dir).filter(filters.build({"path": "/k", "op": "in", "value": []}, EVENT_PATHS)).select("event_id")


@R.query(f"SELECT id, partition_key, n_chars, row_number() OVER (ORDER BY n_chars DESC, partition_key, id)::INTEGER AS position, 'MzA=' AS next_token FROM ({RECORDS}) QUALIFY position > 20 AND position <= 30")
def offset_page(spark, sf_dir):
    return paging.page(_docs(spark, sf_dir).select("id", "partition_key", "n_chars"), [("n_chars", "desc")], 10, paging.encode_token(20))


@R.query(f"SELECT id, partition_key, n_chars FROM ({RECORDS}) WHERE n_chars < 1000 OR (n_chars = 1000 AND id > 'doc-5') ORDER BY n_chars DESC, id LIMIT 25")
def keyset_page(spark, sf_dir):
    rest = _docs(spark, sf_dir).select("id", "partition_key", "n_chars").filter(paging.after([("n_chars", "desc"), ("id", "asc")], [1000, "doc-5"]))
    return rest.orderBy(F.col("n_chars").desc(), "id").limit(25)


#: Orders up to this day are records already, those behind it are new.
KNOWN = "o_orderdate < DATE '1998-06-01'"


def _state(spark, sf_dir, where=KNOWN):
    orders = table(spark, sf_dir, "orders")
    return orders.filter(where).select(F.col("o_orderstatus").alias("partition_key"), F.col("o_orderkey").cast("string").alias("id"), F.col("o_totalprice").alias("price"), F.lit(1).alias("revision"), F.lit("rev:1").alias("etag"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))


def _changes(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(F.col("o_orderstatus").alias("partition_key"), F.col("l_orderkey").cast("string").alias("id"), F.col("l_extendedprice").alias("price"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("seq"), F.col("l_shipdate").alias("at"))


UPSERT = f"""
WITH state AS (SELECT o_orderstatus AS partition_key, CAST(o_orderkey AS VARCHAR) AS id, o_totalprice AS price, 1 AS revision, o_orderdate AS created_at, o_orderdate AS updated_at FROM orders WHERE {KNOWN}),
lines AS (SELECT o_orderstatus AS partition_key, CAST(l_orderkey AS VARCHAR) AS id, l_extendedprice AS price, l_shipdate AS moment, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS back FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
folded AS (SELECT partition_key, id, max(CASE WHEN back = 1 THEN price END) AS price, count(*) AS n, min(moment) AS first_at, max(moment) AS last_at FROM lines GROUP BY ALL)
SELECT COALESCE(s.partition_key, f.partition_key) AS partition_key, COALESCE(s.id, f.id) AS id, COALESCE(f.price, s.price) AS price, (COALESCE(s.revision, 0) + COALESCE(f.n, 0))::BIGINT AS revision, 'rev:' || CAST(COALESCE(s.revision, 0) + COALESCE(f.n, 0) AS VARCHAR) AS etag, COALESCE(s.created_at, f.first_at) AS created_at, COALESCE(f.last_at, s.updated_at) AS updated_at
FROM state s FULL OUTER JOIN folded f ON s.partition_key = f.partition_key AND s.id = f.id"""


@R.query(UPSERT)
def upsert(spark, sf_dir):
    return records.upsert(_state(spark, sf_dir), _changes(spark, sf_dir), ["price"])


@R.query(f"SELECT partition_key, id, price, revision, etag FROM ({UPSERT}) WHERE price >= 20000")
def log_written(spark, sf_dir):
    """A record log after three writes of changes, by the first, the middle and the last lines of orders, and a removal of what became cheap."""
    log = Records(spark, scratch(spark, "log"))
    log.append(_state(spark, sf_dir).withColumn("revision", F.col("revision").cast("bigint")))
    changes = _changes(spark, sf_dir)
    for some in ("seq.l_linenumber <= 2", "seq.l_linenumber BETWEEN 3 AND 4", "seq.l_linenumber > 4"):
        log.upsert(changes.filter(some), ["price"])
    log.delete(log.read().filter("price < 20000"))
    log.settle()
    return log.read().select("partition_key", "id", "price", "revision", "etag")


@R.query(f"""
WITH state AS (SELECT o_orderkey FROM orders WHERE {KNOWN}),
c AS (SELECT o_orderstatus AS partition_key, CAST(o.o_orderkey AS VARCHAR) AS id, CASE WHEN o.o_orderkey % 4 = 0 THEN '*' WHEN o.o_orderkey % 4 = 1 THEN 'none' WHEN o.o_orderkey % 4 = 2 THEN 'rev:1' END AS expected, s.o_orderkey IS NOT NULL AS there FROM orders o LEFT JOIN state s ON o.o_orderkey = s.o_orderkey)
SELECT partition_key, id, expected, CASE WHEN expected IN ('*', 'rev:1') AND NOT there OR expected = 'none' AND there THEN 'conflict' WHEN there THEN 'updated' ELSE 'created' END AS status,
CASE WHEN expected IN ('*', 'rev:1') AND NOT there THEN NULL WHEN expected = 'none' AND there THEN 1 WHEN there THEN 2 ELSE 1 END AS revision FROM c""")
def conditional_write(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    expected = F.expr("CASE o_orderkey % 4 WHEN 0 THEN '*' WHEN 1 THEN 'none' WHEN 2 THEN 'rev:1' END")
    changes = orders.select(F.col("o_orderstatus").alias("partition_key"), F.col("o_orderkey").cast("string").alias("id"), expected.alias("expected"))
    return records.conditional(_state(spark, sf_dir), changes)


BATCH = """
WITH b AS (SELECT l_orderkey AS batch, l_linenumber AS seq, CASE WHEN l_quantity > 45 THEN 'too_many' END AS error FROM lineitem),
f AS (SELECT *, min(CASE WHEN error IS NOT NULL THEN seq END) OVER (PARTITION BY batch) AS first FROM b)
SELECT batch, {status} AS status, count(*) AS n FROM f GROUP BY ALL"""


def _batch(spark, sf_dir, stop):
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("batch"), F.col("l_linenumber").alias("seq"), "l_quantity")
    found = records.batch(lines, F.when(F.col("l_quantity") > 45, "too_many"), stop)
    return found.groupBy("batch", "status").agg(F.count(F.lit(1)).alias("n"))


@R.query(BATCH.format(status="CASE WHEN error IS NOT NULL THEN 'failed' ELSE 'written' END"))
def batch_continue(spark, sf_dir):
    return _batch(spark, sf_dir, False)


@R.query(BATCH.format(status="CASE WHEN seq > first THEN 'skipped' WHEN error IS NOT NULL THEN 'failed' ELSE 'written' END"))
def batch_stop(spark, sf_dir):
    return _batch(spark, sf_dir, True)


@R.query("SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_records(spark, sf_dir):
    orders, poor = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").filter("c_acctbal < 0")
    gone = orders.join(poor, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select(F.col("o_orderstatus").alias("partition_key"), F.col("o_orderkey").cast("string").alias("id"))
    return records.delete(_state(spark, sf_dir, "true"), gone).select("id")


@R.query("""
WITH rows AS (SELECT '{"id":"' || c_name || '","partitionKey":"' || c_mktsegment || '","type":"\\u003C' || c_nationkey || '\\u003E","schemaVersion":null,"metadata":{"z":' || c_custkey || ',"a":[' || c_nationkey || ',"\\u00E9"]},"content":null,"sources":null,"vectors":null,"etag":null,"revision":null,"createdAt":null,"updatedAt":null,"c_custkey":' || c_custkey || '}' AS line, row_number() OVER (ORDER BY c_mktsegment, c_name) AS n FROM customer)
SELECT least(count(*), 100) AS record_count, count(*) > 100 AS truncated, 'sha256:' || sha256('{"collection":"customers","policy":{"name":"customers","indexed":["/a"]},"records":[' || string_agg(CASE WHEN n <= 100 THEN line END, ',' ORDER BY n) || ']}') AS content_hash FROM rows WHERE n <= 101""")
def snapshot_export(spark, sf_dir):
    key, nation = F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    body = F.concat(F.lit('{"z": '), key, F.lit(', "a": ['), nation, F.lit(', "é"]}'))
    state = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("partition_key"), F.col("c_name").alias("id"), F.concat(F.lit("<"), nation, F.lit(">")).alias("type"), body.alias("metadata"), "c_custkey")
    return records.snapshot(state, ["partition_key", "id", "type", "metadata", "c_custkey"], 100, "customers", {"name": "customers", "indexed": ["/a"]})


@R.query("SELECT 'page/' || page_id AS key, octet_length(encode(html))::BIGINT AS length, sha256(html) AS etag FROM pages WHERE starts_with('page/' || page_id, 'page/1') ORDER BY key LIMIT 40 OFFSET 5")
def object_listing(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("body"))
    return objects.listing(pages, "page/1", 40, 5)


@R.query("SELECT CASE WHEN page_id % 3 = 2 THEN 'missing' WHEN page_id % 3 = 1 THEN 'hash_mismatch' ELSE 'ingested' END AS status, 'page/' || CAST(page_id AS VARCHAR) AS key FROM pages")
def artifact_ingest(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("page/"), F.col("page_id").cast("string")).alias("key"), F.col("html").alias("body"))
    manifest = pages.select("key", F.sha2(F.when(F.col("page_id") % 3 == 1, F.lit("other")).otherwise(F.col("body")), 256).alias("sha256"))
    return objects.artifacts(manifest, pages.filter("page_id % 3 <> 2"))


@R.query("""
WITH l AS (SELECT 'doc-' || CAST(doc_id AS VARCHAR) AS path, unnest(string_split(text, chr(10))) AS content, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM documents WHERE contains(lower(text), 'license'))
SELECT path, line::INTEGER AS line, instr(lower(content), 'license')::INTEGER AS "column", content FROM l WHERE contains(lower(content), 'license')""")
def text_search(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return objects.grep(docs, "License", F.col("id"), case_sensitive=False)


@R.query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.expr("try_variant_get(parse_json(props), '$.k', 'bigint')").alias("k"))


@R.query("SELECT 'documents' AS collection, CAST(doc_id AS VARCHAR) AS id FROM documents WHERE n_chars > 5000 UNION ALL SELECT 'pages', CAST(page_id AS VARCHAR) FROM pages WHERE length(html) > 5000 UNION ALL SELECT 'benchmark', CAST(item_id AS VARCHAR) FROM benchmark WHERE length(text) > 5000")
def cross_collection_union(spark, sf_dir):
    def of(name, key, test):
        return table(spark, sf_dir, name).filter(test).select(F.lit(name).alias("collection"), F.col(key).cast("string").alias("id"))

    found = of("documents", "doc_id", "n_chars > 5000").unionByName(of("pages", "page_id", "length(html) > 5000"))
    return found.unionByName(of("benchmark", "item_id", "length(text) > 5000"))
