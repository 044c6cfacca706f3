"""Graphs: walks, paths, import and export, inspection, readiness, seeds and contexts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstone.catalog.base import Registry, table
from quillstone.operators import graph
from quillstone.sources.tables import cut

R = Registry()

NODES = """SELECT 'r' || r_regionkey AS id, 'region' AS type, r_name AS label, NULL::DOUBLE AS score, true AS grounded FROM region UNION ALL SELECT 'n' || n_nationkey, 'nation', n_name, NULL, true FROM nation UNION ALL SELECT 's' || s_suppkey, 'supplier', s_name, s_acctbal, s_acctbal > 0 FROM supplier UNION ALL SELECT 'c' || c_custkey, 'customer', c_name, c_acctbal, c_acctbal > 0 FROM customer"""
EDGES = """SELECT 'rn' || n_nationkey AS id, 'r' || n_regionkey AS source_id, 'n' || n_nationkey AS target_id, 'has' AS predicate, NULL::VARCHAR AS label, NULL::DOUBLE AS score, true AS grounded FROM nation UNION ALL SELECT 'ns' || s_suppkey, 'n' || s_nationkey, 's' || s_suppkey, 'supplies', s_name, s_acctbal, s_acctbal > 1000 FROM supplier UNION ALL SELECT 'nc' || c_custkey, 'n' || c_nationkey, 'c' || c_custkey, 'buys', NULL, c_acctbal, c_acctbal > 1000 FROM customer"""
ASSERTIONS = "SELECT 'a' || id AS id, CASE WHEN length(id) % 4 = 0 THEN 'gone' || id ELSE id END AS subject_id, CASE WHEN score > 5000 THEN 'accepted' ELSE 'proposed' END AS status FROM edges WHERE predicate = 'supplies'"
REVIEWS = "SELECT 'v' || id AS id, CASE WHEN length(id) % 4 <> 1 THEN id ELSE 'lost' || id END AS subject_id, CASE WHEN length(subject_id) % 2 = 0 THEN 'verified' ELSE 'open' END AS status FROM assertions"


def _nodes(spark, sf_dir):
    def of(name, prefix, key, label, score=None):
        value = (F.col(score) if score else F.lit(None)).cast("double")
        return table(spark, sf_dir, name).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), F.lit(name).alias("type"), F.col(label).alias("label"), value.alias("score"), (value > 0 if score else F.lit(True)).alias("grounded"))

    parts = (of("region", "r", "r_regionkey", "r_name"), of("nation", "n", "n_nationkey", "n_name"), of("supplier", "s", "s_suppkey", "s_name", "s_acctbal"), of("customer", "c", "c_custkey", "c_name", "c_acctbal"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _edges(spark, sf_dir):
    def of(name, prefix, key, parent, parent_prefix, own_prefix, predicate, score=None, label=None):
        name_of = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
        value = (F.col(score) if score else F.lit(None)).cast("double")
        return table(spark, sf_dir, name).select(name_of(prefix, key).alias("id"), name_of(parent_prefix, parent).alias("source_id"), name_of(own_prefix, key).alias("target_id"), F.lit(predicate).alias("predicate"), (F.col(label) if label else F.lit(None).cast("string")).alias("label"), value.alias("score"), (value > 1000 if score else F.lit(True)).alias("grounded"))

    found = of("nation", "rn", "n_nationkey", "n_regionkey", "r", "n", "has")
    found = found.unionByName(of("supplier", "ns", "s_suppkey", "s_nationkey", "n", "s", "supplies", "s_acctbal", "s_name"))
    return found.unionByName(of("customer", "nc", "c_custkey", "c_nationkey", "n", "c", "buys", "c_acctbal"))


def _assertions(spark, sf_dir):
    edges = _edges(spark, sf_dir).filter("predicate = 'supplies'")
    return edges.select(F.concat(F.lit("a"), F.col("id")).alias("id"), F.when(F.length("id") % 4 == 0, F.concat(F.lit("gone"), F.col("id"))).otherwise(F.col("id")).alias("subject_id"), F.when(F.col("score") > 5000, "accepted").otherwise("proposed").alias("status"))


def _reviews(spark, sf_dir):
    return _assertions(spark, sf_dir).select(F.concat(F.lit("v"), F.col("id")).alias("id"), F.when(F.length("id") % 4 != 1, F.col("id")).otherwise(F.concat(F.lit("lost"), F.col("id"))).alias("subject_id"), F.when(F.length("subject_id") % 2 == 0, "verified").otherwise("open").alias("status"))


def _starts(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


@R.query(f"""WITH nodes AS ({NODES}), edges AS ({EDGES}), l1 AS (SELECT * FROM edges WHERE source_id = 'r1'), l2 AS (SELECT e.* FROM edges e JOIN l1 ON e.source_id = l1.target_id WHERE e.score IS NULL OR e.score >= 0)
SELECT id, min(depth)::INTEGER AS depth FROM (SELECT 'r1' AS id, 0 AS depth UNION ALL SELECT target_id, 1 FROM l1 UNION ALL SELECT target_id, 2 FROM l2) GROUP BY id""")
def graph_traverse(spark, sf_dir):
    nodes, _ = graph.traverse(_nodes(spark, sf_dir), _edges(spark, sf_dir), _starts(spark, "r1", "nowhere"), cut, filters=graph.Filters(least_score=0.0), max_depth=2, node_limit=None, edge_limit=None)
    return nodes.select("id", "depth")


def _walk_sql(starts: str, sides: tuple[str, ...], depth: int, node_limit: int, edge_limit: int, node_ok: str = "SELECT id FROM nodes", edge_ok: str = "SELECT * FROM edges") -> str:
    """CTEs n{k} and t{k}: the nodes and edges of walks from ``starts`` (walk, id, given) up to depth k, level by level."""
    text = f"""nodes AS ({NODES}), edges AS ({EDGES}), assertions AS ({ASSERTIONS}), reviews AS ({REVIEWS}), node_ok AS ({node_ok}), edge_ok AS ({edge_ok}),
f0 AS (SELECT walk, id, row_number() OVER (PARTITION BY walk ORDER BY given, id) - 1 AS pos FROM (SELECT walk, id, min(given) AS given FROM ({starts}) WHERE id IN (SELECT id FROM nodes) GROUP BY walk, id)),
n0 AS (SELECT walk, id, 0 AS depth, row_number() OVER (PARTITION BY walk ORDER BY pos) - 1 AS pos FROM f0 WHERE id IN (SELECT id FROM node_ok)),
v0 AS (SELECT walk, id FROM f0), t0 AS (SELECT '' AS walk, '' AS id, '' AS a, '' AS b, '' AS predicate, 0 AS depth, 0::BIGINT AS pos WHERE false)"""
    ways = {"out": ("source_id", "target_id", 0), "in": ("target_id", "source_id", 1)}
    for k in range(1, depth + 1):
        j = k - 1
        met = " UNION ALL ".join(f"SELECT f.walk, e.id, f.pos, {ways[s][2]} AS side, e.{ways[s][0]} AS a, e.{ways[s][1]} AS b, e.predicate FROM f{j} f JOIN edge_ok e ON e.{ways[s][0]} = f.id" for s in sides)
        text += f""",
m{k} AS (SELECT *, (pos, side, id) AS o FROM ({met}) m WHERE b IN (SELECT id FROM node_ok) AND (walk, id) NOT IN (SELECT walk, id FROM t{j}) QUALIFY row_number() OVER (PARTITION BY walk, id ORDER BY pos, side) = 1),
s{k} AS (SELECT walk, b, row_number() OVER (PARTITION BY walk ORDER BY min(o)) AS turn FROM m{k} WHERE (walk, b) NOT IN (SELECT walk, id FROM n{j}) GROUP BY walk, b),
g{k} AS (SELECT m.* FROM m{k} m WHERE (walk, b) IN (SELECT walk, id FROM n{j}) OR (walk, b) IN (SELECT walk, b FROM s{k} WHERE turn + (SELECT count(*) FROM n{j} n WHERE n.walk = s{k}.walk) <= {node_limit})),
p{k} AS (SELECT *, row_number() OVER (PARTITION BY walk ORDER BY o) + (SELECT count(*) FROM t{j} t WHERE t.walk = g{k}.walk) AS place FROM g{k} QUALIFY place <= {edge_limit}),
t{k} AS (SELECT * FROM t{j} UNION ALL SELECT walk, id, a, b, predicate, {k}, place - 1 FROM p{k}),
x{k} AS (SELECT walk, b AS id, row_number() OVER (PARTITION BY walk ORDER BY min(place)) - 1 + (SELECT count(*) FROM n{j} n WHERE n.walk = p{k}.walk) AS pos FROM p{k} WHERE (walk, b) NOT IN (SELECT walk, id FROM n{j}) GROUP BY walk, b),
n{k} AS (SELECT * FROM n{j} UNION ALL SELECT walk, id, {k}, pos FROM x{k}),
f{k} AS (SELECT * FROM x{k} WHERE (walk, id) NOT IN (SELECT walk, id FROM v{j})), v{k} AS (SELECT * FROM v{j} UNION ALL SELECT walk, id FROM x{k})"""
    return text


LIMITED = _walk_sql("SELECT 'w' AS walk, unnest(['r1', 'n3', 'c9', 'c2', 'b']) AS id, unnest([1, 2, 3, 4, 5]) AS given", ("out", "in"), 3, 40, 35)


@R.query(f"WITH {LIMITED} SELECT id AS edge_id, a AS from_id, b AS to_id, predicate, depth::INTEGER AS depth, pos::INTEGER AS position FROM t3")
def graph_traverse_limits(spark, sf_dir):
    return graph.traverse(_nodes(spark, sf_dir), _edges(spark, sf_dir), _starts(spark, "r1", "n3", "c9", "c2", "b").withColumn("position", F.expr("array_position(array('r1', 'n3', 'c9', 'c2', 'b'), id)")), cut, max_depth=3, direction="both", node_limit=40, edge_limit=35)[1]


#: A walk from each nation's region and the nation, in this order.
MANY = "SELECT 'w' || n_nationkey AS walk, unnest(['r' || n_regionkey, 'n' || n_nationkey]) AS id, unnest([0, 1]) AS given FROM nation"
FILTERED = {"node_ok": "SELECT id FROM nodes WHERE type <> 'customer' AND grounded", "edge_ok": "SELECT * FROM edges WHERE grounded AND (score IS NULL OR score >= 2000)"}


def _walks(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    return n.select(name("w", "n_nationkey").alias("walk"), F.posexplode(F.array(name("r", "n_regionkey"), name("n", "n_nationkey"))).alias("position", "id"))


def _walked(spark, sf_dir, **options):
    return graph.walk(_nodes(spark, sf_dir), _edges(spark, sf_dir), _walks(spark, sf_dir), cut, **options)


MANY_WALKS = _walk_sql(MANY, ("out", "in"), 2, 12, 15)


@R.query(f"WITH {MANY_WALKS} SELECT walk, id, depth::INTEGER AS depth, pos::INTEGER AS position FROM n2")
def graph_walks(spark, sf_dir):
    return _walked(spark, sf_dir, max_depth=2, direction="both", node_limit=12, edge_limit=15)[0]


@R.query(f"WITH {_walk_sql(MANY, ('out',), 2, 100, 100, **FILTERED)} SELECT walk, id, depth::INTEGER AS depth, pos::INTEGER AS position FROM n2")
def graph_walk_filters(spark, sf_dir):
    filters = graph.Filters(node_types=("region", "nation", "supplier"), grounded=True, least_score=2000.0)
    nodes = _nodes(spark, sf_dir).withColumn("score", F.lit(None).cast("double"))
    return graph.walk(nodes, _edges(spark, sf_dir), _walks(spark, sf_dir), cut, filters=filters, max_depth=2)[0]


@R.query(f"WITH {_walk_sql(MANY, ('out',), 1, 100, 100, edge_ok='SELECT * FROM edges WHERE id IN (SELECT subject_id FROM assertions a WHERE status = ' + chr(39) + 'proposed' + chr(39) + ' AND a.id IN (SELECT subject_id FROM reviews))')} SELECT walk, id AS edge_id, b AS to_id FROM t1")
def graph_walk_statuses(spark, sf_dir):
    filters = graph.Filters(assertion_statuses=("proposed",), review_statuses=("verified", "open"))
    return _walked(spark, sf_dir, filters=filters, assertions=_assertions(spark, sf_dir), reviews=_reviews(spark, sf_dir))[1].select("walk", "edge_id", "to_id")


@R.query(f"""WITH {MANY_WALKS} SELECT walk, n.id, COALESCE(string_agg(t.id || ':' || t.a || '>' || t.b || ':' || predicate || ':' || t.depth, ';' ORDER BY t.pos), '') AS path FROM n2 n LEFT JOIN (SELECT walk AS w, * EXCLUDE (walk) FROM t2) t ON t.w = walk AND t.b = n.id GROUP BY walk, n.id""")
def graph_paths(spark, sf_dir):
    found = graph.paths(*_walked(spark, sf_dir, max_depth=2, direction="both", node_limit=12, edge_limit=15))
    step = lambda x: F.concat(x["edge_id"], F.lit(":"), x["from"], F.lit(">"), x["to"], F.lit(":"), x["predicate"], F.lit(":"), x["depth"].cast("string"))
    return found.select("walk", "id", F.array_join(F.transform("path", step), ";").alias("path"))


@R.query(f"""WITH {MANY_WALKS}, j AS (SELECT walk, '["' || array_to_string(list(id ORDER BY id), '","') || '"]' AS ids FROM n2 GROUP BY walk), k AS (SELECT walk, '["' || array_to_string(list(id ORDER BY id), '","') || '"]' AS ids FROM t2 GROUP BY walk), i AS (SELECT walk, '["' || array_to_string(list(DISTINCT id ORDER BY id), '","') || '"]' AS ids FROM ({MANY}) GROUP BY walk)
SELECT walk, 'projection:g:' || substring(sha256('{{"edges":' || k.ids || ',"graphId":"g","nodes":' || j.ids || ',"profile":"p","starts":' || i.ids || '}}'), 1, 32) AS projection_id FROM j JOIN k USING (walk) JOIN i USING (walk)""")
def graph_projection_ids(spark, sf_dir):
    return graph.projection_ids("g", _walks(spark, sf_dir), *_walked(spark, sf_dir, max_depth=2, direction="both", node_limit=12, edge_limit=15), profile="p")


@R.query(f"""WITH RECURSIVE edges AS ({EDGES}), walk(id, depth) AS (SELECT 'r2', 0 UNION ALL SELECT e.target_id, w.depth + 1 FROM walk w JOIN edges e ON e.source_id = w.id WHERE w.depth < 3)
SELECT id, min(depth)::INTEGER AS depth FROM walk GROUP BY id""")
def graph_reachable(spark, sf_dir):
    return graph.reachable(_edges(spark, sf_dir), _starts(spark, "r2"), 3, cut)


INSPECT = f"""WITH nodes AS ({NODES}), edges AS (SELECT * FROM ({EDGES}) WHERE id <> 'rn0' UNION ALL SELECT 'x1', 'r0', 'nowhere', NULL, NULL, NULL, false),
assertions AS ({ASSERTIONS}), reviews AS ({REVIEWS}),
found AS (SELECT 'node_type' AS kind, COALESCE(type, '(missing)') AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'predicate', COALESCE(predicate, '(missing)'), count(*) FROM edges GROUP BY ALL UNION ALL SELECT 'assertion_status', COALESCE(status, '(missing)'), count(*) FROM assertions GROUP BY ALL UNION ALL SELECT 'review_status', status, count(*) FROM reviews GROUP BY ALL
UNION ALL SELECT 'duplicate_nodes', '', count(*) FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'duplicate_edges', '', count(*) FROM (SELECT id FROM edges GROUP BY id HAVING count(*) > 1) UNION ALL SELECT 'duplicate_reviews', '', count(*) FROM (SELECT id FROM reviews GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'dangling_edges', '', count(*) FROM edges WHERE source_id NOT IN (SELECT id FROM nodes) OR target_id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'grounded_nodes', '', count(*) FROM nodes WHERE grounded UNION ALL SELECT 'grounded_edges', '', count(*) FROM edges WHERE grounded
UNION ALL SELECT 'orphan_assertions', '', count(*) FROM assertions WHERE subject_id NOT IN (SELECT id FROM nodes UNION SELECT id FROM edges)
UNION ALL SELECT 'orphan_reviews', '', count(*) FROM reviews WHERE subject_id NOT IN (SELECT id FROM assertions))
"""


def _inspection(spark, sf_dir):
    edges = _edges(spark, sf_dir).filter("id <> 'rn0'")
    loose = spark.createDataFrame([("x1", "r0", "nowhere", None, None, None, False)], "id string, source_id string, target_id string, predicate string, label string, score double, grounded boolean")
    return graph.inspect(_nodes(spark, sf_dir), edges.unionByName(loose), _assertions(spark, sf_dir), _reviews(spark, sf_dir))


@R.query(INSPECT + "SELECT * FROM found")
def graph_inspect(spark, sf_dir):
    return _inspection(spark, sf_dir)


@R.query(INSPECT + "SELECT sum(CASE WHEN kind = 'node_type' THEN n END)::BIGINT AS n_nodes, sum(CASE WHEN kind = 'predicate' THEN n END)::BIGINT AS n_edges, 1 + sum(CASE WHEN kind IN ('node_type', 'predicate', 'assertion_status', 'review_status') THEN n END)::BIGINT AS n_records, sum(CASE WHEN kind LIKE 'duplicate%' OR kind LIKE 'orphan%' OR kind = 'dangling_edges' THEN n END)::BIGINT AS n_problems, n_records > 500 AS truncated, n_nodes > 0 AND n_problems = 0 AND n_records <= 500 AS traversal_ready FROM found")
def graph_ready(spark, sf_dir):
    return graph.ready(_inspection(spark, sf_dir), 500)


#: Graphs and seeds that fail at each rung: which nodes and edges there are, and the seeds of five targets.
RUNGS = {
    "large": ("true", "true", 10, "'n' || k"),
    "loose": ("type <> 'region'", "true", 10**6, "'n' || k"),
    "seedless": ("true", "true", 10**6, "CASE WHEN k < 2 THEN ' ' END"),
    "strange": ("true", "true", 10**6, "'z' || k"),
    "still": ("true", "false", 10**6, "'n' || k"),
    "sound": ("true", "true", 10**6, "'n' || k"),
}


def _doctor_sql() -> str:
    parts = []
    for name, (node, edge, most, seed) in RUNGS.items():
        parts.append(f"""SELECT '{name}' AS graph, CASE WHEN 1 + (SELECT count(*) FROM nodes WHERE {node}) + (SELECT count(*) FROM edges WHERE {edge}) > {most} THEN 'budget_truncated'
WHEN NOT EXISTS (SELECT 1 FROM nodes WHERE {node}) OR EXISTS (SELECT 1 FROM edges WHERE ({edge}) AND (source_id NOT IN (SELECT id FROM nodes WHERE {node}) OR target_id NOT IN (SELECT id FROM nodes WHERE {node}))) THEN 'graph_not_ready'
WHEN NOT EXISTS (SELECT 1 FROM (SELECT {seed} AS seed FROM range(0, 5) AS g(k)) WHERE trim(seed) <> '') THEN 'no_seeds' WHEN NOT EXISTS (SELECT 1 FROM (SELECT {seed} AS seed FROM range(0, 5) AS g(k)) JOIN nodes ON nodes.id = seed WHERE {node}) THEN 'seed_node_not_found'
WHEN NOT EXISTS (SELECT 1 FROM edges WHERE {edge}) THEN 'traversal_empty' ELSE 'ready' END AS status""")
    return f"WITH nodes AS ({NODES}), edges AS ({EDGES}) " + " UNION ALL ".join(parts)


@R.query(_doctor_sql())
def graph_doctor(spark, sf_dir):
    """The status of a graph for each rung of the ladder, from its tables and targets."""
    union = None
    none = _assertions(spark, sf_dir).limit(0)
    for name, (node, edge, most, seed) in RUNGS.items():
        nodes, edges = _nodes(spark, sf_dir).filter(node), _edges(spark, sf_dir).filter(edge)
        targets = spark.range(5).select(F.expr(seed.replace("k", "id")).alias("id"))
        found = graph.doctor(graph.ready(graph.inspect(nodes, edges, none), most), targets, nodes).select(F.lit(name).alias("graph"), "status")
        union = found if union is None else union.unionByName(found)
    return union


@R.query(f"WITH e AS ({EDGES}) SELECT id, predicate FROM e WHERE predicate = 'supplies' AND score > 5000 AND length(id) % 4 <> 0")
def graph_edge_status(spark, sf_dir):
    return graph.with_status(_edges(spark, sf_dir), _assertions(spark, sf_dir), ["accepted"]).select("id", "predicate")


@R.query("SELECT 40::BIGINT AS n_seeds, count(*) AS n_found, count(*) / 40.0 AS coverage FROM nation WHERE n_nationkey < 40")
def graph_seed_coverage(spark, sf_dir):
    seeds = spark.range(40).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"))
    return graph.seed_coverage(seeds, _nodes(spark, sf_dir))


def _tables(spark, sf_dir):
    return {"node": _nodes(spark, sf_dir), "edge": _edges(spark, sf_dir), "assertion": _assertions(spark, sf_dir), "review": _reviews(spark, sf_dir)}


@R.query(f"WITH nodes AS ({NODES}), edges AS ({EDGES}) SELECT 'node' AS kind, 'blank_id' AS problem, count(*) AS n FROM nodes WHERE type = 'region' UNION ALL SELECT 'edge', 'duplicate_id', count(*) FROM edges WHERE predicate = 'has' UNION ALL SELECT 'envelope', 'too_many_records', 1 + (SELECT count(*) FROM nodes) + (SELECT count(*) FROM edges) + (SELECT count(*) FROM edges WHERE predicate = 'has')")
def graph_validate(spark, sf_dir):
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    blank = nodes.withColumn("id", F.when(F.col("type") == "region", " ").otherwise(F.col("id")))
    return graph.validate({"node": blank, "edge": edges.unionByName(edges.filter("predicate = 'has'"))}, 100)


CODED = "'g:{0}:' || rtrim(replace(replace(base64(encode(id)), '+', '-'), '/', '_'), '=')"
ENTITIES = f"SELECT 'envelope' AS kind, 'demo' AS id UNION ALL SELECT 'node', id FROM nodes UNION ALL SELECT 'edge', id FROM edges UNION ALL SELECT 'assertion', id FROM assertions UNION ALL SELECT 'review', id FROM reviews"
RECORDED = f"WITH nodes AS ({NODES}), edges AS ({EDGES}), assertions AS ({ASSERTIONS}), reviews AS ({REVIEWS}), r AS (SELECT 'demo' AS partition_key, 'g:' || kind || ':' || rtrim(replace(replace(base64(encode(id)), '+', '-'), '/', '_'), '=') AS id, 'graph.' || kind AS type, id AS entity_id FROM ({ENTITIES}))"


@R.query(RECORDED + " SELECT * FROM r")
def graph_records(spark, sf_dir):
    return graph.as_records(_tables(spark, sf_dir), "demo", namespace="n").select("partition_key", "id", "type", "entity_id")


@R.query(RECORDED + " SELECT id, type, true AS truncated FROM r ORDER BY type, id LIMIT 60")
def graph_export(spark, sf_dir):
    records = graph.as_records(_tables(spark, sf_dir), "demo", namespace="n").unionByName(graph.as_records(_tables(spark, sf_dir), "other", namespace="n"))
    return graph.export(records, 60, graph_id="demo", namespace="n").select("id", "type", "truncated")


@R.query(f"SELECT id, source_id, target_id, predicate, label, grounded FROM ({EDGES})")
def graph_import(spark, sf_dir):
    """Edges written as records and read back."""
    records = graph.as_records({"edge": _edges(spark, sf_dir)}, "demo")
    return graph.entities(records, "edge", "id string, source_id string, target_id string, predicate string, label string, grounded boolean")


#: Results of ten queries, each with suppliers and customers as seeds, some twice.
RESULTS = "SELECT 'q' || (k % 10) AS query_id, row_number() OVER (PARTITION BY k % 10 ORDER BY k) AS rank, k FROM (SELECT c_custkey AS k FROM customer)"
SEEDS = f"""r AS ({RESULTS}), every AS (SELECT query_id, 0 AS rank, 0 AS p, 'n1' AS id FROM (SELECT DISTINCT query_id FROM r) UNION ALL SELECT query_id, rank, 1, 'c' || k FROM r WHERE k % 3 > 0 UNION ALL SELECT query_id, rank, 2, 's' || (k % 7) FROM r),
firsts AS (SELECT query_id, id, min((rank, p)) AS o FROM every GROUP BY ALL), seeds AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY o)::INTEGER AS position, greatest(count(*) OVER (PARTITION BY query_id) - 16, 0) AS dropped FROM firsts QUALIFY position <= 16)"""


def _results(spark, sf_dir):
    k = F.col("c_custkey")
    found = table(spark, sf_dir, "customer").select(F.concat(F.lit("q"), (k % 10).cast("string")).alias("query_id"), k.alias("k"))
    return found.withColumn("rank", F.floor((F.col("k") - 1) / 10).cast("int") + 1)


def _seeds(spark, sf_dir):
    name = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    customers = F.when(F.col("k") % 3 > 0, F.array(name("c", F.col("k"))))
    return graph.seeds(_results(spark, sf_dir), ["n1"], [customers, F.array(name("s", F.col("k") % 7))])


@R.query(f"WITH {SEEDS} SELECT * FROM seeds")
def graph_seeds(spark, sf_dir):
    return _seeds(spark, sf_dir)


@R.query(f"""WITH {SEEDS}, {_walk_sql("SELECT query_id AS walk, id, position AS given FROM seeds", ("out", "in"), 1, 12, 25)},
a AS (SELECT DISTINCT query_id AS walk FROM r UNION ALL SELECT 'none'), sl AS (SELECT query_id AS walk, string_agg(id, ', ' ORDER BY position) AS l, max(dropped) AS dropped FROM seeds GROUP BY 1),
nl AS (SELECT walk, count(*) AS n, string_agg('- ' || id || ' (' || type || '): ' || label, chr(10) ORDER BY pos) AS l, string_agg(id, ',' ORDER BY pos) AS ids FROM n1 JOIN nodes USING (id) GROUP BY walk),
el AS (SELECT walk, count(*) AS n, string_agg('- ' || source_id || ' --' || t.predicate || '--> ' || target_id || COALESCE(' (' || label || ')', ''), chr(10) ORDER BY pos) AS l FROM t1 t JOIN edges USING (id) GROUP BY walk),
x AS (SELECT walk, 'Graph context:' || chr(10) || 'Seeds: ' || sl.l || chr(10) || 'Nodes:' || chr(10) || nl.l || COALESCE(chr(10) || 'Edges:' || chr(10) || el.l, '') AS t, COALESCE(nl.n, 0) AS nn, COALESCE(el.n, 0) AS ne, nl.ids, sl.l IS NOT NULL AS seeded, dropped FROM a LEFT JOIN sl USING (walk) LEFT JOIN nl USING (walk) LEFT JOIN el USING (walk))
SELECT walk AS query_id, CASE WHEN seeded THEN 'succeeded' ELSE 'no_seeds' END AS status, nn::INTEGER AS n_nodes, ne::INTEGER AS n_edges, COALESCE(ids, '') AS node_ids, CASE WHEN length(t) > 600 THEN substring(t, 1, 597) || '...' ELSE t END AS context_text, COALESCE(length(t) > 600, false) AS text_truncated, greatest(nn + ne - 20, 0)::INTEGER AS omitted,
 array_to_string(list_filter([CASE WHEN ne >= 25 THEN 'edgeLimit' END, CASE WHEN nn >= 12 THEN 'nodeLimit' END, CASE WHEN length(t) > 600 THEN 'maxGraphContextChars' END, CASE WHEN nn + ne > 20 THEN 'maxGraphProvenanceItems' END, CASE WHEN dropped > 0 THEN 'maxSeedNodes' END], lambda x: x IS NOT NULL), ',') AS limits FROM x""")
def graph_contexts(spark, sf_dir):
    asked = _results(spark, sf_dir).select("query_id").distinct().unionByName(spark.createDataFrame([("none",)], "query_id string"))
    found = graph.contexts(asked, _seeds(spark, sf_dir), _nodes(spark, sf_dir), _edges(spark, sf_dir), cut, 600, 20, direction="both", node_limit=12, edge_limit=25)
    return found.select("query_id", "status", "n_nodes", "n_edges", F.array_join("node_ids", ",").alias("node_ids"), "context_text", "text_truncated", "omitted", F.array_join("limits", ",").alias("limits"))
