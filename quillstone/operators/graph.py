"""Property graphs: filters, bounded walks, import and export, inspection, readiness, and text for contexts.

Graphs are tables: nodes (id, type, label, score, grounded), edges (id,
source_id, target_id, predicate, label, score, grounded, and optionally
assertion_ids), assertions (id, subject_id, status) and reviews (id, subject_id,
status), whose subjects are assertions. Many walks run at once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The most records of a graph's envelope, seeds and provenance items of a context, and characters of its text; the metadata that a graph's collection promotes.
MOST_RECORDS, MOST_SEEDS, MOST_PROVENANCE, MOST_CHARS = 10_000, 16, 64, 1200
GRAPH_INDEXES = ("/metadata/graphId", "/metadata/namespace", "/metadata/tenantId", "/metadata/kind")
KINDS = ("envelope", "node", "edge", "assertion", "review", "projection")


def scoped(table: DataFrame, **scope) -> DataFrame:
    """Rows of the graph's scope, as predicates that reach the scan."""
    for name, value in scope.items():
        if value is not None:
            table = table.filter(F.col(name) == value)
    return table


def min_score(column: str, least: float | None) -> Column:
    """Only a known, lower score refuses a row."""
    return F.lit(True) if least is None else F.coalesce(F.col(column) >= least, F.lit(True))


@dataclass(frozen=True)
class Filters:
    """What a walk may pass: node types, predicates, grounded entities alone, a least score, and edges with an assertion of a status, or with one that has a review of a status."""

    node_types: tuple[str, ...] = ()
    predicates: tuple[str, ...] = ()
    grounded: bool = False
    least_score: float | None = None
    assertion_statuses: tuple[str, ...] = ()
    review_statuses: tuple[str, ...] = ()

    def _both(self, table: DataFrame) -> DataFrame:
        found = table.filter(min_score("score", self.least_score))
        return found.filter("grounded") if self.grounded else found

    def nodes(self, nodes: DataFrame) -> DataFrame:
        found = self._both(nodes)
        return found.filter(F.col("type").isin(*self.node_types)) if self.node_types else found

    def edges(self, edges: DataFrame, assertions: DataFrame | None = None, reviews: DataFrame | None = None) -> DataFrame:
        """Edges allowed; those that assertions and reviews are asked of keep to the statuses, by either of an edge's assertions."""
        found = self._both(edges)
        if self.predicates:
            found = found.filter(F.col("predicate").isin(*self.predicates))
        if self.assertion_statuses or self.review_statuses:
            about = about_edges(edges, assertions)
            if self.assertion_statuses:
                named = assertions.filter(F.col("status").isin(*self.assertion_statuses)).select(F.col("id").alias("assertion_id"))
                found = found.join(about.join(named, "assertion_id", "left_semi").select("id"), "id", "left_semi")
            if self.review_statuses:
                named = reviews.filter(F.col("status").isin(*self.review_statuses)).select(F.col("subject_id").alias("assertion_id"))
                found = found.join(about.join(named, "assertion_id", "left_semi").select("id"), "id", "left_semi")
        return found


def about_edges(edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """id and assertion_id: the assertions about each edge, those that it names and those whose subject it is."""
    found = assertions.select(F.col("subject_id").alias("id"), F.col("id").alias("assertion_id"))
    if "assertion_ids" in edges.columns:
        found = found.unionByName(edges.select("id", F.explode("assertion_ids").alias("assertion_id")))
    return found.distinct()


def with_status(edges: DataFrame, assertions: DataFrame, statuses: list[str]) -> DataFrame:
    """Edges that an assertion of one of the statuses is about."""
    return Filters(assertion_statuses=tuple(statuses)).edges(edges.withColumns({c: F.lit(None).cast("double") for c in ("score",) if c not in edges.columns}), assertions)


def walk(nodes: DataFrame, edges: DataFrame, starts: DataFrame, cut: Callable[[DataFrame], DataFrame], filters: Filters = Filters(), max_depth: int = 1, direction: str = "outgoing", node_limit: int | None = 100, edge_limit: int | None = 100, include_start: bool = True, assertions: DataFrame | None = None, reviews: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walks from ``starts`` (walk, id, and position if they have an order, else they go by id): nodes (walk, id, depth, position) and edges (walk, edge_id, from_id, to_id, predicate, depth, position).

    One round of joins a level, for all walks. A level's edges are ordered by
    their frontier node's position, outgoing before incoming, then by id; an edge
    counts at its first occurrence whose far node is allowed, and a node is new at
    its first one. Of the edges to new nodes those within the node limit are
    taken, of all of them the first within the edge limit: a hub's edges meet in
    aggregates and top-k's, never in a sort. Without limits (None) all count, and
    a level is numbered over many tasks. ``cut`` writes each level where every
    executor can read it.
    """
    ways = {"outgoing": ("out",), "incoming": ("in",), "both": ("out", "in")}[direction]
    edge_ok = filters.edges(edges, assertions, reviews)
    node_ok = filters.nodes(nodes).select("id")
    given = F.col("position") if "position" in starts.columns else F.lit(0)
    there = starts.groupBy("walk", "id").agg(F.min(given).alias("given")).join(nodes.select("id").distinct(), "id", "left_semi")
    by_order = Window.partitionBy("walk").orderBy("given", "id")
    # every start counts; they use up the node limit for later nodes alone
    frontier = cut(there.withColumn("position", F.row_number().over(by_order) - 1).select("walk", "id", "position"))
    allowed = frontier.join(node_ok, "id", "left_semi").select("walk", "id", F.lit(0).alias("depth"), (F.row_number().over(Window.partitionBy("walk").orderBy("position")) - 1).alias("position"))
    included = allowed if include_start else allowed.limit(0)
    visited, taken, level = frontier.select("walk", "id"), None, 0
    included = cut(included)
    while level < max_depth and not frontier.isEmpty():
        steps = []
        for order, way in enumerate(ways):
            near, far = ("source_id", "target_id") if way == "out" else ("target_id", "source_id")
            side = edge_ok.select(F.col(near).alias("from_id"), F.col(far).alias("to_id"), F.col("id").alias("edge_id"), "predicate")
            steps.append(frontier.withColumnsRenamed({"id": "from_id", "position": "at"}).join(side, "from_id").withColumn("side", F.lit(order)))
        met = steps[0] if len(steps) == 1 else steps[0].unionByName(steps[1])
        met = met.join(node_ok.withColumnRenamed("id", "to_id"), "to_id", "left_semi")
        if taken is not None:
            met = met.join(taken.select("walk", "edge_id"), ["walk", "edge_id"], "left_anti")
        met = met.groupBy("walk", "edge_id").agg(F.min(F.struct("at", "side", "from_id", "to_id", "predicate")).alias("x"))
        met = met.select("walk", "edge_id", "x.*", F.struct("x.at", "x.side", "edge_id").alias("order"))
        held = included.groupBy("walk").agg(F.count(F.lit(1)).alias("n_nodes"))
        done = taken.groupBy("walk").agg(F.count(F.lit(1)).alias("n_edges")) if taken is not None else held.select("walk", F.lit(0).alias("n_edges")).limit(0)
        known = included.select("walk", F.col("id").alias("to_id")).withColumn("known", F.lit(True))
        met = met.join(known, ["walk", "to_id"], "left")
        seen = met.filter("known IS NULL").groupBy("walk", "to_id").agg(F.min("order").alias("seen")).join(held, "walk", "left")
        first = F.row_number().over(Window.partitionBy("walk").orderBy("seen"))
        if node_limit is None:
            found = met
        else:
            new = seen.withColumn("turn", first).filter(F.col("turn") <= node_limit).filter(F.col("turn") + F.coalesce("n_nodes", F.lit(0)) <= node_limit).select("walk", "to_id").withColumn("fits", F.lit(True))
            found = met.join(new, ["walk", "to_id"], "left").filter("known OR fits")
        if edge_limit is None:
            found = _numbered(found, "order", "place", cut).join(done, "walk", "left").withColumn("place", F.col("place") + 1 + F.coalesce("n_edges", F.lit(0)))
        else:
            place = F.row_number().over(Window.partitionBy("walk").orderBy("order"))
            found = found.withColumn("place", place).filter(F.col("place") <= edge_limit).join(done, "walk", "left")
            found = found.withColumn("place", F.col("place") + F.coalesce("n_edges", F.lit(0))).filter(F.col("place") <= edge_limit)
        found = cut(found.select("walk", "edge_id", "from_id", "to_id", "predicate", F.lit(level + 1).alias("depth"), (F.col("place") - 1).cast("int").alias("position")))
        fresh = found.groupBy("walk", F.col("to_id").alias("id")).agg(F.min("position").alias("seen")).join(included.select("walk", "id"), ["walk", "id"], "left_anti").join(held, "walk", "left")
        if edge_limit is None:
            fresh = _numbered(fresh, "seen", "turn", cut)
        else:
            fresh = fresh.withColumn("turn", F.row_number().over(Window.partitionBy("walk").orderBy("seen")) - 1)
        fresh = cut(fresh.select("walk", "id", F.lit(level + 1).alias("depth"), (F.col("turn") + F.coalesce("n_nodes", F.lit(0))).cast("int").alias("position")))
        frontier = fresh.join(visited, ["walk", "id"], "left_anti").select("walk", "id", "position")
        visited = visited.unionByName(fresh.select("walk", "id"))
        included = included.unionByName(fresh)
        taken = found if taken is None else taken.unionByName(found)
        level += 1
    if taken is None:
        kind = nodes.schema["id"].dataType
        taken = frontier.select("walk", F.lit(None).cast(edges.schema["id"].dataType).alias("edge_id"), F.lit(None).cast(kind).alias("from_id"), F.lit(None).cast(kind).alias("to_id"), F.lit(None).cast("string").alias("predicate"), F.lit(0).alias("depth"), F.lit(0).alias("position")).limit(0)
    return included, taken


def _numbered(rows: DataFrame, order: str, name: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with their number within their walk by ``order``, from 0: each task numbers a range of the order."""
    dealt = rows.repartitionByRange("walk", order).sortWithinPartitions("walk", order)
    dealt = cut(dealt.withColumns({"part_": F.spark_partition_id(), "row_": F.monotonically_increasing_id()}))
    parts = dealt.groupBy("walk", "part_").agg(F.min("row_").alias("first_"), F.count(F.lit(1)).alias("n_"))
    before = F.sum("n_").over(Window.partitionBy("walk").orderBy("part_")) - F.col("n_")
    numbered = dealt.join(parts.withColumn("before_", before), ["walk", "part_"])
    return numbered.withColumn(name, F.col("row_") - F.col("first_") + F.col("before_")).drop("part_", "row_", "first_", "n_", "before_")


def traverse(nodes: DataFrame, edges: DataFrame, starts: DataFrame, cut: Callable[[DataFrame], DataFrame], **options) -> tuple[DataFrame, DataFrame]:
    """One walk from ``starts`` (id), see ``walk``."""
    found_nodes, found_edges = walk(nodes, edges, starts.withColumn("walk", F.lit(0)), cut, **options)
    return found_nodes.drop("walk"), found_edges.drop("walk")


def paths(walked_nodes: DataFrame, walked_edges: DataFrame) -> DataFrame:
    """walk, id and path: the steps by which each node was met, in the order in which they were taken; a start has none of its own."""
    step = F.struct("position", F.struct("edge_id", F.col("from_id").alias("from"), F.col("to_id").alias("to"), "predicate", "depth").alias("step"))
    listed = walked_edges.groupBy("walk", F.col("to_id").alias("id")).agg(F.transform(F.sort_array(F.collect_list(step)), lambda x: x["step"]).alias("path"))
    empty = F.array().cast(listed.schema["path"].dataType)
    return walked_nodes.select("walk", "id").join(listed, ["walk", "id"], "left").withColumn("path", F.coalesce("path", empty))


def projection_ids(graph_id: str, starts: DataFrame, walked_nodes: DataFrame, walked_edges: DataFrame, profile: str = "{}") -> DataFrame:
    """walk and projection_id, a hash of the graph, the sorted starts, the profile and the sorted ids of what was walked."""
    some = lambda df, c, name: df.groupBy("walk").agg(F.sort_array(F.collect_set(F.col(c).cast("string"))).alias(name))
    joined = some(starts, "id", "starts").join(some(walked_nodes, "id", "nodes"), "walk", "left").join(some(walked_edges, "edge_id", "edges"), "walk", "left")
    none = F.array().cast("array<string>")
    identity = F.to_json(F.struct(F.coalesce("edges", none).alias("edges"), F.lit(graph_id).alias("graphId"), F.coalesce("nodes", none).alias("nodes"), F.lit(profile).alias("profile"), "starts"))
    return joined.select("walk", F.concat(F.lit(f"projection:{graph_id}:"), F.substring(F.sha2(identity, 256), 1, 32)).alias("projection_id"))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """id and least depth of all nodes within ``max_depth`` steps, without limits, for starts and graphs of any size.

    cut writes a level where every executor can read it, see ``sources.tables``.
    """
    seen = frontier = starts.select("id").distinct().withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, frontier["id"] == edges["source_id"]).select(F.col("target_id").alias("id")).distinct()
        frontier = cut(step.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
        seen = seen.unionByName(frontier)
    return seen


def _single(table: DataFrame, kind: str) -> DataFrame:
    return table.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("").alias("value"), "n")


def _union(parts: list[DataFrame]) -> DataFrame:
    union = parts[0]
    for more in parts[1:]:
        union = union.unionByName(more)
    return union


def inspect(nodes: DataFrame, edges: DataFrame, assertions: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """kind, value, n: counts by type, predicate and status, grounded entities, duplicates, dangling edges and references, orphan assertions and reviews."""

    def counted(table: DataFrame, column: str, kind: str) -> DataFrame:
        return table.groupBy(F.coalesce(F.col(column), F.lit("(missing)")).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "value", "n")

    def repeated(table: DataFrame) -> DataFrame:
        return table.groupBy("id").count().filter("count > 1")

    ids = nodes.select(F.col("id").alias("node")).distinct()
    ends = edges.select("id", F.explode(F.array("source_id", "target_id")).alias("node"))
    subjects = ids.select(F.col("node").alias("subject_id")).unionByName(edges.select(F.col("id").alias("subject_id"))).distinct()
    parts = [
        counted(nodes, "type", "node_type"),
        counted(edges, "predicate", "predicate"),
        counted(assertions, "status", "assertion_status"),
        _single(repeated(nodes), "duplicate_nodes"),
        _single(repeated(edges), "duplicate_edges"),
        _single(ends.join(ids, "node", "left_anti").select("id").distinct(), "dangling_edges"),
        _single(assertions.join(subjects, "subject_id", "left_anti"), "orphan_assertions"),
    ]
    for name, table in (("nodes", nodes), ("edges", edges)):
        if "grounded" in table.columns:
            parts.append(_single(table.filter("grounded"), f"grounded_{name}"))
    if "assertion_ids" in edges.columns:
        named = edges.select("id", F.explode("assertion_ids").alias("assertion"))
        parts.append(_single(named.join(assertions.select(F.col("id").alias("assertion")), "assertion", "left_anti"), "dangling_references"))
    if reviews is not None:
        parts += [counted(reviews, "status", "review_status"), _single(repeated(reviews), "duplicate_reviews")]
        parts.append(_single(reviews.join(assertions.select(F.col("id").alias("subject_id")), "subject_id", "left_anti"), "orphan_reviews"))
    return _union(parts)


def ready(inspection: DataFrame, most: int = MOST_RECORDS, allow_partial: bool = False) -> DataFrame:
    """One row: nodes, edges, records, problems, whether the graph exceeds ``most`` records, and whether it can be walked."""
    count = lambda *kinds: F.coalesce(F.sum(F.when(F.col("kind").isin(*kinds), F.col("n"))), F.lit(0))
    bad = count("dangling_edges", "orphan_assertions", "orphan_reviews", "duplicate_nodes", "duplicate_edges", "duplicate_reviews")
    records = 1 + count("node_type", "predicate", "assertion_status", "review_status")
    found = inspection.agg(count("node_type").alias("n_nodes"), count("predicate").alias("n_edges"), records.alias("n_records"), bad.alias("n_problems"))
    found = found.withColumn("truncated", F.col("n_records") > most)
    whole = F.lit(True) if allow_partial else ~F.col("truncated")
    return found.withColumn("traversal_ready", (F.col("n_nodes") > 0) & (F.col("n_problems") == 0) & whole)


def seed_coverage(seeds: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: distinct seeds, those among the nodes, and their share, one without seeds. Null and blank seeds are none."""
    asked = seeds.filter(F.trim(F.col("id").cast("string")) != "").select("id").distinct()
    hit = nodes.select("id").distinct().withColumn("hit", F.lit(1))
    totals = asked.join(hit, "id", "left").agg(F.count(F.lit(1)).alias("n_seeds"), F.count("hit").alias("n_found"))
    return totals.withColumn("coverage", F.when(F.col("n_seeds") > 0, F.col("n_found") / F.col("n_seeds")).otherwise(1.0))


def doctor(readiness: DataFrame, targets: DataFrame | None = None, nodes: DataFrame | None = None) -> DataFrame:
    """``readiness`` (of ``ready``) with seed counts and status: the first problem that keeps the graph from answering, or ready.

    targets: rows with a seed ``id`` each, or null; without them seeds are not looked at.
    """
    if targets is None:
        found = readiness.withColumns({"n_targets": F.lit(0).cast("bigint"), "n_seeds": F.lit(0).cast("bigint"), "n_found": F.lit(0).cast("bigint")})
    else:
        found = readiness.join(F.broadcast(targets.agg(F.count(F.lit(1)).alias("n_targets")))).join(F.broadcast(seed_coverage(targets, nodes).drop("coverage")))
    status = (
        F.when(F.col("truncated"), "budget_truncated")
        .when(~F.col("traversal_ready"), "graph_not_ready")
        .when((F.col("n_targets") > 0) & (F.col("n_seeds") == 0), "no_seeds")
        .when((F.col("n_seeds") > 0) & (F.col("n_found") == 0), "seed_node_not_found")
        .when((F.col("n_nodes") > 0) & (F.col("n_edges") == 0), "traversal_empty")
        .otherwise("ready")
    )
    return found.withColumn("status", status)


def validate(tables: dict[str, DataFrame], most: int = MOST_RECORDS) -> DataFrame:
    """kind, problem, n: blank and repeated ids of each kind of entity, and too many records in all. No rows for a sound envelope."""
    parts = []
    for kind, table in tables.items():
        ids = F.coalesce(F.trim(F.col("id").cast("string")), F.lit(""))
        blank = table.filter(ids == "").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), F.lit("blank_id").alias("problem"), "n")
        twice = table.filter(ids != "").groupBy("id").count().filter("count > 1").agg(F.count(F.lit(1)).alias("n"))
        parts += [blank, twice.select(F.lit(kind).alias("kind"), F.lit("duplicate_id").alias("problem"), "n")]
    total = _union([t.select(F.lit(1).alias("one")) for t in tables.values()]).agg((F.count(F.lit(1)) + 1).alias("n"))
    parts.append(total.filter(F.col("n") > most).select(F.lit("envelope").alias("kind"), F.lit("too_many_records").alias("problem"), "n"))
    return _union(parts).filter("n > 0")


def preflight(tables: dict[str, DataFrame], indexed: tuple[str, ...] | None, create: bool = True, replace: bool = False, allow_other: bool = False, most: int = MOST_RECORDS) -> dict:
    """What an import into a collection would do: valid, policy_status, errors and warnings. indexed: the collection's promoted paths, None if there is none."""
    errors = [f"{r.kind}: {r.problem} ({r.n})" for r in validate(tables, most).orderBy("kind", "problem").collect()]
    warnings, status = [], ""
    lacking = [] if indexed is None else [p for p in GRAPH_INDEXES if p not in indexed]
    if indexed is None and create:
        status = "created"
    elif indexed is None:
        errors.append("the collection does not exist")
    elif replace:
        status = "replaced"
        warnings.append("the collection is made anew")
    elif not lacking:
        status = "existing_graph_policy"
    elif allow_other:
        status = "existing_non_graph_policy_allowed"
        warnings.append("the collection does not promote what graphs are filtered by")
    else:
        errors.append(f"the collection does not promote {', '.join(lacking)}")
    return {"valid": not errors, "policy_status": status, "errors": errors, "warnings": warnings}


def as_records(tables: dict[str, DataFrame], graph_id: str, **scope: str) -> DataFrame:
    """The envelope and all entities as records: partition_key, id ``g:<kind>:<base64url>``, type, graph_id, the scope, entity_id and body."""

    def named(ids: Column, kind: str) -> Column:
        return F.concat(F.lit(f"g:{kind}:"), F.rtrim(F.translate(F.base64(ids.cast("string").cast("binary")), "+/=", "-_ ")))

    about = [F.lit(graph_id).alias("graph_id"), *(F.lit(v).alias(k) for k, v in sorted(scope.items()))]
    spark = next(iter(tables.values())).sparkSession
    parts = [spark.range(1).select(F.lit(graph_id).alias("partition_key"), named(F.lit(graph_id), "envelope").alias("id"), F.lit("graph.envelope").alias("type"), *about, F.lit(graph_id).alias("entity_id"), F.lit("{}").alias("body"))]
    for kind, table in tables.items():
        body = F.to_json(F.struct(*table.columns))
        parts.append(table.select(F.lit(graph_id).alias("partition_key"), named(F.col("id"), kind).alias("id"), F.lit(f"graph.{kind}").alias("type"), *about, F.col("id").cast("string").alias("entity_id"), body.alias("body")))
    return _union(parts)


def export(records: DataFrame, most: int = MOST_RECORDS, **scope: str | None) -> DataFrame:
    """The scope's records by type and id, ``most`` of them at most, with ``truncated``."""
    found = scoped(records, **scope).orderBy("type", "id").limit(most + 1)
    n = F.row_number().over(Window.orderBy("type", "id"))
    rows = found.withColumn("n", n).withColumn("truncated", F.max("n").over(Window.partitionBy()) > most)
    return rows.filter(F.col("n") <= most).drop("n")


def entities(records: DataFrame, kind: str, schema: str) -> DataFrame:
    """The entities of a kind, read back from records."""
    return records.filter(F.col("type") == f"graph.{kind}").select(F.from_json("body", schema).alias("x")).select("x.*")


def seeds(results: DataFrame, explicit: list[str], pointers: list[Column], most: int = MOST_SEEDS) -> DataFrame:
    """query_id, id and position of each query's seeds: the explicit ones, then those that pointers find in its results by rank, distinct, ``most`` at most; and dropped, the distinct ones beyond.

    pointers: arrays of strings, null or empty where nothing is found.
    """
    given = results.select("query_id").distinct().select("query_id", F.posexplode(F.array(*map(F.lit, explicit)).cast("array<string>")).alias("a", "id")).select("query_id", F.lit(0).alias("rank"), F.lit(0).alias("pointer"), "a", "id")
    parts = [given]
    for k, values in enumerate(pointers):
        parts.append(results.select("query_id", "rank", F.lit(k).alias("pointer"), F.posexplode(values).alias("a", "id")))
    every = _union(parts).withColumn("id", F.trim("id")).filter(F.col("id") != "")
    first = every.groupBy("query_id", "id").agg(F.min(F.struct("rank", "pointer", "a")).alias("order"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("order"))
    total = F.count(F.lit(1)).over(Window.partitionBy("query_id"))
    return first.select("query_id", "id", place.alias("position"), F.greatest(total - most, F.lit(0)).alias("dropped")).filter(F.col("position") <= most)


def contexts(asked: DataFrame, found_seeds: DataFrame, nodes: DataFrame, edges: DataFrame, cut: Callable[[DataFrame], DataFrame], most_chars: int = MOST_CHARS, most_items: int = MOST_PROVENANCE, **options) -> DataFrame:
    """Per query of ``asked``: status, node_ids, edge_ids, n_nodes, n_edges, provenance, omitted, context_text, text_truncated, limits.

    The walk from a query's seeds is rendered as lines of seeds, nodes and edges,
    cut to ``most_chars``; provenance names what was met, nodes first, with
    whether it is grounded. A query without seeds has status no_seeds.
    """
    starts = found_seeds.select(F.col("query_id").alias("walk"), "id", "position")
    node_limit, edge_limit = options.get("node_limit", 100), options.get("edge_limit", 100)
    walked_nodes, walked_edges = walk(nodes, edges, starts, cut, **options)
    line = lambda kind, position, text: F.struct(F.lit(kind).alias("kind"), position.alias("position"), text.alias("text"))
    about = nodes.select("id", "type", "label", "grounded")
    n = walked_nodes.join(about, "id").withColumn("text", F.concat(F.lit("- "), F.col("id"), F.coalesce(F.concat(F.lit(" ("), F.col("type"), F.lit(")")), F.lit("")), F.coalesce(F.concat(F.lit(": "), F.col("label")), F.lit(""))))
    e = walked_edges.join(edges.select(F.col("id").alias("edge_id"), "source_id", "target_id", "label", "grounded"), "edge_id")
    e = e.withColumn("text", F.concat(F.lit("- "), F.col("source_id"), F.lit(" --"), F.coalesce("predicate", F.lit("")), F.lit("--> "), F.col("target_id"), F.coalesce(F.concat(F.lit(" ("), F.col("label"), F.lit(")")), F.lit(""))))
    by_place = lambda value: F.transform(F.sort_array(F.collect_list(F.struct("position", value.alias("v")))), lambda x: x["v"])
    item = lambda kind, name: F.struct(F.lit(kind).alias("kind"), F.col(name).alias("entity_id"), "grounded")
    per_nodes = n.groupBy("walk").agg(by_place(F.col("id")).alias("node_ids"), by_place(F.col("text")).alias("node_lines"), by_place(item("node", "id")).alias("node_items"))
    per_edges = e.groupBy("walk").agg(by_place(F.col("edge_id")).alias("edge_ids"), by_place(F.col("text")).alias("edge_lines"), by_place(item("edge", "edge_id")).alias("edge_items"))
    per_seeds = found_seeds.groupBy(F.col("query_id").alias("walk")).agg(by_place(F.col("id")).alias("seed_ids"), F.max("dropped").alias("dropped"))
    joined = asked.select(F.col("query_id").alias("walk")).distinct()
    for part in (per_seeds, per_nodes, per_edges):
        joined = joined.join(part, "walk", "left")
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("seed_ids", "node_ids", "edge_ids", "node_lines", "edge_lines")}
    joined = joined.withColumns(lists)
    items = F.concat(F.coalesce("node_items", F.array().cast(per_nodes.schema["node_items"].dataType)), F.coalesce("edge_items", F.array().cast(per_nodes.schema["node_items"].dataType)))
    some = (F.size("node_ids") > 0) | (F.size("edge_ids") > 0)
    part = lambda title, c: F.when(F.size(c) > 0, F.concat(F.array(F.lit(title)), F.col(c))).otherwise(none)
    seed_line = F.when(F.size("seed_ids") > 0, F.array(F.concat(F.lit("Seeds: "), F.array_join("seed_ids", ", ")))).otherwise(none)
    text = F.when(some, F.array_join(F.concat(F.array(F.lit("Graph context:")), seed_line, part("Nodes:", "node_lines"), part("Edges:", "edge_lines")), "\n"))
    joined = joined.withColumns({"items": items, "text": text, "seeded": F.size("seed_ids") > 0})
    cut_text = F.when(F.length("text") > most_chars, F.concat(F.substring("text", 1, most_chars - 3), F.lit("..."))).otherwise(F.col("text"))
    truncated = F.coalesce(F.length("text") > most_chars, F.lit(False))
    omitted = F.greatest(F.size("items") - most_items, F.lit(0))
    hit = lambda test, name: F.when(test, F.array(F.lit(name))).otherwise(none)
    limits = F.concat(hit(F.size("edge_ids") >= edge_limit, "edgeLimit"), hit(F.size("node_ids") >= node_limit, "nodeLimit"), hit(truncated, "maxGraphContextChars"), hit(omitted > 0, "maxGraphProvenanceItems"), hit(F.coalesce(F.col("dropped") > 0, F.lit(False)), "maxSeedNodes"))
    return joined.select(
        F.col("walk").alias("query_id"), F.when(F.col("seeded"), "succeeded").otherwise("no_seeds").alias("status"), "seed_ids", "node_ids", "edge_ids", F.size("node_ids").alias("n_nodes"), F.size("edge_ids").alias("n_edges"),
        F.slice("items", 1, most_items).alias("provenance"), omitted.alias("omitted"), cut_text.alias("context_text"), truncated.alias("text_truncated"), limits.alias("limits"),
    )
