"""Context assembly: budgets, group quotas, citations and rendering."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def pack(results: DataFrame, max_chars: int = 8000, per_chunk: int = 1200, text: str = "text") -> DataFrame:
    """The ranked results of each query as far as the budget goes: excerpt, truncated, and rank in the context.

    Without quotas the greedy walk has a closed form: what a result takes is its
    capped length, or what its predecessors' capped lengths leave of the budget.
    """
    filled = results.filter(F.trim(F.regexp_replace(text, r"\s+", " ")) != "")
    order = Window.partitionBy("query_id").orderBy("rank")
    capped = F.least(F.length(text), F.lit(per_chunk))
    before = F.coalesce(F.sum(capped).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    take = F.greatest(F.lit(0), F.least(capped, F.lit(max_chars) - before)).cast("int")
    taken = filled.withColumn("take", take).filter(F.col("take") > 0)
    cut = F.length(text) > F.col("take")
    return taken.withColumn("excerpt", excerpt(F.col(text), F.col("take"))).withColumn("truncated", cut).withColumn("context_rank", F.row_number().over(order))


#: The priority of a group without a rule: behind all others.
LAST = 2_147_483_647


def text_of(field: Column, rest: Column) -> Column:
    """The content's field if it is a string, else its compact JSON, else the empty text. field: the string; rest: JSON of anything else."""
    return F.coalesce(field, rest, F.lit(""))


def group_key(kind: str, value: Column, found: Column | None = None) -> Column:
    """What a result is grouped by.

    collection: ``value`` is its name. source_kind: ``value`` is the array of its
    sources' kinds, the first that is not blank counts. json: ``value`` is the
    text of what a pointer found, null for an explicit null, and ``found`` tells
    whether it found anything.
    """
    if kind == "collection":
        return F.when(F.trim(value) != "", value).otherwise("(missing)")
    if kind == "source_kind":
        return F.coalesce(F.get(F.filter(value, lambda k: k.isNotNull() & (F.trim(k) != "")), F.lit(0)), F.lit("(missing)"))
    if kind == "json":
        return F.when(~found, "(missing)").when(value.isNull(), "(null)").otherwise(value)
    raise ValueError(f"unknown grouping: {kind}")


def _priority(rules: dict[str, dict], key: str) -> int:
    """A rule's priority, by default its place among the rules."""
    if key not in rules:
        return LAST
    given = rules[key].get("priority")
    return list(rules).index(key) if given is None else given


def _minima(rule: dict) -> tuple[int, int]:
    """The chunks and characters that satisfy a group."""
    chunks = rule.get("min_chunks")
    return (int(bool(rule.get("required"))) if chunks is None else chunks), rule.get("min_chars") or 0


def pack_grouped(results: DataFrame, rules: dict[str, dict], max_chars: int = 8000, per_chunk: int = 1200, default_max_chunks: int | None = None, default_max_chars: int | None = None) -> DataFrame:
    """query_id, id, group_key, take, context_rank under quotas: groups with minima go first by priority, then the rest by priority and rank.

    The walk is sequential, so each query's candidates, a bounded list, go
    through one function. rules, in order: priority, required, min_chunks,
    max_chunks, min_chars, max_chars. results: query_id, id, group_key, rank,
    length; what is empty is passed over.
    """

    def ordered(pool: list[dict]) -> list[dict]:
        first: list[dict] = []
        for key in sorted(rules, key=lambda k: (_priority(rules, k), k)):
            (chunks, chars), own = _minima(rules[key]), []
            for row in pool:
                if row["group_key"] == key and (len(own) < chunks or sum(min(r["length"], per_chunk) for r in own) < chars):
                    own.append(row)
            first += own
        taken = {id(r) for r in first}
        return first + sorted((r for r in pool if id(r) not in taken), key=lambda r: (_priority(rules, r["group_key"]), r["rank"], r["id"]))

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        left, used, out = max_chars, {}, []
        for row in ordered(rows[rows["length"] > 0].sort_values("rank").to_dict("records")):
            if left <= 0:
                break
            rule = rules.get(row["group_key"], {})
            count, chars = used.get(row["group_key"], (0, 0))
            most = default_max_chunks if rule.get("max_chunks") is None else rule["max_chunks"]
            room = default_max_chars if rule.get("max_chars") is None else rule["max_chars"]
            take = min(row["length"], per_chunk, left, LAST if room is None else room - chars)
            if take <= 0 or most is not None and count >= most:
                continue
            out.append((row["query_id"], row["id"], row["group_key"], take, len(out) + 1))
            used[row["group_key"]] = count + 1, chars + take
            left -= take
        return pd.DataFrame(out, columns=["query_id", "id", "group_key", "take", "context_rank"])

    kinds = {f.name: f.dataType.simpleString() for f in results.schema}
    schema = f"query_id {kinds['query_id']}, id {kinds['id']}, group_key string, take bigint, context_rank int"
    return results.select("query_id", "id", "group_key", "rank", "length").groupBy("query_id").applyInPandas(walk, schema)


def excerpt(text: Column, take: Column) -> Column:
    """So many characters of a text, the last three of them dots if it is longer and there is room."""
    cut = F.length(text) > take
    return F.when(cut & (take > 3), F.concat(F.substring(text, F.lit(1), (take - 3).cast("int")), F.lit("..."))).otherwise(F.substring(text, F.lit(1), take.cast("int")))


def group_satisfaction(results: DataFrame, packed: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """Per query and group, of those that have candidates or a rule: candidates, chunks, characters, whether it is required, and whether its minima are met.

    results: query_id, group_key, length of what was offered; packed: what was taken.
    """
    spark = results.sparkSession
    table = [(k, bool(r.get("required")), *_minima(r)) for k, r in rules.items()]
    ruled = spark.createDataFrame(table, "group_key string, required boolean, min_chunks int, min_chars int")
    offered = results.filter("length > 0").groupBy("query_id", "group_key").agg(F.count(F.lit(1)).alias("candidates"))
    # every query has a row for every rule: the rules are few
    asked = results.select("query_id").distinct().join(F.broadcast(ruled.select("group_key"))).unionByName(offered.select("query_id", "group_key")).distinct()
    stats = packed.groupBy("query_id", "group_key").agg(F.count(F.lit(1)).alias("chunk_count"), F.sum("take").alias("char_count"))
    found = asked.join(offered, ["query_id", "group_key"], "left").join(stats, ["query_id", "group_key"], "left").join(F.broadcast(ruled), "group_key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    satisfied = (zero("chunk_count") >= zero("min_chunks")) & (zero("char_count") >= zero("min_chars"))
    return found.select("query_id", "group_key", zero("candidates").alias("candidates"), zero("chunk_count").alias("chunk_count"), zero("char_count").alias("char_count"), F.coalesce("required", F.lit(False)).alias("required"), satisfied.alias("satisfied"))


def citations(packed: DataFrame, sources: str = "sources", most: int | None = 3) -> DataFrame:
    """query_id, citation, source: the first ones of each chunk, as c1 or, of several, c1.1, c1.2 and so on; a chunk without sources has one with a null source."""
    some = F.col(sources) if most is None else F.slice(F.col(sources), 1, most)
    each = packed.select("query_id", "context_rank", F.greatest(F.coalesce(F.size(sources), F.lit(0)), F.lit(0)).alias("n"), F.posexplode_outer(some).alias("at", "source"))
    name = F.concat(F.lit("c"), F.col("context_rank").cast("string"))
    return each.select("query_id", F.when(F.col("n") <= 1, name).otherwise(F.concat(name, F.lit("."), (F.col("at") + 1).cast("string"))).alias("citation"), "source")


def omitted_citations(packed: DataFrame, sources: str = "sources", most: int = 3) -> DataFrame:
    """query_id and the number of sources that no citation names."""
    return packed.groupBy("query_id").agg(F.sum(F.greatest(F.coalesce(F.size(sources), F.lit(0)) - most, F.lit(0))).alias("omitted"))


def included_span(start: Column, end: Column, taken_from: Column, taken_to: Column) -> Column:
    """The part of a source's span that an excerpt holds, as a struct; null ends where the source has no start."""
    last = F.when(end.isNull(), start + taken_to).otherwise(F.least(start + taken_to, end))
    return F.struct((start + taken_from).alias("char_start"), F.when(start.isNotNull(), last).alias("char_end"))


def render(packed: DataFrame, label: str = "id") -> DataFrame:
    """Per query the context as numbered markdown paragraphs, its length and its hash."""
    line = F.concat(F.lit("["), F.lit("c"), F.col("context_rank").cast("string"), F.lit("] "), F.col(label).cast("string"), F.lit("\n"), F.col("excerpt"))
    listed = F.sort_array(F.collect_list(F.struct("context_rank", line.alias("line"))))
    text = F.concat_ws("\n\n", F.transform(listed, lambda x: x["line"]))
    return packed.groupBy("query_id").agg(text.alias("context")).withColumn("n_chars", F.length("context")).withColumn("context_hash", F.sha2("context", 256))


def prompt(rendered: DataFrame, question: str = "question", instructions: str = "Answer from the context and cite it.", max_chars: int = 20_000) -> DataFrame:
    """prompt, prompt_chars, prompt_hash and whether it fits, of rows with ``context`` and the question's column."""
    text = F.concat(F.lit("## Instructions\n"), F.lit(instructions), F.lit("\n\n## Context\n"), F.col("context"), F.lit("\n\n## Question\n"), F.col(question))
    found = rendered.withColumn("prompt", text)
    return found.withColumns({"prompt_chars": F.length("prompt"), "prompt_hash": F.sha2("prompt", 256), "fits": F.length("prompt") <= max_chars})


def evaluate(packed: DataFrame, expected: DataFrame) -> DataFrame:
    """Per query: expected references, those in the context, the missing ones in order, and whether all are there. No expectation passes."""
    have = packed.groupBy("query_id").agg(F.collect_set("ref").alias("have"))
    want = expected.groupBy("query_id").agg(F.sort_array(F.collect_set("ref")).alias("want"))
    both = have.join(want, "query_id", "full_outer")
    empty = F.array().cast(packed.select(F.array("ref").alias("r")).schema[0].dataType)
    missing = F.array_except(F.coalesce("want", empty), F.coalesce("have", empty))
    n = F.coalesce(F.size("want"), F.lit(0))
    return both.select("query_id", n.alias("n_expected"), (n - F.size(missing)).alias("n_found"), missing.alias("missing"), (F.size(missing) == 0).alias("passed"))


def evaluate_all(found: DataFrame) -> DataFrame:
    """One row: cases, passed, and the share of all expected references found, one if none is expected."""
    total = F.sum("n_expected")
    return found.agg(F.count(F.lit(1)).alias("n_cases"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), F.round(F.when(total > 0, F.sum("n_found") / total).otherwise(1.0), 6).alias("hit_rate"))


# Why a context fails, in the order in which reasons are given.
FAILURES = (
    "retrieval_miss",
    "seed_miss",
    "graph_not_found",
    "traversal_empty",
    "expected_node_missing",
    "expected_edge_missing",
    "expected_provenance_missing",
    "source_grounding_failed",
    "graph_context_text_missing",
    "context_text_truncated",
    "budget_truncated",
)


def evaluate_graph(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Per expected query: matched and missing nodes, edges and provenance, grounding, whether all is as expected, and if not, the failures.

    found: query_id, n_chunks, status, node_ids, edge_ids, provenance (array of
    structs with entity_id and grounded), context_text, text_truncated,
    source_truncated, omitted, limits. expected: query_id, node_ids, edge_ids,
    provenance_ids, require_grounding, require_text, require_whole_text.
    """
    want = expected.select("query_id", *(F.coalesce(c, F.array().cast("array<string>")).alias(f"want_{c}") for c in ("node_ids", "edge_ids", "provenance_ids")), "require_grounding", "require_text", "require_whole_text")
    have = found.withColumn("provenance_ids", F.transform("provenance", lambda p: p["entity_id"]))
    joined = want.join(have, "query_id", "left")
    missing = {c: F.sort_array(F.array_except(f"want_{c}", F.coalesce(c, F.array().cast("array<string>")))) for c in ("node_ids", "edge_ids", "provenance_ids")}
    scope = F.when(F.size("want_provenance_ids") > 0, F.filter("provenance", lambda p: F.array_contains("want_provenance_ids", p["entity_id"]))).otherwise(F.col("provenance"))
    grounded = F.size(F.filter("scope", lambda p: p["grounded"]))
    text = F.coalesce(F.trim("context_text"), F.lit("")) != ""
    joined = joined.withColumns({f"missing_{c}": m for c, m in missing.items()}).withColumn("scope", F.coalesce(scope, F.array().cast(have.schema["provenance"].dataType)))
    joined = joined.withColumn("grounding", ~F.col("require_grounding") | ((F.size("scope") > 0) & (grounded == F.size("scope"))))
    truncated = F.coalesce("text_truncated", F.lit(False))
    budget = truncated | F.coalesce("source_truncated", F.lit(False)) | (F.coalesce("omitted", F.lit(0)) > 0) | (F.coalesce(F.size("limits"), F.lit(0)) > 0)
    gone = {c: F.size(f"missing_{c}") > 0 for c in missing}
    status = F.coalesce("status", F.lit(""))
    empty = (status == "succeeded") & (F.size("want_node_ids") + F.size("want_edge_ids") > 0) & (F.coalesce(F.size("node_ids"), F.lit(0)) + F.coalesce(F.size("edge_ids"), F.lit(0)) == 0)
    tests = (F.coalesce("n_chunks", F.lit(0)) == 0, status == "no_seeds", status == "graph_not_found", empty, gone["node_ids"], gone["edge_ids"], gone["provenance_ids"], ~F.col("grounding"), F.col("require_text") & ~text, F.col("require_whole_text") & truncated, budget)
    passed = ~gone["node_ids"] & ~gone["edge_ids"] & ~gone["provenance_ids"] & F.col("grounding") & (~F.col("require_text") | text) & (~F.col("require_whole_text") | ~truncated)
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in zip(FAILURES, tests, strict=True))))
    joined = joined.withColumn("passed", passed)
    counts = [(F.size(f"want_{c}") - F.size(f"missing_{c}")).alias(f"matched_{c}") for c in missing]
    sizes = [F.size(f"want_{c}").alias(f"expected_{c}") for c in missing]
    return joined.select("query_id", *sizes, *counts, *(f"missing_{c}" for c in missing), grounded.alias("n_grounded"), "passed", F.when(F.col("passed"), F.array().cast("array<string>")).otherwise(reasons).alias("failures"), F.coalesce("limits", F.array().cast("array<string>")).alias("limits"))


def evaluate_graph_all(cases: DataFrame) -> DataFrame:
    """One row: cases, passed, hit rates of nodes, edges and provenance (one where none is expected), and failures and limits with their counts, by name."""
    rate = lambda c: F.round(F.when(F.sum(f"expected_{c}") > 0, F.sum(f"matched_{c}") / F.sum(f"expected_{c}")).otherwise(1.0), 6)
    totals = cases.agg(F.count(F.lit(1)).alias("n_cases"), F.count(F.when(F.col("passed"), 1)).alias("n_passed"), rate("node_ids").alias("node_hit_rate"), rate("edge_ids").alias("edge_hit_rate"), rate("provenance_ids").alias("provenance_hit_rate"))
    for name in ("failures", "limits"):
        counted = cases.select(F.explode(name).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        listed = counted.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "n")))).alias(f"{name[:-1]}_counts"))
        totals = totals.join(F.broadcast(listed))
    return totals
