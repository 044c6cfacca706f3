"""Retrieval quality per case and over cases, and variants against the first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cases(results: DataFrame, expected: DataFrame, negatives: DataFrame | None = None, k: int = 10) -> DataFrame:
    """Per case: hits, hit, reciprocal rank, precision, recall, nDCG at k and the first hard negative's rank.

    results: query_id, ref, rank; expected: query_id, ref, relevance; precision is
    over k. Gains add up per returned row, recall counts distinct references.
    """
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("relevance").desc(), "ref"))
    ideal = expected.withColumn("at", ideal_rank).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_expected"), F.sum(F.when(F.col("at") <= k, F.col("relevance") / F.log2(F.col("at") + 1.0))).alias("ideal"))
    top = results.filter(F.col("rank") <= k)
    hits = top.join(expected, ["query_id", "ref"]).groupBy("query_id").agg(F.countDistinct("ref").alias("hits"), F.min("rank").alias("first"), F.sum(F.col("relevance") / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    found = _measured(ideal, hits, k)
    if negatives is None:
        return found.withColumn("first_negative", F.lit(None).cast("int")).withColumn("has_negatives", F.lit(False))
    bad = negatives.select("query_id", "ref").distinct()
    worst = top.join(bad, ["query_id", "ref"]).groupBy("query_id").agg(F.min("rank").alias("first_negative"))
    return found.join(worst, "query_id", "left").join(bad.select("query_id").distinct().withColumn("has_negatives", F.lit(True)), "query_id", "left").withColumn("has_negatives", F.coalesce("has_negatives", F.lit(False)))


def _measured(ideal: DataFrame, hits: DataFrame, k: int) -> DataFrame:
    """The metrics of each case of ``ideal`` (query_id, n_expected, ideal) by its hits (query_id, hits, first, dcg), if any."""
    found = ideal.join(hits, "query_id", "left")
    matched = F.coalesce("hits", F.lit(0))
    return found.select(
        "query_id",
        "n_expected",
        matched.alias("hits"),
        (matched > 0).alias("hit"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        (matched / F.lit(float(k))).alias("precision"),
        (matched / F.col("n_expected")).alias("recall"),
        F.coalesce(F.col("dcg") / F.col("ideal"), F.lit(0.0)).alias("ndcg"),
    )


def class_cases(results: DataFrame, asked: DataFrame, classes: DataFrame, k: int = 10) -> DataFrame:
    """``cases`` where a case (query_id, wanted, unwanted) expects all references of a class (ref, label) but itself, each with relevance one, and all of another are its negatives.

    References are counted by class, and only returned ones are looked up: no row is
    made for a case and a reference that it expects.
    """
    sizes = classes.filter("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    itself = classes.select(F.col("ref").alias("query_id"), F.col("label").alias("wanted")).groupBy("query_id", "wanted").agg(F.count(F.lit(1)).alias("own"))
    expected = F.col("size") - F.coalesce("own", F.lit(0))
    counted = asked.join(sizes.withColumnRenamed("label", "wanted"), "wanted").join(itself, ["query_id", "wanted"], "left").withColumn("n_expected", expected).filter("n_expected > 0")
    gains = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least(F.col("n_expected"), F.lit(k))), F.lit(0.0), lambda s, x: s + 1 / F.log2(x + 1.0))
    ideal = counted.select("query_id", "n_expected", gains.alias("ideal"))
    top = results.filter(F.col("rank") <= k).join(asked, "query_id").join(classes, "ref")
    good = (F.col("label") == F.col("wanted")) & (F.col("ref") != F.col("query_id"))
    hits = top.filter(good).groupBy("query_id").agg(F.countDistinct("ref").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    worst = top.filter(F.col("label") == F.col("unwanted")).groupBy("query_id").agg(F.min("rank").alias("first_negative"))
    held = asked.join(sizes.select(F.col("label").alias("unwanted")), "unwanted").select("query_id", F.lit(True).alias("has_negatives"))
    found = _measured(ideal, hits, k).join(worst, "query_id", "left").join(held, "query_id", "left")
    return found.withColumn("has_negatives", F.coalesce("has_negatives", F.lit(False)))


def _mean(column: Column) -> Column:
    return F.round(F.avg(column), 6)


# The most cases of an evaluation, expectations and negatives of a case, and variants.
MOST_CASES, MOST_EXPECTED, MOST_NEGATIVES, MOST_VARIANTS = 200, 100, 200, 12


def check_limits(expected: DataFrame, negatives: DataFrame | None = None, variants: int = 1) -> None:
    """Refuses an evaluation beyond the limits."""
    per_case = expected.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)), F.max("n")).first()
    against = None if negatives is None else negatives.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0]
    if per_case[0] > MOST_CASES or (per_case[1] or 0) > MOST_EXPECTED or (against or 0) > MOST_NEGATIVES or variants > MOST_VARIANTS:
        raise ValueError("the evaluation has too many cases, expectations, negatives or variants")


def fallback_rate(cases_run: DataFrame) -> DataFrame:
    """One row: of the cases that asked for a rerank (reranked), the share that fell back (fell_back); zero without any."""
    return cases_run.agg(F.coalesce(F.round(F.avg(F.when(F.col("reranked"), F.col("fell_back").cast("double"))), 6), F.lit(0.0)).alias("rerank_fallback_rate"))


def summary(found: DataFrame, *group: str) -> DataFrame:
    """Means over cases; the hard-negative rate is over the cases that have negatives."""
    return found.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_cases"),
        _mean(F.col("hit").cast("double")).alias("hit_rate"),
        _mean(F.col("reciprocal_rank")).alias("mrr"),
        _mean(F.col("precision")).alias("precision"),
        _mean(F.col("recall")).alias("recall"),
        _mean(F.col("ndcg")).alias("ndcg"),
        _mean(F.when(F.col("has_negatives"), F.col("first_negative").isNotNull().cast("double"))).alias("negative_rate"),
    )


def deltas(summaries: DataFrame, baseline: str, metrics: list[str], variant: str = "variant") -> DataFrame:
    """Each variant's metrics less the baseline's; the baseline is one row."""
    base = summaries.filter(F.col(variant) == baseline).select(*(F.col(m).alias(f"base_{m}") for m in metrics))
    return summaries.join(F.broadcast(base), how="cross").select(variant, *(F.round(F.col(m) - F.col(f"base_{m}"), 6).alias(f"delta_{m}") for m in metrics))


def overlapping(found: DataFrame, wanted: DataFrame, source: str = "source", contained: bool = False, width: int = 4096) -> DataFrame:
    """Pairs of spans (char_start, char_end) of one source that overlap, or of which the wanted one lies within the found one.

    Spans are dealt into cells of ``width`` characters and joined on source and
    cell, so that the range condition is tested near by only; a pair counts in
    the first cell that both touch.
    """

    def dealt(df: DataFrame, side: str) -> DataFrame:
        cells = F.sequence(F.floor(F.col("char_start") / width), F.floor((F.greatest(F.col("char_end"), F.col("char_start") + 1) - 1) / width))
        named = df.select(F.col(source).alias("source"), *(F.col(c).alias(f"{side}_{c}") for c in df.columns if c != source), F.explode(cells).alias("cell"))
        return named

    both = dealt(found, "found").join(dealt(wanted, "wanted"), ["source", "cell"])
    a, b, c, d = (F.col(x) for x in ("found_char_start", "found_char_end", "wanted_char_start", "wanted_char_end"))
    test = (a <= c) & (d <= b) if contained else (a < d) & (c < b)
    return both.filter(test & (F.col("cell") == F.floor(F.greatest(a, c) / width))).drop("cell")


def brief_problems(claims: DataFrame, citations: DataFrame) -> DataFrame:
    """brief_id, claim_id and problem of evidence briefs whose claims (brief_id, claim_id, text, citation_ids, counter_ids) do not stand: blank ones, uncited ones, and those that cite, for or against, what the brief (brief_id, citation_id) does not list."""
    named = claims.withColumn("refs", F.concat(F.coalesce("citation_ids", F.array().cast("array<string>")), F.coalesce("counter_ids", F.array().cast("array<string>"))))
    blank = claims.filter(F.coalesce(F.trim("text"), F.lit("")) == "").select("brief_id", "claim_id", F.lit("blank_claim").alias("problem"))
    bare = claims.filter(F.coalesce(F.size("citation_ids"), F.lit(0)) <= 0).select("brief_id", "claim_id", F.lit("uncited_claim").alias("problem"))
    asked = named.select("brief_id", "claim_id", F.explode("refs").alias("citation_id"))
    lost = asked.join(citations.select("brief_id", "citation_id").distinct(), ["brief_id", "citation_id"], "left_anti").select("brief_id", "claim_id", F.lit("unknown_citation").alias("problem")).distinct()
    return blank.unionByName(bare).unionByName(lost)


#: Sources of a result or of an expectation.
SOURCES = "array<struct<id:string,kind:string,uri:string,span:struct<char_start:int,char_end:int,line:int,column:int,anchor:string>>>"


def source_matches(found: Column, wanted: Column) -> Column:
    """Whether a source is the one that an expectation names: all of id, kind and uri that it gives are equal, one at least, and its span lies within."""
    named, equal = F.lit(False), F.lit(True)
    for part in ("id", "kind", "uri"):
        given = F.coalesce(F.trim(wanted[part]), F.lit("")) != ""
        named = named | given
        equal = equal & (~given | F.coalesce(found[part] == wanted[part], F.lit(False)))
    a, b = found["span"], wanted["span"]
    inside = (b["char_start"].isNull() | F.coalesce(a["char_start"] <= b["char_start"], F.lit(False))) & (b["char_end"].isNull() | F.coalesce(a["char_end"] >= b["char_end"], F.lit(False)))
    for part in ("line", "column", "anchor"):
        inside = inside & (b[part].isNull() | F.coalesce(a[part] == b[part], F.lit(False)))
    return named & equal & (b.isNull() | (a.isNotNull() & inside))


def _first_of(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """query_id, rank and ref: the first of ``wanted``, by position and ref, that each result meets."""
    kinds = {"collection": "string", "partition_key": "string", "sources": SOURCES}
    with_all = lambda df: df.withColumns({c: F.lit(None).cast(k) for c, k in kinds.items() if c not in df.columns})
    position = F.col("position") if "position" in wanted.columns else F.lit(0)
    named = with_all(wanted).select("query_id", "ref", position.alias("position"), "refs", *(F.col(c).alias(f"wanted_{c}") for c in kinds))
    rows = with_all(results).select("query_id", "rank", F.col("refs").alias("own_refs"), *kinds)
    free = lambda c: F.coalesce(F.col(f"wanted_{c}"), F.lit("")) == ""
    scope = F.lit(True)
    for c in ("collection", "partition_key"):
        scope = scope & (free(c) | F.coalesce(F.col(c) == F.col(f"wanted_{c}"), F.lit(False)))
    by_source = F.exists("sources", lambda x: F.exists("wanted_sources", lambda y: source_matches(x, y)))
    test = scope & (F.coalesce(F.arrays_overlap("own_refs", "refs"), F.lit(False)) | F.coalesce(by_source, F.lit(False)))
    # a case has few expectations and few results that count, see the limits
    met = rows.join(named, "query_id").filter(test)
    return met.groupBy("query_id", "rank").agg(F.min(F.struct("position", "ref")).alias("first")).select("query_id", "rank", "first.ref")


def first_match(results: DataFrame, expected: DataFrame, negatives: DataFrame | None = None, k: int = 10) -> DataFrame:
    """``cases`` of results and expectations that know each other by any of several ids (``refs``: a record's own, its sources' and aliases) or by sources, each result counting for the first expectation that it meets.

    Expectations go by ``position`` if they have one, else by ref. Those with a
    collection or partition_key are met by its results alone; sources are those of
    ``SOURCES``. All of these columns may be absent.
    """
    top = results.filter(F.col("rank") <= k)
    met = _first_of(top, expected)
    if negatives is None:
        return cases(met, expected.select("query_id", "ref", "relevance"), None, k)
    # a result may meet an expectation and a negative
    mark = lambda df, name: df.withColumn("ref", F.concat(F.lit(name), F.col("ref").cast("string")))
    both = mark(met, "+").unionByName(mark(_first_of(top, negatives), "-"))
    return cases(both, mark(expected.select("query_id", "ref", "relevance"), "+"), mark(negatives.select("query_id", "ref"), "-"), k)
