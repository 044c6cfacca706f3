"""What a policy's indexes skip, what a snapshot's hash is of, and which expectation a result meets."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from quillstone.operators import evaluation
from quillstone.sources import records
from quillstone.sources.collections import Catalog, Policy


def scanned(df):
    """Rows that a scan gives, behind what it skips by statistics, pages and Bloom filters."""
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    return leaf.metrics().get("numOutputRows").get().value()


def test_indexed_columns_are_skipped_over(spark, tmp_path):
    rows = spark.range(120_000).select(F.lit("p").alias("partition_key"), F.col("id").cast("string").alias("id"), F.pmod(F.xxhash64("id"), F.lit(50_000)).alias("rank"), F.sha2(F.col("id").cast("string"), 256).alias("code"), F.lit("body").alias("body"))
    known = hashlib.sha256(b"777").hexdigest()
    seen = {}
    for name, policy in (("plain", Policy("plain")), ("indexed", Policy("indexed", indexed=("/metadata/rank", "/metadata/code")))):
        catalog = Catalog(spark, f"file://{tmp_path}/{name}")
        catalog.create(policy)
        catalog.write(name, rows.coalesce(2), row_group_bytes=400_000)
        held = catalog.read(name)
        assert held.filter(F.col("code") == known).count() == 1 and held.filter("rank BETWEEN 100 AND 200").count() == rows.filter("rank BETWEEN 100 AND 200").count()
        seen[name] = (scanned(held.filter(F.col("code") == known)), scanned(held.filter("rank BETWEEN 100 AND 200")))
        assert held.count() == 120_000
    assert seen["indexed"][0] < seen["plain"][0] / 3 and seen["indexed"][1] < seen["plain"][1] / 3


def test_a_snapshots_hash_is_of_its_canonical_text(spark):
    rows = [("p", "b", '{"z": 1, "a": ["é", 1e-7, "<&>"]}', 3, "x"), ("p", "a", None, None, "y"), ("o", "c", '"text"', 1, None)]
    state = spark.createDataFrame(rows, "partition_key string, id string, content string, revision int, extra string")
    policy = {"name": "docs", "indexed": []}
    found = records.snapshot(state, state.columns, 2, "docs", policy).first()
    line = lambda p, i, content, revision, extra: f'{{"id":"{i}","partitionKey":"{p}","type":null,"schemaVersion":null,"metadata":null,"content":{content},"sources":null,"vectors":null,"etag":null,"revision":{revision},"createdAt":null,"updatedAt":null,"extra":{extra}}}'
    text = '{"collection":"docs","policy":{"name":"docs","indexed":[]},"records":[' + line("o", "c", '"text"', 1, "null") + "," + line("p", "a", "null", "null", '"y"') + "]}"
    assert found[:] == (2, True, "sha256:" + hashlib.sha256(text.encode()).hexdigest())
    whole = records.snapshot(state, state.columns, 10, "docs", policy).first()
    text = text[:-2] + "," + line("p", "b", '{"z":1,"a":["\\u00E9",1E-07,"\\u003C\\u0026\\u003E"]}', 3, '"x"') + "]}"
    assert whole[:] == (3, False, "sha256:" + hashlib.sha256(text.encode()).hexdigest())
    assert records.snapshot(state.limit(0), state.columns).first().record_count == 0
    assert json.loads(text)["records"][2]["id"] == "b"


SPAN = {"char_start": 10, "char_end": 20, "line": None, "column": None, "anchor": None}


def source(id_=None, kind=None, uri=None, **span):
    return {"id": id_, "kind": kind, "uri": uri, "span": {**dict.fromkeys(SPAN), **span} if span else None}


@pytest.mark.parametrize(
    ("found", "wanted", "meets"),
    [
        (source("a"), source("a"), True),
        (source("a", "k"), source("a", "other"), False),
        (source("a", "k"), source("", "k"), True),
        (source("a"), source(), False),
        (source("a", char_start=0, char_end=30), source("a", char_start=10, char_end=20), True),
        (source("a", char_start=11, char_end=30), source("a", char_start=10, char_end=20), False),
        (source("a"), source("a", char_start=10), False),
        (source("a", char_start=5), source("a", char_start=10), True),
        (source("a", line=3), source("a", line=4), False),
        (source(uri="u", anchor="x", line=1), source(uri="u", anchor="x"), True),
    ],
)
def test_sources(spark, found, wanted, meets):
    kind = evaluation.SOURCES[6:-1]
    row = spark.createDataFrame([(found, wanted)], f"found {kind}, wanted {kind}")
    assert row.select(evaluation.source_matches(F.col("found"), F.col("wanted")).alias("m")).first().m is meets


def test_results_meet_the_first_expectation_in_its_scope(spark):
    results = spark.createDataFrame([(1, 1, ["r", "alias"], "main", "p", None), (1, 2, ["s"], "main", "q", [source("src", char_start=0, char_end=50)]), (1, 3, ["t"], "other", "p", None), (1, 11, ["z"], "main", "p", None)], f"query_id int, rank int, refs array<string>, collection string, partition_key string, sources {evaluation.SOURCES}")
    expected = spark.createDataFrame([(1, "z", 0, 5.0, ["alias"], None, None, None), (1, "a", 1, 1.0, ["r"], "", None, None), (1, "span", 2, 2.0, [], None, None, [source("src", char_start=5, char_end=9)]), (1, "far", 3, 2.0, ["t"], "main", None, None)], f"query_id int, ref string, position int, relevance double, refs array<string>, collection string, partition_key string, sources {evaluation.SOURCES}")
    negatives = spark.createDataFrame([(1, "bad", ["alias", "s"], "q")], "query_id int, ref string, refs array<string>, partition_key string")
    row = evaluation.first_match(results, expected, negatives).first()
    # the first result counts for z, whose name comes last; the third is of another collection
    assert (row.hits, row.n_expected, row.reciprocal_rank) == (2, 4, 1.0)
    ideal = 5 + 2 / 1.584962500721156 + 2 / 2 + 1 / 2.321928094887362
    assert abs(row.ndcg - (5 + 2 / 1.584962500721156) / ideal) < 1e-9
    assert row.first_negative == 2 and row.has_negatives
    assert evaluation.first_match(results, expected).first().has_negatives is False
