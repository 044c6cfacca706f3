"""Stored vectors: what is embedded again, and what a store holds after refreshes."""

import random

from pyspark.sql import functions as F

from quillstone.operators import neighbours, retrieval
from quillstone.sources.vectors import StoredVectors


def embedder(seen):
    """Vectors that tell their text; the texts go to ``seen``."""

    def embed(texts):
        rows = texts.collect()
        seen.extend(r.text for r in rows)
        return texts.sparkSession.createDataFrame([(r.hash, [float(len(r.text)), float(sum(map(ord, r.text)) % 97)]) for r in rows], "hash string, vector array<double>")

    return embed


def test_only_new_texts_are_embedded(spark, tmp_path):
    rng, now = random.Random(1), {}
    store, known = StoredVectors(spark, f"file://{tmp_path}/store", ("p", "id")), set()
    for round_ in range(4):
        for _ in range(12):
            now["p", str(rng.randrange(15))] = rng.choice([None, "", "same", f"text {round_} {rng.randrange(6)}"])
        for key in rng.sample(sorted(now), 3):
            del now[key]
        seen = []
        store = store.refresh(spark.createDataFrame([(*k, t) for k, t in now.items()], "p string, id string, text string"), embedder(seen))
        texts = {t or "" for t in now.values()}
        assert len(seen) == len(set(seen)) and not set(seen) & (known & texts & held_before if round_ else set())
        held = {(r.p, r.id): r.vector for r in store.rows().collect()}
        assert held == {k: [float(len(t or "")), float(sum(map(ord, t or "")) % 97)] for k, t in now.items()}
        known |= set(seen)
        held_before = texts
        assert {r.segment: r.n for r in store.embedded().collect()}[round_] == len(seen)
    seen = []
    again = store.refresh(spark.createDataFrame([(*k, t) for k, t in now.items()], "p string, id string, text string"), embedder(seen))
    assert seen == [] and spark.read.parquet(f"{again.path}/4/rows").count() == 0
    one = again.compacted(f"file://{tmp_path}/one")
    assert {(r.p, r.id): r.vector for r in one.rows().collect()} == held


def test_a_request_over_an_index(spark, tmp_path):
    """A vector field may be an index that a policy chose; a small collection gives the exact rows."""
    rng = random.Random(4)
    rows = [("p", f"{k:03d}", "text", [rng.gauss(0, 1) for _ in range(64)]) for k in range(80)]
    docs = spark.createDataFrame(rows, "partition_key string, id string, text string, vector array<double>").cache()
    queries = spark.createDataFrame([(1, "one query"), (2, "another")], "query_id long, query string")
    packed = docs.select(F.struct("partition_key", "id").alias("id"), "vector")
    found = []
    for field in (docs.select("partition_key", "id", "vector"), neighbours.index_of("diskANN", packed, f"file://{tmp_path}/g"), neighbours.index_of("quantizedFlat", packed, f"file://{tmp_path}/l")):
        collection = retrieval.Collection(docs.select("partition_key", "id", "text"), vectors={"v": (field, "cosine")})
        got = retrieval.run({"vector_fields": {"v": 1.0}, "limit": 5}, {"docs": collection}, queries)
        found.append(sorted((r.query_id, r.id, r["rank"]) for r in got.collect()))
    assert found[0] == found[1] == found[2] and len(found[0]) == 10
