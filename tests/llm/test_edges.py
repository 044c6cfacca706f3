"""Each operator on tables with nulls, empty and long texts, ties, repeated rows, no rows, and other columns of clashing names."""

import pytest
from pyspark.sql import functions as F

import public_tokenizers
from quillstone.llm import context_tree, embedding_dedup, jaccard_join, line_dedup, line_frequency, mixing, packing, quality_model, secrets, warc

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
LONG = "\n".join(" ".join(WORDS[(k * j) % 10] + str(k % 97) for j in range(9)) for k in range(3000))
TEXTS = [(1, "one two three four five six"), (1, "one two three four five six"), (2, None), (3, ""), (4, "  \n\t"), (None, "no id here at all"), (5, LONG), (6, LONG), (7, "été ß 漢字 \U0001f600 words\nété ß 漢字 \U0001f600 words"), (8, "\x00 nul \x0b tab\x0c feed")]
EXTRA = "id long, size long, copies int, score double, body string, text_key long, spans string, lines string, key string, n int"


def table(spark, rows):
    """Documents with many columns whose names the operators use inside."""
    full = [(i, t, None if k % 4 == 0 else f"s{k % 2}", k, k, 1, 0.5, "b", 1, "s", "l", "k", 1) for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, f"doc_id long, text string, source string, {EXTRA}")


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, TEXTS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return table(spark, TEXTS).limit(0)


CASES = {
    "context_tree": lambda d: context_tree.score(d, F.coalesce(F.col("doc_id") == 5, F.lit(False))),
    "line_dedup": line_dedup.dedup,
    "mixing": mixing.mix,
    "mixing_apply": mixing.apply,
    "line_frequency": line_frequency.judge,
    "line_frequency_text": lambda d: line_frequency.judge(d, with_text=True),
    "packing": lambda d: packing.pack(d, TOKENIZER, with_ids=True),
    "quality": lambda d: quality_model.score(d, quality_model.fit([]), keep=d.columns, score_column="quality_"),
    "warc": lambda d: warc.round_trip(d, "doc_id", url_column="source", payload_column="text"),
    "secrets": secrets.scan,
    "jaccard": jaccard_join.join,
    "distinct": jaccard_join.distinct_documents,
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_odd_rows(docs, name):
    found = CASES[name](docs).collect()
    if name not in ("packing", "mixing_apply", "distinct"):
        assert len(found) == len(TEXTS)
    if name in ("mixing_apply", "distinct", "line_dedup", "quality"):
        assert found[0].asDict().keys() >= set(docs.columns)


@pytest.mark.parametrize("name", sorted(CASES))
def test_no_rows(empty, name):
    assert CASES[name](empty).collect() == []


def test_repeated_rows_are_treated_alike(docs):
    for name in ("context_tree", "line_frequency", "secrets", "jaccard"):
        pair = [r for r in CASES[name](docs).collect() if r.doc_id == 1]
        assert pair[0] == pair[1], name


def test_jaccard_on_odd_rows(docs):
    found = {r.doc_id: r for r in CASES["jaccard"](docs).collect()}
    assert found[2].n_shingles == found[3].n_shingles == found[4].n_shingles == 0
    assert found[6].component_id == 5 and found[2].component_id == 2 and not found[6].kept
    kept = [r.doc_id for r in CASES["distinct"](docs).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, None, 5, 7, 8], key=str)


def test_line_dedup_on_odd_rows(docs):
    found = {r.doc_id: r for r in line_dedup.dedup(docs).collect()}
    assert found[2].text is None and found[3].text == "" and found[4].text == "  \n\t"
    # a text's own repeated lines stay as long as they make no run of fifty words
    assert found[7].n_removed_ == 0 and found[6].n_removed_ == 3000 and found[5].n_removed_ < 3000


def test_packing_on_odd_rows(docs):
    found = packing.pack(docs, TOKENIZER, with_ids=True).collect()
    lonely = [r for r in found if r.doc_id in (2, 3, 4)]
    assert all(r.doc_tokens == 1 and r.ids == [2] for r in lonely) and len(lonely) == 3
    assert sum(r.length for r in found if r.doc_id == 5) == next(r.doc_tokens for r in found if r.doc_id == 5)


def test_vectors_on_odd_rows(spark):
    good = [0.5, -1.0, 2.0]
    rows = [(1, good, 1), (2, good, 1), (2, good, 1), (3, None, 1), (4, [0.0, 0.0, 0.0], 1), (5, [1.0, float("nan"), 0.0], 1), (6, [1.0, None, 0.0], 1), (7, [float("inf"), 0.0, 1.0], 1), (8, good, None), (9, good, 2), (10, good[:2], 1), (None, good, 1), (11, [1.0, -2.0, 4.0], 1), (12, [], 1)]
    data = spark.createDataFrame([(i, v, lab, 0, 0) for i, v, lab in rows], "vec_id long, embedding array<double>, label int, cls int, met int")
    found = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.dedup(data).collect())
    links = {"1": 4, "2": 4, "11": 4, "None": 4}
    assert len(found) == len(rows)
    for name, n, component, kept in found:
        assert n == links.get(name, 0)
        assert component == (1 if name in links else int(name)) and kept == (name not in links or name == "1")
    assert embedding_dedup.dedup(data.limit(0)).collect() == []


def test_unlabelled_training(spark, docs):
    labels = spark.createDataFrame([(1, 1), (5, None), (7, 3)], "doc_id long, quality int")
    model = quality_model.train(docs, labels)
    assert all(0 <= r.score <= 1 for r in quality_model.score(docs.drop("score"), model).collect())
