import pytest
from pyspark.sql import functions as F

from quillstone.plans import filters, paging

ROWS = [("a", 1, '{"s": "active", "n": 3, "x": null}'), ("b", 2, '{"s": "pending", "n": 3.5}'), ("c", 3, '{"n": "3", "deep": {"k": [10, 20]}}'), ("d", None, None)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(ROWS, "id string, rank int, body string")


def ids(data, tree):
    paths = filters.Paths({"/id": "id", "/rank": "rank"}, body="body")
    return "".join(r.id for r in data.filter(filters.build(tree, paths)).orderBy("id").collect())


@pytest.mark.parametrize(
    ("tree", "want"),
    [
        (None, "abcd"),
        ({"all": []}, "abcd"),
        ({"path": "/s", "value": "active"}, "a"),
        ({"path": "/s", "op": "NEQ", "value": "active"}, "b"),
        ({"path": "/n", "op": "gte", "value": 3}, "ab"),
        ({"path": "/n", "value": "3"}, "c"),
        ({"path": "/x", "op": "eq", "value": None}, "a"),
        ({"path": "/x", "op": "exists", "value": False}, "bcd"),
        ({"path": "/x", "op": "exists"}, "a"),
        ({"path": "$.deep.k.1", "value": 20}, "c"),
        ({"path": "/rank", "op": "in", "value": [1, 3]}, "ac"),
        ({"path": "/rank", "op": "in", "value": []}, ""),
        ({"any": [{"path": "/s", "op": "startsWith", "value": "pen"}, {"path": "/ID", "op": "contains", "value": "a"}]}, "ab"),
        ({"path": "/rank", "op": "eq", "value": None}, "d"),
    ],
)
def test_tree(data, tree, want):
    assert ids(data, tree) == want


@pytest.mark.parametrize("tree", [{"path": "/a b", "value": 1}, {"path": "/s", "op": "like", "value": "x"}, {"path": "/s", "value": [1]}, {"path": "/s", "op": "gt", "value": float("nan")}, {"nope": []}, {"all": [{"path": "/s", "value": 1}] * 101}])
def test_refused(tree):
    with pytest.raises(filters.FilterError):
        filters.build(tree, filters.Paths(body="body"))


def test_too_deep():
    tree = {"path": "/s", "value": 1}
    for _ in range(17):
        tree = {"all": [tree]}
    with pytest.raises(filters.FilterError):
        filters.build(tree, filters.Paths(body="body"))


def test_promoted_filters_are_pushed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    tree = {"all": [{"path": "/metadata/lang", "value": "en"}, {"path": "/metadata/nChars", "op": "gte", "value": 500}]}
    found = docs.filter(filters.build(tree, filters.Paths({"/metadata/lang": "lang", "/metadata/nChars": "n_chars"}))).select("doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThanOrEqual(n_chars,500)" in plan and "text" not in plan.split("ReadSchema")[1]


def test_pages(spark):
    data = spark.createDataFrame([("p", f"i{k}", k % 3) for k in range(10)], "partition_key string, id string, v int")
    seen, token = [], None
    while True:
        rows = paging.page(data, [("v", "desc")], 4, token).orderBy("position").collect()
        seen += [r.id for r in rows]
        token = rows[-1].next_token
        if token is None:
            break
    assert seen == [r.id for r in data.orderBy(F.col("v").desc(), "id").collect()]
    assert paging.decode_token(paging.encode_token(2)) == 2 and paging.encode_token(2) == "Mg=="
