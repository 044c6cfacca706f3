"""Fill-in-the-middle, spelling variants and sharding against brute force, exact round trips and the law of a uniform shuffle."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstone.llm import fill_middle, sharding, spelling
from quillstone.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LONG = "zwölf Boxkämpfer \U0001f600 jagen\n" * 9000
TEXTS = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (4, " \n\t"), (None, "no id here"), (5, LONG), (6, LONG), (7, "été ß 漢字 \U0001f600"), (8, "holds <P> a mark"), (9, "<S"), (10, "P>")]
CLASHES = "n long, form string, output string, key string, body string, word string, block long, shard int, slot string, row_ long, slice_ int, key_ long, begin_ long, n_ long"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, "f", "o", "k", "b", "w", 2, 3, "s", 4, 5, 6, 7, 8) for i, t in TEXTS]
    return spark.createDataFrame(rows, f"doc_id long, text string, {CLASHES}").repartition(3).cache()


# 11: fill in the middle


def plainly(key, text, seed=1):
    """The contract over code points, cut by slices of a string."""
    text = text or ""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    h = [int(digits[k : k + 8], 16) for k in range(0, 32, 8)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(m in text for m in fill_middle.MARKS) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_fill_middle(spark, odd):
    rows = fill_middle.apply(odd).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    given_rows = collections.Counter((i, *plainly(i, t), t or "") for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in rows) == given_rows
    assert fill_middle.apply(odd.limit(0)).collect() == []


def test_fill_middle_over_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op11_fill_middle"](spark, SF).collect()}
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for d in docs.collect():
        n, form, a, m, output = plainly(d.doc_id, d.text)
        assert tuple(rows[d.doc_id]) == (d.doc_id, n, form, a, m, digest(output), digest(d.text or ""))
    assert {r.form for r in rows.values()} == {"plain", "psm", "spm"}


@settings(max_examples=150, deadline=None)
@given(st.text(st.sampled_from("ab \n\té漢\U0001f600"), max_size=60), st.integers(1, 7), st.sampled_from(sorted(fill_middle.UNITS)))
def test_checkpoints_cut_where_units_begin(text, step, unit):
    pieces = {"code_point": list(text), "line": re.findall(r"[^\n]*\n|[^\n]+", text), "word": re.findall(r"^[ \n\t]+[^ \n\t]*[ \n\t]*|[^ \n\t]+[ \n\t]*", text)}[unit]
    assert "".join(pieces) == text
    old, fill_middle.BLOCK = fill_middle.BLOCK, 5
    try:
        index = fill_middle.Checkpoints(text.encode(), unit, step)
        assert (index.units, index.points) == (len(pieces), len(text))
        assert index.marks.shape[1] == -(-len(pieces) // step)
        for k in range(len(pieces) + 2):
            before = "".join(pieces[:k])
            assert index.cut(k) == (len(before.encode()), len(before))
    finally:
        fill_middle.BLOCK = old


def test_fill_middle_by_lines_and_words(spark, odd):
    for unit in ("line", "word"):
        rows = fill_middle.apply(odd, unit=unit, percent=100, spm_percent=50).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
        assert collections.Counter((r.doc_id, r.back) for r in rows) == collections.Counter((i, t or "") for i, t in TEXTS)
        long = next(r for r in rows if r.doc_id == 5)
        assert long.form != "plain" and (LONG[long.prefix_chars - 1 : long.prefix_chars] in "\n " and LONG[: long.prefix_chars].count("\n") <= 9000)
    with pytest.raises(ValueError):
        fill_middle.apply(odd, marks=("aa", "b", "c"))
    with pytest.raises(ValueError):
        fill_middle.apply(odd, marks=("<x", "<x>", "c"))


# 12: spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def counted(rows, least):
    n = collections.Counter()
    for key, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for word in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if key is None else key}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if len(word) >= 6:
                n[word] += 1
    return {w: c for w, c in n.items() if c >= least}


def grouped(n):
    near = {w: [o for o in n if one_edit(w, o)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def test_spelling_variants(spark):
    rng = random.Random(5)
    stems = ["".join(rng.choice("abçé") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["a" * k for k in range(6, 12)]
    words = []
    for stem in stems:
        words += [stem] * rng.choice([5, 30, 200])
        for _ in range(12):
            k = rng.randrange(len(stem))
            other = rng.choice([stem[:k] + stem[k + 1 :], stem[:k] + rng.choice("abçé") + stem[k:], stem[:k] + rng.choice("abçé") + stem[k + 1 :]])
            words += [other.upper() if other.isascii() else other] * rng.choice([1, 5, 6])
    words += ["chainword"] * 300 + ["chainwords"] * 40 + ["chainwordss"] * 7
    rng.shuffle(words)
    rows = [(k, " ".join(words[k::40])) for k in range(40)] + [(None, words[0] + "·" + words[1]), (41, None), (42, ""), (43, "x" * 5000 + " " + "x" * 4999), (43, "x" * 5000 + " " + "x" * 4999)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n", "3 AS block", "4 AS length").repartition(3)
    wanted = grouped(counted(rows, 5))
    assert any(form and form != root for _, form, root, *_ in wanted)
    for most in (64, 2):
        found = spelling.variants(docs, most=most).collect()
        assert {tuple(r) for r in found} == wanted and len(found) == len(wanted)
    assert {tuple(r) for r in spelling.variants(docs, min_count=1, min_length=6, most=8).collect()} == grouped(counted(rows, 1))
    assert spelling.variants(docs.limit(0)).collect() == []


def test_blocks_are_divided(spark):
    """Words of one beginning: no block but those of a single place has more than the bound, and no pair is lost."""
    rng = random.Random(1)
    words = sorted({"prefix" + "".join(rng.choice("abcdef") for _ in range(rng.randint(4, 5))) for _ in range(1500)})
    table = spark.createDataFrame([(w, k + 1, len(w)) for k, w in enumerate(words)], "word string, n long, length int")
    for part in spelling.blocks(table, 16):
        sizes = part.groupBy("block").agg(F.count("*").alias("size"), F.max("kind").alias("kind")).collect()
        assert all(r.size <= 16 or r.kind > 0 and r.size <= 90 for r in sizes)
    wanted = set()
    for w in words:
        for k in range(len(w) + 1):
            for c in "abcdefprix":
                wanted |= {(w, o) for o in (w[:k] + c + w[k:], w[:k] + c + w[k + 1 :], w[:k] + w[k + 1 :]) if o != w}
    wanted = {(a, b) for a, b in wanted if b in set(words)}
    found = [(r.word, r.other) for r in spelling.near_pairs(table, 16).collect()]
    assert len(found) == len(set(found)) and set(found) == wanted


# 13: sharding


def test_shards_are_exact_and_whole(spark, odd):
    found = sharding.shuffled(odd, shards=5, slice_rows=1)
    assert found.columns == [c for c in odd.columns if c not in ("shard", "slot")] + ["shard", "slot"]
    rows = found.collect()
    assert collections.Counter((r.doc_id, r.text) for r in rows) == collections.Counter(TEXTS)
    slots = collections.defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(len(x) for x in slots.values()) == [2, 2, 2, 3, 3] and all(sorted(x) == list(range(len(x))) for x in slots.values())
    assert sharding.shuffled(odd.limit(0)).collect() == []


def test_sharding_of_all_documents(spark):
    docs = {d.doc_id: d.text or "" for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op13_sharding"](spark, SF).collect()
    assert {r.doc_id: (r.size, r.text_crc32) for r in rows} == {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs.items()} and len(rows) == len(docs)
    sizes = collections.Counter(r.shard for r in rows)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    assert {(r.shard, r.slot) for r in rows} == {(s, k) for s, n in sizes.items() for k in range(n)}
    assert rows == QUERIES["op13_sharding"](spark, SF).collect()


def test_matrix_has_the_law_of_a_uniform_shuffle():
    """Rows and columns sum up as they should, and each number has the mean and variance of drawing without replacement."""
    counts, sizes = np.array([7, 0, 12, 1, 30]), np.array([20, 20, 10])
    drawn = np.stack([[sharding.matrix_row(counts, sizes, p, seed) for p in range(5)] for seed in range(3000)])
    assert (drawn >= 0).all() and (drawn.sum(axis=2) == counts).all() and (drawn.sum(axis=1) == sizes).all()
    n = counts.sum()
    mean = np.outer(counts, sizes) / n
    variance = mean * (1 - sizes / n) * ((n - counts)[:, None] / (n - 1))
    assert np.abs(drawn.mean(axis=0) - mean).max() < 0.15 and np.abs(drawn.var(axis=0) - variance).max() < 0.25


def test_every_order_occurs(spark):
    rows = spark.range(3).repartition(2).cache()
    seen = collections.Counter()
    for seed in range(30):
        found = sorted((r.shard, r.slot, r.id) for r in sharding.shuffled(rows, 2, seed).collect())
        seen[tuple(i for _, _, i in found)] += 1
    assert len(seen) == 6 and max(seen.values()) <= 14


def test_numbers_beyond_numpys_bound():
    """The window around the mode against numpy where both can draw, and the moments where only the window can."""
    rng = np.random.default_rng(4)
    old, sharding.NUMPY_MOST = sharding.NUMPY_MOST, 0
    try:
        for good, bad, draws in ((5, 9, 6), (300, 2000, 1200), (40, 3, 41)):
            ours = np.array([sharding.hypergeometric(rng, good, bad, draws) for _ in range(4000)])
            theirs = rng.hypergeometric(good, bad, draws, 4000)
            assert abs(ours.mean() - theirs.mean()) < 5 * (theirs.std() + 0.01) / 60 and abs(ours.std() - theirs.std()) < 0.1 * theirs.std() + 0.02
            assert ours.min() >= max(0, draws - bad) and ours.max() <= min(good, draws)
        many = np.array([sharding.hypergeometric(rng, 10**10 // 16, 15 * 10**10 // 16, 5 * 10**9) for _ in range(200)])
        deviation = (5e9 / 16 * 15 / 16 / 2) ** 0.5
        assert abs(many.mean() - 5e9 / 16) < 5 * deviation / 200**0.5 and 0.8 < many.std() / deviation < 1.2
        assert sharding.hypergeometric(rng, 0, 10**10, 5) == 0 and sharding.hypergeometric(rng, 10**10, 0, 5) == 5 and sharding.hypergeometric(rng, 3, 10**10, 0) == 0
    finally:
        sharding.NUMPY_MOST = old


def test_written_shards(spark, odd, tmp_path):
    sharding.write(odd.select("doc_id", "text"), str(tmp_path / "shards"), 3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert collections.Counter((r.doc_id, r.text) for r in back.collect()) == collections.Counter(TEXTS)
    assert sorted(r["count"] for r in back.groupBy("shard").count().collect()) == [4, 4, 4]
