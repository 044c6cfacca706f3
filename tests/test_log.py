"""Record logs: merges against a plain dictionary, races, and bytes in proportion to the change."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillstone.sources.log import Conflict, Log, Records
from quillstone.sources.tables import names_in, put_if_absent

SCHEMA = "partition_key string, id string, price double, seq int, at int"


def size(folder):
    return sum(p.stat().st_size for p in Path(folder).rglob("*.parquet"))


def changes(spark, rows):
    return spark.createDataFrame([("p", str(i), float(v), k, k) for k, (i, v) in enumerate(rows)], SCHEMA)


def state(log):
    return {r.id: (r.price, r.revision, r.etag) for r in log.read().collect()}


def test_a_log_is_what_a_dictionary_is(spark, tmp_path):
    rng, log, want = random.Random(3), Records(spark, f"file://{tmp_path}/log"), {}
    with pytest.raises(ValueError):
        log.read()
    first = [(k, k) for k in range(30)]
    log.append(changes(spark, first).select("partition_key", "id", "price", F.lit(1).cast("bigint").alias("revision"), F.lit("rev:1").alias("etag"), F.col("at").alias("created_at"), F.col("at").alias("updated_at")))
    want = {str(k): (float(v), 1) for k, v in first}
    versions = [dict(want)]
    for _ in range(7):
        if rng.random() < 0.3:
            gone = rng.sample(sorted(want), 4)
            log.delete(spark.createDataFrame([("p", g) for g in gone], "partition_key string, id string"))
            for g in gone:
                del want[g]
        else:
            rows = [(rng.randrange(40), rng.randrange(1000)) for _ in range(6)]
            log.upsert(changes(spark, rows), ["price"])
            for i, v in rows:
                want[str(i)] = (float(v), want.get(str(i), (0, 0))[1] + 1)
        versions.append(dict(want))
        assert state(log) == {i: (v, n, f"rev:{n}") for i, (v, n) in want.items()}
    assert {r.id: r.price for r in log.read(3).collect()} == {i: v for i, (v, _) in versions[2].items()}
    before = state(log)
    log.settle()
    assert state(log) == before and len(log.segments()) < 8
    log.compact()
    assert state(log) == before and len(log.segments()) == 1
    log.clean(1)
    assert state(log) == before and len(names_in(spark, f"{log.path}/segments")) == 1


def test_writes_grow_with_the_change(spark, tmp_path):
    """A change of ten records of twenty thousand adds a hundredth of the base at most, and many of them are merged a few times each."""
    log = Records(spark, f"file://{tmp_path}/log")
    base = spark.range(20_000).select(F.lit("p").alias("partition_key"), F.col("id").cast("string").alias("id"), F.rand(1).alias("price"), F.lit(1).cast("bigint").alias("revision"), F.lit("rev:1").alias("etag"), F.lit(0).alias("created_at"), F.lit(0).alias("updated_at"))
    log.append(base.coalesce(1))
    whole = size(tmp_path)
    log.upsert(changes(spark, [(k * 7, k) for k in range(10)]).coalesce(1), ["price"])
    assert size(tmp_path) - whole < whole / 50
    before = state(log)
    segments = len(log.segments())
    log.settle()
    assert len(log.segments()) == segments and state(log) == before  # the base is not touched for little


def test_of_two_conditional_writers_one_succeeds(spark, tmp_path):
    log = Records(spark, f"file://{tmp_path}/log")
    log.append(changes(spark, [(1, 5), (2, 5)]).select("partition_key", "id", "price", F.lit(1).cast("bigint").alias("revision"), F.lit("rev:1").alias("etag"), F.col("at").alias("created_at"), F.col("at").alias("updated_at")))
    statuses, failed = [], []

    def write(value):
        try:
            asked = spark.createDataFrame([("p", "1", value, 1, "rev:1")], "partition_key string, id string, price double, at int, expected string")
            statuses.extend(r.status for r in Records(spark, log.path).put(asked, ["price"])[1].collect())
        except Exception as error:  # noqa: BLE001  shown by the test
            failed.append(error)

    threads = [threading.Thread(target=write, args=(float(k),)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not failed and sorted(statuses) == ["conflict"] * 3 + ["updated"]
    assert state(log)["1"][1:] == (2, "rev:2") and state(log)["2"] == (5.0, 1, "rev:1")
    # blind writers all get through, one after another
    writers = [threading.Thread(target=lambda k=k: Records(spark, log.path).upsert(changes(spark, [(9, k)]), ["price"])) for k in range(3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert state(log)["9"][1] == 3 and log.version() == 5


def test_a_file_is_put_once(spark, tmp_path):
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if put_if_absent(spark, f"file://{tmp_path}/one/v.json", str(k) * 1000) else None) for k in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and (tmp_path / "one" / "v.json").read_text() == str(won[0]) * 1000
    assert [n for n in names_in(spark, f"file://{tmp_path}/one") if not n.startswith(".")] == ["v.json"]
    assert names_in(spark, f"file://{tmp_path}/two") == []


def test_rows_of_one_name_are_written_once(spark, tmp_path):
    log = Log(spark, f"file://{tmp_path}/log", ["k"], "v")
    for n in range(9):
        rows = spark.createDataFrame([(k, n * 10 + k) for k in range(3)] + [(77, 100 - n)], "k int, v int")
        assert log.append(rows, f"batch-{n}") == log.append(rows, f"batch-{n}")
        log.settle()
        log.clean()
    assert log.append(rows, "batch-2") == log.version()
    assert {r.k: r.v for r in log.read().collect()} == {0: 80, 1: 81, 2: 82, 77: 100}
    assert len(log.segments()) <= 4 and Conflict.__doc__
