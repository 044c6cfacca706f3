"""Waits over streams: timers without new rows, state that goes, two streams against tables."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillstone.operators import runs
from quillstone.streaming import events as streams
from quillstone.streaming import waits

SCHEMA = "run_id long, seq long, at timestamp, operation string, kind string, name string, fire_at timestamp, event_id long"
START = dt.datetime(2024, 1, 1)


def hours(x):
    return START + dt.timedelta(hours=x)


def write(spark, rows, schema, path):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)


def source(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*.parquet")


def start(spark, folder, keep=None):
    with waits.with_timers(spark):
        found = waits.timed_waits(source(spark, f"{folder}/in", SCHEMA), keep=keep)
        query = found.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    out = spark.read.schema(found.schema).parquet(f"{folder}/out")
    left = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    return out, left


def test_waits_time_out_without_a_new_row_and_state_goes(spark, tmp_path):
    folder, before = f"file://{tmp_path}", spark.conf.get(waits.STORE, None)
    write(spark, [(k, k, hours(0), "wait", "timer", "t", hours(1), None) for k in range(20)] + [(50, 50, hours(0), "wait", None, "a", hours(3), None), (51, 51, hours(0), "raise", None, "a", None, 7)], SCHEMA, f"{folder}/in/1.parquet")
    out, left = start(spark, folder, keep="4 hours")
    assert out.filter("seq IS NULL").count() == 0 and out.count() == 22 and left[-1] == 22
    # another run's rows move the watermark: the open waits end, and later the outcomes that nobody took and the kept event go
    write(spark, [(99, 99, hours(6), "wait", None, "z", None, None)], SCHEMA, f"{folder}/in/2.parquet")
    out, _ = start(spark, folder, keep="4 hours")
    ended = {(r.run_id, r.outcome, r.name, r.at) for r in out.filter("seq IS NULL").collect()}
    assert ended == {(k, "timer", "t", hours(1)) for k in range(20)} | {(50, "timed_out", "a", hours(3))}
    write(spark, [(99, 100, hours(60), "raise", None, "z", None, 8)], SCHEMA, f"{folder}/in/3.parquet")
    out, left = start(spark, folder, keep="4 hours")
    assert left[-1] <= 1 and out.filter("seq IS NULL").count() == 21
    assert [(r.outcome, r.consumed) for r in out.filter("seq = 100").collect()] == [("resumed", 8)]
    assert spark.conf.get(waits.STORE, None) == before


def test_batches_of_a_stream_answer_as_the_table_does(spark, tmp_path):
    rng = random.Random(2)
    rows = []
    for seq in range(300):
        kind = rng.choice(["timer", "external_event", None])
        wait = rng.random() < 0.5
        at = hours(seq / 4)
        rows.append((rng.randrange(4), seq, at, "wait" if wait else "raise", kind if wait else None, rng.choice("ab"), at + dt.timedelta(minutes=rng.choice([-5, 20, 200])) if wait and rng.random() < 0.6 else None, seq))
    for k in range(3):
        write(spark, rows[k * 100 : k * 100 + 100], SCHEMA, f"file://{tmp_path}/in/{k}.parquet")
    out, _ = start(spark, f"file://{tmp_path}")
    table = runs.waited(spark.createDataFrame(rows, SCHEMA)).select("run_id", "seq", "outcome", "consumed")
    assert sorted(map(tuple, out.filter("seq IS NOT NULL").select(*table.columns).collect()), key=str) == sorted(map(tuple, table.collect()), key=str)


def test_two_streams_meet_as_two_tables_do(spark, tmp_path):
    rng = random.Random(3)
    asked = [(k, rng.randrange(5), rng.choice("ab"), hours(k / 3)) for k in range(200)]
    raised = [(rng.randrange(5), rng.choice("ab"), 1000 + k, hours(rng.random() * 70)) for k in range(150)]
    raised.sort(key=lambda r: r[3])
    left, right = "wait_id long, run_id long, name string, since timestamp", "run_id long, name string, event_id long, at timestamp"
    for k in range(4):
        write(spark, asked[k * 50 : k * 50 + 50], left, f"file://{tmp_path}/waits/{k}.parquet")
        write(spark, raised[k * 38 : k * 38 + 38], right, f"file://{tmp_path}/events/{k}.parquet")
    streamed = streams.drained(waits.resumed_in_time(source(spark, f"file://{tmp_path}/waits", left), source(spark, f"file://{tmp_path}/events", right), "4 hours", "20 hours"), f"file://{tmp_path}/work")
    table = waits.resumed_in_time(spark.createDataFrame(asked, left), spark.createDataFrame(raised, right), "4 hours")
    early = F.col("since") < hours(30)
    rows = lambda df: sorted(map(tuple, df.filter(early).select("wait_id", "event_id", "outcome").collect()), key=str)
    assert rows(streamed) == rows(table) and len(rows(table)) == 90
    wish = {}
    for i, run, name, since in asked:
        fit = [(at, e) for r, n, e, at in raised if (r, n) == (run, name) and since <= at <= since + dt.timedelta(hours=4)]
        wish[i] = min(fit)[1] if fit else None
    assert {r.wait_id: r.event_id for r in table.collect()} == wish
