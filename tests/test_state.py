"""Operators that judge operations one after another, against plain loops."""

import copy
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quillstone.operators import canonical, runs


def judged(rows):
    """A store that applies each transaction to a copy and keeps the copy if nothing objects."""
    stores, out = {}, {}
    for row in sorted(rows, key=lambda r: (r["tenant"], r["seq"])):
        store = stores.setdefault(row["tenant"], {"docs": {}, "fences": {}, "keys": {}})
        key = row["idempotency_key"]
        if key in store["keys"]:
            out[row["seq"]] = "replayed" if store["keys"][key] == row["hash"] else "conflict"
            continue
        trial, ok = copy.deepcopy(store), True
        for m in row["mutations"]:
            doc = trial["docs"].get((m["document_type"], m["id"]))
            ok &= not (m["must_not_exist"] and doc) and not (m["must_exist"] and not doc)
            ok &= m["expected_revision"] is None or doc is not None and doc[0] == m["expected_revision"]
            ok &= m["operation"] == "upsert" or doc is not None and not doc[1]
            trial["docs"][m["document_type"], m["id"]] = ((doc[0] if doc else 0) + 1, m["operation"] == "delete")
        for f in row["fences"]:
            name, owner = (f["name"], f["value"]), (f["owner_type"], f["owner_id"])
            held = trial["fences"].get(name)
            if f["operation"] == "claim":
                ok &= held in (None, owner)
                trial["fences"][name] = owner
            else:
                ok &= held == owner
                trial["fences"].pop(name, None)
        if ok:
            trial["keys"][key] = row["hash"]
            stores[row["tenant"]] = trial
        out[row["seq"]] = "committed" if ok else "conflict"
    return stores, out


def test_commits_like_a_store_that_copies(spark):
    rng = random.Random(7)
    rows = []
    for seq in range(1200):
        mutations = [{"operation": rng.choice(["upsert", "upsert", "delete"]), "document_type": "d", "id": str(rng.randrange(9)), "data": str(seq), "indexes": {"k": "v"}, "expected_revision": rng.choice([None, None, None, rng.randrange(9)]), "must_exist": rng.random() < 0.1, "must_not_exist": rng.random() < 0.1} for _ in range(rng.randint(1, 3))]
        fences = [{"operation": rng.choice(["claim", "release"]), "name": "n", "value": str(rng.randrange(4)), "owner_type": "o", "owner_id": str(rng.randrange(3))} for _ in range(rng.choice([0, 0, 1, 2]))]
        rows.append({"tenant": rng.choice("ab"), "seq": seq, "idempotency_key": str(rng.randrange(900)), "hash": rng.choice("xy"), "mutations": mutations, "fences": fences, "outbox": [{"topic": "t", "key": "k", "payload": "p", "max_attempts": 2}]})
    schema = f"tenant string, seq bigint, idempotency_key string, hash string, mutations {canonical.MUTATIONS}, fences {canonical.FENCES}, outbox {canonical.EVENTS}"
    committed = canonical.commit(spark.createDataFrame(rows, schema).repartition(5)).cache()
    stores, want = judged(rows)
    assert {r.seq: r.status for r in committed.collect()} == want and set(want.values()) == {"committed", "replayed", "conflict"}
    heads = {(r.tenant, r.document_type, r.id): (r.revision, r.deleted) for r in canonical.heads(canonical.committed_revisions(committed)).collect()}
    assert heads == {(t, *k): v for t, s in stores.items() for k, v in s["docs"].items()}
    fences = {(r.tenant, r.name, r.value): (r.owner_type, r.owner_id) for r in canonical.committed_fences(committed).collect()}
    assert fences == {(t, *k): v for t, s in stores.items() for k, v in s["fences"].items()}
    assert canonical.committed_outbox(committed).select("event_id").distinct().count() == list(want.values()).count("committed")


def test_transactions_beyond_the_limits(spark):
    one = {"operation": "upsert", "document_type": "d", "id": "1", "data": "x" * 10, "indexes": {}, "expected_revision": None, "must_exist": False, "must_not_exist": False}
    rows = [("t", 1, "a", "h", [one] * 101, [], []), ("t", 2, "b", "h", [{**one, "data": "é" * 600_000}], [], []), ("t", 3, "c", "h", [one], None, None)]
    schema = f"tenant string, seq bigint, idempotency_key string, hash string, mutations {canonical.MUTATIONS}, fences {canonical.FENCES}, outbox {canonical.EVENTS}"
    assert [(r.status, r.reason) for r in canonical.commit(spark.createDataFrame(rows, schema)).orderBy("seq").collect()] == [("invalid", "limits"), ("invalid", "limits"), ("committed", None)]


def test_refused_deletes_make_no_revisions(spark):
    rows = [("t", "d", "1", k, op, str(k), {}) for k, op in enumerate(["upsert", "delete", "delete", "upsert"])] + [("t", "d", "2", 9, "delete", None, {})]
    data = spark.createDataFrame(rows, "tenant string, document_type string, id string, seq int, operation string, data string, indexes map<string,string>")
    assert [(r.revision, r.conflict) for r in canonical.revisions(data).filter("id = '1'").orderBy("seq").collect()] == [(1, False), (2, False), (None, True), (3, False)]
    assert [(r.id, r.revision, r.deleted, r.data) for r in canonical.current(data).collect()] == [("1", 3, False, "3")]


def test_a_refused_claim_changes_nothing(spark):
    rows = [(1, "claim", "A"), (2, "claim", "B"), (3, "release", "A"), (4, "release", "A"), (5, "claim", "B"), (6, "claim", "B"), (7, "release", "A")]
    data = spark.createDataFrame([("t", "n", "v", *r) for r in rows], "tenant string, name string, value string, seq int, operation string, owner string")
    assert [r.status for r in canonical.fences(data).orderBy("seq").collect()] == ["claimed", "held", "released", "not_owner", "claimed", "claimed", "not_owner"]


def test_restore_refuses_a_changed_archive(spark, tmp_path):
    docs = spark.createDataFrame([("a", "1", {"k": "v"}), ("b", "2", {"k": "w"})], "tenant string, id string, indexes map<string,string>")
    path = f"file://{tmp_path}/archive"
    canonical.export({"docs": docs}, "a", path)
    assert {r.id for r in canonical.restore({"docs": docs.limit(0)}, path)["docs"].collect()} == {"1"}
    docs.filter("tenant = 'a'").withColumn("id", F.lit("9")).write.mode("overwrite").parquet(f"{path}/docs")
    with pytest.raises(ValueError, match="manifest"):
        canonical.restore({"docs": docs}, path)


def test_waits_in_turn(spark):
    at = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(hours=n)
    rows = [
        (1, 1, at(1), "raise", None, "go", None, 11),  # kept, as nothing waits
        (1, 2, at(2), "wait", "external_event", "go", None, None),  # takes it
        (1, 3, at(3), "wait", "external_event", "go", at(5), None),  # suspended
        (1, 4, at(4), "raise", None, "other", None, 12),  # kept
        (1, 5, at(6), "raise", None, "go", None, 13),  # too late: the wait has timed out, the event is kept
        (1, 6, at(7), "wait", "external_event", "go", None, None),  # finds the time-out first
        (1, 7, at(8), "wait", "external_event", "go", None, None),  # then the event
        (2, 1, at(1), "wait", "timer", "t", at(1), None),  # the time has come
        (2, 2, at(2), "wait", "external_event", "go", None, None),  # suspended
        (2, 3, at(3), "raise", None, "go", None, 21),  # resumes it
        (2, 4, at(4), "wait", "external_event", "go", None, None),  # finds the outcome
    ]
    data = spark.createDataFrame(rows, "run_id int, seq int, at timestamp_ntz, operation string, kind string, name string, fire_at timestamp_ntz, event_id int")
    found = [(r.outcome, r.consumed) for r in runs.waited(data).orderBy("run_id", "seq").collect()]
    assert found == [("kept", None), ("external_event", 11), ("suspended", None), ("kept", None), ("kept", None), ("timed_out", None), ("external_event", 13), ("timer", None), ("suspended", None), ("resumed", 21), ("external_event", 21)]


def test_claims_without_a_key_stand_alone(spark):
    rows = [(1, "running", None, 0, 99), (2, "queued", None, 1, 99), (3, "queued", "", 1, 99), (4, "running", "k", 0, 5), (5, "queued", "k", 0, 99), (6, "running", "m", 0, 5), (7, "running", "m", 1, 5), (8, "queued", "n", 2, 9), (9, "queued", "n", 1, 9)]
    data = spark.createDataFrame([(*r, 0) for r in rows], "run_id int, status string, concurrency_key string, created_at int, lease_until int, attempt int")
    assert sorted(r.run_id for r in runs.claims(data, F.lit(10)).collect()) == [2, 3, 4, 9]


def test_keys_of_refused_requests_stay_free(spark):
    rows = [(1, "a", "x"), (2, "b", "x"), (3, "c", "x"), (4, "a", "y"), (5, "c", "x"), (6, None, "x")]
    data = spark.createDataFrame(rows, "seq int, idempotency_key string, hash string")
    assert [r.status for r in runs.admit(data, 1, 3).orderBy("seq").collect()] == ["admitted", "admitted", "queue_full", "conflict", "queue_full", "queue_full"]
    assert {r.status for r in runs.admit(data, 9, 3).collect()} == {"queue_full"}


def test_a_stream_keeps_state_between_batches(spark, tmp_path):
    from quillstone.streaming import events as streams

    rng = random.Random(3)
    rows = [(rng.choice("abc"), k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=k), rng.choice(["acquire", "acquire", "release"]), rng.choice("xy"), 300.0) for k in range(300)]
    schema = "lease_key string, seq int, at timestamp_ntz, operation string, owner string, ttl_seconds double"
    for n in range(3):
        spark.createDataFrame(rows[100 * n : 100 * n + 100], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    stream = streams.read_events(spark, f"file://{tmp_path}/in", files_per_trigger=1)
    found = {r.seq: (r.answer, r.lease_until) for r in streams.drained(runs.ttl_leases(stream), f"file://{tmp_path}/out").collect()}
    batch = {r.seq: (r.answer, r.lease_until) for r in runs.ttl_leases(spark.createDataFrame(rows, schema)).collect()}
    held, want = {}, {}
    for key, seq, at, operation, owner, _ in rows:
        now = held.get(key)
        if operation == "release":
            want[seq] = ("released" if now and now[0] == owner else "not_owner", None)
            if want[seq][0] == "released":
                del held[key]
        elif now and now[1] > at and now[0] != owner:
            want[seq] = ("refused", None)
        else:
            held[key] = (owner, at + dt.timedelta(minutes=5))
            want[seq] = ("acquired", held[key][1])
    assert batch == want and found == want and {a for a, _ in want.values()} == {"acquired", "refused", "released", "not_owner"}


def test_commits_that_do_not_touch_each_other_are_apart(spark):
    """One tenant's transactions fall into groups by what they share, over a long chain of others too, and are answered as one after another."""
    rows = []
    for seq in range(60):
        # a chain over documents, a pair by a fence, a pair by a key, and single ones
        docs = [str(seq), str(seq + 1)] if seq < 30 else [f"own-{seq}"]
        mutations = [{"operation": "upsert", "document_type": "d", "id": d, "data": "x", "indexes": {}, "expected_revision": None, "must_exist": False, "must_not_exist": False} for d in docs]
        fences = [{"operation": "claim", "name": "n", "value": None, "owner_type": "o", "owner_id": str(seq)}] if seq in (40, 41) else None
        rows.append({"tenant": "t", "seq": seq, "idempotency_key": "same" if seq in (50, 51) else str(seq), "hash": "h", "mutations": mutations, "fences": fences, "outbox": [{"topic": " t ", "key": "k", "payload": "p", "max_attempts": 2, "id": " own " if seq == 59 else None, "headers": {"a": "b"}, "not_before": dt.datetime(2024, 1, 1)}]})
    schema = f"tenant string, seq bigint, idempotency_key string, hash string, mutations {canonical.MUTATIONS}, fences {canonical.FENCES}, outbox {canonical.EVENTS}"
    data = spark.createDataFrame(rows, schema).repartition(3)
    groups = {r.seq: r.part_ for r in canonical.together(data).collect()}
    assert {groups[k] for k in range(30)} == {0} and groups[41] == groups[40] == 40 and groups[51] == groups[50] == 50
    assert all(groups[k] == k for k in range(30, 60) if k not in (41, 51)) and len(groups) == 60
    committed = canonical.commit(data)
    found = {r.seq: (r.status, r.reason) for r in committed.collect()}
    assert found[41] == ("conflict", "fence_held") and found[51][0] == "replayed" and all(s == "committed" for k, (s, _) in found.items() if k not in (41, 51))
    assert committed.columns == [*data.columns, "status", "reason", "documents"]
    out = {r.event_id: r for r in canonical.committed_outbox(committed).collect()}
    assert len(out) == 58 and out["own"].topic == "t" and out["own"].headers == {"a": "b"} and out["own"].not_before == dt.datetime(2024, 1, 1)


def test_ties_that_many_transactions_make_are_one(spark, monkeypatch):
    """What is linked grows with distinct documents, fences and keys, not with transactions; a tenant that is null is one as well."""
    one = lambda k: {"operation": "upsert", "document_type": "d", "id": str(k % 3), "data": "x", "indexes": {}, "expected_revision": None, "must_exist": False, "must_not_exist": False}
    rows = [(None if k % 2 else "t", k, str(k % 4), "h", [one(k)], None, None) for k in range(240)]
    schema = f"tenant string, seq bigint, idempotency_key string, hash string, mutations {canonical.MUTATIONS}, fences {canonical.FENCES}, outbox {canonical.EVENTS}"
    made, plain = [], canonical.components
    monkeypatch.setattr(canonical, "components", lambda links, *more: made.append(links.count()) or plain(links, *more))
    committed = canonical.commit(spark.createDataFrame(rows, schema)).collect()
    assert made == [12] and len(committed) == 240
    assert {r.seq: r.status for r in committed} == {k: "committed" if k < 4 else "replayed" for k in range(240)}


def test_judging_reads_no_bodies():
    """Of a batch only what decides becomes Python values; lists that are null are empty."""
    import pyarrow as pa

    mutation = {"operation": "upsert", "document_type": "d", "id": "1", "data": "body", "indexes": None, "expected_revision": None, "must_exist": True, "must_not_exist": False}
    fence = {"operation": "claim", "name": "n", "value": None, "owner_type": "o", "owner_id": "1"}
    batch = pa.RecordBatch.from_pydict({"large": [False, True, False], "idempotency_key": ["a", "b", None], "hash": ["h", "h", "h"], "mutations": [[mutation], None, [mutation, mutation]], "fences": [None, [fence], []]})
    own = ("upsert", "d", "1", None, True, False)
    assert [(r["mutations"], r["fences"]) for r in canonical._read("large")(batch)] == [([own], []), ([], [("claim", "n", None, "o", "1")]), ([own, own], [])]
