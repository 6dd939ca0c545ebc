"""The key-value contract, against a dictionary that replays the log."""

import random

import pytest

from tidelog.operators import keyvalue as kv
from tidelog.operators import runs
from tidelog.sources import store
from tidelog.streaming.upserts import latest_stream


def replay(ops):
    state, found = {}, []
    for seq, key, op, value in ops:
        if op == "put":
            state[key] = value
            found.append((seq, None, None))
        elif op == "get":
            found.append((seq, key in state, state.get(key, "")))
        else:
            found.append((seq, key in state, None))
            state.pop(key, None)
    return state, found


@pytest.fixture(scope="module")
def ops():
    rng = random.Random(5)
    return [(s, 1 if rng.random() < 0.4 else rng.randrange(12), rng.choice(["put", "get", "del"]), f"v{s}") for s in range(600)]


@pytest.fixture(scope="module")
def log(spark, ops):
    return spark.createDataFrame(ops, "seq long, key long, op string, value string")


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_operation_results(log, ops, block, monkeypatch):
    monkeypatch.setattr(kv.with_previous, "__defaults__", (block, None))
    rows = {r.seq: (r.found, r.result) for r in kv.op_results(log).collect()}
    assert rows == {s: (f, v) for s, f, v in replay(ops)[1]}


def test_snapshot_scan_and_batch_get(spark, log, ops):
    state, _ = replay(ops)
    assert {r.key: r.value for r in kv.snapshot(log).collect()} == state
    assert [(r.key, r.value) for r in kv.range_scan(log, 2, 8).collect()] == sorted((k, v) for k, v in state.items() if 2 <= k <= 8)
    probes = spark.createDataFrame([(k,) for k in range(20)], "key long")
    assert {r.key: r.value for r in kv.batch_get(log, probes).collect()} == {k: state.get(k, "") for k in range(20)}
    bounds = {r.key: r.bound for r in kv.lower_bounds(log, probes, 3).collect()}
    assert bounds == {k: min((x for x in state if k <= x <= k + 3), default=None) for k in range(20)}


def test_delete_evens_then_the_rest(spark):
    n = 64
    ops = [(k, k, "put", "s" * (k + 1)) for k in range(n)]
    ops += [(n + k, k, "del", None) for k in range(0, n, 2)]
    ops += [(2 * n + k, k, "get", None) for k in range(n)]
    ops += [(3 * n + k, k, "del", None) for k in range(1, n)]
    log = spark.createDataFrame(ops, "seq long, key long, op string, value string")
    rows = {r.seq: r for r in kv.op_results(log).collect()}
    assert all(rows[n + k].found for k in range(0, n, 2))
    assert all(rows[2 * n + k].result == ("s" * (k + 1) if k % 2 else "") for k in range(n))
    assert all(rows[3 * n + k].found == bool(k % 2) for k in range(1, n))


def test_store_survives_a_restart(spark, tmp_path):
    n, root = 40, str(tmp_path / "store")
    ops = [(k, k, "put", "s" * (k + 1)) for k in range(n)] + [(n + k, k, "del", None) for k in range(0, n, 2)]
    ops += [(2 * n + k, k, "put", "t" * (k + 1)) for k in range(n) if k % 4 < 2]
    for part in (ops[:50], ops[50:]):
        store.append(spark.createDataFrame(part, "seq long, key long, op string, value string"), root)
    store.compact(spark, root, str(tmp_path / "next"), 1)
    for path in (root, str(tmp_path / "next")):
        got = {r.key: r.value for r in kv.snapshot(store.reopen(spark, path)).collect()}
        assert got == {k: ("t" if k % 4 < 2 else "s") * (k + 1) for k in range(n) if k % 4 != 2}


def test_stream_agrees_with_the_batch(spark, log, tmp_path):
    log.write.parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    q = latest_stream(stream).writeStream.outputMode("complete").format("memory").queryName("newest").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(spark.table("newest").collect()) == sorted(kv.latest(log).select("key", "seq", "op", "value").collect())


def test_empty_log(spark):
    empty = spark.createDataFrame([], "seq long, key long, op string, value string")
    assert kv.snapshot(empty).count() == 0
    assert kv.op_results(empty).count() == 0
    assert runs.merged(empty.withColumn("ts", empty.seq)).count() == 0
