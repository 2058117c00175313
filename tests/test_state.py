"""Keyed streaming state: replayed, late and repeated events give the batch answer; cache entries expire."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quarry.streaming import state

START = dt.datetime(2024, 1, 1)


def stream(spark, tmp_path, batches, schema):
    """A stream that gets one file a trigger, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i:03d}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")


def drained(df, mode, path):
    out = []
    q = df.writeStream.outputMode(mode).option("checkpointLocation", path).foreachBatch(lambda b, i: out.append(b.collect())).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return out


def test_versions_in_any_order_give_the_batch_answer(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = random.Random(3)
    rows = [(f"v{rng.randrange(12)}", START + dt.timedelta(seconds=rng.randrange(20_000)), rng.choice(["queued", "started", "started", "ready", "failed"])) for _ in range(90)]
    rows += [("tie", START, "started"), ("tie", START, "ready"), ("open", START + dt.timedelta(seconds=19_990), "started"), ("gone", START, "started"), (None, START, "ready"), ("odd", None, "ready"), ("odd", START, "what")]
    schema = "key string, ts timestamp, status string"
    want = {tuple(r) for r in state.version_states_batch(spark.createDataFrame(rows, schema), 600).collect()}
    assert {("tie", "ready", START), ("gone", "timed_out", START), ("open", "started", START + dt.timedelta(seconds=19_990))} <= want
    replay = rows + rng.sample(rows, 30)
    rng.shuffle(replay)
    batches = [replay[i::4] for i in range(4)]
    last = {}
    for batch in drained(state.version_states(stream(spark, tmp_path, batches, schema), 600, "1 day"), "update", f"{tmp_path}/c"):
        last |= {r["key"]: tuple(r) for r in batch}
    # a watermark a day behind never times out, so only the time-outs differ
    assert {(k, "started" if s == "timed_out" else s, t) for k, s, t in want} == set(last.values())
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_versions_in_order_time_out(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[("a", at(0), "started"), ("b", at(5), "started")], [("b", at(50), "ready"), ("c", at(60), "queued")], [("c", at(500), "started")], [("d", at(2000), "queued")], [("d", at(2050), "queued")], [("c", at(2100), "ready"), ("e", at(2100), "started")]]
    schema = "key string, ts timestamp, status string"
    steps = drained(state.version_states(stream(spark, tmp_path, batches, schema), 100), "update", f"{tmp_path}/c")
    seen = [(r["key"], r["status"]) for batch in steps for r in sorted(batch, key=str)]
    assert ("a", "timed_out") in seen and ("c", "timed_out") in seen and ("b", "timed_out") not in seen and seen.index(("c", "timed_out")) < seen.index(("c", "ready"))
    last = {k: s for k, s in seen}
    rows = [r for b in batches for r in b]
    assert last == {r["key"]: r["status"] for r in state.version_states_batch(spark.createDataFrame(rows, schema), 100).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cache_entries_expire(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    at = lambda s: START + dt.timedelta(seconds=s)
    batches = [[("k", at(0), "one"), ("k", at(10), None), ("m", at(3), None)], [("k", at(59), None), ("k", at(60), None), ("k", at(61), "two")], [("k", at(70), None), ("k", at(65), "three"), ("n", at(500), "x")], [("k", at(501), None), ("n", at(502), None), (None, at(1), None)]]
    steps = drained(state.cached_lookups(stream(spark, tmp_path, batches, "key string, ts timestamp, value string"), 60), "append", f"{tmp_path}/c")
    got = sorted(((r["ts"] - START).seconds, r["key"], r["value"]) for b in steps for r in b)
    assert got == [(3, "m", None), (10, "k", "one"), (59, "k", "one"), (60, "k", None), (70, "k", "three"), (501, "k", None), (502, "n", "x")]
    assert all((r["value"] is not None) == r["hit"] for b in steps for r in b)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_batch_form_ignores_odd_rows(spark):
    none = spark.createDataFrame([(None, START, "ready"), ("a", None, "ready"), ("a", START, "?")], "key string, ts timestamp, status string")
    assert state.version_states_batch(none, 5).collect() == [] and state.version_states_batch(none.limit(0), 5).select(F.count("*")).first()[0] == 0
