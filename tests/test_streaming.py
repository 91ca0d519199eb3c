"""Monitors over streams, against the same rules over the finished log."""

import datetime as dt
import random

import pytest
from sparktrail.streaming import monitor


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, old)


SCHEMA = "user long, at timestamp, pos long, kind string"


def streamed(spark, tmp_path, batches, rule, **more):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{tmp_path}/b{k}")
    out = []
    (tmp_path / "in").mkdir()
    for k in range(len(batches)):  # a run a batch: each goes on from the state of the one before
        source = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in")
        for f in (tmp_path / f"b{k}").glob("*.json"):
            f.rename(tmp_path / "in" / f"{k}.json")
        found = monitor.timed_monitor(source, rule, "user", "at", "pos", "kind", **more)
        q = found.writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    return out


def test_event_time_late_and_expired(rocks, tmp_path):
    start = dt.datetime(2024, 1, 1)
    at = lambda minutes: start + dt.timedelta(minutes=minutes)
    rng = random.Random(3)
    rows = [(u, at(rng.randrange(40)), k, rng.choice(["a", "b", "c", None])) for k in range(120) for u in [rng.randrange(5)]]
    # out of order, but within the delay of ten minutes
    rows.sort(key=lambda r: r[1] + dt.timedelta(minutes=rng.uniform(0, 9)))
    late, none = [(0, at(1), 900, "b"), (1, at(2), 901, "b")], [(None, at(41), 0, "a"), (2, None, 1, "a")]
    batches = [rows[:60], rows[60:], [(99, at(70), 0, "a")], [*late, *none, (99, at(75), 1, "b")], [(99, at(300), 2, "c")], [(0, at(301), 0, "a"), (98, at(400), 0, "c")], [(97, at(500), 0, "c")]]
    rule = "G (a -> F b)"
    got = streamed(rocks, tmp_path, batches, rule, idle_ms=3_600_000)
    log = rocks.createDataFrame(rows, SCHEMA)
    want = {r.user: r.holds for r in monitor.offline(log, rule, "user", ["at", "pos"], "kind").collect()}
    first = {}
    for r in got:
        if r.final:
            first.setdefault(r.user, r)
    counts = {u: sum(r[0] == u for r in rows) for u in want}
    assert {u: first[u].holds for u in want} == want and {u: first[u].steps for u in want} == counts
    # a case that was forgotten starts anew
    again = [r for r in got if r.user == 0 and r.steps == 1]
    assert again and not again[-1].holds and [r.final for r in again] == [False, True]
    assert [(r.steps, r.final) for r in got if r.user == 99][-1] == (1, True)
