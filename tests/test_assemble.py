"""Traces assembled from spans that arrive in any order, late and twice."""

import pytest
from pyspark.sql import functions as F

from spanloom.streaming import assemble

SECOND = 1_000_000_000
SCHEMA = "trace_id string, span_id string, parent_span_id string, name string, start_ns long, end_ns long"


def test_depths():
    assert assemble.depths({"a": None, "b": "a", "c": "b", "d": "gone", "e": "d"}) == {"a": 0, "b": 1, "c": 2, "d": 0, "e": 1}
    assert set(assemble.depths({"x": "y", "y": "x"})) == {"x", "y"}


@pytest.fixture()
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set(key, before)


def test_late_children_join_their_parents(rocks, tmp_path):
    spark = rocks
    landing, out, progress = (str(tmp_path / x) for x in ("in", "out", "progress"))

    def arrive(*rows):
        spark.createDataFrame([(t, s, p, n, at * SECOND, (at + 1) * SECOND) for t, s, p, n, at in rows], SCHEMA).coalesce(1).write.mode("append").json(landing)

    def take_in():
        spans = spark.readStream.schema(SCHEMA).json(landing).withColumn("start_time", F.timestamp_millis(F.floor(F.col("start_ns") / 1_000_000)))
        whole = assemble.assemble_traces(spans, "10 minutes", quiet_s=60)
        query = whole.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start()
        query.awaitTermination()
        return {(r["trace_id"], r["span_id"]): (r["parent_known"], r["depth"], r["n_spans"]) for r in spark.read.schema(assemble.OUT).parquet(out).collect()} if query else {}

    arrive(("t", "c", "b", "grandchild", 1005), ("t", "a", None, "root", 1000))
    take_in()
    arrive(("t", "b", "a", "child", 1002), ("t", "a", None, "root", 1000))  # the missing link, and a repeat, after a restart
    take_in()
    arrive(("u", "z", None, "other", 2000))  # time goes on
    take_in()
    arrive(("u", "y", "z", "other child", 2001), ("t", "b", "a", "child", 2001))  # the first trace's span once more
    found = take_in()
    assert {k: v for k, v in found.items() if k[0] == "t"} == {("t", "a"): (False, 0, 3), ("t", "b"): (True, 1, 3), ("t", "c"): (True, 2, 3)}
    assert spark.read.parquet(out).where("trace_id = 't'").count() == 3


class Handle:
    """A state store that counts the calls to it."""

    def __init__(self):
        self.calls, self.held, self.timers = 0, {}, []

    def _state(self, name, *_):
        store = self

        class State:
            def exists(self):
                store.calls += 1
                return name in store.held

            def get(self):
                store.calls += 1
                return store.held.get(name)

            def update(self, value):
                store.calls += 1
                store.held[name] = value

            def clear(self):
                store.calls += 1
                store.held.pop(name, None)

            def appendValue(self, value):
                store.calls += 1
                store.held.setdefault(name, []).append(value)

            def containsKey(self, key):
                store.calls += 1
                return key in store.held.get(name, {})

            def updateValue(self, key, value):
                store.calls += 1
                store.held.setdefault(name, {})[key] = value

        return State()

    getListState = getValueState = getMapState = _state

    def listTimers(self):
        self.calls += 1
        return iter(self.timers)

    def registerTimer(self, at):
        self.calls += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.calls += 1
        self.timers.remove(at)


class Times:
    def __init__(self, now):
        self.now = now

    def getCurrentWatermarkInMs(self):
        return self.now


def test_calls_to_the_store_do_not_grow_with_the_spans_of_a_batch():
    import pandas as pd

    handle, processor = Handle(), assemble.TraceAssembler(60_000, 3_600_000)
    processor.init(handle)
    rows = [("t", f"s{i % 300}", f"s{i % 300 - 1}" if i % 300 else None, "n", i % 300 * SECOND, (i % 300 + 1) * SECOND) for i in range(600)]
    columns = ["trace_id", "span_id", "parent_span_id", "name", "start_ns", "end_ns"]
    for part in (rows[:500], rows[500:]):
        list(processor.handleInputRows(("t",), iter([pd.DataFrame(part, columns=columns)]), Times(0)))
    assert handle.calls < 20
    out = pd.concat(processor.handleExpiredTimer(("t",), Times(400_000), None))
    assert len(out) == 300 and set(out["n_spans"]) == {300} and out["depth"].max() == 299 and handle.calls < 20
    assert not list(processor.handleInputRows(("t",), iter([pd.DataFrame(rows, columns=columns)]), Times(400_000)))  # repeats
