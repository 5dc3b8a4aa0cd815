"""Debounced flushes against an event loop in plain Python, and the change feed over restarts."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.index_build import Tree
from sparkloom.sources.store import VersionedTables
from sparkloom.streaming import debounce, feed


def event_loop(events, hold):
    """Timers as a queue of calls, each with the number it was armed under; a call whose number is old does nothing."""
    queue, out, waiting, busy, started, armed = [], [], set(), False, None, {"quiet": 0, "limit": 0}
    for k, (ms, path, done) in enumerate(events):
        heapq.heappush(queue, (ms, 1, k, "event", (path, done)))
    while queue:
        now, _, _, kind, what = heapq.heappop(queue)
        if kind == "event":
            path, done = what
            busy = busy and not done
            if path is not None and not done:
                waiting.add(path)
            if waiting:
                if started is None:
                    started = now
                    armed["limit"] += 1
                    heapq.heappush(queue, (now + 2000, 0, 0, "limit", armed["limit"]))
                armed["quiet"] += 1
                heapq.heappush(queue, (now + min(400 + min(15 * len(waiting), 300), max(50, 2000 - (now - started))), 0, 0, "quiet", armed["quiet"]))
        elif what == armed[kind] and waiting and not busy:
            out.append((now, sorted(waiting)))
            waiting, started, busy = set(), None, hold
            armed = {k: v + 1 for k, v in armed.items()}
    return out


def made_events(r, hold):
    now, out = 0, []
    for _ in range(60):
        now += r.choice([1, 20, 100, 390, 405, 450, 800, 2500])
        out.append((now, None, True) if hold and r.random() < 0.2 else (now, r.choice("abcdefgh"), False))
    return out


@pytest.mark.parametrize("hold", [False, True])
def test_waiting_is_the_event_loop(hold):
    for seed in range(200):
        events = made_events(random.Random(seed), hold)
        w, got = debounce.Waiting([]), []
        for now, path, done in events:
            got += w.advance(now, hold)
            w.told(now, path, done)
        got += w.advance(10**9, hold)
        assert got == event_loop(events, hold), seed


def test_debounced_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    every = {s: made_events(random.Random(s), True) for s in (1, 2)}
    rows = [(str(s), ms, p, d) for s, events in every.items() for ms, p, d in events]
    end = max(r[1] for r in rows)
    kind = "source string, ts timestamp, path string, done boolean"
    for k, lo in enumerate(range(0, end + 1, end // 3 + 1)):
        part = [r for r in rows if lo <= r[1] < lo + end // 3 + 1]
        spark.createDataFrame(part, "source string, ms long, path string, done boolean").select("source", F.timestamp_millis("ms").alias("ts"), "path", "done").coalesce(1).write.parquet(f"{tmp_path}/in/part={k}")
    spark.createDataFrame([("late", 10**7, "x", False)], "source string, ms long, path string, done boolean").select("source", F.timestamp_millis("ms").alias("ts"), "path", "done").coalesce(1).write.parquet(f"{tmp_path}/in/part=9")
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    q = debounce.debounced_changes(stream, "1 hour", True).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.source, r.at, r.paths) for r in spark.read.parquet(f"{tmp_path}/out").where("source <> 'late'").collect())
    assert got == sorted((str(s), at, paths) for s, events in every.items() for at, paths in event_loop(events, True))


def test_feed_over_restarts(spark, tmp_path):
    spark.dataSource.register(feed.StoreFeed)
    tree = tmp_path / "tree"
    tree.mkdir()
    store = VersionedTables(spark, str(tmp_path / "store"), 4)
    source = Tree(spark, str(tree))

    def look(**texts):
        for name, text in texts.items():
            (tree / name).write_text(text) if text else (tree / name).unlink()
        return feed.record_marks(store, source.marks())

    def run():
        stream = spark.readStream.format("storefeed").options(root=f"file:{store.root}", table="tree", mark="mark").load()
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").option("path", f"{tmp_path}/out").start()
        q.processAllAvailable()
        q.stop()
        return sorted((r.snapshot, r.path, r.change) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert look(a="1", b="1", c="1") == 0
    want = [(0, x, "added") for x in "abc"]
    assert run() == want
    assert look() is None and run() == want
    assert look(a="22", b=None, d="1") == 1 and look(a="333") == 2 and look(b="back") == 3
    want += [(1, "a", "changed"), (1, "b", "removed"), (1, "d", "added"), (2, "a", "changed"), (3, "b", "added")]
    assert run() == want and run() == want
