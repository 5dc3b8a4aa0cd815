"""The index build: an incremental build equals a full one, reads only what changed, and leaves old snapshots readable."""

import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.plans import index_build as I
from sparkloom.sources.store import Conflict, VersionedTables

TABLES = ("files", "symbols", "imports", "routes", "frameworks", "edges")
SCHEMA = "path string, hash string, size long, mtime long, text string, more int"


def content(store, name, snapshot=None):
    df = store.read(name, snapshot)
    return sorted(map(str, df.select(sorted(df.columns)).collect()))


def code(k, v=0):
    return f"import {{ a }} from './m{k + 1}'\nexport function f{k}_{v}() {{}}\napp.get('/r{k}', h)\nconst e = require('express')\n"


def frame(spark, state):
    return I.Frame(spark.createDataFrame([(p, f"h{hash(t)}", len(t), 5, t, 1) for p, t in state.items()], SCHEMA))


def test_incremental_equals_full(spark, tmp_path):
    state = {f"src/m{k}.ts": code(k) for k in range(60)} | {"lib/a.py": "import os\nclass A:\n", "readme.md": "# no adapter", "x.go": ""}
    store = VersionedTables(spark, str(tmp_path / "one"), 8)
    first = I.build(store, frame(spark, state))
    assert (first["scanned"], first["indexed"], first["skipped"], first["removed"], first["snapshot"]) == (62, 62, 0, 0, 0)
    assert first["languages"] == {"typescript": 60, "python": 1, "go": 1}
    before = {t: content(store, t) for t in TABLES}
    state["src/m7.ts"], state["src/new.ts"] = code(7, 9), code(99)
    del state["src/m12.ts"], state["lib/a.py"]
    # what hasn't changed can't be read: its text is an error
    rows = frame(spark, state).files
    guarded = rows.where("path in ('src/m7.ts', 'src/new.ts')").unionByName(rows.where("path not in ('src/m7.ts', 'src/new.ts')").withColumn("text", F.lit("class Wrong {")))
    second = I.build(store, I.Frame(guarded))
    assert (second["scanned"], second["indexed"], second["skipped"], second["removed"], second["languages"]) == (61, 2, 59, 2, {"typescript": 2})
    full = VersionedTables(spark, str(tmp_path / "two"), 8)
    I.build(full, frame(spark, state))
    for t in TABLES:
        assert content(store, t) == content(full, t), t
        assert content(store, t, 0) == before[t]
    assert I.build(store, frame(spark, state)).get("snapshot") is None and store.snapshots() == [0, 1]
    again = I.build(store, frame(spark, state), incremental=False)
    assert again["indexed"] == 61 and content(store, "symbols") == content(full, "symbols")
    assert store.expire(1) == 2 and store.snapshots() == [2] and content(store, "edges") == content(full, "edges")
    with pytest.raises(ValueError):
        store.read("files", 0)


def test_only_changed_buckets_are_written(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"), 32)
    state = {f"m{k}.ts": code(k) for k in range(100)}
    I.build(store, frame(spark, state), graph=False)
    state["m3.ts"] = code(3, 1)
    I.build(store, frame(spark, state), graph=False)
    was, now = store.manifest(0)["tables"]["symbols"]["buckets"], store.manifest(1)["tables"]["symbols"]["buckets"]
    assert sum(was[b] != now[b] for b in now) == 1 and was.keys() == now.keys()


def test_tree_opens_only_changed_files(spark, tmp_path, monkeypatch):
    tree = tmp_path / "tree"
    tree.mkdir()
    for k in range(5):
        (tree / f"m{k}.ts").write_text(code(k))
    (tree / "n.md").write_text("no")
    source = I.Tree(spark, str(tree))
    store = VersionedTables(spark, str(tmp_path / "s"), 4)
    assert I.build(store, source)["indexed"] == 5
    time.sleep(0.02)
    (tree / "m1.ts").write_text(code(1, 77))
    os.utime(tree / "m2.ts")  # another mark, the same contents
    changed = spark.createDataFrame([("m1.ts", "x")], "path string, mark string")
    assert [os.path.basename(f) for f in source.contents(changed).inputFiles()] == ["m1.ts"]
    assert "content" not in source.marks()._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    run = I.build(store, source)
    assert (run["indexed"], run["skipped"]) == (1, 4)
    assert {r.name for r in store.read("symbols").where("file_path = 'm1.ts'").collect()} >= {"f1_77"}
    assert I.build(store, source)["indexed"] == 0 and len(store.snapshots()) == 2
    monkeypatch.setattr(I, "LISTED", 0)  # by a scan of the whole tree
    (tree / "m4.ts").unlink()
    (tree / "m0.ts").write_text(code(0, 55))
    run = I.build(store, source)
    assert (run["indexed"], run["removed"]) == (1, 1)


def test_a_second_writer_conflicts(spark, tmp_path):
    store = VersionedTables(spark, str(tmp_path / "s"), 4)
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "path string, n int")
    one, two = store.begin(), store.begin()
    for tx in (one, two):
        tx.write("t", rows, "path")
    assert one.read("t").count() == 2 and store.read("t") is None
    assert one.commit(note="x") == 0 and store.meta() == {"note": "x"}
    with pytest.raises(Conflict):
        two.commit()
    tx = store.begin()
    bucket = rows.where("path = 'a'").select(store.bucket_of("path")).first()[0]
    tx.write("t", rows.limit(0), "path", [bucket])
    tx.commit()
    assert [r.path for r in store.read("t").collect()] in ([], ["b"]) and store.read("t", 0).count() == 2


def test_what_grows_is_not_broadcast(spark, tmp_path, monkeypatch):
    from sparkloom.functions import code as E
    from sparkloom.operators import graph as G
    from sparkloom.sources.store import Transaction

    plans, staged, write = [], G.staged, Transaction.write
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString())
    for module in (I, E):
        monkeypatch.setattr(module, "staged", lambda df: (seen(df), staged(df))[1])
    monkeypatch.setattr(Transaction, "write", lambda self, name, rows, *more: (seen(rows), write(self, name, rows, *more))[1])
    state = {f"src/m{k}.ts": code(k) for k in range(20)}
    store = VersionedTables(spark, str(tmp_path / "s"), 4)
    I.build(store, frame(spark, state))
    state["src/m7.ts"], state["src/new.ts"] = code(7, 9), code(99)
    I.build(store, frame(spark, state))
    assert len(plans) > 20 and any("SortMergeJoin" in p for p in plans)
    joins = [line for p in plans for line in p.splitlines() if "BroadcastHashJoin" in line]
    assert joins and all(" [ext#" in line for line in joins)  # the 11 adapters
