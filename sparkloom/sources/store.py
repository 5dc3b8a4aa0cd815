"""Tables with versions in a folder that all executors share.

A table is cut into buckets by the hash of a key. A transaction writes whole new contents of some buckets into a folder of its own and then commits
a manifest that says which folder each bucket is read from; buckets it didn't write stay where they are. So a commit is one renamed file, readers never
see half of it, earlier snapshots stay readable, and a transaction that was lost leaves files that no manifest names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Someone else has committed since this transaction began."""


class VersionedTables:
    """The tables below root. buckets is fixed with the first commit; a manifest has a number for each table and bucket, so it stays small whatever the data."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        head = self.manifest()
        self.buckets = head["buckets"] if head else buckets

    def _path(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def snapshots(self) -> list[int]:
        fs, path = self._path("manifests")
        names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, snapshot: int | None = None) -> dict | None:
        known = self.snapshots()
        if snapshot is None:
            if not known:
                return None
            snapshot = known[-1]
        elif snapshot not in known:
            raise ValueError(f"no snapshot {snapshot}")
        fs, path = self._path("manifests", f"{snapshot}.json")
        stream = fs.open(path)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def meta(self, snapshot: int | None = None) -> dict:
        found = self.manifest(snapshot)
        return found["meta"] if found else {}

    def bucket_of(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self, name: str, snapshot: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """A table as of a snapshot (the last one, if none is named), or only some buckets of it; None where there is no such table."""
        found = self.manifest(snapshot)
        return self._read(found, name, buckets) if found else None

    def _read(self, manifest: dict, name: str, buckets: list[int] | None) -> DataFrame | None:
        if name not in manifest["tables"]:
            return None
        table = manifest["tables"][name]
        schema = StructType.fromJson(table["schema"])
        wanted = [f"{self.root}/data/{name}/{at}/bucket={b}" for b, at in table["buckets"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], schema)

    def begin(self) -> Transaction:
        return Transaction(self)

    def expire(self, keep: int = 2) -> int:
        """Forget all but the last snapshots, and remove the folders that only they named; how many snapshots went."""
        known = self.snapshots()
        kept = [self.manifest(s) for s in known[-keep:]]
        used = {(name, at) for m in kept for name, t in m["tables"].items() for at in t["buckets"].values()}
        gone = {(name, at) for s in known[:-keep] for name, t in self.manifest(s)["tables"].items() for at in t["buckets"].values()} - used
        for s in known[:-keep]:
            fs, path = self._path("manifests", f"{s}.json")
            fs.delete(path, False)
        for name, at in gone:
            fs, path = self._path("data", name, at)
            fs.delete(path, True)
        return len(known[:-keep])


class Transaction:
    """Writes that become visible together with commit(); read() sees them already."""

    def __init__(self, store: VersionedTables):
        self.store = store
        head = store.manifest()
        self.number = head["snapshot"] + 1 if head else 0
        self.folder = f"{self.number}-{uuid.uuid4().hex[:12]}"
        self.pending = {"snapshot": self.number, "buckets": store.buckets, "tables": dict(head["tables"]) if head else {}, "meta": {}}

    def write(self, name: str, rows: DataFrame, key: str, buckets: list[int] | None = None) -> None:
        """rows become the whole content of the named buckets (of all, if none are named). Spark splits a bucket that has most rows over several files."""
        fs, path = self.store._path("data", name, self.folder)
        dealt = rows.withColumn("bucket", self.store.bucket_of(key)).hint("rebalance", "bucket")
        dealt.write.partitionBy("bucket").parquet(path.toString())
        written = {x.getPath().getName().removeprefix("bucket=") for x in fs.listStatus(path) if x.getPath().getName().startswith("bucket=")}
        old = self.pending["tables"].get(name, {"buckets": {}})["buckets"]
        stays = {} if buckets is None else {b: at for b, at in old.items() if int(b) not in buckets}
        if buckets is not None and not {int(b) for b in written} <= set(buckets):
            raise ValueError("rows of buckets that were not named")
        self.pending["tables"][name] = {"schema": rows.schema.jsonValue(), "buckets": stays | {b: self.folder for b in written}}

    def read(self, name: str, buckets: list[int] | None = None) -> DataFrame | None:
        return self.store._read(self.pending, name, buckets)

    def commit(self, **meta) -> int:
        """The new snapshot's number; Conflict if there is one of that number already."""
        self.pending["meta"] = meta
        fs, draft = self.store._path("manifests", f".{self.folder}.draft")
        stream = fs.create(draft, False)
        try:
            stream.write(bytearray(json.dumps(self.pending).encode()))
        finally:
            stream.close()
        _, final = self.store._path("manifests", f"{self.number}.json")
        if fs.exists(final) or not fs.rename(draft, final):
            fs.delete(draft, False)
            raise Conflict(f"snapshot {self.number} is there already")
        return self.number
