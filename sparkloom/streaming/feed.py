"""What has changed in a versioned table, as a stream: offsets are snapshot numbers, a partition is a bucket of a snapshot that another folder took over.

spark.dataSource.register(StoreFeed); spark.readStream.format("storefeed").option("root", ...).option("table", ...).option("key", "path").option("mark", "hash").load()

Nothing is kept in the source but the offsets that Spark writes to the query's checkpoint: after a restart it goes on from there, and a batch that is run
again reads the same immutable folders. The first batch tells every row as added, by way of all snapshots there are. A task holds one bucket's keys and
marks. Snapshots must not expire before they have been read. The store's folder is read by the tasks themselves, so it must be one they can open (a path or an
address that pyarrow knows).
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.store import VersionedTables


def opened(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root)


class BucketStep(InputPartition):
    def __init__(self, snapshot: int, before: str | None, after: str | None):
        self.snapshot, self.before, self.after = snapshot, before, after


class FeedReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.table = options["root"].rstrip("/"), options["table"]
        self.key, self.mark = options.get("key", "path"), options.get("mark", "hash")

    def initialOffset(self) -> dict:  # noqa: N802
        return {"snapshot": -1}

    def latestOffset(self) -> dict:  # noqa: N802
        files, root = opened(self.root)
        found = files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
        numbers = [int(x.base_name.removesuffix(".json")) for x in found if x.base_name.endswith(".json") and not x.base_name.startswith(".")]
        return {"snapshot": max(numbers, default=-1)}

    def _folders(self, snapshot: int) -> dict[str, str]:
        if snapshot < 0:
            return {}
        files, root = opened(self.root)
        with files.open_input_stream(f"{root}/manifests/{snapshot}.json") as f:
            tables = json.loads(f.read())["tables"]
        return {b: f"{root}/data/{self.table}/{at}/bucket={b}" for b, at in tables.get(self.table, {"buckets": {}})["buckets"].items()}

    def partitions(self, start: dict, end: dict) -> list[BucketStep]:
        out, before = [], self._folders(start["snapshot"])
        for snapshot in range(start["snapshot"] + 1, end["snapshot"] + 1):
            after = self._folders(snapshot)
            out += [BucketStep(snapshot, before.get(b), after.get(b)) for b in sorted(before.keys() | after.keys()) if before.get(b) != after.get(b)]
            before = after
        return out

    def _marks(self, folder: str | None) -> dict:
        if folder is None:
            return {}
        files, _ = opened(self.root)
        rows = ds.dataset(folder, filesystem=files, format="parquet", exclude_invalid_files=True).to_table([self.key, self.mark])
        return dict(zip(rows[self.key].to_pylist(), rows[self.mark].to_pylist()))

    def read(self, partition: BucketStep) -> Iterator[pa.RecordBatch]:
        was, now = self._marks(partition.before), self._marks(partition.after)
        rows = [(k, "added" if k not in was else "removed" if k not in now else "changed") for k in was.keys() | now.keys() if k not in was or k not in now or was[k] != now[k]]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string()), pa.array([partition.snapshot] * len(rows), pa.int64())], ["path", "change", "snapshot"])


class StoreFeed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "storefeed"

    def schema(self) -> str:
        return "path string, change string, snapshot long"

    def streamReader(self, schema) -> FeedReader:  # noqa: N802
        return FeedReader(dict(self.options))


def record_marks(store: VersionedTables, marks: DataFrame, table: str = "tree") -> int | None:
    """One look at a tree: its marks (path, mark) become a snapshot's table, of which only buckets with a change are written; None if there is no change."""
    tx = store.begin()
    known = tx.read(table)
    if known is None:
        tx.write(table, marks, "path")
        return tx.commit()
    both = marks.join(known.select("path", F.col("mark").alias("was")), "path", "full").where(~F.col("mark").eqNullSafe(F.col("was")))
    buckets = [r["b"] for r in both.select(store.bucket_of("path").alias("b")).distinct().collect()]  # store.buckets rows at most
    if not buckets:
        return None
    tx.write(table, marks.where(store.bucket_of("path").isin(buckets)), "path", buckets)
    return tx.commit()
