"""The index of a repository: files, symbols, imports, routes, framework hints and edges, built anew only where contents have changed.

A build compares marks (hashes, or time and length of files) with those of the last snapshot, reads the contents of what differs and of nothing else, extracts
from what has another hash, and replaces the rows of changed and removed paths in the buckets they are in. All tables go into one
snapshot of a VersionedTables store. The graph is of all files, so it is built again whenever any row has changed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import code
from ..functions.text import symbol_id
from ..operators.graph import shuffled, staged
from ..operators.joins import with_adapter
from ..sources.store import VersionedTables
from .pipelines import build_graph

#: Changed files up to this number are read by their names, which pass through the driver; more are read by a scan of the tree joined with them.
LISTED = 10_000


@dataclass
class Frame:
    """Contents in a table (path, hash, size, mtime, text). The mark is the hash, so only hashes are read of rows that stay."""

    files: DataFrame

    def marks(self) -> DataFrame:
        """(path, mark); of a path with several rows the newest counts."""
        return self.files.where("path is not null").groupBy("path").agg(F.max_by("hash", F.struct("mtime", "hash")).alias("mark"))

    def contents(self, changed: DataFrame) -> DataFrame:
        """(path, mark, hash, size, mtime, text) of the changed (path, mark), a row a path, with what else changed has; texts are shuffled once."""
        more = [c for c in changed.columns if c not in ("path", "mark")]
        rows = self.files.join(shuffled(changed.withColumnRenamed("mark", "hash")), ["path", "hash"])
        return rows.select("path", F.col("hash").alias("mark"), "hash", "size", "mtime", "text", *more).dropDuplicates(["path", "mark"])


@dataclass
class Tree:
    """Contents in files below root. The mark is time and length, so files that stay are listed but not opened."""

    spark: SparkSession
    root: str

    def _scan(self, *paths: str) -> DataFrame:
        reader = self.spark.read.format("binaryFile").option("recursiveFileLookup", True)
        rows = reader.load(list(paths) if paths else self.root)
        inside = F.substring_index(F.col("path"), self.root.removeprefix("file:").strip("/") + "/", -1)
        mark = F.concat_ws(":", F.unix_micros("modificationTime").cast("string"), F.col("length").cast("string"))
        return rows.select(inside.alias("path"), F.col("path").alias("full"), mark.alias("mark"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")

    def marks(self) -> DataFrame:
        return self._scan().select("path", "mark")

    def contents(self, changed: DataFrame) -> DataFrame:
        few = changed.select("path").limit(LISTED + 1).collect()  # LISTED rows at most are used
        wanted = changed.select("path", *(c for c in changed.columns if c not in ("path", "mark")))
        if len(few) > LISTED:
            rows = self._scan().join(shuffled(wanted), "path")
        elif few:
            rows = self._scan(*(f"{self.root.rstrip('/')}/{r['path']}" for r in few)).join(wanted, "path")
        else:
            rows = self._scan().limit(0).join(wanted, "path")
        return rows.select("path", "mark", F.sha2("content", 256).alias("hash"), "size", "mtime", F.decode("content", "UTF-8").alias("text"), *wanted.columns[1:])


def extracted(files: DataFrame) -> dict[str, tuple[DataFrame, str]]:
    """The side tables of files (path, language, text), with the column each is bucketed by."""
    line, found = F.col("line_number"), code.analysis(files)
    symbols = found["symbols"].select(symbol_id(F.col("path"), F.col("name"), line).alias("id"), F.col("path").alias("file_path"), "name", "kind", line.alias("line"), "exported", "signature")
    imports = found["imports"].select(F.col("path").alias("file_path"), "source", "specifier", line.alias("line"))
    symbols = symbols.groupBy("file_path", "id").agg(F.max_by(F.struct("name", "kind", "line", "exported", "signature"), F.struct("kind", "exported")).alias("s")).select("id", "file_path", "s.*")  # an id once
    return {"symbols": (symbols, "file_path"), "imports": (imports, "file_path"), "routes": (found["routes"], "path"), "frameworks": (found["frameworks"], "path")}


def build(store: VersionedTables, source: Frame | Tree, incremental: bool = True, graph: bool = True) -> dict:
    """One build; gives the run's counts, which the snapshot's meta keeps: scanned, indexed, skipped, removed, languages.

    Paths without an adapter for their extension are no part of the index. A path whose mark is new but whose hash is known is skipped and keeps its rows.
    incremental=False extracts everything again. Nothing changed: no snapshot is made.
    """
    tx = store.begin()
    now = with_adapter(source.marks()).where("adapter is not null").select("path", "mark", F.col("adapter").alias("language"))
    known = tx.read("files")
    if known is None:
        known = store.spark.createDataFrame([], "path string, mark string, hash string")
    both = now.join(known.select("path", F.col("mark").alias("was"), F.col("hash").alias("known_hash")), "path", "full")
    action = F.when(F.col("mark").isNull(), "delete").when(F.lit(not incremental) | F.col("was").isNull() | (F.col("was") != F.col("mark")), "read").otherwise("keep")
    delta = staged(both.select("path", "mark", "language", "known_hash", action.alias("action")))
    wanted = delta.where("action = 'read'")
    read = source.contents(wanted.select("path", "mark", "language", "known_hash"))
    changed = F.lit(not incremental) | F.col("known_hash").isNull() | (F.col("known_hash") != F.col("hash"))
    read = staged(read.withColumn("changed", changed))
    gone = delta.where("action = 'delete'").select("path")
    indexed = read.where("changed").groupBy("language").agg(F.count("*").alias("n")).collect()  # a row a language
    counts = {r["action"]: r["n"] for r in delta.groupBy("action").agg(F.count("*").alias("n")).collect()}
    run = {"scanned": counts.get("read", 0) + counts.get("keep", 0), "indexed": sum(r["n"] for r in indexed), "removed": counts.get("delete", 0), "languages": {r["language"]: r["n"] for r in indexed}}
    run["skipped"] = run["scanned"] - run["indexed"]
    if not counts.get("read", 0) and not run["removed"]:
        return run

    def replace(name: str, new: DataFrame, key: str, paths: DataFrame) -> None:
        buckets = [r["b"] for r in paths.select(store.bucket_of("path").alias("b")).distinct().collect()]  # store.buckets rows at most
        if name not in tx.pending["tables"]:
            tx.write(name, new, key)
        elif buckets:
            old = tx.read(name, buckets)
            tx.write(name, old.join(shuffled(paths.select(F.col("path").alias(key))), key, "left_anti").unionByName(new.select(old.columns)), key, buckets)

    stamped = read.select("path", "mark", "hash", "language", "size", "mtime")
    replace("files", stamped, "path", read.select("path").union(gone))
    again = staged(read.where("changed").select("path").union(gone))
    for name, (rows, key) in extracted(read.where("changed")).items():
        replace(name, rows, key, again)
    if graph and (run["indexed"] or run["removed"]):
        numbered = tx.read("imports").withColumn("ord", F.xxhash64("file_path", "source", "specifier", "line"))
        edges = build_graph(tx.read("files"), tx.read("symbols"), numbered)
        tx.write("edges", edges, "from_id")
    run["snapshot"] = tx.commit(**run)
    return run
