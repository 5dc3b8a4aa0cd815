"""Source trees, change logs and git output as DataFrames."""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.predicates import not_ignored


def scan(spark: SparkSession, root: str, ignore: list[str] | None = None, pattern: str = "*") -> DataFrame:
    """(path, hash, size, mtime, content) of every file below root; hashing is done by the tasks that read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    base = "^" + "(file:)?/*" + root.removeprefix("file:").strip("/").replace(".", r"\.") + "/"
    rows = rows.select(F.regexp_replace("path", base, "").alias("path"), F.sha2("content", 256).alias("hash"), F.col("length").alias("size"), F.unix_millis("modificationTime").alias("mtime"), "content")
    return rows if ignore is None else not_ignored(rows, ignore)


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


HASH_ROW = "path string, hash string, size long, mtime long"


def hash_rows(lines: DataFrame) -> DataFrame:
    """(path, hash, size, mtime) of JSON lines (line): lines that are no JSON, lack path or hash, or have another type anywhere are dropped; backslashes become slashes."""
    typed = F.from_json("line", HASH_ROW, {"mode": "PERMISSIVE"}).alias("r")
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{c}", "variant")), F.lit("")) for c in ("path", "hash", "size", "mtime")]
    rows = lines.select(typed, F.try_parse_json("line").alias("v"))
    good = (kinds[0] == "STRING") & (kinds[1] == "STRING") & (kinds[2] == "BIGINT") & (kinds[3] == "BIGINT")
    return rows.where(good).select("r.*").withColumn("path", F.replace("path", F.lit("\\"), F.lit("/")))


def hash_log(spark: SparkSession, path: str) -> DataFrame:
    """hash_rows() of a file of JSON lines."""
    return hash_rows(spark.read.text(path).withColumnRenamed("value", "line"))


def manifests(files: DataFrame) -> DataFrame:
    """(path, name, version, scripts, deps) of package manifests in files (path, text); bad JSON is dropped."""
    kind = "struct<name:string,version:string,scripts:map<string,string>,dependencies:map<string,string>,devDependencies:map<string,string>,peerDependencies:map<string,string>>"
    rows = files.where(F.col("path").rlike(r"(^|/)package\.json$")).select("path", F.from_json("text", kind).alias("m")).where("m is not null")
    names = [F.coalesce(F.map_keys(f"m.{c}"), F.array().cast("array<string>")) for c in ("dependencies", "devDependencies", "peerDependencies")]
    return rows.select("path", "m.name", "m.version", "m.scripts", F.array_distinct(F.concat(*names)).alias("deps"))


def code_owners(files: DataFrame) -> DataFrame:
    """(line_number, pattern, owners) of an ownership file's text; comments and single words are skipped."""
    lines = files.select(F.posexplode(F.split("text", "\r?\n")).alias("n", "line")).withColumn("line", F.trim("line"))
    parts = F.split("line", r"\s+")
    return lines.where(~F.startswith("line", F.lit("#")) & (F.size(parts) > 1)).select((F.col("n") + 1).alias("line_number"), parts[0].alias("pattern"), F.slice(parts, 2, 1 << 30).alias("owners"))


def git_status(lines: DataFrame) -> DataFrame:
    """(kind, path) of porcelain status lines (line): staged, unstaged, untracked."""
    x, y, path = F.substring("line", 1, 1), F.substring("line", 2, 1), F.substring("line", 4, 1 << 30)
    kinds = F.array_compact(F.array(
        F.when((x == "?") & (y == "?"), "untracked"), F.when(~x.isin(" ", "?", "#"), "staged"), F.when(~y.isin(" ", "?", "#"), "unstaged")))
    return lines.where(~F.startswith("line", F.lit("##"))).select(F.explode(kinds).alias("kind"), F.element_at(F.split(path, " -> "), -1).alias("path"))


def git_position(lines: DataFrame) -> DataFrame:
    """(branch, ahead, behind) of the header of porcelain status lines (line); 0 where it says nothing, no row without a header."""
    head = lines.where(F.startswith("line", F.lit("## ")))
    n = lambda word: F.coalesce(F.nullif(F.regexp_extract("line", rf"{word}\s+(\d+)", 1), F.lit("")).cast("int"), F.lit(0))
    branch = F.regexp_replace(F.regexp_extract("line", r"^## (?:No commits yet on |Initial commit on )?(\S+)", 1), r"\.\.\..*$", "")
    return head.select(branch.alias("branch"), n("ahead").alias("ahead"), n("behind").alias("behind"))


class GitSource(DataSource):
    """spark.read.format("gitlines").option("root", ...).option("command", "log"): lines of a read-only git command."""

    #: The only commands run, with fixed arguments.
    COMMANDS = {
        "status": ["status", "--porcelain=v1", "--branch"], "log": ["log", "-n", "10", "--format=%h %s (%an)"], "diff": ["diff"], "staged": ["diff", "--cached"],
        "branches": ["branch", "--format=%(refname:short)"], "show": ["show", "--stat", "HEAD"],
    }

    @classmethod
    def name(cls) -> str:
        return "gitlines"

    def schema(self) -> str:
        return "n int, line string"

    def reader(self, schema) -> DataSourceReader:
        return GitReader(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.command = options["root"], GitSource.COMMANDS[options.get("command", "status")]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(0)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        done = subprocess.run(["git", "-C", self.root, *self.command], capture_output=True, text=True, timeout=60)
        yield from enumerate(done.stdout.splitlines() if done.returncode == 0 else [], 1)


def read_git(spark: SparkSession, root: str, command: str = "status") -> DataFrame:
    spark.dataSource.register(GitSource)
    return spark.read.format("gitlines").option("root", root).option("command", command).load()
