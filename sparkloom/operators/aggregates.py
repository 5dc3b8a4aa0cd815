"""Counts, scores and rankings over files, symbols, imports and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, node_path
from .joins import DEPENDENCY, with_adapter


def table_counts(**tables: DataFrame) -> DataFrame:
    """One row: how many rows each table has."""
    one = [df.agg(F.count("*").alias(f"n_{name}")) for name, df in tables.items()]
    return reduce(DataFrame.crossJoin, one)  # one row each


def counts_by(rows: DataFrame, column: str, default: str = "unknown") -> DataFrame:
    return rows.groupBy(F.coalesce(F.nullif(F.col(column), F.lit("")), F.lit(default)).alias(column)).agg(F.count("*").alias("n"))


def graph_stats(files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    by_type = edges.groupBy("edge_type").agg(F.count("*").alias("n"))
    packed = by_type.agg(F.sum("n").alias("n_edges"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("edge_type", "n")))).alias("by_type"))
    return table_counts(files=files, symbols=symbols).select((F.col("n_files") + F.col("n_symbols")).alias("n_nodes")).crossJoin(packed)


def fan_in(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges that reach each file, zeros included; an import that is also a dependency counts twice."""
    into = edges.where(F.col("edge_type").isin(*DEPENDENCY)).groupBy(node_path(F.col("to_id")).alias("path")).agg(F.count("*").alias("n"))
    return files.select("path").join(into, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("fan_in"))


def top(rows: DataFrame, by: str, key: str, k: int = 20) -> DataFrame:
    return rows.orderBy(F.desc(by), key).limit(k)


def repeated_routes(routes: DataFrame) -> DataFrame:
    """Paths that more than one file defines."""
    made = routes.groupBy("route").agg(F.sort_array(F.collect_set("file_path")).alias("files"), F.sort_array(F.collect_set("method")).alias("methods"))
    return made.where(F.size("files") > 1)


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Distinct keys in the order they first come."""
    return rows.groupBy(key).agg(F.min(order).alias("first")).orderBy("first", key)


def grouped_samples(rows: DataFrame, key: str, value: str, order: str, k: int = 20) -> DataFrame:
    """key with its first k distinct values by first appearance."""
    once = rows.groupBy(key, value).agg(F.min(order).alias("first"))
    return once.groupBy(key).agg(F.transform(F.slice(F.sort_array(F.collect_list(F.struct("first", value))), 1, k), lambda x: x[value]).alias("values"))


def capped_counts(findings: DataFrame, order: list[str], cap: int = 200) -> DataFrame:
    """(by, key, n): counts by kind and by label of the first cap findings."""
    kept = findings.orderBy(*order).limit(cap)
    both = F.explode(F.array(F.struct(F.lit("kind").alias("by"), F.col("kind").alias("key")), F.struct(F.lit("label").alias("by"), F.col("label").alias("key")))).alias("x")
    return kept.select(both).groupBy("x.by", "x.key").agg(F.count("*").alias("n"))


def weighted_score(checks: DataFrame) -> DataFrame:
    """(score, grade, ready) of checks (ok, weight): the rounded share of weight that holds; 0 without checks."""
    made = checks.agg(F.sum(F.when(F.col("ok"), F.col("weight")).otherwise(0)).alias("good"), F.sum("weight").alias("all"), F.bool_and("ok").alias("ready"))
    score = F.coalesce(F.round(F.col("good") * 100 / F.col("all")), F.lit(0)).cast("long")
    grade = F.when(score >= 90, "A").when(score >= 80, "B").when(score >= 70, "C").when(score >= 60, "D").otherwise("F")
    return made.select(score.alias("score"), grade.alias("grade"), F.coalesce("ready", F.lit(True)).alias("ready"))


def duplicate_imports(imports: DataFrame, limit: int = 50) -> DataFrame:
    n = imports.groupBy("file_path", "source").agg(F.count("*").alias("n")).where("n > 1")
    return n.orderBy(F.desc("n"), "file_path", "source").limit(limit)


def heavy_files(imports: DataFrame, edges: DataFrame, least: int = 8, limit: int = 25, samples: int = 8) -> DataFrame:
    """Files with many imports or dependency edges, whichever is more, with sample sources."""
    own = imports.groupBy("file_path").agg(F.count("*").alias("n_imports"), F.slice(F.sort_array(F.collect_set("source")), 1, samples).alias("samples"))
    out = edges.where(F.col("edge_type").isin(*DEPENDENCY)).groupBy(node_path(F.col("from_id")).alias("file_path")).agg(F.count("*").alias("n_edges"))
    both = own.join(out, "file_path", "full").select("file_path", F.coalesce("n_imports", F.lit(0)).alias("n_imports"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))
    both = both.withColumn("weight", F.greatest("n_imports", "n_edges")).where(F.col("weight") >= least)
    return both.orderBy(F.desc("weight"), "file_path").limit(limit)


def adapter_coverage(files: DataFrame) -> DataFrame:
    """Files per extension and the adapter that reads it, if any."""
    return with_adapter(files).groupBy(extension(F.col("path")).alias("extension"), "adapter").agg(F.count("*").alias("n"))


def uncovered_extensions(files: DataFrame, limit: int = 30) -> DataFrame:
    """(extension, n) of the commonest extensions that no adapter reads."""
    covered = adapter_coverage(files).where("adapter is null and extension <> ''")
    return covered.select("extension", "n").orderBy(F.desc("n"), "extension").limit(limit)


def best_confidence(rows: DataFrame, confidence: Column, *keys: str) -> DataFrame:
    """The strongest confidence of each group."""
    rank = F.when(confidence == "confirmed", 3).when(confidence == "strongly_inferred", 2).when(confidence == "weakly_inferred", 1).otherwise(0)
    return rows.groupBy(*keys).agg(F.max_by(confidence, rank).alias("confidence"))


def line_span(rows: DataFrame, key: str, line: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min(line).alias("lo"), F.max(line).alias("hi"))
