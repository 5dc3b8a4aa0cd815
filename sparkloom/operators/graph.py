"""Reachability, paths and components of the edge table: level by level joins, each level staged, nothing collected."""

from __future__ import annotations

import itertools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEEP = 10
UP, DOWN = ("IMPORTS", "DEPENDS_ON", "TESTS"), ("IMPORTS", "DEPENDS_ON")


def shared_folder(spark: SparkSession) -> str:
    """A new name in the folder that executors share (spark.checkpoint.dir); unset, one process (as in tests) gets a folder of its own and a cluster an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/staged/{uuid.uuid4().hex}"


def clear_staged(spark: SparkSession) -> None:
    """Remove all that was staged; call it when no result made of it is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_folder(spark)).getParent()
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again: lineage is cut, lost executors lose nothing."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """df, a side of a join that grows with the input: no broadcast, which would pass it through the driver whole. Spark takes files for as small as they are compressed."""
    return df.hint("merge")


def reach(edges: DataFrame, seeds: DataFrame, depth: int, source: str, target: str) -> DataFrame:
    """(seed, node) within depth steps along source -> target; a seed may come back through a cycle. Only new nodes go on."""
    step = edges.select(F.col(source).alias("node"), F.col(target).alias("next")).distinct()
    frontier = seeds.select("seed", F.col("seed").alias("node")).distinct()
    found = None
    for level in range(depth):
        level_nodes = frontier.join(step, "node").select("seed", F.col("next").alias("node")).distinct()
        if found is not None:
            level_nodes = level_nodes.join(found, ["seed", "node"], "left_anti")
        frontier = staged(level_nodes) if depth > 2 and level < depth - 1 else level_nodes
        found = frontier if found is None else found.union(frontier)
    return found if found is not None else frontier.limit(0)


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, direction, node): what depends on each seed and what it depends on, within depth steps."""
    up = reach(edges.where(F.col("edge_type").isin(*UP)), seeds, depth, "to_id", "from_id").withColumn("direction", F.lit("dependents"))
    down = reach(edges.where(F.col("edge_type").isin(*DOWN)), seeds, depth, "from_id", "to_id").withColumn("direction", F.lit("dependencies"))
    return up.union(down).select("seed", "direction", "node")


def distances(edges: DataFrame, start: str, kinds: tuple[str, ...] = DOWN) -> DataFrame:
    """(node, distance, parent) of everything reachable from start, however far; the smallest parent wins a tie.

    A level holds only nodes not seen before, so the loop ends. Every DEEP levels what is seen is staged, to keep plans short.
    """
    spark = edges.sparkSession
    step = staged(edges.where(F.col("edge_type").isin(*kinds)).select(F.col("from_id").alias("node"), F.col("to_id").alias("next")).distinct())
    frontier = spark.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("distance"), F.lit(None).cast("string").alias("parent"))
    seen = frontier
    for d in itertools.count(1):
        new = frontier.join(step, "node").groupBy("next").agg(F.min("node").alias("parent")).select(F.col("next").alias("node"), F.lit(d).alias("distance"), "parent")
        frontier = staged(new.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
        if d % DEEP == 0:
            seen = staged(seen)
    return seen


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(place, node) of one shortest path, empty if there is none."""
    seen = staged(distances(edges, start))
    at = seen.where(F.col("node") == end).select("node", "parent", "distance")
    path = at
    hops = at.first()
    for _ in range(hops["distance"] if hops else 0):  # one row a step
        at = staged(seen.join(at.select(F.col("parent").alias("node")), "node").select("node", "parent", "distance"))
        path = path.union(at)
    return path.select(F.col("distance").alias("place"), "node")


def strong_components(edges: DataFrame, least: int = 3, kinds: tuple[str, ...] = ("IMPORTS",)) -> DataFrame:
    """(component, node) of strongly connected components of at least that many nodes; component is its smallest node.

    Nodes without an edge in or out are trimmed again and again; then the smallest label that reaches each node colours
    it, and nodes that reach their colour's root within the colour are its component. What is left goes another round.
    """
    e = staged(edges.where(F.col("edge_type").isin(*kinds) & (F.col("from_id") != F.col("to_id"))).select(F.col("from_id").alias("a"), F.col("to_id").alias("b")).distinct())
    done = None
    while True:
        while True:  # trim
            n = e.count()
            e = staged(e.join(e.select(F.col("b").alias("a")).distinct(), "a", "left_semi").join(e.select(F.col("a").alias("b")).distinct(), "b", "left_semi").select("a", "b"))
            if e.count() == n:
                break
        if n == 0:
            break
        colour = _spread(e, e.select(F.col("a").alias("node")).union(e.select("b")).distinct().withColumn("label", F.col("node")), "a", "b")
        inside = e.join(colour.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(colour.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("la = lb")
        inside = staged(inside.select("a", "b", F.col("la").alias("label")))
        back = _reaches_root(inside, colour)
        made = back.select(F.col("label").alias("component"), "node")
        done = made if done is None else done.union(made)
        e = staged(e.join(back.select(F.col("node").alias("a")), "a", "left_anti").join(back.select(F.col("node").alias("b")), "b", "left_anti"))
    if done is None:
        return edges.select(F.col("from_id").alias("component"), F.col("to_id").alias("node")).limit(0)
    sizes = done.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("component")
    return done.join(sizes, "component", "left_semi").select("component", "node")


def _spread(e: DataFrame, labels: DataFrame, source: str, target: str) -> DataFrame:
    """The smallest label that reaches each node."""
    labels = staged(labels)
    while True:
        sent = e.join(labels.select(F.col("node").alias(source), "label"), source).groupBy(F.col(target).alias("node")).agg(F.min("label").alias("new"))
        both = staged(labels.join(sent, "node", "left").select("node", F.least("label", F.coalesce("new", "label")).alias("label"), (F.col("new") < F.col("label")).alias("moved")))
        labels = both.select("node", "label")
        if both.where("moved").isEmpty():
            return labels


def _reaches_root(inside: DataFrame, colour: DataFrame) -> DataFrame:
    """(node, label) of the nodes from which their colour's root is reached within the colour."""
    found = staged(colour.where("node = label"))
    frontier = found
    while True:
        new = inside.join(frontier.select(F.col("node").alias("b"), "label"), ["b", "label"]).select(F.col("a").alias("node"), "label").distinct()
        frontier = staged(new.join(found, ["node", "label"], "left_anti"))
        if frontier.isEmpty():
            return found
        found = staged(found.union(frontier))
