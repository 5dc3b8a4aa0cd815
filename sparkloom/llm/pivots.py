"""Lists of many nodes that share a key, without all their pairs.

Every node of a list is first compared with one of them, the list's pivot P; linked nodes become components. What is then
still apart is not paired within the list: two nodes A, B that differ in at most `most` elements, not both linked with P,
must differ from P in the same elements, for A ^ B = (A ^ P) ^ (B ^ P). So each node posts under (P, element) the first
of its differences from P, rarest first, and only nodes that meet there and are still apart are compared. The key that
all of a list have in common is in none of the differences, so a list of very many nodes that are all near P and far
from one another falls apart into lists of those with the same change.

With d = |A ^ P| <= |B ^ P|, at least (|A ^ P| + |B ^ P| - most) / 2 differences are common. Hence A needs to post its first
most / 2 + 1 and B its first most + 1, and if the first common one stands at i and j, it is at most min(|A ^ P| - i, |B ^ P| - j).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import U, components, mix, stage

#: What a comparison of (node, pivot) gives: one row with a null key that says whether they link, and what the node posts.
COMPARED = "node long, pivot long, linked boolean, size long, key long, differ long, at long, small boolean, sketch array<int>"
ALIKE = U(0x6A09E667F3BCC909)


def lists_of(posted: DataFrame, score: str | None = None) -> DataFrame:
    """(key, node, pivot) of the lists of more than one node. posted: (key, node, score), staged; the pivot has the least score.

    A pivot that has little of its own keeps the differences short. Ends are summed up before the shuffle, and a long list
    can be split over tasks.
    """
    place = F.struct(F.col(score).alias("score"), "node") if score else F.struct("node")
    ends = posted.groupBy("key").agg(F.min(place).alias("pivot"), F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi")
    return posted.select("key", "node").join(stage(ends.select("key", "pivot.node").withColumnRenamed("node", "pivot"), "pivots"), "key").distinct()


def rows_of(pivot: int, differences: np.ndarray, most: int, alone: int = 0, alike: bool = True) -> tuple[np.ndarray, ...]:
    """(key, differ, at, small) that a node posts: differences in posting order, of which the first `alone` are surely no other node's.

    alike: nodes near P that have no difference in common may link without both being linked with P.
    """
    n, p = len(differences), mix(np.array([pivot], np.int64).view(U))
    at = np.arange(alone, min(n, most + 1))
    keys, small = mix(differences[at] ^ p), at <= most // 2
    if alike and n <= most:  # pairs that may have no difference in common: both are near P
        low = np.arange(min(n, most - n) + 1)
        far = np.concatenate((low, [n]))
        keys = np.concatenate((keys, mix(mix(p ^ ALIKE) + far.astype(U))))
        at, small = np.concatenate((at, np.zeros(len(far), np.int64))), np.concatenate((small, np.zeros(len(low), bool), [True]))
    return keys.view(np.int64), np.full(len(at), n), at, small


def compared(nodes: list[int], pivots: list[int], linked: list[bool], sizes: list[int], posted: list[tuple[np.ndarray, ...]], sketches: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of COMPARED for pairs and what rows_of() gave for each; sketches: a row of numbers of each node for the condition on pairs."""
    each = np.array([len(p[0]) for p in posted], np.int64)
    pair = np.concatenate((np.arange(len(nodes)), np.repeat(np.arange(len(nodes)), each)))
    columns = [pa.array(np.asarray(x, kind)[pair]) for x, kind in ((nodes, np.int64), (pivots, np.int64), (linked, bool), (sizes, np.int64))]
    for k, kind in enumerate((np.int64, np.int64, np.int64, bool)):
        flat = np.concatenate([np.zeros(len(nodes), kind), *(p[k] for p in posted)])
        columns.append(pa.array(flat, mask=np.arange(len(pair)) < len(nodes)))
    if sketches is None:
        columns.append(pa.nulls(len(pair), pa.list_(pa.int32())))
    else:
        wide = np.ascontiguousarray(sketches, np.int32)[pair]
        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(len(pair) + 1, dtype=np.int32) * wide.shape[1]), pa.array(wide.ravel())))
    return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in COMPARED.split(", ")])


def apart_pairs(rows: DataFrame, found: DataFrame, most: str, also: str = "true") -> DataFrame:
    """Distinct pairs (a, b) of nodes that are in different components so far and may differ in at most `most` elements (SQL of size_a, size_b); also: a condition of these sizes and of sketch_a, sketch_b."""
    rows = stage(rows.join(found, "node", "left").select(*rows.columns, F.coalesce("component", "node").alias("inside")), "differences")
    mixed = rows.groupBy("key").agg(F.min("inside").alias("lo"), F.max("inside").alias("hi"), F.max("small").alias("some")).where("lo <> hi and some")
    rows = stage(rows.join(stage(mixed.select("key"), "mixed"), "key", "left_semi"), "differences")

    def side(c: str) -> DataFrame:
        return rows.select("key", *(F.col(x).alias(f"{x}_{c}") for x in ("node", "size", "differ", "at", "small", "inside", "sketch")))

    first = F.struct("differ_a", "node_a") < F.struct("differ_b", "node_b")
    shared = 2 * F.least(F.col("differ_a") - F.col("at_a"), F.col("differ_b") - F.col("at_b"))
    both = side("a").where("small_a").join(side("b"), "key")
    both = both.where((F.col("inside_a") != F.col("inside_b")) & first & (shared >= F.col("differ_a") + F.col("differ_b") - F.expr(most)) & F.expr(also))
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def merged(found: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) after the links (a, b) between nodes are added to the components found."""
    for c in ("a", "b"):
        links = links.join(found.select(F.col("node").alias(c), F.col("component").alias(f"in_{c}")), c, "left")
    links = stage(links.select(F.coalesce("in_a", "a").alias("a"), F.coalesce("in_b", "b").alias("b")).where("a <> b").distinct(), "links")
    if links.isEmpty():
        return found
    above = stage(components(links), "components")
    below = found.join(above.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return stage(below.select("node", F.coalesce("top", "component").alias("component")).union(above.join(found, "node", "left_anti").select("node", "component")), "components")
