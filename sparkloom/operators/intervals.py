"""Points in intervals, overlaps and nearest neighbours by equal keys.

The number line of a key is a tree whose nodes of level k are 4 ** k wide. An interval is written as the few nodes that make it up
exactly (at most six of a level), a point as the nodes above it, one of each level. A point is in an interval if and only if they share a
node, and then just one: the equi-join on (key, level, node) makes each pair once and no other, and a key with very many rows is
spread over its nodes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Levels of the tree; intervals longer than 4 ** (LEVELS - 1) take more than six nodes of the last.
LEVELS = 13


def _run(lo: Column, end: Column, level: int) -> Column:
    """The nodes lo, ..., end - 1 of a level."""
    made = F.transform(F.sequence(lo, end - 1), lambda x: F.struct(F.lit(level).alias("level"), x.alias("node")))
    return F.when(lo < end, made).otherwise(F.array().cast("array<struct<level:int,node:bigint>>"))


def nodes_of(lo: Column, hi: Column) -> Column:
    """The nodes that make up [lo, hi]; none if hi < lo."""
    lo, hi = lo.cast("long"), hi.cast("long")
    start = [F.shiftright(lo + ((1 << 2 * k) - 1), 2 * k) for k in range(LEVELS)]
    end = [F.shiftright(hi + 1, 2 * k) for k in range(LEVELS)]
    out = []
    for k in range(LEVELS - 1):
        above = start[k + 1] < end[k + 1]  # some nodes of the next level are in it
        out += [_run(start[k], F.when(above, start[k + 1] * 4).otherwise(end[k]), k), F.when(above, _run(end[k + 1] * 4, end[k], k)).otherwise(_run(F.lit(0), F.lit(0), k))]
    return F.concat(*out, _run(start[-1], end[-1], LEVELS - 1))


def above(x: Column) -> Column:
    """The nodes that hold x, one of each level."""
    return F.array(*(F.struct(F.lit(k).alias("level"), F.shiftright(x.cast("long"), 2 * k).alias("node")) for k in range(LEVELS)))


def points_inside(points: DataFrame, x: Column, spans: DataFrame, lo: Column, hi: Column, key: str) -> DataFrame:
    """points joined with spans of the same key where lo <= x <= hi. Null ends meet nothing."""
    a = points.select("*", F.inline(above(x)).alias("level", "node"))
    b = spans.select("*", F.inline(nodes_of(lo, hi)).alias("level", "node"))
    return a.join(b, [key, "level", "node"]).drop("level", "node")


def overlaps(spans: DataFrame, first: str, last: str, ranges: DataFrame, lo: str, hi: str, key: str) -> DataFrame:
    """spans joined with ranges of the same key where first <= hi and last >= lo, each pair once.

    Of two that overlap, the one that begins later (the span, where both begin together) begins inside the other. An interval that ends before it
    begins overlaps what holds all from its end to its beginning, as the two inequalities say.
    """
    straight = (F.col(first) <= F.col(last)) & (F.col(lo) <= F.col(hi))
    sf, sl = F.least(first, last), F.greatest(first, last)
    rf, rl = F.least(lo, hi), F.greatest(lo, hi)
    starts = points_inside(spans, sf, ranges, rf, rl, key)
    covers = points_inside(ranges, rf, spans, sf + 1, sl, key)
    both = starts.unionByName(covers.select(starts.columns))
    return both.where(straight | (F.col(first) <= F.col(hi)) & (F.col(last) >= F.col(lo)))


def nearest(points: DataFrame, probes: DataFrame, key: str, x: str, at: str, tie: str, k: int, width: int = 1024) -> DataFrame:
    """(probe columns, near: the k points of its key nearest to it, as structs (distance, tie, point)); ties by the column tie. probes: distinct (key, at).

    The line of each key is cut into stretches. Within one, a sorted pass carries the last k points on to each probe, once upwards and once
    downwards; k points at each end of a stretch go to the next ones in a second pass over the stretches that have any. No point meets more
    than the probes it can be near to, and a key with very many points is as many tasks' work as it has stretches.
    """
    row = F.struct(*(c for c in points.columns if c != key))
    stretch = F.floor(F.col(x) / width)
    p = points.where(F.col(x).isNotNull()).select(F.col(key).alias("__k"), stretch.alias("__s"), F.col(x).cast("long").alias("__x"), F.col(tie).alias("__t"), row.alias("__row"))
    q = probes.where(F.col(at).isNotNull()).select(F.col(key).alias("__k"), F.floor(F.col(at) / width).alias("__s"), F.col(at).cast("long").alias("__x"))
    item = F.struct(F.col("__x").alias("x"), F.col("__t").alias("t"), F.col("__row").alias("row"))
    kind = p.select(item.alias("i")).schema["i"].dataType
    both = p.select("__k", "__s", "__x", "__t", item.alias("i"), F.lit(True).alias("__point")).unionByName(
        q.select("__k", "__s", "__x", F.lit(None).cast(p.schema["__t"].dataType).alias("__t"), F.lit(None).cast(kind).alias("i"), F.lit(False).alias("__point")))

    def carried(way: int) -> tuple[DataFrame, DataFrame]:
        """(key, stretch, at, near) of probes within their stretch, and (key, stretch, before) of what comes from the stretches before; way: 1 up, -1 down."""
        # of equal places those with the first ties come last, so they are kept; upwards a probe sees the points of its own place, downwards it doesn't
        order = [F.col("__x") * way, F.col("__point").cast("int") * -way, F.col("__t").desc_nulls_last()]
        inside = Window.partitionBy("__k", "__s", "__point").orderBy(*order).rowsBetween(1 - k, 0)
        kept = both.withColumn("near", F.when(F.col("__point"), F.collect_list("i").over(inside)))
        by = Window.partitionBy("__k", "__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        seen = kept.withColumn("near", F.last("near", ignorenulls=True).over(by))
        own = seen.where(~F.col("__point")).select("__k", "__s", "__x", F.coalesce("near", F.array().cast(seen.schema["near"].dataType)).alias("near"))
        ends = p.withColumn("n", F.row_number().over(Window.partitionBy("__k", "__s").orderBy(F.col("__x") * -way, F.col("__t").asc_nulls_first()))).where(F.col("n") <= k)
        ends = ends.groupBy("__k", "__s").agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), item.alias("i")))).alias("e"))
        ends = ends.select("__k", "__s", F.transform("e", lambda e: e["i"]).alias("e"))
        line = Window.partitionBy("__k").orderBy(F.col("__s") * way)
        upto = F.flatten(F.collect_list("e").over(line.rowsBetween(1 - k, 0)))
        ends = ends.select("__k", "__s", F.slice(upto, F.greatest(F.lit(1), F.size(upto) - k + 1), k).alias("e"))
        asked = ends.unionByName(q.select("__k", "__s").distinct().join(ends, ["__k", "__s"], "left_anti").withColumn("e", F.lit(None).cast(ends.schema["e"].dataType)))
        before = asked.withColumn("before", F.last("e", ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, -1)))
        return own, before.select("__k", "__s", "before")

    out = None
    for way in (1, -1):
        own, before = carried(way)
        none = F.array().cast(own.schema["near"].dataType)
        side = own.join(before, ["__k", "__s"], "left").select("__k", "__x", F.concat(F.coalesce("before", none), "near").alias(f"near{way}"))
        out = side if out is None else out.join(side, ["__k", "__x"])
    ranked = F.transform(F.concat("near1", "near-1"), lambda i: F.struct(F.abs(i["x"] - F.col("__x")).alias("distance"), i["t"].alias("tie"), i["row"].alias("point")))
    return out.select(F.col("__k").alias(key), F.col("__x").alias(at), F.slice(F.sort_array(ranked), 1, k).alias("near"))
