"""Running sums over a whole table without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import staged


def running_sum(rows: DataFrame, value: str, name: str, *order: Column, parts: int | None = None) -> DataFrame:
    """rows with name: the sum of value over all rows up to this one in the given order (which should leave no ties).

    Rows are dealt by ranges of the order and staged with their range's number; sums of the ranges give each its offset (a row a range),
    and within a range the sum runs on from there. Rows that are equal in the order have the same range.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(rows.repartitionByRange(parts, *order).withColumn("__range", F.spark_partition_id()))
    sums = dealt.groupBy("__range").agg(F.sum(value).alias("__sum"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = sums.select("__range", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.join(F.broadcast(offsets), "__range")  # at most `parts` rows
    return summed.withColumn(name, F.col("__offset") + F.sum(value).over(inside)).drop("__range", "__offset")


def within_budget(items: DataFrame, budget: int | None, score: str = "score", tokens: str = "tokens", tie: str | tuple[str, ...] = "id", *keys: str) -> DataFrame:
    """Best items first (of each key) while the running token sum, `used`, stays within the budget; stops at the first that doesn't fit. None: no limit.

    Tokens are 1 at least, so the items before the first that doesn't fit are those whose sum is within the budget. A key's sum is the
    table's minus what comes before the key, so that one key may have most rows.
    """
    ties = (tie,) if isinstance(tie, str) else tie
    order = [*(F.col(k) for k in keys), F.desc(score), *(F.col(t) for t in ties)]
    summed = running_sum(items, tokens, "used", *order)
    if keys:
        summed = staged(summed)
        first = summed.groupBy(*(F.col(k).alias(f"__{k}") for k in keys)).agg(F.min(F.col("used") - F.col(tokens)).alias("__before"))
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
        summed = summed.join(first, same).select(*items.columns, (F.col("used") - F.col("__before")).alias("used"))
    return summed if budget is None else summed.where(F.col("used") <= budget)
