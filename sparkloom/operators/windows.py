"""First and last matches, carried values, ordinals and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .prefix import within_budget  # noqa: F401  one of these operators


def first_match(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    return rows.groupBy(key).agg(F.min_by(value, place).alias(value))


def last_match(rows: DataFrame, key: str, value: str, place: str) -> DataFrame:
    return rows.groupBy(key).agg(F.max_by(value, place).alias(value))


def numbered(rows: DataFrame, key: str, *order: str) -> DataFrame:
    return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(*order)))


def lines_of(rows: DataFrame, text: str = "text") -> DataFrame:
    """A row a line, numbered from 1; line ends are \\n or \\r\\n."""
    return rows.select("*", F.posexplode(F.split(F.col(text), "\r?\n", -1)).alias("place", "line")).withColumn("line_number", F.col("place") + 1).drop("place", text)


def carried(rows: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """The last value that isn't null up to each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def stable_last(rows: DataFrame, late, *order: str) -> DataFrame:
    """Rows for which late holds come after the others, else in order."""
    return rows.orderBy(late.cast("int"), *order)


def ranked_by_name(rows: DataFrame, rank, name: str = "name") -> DataFrame:
    """Rows in order of rank, then of name as people sort it (letters before case)."""
    return rows.orderBy(rank, F.collate(F.col(name), "UNICODE"))


def blame(lines: DataFrame, most: int = 400) -> DataFrame:
    """(path, n, author, text) of the first code lines of porcelain blame rows (path, n, line): the author last named, ? before any."""
    by = Window.partitionBy("path").orderBy("n")
    named = F.last(F.when(F.startswith("line", F.lit("author ")), F.substring("line", 8, 1 << 30)), ignorenulls=True)
    code = lines.select("path", "n", "line", F.coalesce(named.over(by.rowsBetween(Window.unboundedPreceding, 0)), F.lit("?")).alias("author"))
    code = code.where(F.startswith("line", F.lit("\t"))).withColumn("k", F.row_number().over(by)).where(F.col("k") <= most)
    return code.select("path", F.col("k").alias("n"), "author", F.substring("line", 2, 1 << 30).alias("text"))


def diff_lines(diff: DataFrame) -> DataFrame:
    """Old and new line numbers of unified-diff rows (diff_id, n, line): hunk headers carried down, counters by running sums.

    Gives (diff_id, file, op, line_number, text) of the added and removed lines.
    """
    by = Window.partitionBy("diff_id").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = diff.withColumns({
        "file": F.last(F.when(F.col("line").rlike(r"^\+\+\+ "), F.regexp_replace("line", r"^\+\+\+ (b/)?", "")), ignorenulls=True).over(by),
        "hunk": F.last(F.when(F.col("line").rlike("^@@ "), F.col("n")), ignorenulls=True).over(by),
        "old0": F.last(F.when(F.col("line").rlike("^@@ "), F.regexp_extract("line", r"^@@ -(\d+)", 1).cast("int")), ignorenulls=True).over(by),
        "new0": F.last(F.when(F.col("line").rlike("^@@ "), F.regexp_extract("line", r"^@@ -\S+ \+(\d+)", 1).cast("int")), ignorenulls=True).over(by),
    })
    d = d.where((F.col("n") > F.col("hunk")) & ~F.col("line").rlike(r"^(diff |index |--- |\+\+\+ )"))
    op = F.substring("line", 1, 1)
    inside = Window.partitionBy("diff_id", "hunk").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"op": op, "old_n": F.col("old0") - 1 + F.count_if(op != "+").over(inside), "new_n": F.col("new0") - 1 + F.count_if(op != "-").over(inside)})
    return d.where(F.col("op").isin("+", "-")).select("diff_id", "file", "op", F.when(F.col("op") == "+", F.col("new_n")).otherwise(F.col("old_n")).alias("line_number"), F.substring("line", 2, 1 << 30).alias("text"))


def snapshot_changes(before: DataFrame, after: DataFrame, key: str = "path", mark: str = "hash") -> DataFrame:
    """(path, change): added, changed or removed between two snapshots."""
    b, a = before.select(key, F.col(mark).alias("was")), after.select(key, F.col(mark).alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") != F.col("now"), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change is not null")


def changed_paths(*parts: DataFrame, distinct: bool = True) -> DataFrame:
    out = parts[0].select("path")
    for p in parts[1:]:
        out = out.union(p.select("path"))
    return out.distinct() if distinct else out


def key_differences(used: DataFrame, documented: DataFrame, fine: tuple[str, ...] = ("NODE_ENV", "PATH")) -> DataFrame:
    """(key, side): used but not documented (but for some), documented but not used."""
    missing = used.where(~F.col("key").isin(*fine)).select("key").distinct().join(documented.select("key"), "key", "left_anti").withColumn("side", F.lit("undocumented"))
    extra = documented.select("key").distinct().join(used.select("key"), "key", "left_anti").withColumn("side", F.lit("unused"))
    return missing.union(extra)
