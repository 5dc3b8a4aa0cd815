"""Substring and path-suffix joins by equal keys: grams and suffixes are rows, so no pair is made that shares none.

containing(): texts are indexed by their character grams, and a needle looks up only its rarest gram, so what is compared is about
what the rarest gram lets through. matched_files(): a path's own suffixes are looked up among the known paths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from .graph import staged

GRAM = 3


def grams(c: Column, size: int) -> Column:
    """The substrings of `size` characters, as an array; one empty string for size 0."""
    if size == 0:
        return F.array(F.lit(""))
    n = F.length(c) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(c, i, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def containing(needles: DataFrame, texts: DataFrame) -> DataFrame:
    """Distinct (needle, text) for which text contains needle; needles (needle), texts (text), nulls meet nothing.

    A needle under GRAM characters is a gram itself, so its pairs are found by the key alone; the empty needle is in every text, as in contains().
    """
    needles = needles.where("needle is not null").distinct()
    texts = texts.where("text is not null").distinct()
    own = F.when(F.length("needle") >= GRAM, grams(F.col("needle"), GRAM)).otherwise(F.array("needle"))
    wanted = staged(needles.select("needle", F.explode(F.array_distinct(own)).alias("gram")))
    every = F.array_distinct(F.concat(*(grams(F.col("text"), k) for k in range(GRAM + 1))))
    posted = staged(texts.select("text", F.explode(every).alias("gram")).join(wanted.select("gram").distinct(), "gram", "left_semi"))
    counts = posted.groupBy("gram").agg(F.count("*").alias("n"))
    probe = wanted.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    probe = probe.where("rarest.n > 0").select("needle", F.col("rarest.gram").alias("gram"))
    return probe.join(posted, "gram").where(F.contains("text", F.col("needle"))).select("needle", "text").distinct()


def suffixes(c: Column) -> Column:
    """The endings of a path that begin after a slash, and the path itself."""
    parts = F.split(c, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))


def matched_files(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """(file, path, how) of distinct paths `file` among the known ones (path); those that match none are left out.

    how is exact: the known path is file or an ending of it after a slash (the first of several by path); else base: the only known path with its
    file name; else tail: the longest known path that file ends in, wherever it begins. Each step is a join by equal strings,
    of the distinct files that the steps before have left.
    """
    wanted = staged(wanted.select("file").where("file is not null").distinct())
    known = files.select("path").where("path <> ''").distinct()
    exact = wanted.select("file", F.explode(suffixes(F.col("file"))).alias("path")).join(known, "path")
    exact = staged(exact.groupBy("file").agg(F.min("path").alias("path"), F.lit("exact").alias("how")))
    rest = wanted.join(exact, "file", "left_anti")
    only = known.groupBy(basename(F.col("path")).alias("base")).agg(F.count("*").alias("n"), F.min("path").alias("path")).where("n = 1")
    base = staged(rest.withColumn("base", basename(F.col("file"))).join(only, "base").select("file", "path", F.lit("base").alias("how")))
    rest = rest.join(base, "file", "left_anti")
    tails = F.transform(F.sequence(F.lit(1), F.length("file")), lambda k: F.substring(F.col("file"), k, F.length("file")))
    tail = rest.where("file <> ''").select("file", F.explode(tails).alias("path")).join(known, "path")
    tail = tail.groupBy("file").agg(F.max_by("path", F.length("path")).alias("path"), F.lit("tail").alias("how"))
    return exact.unionByName(base).unionByName(tail)
