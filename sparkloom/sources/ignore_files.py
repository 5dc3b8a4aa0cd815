r"""Ignore files with their scopes: which paths of a tree the rules of all its ignore files leave out.

A rule holds below the folder its file stands in. Of the rules that match an entry the last one decides: by kind of file, then the
deepest file, then the last line; ! takes an entry in again. An entry below an ignored folder is ignored whatever its own rules say, for
nobody looks into that folder. So each folder and each file is decided once, from the rules of the folders above it, and a
path is ignored if it or any folder above it is.

Rules are joined to entries by folder: every entry has a row for each folder above it, and a folder's rules are one row. The rule side is broadcast
only if its size, which is counted first, is below BROADCAST_BYTES; else Spark joins by shuffle and splits the folder that most entries are below (the root).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import staged
from ..operators.predicates import DEFAULT_IGNORES

#: Ignore files and their rank; where rules of several kinds match, the higher rank decides.
KINDS = {"exclude": 0, ".gitignore": 1, ".ignore": 2}
BROADCAST_BYTES = 8 << 20


def rule_regex(pattern: str) -> str:
    """An ignore pattern (without ! and a slash at its end) as a regular expression of paths relative to its folder.

    A slash at the beginning or inside ties it to that folder. * and ? stop at slashes; ** between slashes is any folders, at the end all that is below.
    """
    tied = "/" in pattern.rstrip("/")
    parts = pattern.strip("/").split("/")
    out = "" if tied or parts == ["**"] else "(?:.*/)?"
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:[^/]+/)*"
        else:
            out += _segment(part) + ("" if last else "/")
    return f"^{out}$"


def _segment(part: str) -> str:
    out, k = "", 0
    while k < len(part):
        c = part[k]
        if c == "\\" and k + 1 < len(part):
            k += 1
            out += "\\x{%x}" % ord(part[k])
        elif c == "*":
            out += "[^/]*" if not out.endswith("[^/]*") else ""
        elif c == "?":
            out += "[^/]"
        elif c == "[" and (end := part.find("]", k + 2 if part[k + 1:k + 2] not in ("!", "^") else k + 3)) > 0:
            inner = part[k + 1:end]
            no = inner[:1] in ("!", "^")
            body = "".join("-" if x == "-" and 0 < i < len(inner[no:]) - 1 else "\\x{%x}" % ord(x) for i, x in enumerate(inner[no:]))
            out += "[" + "^/" * no + body + "]"
            k = end
        else:
            out += "\\x{%x}" % ord(c)
        k += 1
    return out


def parsed_rules(ignore_files: DataFrame) -> DataFrame:
    """(folder, rank, line_number, regex, folders_only, negated) of the lines of ignore files (path, text): blank lines and comments are none.

    Spaces at the end count only after a backslash; a backslash before # or ! takes their meaning away. A file whose name is not of KINDS has the rank of exclude and
    holds for the whole tree.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for folder, rank, n, line in zip(part["folder"], part["rank"], part["line_number"], part["line"]):
                negated = line.startswith("!")
                body = line[1:] if negated else line
                only = body.endswith("/")
                if body.strip("/"):
                    out.append((folder, rank, n, rule_regex(body[:-1] if only else body), only, negated))
            yield pd.DataFrame(out, columns=["folder", "rank", "line_number", "regex", "folders_only", "negated"])

    name = F.element_at(F.split("path", "/"), -1)
    rank = F.coalesce(*(F.when(name == k, v) for k, v in KINDS.items()), F.lit(KINDS["exclude"]))
    own = F.when(name.isin(*(k for k in KINDS if k != "exclude")), F.regexp_replace("path", r"[^/]+$", "")).otherwise(F.lit(""))
    lines = ignore_files.where("text is not null").select(own.alias("folder"), rank.alias("rank"), F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    lines = lines.select("folder", "rank", (F.col("n") + 1).alias("line_number"), F.regexp_replace("line", r"(?<!\\) +$", "").alias("line")).where(r"line <> '' and not startswith(line, '#')")
    return lines.mapInPandas(run, "folder string, rank int, line_number int, regex string, folders_only boolean, negated boolean")


def above(path: F.Column) -> F.Column:
    """The folders above a path, '' first, each with a slash at its end."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.when(k == 0, "").otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))


def ignored_entries(files: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """(entry, folder, ignored) of each folder (a slash at its end) and file (path) that some rule matches, whatever is above it."""
    rules = parsed_rules(ignore_files).groupBy("folder").agg(F.collect_list(F.struct("rank", F.length("folder").alias("depth"), "line_number", "regex", "folders_only", "negated")).alias("rules"))
    rules = staged(rules)
    size = rules.select(F.sum(F.size("rules") * 64 + F.aggregate("rules", F.lit(0), lambda t, r: t + F.length(r["regex"])))).first()[0] or 0
    paths = files.select("path").distinct()
    folders = paths.select(F.explode(F.slice(above(F.col("path")), 2, 1 << 30)).alias("entry")).distinct()
    entries = folders.withColumn("is_folder", F.lit(True)).union(paths.select("path", F.lit(False)))
    entries = entries.withColumn("whole", F.regexp_replace("entry", "/$", ""))
    each = entries.select("entry", "is_folder", "whole", F.explode(above(F.col("whole"))).alias("folder"))
    each = each.join(F.broadcast(rules) if size < BROADCAST_BYTES else rules, "folder")
    inside = F.substring(F.col("whole"), F.length("folder") + 1, F.length("whole"))
    hits = F.filter("rules", lambda r: (F.col("is_folder") | ~r["folders_only"]) & F.rlike(inside, r["regex"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(r["rank"].alias("rank"), r["depth"].alias("depth"), r["line_number"].alias("line_number"), (~r["negated"]).alias("out"))))
    each = each.select("entry", "is_folder", best.alias("best")).where("best is not null")
    return each.groupBy("entry", "is_folder").agg(F.max("best").alias("best")).select("entry", F.col("is_folder").alias("folder"), F.col("best.out").alias("ignored"))


def not_ignored_by_files(files: DataFrame, ignore_files: DataFrame, defaults: tuple[str, ...] = DEFAULT_IGNORES) -> DataFrame:
    """Rows of files (path, ...) that neither the ignore files (path, text) of their tree nor a default name anywhere on their way leave out; null paths are left out."""
    known = files.where("path is not null")
    known = known.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, defaults)))) if defaults else known
    out = staged(ignored_entries(known, ignore_files).where("ignored"))
    gone = out.where("not folder").select(F.col("entry").alias("path"))
    # a path is below an ignored folder if one of the folders above it is that folder: by equal keys
    ways = known.select("path").distinct().select("path", F.explode(above(F.col("path"))).alias("entry"))
    gone = gone.union(ways.join(out.where("folder").select("entry"), "entry", "left_semi").select("path"))
    return known.join(gone.distinct(), "path", "left_anti").select(*files.columns)
