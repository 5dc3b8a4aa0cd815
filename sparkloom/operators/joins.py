"""Joins of files, symbols, edges, imports, owners and frames. Small rule tables are built from parameters; Spark picks the strategy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import dirname, extension, folded, glob_regex, imported_names, internal_frame, node_path, posix
from .graph import impact, shuffled
from .intervals import nearest, overlaps, points_inside
from .matching import containing, matched_files
from .predicates import CONVENTION, TEST_FILES, is_entry

#: Extension to language adapter.
ADAPTERS = {
    ".ts": "typescript", ".tsx": "typescript", ".mts": "typescript", ".cts": "typescript", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".rs": "rust", ".py": "python", ".go": "go",
}
#: Endings under which an import is looked for, in order.
ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".rs", ".py", ".go", "/index.ts", "/index.tsx", "/index.js", "/mod.rs", "/__init__.py")
DEPENDENCY = ("IMPORTS", "DEPENDS_ON")


def pairs_table(spark, pairs: dict[str, str], key: str, value: str) -> DataFrame:
    """A literal two-column table."""
    rows = F.array(*(F.struct(F.lit(k).alias(key), F.lit(v).alias(value)) for k, v in pairs.items()))
    return spark.range(1).select(F.inline(rows))


def neighbours(edges: DataFrame, node: str, kinds: tuple[str, ...] | None = None) -> DataFrame:
    rows = edges if kinds is None else edges.where(F.col("edge_type").isin(*kinds))
    out = rows.where(F.col("from_id") == node).withColumn("direction", F.lit("out"))
    return out.unionByName(rows.where(F.col("to_id") == node).withColumn("direction", F.lit("in")))


def with_adapter(files: DataFrame) -> DataFrame:
    adapters = pairs_table(files.sparkSession, ADAPTERS, "ext", "adapter")
    return files.withColumn("ext", extension(F.col("path"))).join(F.broadcast(adapters), "ext", "left")  # 11 rows


def cross_dependencies(packages: DataFrame) -> DataFrame:
    """(package, dependency) of declared dependencies that are packages of the workspace; packages has name, deps (names)."""
    declared = packages.select(F.col("name").alias("package"), F.explode("deps").alias("dependency")).distinct()
    return declared.join(packages.select(F.col("name").alias("dependency")).distinct(), "dependency").select("package", "dependency")


def import_targets(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports with the target: a package's first part, the first known file of the candidates, else the stripped path."""
    external = ~F.col("source").rlike(r"^[./\\]")
    whole = F.when(~external, folded(F.concat(dirname(F.col("file_path")), F.lit("/"), F.col("source"))))
    rows = imports.select("ord", "file_path", "source", external.alias("external"), F.explode(F.array(whole)).alias("whole"))  # once a row
    rows = rows.withColumn("stripped", F.regexp_replace("whole", r"(?i)\.(js|jsx|mjs|cjs|mts|cts)$", ""))
    rows = rows.withColumn("tried", F.array("whole", *(F.concat("stripped", F.lit(e)) for e in ENDINGS)))
    found = rows.where(~F.col("external")).select("ord", F.posexplode("tried").alias("place", "path"))
    found = found.join(shuffled(files.select("path")), "path").groupBy("ord").agg(F.min_by("path", "place").alias("found"))
    target = F.when(F.col("external"), F.concat(F.lit("pkg:"), F.element_at(F.split("source", "/"), 1))).otherwise(F.coalesce("found", "stripped"))
    return rows.join(shuffled(found), "ord", "left").select("ord", "file_path", "source", target.alias("target"), (F.col("external") | F.col("found").isNotNull()).alias("known"))


def orphans(files: DataFrame, edges: DataFrame) -> DataFrame:
    """Files that no IMPORTS edge leaves or reaches."""
    used = edges.where(F.col("edge_type") == "IMPORTS")
    ends = used.select(node_path(F.col("from_id")).alias("path")).union(used.select(node_path(F.col("to_id"))))
    return files.join(ends, "path", "left_anti").select("path")


def unused_symbols(symbols: DataFrame, imports: DataFrame, edges: DataFrame, private: bool = False) -> DataFrame:
    """Symbols whose name no import brings in and that no call or reference reaches or starts from, with a confidence."""
    names = imports.select(F.explode(imported_names(F.col("specifier"))).alias("name")).distinct()
    used = edges.where(F.col("edge_type").isin("CALLS", "REFERENCES"))
    called = used.select(F.explode(F.array("to_id", "from_id")).alias("end")).select(F.regexp_replace("end", "^symbol:", "").alias("id"))
    rows = symbols if private else symbols.where("exported")
    rows = rows.where(~F.col("file_path").rlike(TEST_FILES["unused"])).join(names, "name", "left_anti").join(called, "id", "left_anti")
    strong = F.col("exported") & ~is_entry(F.col("file_path"), F.col("name")) & ~F.col("name").rlike("(?i)^(get|set|handle|use|create|on)") & ~F.col("name").rlike(CONVENTION)
    return rows.select("id", "name", "file_path", "line", "kind", "exported", F.when(strong, "strongly_inferred").otherwise("weakly_inferred").alias("confidence"))


def unused_report(symbols: DataFrame, imports: DataFrame, edges: DataFrame, limit: int = 100, private: bool = False) -> DataFrame:
    """The first unused symbols, surest first, then by name as people sort it, with the reasons for each."""
    rows = unused_symbols(symbols, imports, edges, private)
    entry, convention = is_entry(F.col("file_path"), F.col("name")), F.col("name").rlike(CONVENTION)
    reasons = F.array_compact(F.array(
        F.when(F.col("exported"), "exported symbol name not seen in any indexed import specifier").otherwise("non-exported symbol with no import references (limited visibility)"), F.lit("no CALLS/REFERENCES edges to this symbol"),
        F.when(entry, "possible entrypoint / barrel — lower confidence").when(F.col("exported") & ~F.col("name").rlike("(?i)^(get|set|handle|use|create|on)"), "non-entry exported symbol with zero import hits"),
        F.when(convention, "framework/route convention name — may be framework-invoked")))
    rank = F.when(F.col("confidence") == "strongly_inferred", 0).otherwise(1)
    return rows.withColumn("reasons", reasons).orderBy(rank, F.collate(F.col("name"), "UNICODE"), "id").limit(limit)


def owners_for(files: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(path, pattern, owner) of the last rule that matches; null where none does. Rules are configuration, in file order."""
    paths, out = F.col("path"), F.lit(None).cast("struct<pattern:string,owner:string>")
    for pattern, owner in rules:
        out = F.when(paths.rlike(glob_regex(pattern)), F.struct(F.lit(pattern).alias("pattern"), F.lit(owner).alias("owner"))).otherwise(out)
    return files.select("path", out.alias("rule")).select("path", "rule.pattern", "rule.owner")


def uncovered(files: DataFrame, rules: list[tuple[str, str]], limit: int = 100) -> DataFrame:
    return owners_for(files, rules).where("owner is null").select("path").orderBy("path").limit(limit)


def tests_of(changed: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(of, path): test files tied to each changed path (path) by a TESTS edge, or by its stem anywhere in their own path."""
    changed = changed.select(F.col("path").alias("of")).distinct()
    tests = files.where(F.col("path").rlike(TEST_FILES["review"])).select("path")
    by_edge = edges.where(F.col("edge_type") == "TESTS").select(node_path(F.col("to_id")).alias("of"), node_path(F.col("from_id")).alias("path"))
    by_edge = by_edge.join(changed, "of", "left_semi")
    stems = changed.withColumn("needle", F.element_at(F.split(F.regexp_replace("of", r"\.[^.]+\z", ""), "/"), -1))
    by_stem = containing(stems, tests.withColumnRenamed("path", "text")).join(stems, "needle").select("of", F.col("text").alias("path"))
    return by_edge.union(by_stem).distinct()


def related_tests(changed: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """Test files tied to any changed path (path)."""
    return tests_of(changed, files, edges).select("path").distinct()


def chosen_tests(targets: DataFrame, files: DataFrame, edges: DataFrame, mode: str = "all") -> DataFrame:
    """(target, path): the test files that a run in this mode takes for each target (target), a path or a package's folder.

    all: every test file, targets or not (target null). file: whose path holds the target or is held by it, what depends on it within two steps, and
    what a TESTS edge ties to it. related: the target and what is within two steps of it either way, and tests of any of these. package: whose path
    begins with the target.
    """
    tests = files.where(F.col("path").rlike(TEST_FILES["inventory"])).select("path").distinct()
    if mode == "all":
        return tests.select(F.lit(None).cast("string").alias("target"), "path")
    targets = targets.select(posix(F.col("target")).alias("target")).distinct()
    held = containing(targets.withColumnRenamed("target", "needle"), tests.withColumnRenamed("path", "text"))
    held = held.select(F.col("needle").alias("target"), F.col("text").alias("path"))
    if mode == "package":
        return held.where(F.startswith("path", F.col("target")))
    near = impact(edges, targets.select(F.concat(F.lit("file:"), "target").alias("seed")), 2)
    target, tested = F.substring("seed", 6, 1 << 30).alias("target"), edges.where(F.col("edge_type") == "TESTS")
    own = targets.select("target", F.concat(F.lit("file:"), "target").alias("node"))
    if mode == "file":
        reached = near.where("direction = 'dependents'").select(target, "node")
        holds = containing(tests.withColumnRenamed("path", "needle"), targets.withColumnRenamed("target", "text")).select(F.col("text").alias("target"), F.col("needle").alias("path"))
        tied, more = own, held.union(holds)
    elif mode == "related":
        reached = tied = near.select(target, "node").union(own)
        more = held.limit(0)
    else:
        raise ValueError(f"no such mode: {mode}")
    tied = tested.join(tied, F.col("to_id") == F.col("node")).select("target", node_path(F.col("from_id")).alias("path"))
    found = reached.where(F.startswith("node", F.lit("file:"))).select("target", node_path(F.col("node")).alias("path")).union(tied)
    return found.join(tests, "path", "left_semi").select("target", "path").union(more).distinct()


def frame_files(frames: DataFrame, files: DataFrame) -> DataFrame:
    """Frames (id, file, line) with the known file (path) they are of and how it was found (see matched_files); internal frames are left out, packages' own are not."""
    named = frames.select("*", F.explode(F.array(posix(F.col("file")))).alias("__file"))  # computed once a row, used often
    named = named.where(~internal_frame(F.col("__file")) | F.contains("__file", F.lit("node_modules/")))
    found = matched_files(named.select(F.col("__file").alias("file")), files).withColumnRenamed("file", "__file")
    return named.join(found, "__file").drop("__file")


def frame_symbols(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """The symbol at or nearest above each frame's line in its file (path): an as-of join, one sorted pass over both sides."""
    lower = symbols.select(F.col("file_path").alias("path"), "line", F.lit(0).alias("side"), F.col("id").alias("symbol_id"), F.struct("name", F.col("line").alias("at")).alias("s"), F.lit(None).cast(frames.schema["id"].dataType).alias("id"))
    upper = frames.select("path", "line", F.lit(1).alias("side"), F.lit(None).cast(symbols.schema["id"].dataType).alias("symbol_id"), F.lit(None).cast(lower.schema["s"].dataType).alias("s"), "id")
    by = Window.partitionBy("path").orderBy("line", "side", "symbol_id").rowsBetween(Window.unboundedPreceding, 0)
    both = lower.union(upper).withColumns({"s": F.last("s", ignorenulls=True).over(by), "symbol_id": F.last("symbol_id", ignorenulls=True).over(by)})
    return both.where("side = 1 and s is not null").select("id", "path", "line", "s.name", F.col("s.at").alias("symbol_line"), "symbol_id").distinct()


def placed_symbols(frames: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, path, line, symbol_id, name, how): each frame's (id, path, line, function) symbol in its file, else no row.

    how is name (the function or its last part; the first such symbol), else span (the smallest [line, end_line] that holds the
    line), else above (the nearest start at or above it). Spans meet the lines inside them alone.
    """
    at = symbols.select(F.col("file_path").alias("path"), F.col("id").alias("symbol_id"), "name", F.col("line").alias("first"), F.coalesce("end_line", "line").alias("last"))

    def order(k: int, first: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), first.cast("long").alias("first"), F.col("symbol_id").alias("tie")).alias("order")

    called = F.explode(F.array_distinct(F.array("function", F.regexp_extract("function", r"([^./]+)$", 1))))
    named = frames.select("id", "path", "line", called.alias("name")).where("name <> ''").join(at, ["path", "name"])
    named = named.select("id", "path", "line", "symbol_id", "name", F.lit("name").alias("how"), order(0, F.col("first")))
    inside = points_inside(frames.select("id", "path", "line"), F.col("line"), at, F.col("first"), F.col("last"), "path")
    inside = inside.select("id", "path", "line", "symbol_id", "name", F.lit("span"), order(1, F.col("last") - F.col("first")))
    above = frame_symbols(frames, symbols).select("id", "path", "line", "symbol_id", "name", F.lit("above"), order(2, F.lit(0)))
    best = F.min_by(F.struct("symbol_id", "name", "how"), "order").alias("s")
    return named.union(inside).union(above).groupBy("id", "path", "line").agg(best).select("id", "path", "line", "s.*")


def touched_symbols(ranges: DataFrame, symbols: DataFrame, span: int = 30) -> DataFrame:
    """Symbols whose lines, to end_line or else span lines on, meet a range (path, lo, hi)."""
    last = F.col("line") + span
    if "end_line" in symbols.columns:
        last = F.coalesce("end_line", last)
    held = symbols.select(F.col("file_path").alias("path"), "id", "name", "line", last.alias("last"))
    return overlaps(held, "line", "last", ranges.select("path", "lo", "hi"), "lo", "hi", "path").select("path", "lo", "hi", "id", "name", "line")


def nearest_symbols(symbols: DataFrame, probes: DataFrame, k: int = 15) -> DataFrame:
    """The k symbols nearest to each probe (path, at) in its file."""
    points = symbols.select(F.col("file_path").alias("path"), "id", "name", "line")
    near = nearest(points, probes.select("path", "at").distinct(), "path", "line", "at", "id", k)
    near = near.select("path", "at", F.posexplode("near").alias("place", "s"))
    return near.select("path", "at", "s.point.id", "s.point.name", "s.distance", (F.col("place") + 1).alias("rank"))


def with_side_records(files: DataFrame, side: DataFrame, name: str, fields: list[str]) -> DataFrame:
    """files with an array of their side records (file_path, fields...), ordered by them."""
    packed = side.groupBy("file_path").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))
    return files.join(packed, files["path"] == packed["file_path"], "left").drop("file_path")


def registered_steps(steps: DataFrame, registry: DataFrame) -> DataFrame:
    """Flow steps (flow, step, tool) with whether the tool is known."""
    known = registry.select("tool").distinct().withColumn("known", F.lit(True))
    return steps.join(known, "tool", "left").select("flow", "step", "tool", F.coalesce("known", F.lit(False)).alias("registered"))


def present(files: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """(name, present): which of the wanted systems have a file whose path matches."""
    flags = files.agg(*(F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(k) for k, p in wanted.items()))
    return flags.select(F.inline(F.array(*(F.struct(F.lit(k).alias("name"), F.col(k).alias("present")) for k in wanted))))


def applicable_rules(rules: DataFrame, path: str, fallback: int = 5) -> DataFrame:
    """Rules (name, globs, body) for a path and why; if none applies, the first few."""
    parts = [p for p in path.split("/") if len(p) > 2]
    mention = F.lit(False)
    for p in parts:
        mention = mention | F.contains(F.lower("body"), F.lit(p.lower()))
    typed = F.lit(path.endswith((".ts", ".tsx"))) & F.lower("body").rlike("typescript")
    reasons = F.array_compact(F.array(
        F.when(F.exists("globs", lambda g: F.rlike(F.lit(path), g)), "glob"), F.when(mention, "mention"), F.when(F.lower("body").rlike(r"\balways\b|\ball files\b"), "always"), F.when(typed, "typescript")))
    marked = rules.select("name", reasons.alias("reasons"))
    any_hit = Window.partitionBy()  # rules are a small configuration table
    ranked = marked.withColumns({"hits": F.count_if(F.size("reasons") > 0).over(any_hit), "place": F.row_number().over(Window.orderBy("name"))})
    return ranked.where((F.size("reasons") > 0) | ((F.col("hits") == 0) & (F.col("place") <= fallback))).select("name", "reasons")


def mutual_pairs(edges: DataFrame, kinds: tuple[str, ...] = ("IMPORTS",)) -> DataFrame:
    rows = edges.where(F.col("edge_type").isin(*kinds)).select("from_id", "to_id").distinct()
    back = rows.select(F.col("to_id").alias("from_id"), F.col("from_id").alias("to_id"))
    return rows.where("from_id < to_id").join(back, ["from_id", "to_id"], "left_semi")
