"""Composite queries: index delta, graph build, context pack, review, search, health."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.code import by_rule, hits, part
from ..functions.extract import TO_DO, added_line_findings, shell_commands
from ..functions.text import any_term, dirname, edge_id, escaped_like, folded, match_score, node_id, node_path, token_estimate
from ..operators.graph import impact, staged
from ..operators.joins import import_targets, mutual_pairs, tests_of, touched_symbols
from ..operators.matching import containing
from ..operators.predicates import GENERATED, TEST_FILES
from ..operators.prefix import within_budget

#: Token budgets.
BUDGETS = {"tiny": 2_000, "small": 8_000, "normal": 32_000, "large": 100_000, "unlimited": None}


def index_delta(files: DataFrame, known: DataFrame) -> DataFrame:
    """(path, action): files to read again (new or another hash) and known paths to delete."""
    both = files.select("path", F.col("hash").alias("now")).join(known.select("path", F.col("hash").alias("was")), "path", "full")
    action = F.when(F.col("now").isNull(), "delete").when(F.col("was").isNull() | (F.col("was") != F.col("now")), "read")
    return both.select("path", action.alias("action")).where("action is not null")


def keep_latest(old: DataFrame, new: DataFrame, key: str, version: str, created: str | None = None) -> DataFrame:
    """Upsert: the newest row of each key; created, if given, stays the oldest one's."""
    every = old.unionByName(new)
    best = F.max_by(F.struct(*(c for c in every.columns)), version).alias("row")
    made = every.groupBy(key).agg(best, *([F.min(created).alias("__created")] if created else []))
    cols = [F.col("__created").alias(c) if c == created else F.col(f"row.{c}").alias(c) for c in every.columns]
    return made.select(*cols)


def upserted_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by id: of an id in both the new confidence and meta, of several new ones the last by confidence."""
    fresh = new.groupBy("id").agg(F.max_by(F.struct("from_id", "to_id", "edge_type", "confidence", "meta"), "confidence").alias("e")).select("id", "e.*")
    return old.join(fresh, "id", "left_anti").unionByName(fresh.join(old.select("id", F.struct("from_id", "to_id", "edge_type").alias("o")), "id", "left").select(
        "id", *(F.coalesce(f"o.{c}", c).alias(c) for c in ("from_id", "to_id", "edge_type")), "confidence", "meta"))


def replace_rows(old: DataFrame, new: DataFrame, changed: DataFrame, key: str = "file_path") -> DataFrame:
    """Rows of changed keys replaced by the new ones."""
    return old.join(changed.select(F.col("path").alias(key)), key, "left_anti").unionByName(new)


def build_graph(files: DataFrame, symbols: DataFrame, imports: DataFrame) -> DataFrame:
    """Edges with id and confidence: contains, routes, imports, dependencies, tests."""
    file_node = F.concat(F.lit("file:"), F.col("file_path"))
    contains = symbols.select(file_node.alias("from_id"), F.concat(F.lit("symbol:"), "id").alias("to_id"), F.lit("CONTAINS").alias("edge_type"), F.lit("confirmed").alias("confidence"))
    routes = symbols.where(F.col("kind") == "route").select(file_node, F.concat(F.lit("route:"), "name"), F.lit("ROUTES_TO"), F.lit("strongly_inferred"))
    targets = import_targets(imports, files)
    to = F.when(F.startswith("target", F.lit("pkg:")), F.col("target")).when(F.col("known"), node_id(F.col("target"))).otherwise(F.concat(F.lit("unresolved:"), "target"))
    sure = F.when(F.col("known"), "confirmed").otherwise("weakly_inferred")
    linked = [targets.select(file_node, to, F.lit(k), sure) for k in ("IMPORTS", "DEPENDS_ON")]
    tests = targets.where(F.col("known") & ~F.startswith("target", F.lit("pkg:")) & F.col("file_path").rlike(TEST_FILES["graph"])).select(file_node, to, F.lit("TESTS"), F.lit("strongly_inferred"))
    every = reduce(DataFrame.union, [contains, routes, *linked, tests])
    made = every.groupBy("from_id", "to_id", "edge_type").agg(F.min("confidence").alias("confidence"), F.lit(None).cast("string").alias("meta"))
    return made.withColumn("id", edge_id(F.col("from_id"), F.col("to_id"), F.col("edge_type")))


def context_items(files: DataFrame, symbols: DataFrame, memory: DataFrame, query: str) -> DataFrame:
    """(id, kind, title, content, score, tokens, node, place): candidate symbols, files and memory; place orders those of equal score, node is that of the graph or null."""
    q = F.col
    found = symbols.where(escaped_like(q("name"), query)).orderBy("name", "id").limit(40)
    signature = F.coalesce(F.concat(F.lit("\n"), "signature"), F.lit("")) if "signature" in symbols.columns else F.lit("")
    a = found.select(
        F.concat(F.lit("symbol:"), "id").alias("id"), F.lit("symbol").alias("kind"), q("name").alias("title"), F.concat("kind", F.lit(" "), "name", F.lit(" @ "), "file_path", F.lit(":"), q("line").cast("string"), signature).alias("content"),
        (match_score(q("name"), query) + F.when(q("exported"), 5).otherwise(0)).alias("score"), F.concat(F.lit("symbol:"), "id").alias("node"), F.struct(F.lit(1).alias("k"), F.lit(0).cast("long").alias("n"), q("name").alias("s"), q("id").alias("id")).alias("place"))
    b = files.where(any_term(q("path"), query)).select(
        F.concat(F.lit("file:"), "path"), F.lit("file"), q("path"), F.concat(F.lit("File "), "path", F.lit(" ("), F.coalesce("language", F.lit("unknown")), F.lit(", "), q("size").cast("string"), F.lit(" bytes)")),
        match_score(q("path"), query) + 2, F.concat(F.lit("file:"), "path"), F.struct(F.lit(2), F.lit(0).cast("long"), q("path"), F.lit("")))
    c = memory.where(escaped_like(q("title"), query) | escaped_like(q("content"), query) | escaped_like(q("tags"), query)).orderBy(F.desc("updated_at"), "id").limit(20)
    c = c.select(F.concat(F.lit("memory:"), "id"), F.lit("memory"), q("title"), F.concat(F.lit("# "), "title", F.lit("\n"), "content"), match_score(q("title"), query) + 3, F.lit(None).cast("string"), F.struct(F.lit(3), -q("updated_at"), F.lit(""), q("id")))
    every = a.union(b).union(c)
    return every.select("id", "kind", "title", "content", "score", token_estimate(q("content")).alias("tokens"), "node", "place")


def neighbourhood(edges: DataFrame, top: DataFrame) -> DataFrame:
    """The candidate that tells what is one step from the best one's node (top: one row): as long as that list written as indented JSON, scored above it."""
    near = impact(edges, top.select(F.col("node").alias("seed")), 1).select("direction", "node").distinct()
    written = F.length(F.to_json(F.array("node"))) - 2  # as a JSON string
    sizes = near.agg(*(f(F.when(F.col("direction") == d, written)).alias(f"{d}_{n}") for d in ("dependents", "dependencies") for n, f in (("n", F.count), ("chars", F.sum))))
    empty = len(json.dumps({"node": "", "dependents": [], "dependencies": [], "confidence": "strongly_inferred"}, indent=2)) - 2
    listed = sum((F.when(F.col(f"{d}_n") > 0, F.col(f"{d}_chars") + 6 * F.col(f"{d}_n") + 2).otherwise(0) for d in ("dependents", "dependencies")), F.lit(0))
    chars = F.lit(empty) + F.length(F.to_json(F.array("top.node"))) - 2 + listed
    one = top.select(F.struct("node", "score").alias("top")).where("top.node is not null").crossJoin(sizes)  # one row each
    return one.select(
        F.concat(F.lit("graph:"), "top.node").alias("id"), F.lit("graph").alias("kind"), F.concat(F.lit("Impact of "), "top.node").alias("title"), F.lit(None).cast("string").alias("content"), (F.col("top.score") + 1).alias("score"),
        F.greatest(F.lit(1), F.ceil(chars / 4)).cast("long").alias("tokens"), "top.node", F.struct(F.lit(4).alias("k"), F.lit(0).cast("long").alias("n"), F.lit("").alias("s"), F.lit("").alias("id")).alias("place"))


def context_pack(files: DataFrame, symbols: DataFrame, memory: DataFrame, query: str, budget: int | None = BUDGETS["normal"], edges: DataFrame | None = None) -> DataFrame:
    """(id, kind, title, content, score, tokens, used): the best candidates while they fit the budget, with the best one's neighbourhood where edges are given.

    Equal scores keep the order symbols, files, memory, graph. The neighbourhood's content is left to who asks for its node; its tokens count.
    """
    items = staged(context_items(files, symbols, memory, query))
    if edges is not None:
        best = items.orderBy(F.desc("score"), "place").limit(1)
        items = items.unionByName(neighbourhood(edges, best))
    return within_budget(items, budget, "score", "tokens", "place").drop("node", "place")


CODE_FILES = r"\.(ts|tsx|js|jsx|rs|py|go)$"
#: Files whose change may tell a secret.
SECRET_CHANGE = r"(?i)\.(env|pem|key)$|(?-i)(^|/)\.env(\.|$)"


def review(changed: DataFrame, added: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame, diff: DataFrame | None = None, many: int = 10, wide: int = 40) -> DataFrame:
    """(path, line_number, category, severity, message, confidence) findings of a change: paths (path), added lines (path, line_number, line), all of the diff's lines (line; the added ones if not given).

    Of the change as a whole: too many paths, notes to do, routes changed but no document. Of a path: generated, secret or document; what its added lines look like; many
    dependents, symbols touched, no tests (if it is indexed code), not indexed (code that is not in files).
    """
    p = F.col("path")
    changed = staged(changed.select("path").where("path is not null").distinct())
    added = staged(added.join(changed, "path", "left_semi").select("path", "line_number", "line"))

    def said(rows: DataFrame, category: str, severity: str, message, confidence: str) -> DataFrame:
        return rows.select("path", F.lit(None).cast("int").alias("line_number"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), (F.lit(message) if isinstance(message, str) else message).alias("message"), F.lit(confidence).alias("confidence"))

    of_lines = added_line_findings(added)
    size = changed.agg(F.count("*").alias("n"), F.coalesce(F.bool_or(p.rlike(r"(?i)\.(md|mdx)$")), F.lit(False)).alias("documented"))  # one row
    out = [
        said(size.where(F.col("n") > wide).withColumn("path", F.lit("(changeset)")), "scope", "warn", F.concat(F.lit("Large changeset: "), F.col("n").cast("string"), F.lit(" paths")), "confirmed"),
        said(changed.where(reduce(lambda a, b: a | b, [p.rlike(x) for x in GENERATED])), "generated", "info", "Looks like a generated/lock/build artifact", "strongly_inferred"),
        said(changed.where(p.rlike(SECRET_CHANGE)), "security", "risk", "Possible secrets file in changeset", "strongly_inferred"),
        said(changed.where(p.rlike(r"(?i)\.(md|mdx)$")), "docs", "info", "Documentation file changed", "confirmed"), of_lines]
    indexed = changed.join(files.select("path"), "path", "left_semi")
    fan = impact(edges, indexed.select(F.concat(F.lit("file:"), "path").alias("seed")), 1).where("direction = 'dependents'").groupBy(node_path(F.col("seed")).alias("path")).agg(F.count("*").alias("n"))
    out.append(said(fan.where(F.col("n") > many), "impact", "warn", F.concat(F.lit("High fan-in: "), F.col("n").cast("string"), F.lit(" dependents")), "strongly_inferred"))
    ranges = added.groupBy("path").agg(F.min("line_number").alias("lo"), F.max("line_number").alias("hi")).join(indexed, "path", "left_semi")
    touched = touched_symbols(ranges, symbols).groupBy("path").agg(F.slice(F.sort_array(F.collect_list(F.struct("line", "name", "id"))), 1, 8).alias("s"))
    out.append(said(touched, "general", "info", F.concat(F.lit("Hunks touch symbols: "), F.array_join(F.transform("s", lambda x: x["name"]), ", ")), "strongly_inferred"))
    code = indexed.where(p.rlike(CODE_FILES) & ~p.rlike(TEST_FILES["review"]))
    tests = files.where(p.rlike(TEST_FILES["review"])).select(F.col("path").alias("text"))
    named = code.withColumn("needle", F.regexp_replace("path", r"\.[^.]+$", ""))
    tested = containing(named, tests).join(named, "needle").select("path")
    by_edge = edges.where("edge_type = 'TESTS'").select(node_path(F.col("from_id")).alias("text"), node_path(F.col("to_id")).alias("path")).join(tests, "text", "left_semi").select("path")
    out.append(said(code.join(tested.union(by_edge), "path", "left_anti"), "tests", "warn", "No related test files inferred for this change", "weakly_inferred"))
    out.append(said(changed.where(p.rlike(CODE_FILES)).join(files.select("path"), "path", "left_anti"), "general", "info", "Not in the index yet", "confirmed"))
    noted = (diff if diff is not None else added).agg(F.coalesce(F.bool_or(F.col("line").rlike(TO_DO)), F.lit(False)).alias("noted")).where("noted")  # one row
    out.append(said(noted.withColumn("path", F.lit("(diff)")), "general", "info", "TODO/FIXME markers present in diff", "confirmed"))
    routed = of_lines.agg(F.coalesce(F.bool_or(F.col("category") == "api"), F.lit(False)).alias("api")).crossJoin(size).where("api and not documented")  # one row each
    out.append(said(routed.withColumn("path", F.lit("(docs)")), "docs", "info", "API/route-like changes without documentation file updates", "weakly_inferred"))
    return reduce(DataFrame.unionByName, out)


def search_docs(docs: DataFrame, query: str, limit: int = 40) -> DataFrame:
    """(path, line_number, preview) of the first lines of documents (path, text) that hold the query: those below docs, then apps/docs, then the root's own four."""
    p = F.col("path")
    place = F.when(p.rlike(r"(?i)^docs/.*\.mdx?$"), 0).when(p.rlike(r"(?i)^apps/docs/.*\.mdx?$"), 1).when(p.isin("README.md", "CHANGELOG.md", "CONTRIBUTING.md", "AGENTS.md"), 2)
    some = docs.withColumn("place", place).where(F.col("place").isNotNull() & ~p.rlike("node_modules|dist/"))
    lines = some.select("path", "place", F.posexplode(F.split("text", "\r?\n")).alias("k", "line")).where(F.contains(F.lower("line"), F.lit(query.lower())))
    return lines.orderBy("place", "path", "k").limit(limit).select("path", (F.col("k") + 1).alias("line_number"), F.substring(F.trim("line"), 1, 200).alias("preview"))


def unified_search(files: DataFrame, symbols: DataFrame, memory: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """(kind, id, title): up to limit hits of each kind; a document's hit is a line of it."""
    a = symbols.where(escaped_like(F.col("name"), query)).orderBy("name", "id").limit(limit).select(F.lit("symbol").alias("kind"), "id", F.col("name").alias("title"))
    b = files.where(F.contains(F.lower("path"), F.lit(query.lower()))).orderBy("path").limit(limit).select(F.lit("file"), F.col("path"), F.col("path"))
    c = memory.where(escaped_like(F.col("title"), query) | escaped_like(F.col("content"), query)).orderBy(F.desc("updated_at"), "id").limit(limit).select(F.lit("memory"), "id", "title")
    d = search_docs(files, query, limit).select(F.lit("doc"), F.concat("path", F.lit(":"), F.col("line_number").cast("string")), "preview")
    return a.union(b).union(c).union(d)


def health_checks(files: DataFrame, symbols: DataFrame, edges: DataFrame, git: bool = False) -> DataFrame:
    """(name, ok, weight, detail) of a repository's checks. The scripts check is there only if files (path, text) hold a package.json at the root; an unreadable one fails it."""
    has_text = "text" in files.columns
    package = F.max(F.when(F.col("path") == "package.json", F.coalesce("text", F.lit("")))) if has_text else F.lit(None).cast("string")
    f = files.agg(F.count("*").alias("files"), F.count_if(F.col("path") == "README.md").alias("readme"), F.count_if(F.col("path").rlike(TEST_FILES["inventory"])).alias("tests"), package.alias("package"))
    s, e = symbols.agg(F.count("*").alias("symbols")), edges.agg(F.count("*").alias("edges"))
    cycles = mutual_pairs(edges).agg(F.count("*").alias("cycles"))
    one = f.crossJoin(s).crossJoin(e).crossJoin(cycles)  # one row each
    scripts = F.from_json(F.get_json_object("package", "$.scripts"), "map<string,string>")
    named = reduce(lambda a, b: a | b, (F.coalesce(F.element_at(scripts, F.lit(k)) != "", F.lit(False)) for k in ("test", "build", "lint")))
    n = lambda *parts: F.concat(*(F.col(x).cast("string") if x in ("files", "symbols", "edges", "cycles", "tests") else F.lit(x) for x in parts))
    rows = [
        ("index", F.col("files") > 0, 20, n("files", " files, ", "symbols", " symbols")), ("graph", F.col("edges") > 0, 15, n("edges", " edges")), ("git", F.lit(git), 10, F.lit("git repository" if git else "not a git repo or git unavailable")),
        ("readme", F.col("readme") > 0, 5, F.when(F.col("readme") > 0, "README.md found").otherwise("missing README.md")),
        ("cycles", F.col("cycles") == 0, 15, F.when(F.col("cycles") == 0, "no mutual file import pairs found").otherwise(n("cycles", " mutual import pairs"))), ("tests", F.col("tests") > 0, 15, n("tests", " test-related files indexed"))]
    checks = [F.struct(F.lit(name).alias("name"), ok.alias("ok"), F.lit(w).alias("weight"), detail.alias("detail")) for name, ok, w, detail in rows]
    told = F.when(scripts.isNull(), "package.json unreadable or without scripts").otherwise(F.concat(F.lit("scripts: "), F.array_join(F.slice(F.map_keys(scripts), 1, 8), ", ")))
    checks.append(F.when(F.col("package").isNotNull(), F.struct(F.lit("scripts").alias("name"), named.alias("ok"), F.lit(10).alias("weight"), told.alias("detail"))))
    return one.select(F.inline(F.array_compact(F.array(*checks))))


def broken_commands(commands: DataFrame, files: DataFrame, known: tuple[str, ...], program: str) -> DataFrame:
    """(path, command, problem) of commands (path, command): unknown subcommands of program, and ./paths given to node or a package manager that are neither at the root nor beside the document."""
    sub = F.regexp_extract("command", rf"^{program}\s+(\w+)", 1)
    unknown = commands.where((sub != "") & ~sub.isin(*known)).select("path", "command", F.concat(F.lit("unknown subcommand '"), sub, F.lit("'")).alias("problem"))
    local = commands.withColumn("target", F.regexp_replace(F.regexp_extract("command", r"(?:node|pnpm|npm|npx)\s+\./(\S+)", 1), r"""[`'".,;:)\]]+$""", "")).where("target <> ''")
    tried = local.select("path", "command", "target", F.explode(F.array_distinct(F.array(folded(F.col("target")), folded(F.concat(dirname(F.col("path")), F.lit("/"), "target"))))).alias("at"))
    there = tried.join(files.select(F.col("path").alias("at")), "at", "left_semi").select("path", "command", "target")
    gone = local.join(there.distinct(), ["path", "command", "target"], "left_anti").select("path", "command", F.concat(F.lit("path not found: ./"), "target").alias("problem"))
    return unknown.union(gone)


def ci_commands(workflows: DataFrame) -> DataFrame:
    """(path, kind, value) of the run: and uses: lines of workflow files."""
    return ci_steps(workflows).select("path", "kind", "value")


#: Keys two spaces in that are no jobs.
NO_JOBS = ("on", "env", "defaults", "concurrency", "permissions", "name")
CI_PATTERNS = {"job": r"(?m)^\s{2}([a-zA-Z0-9_-]+):\s*$", "run": r"run:\s*[|>]?\s*(.+)", "uses": r"uses:\s*(.+)"}


def ci_steps(workflows: DataFrame, most_runs: int = 40, most_uses: int = 20) -> DataFrame:
    """(path, job, line, kind, place, value) of the first run and uses steps of each workflow file (path, text); job is the last one that begins above the step."""
    found = hits(workflows, [(F.lit(True), p) for p in CI_PATTERNS.values()])
    value = by_rule([F.regexp_replace(part(p, 1), r"^\s+|\s+\z", "") for p in CI_PATTERNS.values()])
    kind = F.element_at(F.array(*map(F.lit, CI_PATTERNS)), F.col("rule") + 1)
    found = found.select("path", "line", "place", kind.alias("kind"), F.coalesce(value, F.lit("")).alias("value")).where(~((F.col("kind") == "job") & F.col("value").isin(*NO_JOBS)))
    above = Window.partitionBy("path").orderBy("line", (F.col("kind") != "job").cast("int"), "place").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("job", F.last(F.when(F.col("kind") == "job", F.col("value")), ignorenulls=True).over(above))
    return found.where((F.col("kind") == "run") & (F.col("place") < most_runs) | (F.col("kind") == "uses") & (F.col("place") < most_uses)).select("path", "job", "line", "kind", "place", "value")


def ci_equivalents(workflows: DataFrame) -> DataFrame:
    """(path, job, line, kind, ci_step, local_command, confidence) of the steps of workflow files (path, text, scripts: the project's own, a map): what to run at one's own machine.

    The first rule that fits a run step decides; a script that the step names goes before all of them, the first in the map's order.
    """
    scripts = workflows.select("path", F.coalesce("scripts", F.create_map().cast("map<string,string>")).alias("scripts"))
    steps = ci_steps(workflows).join(scripts, "path")
    run, known = F.col("value"), F.col("scripts")
    has = lambda name: F.coalesce(F.element_at(known, name) != "", F.lit(False))
    own = F.element_at(F.split(F.regexp_replace(run, r"^pnpm (?:run )?", ""), r"\s"), 1)
    choice = lambda command, sure: F.struct(command.alias("command"), F.lit(sure).alias("confidence"))
    ruled = (
        F.when(run.rlike(r"\b(npm|pnpm|yarn)\s+test\b") & has(F.lit("test")), choice(F.lit("pnpm test"), "confirmed"))
        .when(run.rlike(r"\bbuild\b") & has(F.lit("build")), choice(F.lit("pnpm run build"), "strongly_inferred"))
        .when(run.rlike(r"\blint\b") & (has(F.lit("lint")) | has(F.lit("lint:check"))), choice(F.when(has(F.lit("lint")), "pnpm run lint").otherwise("pnpm run lint:check"), "strongly_inferred"))
        .when(run.rlike("vitest|jest|pytest|cargo test|go test"), choice(F.substring(F.trim(F.regexp_replace(run, r"\$\{\{.*?\}\}", "")), 1, 120), "weakly_inferred"))
        .when(has(own), choice(F.concat(F.lit("pnpm run "), own), "confirmed")).otherwise(choice(F.lit(None).cast("string"), "weakly_inferred")))
    named = F.get(F.filter(F.map_keys(known), lambda k: F.contains(run, F.concat(F.lit("run "), k)) | F.contains(run, F.concat(F.lit("pnpm "), k)) | F.endswith(run, k)), F.lit(0))
    ran = F.when(named.isNotNull(), choice(F.concat(F.lit("pnpm run "), named), "confirmed")).otherwise(ruled)
    used = F.when(run.rlike("(?i)setup-node"), choice(F.lit("node --version && corepack enable"), "weakly_inferred")).when(run.rlike("(?i)setup-pnpm"), choice(F.lit("pnpm --version"), "weakly_inferred")).otherwise(choice(F.lit(None).cast("string"), "unknown"))
    shown = F.when(F.col("kind") == "run", F.substring(run, 1, 160)).otherwise(F.concat(F.lit("uses: "), F.substring(run, 1, 100)))
    made = steps.withColumn("local", F.when(F.col("kind") == "run", ran).otherwise(used))
    return made.select("path", "job", "line", "kind", shown.alias("ci_step"), F.col("local.command").alias("local_command"), "local.confidence")


def without_ids(rows: DataFrame, gone: DataFrame, key: str = "id") -> DataFrame:
    """Rows but for those whose key is among gone's; rows without a key stay."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def secret_summary(found: DataFrame) -> DataFrame:
    """(path, label, n, lines) of secret findings: nothing of the matched text, not even its length."""
    return found.groupBy("path", "label").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("line_number")).alias("lines"))


def change_impact(changed: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(path, dependents, dependencies): what is one step away from each changed path (path) that is known; 0 where nothing is."""
    known = changed.select("path").distinct().join(files.select("path"), "path", "left_semi")
    near = impact(edges, known.select(F.concat(F.lit("file:"), "path").alias("seed")), 1).groupBy(F.substring("seed", 6, 1 << 30).alias("path"))
    counts = near.agg(*(F.count_if(F.col("direction") == k).alias(k) for k in ("dependents", "dependencies")))
    return known.join(counts, "path", "left").select("path", *(F.coalesce(k, F.lit(0)).alias(k) for k in ("dependents", "dependencies")))


def change_risks(changed: DataFrame, added: DataFrame, files: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """The review's findings that are more than information."""
    return review(changed, added, files, symbols, edges).where(F.col("severity").isin("risk", "warn"))


def change_tests(changed: DataFrame, files: DataFrame, edges: DataFrame) -> DataFrame:
    """(of, path): the tests of each changed code file."""
    return tests_of(changed.where(F.col("path").rlike(r"\.(ts|tsx|js|jsx|rs|py|go)$")), files, edges)


def change_docs(changed: DataFrame, files: DataFrame, known: tuple[str, ...], program: str) -> DataFrame:
    """Broken commands of the changed documents; of all documents where none changed."""
    docs = files.where(F.col("path").rlike(r"(?i)\.mdx?$"))
    touched = docs.join(changed.select("path"), "path", "left_semi")
    some = touched.agg((F.count("*") > 0).alias("some"))  # one row
    chosen = docs.join(changed.select("path").distinct().withColumn("hit", F.lit(True)), "path", "left").crossJoin(some).where("not some or hit")
    return broken_commands(shell_commands(chosen.select("path", "text")), files, known, program)


def memory_records(given: DataFrame, now_ms=None) -> DataFrame:
    """New memory rows of (type, title, content, tags): an id, tags joined by commas, both times now (in milliseconds; a parameter for tests)."""
    now = F.unix_millis(F.current_timestamp()) if now_ms is None else F.lit(now_ms).cast("long")
    stamp = F.date_format(F.timestamp_millis(now), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX")
    return given.select(F.expr("uuid()").alias("id"), "type", "title", "content", F.array_join("tags", ",").alias("tags"), now.alias("created_at"), now.alias("updated_at"), stamp.alias("written"))
