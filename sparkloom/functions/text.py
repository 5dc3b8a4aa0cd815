"""Scalar expressions over paths, names, commands and text lines; all built-in and in whole-stage codegen where Spark can."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = ("unknown", "weakly_inferred", "strongly_inferred", "confirmed")


def any_of(c: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def first_of(c: Column, ladder: tuple[tuple[str, str], ...], otherwise: str | None = None) -> Column:
    """The label of the first pattern that c matches."""
    out = F.when(c.rlike(ladder[0][1]), ladder[0][0])
    for label, pattern in ladder[1:]:
        out = out.when(c.rlike(pattern), label)
    return out.otherwise(F.lit(otherwise))


# ---- paths

def posix(c: Column) -> Column:
    return F.replace(c, F.lit("\\"), F.lit("/"))


def basename(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def dirname(c: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(c, r"^(.*/)[^/]*$", 1), "/$", "")


def extension(c: Column) -> Column:
    """Lower-case last extension with its dot, '' if there is none."""
    return F.lower(F.regexp_extract(basename(c), r"(\.[^.]*)$", 1))


def stem(c: Column) -> Column:
    return F.regexp_replace(basename(c), r"\.[^.]*$", "")


def folded(c: Column) -> Column:
    """A path without '.', '' and '..' parts; '..' at the root is dropped."""
    step = lambda acc, p: F.when((p == ".") | (p == ""), acc).when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(c, "/"), F.array().cast("array<string>"), step), "/")


def node_id(path: Column) -> Column:
    """A bare path is a file node; what has a colon is a node already."""
    return F.when(F.contains(path, F.lit(":")), path).otherwise(F.concat(F.lit("file:"), path))


def node_path(node: Column) -> Column:
    return F.when(F.startswith(node, F.lit("file:")), F.substring(node, 6, 1 << 30)).otherwise(node)


# ---- ids

def symbol_id(path: Column, name: Column, line: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws(":", path, name, line.cast("string"))), 1, 16)


def edge_id(a: Column, b: Column, kind: Column) -> Column:
    return F.substring(F.sha1(F.concat_ws("|", a, b, kind)), 1, 20)


# ---- names and scores

def escaped_like(c: Column, query: str) -> Column:
    """Substring match that ignores case; % and _ in the query are wildcards, a backslash is itself."""
    return c.ilike("%" + query.replace("\\", "\\\\") + "%")


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(c) / 4)).cast("long")


def slug(c: Column, longest: int = 40) -> Column:
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", ""), 1, longest)


def match_score(c: Column, query: str) -> Column:
    """100 if equal, 50 if contained, else 10 for each word of the query that is contained; case is ignored."""
    low, q = F.lower(c), query.lower()
    words = sum((F.when(F.contains(low, F.lit(w)), 10).otherwise(0) for w in q.split()), F.lit(0))
    return F.when(low == q, 100).when(F.contains(low, F.lit(q)), 50).otherwise(words)


def any_term(c: Column, query: str) -> Column:
    out = F.lit(False)
    for w in query.lower().split():
        out = out | F.contains(F.lower(c), F.lit(w))
    return out


def imported_names(specifier: Column) -> Column:
    """Names a specifier may bring in: the first of a braced list, and a trailing identifier."""
    cleaned = F.trim(F.element_at(F.split(F.regexp_replace(specifier, r"[{}\s*]", ""), ","), 1))
    trailing = F.regexp_extract(specifier, r"(?:as\s+)?(\w+)\s*$", 1)
    return F.filter(F.array(cleaned, trailing), lambda x: x != "")


def entropy(c: Column) -> Column:
    """Shannon entropy in bits of the characters of c; 0 for an empty one. Characters are sorted once and equal ones counted in one pass."""
    chars = F.sort_array(F.filter(F.split(c, ""), lambda x: x != ""))
    share = lambda n: F.when(n > 0, n * F.log2(n)).otherwise(0.0)

    def step(state: Column, x: Column) -> Column:
        same = state["x"] == x
        return F.struct(x.alias("x"), F.when(same, state["n"] + 1).otherwise(1.0).alias("n"), (state["sum"] + F.when(same, 0.0).otherwise(share(state["n"]))).alias("sum"))

    start = F.struct(F.lit("").alias("x"), F.lit(0.0).alias("n"), F.lit(0.0).alias("sum"))
    n = F.length(c).cast("double")
    total = F.aggregate(chars, start, step, lambda state: state["sum"] + share(state["n"]))
    return F.when(n > 0, F.log2(n) - total / n).otherwise(0.0)


def app_route(path: Column) -> Column:
    """The route of a page, layout or route file: what is below the last app folder (all of the path, if there is none), without file name and (group) parts."""
    inner = F.regexp_extract(F.concat(F.lit("/"), path), r"^.*/app(/.*)$", 1)
    folder = F.regexp_replace(F.when(inner != "", inner).otherwise(F.concat(F.lit("/"), path)), r"/(page|layout|route|loading|error|default)\.[tj]sx?\z", "")
    parts = F.filter(F.split(folder, "/"), lambda x: (x != "") & ~x.rlike(r"^\([^)]+\)"))
    return F.concat(F.lit("/"), F.array_join(parts, "/"))


def django_route(c: Column) -> Column:
    """A leading ^ and a trailing $ taken off, a slash put before."""
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(c, r"^\^", ""), r"\$$", ""))


def json_at(c: Column, dotted: str) -> Column:
    """The value at a dotted path of JSON text as text; null where there is none."""
    return F.get_json_object(c, "$" + "".join(f"['{part}']" for part in dotted.split(".")))


def release_version(manifest: Column, cargo: Column, tag: Column) -> Column:
    """The version of a manifest's JSON, else of a Cargo file's text, else the tag."""
    own = F.regexp_extract(cargo, r'(?m)^version\s*=\s*"([^"]+)"', 1)
    return F.coalesce(json_at(manifest, "version"), F.when(own != "", own), F.when(F.trim(tag) != "", F.trim(tag)))


def without_comments(c: Column) -> Column:
    blocks = F.when(F.contains(c, F.lit("/*")), F.regexp_replace(c, r"(?s)/\*.*?\*/", "")).otherwise(c)
    return F.when(F.contains(c, F.lit("//")) | F.contains(c, F.lit("/*")), F.regexp_replace(blocks, r"(?m)^\s*//.*$", "")).otherwise(c)


# ---- commands

#: Script categories in the order they are tried (name pattern, command pattern).
SCRIPT_CATEGORIES = (
    ("build", r"^(build|compile|bundle)", r"\b(tsc|vite build|next build|cargo build)\b"),
    ("test", r"^(test|spec|jest|vitest|pytest)", r"\b(vitest|jest|pytest|go test)\b"),
    ("lint", r"lint|eslint|prettier|format", r"\b(eslint|prettier|ruff)\b"),
    ("typecheck", r"typecheck|type-check|check-types", r"tsc.*--noemit"),
    ("dev", r"^(dev|watch)", r"\b(--watch|nodemon|vite\b(?! build))\b"),
    ("start", r"^(start|serve|preview)", None),
    ("clean", r"clean|rimraf|rm -rf", r"\brimraf\b"),
    ("docs", r"doc|vitepress|storybook", None),
    ("release", r"release|publish|changeset|version", None),
)


def script_category(name: Column, command: Column) -> Column:
    out = None
    for label, by_name, by_command in SCRIPT_CATEGORIES:
        hit = F.lower(name).rlike(by_name)
        if by_command and label != "typecheck":
            hit = hit | F.lower(command).rlike(by_command)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise("other")


#: Fixed values: (level 0-3, reason, pattern, destructive, network, writes).
COMMAND_RISKS = (
    (3, "Recursive/forced delete", r"\brm\s+(-[a-zA-Z]*f|-[a-zA-Z]*r)|rimraf|Remove-Item\s+.*-Recurse|del\s+/s", 1, 0, 0),
    (3, "Destructive git rewrite", r"\bgit\s+push\s+.*--force|\bgit\s+reset\s+--hard|\bgit\s+clean\s+-f", 1, 0, 0),
    (3, "Destructive database DDL", r"\bDROP\s+(TABLE|DATABASE|SCHEMA)\b|\bTRUNCATE\b", 1, 0, 0),
    (3, "Dangerous permission or pipe-to-shell", r"\bchmod\s+-R\s+777|\bcurl\s+[^\n]*\|\s*(ba)?sh", 0, 0, 0),
    (2, "Publishes package to registry", r"\bnpm\s+publish|\bpnpm\s+publish|\byarn\s+publish|twine\s+upload|cargo\s+publish", 0, 1, 1),
    (2, "Docker prune/force remove", r"\bdocker\s+(system\s+)?prune|\bdocker\s+rm\s+-f", 1, 0, 0),
    (1, "Network request", r"\b(curl|wget|Invoke-WebRequest)\b", 0, 1, 0),
    (1, "Installs dependencies (mutates lockfile/node_modules)", r"\bnpm\s+i(nstall)?|\bpnpm\s+i(nstall)?|\byarn\s+add|\bpip\s+install", 0, 1, 1),
    (1, "Skips confirmation or safety hooks", r"\b--force\b|\b-f\b|\b--yes\b|\b-y\b|\b--no-verify\b", 0, 0, 0),
    (2, "May mutate database schema", r"\bmigrate\b|\bprisma\s+db\s+push|\bdrizzle-kit\s+push", 0, 0, 1),
)
VERIFY = r"\b(test|lint|typecheck|build|tsc|vitest|eslint)\b"
LEVELS = ("low", "medium", "high", "critical")


def command_risk(command: Column) -> Column:
    """(level, reasons, destructive, network, writes, confidence) of a shell command."""
    cmd = F.trim(command)
    hits = [cmd.rlike("(?i)" + p) for _, _, p, *_ in COMMAND_RISKS]
    level = F.greatest(F.lit(0), *(F.when(h, r[0]).otherwise(0) for h, r in zip(hits, COMMAND_RISKS)), F.lit(0))
    usual = cmd.rlike("(?i)" + VERIFY) & (level == 0)
    reasons = F.array_compact(F.array(*(F.when(h, r[1]) for h, r in zip(hits, COMMAND_RISKS)), F.when(usual, "Typical local verify/build command")))
    flag = lambda k: sum((F.when(h, r[k]).otherwise(0) for h, r in zip(hits, COMMAND_RISKS)), F.lit(0)) > 0
    return F.struct(
        F.element_at(F.array(*map(F.lit, LEVELS)), level + 1).alias("level"), reasons.alias("reasons"), flag(3).alias("destructive"), flag(4).alias("network"),
        flag(5).alias("writes"), F.when(F.size(reasons) > 0, "strongly_inferred").otherwise("weakly_inferred").alias("confidence"))


# ---- frames

def frame_path(c: Column) -> Column:
    """A frame's file with slashes; a file URL without its scheme, a drive letter with its colon."""
    slashed = posix(c)
    bare = F.when(F.startswith(slashed, F.lit("file:")), F.regexp_replace(F.substring(slashed, 6, 1 << 30), "^/{2,3}", "")).otherwise(slashed)
    return F.when(bare.rlike("^[A-Za-z]/"), F.concat(F.left(bare, F.lit(1)), F.lit(":"), F.substring(bare, 2, 1 << 30))).otherwise(bare)


def internal_frame(c: Column) -> Column:
    """Whether a frame is the runtime's or a package's own."""
    folders = F.split(c, "/")
    within = F.array_contains(F.slice(folders, 2, F.greatest(F.size(folders) - 2, F.lit(0))), "internal")  # neither first nor last
    packaged = c.contains("node_modules/")
    return packaged | within | c.rlike(r"^(?:node:|<|(?i:native|unknown))")


# ---- globs

def glob_regex(pattern: str) -> str:
    """An ownership glob as an anchored pattern: ** any, * within a folder; a plain name also as a last part; x/ a folder."""
    p = pattern.replace("\\", "/").removeprefix("/")
    if p.endswith("/"):
        return "^" + _quoted(p[:-1]) + "(/.*)?$"
    body = "".join(".*" if part == "**" else "[^/]*" if part == "*" else _quoted(part) for part in _glob_parts(p))
    if "/" in p:
        return f"^{body}$"
    return f"^{body}$|(^|/){body}$|/{_quoted(p.replace('*', ''))}$"


def _glob_parts(p: str) -> list[str]:
    out, k = [], 0
    while k < len(p):
        star = 2 if p.startswith("**", k) else 1 if p[k] == "*" else 0
        out.append(p[k:k + max(1, star)])
        k += max(1, star)
    return out


def _quoted(s: str) -> str:
    return "".join("\\" + c if c in r".+^${}()|[]\?*" else c for c in s)
