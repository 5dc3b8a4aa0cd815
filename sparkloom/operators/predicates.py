"""Filters and classifiers of files, symbols and memory rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import any_of, escaped_like, first_of

#: Names ignored by default, beside the project's own folder.
DEFAULT_IGNORES = (
    "node_modules", ".git", "dist", "build", "out", "coverage", ".turbo", ".next", ".nuxt", ".svelte-kit", "target", "vendor", "__pycache__", ".venv", "venv",
    ".cache", "tmp", "temp",
)

#: Test files, by who asks. Fixed values.
TEST_FILES = {
    "graph": r"\.(test|spec)\.|_test\.|(^|/)test_",
    "review": r"\.(test|spec)\.|_test\.",
    "inventory": r"\.(test|spec)\.|_test\.|(^|/)tests?/",
    "unused": r"(?i)\.(test|spec)\.|/(__tests__|__mocks__|fixtures|testdata|snapshots)/|/(dist|build|coverage|\.next)/",
}
#: Classes of paths in the order they are tried.
MIGRATIONS = (
    ("migration_dir", r"(?i)migrations?/|/migrate/"), ("timestamped_migration", r"(?i)^(?=.*migrat).*\d{8,}.*\.(sql|ts|js)$"),
    ("prisma_migration", r"(?i)prisma/migrations"), ("drizzle_migration", r"(?i)drizzle.*migrat"), ("alembic", r"(?i)alembic/versions"),
)
MODELS = (
    ("prisma_schema", r"(?i)schema\.prisma$"), ("models_path", r"(?i)models?\.(ts|js|py)$|/models?/"),
    ("drizzle_or_schema", r"(?i)drizzle.*schema|^(?=.*(db|drizzle|sql)).*schema\.ts$"), ("entity", r"(?i)entities?/|entity\.(ts|py)$"),
)
#: Patterns of paths and names.
SENSITIVE = r"(?i)(^|/)(\.env($|\.)|.*secrets?.*|.*credentials?.*|.*\.pem$|.*\.key$|id_rsa|id_ed25519|.*\.p12$|.*\.pfx$|keystore|auth\.json|service-account.*\.json)"
ENTRY = r"(?i)(^|/)(index|main|mod|app|server|cli|bin)\.(ts|tsx|js|jsx|mjs|cjs|rs|go|py)$"
ENTRY_FOLDER = r"(?i)/(bin|scripts|src/bin)/"
ENTRY_NAMES = ("default", "main", "run")
CONVENTION = r"^(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|default|middleware|layout|loading|error|notFound)$"
SCHEMA_FILE = r"(?i)schema|migrations?/|\.sql$|\.prisma$"
#: Generated artifacts.
GENERATED = (
    r"(^|/)dist/", r"(^|/)build/", r"(^|/)\.next/", r"(^|/)out/", r"(^|/)coverage/", r"\.min\.(js|css)$", r"(^|/)pnpm-lock\.yaml$",
    r"(^|/)package-lock\.json$", r"(^|/)yarn\.lock$", r"(^|/)Cargo\.lock$", r"\.generated\.",
)
DOCS = r"(?i)\.(md|mdx|rst|txt)$"


def ignored(path: Column, patterns: list[str], defaults: tuple[str, ...] = DEFAULT_IGNORES, own_folder: str | None = None) -> Column:
    """Whether any rule (or the project's own folder, where its state is kept) ignores the path: /anchored, *.ext, a whole segment, **/tail, else a plain substring; ! is skipped."""
    out = F.lit(False)
    parts = F.split(path, "/")
    for raw in (*defaults, *([own_folder] if own_folder else []), *(p.strip() for p in patterns)):
        p = raw.replace("\\", "/").rstrip("/")
        if not p or p[0] in "#!":
            continue
        if p.startswith("/"):
            hit = (path == p[1:]) | F.startswith(path, F.lit(p[1:] + "/"))
        elif p.startswith("*."):
            hit = F.endswith(path, F.lit(p[1:]))
        elif "**/" in p:
            tail = p.rsplit("**/", 1)[-1]
            hit = F.endswith(path, F.lit(tail)) | F.array_contains(parts, tail.split("/")[0]) | F.contains(path, F.lit(p))
        else:
            hit = F.contains(path, F.lit(p))  # a whole segment or a leading folder is a substring too
        out = out | hit
    return out


def not_ignored(files: DataFrame, patterns: list[str]) -> DataFrame:
    return files.where(~ignored(F.col("path"), patterns))


def path_contains(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return files.where(F.contains(F.lower("path"), F.lit(query.lower()))).orderBy("path").limit(limit)


def name_search(symbols: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return symbols.where(escaped_like(F.col("name"), query)).orderBy("name", "id").limit(limit)


def definitions(symbols: DataFrame, name: str) -> DataFrame:
    """Of the first 20 fuzzy matches those equal to name if there are any, else the first 5."""
    fuzzy = name_search(symbols, name, 20)
    everything = Window.partitionBy()  # 20 rows
    marked = fuzzy.withColumns({"exact": F.col("name") == name, "any": F.max(F.col("name") == name).over(everything), "place": F.row_number().over(Window.orderBy("name", "id"))})
    return marked.where(F.when(F.col("any"), F.col("exact")).otherwise(F.col("place") <= 5)).drop("exact", "any", "place")


def by_column(rows: DataFrame, column: str, value, newest: str | None = None, limit: int | None = None) -> DataFrame:
    rows = rows if value is None else rows.where(F.col(column) == value)
    rows = rows.orderBy(F.desc(newest), "id") if newest else rows
    return rows if limit is None else rows.limit(limit)


def import_mentions(imports: DataFrame, name: str, limit: int = 100) -> DataFrame:
    """Files whose import records mention name anywhere."""
    return imports.where(F.contains(F.concat_ws("|", "source", "specifier"), F.lit(name))).select("file_path").distinct().orderBy("file_path").limit(limit)


def exports_by_kind(symbols: DataFrame) -> DataFrame:
    return symbols.where(F.col("kind").rlike("(?i)export|function|class|const|interface|type"))


def memory_search(memory: DataFrame, query: str, limit: int = 50) -> DataFrame:
    hit = escaped_like(F.col("title"), query) | escaped_like(F.col("content"), query) | escaped_like(F.col("tags"), query)
    return memory.where(hit).orderBy(F.desc("updated_at"), "id").limit(limit)


def decision_search(decisions: DataFrame, query: str) -> DataFrame:
    """Decisions (title, decision) that hold the query in either; case is ignored."""
    q = F.lit(query.lower())
    return decisions.where(F.contains(F.lower("title"), q) | F.contains(F.lower("decision"), q))


def test_files(files: DataFrame, kind: str = "inventory") -> DataFrame:
    return files.where(F.col("path").rlike(TEST_FILES[kind]))


def stem_related(files: DataFrame, path: str) -> DataFrame:
    """Test files whose path holds the file name of path without its extension."""
    name = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    return files.where(F.col("path").rlike(TEST_FILES["review"]) & F.contains("path", F.lit(name)) & (F.col("path") != path))


def schema_files(files: DataFrame) -> DataFrame:
    return files.where(F.col("path").rlike(SCHEMA_FILE))


def classified(files: DataFrame, ladder: tuple[tuple[str, str], ...]) -> DataFrame:
    return files.select("path", first_of(F.col("path"), ladder).alias("kind")).where("kind is not null")


def model_symbols(files: DataFrame, symbols: DataFrame, n_files: int = 40, limit: int = 80) -> DataFrame:
    models = classified(files, MODELS).orderBy("path").limit(n_files).select("path")
    found = symbols.join(models, symbols["file_path"] == models["path"], "left_semi")
    hit = F.col("kind").rlike("(?i)model|entity|table|schema|collection") | F.col("name").rlike("Model|Entity|Table")
    return found.where(hit).orderBy("file_path", "line", "id").limit(limit)


def sensitive_files(files: DataFrame, limit: int = 80) -> DataFrame:
    reason = F.when(F.col("path").rlike(SENSITIVE), "path_pattern_sensitive").when(
        F.col("path").rlike(r"(?i)\.env") & ~F.col("path").rlike(r"(?i)\.example|\.sample|\.template"), "env_file_not_example")
    return files.select("path", reason.alias("reason")).where("reason is not null").orderBy("path").limit(limit)


def is_entry(path: Column, name: Column | None = None) -> Column:
    """Whether a file, or a symbol of this name, is where a program starts."""
    hit = path.rlike(ENTRY) | path.rlike(ENTRY_FOLDER)
    return hit if name is None else hit | name.isin(*ENTRY_NAMES)


def path_roles(files: DataFrame) -> DataFrame:
    """Entry points, generated artifacts, documents and tests, as flags."""
    p = F.col("path")
    return files.select("path", is_entry(p).alias("entry"), any_of(p, GENERATED).alias("generated"), p.rlike(DOCS).alias("docs"), p.rlike(SENSITIVE).alias("secret"),
                        *(p.rlike(x).alias(f"test_{k}") for k, x in TEST_FILES.items()))


def first_package(packages: DataFrame, name: str) -> DataFrame:
    """The first package of that name, path or path end."""
    hit = (F.col("name") == name) | (F.col("path") == name) | F.endswith("path", F.lit("/" + name))
    return packages.where(hit).orderBy("path").limit(1)


