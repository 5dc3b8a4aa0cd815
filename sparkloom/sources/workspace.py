"""Identity and workspace maps of repositories, many at once, from tables of their files (repo, path, text).

Manifests are aggregated by repository with map-side partials: only the few marker files' texts are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename

#: Folders whose children may be packages.
PACKAGE_FOLDERS = ("packages", "apps", "services", "cli", "servers", "adapters", "fixtures")
#: Dependency of a package manifest to framework.
FRAMEWORKS = {"next": "nextjs", "react": "react", "vue": "vue", "express": "express", "fastify": "fastify", "@nestjs/core": "nestjs"}
#: Marker files of package managers, in order.
MANAGERS = {
    "pnpm": ("pnpm-lock.yaml", "pnpm-workspace.yaml"), "yarn": ("yarn.lock",), "npm": ("package-lock.json",), "bun": ("bun.lockb", "bun.lock"),
    "cargo": ("Cargo.toml",), "go": ("go.mod",), "pip/poetry": ("poetry.lock", "pyproject.toml"),
}
#: Marker files of languages; JavaScript and TypeScript have rules of their own.
LANGUAGES = {"rust": ("Cargo.toml",), "python": ("pyproject.toml", "requirements.txt", "setup.py"), "go": ("go.mod",)}
READ = ("package.json", "Cargo.toml", "pyproject.toml", "requirements.txt")
MANIFEST = "struct<name:string,version:string,private:string,scripts:map<string,string>,dependencies:map<string,string>,devDependencies:map<string,string>>"


def _any(names: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.array_contains("markers", n) for n in names])


def _keys(c: str) -> Column:
    return F.coalesce(F.map_keys(c), F.array().cast("array<string>"))


def project_identity(files: DataFrame) -> DataFrame:
    """(repo, name, languages, frameworks, package_managers, monorepo, git) of each repository.

    Only markers in the root count. A repository without a manifest's name is called by the last part of repo. A manifest that
    isn't JSON counts as a marker without dependencies; null paths and texts count for nothing.
    """
    names = sorted({n for group in (*MANAGERS.values(), *LANGUAGES.values()) for n in group} | {"package.json", "tsconfig.json"})
    path = F.col("path")
    texts = [F.max(F.when(path == n, F.col("text"))).alias(f"t{k}") for k, n in enumerate(READ)]
    made = files.groupBy("repo").agg(
        F.collect_set(F.when(path.isin(*names), path)).alias("markers"), F.coalesce(F.bool_or(F.startswith(path, F.lit("packages/"))), F.lit(False)).alias("folder"),
        F.coalesce(F.bool_or((path == ".git") | F.startswith(path, F.lit(".git/"))), F.lit(False)).alias("git"), *texts)
    made = made.withColumns({"pkg": F.from_json("t0", MANIFEST), "spaces": F.get_json_object("t0", "$.workspaces"), "cargo": F.coalesce("t1", F.lit("")), "py": F.concat_ws("", "t2", "t3")})
    made = made.withColumn("deps", F.array_union(_keys("pkg.dependencies"), _keys("pkg.devDependencies")))
    script = _any(("tsconfig.json", "package.json"))
    languages = [F.when(script & (F.array_contains("deps", "typescript") | _any(("tsconfig.json",))), "typescript"), F.when(script, "javascript")]
    languages += [F.when(_any(marks), name) for name, marks in LANGUAGES.items()]
    frameworks = [F.when(F.array_contains("deps", d), name) for d, name in FRAMEWORKS.items()]
    frameworks += [F.when(F.contains("cargo", F.lit("axum")), "axum"), F.when(F.col("cargo").rlike("actix[-_]web"), "actix")]
    frameworks += [F.when(F.col("py").rlike(f"(?i){n}"), n) for n in ("fastapi", "flask", "django")]
    managers = [F.when(_any(marks), name) for name, marks in MANAGERS.items()]
    spaces = F.col("spaces").isNotNull() & ~F.col("spaces").isin("", "0", "false")
    mono = _any(("pnpm-workspace.yaml",)) | (F.col("folder") & _any(("package.json",))) | F.contains("cargo", F.lit("[workspace]")) | spaces
    return made.select(
        "repo", F.coalesce(F.when(F.col("pkg.name") != "", F.col("pkg.name")), F.when(basename(F.col("repo")) != "", basename(F.col("repo"))), F.lit("project")).alias("name"),
        F.array_compact(F.array(*languages)).alias("languages"), F.array_compact(F.array(*frameworks)).alias("frameworks"),
        F.array_compact(F.array(*managers)).alias("package_managers"), mono.alias("monorepo"), "git")


def assembled(rows: DataFrame, key: str, name: str, *fields: str) -> DataFrame:
    """(key, name): the named fields of each row put into one nested record."""
    return rows.select(key, F.struct(*fields).alias(name))


def workspace_globs(files: DataFrame) -> DataFrame:
    """(repo, glob): the workspaces of the root manifest (a list, or a list under packages) and the list items of the workspace file, once each."""
    spaces = F.get_json_object("text", "$.workspaces")
    listed = F.coalesce(F.from_json(spaces, "array<string>"), F.from_json(F.get_json_object("text", "$.workspaces.packages"), "array<string>"))
    a = files.where("path = 'package.json'").select("repo", F.explode(F.when(F.startswith(spaces, F.lit("[")) | F.startswith(spaces, F.lit("{")), listed)).alias("glob"))
    lines = files.where("path = 'pnpm-workspace.yaml'").select("repo", F.explode(F.split("text", "\r?\n")).alias("line"))
    b = lines.select("repo", F.regexp_extract("line", r"""^\s*-\s*["']?([^"']+)""", 1).alias("glob")).where("glob <> ''")
    return a.union(b).where("glob is not null").distinct()


def workspace_packages(files: DataFrame, most: int = 80) -> DataFrame:
    """(repo, path, kind, name, version, private, scripts, dependencies) of a repository's packages.

    kind npm: the root manifest and those of the children of PACKAGE_FOLDERS; bad JSON is dropped, at most the first `most`
    dependencies are listed. kind cargo: members of a workspace whose own manifest is there.
    """
    at = rf"^(?:(?:{'|'.join(PACKAGE_FOLDERS)})/[^/]+/)?package\.json$"
    folder = F.regexp_replace("path", r"/?package\.json$", "")
    found = files.where(F.col("path").rlike(at)).select("repo", F.when(folder == "", ".").otherwise(folder).alias("path"), F.from_json("text", MANIFEST).alias("m"), F.col("text").rlike(r"^\s*\{").alias("object"))
    deps = F.filter(F.array_union(_keys("m.dependencies"), _keys("m.devDependencies")), lambda d: F.startswith(d, F.lit("@")) | ~F.contains(d, F.lit("/")))
    named = F.coalesce("m.name", F.when(F.col("path") == ".", basename(F.col("repo"))).otherwise(basename(F.col("path"))))
    npm = found.where("object and (m.name is not null or m.version is not null or m.private is not null or m.scripts is not null or m.dependencies is not null or m.devDependencies is not null)").select(
        "repo", "path", F.lit("npm").alias("kind"), named.alias("name"), F.when(F.col("m.version") != "", F.col("m.version")).alias("version"),
        F.coalesce(F.col("m.private") == "true", F.lit(False)).alias("private"), _keys("m.scripts").alias("scripts"), F.slice(deps, 1, most).alias("dependencies"))
    block = F.regexp_extract("text", r"members\s*=\s*\[([^\]]*)\]", 1)
    roots = files.where("path = 'Cargo.toml'").where(F.contains("text", F.lit("[workspace]")))
    members = roots.select("repo", F.explode(F.regexp_extract_all(block, F.lit('"([^"]+)"'), 1)).alias("member"))
    own = files.where(F.endswith("path", F.lit("/Cargo.toml"))).select("repo", F.regexp_replace("path", "/Cargo\\.toml$", "").alias("member"), F.regexp_extract("text", r'(?m)^name\s*=\s*"([^"]+)"', 1).alias("own"))
    none = F.array().cast("array<string>")
    cargo = members.join(own, ["repo", "member"]).select(
        "repo", F.col("member").alias("path"), F.lit("cargo").alias("kind"), F.coalesce(F.when(F.col("own") != "", F.col("own")), basename(F.col("member"))).alias("name"),
        F.lit(None).cast("string").alias("version"), F.lit(False).alias("private"), none.alias("scripts"), none.alias("dependencies"))
    return npm.union(cargo)


def workspace_map(files: DataFrame) -> DataFrame:
    """(repo, packages, globs, monorepo) of each repository: the paths of its packages and its globs, sorted."""
    packages = workspace_packages(files).groupBy("repo").agg(F.sort_array(F.collect_list("path")).alias("packages"), F.count_if(F.col("path") != ".").alias("inner"))
    globs = workspace_globs(files).groupBy("repo").agg(F.sort_array(F.collect_list("glob")).alias("globs"))
    repos = files.groupBy("repo").agg(F.coalesce(F.bool_or(F.col("path") == "pnpm-workspace.yaml"), F.lit(False)).alias("listed"))
    none = F.array().cast("array<string>")
    made = repos.join(packages, "repo", "left").join(globs, "repo", "left")
    mono = F.col("listed") | F.col("globs").isNotNull() | (F.coalesce("inner", F.lit(0)) > 1)
    return made.select("repo", F.coalesce("packages", none).alias("packages"), F.coalesce("globs", none).alias("globs"), mono.alias("monorepo"))
