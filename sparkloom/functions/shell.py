"""What the words of shell commands are: a fold over the words with the state a reader would keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What programs are.
BINARIES = {
    "node": "Run a Node.js script or module", "npm": "Node package manager", "npx": "Execute a package binary", "pnpm": "Performant npm-compatible package manager", "yarn": "Yarn package manager",
    "bun": "Bun runtime / package manager", "cargo": "Rust package manager and build tool", "go": "Go toolchain", "python": "Python interpreter", "python3": "Python 3 interpreter",
    "pip": "Python package installer", "pytest": "Python test runner", "vitest": "Vitest test runner", "tsc": "TypeScript compiler", "eslint": "ESLint linter", "prettier": "Prettier formatter",
    "docker": "Docker CLI", "git": "Git VCS", "curl": "HTTP client", "wget": "HTTP downloader", "make": "Make build tool", "cmake": "CMake build system", "rustc": "Rust compiler", "deno": "Deno runtime",
}
#: What flags mean.
FLAGS = {
    "-r": "Recursive / run workspace packages (context-dependent)", "--filter": "Limit to matching workspace package(s)", "--frozen-lockfile": "Fail if lockfile would change",
    "--production": "Omit devDependencies", "--watch": "Re-run on file changes", "--coverage": "Collect test coverage", "--json": "Machine-readable JSON output",
    "--staged": "Operate on staged git changes only", "--yes": "Skip interactive confirmation", "-c": "Pass a command string / config (context-dependent)",
    "--noEmit": "Typecheck without emitting files", "--passWithNoTests": "Exit successfully when no tests match",
}
#: Flags that take the next word in any case; flags that take it unless it is a flag; flags that destroy; git's own.
TAKE, MAY_TAKE, DESTROY, GIT_DESTROYS = ("--filter", "-c", "--cwd", "--budget"), ("--package", "--file", "--related"), ("--force", "-f", "--hard"), ("push", "reset", "clean")
MANAGERS, LIFECYCLE, INSTALL = ("pnpm", "npm", "yarn", "bun"), ("run", "test", "build", "start", "dev"), ("install", "i", "add")
DELETES = r"(?i)\brm\b|\brimraf\b|\b--force\b|\bDROP\b"
#: A word: one of the four signs, a quoted string, or what stands between them and blanks. A quote without its other half is no word.
WORD = r"""[|<]|>>?|"[^"]*"|'[^']*'|[^\s|<>"']+"""
TOKEN = "struct<text:string,role:string,meaning:string>"


def shell_words(command: Column) -> Column:
    return F.regexp_extract_all(command, F.lit(WORD), F.lit(0))


def _is_path(t: Column) -> Column:
    return t.rlike(r"^(\.{0,2}/|[A-Za-z]:[\\/])") | t.rlike(r"(?i)\.[a-z]{1,4}\z")


def _meant(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key), otherwise)


def _own_name(t: Column) -> Column:
    return F.regexp_replace(t, r"^.*[\\/]", "")


def explained(rows: DataFrame, command: str = "command", scripts: str | None = None, binaries: dict[str, str] = BINARIES) -> DataFrame:
    """rows with tokens (text, role, meaning), summary, risks, related (script names) and confidence of the command; scripts: a map column of script commands.

    Roles: binary, subcommand, flag, flag_value, path, arg, pipe, redirect, env. The first word that is no env setting or pipe is the binary; words after it
    or after a subcommand are subcommands, unless they look like paths. A flag that takes a value makes the next word that is no sign and no setting
    its value. Values of settings are never kept. A null command has no words.
    """
    names = ("text", "role", "meaning")

    def token(text: Column, role: str | Column, meaning: Column) -> Column:
        return F.struct(text.alias("text"), (F.lit(role) if isinstance(role, str) else role).alias("role"), meaning.alias("meaning"))

    def step(state: Column, x: Column) -> Column:
        t, after, awaited, before = x["t"], x["next"], state["awaited"], state["before"]
        setting = t.rlike("^[A-Z_][A-Z0-9_]*=")
        key = F.substring_index(t, "=", 1)
        first = state["only_settings"]
        follows = before.isin("binary", "subcommand")
        role = (
            F.when(t == "|", "pipe").when(t.isin(">", ">>", "<"), "redirect").when(setting, "env").when(awaited != "", "flag_value").when(F.startswith(t, F.lit("-")), "flag")
            .when(first | (x["i"] == 0), "binary").when(_is_path(t), "path").when(follows, "subcommand").otherwise("arg"))
        meaning = (
            F.when(role == "pipe", "Pipe stdout to the next command").when(role == "redirect", F.when(t == "<", "Redirect stdin from file").otherwise("Redirect stdout to file"))
            .when(role == "env", F.concat(F.lit("Set environment variable "), key, F.lit(" for this command (value omitted)"))).when(role == "flag_value", F.concat(F.lit("Value for "), awaited))
            .when(role == "flag", _meant(FLAGS, t, F.concat(F.lit("Flag "), t))).when(role == "binary", _meant(binaries, _own_name(t), F.concat(F.lit("Executable '"), _own_name(t), F.lit("'"))))
            .when(role == "path", F.concat(F.when(follows, "Path argument: ").otherwise("Path: "), t)).when(role == "subcommand", F.concat(F.lit("Subcommand or script name '"), t, F.lit("'"))).otherwise(F.concat(F.lit("Argument: "), t)))
        takes = t.isin(*TAKE) | t.isin(*MAY_TAKE) & after.isNotNull() & ~F.startswith(after, F.lit("-"))
        return F.struct(
            F.concat(state["tokens"], F.array(token(F.when(role == "env", F.concat(key, F.lit("="))).otherwise(t), role, meaning))).alias("tokens"),
            F.when(role == "flag_value", "").when((role == "flag") & takes, t).otherwise(awaited).alias("awaited"), role.alias("before"), (first & role.isin("env", "pipe")).alias("only_settings"))

    trimmed = F.regexp_replace(F.coalesce(F.col(command), F.lit("")), r"^\s+|\s+\z", "")
    rows = rows.select("*", F.explode(F.array(F.struct(trimmed.alias("trimmed"), shell_words(trimmed).alias("w")))).alias("__c"))
    w = F.col("__c.w")
    each = F.transform(w, lambda t, i: F.struct(t.alias("t"), F.get(w, i + 1).alias("next"), i.alias("i")))
    start = F.struct(F.array().cast(f"array<{TOKEN}>").alias("tokens"), F.lit("").alias("awaited"), F.lit("").alias("before"), F.lit(True).alias("only_settings"))
    rows = rows.select("*", F.explode(F.array(F.aggregate(each, start, step)["tokens"])).alias("tokens"))
    tokens, text = F.col("tokens"), F.col("__c.trimmed")

    def first_of(role: str) -> Column:
        return F.get(F.filter(tokens, lambda x: x["role"] == role), F.lit(0))["text"]

    risky = F.transform(F.filter(tokens, lambda x: (x["role"] == "flag") & x["text"].isin(*DESTROY)), lambda x: F.concat(F.lit("Destructive-looking flag "), x["text"]))
    rows = rows.withColumns({"__bin": F.coalesce(_own_name(first_of("binary")), F.lit("")), "__sub": first_of("subcommand"), "__risky": risky})
    binary, sub = F.col("__bin"), F.col("__sub")
    manager, named = binary.isin(*MANAGERS), F.concat(binary, F.coalesce(F.concat(F.lit(" "), sub), F.lit("")))
    installs = manager & sub.isin(*INSTALL)
    plain = F.array_join(F.transform(F.filter(tokens, lambda x: x["role"].isin("binary", "subcommand")), lambda x: x["text"]), " ")
    summary = (
        F.when(manager & sub.isin(*LIFECYCLE), F.concat(F.lit("Invoke package manager '"), binary, F.lit("' to "), sub, F.lit(" a project script or lifecycle")))
        .when(installs, F.concat(F.lit("Install or add dependencies via "), binary)).when(manager, F.concat(F.lit("Run "), named))
        .when(binary == "git", F.concat(F.lit("Git "), F.coalesce(sub, F.lit("command")))).when(plain != "", plain).otherwise(F.substring(text, 1, 120)))
    risks = F.concat("__risky", F.array_compact(F.array(
        F.when(installs, "May mutate package.json / lockfile and node_modules"), F.when((binary == "git") & sub.isin(*GIT_DESTROYS), F.concat(F.lit("Potentially destructive git operation: "), sub)), F.when(text.rlike(DELETES), "Command may delete or overwrite data"))))
    related = F.array().cast("array<string>")
    if scripts:
        known = F.coalesce(F.col(scripts), F.create_map().cast("map<string,string>"))
        like = F.map_filter(known, lambda name, c: F.contains(c, text) | F.contains(text, c))
        run = F.get(F.filter(F.transform(tokens, lambda x, i: F.struct(*(x[k].alias(k) for k in names), F.get(tokens, i - 1)["text"].alias("prior"))), lambda x: (x["role"] == "subcommand") & (x["prior"] == "run")), F.lit(0))["text"]
        asked = F.when((F.coalesce(sub == "run", F.lit(False)) | binary.isin("npm", "pnpm")) & (F.size(tokens) >= 3) & (F.element_at(known, run) != ""), run)
        related = F.array_distinct(F.concat(F.slice(F.map_keys(like), 1, 10), F.array_compact(F.array(asked))))
        summary = F.when(asked.isNotNull(), F.concat(F.lit("Run package script '"), asked, F.lit("': "), F.element_at(known, asked))).otherwise(summary)
    made = rows.withColumns({"summary": summary, "risks": F.array_distinct(risks), "related": related, "confidence": F.when(F.size(tokens) > 0, "strongly_inferred").otherwise("unknown")})
    return made.drop("__c", "__bin", "__sub", "__risky")
