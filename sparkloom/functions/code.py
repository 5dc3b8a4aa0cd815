r"""Symbols, imports, routes and framework hints out of whole source texts.

A rule is a pattern over the whole text, so what it matches may run over several lines. The text is split by the pattern, and the ends of line in
the pieces before a hit, summed up, give its line: one pass over the texts makes a row for each hit, and only these rows are
shuffled. All expressions are Spark's own. A file (path, language, text) is one row; null texts have no hits.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.graph import shuffled, staged
from .text import app_route, django_route, without_comments

SCRIPT = ("typescript", "javascript")
#: Symbol rules of each language in the order they are tried: (languages, kind, pattern, groups the name may be in).
SYMBOLS = (
    (SCRIPT, "function", r"export\s+(?:async\s+)?function\s+(\w+)", (1,)),
    (SCRIPT, "local function", r"(?:^|\n)\s*(?:async\s+)?function\s+(\w+)", (1,)),
    (SCRIPT, "class", r"export\s+class\s+(\w+)|(?:^|\n)\s*class\s+(\w+)", (1, 2)),
    (SCRIPT, "interface", r"export\s+interface\s+(\w+)|interface\s+(\w+)", (1, 2)),
    (SCRIPT, "type", r"export\s+type\s+(\w+)|type\s+(\w+)\s*=", (1, 2)),
    (SCRIPT, "const", r"export\s+(?:const|let|var)\s+(\w+)|(?:^|\n)\s*(?:const|let|var)\s+(\w+)\s*=", (1, 2)),
    (SCRIPT, "route", r"""(?i)\.(get|post|put|patch|delete|options|head)\s*\(\s*['"`]([^'"`]+)['"`]""", (1, 2)),
    (("python",), "class", r"(?m)^class\s+(\w+)", (1,)),
    (("python",), "function", r"(?m)^(?:async\s+)?def\s+(\w+)", (1,)),
    (("rust",), "module", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", (1,)),
    (("rust",), "function", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+(\w+)", (1,)),
    (("rust",), "struct", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", (1,)),
    (("rust",), "trait", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?trait\s+(\w+)", (1,)),
    (("rust",), "enum", r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?enum\s+(\w+)", (1,)),
    (("rust",), "impl", r"(?m)^\s*impl(?:<[^>]+>)?\s+(?:(\w+)\s+for\s+)?(\w+)", (1, 2)),
    (("go",), "function", r"(?m)^func\s+(?:\((\w+)\s+\*?(\w+)\)\s+)?(\w+)", (2, 3)),
    (("go",), "struct", r"(?m)^type\s+(\w+)\s+(struct|interface)", (1,)),
    (("go",), "const", r"(?m)^(?:const|var)\s+(\w+)", (1,)),
)
#: Import rules (languages, pattern, groups of the source, groups of the specifiers); those of a Go block are tried inside it.
IMPORTS = (
    (SCRIPT, r"""(?:import\s+(?:type\s+)?(?:([\w*\s{},]+)\s+from\s+)?['"]([^'"]+)['"]|require\s*\(\s*['"]([^'"]+)['"]\s*\))""", (2, 3), (1,)),
    (("python",), r"(?m)^(?:from\s+([\w.]+)\s+import\s+(.+)|import\s+([\w.,\s]+))", (1, 3), (2, 3)),
    (("rust",), r"(?m)^\s*use\s+([^;]+);", (1,), (1,)),
    (("go",), r'(?m)^import\s+(?:(\w+)\s+)?"([^"]+)"', (2,), (1, 2)),
    (("go",), r"import\s*\(([\s\S]*?)\)", (), ()),
)
GO_IMPORT = r'(?:(\w+)\s+)?"([^"]+)"'
#: Names that a const rule passes over.
NO_CONSTS = ("require", "module", "exports")
#: Fixed values: (framework, pattern, group of the method, group of the path, group of the handler or None, confidence, pattern the whole text must have).
ROUTES = (
    ("express", r"""(?i)(?:app|router|server|fastify)\s*\.\s*(get|post|put|patch|delete|options|head|all)\s*\(\s*['"`]([^'"`]+)['"`]""", 1, 2, None, "confirmed", None),
    ("express", r"""(?i)\.route\s*\(\s*['"`]([^'"`]+)['"`]\s*\)\s*\.\s*(get|post|put|patch|delete)""", 2, 1, None, "confirmed", None),
    ("flask", r"""(?i)@(?:app|router|bp|blueprint)\.(get|post|put|patch|delete|route)\s*\(\s*['"]([^'"]+)['"]""", 1, 2, None, "confirmed", None),
    ("django", r"""(?:path|re_path|url)\s*\(\s*r?['"]([^'"]+)['"]""", 1, 1, None, "strongly_inferred", "urlpatterns"),
    ("axum", r"""\.route\s*\(\s*"([^"]+)"\s*,\s*(get|post|put|patch|delete)\s*\(\s*([a-zA-Z0-9_:]+)""", 2, 1, 3, "confirmed", None),
    ("actix", r"""#\[(get|post|put|patch|delete)\s*\(\s*"([^"]+)"\s*\)\s*\]""", 1, 2, None, "confirmed", None),
    ("actix", r"""(?i)web::resource\s*\(\s*"([^"]+)"\s*\)[\s\S]{0,80}?web::(get|post|put|patch|delete)""", 2, 1, None, "strongly_inferred", None),
)
#: Fixed value: the functions that an app folder's route, page and layout files export for their methods.
EXPORTED_VERB = r"export\s+(?:async\s+)?function\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
#: Fixed value: functions that may be components.
COMPONENT = r"(?:export\s+default\s+function\s+(\w+)|export\s+function\s+([A-Z]\w*)|function\s+([A-Z]\w*)\s*\([^)]*\)\s*(?::\s*JSX\.Element|\s*\{))"
#: Words of which each route pattern needs one, lower-cased; none: any text is tried.
ROUTE_WORDS = (("app", "router", "server", "fastify"), (".route",), ("@app.", "@router.", "@bp.", "@blueprint."), (), (".route",), ("#[",), ("web::resource",))
#: Framework hints (id, pattern of the text, pattern of the path or None, pattern of a sure text or None: always, confidence otherwise, evidence or None: the path).
FRAMEWORKS = (
    ("nextjs", r"""from\s+['"]next(\/|\z)|require\(['"]next""", r"/app/.*page\.(t|j)sx?\z", r"""from\s+['"]next""", "strongly_inferred", None),
    ("react", r"""from\s+['"]react['"]|from\s+['"]react\/""", r"\.(tsx|jsx)\z", r"""from\s+['"]react""", "weakly_inferred", None),
    ("express", r"""from\s+['"]express['"]|require\(['"]express['"]\)""", None, None, None, "import express"),
    ("fastify", r"""from\s+['"]fastify['"]|require\(['"]fastify['"]\)""", None, None, None, "import fastify"),
    ("fastapi", r"(?i)from\s+fastapi|import\s+fastapi", None, None, None, "import fastapi"),
    ("flask", r"(?i)from\s+flask|import\s+flask", None, None, None, "import flask"),
    ("django", r"(?i)from\s+django|import\s+django|urlpatterns\s*=", None, "urlpatterns", "strongly_inferred", None),
    ("axum", r"use\s+axum|axum::", None, None, None, "use axum"),
    ("actix", r"use\s+actix_web|actix_web::", None, None, None, "use actix_web"),
)
#: Words of which each framework's pattern needs one, lower-cased.
FRAMEWORK_WORDS = {"nextjs": ("next",), "react": ("react",), "express": ("express",), "fastify": ("fastify",), "fastapi": ("fastapi",), "flask": ("flask",), "django": ("django", "urlpatterns"), "axum": ("axum",), "actix": ("actix_web",)}


def tells(text: Column, lower: Column, pattern: str, words: tuple[str, ...]) -> Column:
    """Whether the pattern is found; where none of the words is, it is not tried, as looking for a word is far cheaper."""
    found = text.rlike(pattern)
    return reduce(lambda x, y: x | y, (F.contains(lower, F.lit(w)) for w in words)) & found if words else found


def line_ends(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))


def hits(files: DataFrame, rules: list[tuple[Column, str]]) -> DataFrame:
    """(path, rule, place, hit, line) of all matches of the rules' patterns (condition on the file, pattern), rule and place from 0; hit is what was matched."""
    kind = "array<struct<rule:int,place:int,hit:string,before:int>>"

    def of(rule: int, when: Column, pattern: str) -> Column:
        # a lambda's variable is worked out once; what is behind the last hit is not searched a second time
        between = lambda hits: F.slice(F.split("text", pattern, F.size(hits) + 1), 1, F.size(hits))
        paired = lambda hits: F.zip_with(hits, between(hits), lambda h, b: F.struct(h.alias("hit"), line_ends(b).alias("before")))
        each = F.transform(F.array(F.regexp_extract_all("text", F.lit(pattern), F.lit(0))), paired)[0]
        each = F.transform(each, lambda x, k: F.struct(F.lit(rule).alias("rule"), k.alias("place"), x["hit"].alias("hit"), x["before"].alias("before")))
        return F.when(when & F.col("text").isNotNull(), each).otherwise(F.array().cast(kind))

    files = files.withColumn("of", F.xxhash64("text"))  # before the hits, so that no hit carries its text
    rows = files.select("path", "of", F.inline(F.concat(*(of(k, when, p) for k, (when, p) in enumerate(rules)))))
    earlier = Window.partitionBy("path", "of", "rule").orderBy("place")
    line = F.sum("before").over(earlier) + F.coalesce(F.sum(line_ends(F.col("hit"))).over(earlier.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + 1
    return rows.select("path", "rule", "place", "hit", line.cast("int").alias("line"))


def part(pattern: str, *groups: int) -> Column:
    """The first of the groups that has a text in the hit, else null."""
    return F.coalesce(*(F.nullif(F.regexp_extract("hit", pattern, g), F.lit("")) for g in groups), F.lit(None).cast("string"))


def by_rule(values: list[Column]) -> Column:
    return reduce(lambda out, kv: F.when(F.col("rule") == kv[0], kv[1]).otherwise(out), enumerate(values), F.lit(None))


def symbols(files: DataFrame) -> DataFrame:
    """(path, line_number, kind, name, exported, signature, place) of files; place orders a file's symbols by rule and text.

    A script's function without export is left out if one of its name came before. Methods are named with their type.
    """
    found = hits(files, [(F.col("language").isin(*langs), p) for langs, _, p, _ in SYMBOLS])
    names, kinds, exported, signed = [], [], [], []
    for langs, kind, p, groups in SYMBOLS:
        name, first, none = part(p, *groups), part(p, 1), F.lit(None).cast("string")
        out, shown, sign = F.lit(True), F.lit(kind), none
        if langs == SCRIPT:
            out = first.isNotNull() if kind != "route" else F.lit(False)
            if kind == "function":
                sign = F.col("hit")
            if kind == "local function":
                shown, out = F.lit("function"), F.lit(False)
            if kind == "route":
                name = F.concat(F.upper(part(p, 1)), F.lit(" "), part(p, 2))
        elif langs == ("python",) and kind == "function":
            out, sign = ~F.startswith(name, F.lit("_")), F.col("hit")
        elif langs == ("rust",):
            out = F.contains("hit", F.lit("pub")) if kind != "impl" else F.lit(False)
            if kind == "function":
                sign = F.trim(F.regexp_replace("hit", r"^\s+", ""))
            if kind == "impl":
                name = F.concat_ws(" for ", part(p, 1), part(p, 2))
        elif langs == ("go",):
            if kind == "function":
                shown, sign = F.when(first.isNotNull(), "method").otherwise("function"), F.col("hit")
                name = F.concat_ws(".", F.when(first.isNotNull(), part(p, 2)), part(p, 3))
                out = part(p, 3).rlike("^[A-Z]")
            else:
                out = name.rlike("^[A-Z]")
                if kind == "struct":
                    shown = part(p, 2)
        names.append(name), kinds.append(shown), exported.append(out), signed.append(sign)
    rows = found.select("path", F.col("line").alias("line_number"), by_rule(kinds).alias("kind"), by_rule(names).alias("name"), by_rule(exported).alias("exported"), by_rule(signed).alias("signature"), F.struct("rule", "place").alias("place"))
    consts = {k for k, (langs, kind, _, _) in enumerate(SYMBOLS) if langs == SCRIPT and kind == "const"}
    rows = rows.where(~(F.col("place.rule").isin(*consts) & F.col("name").isin(*NO_CONSTS)))
    local = F.col("place.rule") == next(k for k, (_, kind, _, _) in enumerate(SYMBOLS) if kind == "local function")
    same = Window.partitionBy("path", "name", F.col("place.rule") <= 1).orderBy("place")  # exported functions come first
    return rows.withColumn("nth", F.row_number().over(same)).where(~local | (F.col("nth") == 1)).drop("nth")


def imports(files: DataFrame) -> DataFrame:
    """(path, line_number, source, specifier, specifiers); all of a Go block have the block's line."""
    found = hits(files, [(F.col("language").isin(*langs), p) for langs, p, _, _ in IMPORTS])
    block = len(IMPORTS) - 1
    plain = found.where(F.col("rule") < block)
    source = by_rule([part(p, *s) for _, p, s, _ in IMPORTS[:block]])
    spec = by_rule([F.coalesce(part(p, *s), F.lit("*" if k == 0 else "")) for k, (_, p, _, s) in enumerate(IMPORTS[:block])])
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    several = F.when(F.col("rule") == 1, F.transform(F.split("specifier", ","), trim)).otherwise(F.array("specifier"))
    plain = plain.select("path", F.col("line").alias("line_number"), "rule", trim(source).alias("source"), trim(spec).alias("specifier")).select("path", "line_number", "source", "specifier", several.alias("specifiers"))
    inner = found.where(F.col("rule") == block).select("path", "line", F.explode(F.regexp_extract_all(F.regexp_extract("hit", IMPORTS[block][1], 1), F.lit(GO_IMPORT), F.lit(0))).alias("hit"))
    named = part(GO_IMPORT, 1, 2)
    return plain.unionByName(inner.select("path", F.col("line").alias("line_number"), part(GO_IMPORT, 2).alias("source"), named.alias("specifier"), F.array(named).alias("specifiers")))


def first_line(text: Column, hit: Column) -> Column:
    """The line where hit stands first in text, 1 if it doesn't."""
    return line_ends(F.left(text, F.greatest(F.position(hit, text) - 1, F.lit(0)))) + 1


def framework_routes(files: DataFrame) -> DataFrame:
    """(path, line_number, framework, method, route, handler, confidence, rule) of files (path, text), with the routes that app folders imply.

    Patterns read the text without comments; a route's line is that where its text stands first. All rules are tried in one pass.
    """
    code = files.where("text is not null").select("path", "text", tells(F.col("text"), F.lower("text"), "(?i)fastapi", ("fastapi",)).alias("fastapi"), F.explode(F.array(without_comments(F.col("text")))).alias("code")).withColumn("lower", F.lower("code"))
    places, pages = F.col("path").rlike(r"/(page|layout|route)\.[tj]sx?\z"), F.col("path").rlike(r"/page\.[tj]sx?\z")
    tried = [(k if k < 2 else k + 2, p, F.lit(True) if needs is None else F.contains("code", F.lit(needs)), ROUTE_WORDS[k]) for k, (_, p, *_, needs) in enumerate(ROUTES)]
    kind = "array<struct<rule:int,hit:string,line:int>>"

    def of(rule: int, pattern: str, when: Column, words: tuple[str, ...] = ()) -> Column:
        found = F.regexp_extract_all("code", F.lit(pattern), F.lit(0))
        return F.when(when & tells(F.col("code"), F.col("lower"), pattern, words), F.transform(found, lambda h: F.struct(F.lit(rule).alias("rule"), h.alias("hit"), first_line(F.col("text"), h).alias("line")))).otherwise(F.array().cast(kind))

    page = F.when(pages, F.array(F.struct(F.lit(3).alias("rule"), F.lit("").alias("hit"), F.lit(1).alias("line")))).otherwise(F.array().cast(kind))
    rows = code.select("path", "fastapi", F.inline(F.concat(of(2, EXPORTED_VERB, places), page, *(of(*t) for t in tried))))

    by, verb, at, handler, sure = {}, {}, {}, {}, {}
    for k, (name, p, method, route, handled, confidence, _) in enumerate(ROUTES):
        k = k if k < 2 else k + 2
        by[k], verb[k], at[k], sure[k] = F.lit(name), F.upper(F.regexp_extract("hit", p, method)), F.regexp_extract("hit", p, route), F.lit(confidence)
        handler[k] = F.regexp_extract("hit", p, handled) if handled else F.lit(None).cast("string")
        if name == "express":
            by[k] = F.when(F.col("hit").rlike("(?i)fastify"), "fastify").otherwise("express")
        if name == "flask":
            by[k], verb[k] = F.when(F.col("fastapi"), "fastapi").otherwise("flask"), F.when(verb[k] == "ROUTE", "GET").otherwise(verb[k])
        if name == "django":
            at[k], verb[k] = django_route(at[k]), F.lit("ANY")
    exported = F.regexp_extract("hit", EXPORTED_VERB, 1)
    for k, method, handled in ((2, exported, exported), (3, F.lit("GET"), F.lit("page"))):
        by[k], verb[k], at[k], handler[k], sure[k] = F.lit("nextjs"), method, app_route(F.col("path")), handled, F.lit("strongly_inferred")
    pick = lambda of_rule: by_rule([of_rule[k] for k in range(len(of_rule))])
    return rows.select("path", F.col("line").alias("line_number"), pick(by).alias("framework"), pick(verb).alias("method"), pick(at).alias("route"), pick(handler).alias("handler"), pick(sure).alias("confidence"), "rule").distinct()


def routes(files: DataFrame) -> DataFrame:
    """framework_routes() without the order of rules."""
    return framework_routes(files).drop("rule").distinct()


def merged_routes(found: DataFrame) -> DataFrame:
    """One row of each (path, method, route, line): the surest one, then the first framework."""
    rank = F.array_position(F.array(F.lit("confirmed"), F.lit("strongly_inferred")), F.col("confidence"))
    best = F.min_by(F.struct("framework", "handler", "confidence"), F.struct(rank, "framework", "handler")).alias("best")
    return found.groupBy("path", "method", "route", "line_number").agg(best).select("path", "line_number", "method", "route", "best.*")


def frameworks(files: DataFrame) -> DataFrame:
    """(path, framework, confidence, evidence) of the frameworks that a file's text or its path hints at."""
    files = files.select("path", F.coalesce("text", F.lit("")).alias("text"), F.lower(F.coalesce("text", F.lit(""))).alias("lower"))
    text, path = F.col("text"), F.col("path")
    found = []
    for name, p, by_path, sure, otherwise, evidence in FRAMEWORKS:
        confidence = F.when(text.rlike(sure), "confirmed").otherwise(otherwise) if sure else F.lit("confirmed")
        told = F.array(F.lit(evidence) if evidence else path)
        found.append(F.when(tells(text, F.col("lower"), p, FRAMEWORK_WORDS[name]) | (path.rlike(by_path) if by_path else F.lit(False)), F.struct(F.lit(name).alias("framework"), confidence.alias("confidence"), told.alias("evidence"))))
    return files.select("path", F.inline(F.array_compact(F.array(*found))))


def analysis(files: DataFrame) -> dict[str, DataFrame]:
    """symbols, imports, routes and frameworks of files, with what frameworks add to the symbols of a file.

    A framework's route is a symbol, exported, signed by the framework and its handler, unless the file has a route of that name; so is a component of a file
    with a hint of react or nextjs, unless the file has any symbol of that name. Go files get no routes of frameworks.
    """
    own = staged(symbols(files))  # used more than once below
    framed = staged(framework_routes(files.where("language <> 'go'")))
    name = F.concat("method", F.lit(" "), "route")
    sign = F.concat_ws(":", "framework", "handler")
    added = framed.groupBy("path", name.alias("name")).agg(F.min_by(F.struct("line_number", sign.alias("signature")), F.struct("rule", "line_number")).alias("r"))
    added = added.join(shuffled(own.where("kind = 'route'").select("path", "name")), ["path", "name"], "left_anti")
    columns = ["path", "line_number", "kind", "name", "exported", "signature"]
    added = added.select("path", F.col("r.line_number").alias("line_number"), F.lit("route").alias("kind"), "name", F.lit(True).alias("exported"), F.col("r.signature").alias("signature"))
    every = own.select(columns).union(added)
    # a hint is a matter of the file's own text and path, so no text has to meet the hints
    ui = reduce(lambda x, y: x | y, (tells(F.col("text"), F.col("text"), p, FRAMEWORK_WORDS[name]) | F.col("path").rlike(by_path) for name, p, by_path, *_ in FRAMEWORKS if name in ("react", "nextjs")))
    shown = hits(files, [((F.col("language") != "go") & ui, COMPONENT)]).select("path", "line", "place", part(COMPONENT, 1, 2, 3).alias("name"), part(COMPONENT, 1, 2).isNotNull().alias("exported"))
    shown = shown.groupBy("path", "name").agg(F.min_by(F.struct("line", "exported"), "place").alias("c")).join(shuffled(every.select("path", "name")), ["path", "name"], "left_anti")
    every = every.union(shown.select("path", "c.line", F.lit("function"), "name", "c.exported", F.lit("react-component")))
    scripted = own.where("kind = 'route'").select("path", "line_number", F.lit(None).cast("string").alias("framework"), F.substring_index("name", " ", 1).alias("method"), F.expr("substr(name, position(' ', name) + 1)").alias("route"), F.lit(None).cast("string").alias("handler"), F.lit(None).cast("string").alias("confidence"))
    return {"symbols": every, "imports": imports(files), "routes": merged_routes(framed.drop("rule").union(scripted)), "frameworks": frameworks(files)}
