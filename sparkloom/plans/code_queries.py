"""Queries over source code: files whose texts begin with a head of code of their language, and the same rows in SQL.

The SQL finds hits as the operators do, by the pieces between them, with DuckDB's own regular expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import code as E
from .catalog import Catalog

#: A head of code for each language: every rule occurs, beside near misses. {i} is the document's number.
HEADS = {
    "typescript": """import { a,
  b } from './n{i}'
import def from "react"
const x{i} = require('lib/{i}')
import type { T } from '../t'
import './side'
// an import from nowhere
export async function load{i}() {}
export function again() {}
function again() {}

  async function inner{i}() {}
function inner{i}() {}
myfunction other() {}
export class C{i} {}
class Local{i} {}
subclass Not {}
export interface I{i} {}
interface J{i} {}
export type T{i} = string
type U{i} = number
type without
export const k{i} = 1
let v{i} = 2
let nothing
const module = 3
app.get('/r{i}', h)
router.route('/c{i}').post(h)
x.delete("/d{i}") // y.put('/e')
// app.get('/commented')
export default function Page{i}() {}
function Widget{i}() {
}
""",
    "python": """from fastapi import FastAPI, x as y
import os

class A{i}(B):
    def method(self): pass
async def go{i}(): pass
def _hidden{i}(): pass
@app.get("/p{i}")
@bp.route('/q{i}')
urlpatterns = [path('users/{i}/', v), re_path(r'^item/{i}$', w)]
from a.b import c,  d
x = class_
""",
    "rust": """use std::{io,
  fs};
use axum::Router;

pub(crate) mod m{i};
fn quiet{i}() {}
    pub async fn loud{i}() {}
fn publish() {}
struct S{i};
pub trait T{i} {}
enum E{i} {}
impl<T> Show for S{i} {}
impl S{i} {}
let r = Router::new().route("/ax{i}", get(handlers::h));
#[post("/act{i}")]
web::resource("/res{i}")
  .route(web::put())
unsafe fn not_found() {}
""",
    "go": """package p
import "fmt"
import (
\tlog "a/b{i}"
\t"os"
)
func (s *Server) Run{i}() {}
func helper{i}() {}
type T{i} struct {}
type r{i} interface {}
type Alias = int
const Big{i} = 1
var small = 2
app.get('/not/in/go')
""",
}
HINTS = ("import a from 'next/link'", "require('next')", "from 'nextish'", "from 'react/jsx'", "from 'reactive'", "require('express')", 'from "express"', "import 'express'", "from 'fastify'", "From FastAPI x", "import flask", "urlpatterns =", "from django", "use axum", "axum", "actix_web::x")


def coded(c: Catalog) -> DataFrame:
    """files whose texts begin with a head of code of their language."""
    head = F.lit("")
    for k, v in HEADS.items():
        head = F.when(F.col("language") == k, F.lit(v)).otherwise(head)
    return c.files.withColumn("text", F.concat(F.replace(head, F.lit("{i}"), F.col("doc_id").cast("string")), "text"))


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def coded_sql(where: str = "true") -> str:
    heads = " ".join(f"WHEN '{k}' THEN replace({quoted(v)}, '{{i}}', doc_id::VARCHAR)" for k, v in HEADS.items())
    return f"coded AS (SELECT path, language, doc_id, CASE language {heads} ELSE '' END || text AS text FROM files WHERE {where})"


def hits_sql(rules: list[tuple[str, str]], name: str = "hits") -> str:
    """CTEs with (path, rule, place, hit, line) of rules (condition, pattern) over coded."""
    each = " UNION ALL ".join(f"SELECT path, {k} AS rule, regexp_extract_all(text, {quoted(p)}) AS hits, string_split_regex(text, {quoted(p)}) AS gaps FROM coded WHERE {when}" for k, (when, p) in enumerate(rules))
    ends = "length({0}) - length(replace({0}, chr(10), ''))"
    return f"""{name}_all AS ({each}), {name}_each AS (SELECT path, rule, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS place FROM {name}_all WHERE len(hits) > 0),
{name} AS (SELECT path, rule, place, hit, (1 + sum({ends.format('gap')}) OVER w + coalesce(sum({ends.format('hit')}) OVER (PARTITION BY path, rule ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS line FROM {name}_each WINDOW w AS (PARTITION BY path, rule ORDER BY place))"""


def group(p: str, *groups: int) -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract(hit, {quoted(p)}, {g}), '')" for g in groups) + ", NULL)"


def languages(langs: tuple[str, ...]) -> str:
    return f"language IN ({', '.join(map(quoted, langs))})"


def case(values: list[str]) -> str:
    return "CASE rule " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(values)) + " END"


def symbols_sql() -> str:
    """CTEs with symbols_of (path, line_number, kind, name, exported)."""
    names, kinds, out = [], [], []
    for langs, kind, p, groups in E.SYMBOLS:
        name, shown, exported = group(p, *groups), quoted(kind.removeprefix("local ")), "true"
        if langs == E.SCRIPT:
            exported = f"{group(p, 1)} IS NOT NULL" if kind not in ("route", "local function") else "false"
            name = f"upper({group(p, 1)}) || ' ' || {group(p, 2)}" if kind == "route" else name
        elif langs == ("python",):
            exported = f"NOT starts_with({name}, '_')" if kind == "function" else "true"
        elif langs == ("rust",):
            exported = "contains(hit, 'pub')" if kind != "impl" else "false"
            name = f"concat_ws(' for ', {group(p, 1)}, {group(p, 2)})" if kind == "impl" else name
        else:
            exported = f"regexp_matches({group(p, 3) if kind == 'function' else name}, '^[A-Z]')"
            if kind == "function":
                name, shown = f"concat_ws('.', {group(p, 2)}, {group(p, 3)})", f"CASE WHEN {group(p, 1)} IS NOT NULL THEN 'method' ELSE 'function' END"
            shown = group(p, 2) if kind == "struct" else shown
        names.append(name), kinds.append(shown), out.append(exported)
    return hits_sql([(languages(langs), p) for langs, _, p, _ in E.SYMBOLS]) + f""", named AS (SELECT path, rule, place, line AS line_number, {case(kinds)} AS kind, {case(names)} AS name, {case(out)} AS exported FROM hits),
symbols_of AS (SELECT path, line_number, kind, name, exported FROM (SELECT *, row_number() OVER (PARTITION BY path, name, rule <= 1 ORDER BY rule, place) AS nth FROM named WHERE NOT (rule = 5 AND name IN ('require', 'module', 'exports'))) WHERE rule <> 1 OR nth = 1)"""


def imports_sql() -> str:
    plain = E.IMPORTS[:-1]
    source = case([group(p, *s) for _, p, s, _ in plain])
    spec = case([f"coalesce({group(p, *s)}, {quoted('*' if k == 0 else '')})" for k, (_, p, _, s) in enumerate(plain)])
    return "WITH " + coded_sql() + ", " + hits_sql([(languages(langs), p) for langs, p, _, _ in E.IMPORTS]) + rf""",
inner_hits AS (SELECT path, line, unnest(regexp_extract_all(regexp_extract(hit, {quoted(E.IMPORTS[-1][1])}, 1), {quoted(E.GO_IMPORT)})) AS hit FROM hits WHERE rule = {len(plain)})
SELECT path, line AS line_number, regexp_replace({source}, '^\s+|\s+$', '', 'g') AS source, regexp_replace({spec}, '^\s+|\s+$', '', 'g') AS specifier FROM hits WHERE rule < {len(plain)}
UNION ALL SELECT path, line, {group(E.GO_IMPORT, 2)}, {group(E.GO_IMPORT, 1, 2)} FROM inner_hits"""


def routes_sql() -> str:
    """CTEs with framed (path, line_number, framework, method, route, handler, rule)."""
    each = []
    for k, (name, p, method, route, handler, _, needs) in enumerate(E.ROUTES):
        verb, at, by = f"upper({group(p, method)})", group(p, route), quoted(name)
        if name == "express":
            by = "CASE WHEN regexp_matches(hit, '(?i)fastify') THEN 'fastify' ELSE 'express' END"
        if name == "flask":
            by, verb = "CASE WHEN regexp_matches(text, '(?i)fastapi') THEN 'fastapi' ELSE 'flask' END", f"CASE WHEN {verb} = 'ROUTE' THEN 'GET' ELSE {verb} END"
        if name == "django":
            verb, at = "'ANY'", rf"'/' || regexp_replace(regexp_replace({at}, '^\^', ''), '\$$', '')"
        found = f"SELECT path, text, unnest(regexp_extract_all(code, {quoted(p)})) AS hit FROM uncommented" + (f" WHERE contains(code, {quoted(needs)})" if needs else "")
        each.append(f"SELECT path, text, hit, {by} AS framework, {verb} AS method, {at} AS route, {group(p, handler) if handler else 'NULL'} AS handler, {k if k < 2 else k + 2} AS rule FROM ({found})")
    before = "left(text, greatest(position(hit IN text) - 1, 0))"
    return r"uncommented AS (SELECT path, text, regexp_replace(regexp_replace(text, '(?s)/\*.*?\*/', '', 'g'), '(?m)^\s*//.*$', '', 'g') AS code FROM coded), framed_hits AS (" + " UNION ALL ".join(each) + f"""),
framed AS (SELECT DISTINCT path, (1 + length({before}) - length(replace({before}, chr(10), '')))::INT AS line_number, framework, method, route, handler, rule FROM framed_hits)"""


def analysis_sql(where: str = "true") -> str:
    p = E.COMPONENT
    return "WITH " + coded_sql(where) + ", " + symbols_sql() + ", " + routes_sql() + ", " + hits_sql([("language <> 'go' AND (contains(text, 'react') OR path LIKE '%.tsx')", p)], "shown") + f""",
added AS (SELECT path, name, arg_min(line_number, struct_pack(rule := rule, line_number := line_number)) AS line_number FROM (SELECT *, method || ' ' || route AS name FROM framed WHERE path IN (SELECT path FROM coded WHERE language <> 'go'))
  WHERE (path, name) NOT IN (SELECT (path, name) FROM symbols_of WHERE kind = 'route') GROUP BY path, name),
most AS (SELECT * FROM symbols_of UNION ALL SELECT path, line_number, 'route', name, true FROM added),
parts AS (SELECT path, place, line, {group(p, 1, 2, 3)} AS name, {group(p, 1, 2)} IS NOT NULL AS exported FROM shown)
SELECT path, line_number, kind, name, exported FROM most UNION ALL SELECT path, arg_min(line, place), 'function', name, arg_min(exported, place) FROM parts WHERE (path, name) NOT IN (SELECT (path, name) FROM most) GROUP BY path, name"""


def hints_sql() -> str:
    is_in = lambda *k: f"t IN ({', '.join(quoted(HINTS[x]) for x in k)})"
    return f"""WITH h AS (SELECT path, path LIKE '%.tsx' AS tsx, [{', '.join(map(quoted, HINTS))}][doc_id % {len(HINTS)} + 1] AS t FROM files)
SELECT path, 'nextjs' AS framework, CASE WHEN {is_in(0)} THEN 'confirmed' ELSE 'strongly_inferred' END AS confidence, path AS evidence FROM h WHERE {is_in(0, 1)}
UNION ALL SELECT path, 'react', CASE WHEN {is_in(3, 4)} THEN 'confirmed' ELSE 'weakly_inferred' END, path FROM h WHERE {is_in(3)} OR tsx
UNION ALL SELECT path, 'express', 'confirmed', 'import express' FROM h WHERE {is_in(5, 6)} UNION ALL SELECT path, 'fastify', 'confirmed', 'import fastify' FROM h WHERE {is_in(8)}
UNION ALL SELECT path, 'fastapi', 'confirmed', 'import fastapi' FROM h WHERE {is_in(9)} UNION ALL SELECT path, 'flask', 'confirmed', 'import flask' FROM h WHERE {is_in(10)}
UNION ALL SELECT path, 'django', CASE WHEN {is_in(11)} THEN 'confirmed' ELSE 'strongly_inferred' END, path FROM h WHERE {is_in(11, 12)}
UNION ALL SELECT path, 'axum', 'confirmed', 'use axum' FROM h WHERE {is_in(13)} UNION ALL SELECT path, 'actix', 'confirmed', 'use actix_web' FROM h WHERE {is_in(15)}"""


def register(add) -> None:
    add("v02_imports", lambda c: E.imports(coded(c)).select("path", "line_number", "source", "specifier"), imports_sql())
    add("v03_symbols", lambda c: E.symbols(coded(c)).select("path", "line_number", "kind", "name", "exported"), "WITH " + coded_sql() + ", " + symbols_sql() + " SELECT * FROM symbols_of")
    add("v07_frameworks", lambda c: E.frameworks(c.files.select("path", F.element_at(F.array(*map(F.lit, HINTS)), (F.col("doc_id") % len(HINTS) + 1).cast("int")).alias("text"))).select("path", "framework", "confidence", F.col("evidence")[0].alias("evidence")), hints_sql())
    add("v08_routes", lambda c: E.routes(coded(c)).select("path", "line_number", "framework", "method", "route", "handler"), "WITH " + coded_sql() + ", " + routes_sql() + " SELECT DISTINCT path, line_number, framework, method, route, handler FROM framed")
    add("v09_merged_routes", lambda c: E.merged_routes(E.routes(coded(c))).select("path", "line_number", "framework", "method", "route"), "WITH " + coded_sql() + ", " + routes_sql() + """
SELECT path, line_number, arg_min(framework, struct_pack(unsure := rule IN (5, 8), framework := framework, handler := coalesce(handler, ''))) AS framework, method, route FROM framed GROUP BY path, line_number, method, route""")
    add("v09_analysis_symbols", lambda c: E.analysis(coded(c))["symbols"].select("path", "line_number", "kind", "name", "exported"), analysis_sql())
