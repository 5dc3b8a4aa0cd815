"""Operators that SQL doesn't cover, on small frames."""

from pyspark.sql import functions as F

from sparkloom.functions import code as E
from sparkloom.functions import extract as X
from sparkloom.functions import text as T
from sparkloom.operators import graph as G
from sparkloom.operators import joins as J
from sparkloom.operators import windows as W
from sparkloom.plans import pipelines as L
from sparkloom.sources import trees as S
from sparkloom.sources import workspace as R
from sparkloom.streaming import changes as C
from sparkloom.streaming.polling import changes_of, polled_changes


def test_diff_lines(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,3 +1,4 @@\n keep\n-old\n+new\n+more\n keep\n@@ -10,1 +11,1 @@\n-a\n+b"
    rows = spark.createDataFrame([(1, k, s) for k, s in enumerate(text.split("\n"))], "diff_id int, n int, line string")
    got = sorted((r.file, r.op, r.line_number, r.text) for r in W.diff_lines(rows).collect())
    assert got == [("x", "+", 2, "new"), ("x", "+", 3, "more"), ("x", "+", 11, "b"), ("x", "-", 2, "old"), ("x", "-", 10, "a")]


def test_stack_frames(spark):
    text = "\n".join([
        "Error: x", "    at run (/srv/app/a.ts:10:5)", "    at async Foo.bar (C:\\w\\b.js:3:1)", "    at file:///srv/c.mjs:7:2", "    at node:internal/x.js:1:1", "    at new Thing (/srv/node_modules/p/i.js:4)",
        '  File "/p/b.py", line 7, in go', '  File "<stdin>", line 1', "\t/src/c.go:33 +0x1d", "   3: my_crate::run", "             at ./src/main.rs:12:9", "nothing here: 12", "    at native", ""])
    got = X.stack_frames(spark.createDataFrame([(1, text), (2, None)], "id int, text string")).orderBy("n").collect()
    assert [(r.n, r.file, r.line, r.column, r.function, r.dialect) for r in got] == [
        (2, "/srv/app/a.ts", 10, 5, "run", "js"), (3, "C:/w/b.js", 3, 1, "Foo.bar", "js"), (4, "srv/c.mjs", 7, 2, None, "js"), (6, "/srv/node_modules/p/i.js", 4, None, "Thing", "js"),
        (7, "/p/b.py", 7, None, "go", "python"), (8, "<stdin>", 1, None, None, "python"), (9, "/src/c.go", 33, None, None, "go"), (11, "./src/main.rs", 12, 9, None, "js")]


def test_frame_files(spark):
    frames = spark.createDataFrame([(1, "/srv/pkg/a.ts", 3), (2, "a.ts", 4), (3, "only.py", 1), (4, "node:internal/x.ts", 1)], "id int, file string, line int")
    files = spark.createDataFrame([("pkg/a.ts",), ("other/a.ts",), ("lib/only.py",)], "path string")
    got = {r.id: r.path for r in J.frame_files(frames, files).collect()}
    assert got[1] == "pkg/a.ts" and got[3] == "lib/only.py" and 4 not in got


def test_command_risk(spark):
    df = spark.createDataFrame([("rm -rf build && npm test",), ("npm run build",), ("ls",)], "c string")
    got = [r.r for r in df.select(T.command_risk(F.col("c")).alias("r")).collect()]
    assert [g.level for g in got] == ["critical", "low", "low"] and got[2].confidence == "weakly_inferred"


def test_globs():
    import re
    assert re.search(T.glob_regex("*.py"), "a/b.py") and not re.search(T.glob_regex("src/*.py"), "src/x/b.py")
    assert re.search(T.glob_regex("src/**"), "src/x/b.py") and re.search(T.glob_regex("docs/"), "docs/a/b")


def test_strong_components(spark):
    e = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (9, 7), (5, 7)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "IMPORTS") for a, b in e], "from_id string, to_id string, edge_type string")
    got = sorted((r.component, r.node) for r in G.strong_components(edges).collect())
    assert got == [("n1", "n1"), ("n1", "n2"), ("n1", "n3"), ("n7", "n7"), ("n7", "n8"), ("n7", "n9")]


def test_shortest_path(spark):
    edges = spark.createDataFrame([("a", "b", "IMPORTS"), ("b", "c", "IMPORTS"), ("a", "d", "IMPORTS"), ("d", "c", "TESTS")], "from_id string, to_id string, edge_type string")
    assert [r.node for r in G.shortest_path(edges, "a", "c").orderBy("place").collect()] == ["a", "b", "c"]
    assert G.shortest_path(edges, "c", "a").count() == 0


def test_paths_of_more_than_fifty_steps(spark):
    names = [f"n{k:02}" for k in range(53)]
    edges = [(a, b, "IMPORTS") for a, b in zip(names, names[1:])] + [("n52", "n03", "IMPORTS")]  # and a way back
    edges = spark.createDataFrame(edges, "from_id string, to_id string, edge_type string").coalesce(1)
    assert {r.node: r.distance for r in G.distances(edges, "n00").collect()} == {n: k for k, n in enumerate(names)}


def test_applicable_rules(spark):
    rules = spark.createDataFrame([("r1", ["^src/"], "x"), ("r2", [], "Always do"), ("r3", [], "nothing")], "name string, globs array<string>, body string")
    assert {r.name for r in J.applicable_rules(rules, "src/a.ts").collect()} == {"r1", "r2"}


def test_commands_in_docs(spark):
    docs = spark.createDataFrame([("docs/a.md", "x\n```bash\n$ tool run a\n# note\n// note\n| table |\n> node ./scripts/go.js`.\nnode ./near.js\nnpx ./root.js x\n```\n```mermaid\ntool no\n```\n```PWSH\ntool build\n```\n")], "path string, text string")
    found = X.shell_commands(docs)
    assert [r.command for r in found.collect()] == ["tool run a", "node ./scripts/go.js`.", "node ./near.js", "npx ./root.js x", "tool build"]
    bad = L.broken_commands(found, spark.createDataFrame([("docs/near.js",), ("root.js",)], "path string"), ("build",), "tool")
    assert {(r.command, r.problem) for r in bad.collect()} == {("tool run a", "unknown subcommand 'run'"), ("node ./scripts/go.js`.", "path not found: ./scripts/go.js")}


def test_ci_and_manifests(spark):
    ci = spark.createDataFrame([("ci.yml", "jobs:\n  a:\n    - run: npm test\n    - uses: x/y@v1")], "path string, text string")
    assert sorted((r.kind, r.value) for r in L.ci_commands(ci).collect()) == [("run", "npm test"), ("uses", "x/y@v1")]
    m = S.manifests(spark.createDataFrame([("a/package.json", '{"name":"a","dependencies":{"b":"1"},"devDependencies":{"b":"2","c":"1"}}'), ("b/package.json", "{bad")], "path string, text string"))
    assert [(r.name, sorted(r.deps)) for r in m.where("name is not null").collect()] == [("a", ["b", "c"])]


def test_sources(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("x")
    (tmp_path / "dist").mkdir()
    (tmp_path / "dist" / "b.js").write_text("y")
    got = S.scan(spark, str(tmp_path), ignore=[]).collect()
    assert [r.path.endswith("src/a.py") for r in got] == [True] and len(got[0].hash) == 64
    status = spark.createDataFrame([("## main",), ("M  a",), (" M b",), ("?? c",), ("R  d -> e",)], "line string")
    assert sorted((r.kind, r.path) for r in S.git_status(status).collect()) == [("staged", "a"), ("staged", "e"), ("unstaged", "b"), ("untracked", "c")]
    owners = S.code_owners(spark.createDataFrame([("# c\n* @a @b\nlone\nsrc/ @c",)], "text string"))
    assert [(r.line_number, r.pattern, r.owners) for r in owners.collect()] == [(2, "*", ["@a", "@b"]), (4, "src/", ["@c"])]


def test_git_source(spark, tmp_path):
    import subprocess
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / "n.txt").write_text("x")
    lines = [r.line for r in S.read_git(spark, str(tmp_path), "status").collect()]
    assert "?? n.txt" in lines


def test_streamed_sessions(spark, tmp_path):
    rows = spark.createDataFrame([("s", 0), ("s", 100), ("s", 2000), ("s", 90000)], "source string, ms long").select("source", F.timestamp_millis("ms").alias("ts"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = C.debounced(stream, late="1 second").writeStream.format("memory").queryName("sessions").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.n for r in spark.table("sessions").collect()) == [1, 2]


def test_empty_tables(spark):
    files = spark.createDataFrame([], "path string, language string, text string, hash string")
    assert E.symbols(files).count() == 0 and X.secrets(files).count() == 0 and L.index_delta(files, files).count() == 0


def test_path_rules(spark):
    """Fixed lists: ignored names, generated files, entry points, adapters."""
    from pyspark.sql import functions as F

    from sparkloom.operators import joins, predicates

    paths = ["a/.nuxt/x.js", "a/.svelte-kit/x.js", "state/x", "src/a.ts", "scripts/x.sh", "a/scripts/x.sh", "a/src/bin/tool.rs", "yarn.lock", "x/Cargo.lock", "poetry.lock", "a.min.js", "b.map", "k.mts", "k.cts", "k.cjs"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    kept = {x.path for x in files.where(~predicates.ignored(F.col("path"), [], own_folder="state")).collect()}
    assert kept == set(paths[3:])
    roles = {x.path: x for x in predicates.path_roles(files).collect()}
    assert {p for p in paths if roles[p].generated} == {"yarn.lock", "x/Cargo.lock", "a.min.js"}
    assert {p for p in paths if roles[p].entry} == {"a/scripts/x.sh", "a/src/bin/tool.rs"}
    adapters = {x.path: x.adapter for x in joins.with_adapter(files).collect()}
    assert (adapters["src/a.ts"], adapters["k.mts"], adapters["k.cts"], adapters["k.cjs"], adapters["yarn.lock"]) == ("typescript", "typescript", "typescript", "javascript", None)


def test_symbols_that_call_are_used(spark):
    from sparkloom.operators import joins

    symbols = spark.createDataFrame([(k, n, "a/x.ts", 1, "function", True) for k, n in (("1", "caller"), ("2", "callee"), ("3", "alone"), ("4", "run"))], "id string, name string, file_path string, line int, kind string, exported boolean")
    imports = spark.createDataFrame([], "specifier string")
    edges = spark.createDataFrame([("symbol:1", "symbol:2", "CALLS")], "from_id string, to_id string, edge_type string")
    got = {x.name: x.confidence for x in joins.unused_symbols(symbols, imports, edges).collect()}
    assert got == {"alone": "strongly_inferred", "run": "weakly_inferred"}


def test_routes_of_all_frameworks(spark):
    rows = [
        ("a.ts", "// app.get('/no')\n/* app.get('/nor') */\napp.get('/x', h); router . POST(`/y`)\nfastify.get('/f')\nr.route('/c').delete(h)"),
        ("b.py", "from fastapi import FastAPI\n@app.get('/api')\n"), ("c.py", "@bp.route('/old')\n@bp.post(\"/new\")"),
        ("d.py", "urlpatterns = [\n path('users/', v), re_path(r'^item/$', w)]"), ("e.py", "path('unused/')"),
        ("f.rs", 'Router::new().route("/axum", post(handlers::make))\n#[get("/actix")]\nweb::resource("/res")\n  .route(web::put())'),
        ("src/app/(shop)/cart/route.ts", "x\nexport async function GET() {}\nexport function POST() {}"), ("app/about/page.tsx", "export default x"), ("n.ts", None),
    ]
    found = E.routes(spark.createDataFrame(rows, "path string, text string"))
    got = {(r.path, r.line_number, r.framework, r.method, r.route, r.handler) for r in found.collect()}
    shop = "src/app/(shop)/cart/route.ts"
    assert got == {
        ("a.ts", 3, "express", "GET", "/x", None), ("a.ts", 3, "express", "POST", "/y", None), ("a.ts", 4, "fastify", "GET", "/f", None), ("a.ts", 5, "express", "DELETE", "/c", None),
        ("b.py", 2, "fastapi", "GET", "/api", None), ("b.py", 2, "express", "GET", "/api", None), ("c.py", 1, "flask", "GET", "/old", None), ("c.py", 2, "flask", "POST", "/new", None),
        ("d.py", 2, "django", "ANY", "/users/", None), ("d.py", 2, "django", "ANY", "/item/", None), ("f.rs", 1, "axum", "POST", "/axum", "handlers::make"),
        ("f.rs", 2, "actix", "GET", "/actix", None), ("f.rs", 3, "actix", "PUT", "/res", None), (shop, 2, "nextjs", "GET", "/cart", "GET"), (shop, 3, "nextjs", "POST", "/cart", "POST"),
        ("app/about/page.tsx", 1, "nextjs", "GET", "/about", "page")}
    assert E.merged_routes(found.where("path = 'b.py'")).count() == 1


def test_go_and_python_imports_and_methods(spark):
    go = 'package x\nimport "fmt"\nimport (\n\tlog "a/b"\n\t"os"\n)\nfunc (s *Server) Run() {}\nfunc helper() {}\n'
    df = spark.createDataFrame([("a.go", "go", go), ("b.py", "python", "from a.b import c, d\n\nimport os, sys\n")], "path string, language string, text string")
    got = {(r.path, r.line_number, r.source, r.specifier) for r in E.imports(df).collect()}
    assert got == {("a.go", 2, "fmt", "fmt"), ("a.go", 3, "a/b", "log"), ("a.go", 3, "os", "os"), ("b.py", 1, "a.b", "c, d"), ("b.py", 3, "os, sys", "os, sys")}
    assert {(r.kind, r.name, r.exported) for r in E.symbols(df.where("language = 'go'")).collect()} == {("method", "Server.Run", True), ("function", "helper", False)}


def test_extraction_of_whole_texts(spark):
    """A file of each language: names, lines (leading blank lines belong to a hit), what is exported, routes and hints."""
    rows = [
        ("src/index.ts", "typescript", "/** doc */\nexport function greet(name: string) {\n  return name;\n}\n\nexport class Greeter {\n  hello() {}\n}\n"),
        ("apps/web/app/page.tsx", "typescript", "export default function Home() {\n  return null;\n}\n"),
        ("src/lib.rs", "rust", "fn greet() {\n}\n// note\n\npub struct Greeter;\n\nimpl Greeter {\n    pub fn greet(&self) {}\n}\n"),
        ("main.py", "python", 'from fastapi import FastAPI\n\napp = FastAPI()\n\n@app.get("/health")\ndef health():\n    return 1\n'),
        ("main.go", "go", 'package main\n\nimport "fmt"\n\nfunc Greet() string { return "" }\n\n\n\nfunc main() {}\n'),
        ("index.ts", "typescript", "// mixed\nexport const mixed = 1;\nconst require = x\nconst { a } = b\n"), ("none.ts", "typescript", None), ("empty.py", "python", ""),
    ]
    found = E.analysis(spark.createDataFrame(rows, "path string, language string, text string"))
    symbols = {(r.path, r.line_number, r.kind, r.name, r.exported) for r in found["symbols"].collect()}
    assert symbols == {
        ("src/index.ts", 2, "function", "greet", True), ("src/index.ts", 6, "class", "Greeter", True), ("apps/web/app/page.tsx", 1, "route", "GET /", True), ("apps/web/app/page.tsx", 1, "function", "Home", True),
        ("src/lib.rs", 1, "function", "greet", False), ("src/lib.rs", 8, "function", "greet", True), ("src/lib.rs", 4, "struct", "Greeter", True), ("src/lib.rs", 6, "impl", "Greeter", False),
        ("main.py", 6, "function", "health", True), ("main.py", 5, "route", "GET /health", True), ("main.go", 5, "function", "Greet", True), ("main.go", 9, "function", "main", False), ("index.ts", 2, "const", "mixed", True)}
    assert {(r.path, r.line_number, r.source) for r in found["imports"].collect()} == {("main.py", 1, "fastapi"), ("main.go", 3, "fmt")}
    assert {(r.path, r.method, r.route) for r in found["routes"].collect()} == {("apps/web/app/page.tsx", "GET", "/"), ("main.py", "GET", "/health")}
    assert {(r.path, r.framework, r.confidence) for r in found["frameworks"].collect()} == {("apps/web/app/page.tsx", "nextjs", "strongly_inferred"), ("apps/web/app/page.tsx", "react", "weakly_inferred"), ("main.py", "fastapi", "confirmed")}


def test_imports_over_several_lines(spark):
    text = "import {\n  a,\n  b,\n} from './x'\n\nimport './x'\nimport def from './x'\n"
    got = [(r.line_number, r.source, r.specifier) for r in E.imports(spark.createDataFrame([("a.ts", "typescript", text)], "path string, language string, text string")).orderBy("line_number").collect()]
    assert got == [(1, "./x", "{\n  a,\n  b,\n}"), (6, "./x", "*"), (7, "./x", "def")]


def test_health_docs_edges_and_position(spark):
    files = spark.createDataFrame([("README.md", "The Plan\nplan b"), ("docs/a.md", "no\nmy PLAN  "), ("docs/node_modules/x.md", "plan"), ("src/a.test.ts", "plan"), ("package.json", '{"scripts": {"build": "x", "z": "y"}}')], "path string, text string")
    edges = spark.createDataFrame([("a", "b", "IMPORTS"), ("b", "a", "IMPORTS")], "from_id string, to_id string, edge_type string")
    symbols = spark.createDataFrame([("1",)], "id string")
    got = {r.name: (r.ok, r.weight, r.detail) for r in L.health_checks(files, symbols, edges, git=True).collect()}
    assert got == {"index": (True, 20, "5 files, 1 symbols"), "graph": (True, 15, "2 edges"), "git": (True, 10, "git repository"), "readme": (True, 5, "README.md found"), "cycles": (False, 15, "1 mutual import pairs"),
                   "tests": (True, 15, "1 test-related files indexed"), "scripts": (True, 10, "scripts: build, z")}
    assert "scripts" not in {r.name for r in L.health_checks(files.where("path <> 'package.json'"), symbols, edges).collect()}
    assert [tuple(r) for r in L.search_docs(files, "plan").collect()] == [("docs/a.md", 2, "my PLAN"), ("README.md", 1, "The Plan"), ("README.md", 2, "plan b")]
    kind = "id string, from_id string, to_id string, edge_type string, confidence string, meta string"
    old, new = spark.createDataFrame([("1", "a", "b", "X", "weak", None), ("2", "c", "d", "X", "weak", None)], kind), spark.createDataFrame([("1", "q", "q", "q", "sure", "m"), ("3", "e", "f", "X", "weak", None)], kind)
    assert sorted(map(tuple, L.upserted_edges(old, new).collect()), key=lambda r: r[0]) == [("1", "a", "b", "X", "sure", "m"), ("2", "c", "d", "X", "weak", None), ("3", "e", "f", "X", "weak", None)]
    lines = spark.createDataFrame([("## main...origin/main [ahead 2, behind 13]",), ("M  a",)], "line string")
    assert [tuple(r) for r in S.git_position(lines).collect()] == [("main", 2, 13)]
    assert [tuple(r) for r in S.git_position(spark.createDataFrame([("## No commits yet on dev",)], "line string")).collect()] == [("dev", 0, 0)]


def test_order_of_names(spark):
    df = spark.createDataFrame([(1, "B"), (1, "a"), (1, "_x"), (1, "A"), (0, "z"), (1, "b")], "rank int, name string")
    assert [r.name for r in W.ranked_by_name(df, F.col("rank")).collect()] == ["z", "_x", "a", "A", "b", "B"]


def test_project_identity_edges(spark):
    rows = [("a/one", "package.json", "not json"), ("b", "src/x.py", None), ("b", None, "x"), ("c", "package.json", '{"name": "", "workspaces": {"packages": ["p/*", "p/*"]}}'), ("c", "package.json", None)]
    files = spark.createDataFrame(rows, "repo string, path string, text string")
    got = {r.repo: r for r in R.project_identity(files).collect()}
    assert got["a/one"].name == "one" and got["a/one"].languages == ["javascript"] and not got["a/one"].monorepo
    assert got["b"].name == "b" and got["b"].languages == [] and not got["b"].git
    assert got["c"].name == "c" and got["c"].monorepo
    assert [tuple(r) for r in R.workspace_globs(files).collect()] == [("c", "p/*")]
    assert R.project_identity(files.limit(0)).count() == 0 and R.workspace_map(files.limit(0)).count() == 0
    assert {r.path for r in R.workspace_packages(files).collect()} == {"."}


def test_placed_symbols(spark):
    frames = spark.createDataFrame([(1, "f", 50, "mod.run"), (2, "f", 12, ""), (3, "f", 300, None), (4, "f", 1, "")], "id int, path string, line int, function string")
    symbols = spark.createDataFrame([("s1", "f", "outer", 10, 200), ("s2", "f", "inner", 11, 14), ("s3", "f", "run", 70, None)], "id string, file_path string, name string, line int, end_line int")
    got = {r.id: (r.symbol_id, r.how) for r in J.placed_symbols(frames, symbols).collect()}
    assert got == {1: ("s3", "name"), 2: ("s2", "span"), 3: ("s3", "above")}


def test_change_docs_and_tests(spark):
    text = "```bash\ntool run\ntool fly\n```"
    files = spark.createDataFrame([("a.md", text), ("b.md", text), ("src/n1.ts", ""), ("src/n1.test.ts", "")], "path string, text string")
    changed = spark.createDataFrame([("a.md",), ("src/n1.ts",)], "path string")
    assert [(r.path, r.problem) for r in L.change_docs(changed, files, ("run",), "tool").collect()] == [("a.md", "unknown subcommand 'fly'")]
    assert sorted(r.path for r in L.change_docs(changed.limit(0), files, ("run",), "tool").collect()) == ["a.md", "b.md"]
    edges = spark.createDataFrame([], "from_id string, to_id string, edge_type string")
    assert [tuple(r) for r in L.change_tests(changed, files, edges).collect()] == [("src/n1.ts", "src/n1.test.ts")]


def test_memory_records(spark):
    got = L.memory_records(spark.createDataFrame([("note", "t", "c", ["x", "y"])], "type string, title string, content string, tags array<string>"), 1000).first()
    assert got.tags == "x,y" and got.created_at == 1000 and len(got.id) == 36 and got.written.startswith("1970-01-0")


def test_polled_changes(spark, tmp_path):
    tree, folder = tmp_path / "tree", str(tmp_path / "state")
    tree.mkdir()
    (tree / "a").write_text("1")
    (tree / "b").write_text("1")
    for k in range(2):
        polled_changes(spark, str(tree), folder, once=True).awaitTermination(120)
        if k == 0:
            (tree / "a").write_text("longer")
            (tree / "b").unlink()
            (tree / "c").write_text("1")
    got = sorted((r.tick, r.path.rsplit("/", 1)[1], r.change) for r in changes_of(spark, folder).collect())
    assert got == [(0, "a", "added"), (0, "b", "added"), (1, "a", "changed"), (1, "b", "removed"), (1, "c", "added")]


def test_hits_do_not_carry_texts_and_words_spare_no_match(spark, monkeypatch):
    """what a file is told apart by is worked out before its hits; patterns are tried wherever one of their words stands in any case."""
    from sparkloom.functions import code as E

    text = "@APP.Get('/a')\nROUTER . post ( '/b')\nx.ROUTE('/c').Put(1)\nWEB::Resource(\"/d\") .to web::Delete\nr.route(\"/e\", get(h::i))\n#[get(\"/f\")]\nFROM FLASK\nImport FastAPI\n"
    rows = [("a.py", "python", text), ("b.py", "python", "/" + "/**/" + "/ app.get('/gone')\n"), ("c.py", "python", None), ("d.ts", "typescript", "class A {}\n" * 3 + "let x = 1" + "\ny" * 50)]
    files = spark.createDataFrame(rows, "path string, language string, text string")
    plan = E.symbols(files)._jdf.queryExecution().executedPlan().toString()
    assert 0 < plan.index("Generate inline") < plan.index("xxhash64(text")
    found = {(r.path, r.method, r.route, r.line_number) for r in E.routes(files).collect()}
    assert found == {("a.py", "GET", "/a", 1), ("a.py", "POST", "/b", 2), ("a.py", "PUT", "/c", 3), ("a.py", "DELETE", "/d", 4), ("a.py", "GET", "/e", 5), ("a.py", "GET", "/f", 6)}
    assert {(r.path, r.framework) for r in E.frameworks(files).collect()} == {("a.py", "flask"), ("a.py", "fastapi")}
    assert [(r.name, r.line_number) for r in E.symbols(files).where("path = 'd.ts'").orderBy("place").collect()] == [("A", 1), ("A", 1), ("A", 2), ("x", 3)]
    kept = []
    monkeypatch.setattr(E, "staged", lambda df: (kept.append(df.columns), df)[1])
    E.analysis(files)
    assert not [c for c in kept if "evidence" in c]  # hints that nobody reads are not worked out
