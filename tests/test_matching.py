"""Substring, suffix, interval, nearest and running-sum operators against all pairs in plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import intervals, joins, matching, prefix

R = random.Random(17)


def test_containing_is_all_pairs(spark):
    words = ["".join(R.choice("abé_") for _ in range(R.randrange(0, 7))) for _ in range(60)] + ["", "n1", "a", None, "%", "_b"]
    texts = ["/".join("".join(R.choice("abé_n1") for _ in range(R.randrange(0, 9))) for _ in range(3)) for _ in range(150)] + ["", "a", None, "a%c"]
    needles, hay = spark.createDataFrame([(w,) for w in words + words[:5]], "needle string"), spark.createDataFrame([(t,) for t in texts + texts[:9]], "text string")
    got = sorted(map(tuple, matching.containing(needles, hay).collect()))
    assert got == sorted({(w, t) for w in words if w is not None for t in texts if t is not None and w in t})
    assert matching.containing(needles.limit(0), hay).count() == 0 and matching.containing(needles, hay.limit(0)).count() == 0


def plain_match(file, paths):
    for p in paths:
        if p == file or file.endswith("/" + p):
            return p, "exact"
    same = [p for p in paths if p.split("/")[-1] == file.split("/")[-1]]
    if len(same) == 1:
        return same[0], "base"
    tails = [p for p in paths if file.endswith(p)]
    return (max(tails, key=len), "tail") if tails else None


def test_matched_files_is_all_pairs(spark):
    parts = ["a", "b", "src", "index.ts", "x.py", "xsrc", "é.go"]
    paths = sorted({"/".join(R.choice(parts) for _ in range(R.randrange(1, 4))) for _ in range(60)} | {"lib/only.rs", "s"})
    wanted = ["/".join(R.choice([*parts, "zz", "q.rs"]) for _ in range(R.randrange(1, 6))) for _ in range(200)] + ["/srv/other/only.rs", "", "/", None, "C:/w/src/index.ts", "zzs"]
    got = {r.file: (r.path, r.how) for r in matching.matched_files(spark.createDataFrame([(w,) for w in wanted], "file string"), spark.createDataFrame([(p,) for p in paths], "path string")).collect()}
    assert got == {w: plain_match(w, paths) for w in wanted if w is not None and plain_match(w, paths)}
    assert {h for _, h in got.values()} == {"exact", "base", "tail"}


def test_frame_files_of_one_base_name(spark):
    n = 100_000
    files = spark.range(n).select(F.concat(F.lit("pkg"), F.col("id").cast("string"), F.lit("/index.ts")).alias("path"))
    frames = spark.range(500).select("id", F.concat(F.lit("/srv/pkg"), (F.col("id") * 7).cast("string"), F.lit("/index.ts")).alias("file"), F.lit(3).alias("line"))
    frames = frames.union(spark.createDataFrame([(900, "node:internal/x.ts", 1), (901, "C:\\w\\node_modules\\pkg5\\index.ts", 2), (902, "nowhere.ts", 2)], frames.schema))
    made = joins.frame_files(frames, files)
    got = {r.id: r.path for r in made.collect()}
    assert got == {k: f"pkg{7 * k}/index.ts" for k in range(500)} | {901: "pkg5/index.ts"}


def test_overlaps_are_all_pairs(spark):
    spans = [(i, R.choice("ab"), a, R.choice([a, a + R.randrange(0, 9), a + R.randrange(0, 5000), a - 3])) for i in range(150) for a in [R.randrange(0, 4000)]] + [(900, "a", None, 3), (901, None, 1, 2), (902, "a", 5, 1 << 40)]
    ranges = [(R.choice("abc"), a, R.choice([a, a + R.randrange(0, 40), a + R.randrange(0, 9000), a - 2])) for _ in range(120) for a in [R.randrange(0, 4000)]] + [("a", 1, None), (None, 1, 9)]
    s, r = spark.createDataFrame(spans, "id int, path string, first long, last long"), spark.createDataFrame(ranges, "path string, lo long, hi long")
    got = sorted((x.id, x.path, x.lo, x.hi) for x in intervals.overlaps(s, "first", "last", r, "lo", "hi", "path").collect())
    assert got == sorted((i, p, lo, hi) for i, p, a, b in spans for q, lo, hi in ranges if p == q and None not in (p, a, b, lo, hi) and a <= hi and b >= lo)


def test_a_point_meets_only_its_intervals(spark):
    """The join makes no pair that a filter takes away: as many rows as there are pairs, in a key with all rows."""
    spans = spark.range(2000).select(F.lit("one").alias("k"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 14).alias("hi"))
    points = spark.range(20_000).select(F.lit("one").alias("k"), F.col("id").alias("x"))
    made = intervals.points_inside(points, F.col("x"), spans, F.col("lo"), F.col("hi"), "k")
    assert made.count() == sum(1 for k in range(2000) for x in range(k * 10, k * 10 + 15) if x < 20_000) and made.where("x < lo or x > hi").count() == 0


@pytest.mark.parametrize("width", [4, 1024])
def test_nearest_is_all_pairs(spark, width):
    points = [(R.choice("ab"), i, R.randrange(0, 300)) for i in range(200)] + [("c", 500, 7), ("a", 501, None), (None, 502, 3), ("d", 503, 1), ("d", 504, 250)]
    probes = sorted({(R.choice("abcde"), R.randrange(-20, 330)) for _ in range(120)}) + [("a", None)]
    p, q = spark.createDataFrame(points, "path string, id long, line long"), spark.createDataFrame(probes, "path string, at long")
    got = {(r.path, r.at): [(s.distance, s.point.id) for s in r.near] for r in intervals.nearest(p, q, "path", "line", "at", "id", 5, width).collect()}
    want = {(k, at): sorted((abs(x - at), i) for c, i, x in points if c == k and x is not None)[:5] for k, at in probes if at is not None}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_running_sums(spark):
    rows = [(R.choice(["p", "p", "p", "q", None]), R.randrange(0, 5), R.randrange(1, 50), i) for i in range(500)]
    df = spark.createDataFrame(rows, "part string, score int, tokens int, id int").repartition(7)
    got = {r.id: r.used for r in prefix.within_budget(df, 3000).collect()}
    total, want = 0, {}
    for _, _, tokens, i in sorted(rows, key=lambda r: (-r[1], r[3])):
        total += tokens
        if total <= 3000:
            want[i] = total
    assert got == want
    keyed = {r.id: r.used for r in prefix.within_budget(df, 900, "score", "tokens", "id", "part").collect()}
    want = {}
    for part in ("p", "q", None):
        total = 0
        for _, _, tokens, i in sorted((r for r in rows if r[0] == part), key=lambda r: (-r[1], r[3])):
            total += tokens
            if total <= 900:
                want[i] = total
    assert keyed == want
    assert prefix.within_budget(df, None).count() == 500 and prefix.within_budget(df.limit(0), 10).count() == 0
    assert prefix.running_sum(df, "tokens", "s", F.col("id"), parts=5).agg(F.max("s")).first()[0] == sum(r[2] for r in rows)


def test_chosen_tests(spark):
    paths = ["src/a.ts", "src/a.test.ts", "src/b.ts", "tests/b_test.go", "pkg/x/y.spec.ts", "pkg/z.test.ts", "deep/tests/util.py", "other.ts"]
    files = spark.createDataFrame([(p,) for p in paths], "path string")
    edges = spark.createDataFrame([(f"file:{a}", f"file:{b}", k) for a, b, k in [("pkg/z.test.ts", "src/b.ts", "TESTS"), ("src/b.ts", "src/a.ts", "IMPORTS"), ("tests/b_test.go", "src/b.ts", "IMPORTS"), ("deep/tests/util.py", "other.ts", "TESTS")]], "from_id string, to_id string, edge_type string")

    def run(mode, *targets):
        return sorted(tuple(r) for r in joins.chosen_tests(spark.createDataFrame([(t,) for t in targets], "target string"), files, edges, mode).collect())

    inventory = [p for p in paths if re.search(r"\.(test|spec)\.|_test\.|(^|/)tests?/", p)]
    assert [p for _, p in run("all")] == sorted(inventory)
    assert run("package", "pkg", "src\\") == [("pkg", "pkg/x/y.spec.ts"), ("pkg", "pkg/z.test.ts"), ("src/", "src/a.test.ts")]
    assert run("related", "src/a.ts") == [("src/a.ts", "pkg/z.test.ts"), ("src/a.ts", "tests/b_test.go")]
    assert run("file", "other.ts", "src/a.t", "x/src/a.test.ts", "src/a.ts") == [
        ("other.ts", "deep/tests/util.py"), ("src/a.t", "src/a.test.ts"), ("src/a.ts", "pkg/z.test.ts"), ("src/a.ts", "tests/b_test.go"), ("x/src/a.test.ts", "src/a.test.ts")]


def test_tests_of_longer_names(spark):
    files = spark.createDataFrame([("lib/user_service.test.ts",), ("lib/user.test.ts",), ("x/abuser_test.go",), ("docs/user.md",)], "path string")
    edges = spark.createDataFrame([], "from_id string, to_id string, edge_type string")
    changed = spark.createDataFrame([("src/user.ts",), ("src/none.ts",), ("src/service",)], "path string")
    assert sorted(map(tuple, joins.tests_of(changed, files, edges).collect())) == [
        ("src/service", "lib/user_service.test.ts"), ("src/user.ts", "lib/user.test.ts"), ("src/user.ts", "lib/user_service.test.ts"), ("src/user.ts", "x/abuser_test.go")]
