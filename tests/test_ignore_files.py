"""Ignore files against a matcher of their own in plain Python: a walk that decides folder by folder, patterns matched by recursion."""

import random

from sparkloom.sources import ignore_files as I


def fits(pattern, name):
    """One path part, by trying each way a star can go."""
    if not pattern:
        return not name
    c = pattern[0]
    if c == "*":
        return fits(pattern[1:], name) or bool(name) and fits(pattern, name[1:])
    if not name:
        return False
    if c == "?":
        return fits(pattern[1:], name[1:])
    if c == "\\":
        return pattern[1] == name[0] and fits(pattern[2:], name[1:])
    if c == "[" and "]" in pattern[2:]:
        end = pattern.index("]", 2 if pattern[1] not in "!^" else 3)
        inner, no = pattern[1:end], False
        if inner[0] in "!^":
            inner, no = inner[1:], True
        found, k = False, 0
        while k < len(inner):
            if inner[k + 1:k + 2] == "-" and k + 2 < len(inner):
                found |= inner[k] <= name[0] <= inner[k + 2]
                k += 3
            else:
                found |= inner[k] == name[0]
                k += 1
        return found != no and fits(pattern[end + 1:], name[1:])
    return c == name[0] and fits(pattern[1:], name[1:])


def matches(pattern, parts):
    """A whole relative path against the parts of a tied pattern."""
    if not pattern:
        return not parts
    if pattern[0] == "**":
        return bool(parts) if len(pattern) == 1 else any(matches(pattern[1:], parts[k:]) for k in range(len(parts) + 1))
    return bool(parts) and fits(pattern[0], parts[0]) and matches(pattern[1:], parts[1:])


def rules_of(text):
    for line in text.split("\n"):
        line = line.rstrip("\r")
        while line.endswith(" ") and not line.endswith("\\ "):
            line = line[:-1]
        if line and line[0] != "#":
            no, body = line[0] == "!", line[line[0] == "!":]
            only = body.endswith("/")
            body = body[:-1] if only else body
            if body.strip("/"):
                yield no, only, body if "/" in body else "**/" + body


def walk(paths, ignore):
    """The paths a walk reaches."""
    def decide(entry, folder):
        parts = entry.split("/")
        best, out = None, False
        for path, text in ignore:
            at, _, name = path.rpartition("/")
            rank = {".gitignore": 1, ".ignore": 2}.get(name, 0)
            above = at.split("/") if at and rank else []
            if parts[:len(above)] != above or len(parts) == len(above):
                continue
            for n, (no, only, body) in enumerate(rules_of(text)):
                if (folder or not only) and matches(body.strip("/").split("/"), parts[len(above):]) and (best is None or (rank, len(above), n) >= best):
                    best, out = (rank, len(above), n), not no
        return out

    def reached(path):
        parts = path.split("/")
        return not any(decide("/".join(parts[:k]), k < len(parts)) for k in range(1, len(parts) + 1))

    return sorted(p for p in paths if reached(p))


FIXED = [
    (".gitignore", "# note\n*.log\n!keep.log\n/build\nout/\n**/cache\na/**/z\ndocs/**\n!docs/x.md\n\\#odd\n\\!bang\nfoo[0-9].t?t\nspace\\ \ntrail   \nsrc/*.tmp\n[!a]q\n"),
    ("src/.gitignore", "!*.log\n/local\n*.md\n"), ("src/deep/.gitignore", "*.log\n!local\n"), ("lib/.ignore", "!only.log\nx\n"), ("tools/extra", "never.py\n"),
]
PATHS = [
    "a.log", "keep.log", "build/x", "src/build/x", "out", "out/x", "lib/out/y", "x/cache", "x/cache/y", "a/z", "a/b/z", "a/b/c/z", "b/a/z", "docs/x.md", "docs/y/z.md", "#odd", "!bang", "foo1.txt", "foo1.tt", "fooa.txt", "space ", "trail", "trail   ",
    "src/a.tmp", "src/b/a.tmp", "src/x.log", "src/local", "src/sub/local", "src/deep/x.log", "src/deep/local", "src/r.md", "lib/only.log", "lib/x", "x", "never.py", "q/never.py", "zq", "aq", "ä/ö.log", "dist/x.py", "a/node_modules/b",
]


def test_ignore_files_against_a_walk(spark):
    df = spark.createDataFrame([(p, 1) for p in PATHS + PATHS[:2]] + [(None, 2)], "path string, entry int")
    rules = spark.createDataFrame([*FIXED, ("e/.gitignore", None)], "path string, text string")
    made = I.not_ignored_by_files(df, rules)
    assert made.columns == df.columns
    want = [p for p in walk(PATHS, FIXED) if not {"dist", "node_modules", "build", "out"} & set(p.split("/"))]
    assert sorted(r.path for r in made.dropDuplicates(["path"]).collect()) == want
    assert 12 < len(want) < len(PATHS) - 12
    assert I.not_ignored_by_files(df.limit(0), rules).count() == 0 and I.not_ignored_by_files(df, rules.limit(0), ()).count() == len(PATHS) + 2


def test_random_trees(spark, monkeypatch):
    r = random.Random(23)
    names, tokens = ["a", "b", "ab", "x.log", "y.md", "log"], ["a", "b", "*", "a*", "?b", "**", "*.log", "[ab]", "x.*", "y.m[!x]"]
    for k in range(3):
        paths = sorted({"/".join(r.choice(names) for _ in range(r.randrange(1, 5))) for _ in range(80)})
        ignore = []
        for folder in ["", "a/", "a/b/", "b/"]:
            lines = []
            for _ in range(r.randrange(1, 6)):
                body = "/".join(r.choice(tokens) for _ in range(r.randrange(1, 4)))
                lines.append(r.choice(["", "", "!"]) + r.choice(["", "/"]) + body + r.choice(["", "", "/"]))
            ignore.append((folder + r.choice([".gitignore", ".gitignore", ".ignore"]), "\n".join(lines)))
        if k == 2:
            monkeypatch.setattr(I, "BROADCAST_BYTES", 0)
        made = I.not_ignored_by_files(spark.createDataFrame([(p,) for p in paths], "path string"), spark.createDataFrame(ignore, "path string, text string"), ())
        assert sorted(x.path for x in made.collect()) == walk(paths, ignore), ignore
