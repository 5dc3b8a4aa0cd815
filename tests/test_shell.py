"""Explained commands against a reader in plain Python, over generated commands."""

import random
import re

from sparkloom.functions import shell as S

PIECES = ["npm", "pnpm", "run", "build", "test", "git", "push", "-f", "--force", "--filter", "web", "-c", "--package", "--file", "x.ts", "./run.sh", "/bin/rm", "rm", "|", ">", ">>", "<", "A_B=1", "FOO=", "'a b'", '"q"', "--x=1", "-r", "install", "DROP", "out.txt", "..", "node", "'open", "--related", "-", "é"]


def read(command, scripts):
    text = (command or "").strip()
    words = re.findall(r"""\||>>|>|<|"[^"]*"|'[^']*'|[^\s"'|><]+""", text)
    out, risks, wait = [], [], None

    def path(t):
        return t.startswith(("./", "../", "/")) or bool(re.match(r"[A-Za-z]:[\\/]", t)) or bool(re.search(r"\.[a-z]{1,4}$", t, re.I))

    for i, t in enumerate(words):
        prev = out[-1][1] if out else None
        if t == "|":
            out.append((t, "pipe"))
        elif t in (">", ">>", "<"):
            out.append((t, "redirect"))
        elif re.match("[A-Z_][A-Z0-9_]*=", t):
            out.append((t.split("=")[0] + "=", "env"))
        elif wait:
            out.append((t, "flag_value"))
            wait = None
        elif t.startswith("-"):
            out.append((t, "flag"))
            if t in S.TAKE or t in S.MAY_TAKE and i + 1 < len(words) and not words[i + 1].startswith("-"):
                wait = t
            if t in S.DESTROY:
                risks.append(f"Destructive-looking flag {t}")
        elif i == 0 or all(r in ("env", "pipe") for _, r in out):
            out.append((t, "binary"))
        elif prev in ("binary", "subcommand"):
            out.append((t, "path" if path(t) else "subcommand"))
        else:
            out.append((t, "path" if path(t) else "arg"))
    first = lambda role: next((t for t, r in out if r == role), None)
    binary, sub = re.sub(r"^.*[\\/]", "", first("binary") or ""), first("subcommand")
    if binary in S.MANAGERS:
        summary = f"Invoke package manager '{binary}' to {sub} a project script or lifecycle" if sub in S.LIFECYCLE else f"Install or add dependencies via {binary}" if sub in S.INSTALL else f"Run {binary}" + (f" {sub}" if sub else "")
        risks += ["May mutate package.json / lockfile and node_modules"] if sub in S.INSTALL else []
    elif binary == "git":
        summary = f"Git {sub or 'command'}"
        risks += [f"Potentially destructive git operation: {sub}"] if sub in S.GIT_DESTROYS else []
    else:
        summary = " ".join(t for t, r in out if r in ("binary", "subcommand")) or text[:120]
    if re.search(r"\brm\b|\brimraf\b|\b--force\b|\bDROP\b", text, re.I):
        risks.append("Command may delete or overwrite data")
    related = [n for n, c in scripts.items() if text in c or c in text][:10]
    if (sub == "run" or binary in ("npm", "pnpm")) and len(out) >= 3:
        name = next((t for k, (t, r) in enumerate(out) if r == "subcommand" and k and out[k - 1][0] == "run"), None)
        if name and scripts.get(name):
            related.append(name)
            summary = f"Run package script '{name}': {scripts[name]}"
    return out, summary, list(dict.fromkeys(risks)), list(dict.fromkeys(related))


def test_explained_commands(spark):
    r = random.Random(41)
    scripts = {"build": "tsc -b", "test": "vitest run", "web": "npm run build", "none": ""}
    commands = [" ".join(r.choice(PIECES) for _ in range(r.randrange(1, 8))) for _ in range(400)] + [None, "", "  ", "pnpm run build --filter web", "A=1 B=2 node x.js | tee out.txt", "'unclosed"]
    df = spark.createDataFrame([(k, c, scripts) for k, c in enumerate(commands)], "id int, command string, scripts map<string,string>")
    roles = set()
    for row in S.explained(df, scripts="scripts").collect():
        out, summary, risks, related = read(commands[row.id], scripts)
        assert [(t.text, t.role) for t in row.tokens] == out, commands[row.id]
        assert (row.summary, row.risks, sorted(row.related)) == (summary, risks, sorted(related)), commands[row.id]
        assert row.confidence == ("strongly_inferred" if out else "unknown") and all(t.meaning for t in row.tokens)
        roles |= {role for _, role in out}
    assert roles == {"binary", "subcommand", "flag", "flag_value", "path", "arg", "pipe", "redirect", "env"}
    got = S.explained(spark.createDataFrame([("TOKEN=abc /usr/bin/git push -c core.x=1",)], "command string")).first()
    assert [t.meaning for t in got.tokens] == ["Set environment variable TOKEN for this command (value omitted)", "Git VCS", "Subcommand or script name 'push'", "Pass a command string / config (context-dependent)", "Value for -c"]
    assert "abc" not in str(got.tokens)
