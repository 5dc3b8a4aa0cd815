"""License scans, source divergence and whitening against brute force, with nulls, repeats, ties, long texts and clashing columns."""

import collections
import heapq
import random
import re

import duckdb
import numpy as np
import pytest

from sparkloom.llm import license_scan, registry, source_divergence, whitening

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, own string, w string, t int, label string"
MORE = (0, 1, "own", "w", 2, "label")
MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def table_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, *MORE) for i, t, lang, source in rows], SCHEMA)


def plain_scan(text):
    """The docstring's words in plain Python."""
    w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    places, base, labels, score = [], set(), set(), 0.0
    for _, label, is_base, k, words in license_scan.pieces():
        hits = collections.defaultdict(list)
        for i in range(len(w) - k + 1):
            for j in range(len(words) - k + 1):
                if w[i:i + k] == words[j:j + k]:
                    hits[i - j].append(j)
        spans, before = [], None
        for d in sorted(hits):
            if is_base or before is None or d - before > license_scan.GAP:
                spans.append(set())
            spans[-1] |= {j + x for j in hits[d] for x in range(k)}
            before = d
        if is_base and hits:
            places += hits
            base.add(label)
        score = max([score, *(len(s) / len(words) for s in spans)])
        if any(10 * len(s) >= 9 * len(words) for s in spans):
            labels.add(label)
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


@pytest.fixture(scope="module")
def license_texts():
    r = random.Random(3)
    edited = MIT.replace("hereby", "thereby").split()
    shifted = MIT.split()
    shifted.insert(9, "kindly")
    del shifted[14]
    notices = [n for texts in license_scan.NOTICES.values() for n in texts] + list(license_scan.PHRASES)

    def mixed():
        out = []
        for _ in range(r.randrange(0, 12)):
            words = r.choice(notices).split()
            for _ in range(r.randrange(0, 3)):
                k = r.randrange(len(words))
                words[k:k + r.randrange(0, 2)] = [r.choice(["word", "é", "license", "the"])] * r.randrange(0, 2)
                words = words or ["x"]
            out.append(r.choice([" ", "\n", ", ", "(c) "]).join(words))
        return " ; ".join(out)

    fixed = [None, "", "...", "CC BY", "cc\x00BY cc-by 4.0 CC by", "General Public\nLicense; general public license general public", "ALL RIGHTS RESERVED. All rights reserved", "Ünall rights reserved", MIT,
             " ".join(edited), " ".join(shifted), "cc cc by by", "a a a a a", "licensed under the apache license version", "É" * 5, "cc by " * 3000, ("x " * 20_000) + "all rights reserved"]
    return fixed + [mixed() for _ in range(80)]


def test_op11_against_plain_python(spark, license_texts):
    rows = [(k if k % 9 else None, t, None, "s") for k, t in enumerate(license_texts)] + [(8, license_texts[8], None, "s")] * 2
    got = [tuple(r) for r in license_scan.scan(table_of(spark, rows)).select("own.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()]
    want = [(i, *plain_scan(t)) for i, t, *_ in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert any("mit" in r[6] for r in got if r[0] in (10,)) and len({r[6] for r in got}) > 15
    spans = [r.spans for r in license_scan.scan(table_of(spark, [(1, "See: " + MIT + ".", None, None)])).collect()][0]
    assert [(s.label, s.start, s.end, s.coverage) for s in spans] == [("mit", 1, 20, 1.0)]
    assert license_scan.scan(table_of(spark, [])).count() == 0


def test_op11_sql_and_plan(spark, license_texts, tmp_path):
    docs = table_of(spark, [(k, t, None, "s") for k, t in enumerate(license_texts)])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    made = license_scan.op11_license_scan(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, made.collect())) == sorted(con.execute(registry.oracle_sql()["op11_license_scan"]).fetchall())
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_op11_long_notice_in_pieces(spark):
    long = " ".join(f"w{k}" for k in range(150))
    assert [len(p[4]) for p in license_scan.pieces({}, {"long": (long,)})] == [50, 50, 50]
    found = license_scan.scan(table_of(spark, [(1, long, None, None), (2, long.replace("w20 ", ""), None, None), (3, "none", None, None)]), {}, {"long": (long,)})
    assert {r.own.doc_id: r.labels for r in found.collect()} == {1: "long", 2: "long", 3: ""}


def plain_divergence(rows, least, top):
    docs = [(lang or "", source or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = collections.Counter(t for d in mine for t in set(d[2]))
        kept = sorted(t for t in df if df[t] >= least)

        def share(of):
            n = collections.Counter(t for d in of for t in d[2])
            total = sum(n[t] for t in kept)
            return n, {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * len(kept)) for t in kept}

        _, q = share(mine)
        groups = {s: share([d for d in mine if d[1] == s]) for s in {d[1] for d in mine}}
        for s, (n, p) in groups.items():
            pairs = [(-sum(abs(p[t] - p2[t]) for t in kept), o.encode()) for o, (_, p2) in groups.items() if o != s]
            own = heapq.nsmallest(top, [(q[t] - p[t], t.encode()) for t in kept if n[t] and p[t] > q[t]])
            out += [(lang, s, part, i.decode(), -v, k) for part, found in (("pair", sorted(pairs)), ("term", own)) for k, (v, i) in enumerate(found, 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def term_rows():
    r = random.Random(9)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)] + ["Été", "ÉTÉ", "été", "THE", "the", "x1y", "日本"]
    rows = []
    for k in range(500):
        source = r.choice(["hot"] * 8 + [f"s{j}" for j in range(9)] + [None, "", "é", "Z"])
        text = " ".join(r.choice(words[:40] if r.random() < 0.6 else words) for _ in range(r.randrange(0, 60)))
        rows.append((k if k % 7 else 3, r.choice([text, text + "\x00\n", text.upper()]), r.choice(["en", "en", "de", None, "tiny"]) if k < 490 else "few", source))
    rows += [(1, None, "en", "empty"), (2, "", "de", "empty"), (2, "!? 12", "few", "lone"), rows[0], rows[0], (5, None, "alone", "one")]
    return rows


@pytest.mark.parametrize("block, band, entries", [(1024, 256, 400_000), (7, 3, 50)])
def test_op12_against_plain_python(spark, term_rows, monkeypatch, block, band, entries):
    for name, value in (("BLOCK", block), ("BAND", band), ("TABLE", entries)):
        monkeypatch.setattr(source_divergence, name, value)
    got = sorted(map(tuple, source_divergence.divergence(table_of(spark, term_rows).repartition(5)).collect()))
    assert got == plain_divergence(term_rows, source_divergence.LEAST_DOCS, source_divergence.TOP)
    assert {r[0] for r in got} == {"en", "de", "", "tiny", "few"}


def test_op12_sql_ties_and_empty(spark, term_rows, tmp_path):
    table_of(spark, term_rows).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(map(tuple, source_divergence.op12_source_divergence(spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(registry.oracle_sql()["op12_source_divergence"]).fetchall())
    assert any(a[4] == b[4] and a[3] < b[3] for a, b in zip(got, got[1:]) if a[:3] == b[:3])
    assert source_divergence.divergence(table_of(spark, [])).count() == 0


def test_op12_shares_beyond_64_bits():
    counts = np.array([[10**12, 3]], np.int64)
    assert source_divergence.shares(counts, np.array([10**12 + 3]), 2).tolist() == [[1 + 10**9 * (c + 5) // (10**12 + 13) for c in (10**12, 3)]]


VECTORS = "vec_id long, embedding array<float>, label int, id int, v string, n int, component string"


def whitened(spark, vectors, **more):
    df = spark.createDataFrame([(i, v, 0, 1, "v", 2, "c") for i, v in vectors], VECTORS)
    return whitening.whiten(df.repartition(3), **more).collect()


def held_against_eigh(rows, vectors, least=32, error=1e-10):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    c = ((n * x - s) / n).astype(float)
    values, frame = np.linalg.eigh(c.T @ c / n)
    values, frame = values[::-1], frame[:, ::-1]
    k = min(least, (values > 1e-12 * values[0]).sum())
    assert {r.component for r in rows} == set(range(1, k + 1)) and len(rows) == n * k and {r.n for r in rows} == {n}
    assert max(r.identity_error for r in rows) < error
    for j in range(k):
        mine = [r for r in rows if r.component == j + 1]
        assert sorted(r.deviation for r in mine) == sorted(int(d) for d in ((n * x - s) ** 2).sum(axis=1))
        assert abs(mine[0].explained - values[j] / values.sum()) < 1e-12
        gap = min([abs(values[j] - e) for i, e in enumerate(values) if i != j], default=1)
        if gap > 1e-6 * values[0]:
            want = np.sort(c @ frame[:, j] / np.sqrt(values[j]))
            got = np.sort([r.whitened for r in mine])
            assert min(np.abs(got - want).max(), np.abs(got + want[::-1]).max()) < 1e-7


@pytest.mark.parametrize("d, n", [(5, 40), (64, 300), (100, 400), (40, 20)])
def test_op13_against_eigh(spark, d, n):
    r = np.random.default_rng(d)
    vectors = (r.standard_normal((n, d)) * np.linspace(0.2, 3, d)).astype(np.float32).tolist()
    held_against_eigh(whitened(spark, list(enumerate(vectors))), vectors)


def test_op13_nulls_repeats_lengths_and_scale(spark):
    r = np.random.default_rng(1)
    vectors = (r.standard_normal((60, 6)) * [1, 1, 1, 0, 50, 2e4]).astype(np.float32).tolist()
    bad = [(1, None), (2, []), (3, [None] * 6), (4, [float("nan")] + [0.0] * 5), (5, [float("inf")] * 6), (6, [1.0] * 5), (None, [float("-inf")] * 6)]
    rows = whitened(spark, [(i % 50 if i else None, v) for i, v in enumerate(vectors)] + bad)
    held_against_eigh(rows, vectors, error=1e-6)  # a dimension without variance, one of 10**9 times another's; ids null and repeated
    assert len([r for r in rows if r.vec_id is None and r.component == 1]) == 1
    assert whitened(spark, []) == [] and whitened(spark, bad[:5]) == [] and whitened(spark, [(1, [0.5, 2.0])] * 3) == []
    huge = whitened(spark, [(k, [1e30 * (-1) ** k, float(k)]) for k in range(4)])
    assert {r.deviation for r in huge} == {None}


def test_op13_multiplicities_and_restarts():
    r = np.random.default_rng(4)
    q, _ = np.linalg.qr(r.standard_normal((90, 90)))
    for spectrum in ([5.0] * 40 + [1.0] * 50, [3.0] * 2 + [0.0] * 88, [0.0] * 90, list(np.geomspace(1, 1e-9, 90))):
        a = (q * np.array(spectrum)) @ q.T
        calls = []
        values, vectors = whitening.block_lanczos(lambda b: calls.append(b) or a @ b, 90, 32)
        assert np.abs(values - spectrum[:32]).max() < 1e-13 * max(spectrum[0], 1)
        assert np.abs(vectors.T @ vectors - np.eye(32)).max() < 1e-13 and np.linalg.norm(a @ vectors - vectors * values, axis=0).max() < 1e-13 * max(spectrum[0], 1)
        every = np.hstack(calls)
        assert np.abs(every.T @ every - np.eye(every.shape[1])).max() < 1e-13  # full reorthogonalisation
