r"""How far the sources of a language differ in their words.

For each language the terms in at least LEAST_DOCS of its documents are kept. A group (lang, source) gives term t the share
p = 1 + floor(SCALE * (count + PLUS) / (N + PLUS * V)), N its kept occurrences, V the number of kept terms; the language's own
share is q. Two groups of a language differ by the sum of |p - p'| over all kept terms; a group's own terms are those with
p > q.

Terms are counted by the tasks that read (a table of at most TABLE entries each, then summed by Spark). The kept terms of a language
are dealt by hash into blocks of about BLOCK terms, its sources into bands of at most BAND; each (block, two bands) is a dense
int64 tile of groups by terms, zero counts included, in which numpy compares all pairs by broadcasting, a row at a time. Tiles give partial
sums of pairs and the best terms of each group; Spark sums the one and merges the other. A tile's size depends on BLOCK and BAND alone, a common
term or a source with most rows is as large as any other there. The result itself has all pairs of sources of a language, as asked for.

Null text, lang and source are ''. Every row is a document, whatever its id. An empty table gives no rows; a group without
kept terms gives each term PLUS / (PLUS * V); where V is 0 pairs differ by 0 and there are no terms. All arithmetic is exact in
64 bits: counts up to 2**63 / SCALE, that is 9.2e9 occurrences of a term in a language, stay in int64 and beyond it Python integers
take over. Texts are taken whole, as bytes: invalid UTF-8 doesn't stop a run. Columns other than the three aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import stage, table

LEAST_DOCS, SCALE, PLUS, TOP = 30, 1_000_000_000, 5, 50
BLOCK, BAND, TABLE = 1024, 256, 400_000
#: A byte of a term as it counts (A-Z in lower case), all others as a space. UTF-8 bytes of letters beyond ASCII belong to terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs), terms as bytes; term null: n is 0 and docs the group's documents. docs: (lang, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        rows, held = Counter(), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, d) in tables.items():
                yield pa.RecordBatch.from_arrays([
                    pa.array([lang] * len(n), pa.string()), pa.array([source] * len(n), pa.string()), pa.array(list(n), pa.binary()),
                    pa.array(list(n.values()), pa.int64()), pa.array([d[t] for t in n], pa.int64())], ["lang", "source", "term", "n", "docs"])
            tables.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = text.translate(TERM_BYTES).split()
                n, d = tables.setdefault((lang, source), (Counter(), Counter()))
                held -= len(n)
                n.update(words)
                d.update(set(words))
                held += len(n)
                rows[lang, source] += 1
                if held > TABLE:
                    yield from flush()
                    held = 0
        yield from flush()
        if rows:
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.nulls(len(rows), pa.binary()),
                pa.array([0] * len(rows), pa.int64()), pa.array(list(rows.values()), pa.int64())], ["lang", "source", "term", "n", "docs"])

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source")), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    counted = read.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def shares(counts: np.ndarray, totals: np.ndarray, kept: int) -> np.ndarray:
    """p of counts (groups x terms) with the groups' totals."""
    most = int(counts.max(initial=0)) + PLUS
    if most > (1 << 63) // SCALE:
        counts, totals = counts.astype(object), totals.astype(object)
    return (1 + SCALE * (counts + PLUS) // (totals + PLUS * kept)[:, None]).astype(np.int64)


def compare_tile(rows: pd.DataFrame) -> pd.DataFrame:
    """A tile's partial sums of pairs and the TOP terms of each group of its first band, where the tile has one band.

    rows of one (lang, block, band_a, band_b): a group (band, source, n: its total), a kept term (term, n: in the language, total: of the language), a count (source, term, n).
    """
    lang, kept = rows["lang"].iat[0], int(rows["kept"].iat[0])
    band_a, band_b = int(rows["band_a"].iat[0]), int(rows["band_b"].iat[0])
    groups, terms, counts = (rows[rows["kind"] == k] for k in "gtc")
    groups = groups.sort_values(["band", "source"])
    names, bands = groups["source"].tolist(), groups["band"].to_numpy()
    row = {s: i for i, s in enumerate(names)}
    column = {t: j for j, t in enumerate(terms["term"])}
    tile = np.zeros((len(names), len(column)), np.int64)
    tile[[row[s] for s in counts["source"]], [column[t] for t in counts["term"]]] = counts["n"].to_numpy(np.int64)
    p = shares(tile, groups["n"].to_numpy(np.int64), kept) if column else np.zeros(tile.shape, np.int64)
    out = []
    for i in range(len(names)):
        others = np.arange(i + 1, len(names)) if band_a == band_b else np.flatnonzero(bands == band_b) if bands[i] == band_a else []
        sums = np.abs(p[others] - p[i]).sum(axis=1) if len(others) else []
        out += [("pair", names[i], names[j], None, int(v)) for j, v in zip(others, sums)]
    if band_a == band_b and column:
        q = shares(terms["n"].to_numpy(np.int64)[None], terms["total"].to_numpy(np.int64)[:1], kept)[0]
        words = list(column)
        for i, name in enumerate(names):
            over = np.flatnonzero((tile[i] > 0) & (p[i] > q))
            best = sorted(over, key=lambda j: (q[j] - p[i, j], words[j]))[:TOP]
            out += [("term", name, None, words[j], int(p[i, j] - q[j])) for j in best]
    made = pd.DataFrame(out, columns=["part", "source", "other", "term", "value"])
    made.insert(0, "lang", lang)
    return made


TILE = "lang string, part string, source string, other string, term binary, value long"


def divergence(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` has each other source of the lang, `term` the group's TOP own terms."""
    counts = stage(count_terms(docs), "terms")
    terms = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = stage(terms.where(F.col("docs") >= LEAST_DOCS).drop("docs"), "kept")
    in_group = counts.where("term is not null").select("lang", "source", "term", "n").join(terms.select("lang", "term"), ["lang", "term"])
    in_group = stage(in_group, "counts")
    sizes = in_group.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    groups = counts.where("term is null").select("lang", "source").join(sizes, ["lang", "source"], "left").fillna(0, ["n"])
    # rows of languages and of groups from here: few beside the texts
    per_lang = groups.groupBy("lang").agg(F.count("*").alias("sources")).join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("n").alias("total")), "lang", "left").fillna(0)
    per_lang = stage(per_lang.withColumns({"blocks": F.greatest(F.lit(1), F.ceil(F.col("kept") / BLOCK)), "bands": F.ceil(F.col("sources") / BAND)}), "langs")
    block, band = F.pmod(F.xxhash64("term"), F.col("blocks")), F.pmod(F.xxhash64("source"), F.col("bands"))

    def with_tiles(df: DataFrame, band_of: str | None) -> DataFrame:
        """df once for each tile that needs it: all pairs of bands, or those with the row's own."""
        pairs = "transform(sequence(0L, bands - 1), y -> struct({0} as band_a, {1} as band_b))"
        each = f"flatten(transform(sequence(0L, bands - 1), x -> filter({pairs.format('x', 'y')}, s -> s.band_a <= s.band_b)))" if band_of is None else pairs.format(f"least({band_of}, y)", f"greatest({band_of}, y)")
        return df.withColumn("tile", F.explode(F.expr(each))).select("lang", "kept", "block", "tile.*", "kind", "band", "source", "term", "n", "total")

    none = F.lit(None)
    rows = with_tiles(
        groups.join(per_lang, "lang").withColumn("band", band).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).withColumns({"kind": F.lit("g"), "term": none.cast("binary"), "total": F.lit(0).cast("long")}), "band")
    rows = rows.unionByName(with_tiles(
        terms.join(per_lang, "lang").withColumn("block", block).withColumns({"kind": F.lit("t"), "band": none.cast("long"), "source": none.cast("string")}), None))
    rows = rows.unionByName(with_tiles(
        in_group.join(per_lang.drop("total"), "lang").withColumns({"block": block, "band": band, "kind": F.lit("c"), "total": F.lit(0).cast("long")}), "band"))
    made = stage(rows.groupBy("lang", "block", "band_a", "band_b").applyInPandas(compare_tile, TILE), "tiles")

    pair = made.where("part = 'pair'").groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    pair = pair.unionByName(pair.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), "value"))
    pair = pair.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value")
    term = made.where("part = 'term'").select("lang", "source", "part", F.col("term").cast("string").alias("item"), "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item"))
    return pair.withColumn("rank", rank).unionByName(term.withColumn("rank", rank).where(F.col("rank") <= TOP))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents").select("lang", "source", "text"))


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), words AS (SELECT r, lang, source, unnest(w) AS term FROM docs
), kept AS (
  SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= {LEAST_DOCS}
), langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY ALL
), seen AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY ALL
), sizes AS (SELECT lang, source, sum(n) AS total FROM seen GROUP BY ALL
), groups AS (SELECT DISTINCT lang, source FROM docs
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(s.n, 0) AS n,
    (1 + {SCALE}::HUGEINT * (coalesce(s.n, 0) + {PLUS}) // (coalesce(z.total, 0) + {PLUS} * l.v))::BIGINT AS p,
    (1 + {SCALE}::HUGEINT * (k.n + {PLUS}) // (l.total + {PLUS} * l.v))::BIGINT AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN sizes z ON z.lang = g.lang AND z.source = g.source
  LEFT JOIN seen s ON s.lang = g.lang AND s.source = g.source AND s.term = k.term
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(x.p - y.p)) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN dense x ON x.lang = a.lang AND x.source = a.source LEFT JOIN dense y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL
), parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0)::BIGINT AS value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM dense WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= {TOP}
"""
