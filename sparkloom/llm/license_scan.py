r"""License notices in texts, found by diagonal voting.

Every rolling k-gram of a text's words is hashed and joined to the positions of the same k-gram in the templates. A hit at
word i of the text and word j of a template votes for the diagonal i - j; votes of a text, template and diagonal are
summed up as a mask of the template's words. Diagonals at most GAP apart are one span (words put in or left out shift the
rest of a notice by as many places), and a span is verified when its hits cover nine tenths of the template's words: a
notice of under ten words must stand whole, a longer one may be edited. Hits are equal in text, not only in hash.

Base phrases are templates of one k-gram, so each of their hits is a place. Notices have k = 3 and at most LONGEST words; longer
ones are cut into pieces that are verified each for itself.

Built-in functions only. Texts are read once and never shuffled: what is shuffled is one row for each text and a row for
each diagonal with a hit. The templates are a fixed table and are broadcast. A text's k-grams, 8 bytes each, are held
while it is read.

A null text is empty: no words, no places, empty labels, score 0. Every row is a document of its own, whatever its id (null,
repeated); an empty table gives an empty result. Columns of docs to be returned are named in keep and come in a struct, so none
clashes with those made here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table

GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The phrases of the base and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words of public license notices, lower case, by label.
NOTICES = {
    "apache-2.0": (
        "licensed under the apache license version 2 0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
    ),
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "licensed under the mit license",
        "released under the mit license",
    ),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",),
    "gpl-2": ("gnu general public license version 2",),
    "gpl-3": ("gnu general public license version 3",),
    "gpl-notice": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",),
    "lgpl": ("gnu lesser general public license",),
    "agpl": ("gnu affero general public license",),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0",),
    "cc-by-nc": ("licensed under cc by nc", "creative commons attribution noncommercial"),
    "cc-by-sa": ("licensed under cc by sa", "creative commons attribution sharealike"),
    "cc0": ("has waived all copyright and related or neighboring rights to this work", "creative commons zero v1 0 universal"),
    "proprietary": ("unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",),
}
K, GAP, LONGEST = 3, 2, 60


def pieces(phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES) -> list[tuple[int, str, bool, int, list[str]]]:
    """(template from 1, label, base, k, words); a notice needs K words at least, a phrase two or K."""
    out = [(label, True, len(p.split()), p.split()) for p, label in phrases.items()]
    for label, texts in notices.items():
        for words in (t.split() for t in texts):
            n = -(-len(words) // LONGEST)
            out += [(label, False, K, words[k * len(words) // n:(k + 1) * len(words) // n]) for k in range(n)]
    if any(len(words) < k or k not in (2, K) for _, _, k, words in out):
        raise ValueError(f"a phrase has 2 or {K} words, a notice {K} or more")
    return [(t, *row) for t, row in enumerate(out, 1)]


def gram_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def templates(spark: SparkSession, parts: list) -> DataFrame:
    """(h, t, k, at, gram) of every k-gram of the templates, and a row t = 0 that every text has once, with hash 0."""
    rows = [(t, k, at, " ".join(words[at:at + k])) for t, _, _, k, words in parts for at in range(len(words) - k + 1)]
    made = spark.sql("VALUES " + ", ".join(f"({t}, {k}, {at}, '{gram}')" for t, k, at, gram in rows)).toDF("t", "k", "at", "gram")
    word = [F.get(F.split("gram", " "), F.lit(j)) for j in range(K)]
    hashed = F.when(F.col("k") == 2, gram_hash(word[:2])).otherwise(gram_hash(word))
    return made.select(hashed.alias("h"), "t", "k", "at", "gram").unionByName(spark.sql("SELECT 0L AS h, 0 AS t, 0 AS k, 0 AS at, '' AS gram"))


def hits(docs: DataFrame, parts: list, text: Column, keep: tuple[str, ...]) -> DataFrame:
    """(row, own: the columns keep, n_words) with (t, diagonal, at, place, k) for each hit; t = 0 once a row."""
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), GAPS), "")
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*keep).alias("own"), F.explode(F.array(words)).alias("w"))
    w, n = F.col("w"), F.size("w")

    def rolling(k: int) -> Column:
        at = F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: gram_hash([F.get(w, i + j) for j in range(k)]))

    grams = F.concat(F.array(F.lit(0).cast("long")), rolling(2), rolling(K))
    each = df.select("row", "own", "w", F.posexplode(grams).alias("slot", "h"))
    found = each.join(F.broadcast(templates(docs.sparkSession, parts)), "h")
    place = F.col("slot") - 1 - F.when(F.col("k") == K, F.greatest(n - 1, F.lit(0))).otherwise(F.lit(0))
    same = (F.col("t") == 0) & (F.col("slot") == 0) | (F.col("t") > 0) & (F.col("slot") > 0) & (F.array_join(F.slice("w", F.greatest(place + 1, F.lit(1)), F.col("k")), " ") == F.col("gram"))
    own = F.when(F.col("t") == 0, F.col("own"))  # once a text is enough
    return found.where(same).select("row", own.alias("own"), n.cast("long").alias("n_words"), "t", (place - F.col("at")).alias("diagonal"), "at", place.alias("place"), "k")


def scan(docs: DataFrame, phrases: dict[str, str] = PHRASES, notices: dict[str, tuple[str, ...]] = NOTICES, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(own: the columns keep of docs, n_words, n_base, first_word, last_word, base_labels, labels, score, spans).

    spans: (label, start, end, coverage) of verified notices, by start, label; end is the last word. score: the greatest part of a template that a span covers.
    """
    parts = pieces(phrases, notices)
    known = docs.sparkSession.sql("VALUES " + ", ".join(f"({t}, '{label}', {str(base).lower()}, {len(words)})" for t, label, base, _, words in parts)).toDF("t", "label", "base", "length")
    mask = F.expr("shiftleft(shiftleft(1L, k) - 1, at)")
    voted = hits(docs, parts, F.col(text_col), keep).groupBy("row", "t", "diagonal").agg(
        F.first("own").alias("own"), F.first("n_words").alias("n_words"), F.bit_or(mask).alias("mask"),
        F.min("place").alias("start"), F.max(F.col("place") + F.col("k") - 1).alias("end"))
    voted = voted.join(F.broadcast(known), "t", "left")
    beside = Window.partitionBy("row", "t").orderBy("diagonal")
    fresh = F.coalesce(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(beside) > GAP), F.lit(True))
    span = voted.withColumn("fresh", fresh.cast("int")).withColumn("span", F.sum("fresh").over(beside))
    span = span.groupBy("row", "t", "span").agg(
        *(F.first(c).alias(c) for c in ("own", "n_words", "label", "base", "length")),
        F.expr("bit_count(bit_or(mask))").alias("covered"), F.min("start").alias("start"), F.max("end").alias("end"))
    base = F.coalesce("base", F.lit(False))
    good = F.col("label").isNotNull() & (F.col("covered") * 10 >= F.col("length") * 9)
    shown = F.struct(F.col("start").cast("long").alias("start"), F.col("label").alias("label"), F.col("end").cast("long").alias("end"), (F.col("covered") / F.col("length")).alias("coverage"))

    def joined(of: Column) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(of, F.col("label")))), ",")

    return span.groupBy("row").agg(
        F.max_by("own", F.col("t") == 0).alias("own"), F.max_by("n_words", F.col("t") == 0).alias("n_words"), F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(good).alias("labels"), F.coalesce(F.max(F.col("covered") / F.col("length")), F.lit(0.0)).alias("score"),
        F.sort_array(F.collect_list(F.when(good & ~base, shown))).alias("spans"),
    ).drop("row")


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select("own.doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def _sql() -> str:
    parts = pieces()
    values = ", ".join(f"({t}, '{label}', {base}, {k}, {len(words)}, {at}, '{' '.join(words[at:at + k])}')" for t, label, base, k, words in parts for at in range(len(words) - k + 1))
    return rf"""
WITH templates(t, label, base, k, len, shift, gram) AS (VALUES {values}),
texts AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), places AS (
  SELECT r, w, unnest(generate_series(0, len(w) - 2)) AS i FROM texts WHERE len(w) >= 2
), grams AS (
  SELECT r, i, 2 AS k, w[i + 1] || ' ' || w[i + 2] AS gram FROM places
  UNION ALL SELECT r, i, 3 AS k, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS gram FROM places WHERE i + 3 <= len(w)
), votes AS (
  SELECT r, t, label, base, len, i - shift AS d, bit_or(((1::BIGINT << k) - 1) << shift) AS mask, min(i) AS start FROM grams JOIN templates USING (k, gram) GROUP BY ALL
), cut AS (
  SELECT *, CASE WHEN base OR d - lag(d) OVER o > {GAP} THEN 1 ELSE 0 END AS fresh FROM votes WINDOW o AS (PARTITION BY r, t ORDER BY d)
), spans AS (
  SELECT *, sum(fresh) OVER (PARTITION BY r, t ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM cut
), found AS (
  SELECT r, t, s, label, base, len, bit_count(bit_or(mask))::BIGINT AS covered, min(start) AS start FROM spans GROUP BY ALL
), told AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
    list_sort(list_distinct(list(label) FILTER (WHERE base))) AS base_labels, list_sort(list_distinct(list(label) FILTER (WHERE covered * 10 >= len * 9))) AS labels,
    max(covered::DOUBLE / len) AS score FROM found GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(array_to_string(base_labels, ','), '') AS base_labels, coalesce(array_to_string(labels, ','), '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM texts LEFT JOIN told USING (r)
"""


SQL = _sql()
