r"""Quality rules whose cutoffs are certified on labelled documents.

Each rule is a ratio of a document's text and a grid of cutoffs. In every stratum (a language, at most STRATA of them by
number of good labels; the rest and null are one) the good labelled documents are a holdout: a cutoff that would reject
k of n of them is certified if the exact binomial tail P(Bin(n, alpha) <= k) is at most delta / m, where alpha is the
allowed false rejection divided among the rules and m counts all (stratum, rule, cutoff) tests (Bonferroni). So with
probability 1 - delta no certified rule rejects more than its share of good documents in any stratum. Among the certified
cutoffs of a rule the one that best separates bad from good is used; a rule that has none, or that rejects no bad
document, stays off in that stratum.

Null texts are empty: no words, base_failed. A document may repeat or have a null id: statistics are of the row's own
text. A label counts once for each row with its id; labels without an id or a quality don't count. Texts are taken
whole. Built-in functions only; arrays are fixed by a one-element explode so that no lambda recomputes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage, table

SPACES = r"[ \t-\r]+"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_bangs")
#: Rule: its ratio and its cutoffs; a document is rejected if the ratio is greater.
RULES = {
    "symbols_per_word": ("n_symbols / n_words", (0.05, 0.1, 0.2, 0.4, 0.8, 1.6)),
    "caps_per_char": ("n_caps / word_chars", (0.05, 0.1, 0.2, 0.3, 0.5)),
    "bangs_per_word": ("n_bangs / n_words", (0.02, 0.05, 0.1, 0.25, 0.5)),
    "repeated_words": ("n_repeat_words / n_words", (0.02, 0.05, 0.1, 0.15)),
    "repeated_lines": ("n_dup_lines / n_lines", (0.05, 0.1, 0.2, 0.3)),
}
ALPHA, DELTA, STRATA = 0.05, 0.05, 32


def fixed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with an array column that is computed once a row, whatever refers to it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and its statistics as __q_<name> columns; every row for itself, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def number_of(chars: str) -> Column:
        return F.length(F.regexp_replace(text, f"[^{chars}]+", "")).cast("long")

    inner = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    df = fixed(docs, "__q_w", F.when(inner != "", F.split(inner, SPACES)).otherwise(F.array().cast("array<string>")))
    df = fixed(df, "__q_l", F.filter(F.split(text, "\n"), lambda x: F.rlike(x, F.lit(r"[^ \t-\r]"))))
    w = F.col("__q_w")
    df = fixed(df, "__q_h", F.when(F.size(w) >= 5, F.transform(F.sequence(F.lit(0), F.size(w) - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))))
               .otherwise(F.array().cast("array<bigint>")))
    again = F.size("__q_h") != F.size(F.array_distinct("__q_h"))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = fixed(df, "__q_s", F.when(again, F.sort_array(F.transform("__q_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none))
    s, n = F.col("__q_s"), F.size("__q_s")
    beside = F.zip_with(s, F.slice(s, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a["h"] == b["h"])  # with the next one
    df = fixed(df, "__q_e", beside)
    found = F.zip_with(s, F.concat(F.array(F.lit(False)), F.col("__q_e")), lambda a, b: F.struct(a["i"].alias("i"), b.alias("b")))
    found = F.zip_with(F.slice(found, 1, n), F.col("__q_e"), lambda a, e: F.when(F.coalesce(a["b"], F.lit(False)) | F.coalesce(e, F.lit(False)), a["i"]))
    df = fixed(df, "__q_p", F.when(n > 0, F.sort_array(F.array_compact(found))).otherwise(F.array().cast("array<int>")))
    p = F.col("__q_p")
    gaps = F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.least(F.coalesce(b - a, F.lit(5)), F.lit(5)))
    lines = F.col("__q_l")
    return df.withColumns({
        "__q_n_words": F.size(w).cast("long"),
        "__q_word_chars": F.length(F.array_join(w, "")).cast("long"),
        "__q_n_symbols": number_of("#*$%&|<>"),
        "__q_n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "__q_n_repeat_words": F.aggregate(gaps, F.lit(0), lambda t, x: t + x).cast("long"),
        "__q_n_lines": F.size(lines).cast("long"),
        "__q_n_caps": number_of("A-Z"),
        "__q_n_bangs": number_of("!"),
    }).drop("__q_w", "__q_l", "__q_h", "__q_s", "__q_e", "__q_p")


def base_failed() -> Column:
    return (F.col("__q_n_words") < 10) | (F.col("__q_n_repeat_words") * 100 > F.col("__q_n_words") * 20)


def ratio(rule: str) -> Column:
    over, under = RULES[rule][0].split(" / ")
    return F.coalesce(F.col(f"__q_{over}") / F.col(f"__q_{under}"), F.lit(0.0))


def tail(n: Column, k: Column, alpha: float) -> Column:
    """log P(Bin(n, alpha) <= k), each term from the one before it, added up as logarithms."""
    odds = F.lit(alpha / (1 - alpha))

    def add(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1) / i * odds)
        top = F.greatest(acc["sum"], term)
        return F.struct(term.alias("term"), (top + F.log(F.exp(acc["sum"] - top) + F.exp(term - top))).alias("sum"))

    first = n * F.log(F.lit(1 - alpha))
    steps = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(first.alias("term"), first.alias("sum")), add, lambda acc: acc["sum"])


def certify(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", lang_col: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, <rule>: cutoff or null): at most STRATA + 1 rows. stats: with_statistics of the documents."""
    seen = stats.where(~base_failed()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), *(ratio(r).alias(r) for r in RULES))
    seen = seen.join(labels.where("quality is not null").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("good")), "id")
    counts = [F.count_if((F.col(r) > c) & g).alias(f"{r}_{j}_{s}") for r, (_, cuts) in RULES.items() for j, c in enumerate(cuts) for s, g in (("good", F.col("good")), ("bad", ~F.col("good")))]
    by_lang = seen.groupBy("lang").agg(F.count_if("good").alias("n_good"), F.count_if(~F.col("good")).alias("n_bad"), *counts)
    by_lang = stage(by_lang, "languages")  # read three times below
    rank = F.row_number().over(Window.orderBy(F.col("n_good").desc(), "lang"))  # a row a language, summed up before
    own = by_lang.where("lang is not null").withColumn("rank", rank).withColumn("stratum", F.when(F.col("rank") <= STRATA, F.col("lang")))
    pooled = own.drop("rank").unionByName(by_lang.where("lang is null").withColumn("stratum", F.lit(None).cast("string")))
    pooled = pooled.groupBy("stratum").agg(*(F.sum(c).alias(c) for c in by_lang.columns if c != "lang"))
    each = F.explode(F.array(*(
        F.struct(F.lit(r).alias("rule"), F.lit(float(c)).alias("cutoff"), F.col(f"{r}_{j}_good").alias("k"), F.col(f"{r}_{j}_bad").alias("b"))
        for r, (_, cuts) in RULES.items() for j, c in enumerate(cuts)))).alias("t")
    tests = stage(pooled.select("stratum", "n_good", "n_bad", each).select("stratum", "n_good", "n_bad", "t.*"), "tests")  # read twice below
    m = tests.groupBy().agg(F.count("*").alias("m"))
    share = alpha / len(RULES)
    certified = (F.col("k") <= F.col("n_good") * share) & (tail(F.col("n_good"), F.col("k"), share) <= F.log(F.lit(delta) / F.col("m")))
    tests = tests.crossJoin(F.broadcast(m)).where((F.col("b") > 0) & certified)  # one row
    gain = F.round(F.col("b") / F.col("n_bad") - F.col("k") / F.col("n_good"), 9)
    best = tests.groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct(gain, "cutoff")).alias("cutoff"))
    return best.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))


def verdict(stats: DataFrame, cutoffs: DataFrame, lang_col: str = "lang") -> DataFrame:
    """stats with __q_kept: the base rules hold and no certified rule of the row's stratum rejects it."""
    strata = cutoffs.select(F.coalesce("stratum", F.lit("\0")).alias("__q_stratum"), *(F.col(r).alias(f"__q_cut_{r}") for r in RULES))
    named = strata.agg(F.collect_list("__q_stratum").alias("__q_named"))
    known = F.coalesce(F.col(lang_col), F.lit("\0"))
    df = stats.crossJoin(F.broadcast(named))  # one row of at most STRATA + 1 names
    df = df.withColumn("__q_stratum", F.when(F.array_contains("__q_named", known), known).otherwise(F.lit("\0")))
    df = df.join(F.broadcast(strata), "__q_stratum", "left")  # at most STRATA + 1 rows
    rejected = [F.coalesce(ratio(r) > F.col(f"__q_cut_{r}"), F.lit(False)) for r in RULES]
    any_of = rejected[0]
    for r in rejected[1:]:
        any_of = any_of | r
    return df.withColumn("__q_kept", ~base_failed() & ~any_of).drop("__q_stratum", "__q_named", *(f"__q_cut_{r}" for r in RULES))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that are kept, with its columns. Texts are read twice and never shuffled."""
    stats = with_statistics(docs, text_col)
    cutoffs = stage(certify(stats, labels, id_col, lang_col), "cutoffs")
    return verdict(stats, cutoffs, lang_col).where("__q_kept").select(*docs.columns)


def op1_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    stats = with_statistics(docs.select("doc_id", "text", "lang")).drop("text")
    stats = stage(stats, "statistics")
    cutoffs = stage(certify(stats, labels), "cutoffs")
    made = verdict(stats, cutoffs)
    return made.select("doc_id", *(F.col(f"__q_{c}").alias(c) for c in STATS[:5]), base_failed().alias("base_failed"), F.col("__q_kept").alias("kept"))


def _sql() -> str:
    tests = ", ".join(f"('{r}', {c})" for r, (_, cuts) in RULES.items() for c in cuts)
    ratios = ", ".join("coalesce({}::DOUBLE / nullif({}, 0), 0) AS {}".format(*e.split(" / "), r) for r, (e, _) in RULES.items())
    share = ALPHA / len(RULES)
    return rf"""
WITH docs AS (
  SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM docs WHERE len(w) >= 5)
), again AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(generate_series(0, 4)) AS k) GROUP BY doc_id
), stats AS (
  SELECT doc_id, lang, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
    len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(l) AS n_lines,
    length(text) - length(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS n_caps, length(text) - length(translate(text, '!', '')) AS n_bangs
  FROM docs LEFT JOIN covered USING (doc_id)
), rated AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, {ratios} FROM stats
), ratios AS (UNPIVOT (SELECT doc_id, lang, base_failed, {", ".join(RULES)} FROM rated) ON {", ".join(RULES)} INTO NAME rule VALUE ratio
), langs AS (
  SELECT lang, row_number() OVER (ORDER BY sum((quality = 1)::INT) DESC, lang) AS r FROM rated JOIN labels USING (doc_id)
  WHERE NOT base_failed AND quality IS NOT NULL AND lang IS NOT NULL GROUP BY lang
), held AS (
  SELECT doc_id, coalesce(CASE WHEN r <= {STRATA} THEN lang END, chr(1)) AS stratum, quality = 1 AS good, rule, ratio
  FROM ratios LEFT JOIN langs USING (lang) JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL
), tests AS (
  SELECT stratum, rule, c.cutoff, count(*) FILTER (WHERE good) AS n, count(*) FILTER (WHERE NOT good) AS nb,
    count(*) FILTER (WHERE good AND ratio > c.cutoff) AS k, count(*) FILTER (WHERE NOT good AND ratio > c.cutoff) AS b
  FROM held JOIN (VALUES {tests}) c(rule, cutoff) USING (rule) GROUP BY ALL
), tails AS (
  SELECT *, count(*) OVER () AS m, CASE WHEN k <= n * {share} THEN list_sum(list_transform(generate_series(0, k), lambda i:
    exp(lgamma(n + 1.0) - lgamma(i + 1.0) - lgamma(n - i + 1.0) + i * ln({share}) + (n - i) * ln(1 - {share})))) END AS tail FROM tests
), cutoffs AS (
  SELECT stratum, rule, arg_max(cutoff, round(b / nb - k / n, 9) + cutoff * 1e-12) AS cutoff FROM tails WHERE b > 0 AND tail <= {DELTA} / m GROUP BY ALL
), rejected AS (
  SELECT DISTINCT doc_id FROM ratios x LEFT JOIN langs USING (lang)
  JOIN cutoffs c ON c.rule = x.rule AND c.stratum = coalesce(CASE WHEN r <= {STRATA} THEN x.lang END, chr(1)) WHERE x.ratio > c.cutoff
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND r.doc_id IS NULL AS kept
FROM rated d LEFT JOIN rejected r USING (doc_id)
"""


SQL = _sql()
