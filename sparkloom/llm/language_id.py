"""Language of a text by interpolated Kneser-Ney character models.

Texts become streams of at most 64 symbols: one for everything between letters, one for each of the 47 commonest letters
(lower case), and 16 that all other letters share, dealt out in order of their frequency; so languages in scripts that few
texts have still differ by which of these follow each other. Per language a model of order 4 is counted over all training texts in Spark (rows are
added up before the shuffle) and kept as sorted arrays of hashed n-grams with their discounted probabilities, one array
per order, and back-off weights. A text's cross-entropy under each language is the mean over its symbols; the lowest one
is the prediction. The score is that language's softmax share with a temperature, and a text is marked rejected if its
cross-entropy is above nearly all of its language's calibration texts: both are calibrated on training texts that the
counts leave out.

Null texts and texts without a letter are ``und`` with score 0. Rows are mapped one by one, so ids may be null or repeat;
long texts are read whole. With nothing to learn from every text is ``und``. The model is bounded by 64 ** 4 n-grams a
language whatever the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import STEP_BYTES, U, mix, table

ORDER, SYMBOLS, DISCOUNT = 4, 64, 0.75
SHARED = 16  # symbols for the letters that have none of their own
REJECT = 0.999  # the share of calibration texts that are not to be rejected
GRAMS = SYMBOLS ** ORDER


def steps(batch: pa.RecordBatch, at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows and their lower-case texts, a bounded number of characters at a time."""
    texts, lo, size = [], 0, 0
    for k, t in enumerate(batch.column(at)):
        t = (t.as_py() or "").lower()
        if texts and size + len(t) > STEP_BYTES:
            yield batch.slice(lo, k - lo), texts
            texts, lo, size = [], k, 0
        texts.append(t)
        size += len(t)
    if texts:
        yield batch.slice(lo), texts


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text starts (a line end is put before every text)."""
    joined = "\n" + "\n".join(texts)
    first = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), first


def stream(symbols: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(grams, first): the ORDER symbols that end at each letter or gap, as one number; gaps are one symbol long."""
    points, first = code_points(texts)
    s = symbols[points]
    keep = np.concatenate(([True], (s[1:] != 0) | (s[:-1] != 0)))
    keep[first[:-1]] = True
    kept_before = np.concatenate(([0], np.cumsum(keep)))
    s, first = s[keep].astype(np.int64), kept_before[first]
    gram = s.copy()
    for k in range(1, ORDER):
        back = np.zeros_like(s)
        back[k:] = s[:-k]
        for j in range(k):  # what stands before a text is a gap
            at = first[:-1] + j
            back[at[at < first[1:]]] = 0
        gram += back << (6 * k)
    return gram, first


class Model:
    """Kneser-Ney probabilities of one language from its counts of ORDER-grams."""

    def __init__(self, grams: np.ndarray, times: np.ndarray):
        self.tables = []
        counts = times.astype(float)
        for order in range(ORDER, 0, -1):
            context = grams >> 6
            found, where = np.unique(context, return_inverse=True)
            total = np.bincount(where, counts, len(found))
            kinds = np.bincount(where, minlength=len(found))
            given = np.maximum(counts - DISCOUNT, 0) / total[where]
            weight = np.minimum(DISCOUNT * kinds / total, 1.0)
            self.tables.append((order, *self._sorted(order, grams, given), *self._sorted(order + 16, found, weight)))
            shorter = grams & ((1 << 6 * (order - 1)) - 1)  # continuation counts: in how many longer grams
            grams, counts = np.unique(shorter, return_counts=True)
            counts = counts.astype(float)

    @staticmethod
    def _hash(order: int, keys: np.ndarray) -> np.ndarray:
        return mix(keys.astype(U) ^ (U(order) << U(58)))

    def _sorted(self, order: int, keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self._hash(order, keys)
        by = np.argsort(h)
        return h[by], values[by]

    def log_probability(self, grams: np.ndarray) -> np.ndarray:
        p, weight = np.zeros(grams.shape), np.ones(grams.shape)
        for order, keys, given, contexts, shares in self.tables:
            part = grams & ((1 << 6 * order) - 1)
            p += weight * self._look(keys, given, self._hash(order, part), 0.0)
            weight *= self._look(contexts, shares, self._hash(order + 16, part >> 6), 1.0)
        return np.log(p + weight / SYMBOLS)

    @staticmethod
    def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
        if not len(keys):
            return np.full(wanted.shape, default)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], default)


class Scorer:
    """Cross-entropies of texts under all languages; probabilities of n-grams met before are kept."""

    def __init__(self, symbols: np.ndarray, models: list[Model]):
        self.symbols, self.models = symbols, models
        self.slot = np.full(GRAMS, -1, np.int32)
        self.values = np.zeros((0, len(models)), np.float32)

    def entropies(self, texts: list[str]) -> np.ndarray:
        grams, first = stream(self.symbols, texts)
        at = self.slot[grams]
        if (at < 0).any():
            new = np.unique(grams[at < 0])
            self.slot[new] = len(self.values) + np.arange(len(new))
            self.values = np.concatenate((self.values, np.stack([m.log_probability(new) for m in self.models], 1).astype(np.float32)))
            at = self.slot[grams]
        return -np.add.reduceat(self.values[at], first[:-1], 0) / np.diff(first)[:, None]


_scorers: dict = {}


def scorer(model) -> Scorer:
    """One per Python worker and model."""
    if model.value["id"] not in _scorers:
        _scorers.clear()
        _scorers[model.value["id"]] = Scorer(model.value["symbols"], model.value["models"])
    return _scorers[model.value["id"]]


def letter_counts(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for batch in batches:
            for _, part in steps(batch, 0):
                found, n = np.unique(code_points(part)[0], return_counts=True)
                total[found] += n
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["point", "n"])

    return texts.mapInArrow(run, "point long, n long").groupBy("point").agg(F.sum("n").alias("n"))


def gram_counts(texts: DataFrame, symbols) -> DataFrame:
    """(lang, gram, n) from rows (text, lang)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for rows, part in steps(batch, 0):
                langs = rows.column(1).to_pylist()
                for lang in set(langs):
                    found, n = np.unique(stream(symbols.value, [t for t, x in zip(part, langs) if x == lang])[0], return_counts=True)
                    if lang in held:
                        found, where = np.unique(np.concatenate((held[lang][0], found)), return_inverse=True)
                        n = np.bincount(where, np.concatenate((held[lang][1], n))).astype(np.int64)
                    held[lang] = found, n
        for lang, (found, n) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found)), pa.array(found), pa.array(n)], ["lang", "gram", "n"])

    return texts.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(train: DataFrame, calibrate: DataFrame):
    """A broadcast model from rows (text, lang); null languages don't count."""
    context = train.sparkSession.sparkContext
    train, calibrate = (df.where("lang is not null and text is not null").select("text", "lang") for df in (train, calibrate))
    points = letter_counts(train.select("text")).orderBy(F.desc("n"), "point").limit(4096).toArrow()
    own = SYMBOLS - 1 - SHARED
    symbols = np.array([own + 1 + c % SHARED if chr(c).isalpha() else 0 for c in range(0x110000)], np.uint8)
    common = [c for c in points["point"].to_pylist() if chr(c).isalpha()]
    at = np.arange(len(common))
    symbols[common] = np.where(at < own, at + 1, own + 1 + (at - own) % SHARED)
    counts = gram_counts(train, context.broadcast(symbols)).toArrow().to_pandas()
    langs = sorted(counts["lang"].unique())
    models = [Model(*(counts.loc[counts["lang"] == x, c].to_numpy() for c in ("gram", "n"))) for x in langs]
    model = {"id": uuid.uuid4().hex, "symbols": symbols, "langs": langs, "models": models, "beta": 20.0, "most": [99.0] * len(langs)}
    if not langs:
        return context.broadcast(model)
    betas = [2.0 ** k for k in range(8)]
    loss = [F.avg(F.element_at("losses", k + 1)).alias(f"l{k}") for k in range(len(betas))]
    seen = calibration(calibrate, context.broadcast(model), betas).where("loss_at >= 0")
    found = seen.groupBy("lang").agg(F.percentile_approx("entropy", REJECT, 1000).alias("most")).toArrow().to_pylist()
    mean = seen.agg(*loss).first()
    if mean[0] is not None:
        model["beta"] = betas[int(np.argmin(list(mean)))]
        most = {x["lang"]: x["most"] for x in found}
        model["most"] = [most.get(x, 99.0) for x in langs]
    return context.broadcast(model | {"id": uuid.uuid4().hex})


def calibration(texts: DataFrame, model, betas: list[float]) -> DataFrame:
    """Per text its own language's cross-entropy, and its log loss at each temperature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs = {x: k for k, x in enumerate(model.value["langs"])}
        for batch in batches:
            for rows, part in steps(batch, 0):
                entropy = scorer(model).entropies(part)
                own = np.array([langs.get(x, -1) for x in rows.column(1).to_pylist()])
                known, row = own >= 0, np.arange(len(part))
                losses = []
                for beta in betas:
                    x = -beta * entropy
                    x -= x.max(1, keepdims=True)
                    losses.append(np.log(np.exp(x).sum(1)) - x[row, own])
                cols = [rows.column(1), pa.array(np.where(known, own, -1)), pa.array(entropy[row, own].astype(float)), pa.array(np.stack(losses, 1).astype(float).tolist(), pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["lang", "loss_at", "entropy", "losses"])

    return texts.mapInArrow(run, "lang string, loss_at long, entropy double, losses array<double>")


def identify(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score, cross_entropy, rejected) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for rows, part in steps(batch, 1):
                lettered = np.array([any(map(str.isalpha, t)) for t in part]) & bool(m["langs"])
                n = len(part)
                pred, score, entropy, rejected = np.full(n, "und", object), np.zeros(n), np.full(n, np.nan), ~lettered
                if m["langs"]:
                    e = scorer(model).entropies(part)
                    best = e.argmin(1)
                    x = np.exp(-m["beta"] * (e - e.min(1, keepdims=True)))
                    pred = np.where(lettered, np.array(m["langs"], object)[best], "und")
                    entropy = np.where(lettered, e.min(1), np.nan)
                    score = np.where(lettered, 1 / x.sum(1), 0.0)
                    rejected = ~lettered | (e.min(1) > np.array(m["most"])[best])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(pred.tolist(), pa.string()), pa.array(score), pa.array(entropy.astype(float), from_pandas=True), pa.array(rejected)], ["doc_id", "lang_pred", "score", "cross_entropy", "rejected"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, lang_pred string, score double, cross_entropy double, rejected boolean")


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    part = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0))
    model = learn(docs.where((part == 0) | (part == 1)), docs.where(part == 3))
    return identify(docs, model).select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4, F.lit(0)) == 2).alias("held_out"), "lang_pred", "score", "rejected")
