"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is a position of the chain with two states, bad and good. Its features are shares of character
kinds, words and repetition of the line itself and of the lines before and after it. Forward-backward gives each line's
marginal of being good; their mean, weighted by line length, is the document's quality, which one logistic step turns
into a probability.

Weights are fitted in numpy on at most FIT_DOCS labelled documents (those with the smallest hash of their id; of rows with one id one) and at most
FIT_LINES lines in a row of each. Labels of lines are hidden: a good document's lines are good, of a bad one's at most half, and which
these are is learned. Scoring covers every line of every text. Texts without a word
(null, empty) have no good line and get the score of mean 0. Rows are scored one by one, so ids may be null or repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, U, mix, prefix_hash, span_hash, table, text_steps, windows, words

FIT_DOCS, FIT_LINES = 4000, 96
KINDS = np.zeros(256, np.uint8)
for _k, _chars in enumerate((range(65, 91), range(97, 123), range(48, 58), b"!", b"|", b"#*$%&<>@^~=+\\/_{}[]", b".,;:?'\"()-"), 1):
    KINDS[list(_chars)] = _k
KINDS[128:] = 2  # bytes of other letters count as lower case
N_OWN = 13


def line_table(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, length in words, first): text i has the lines first[i]:first[i + 1], those without a word left out."""
    ends = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate((offs[:-1], ends + 1)))
    start = start[start < len(data)]
    end = np.concatenate((start[1:], [len(data)]))[:len(start)] if len(start) else start
    w0, w1, w_first = words(data, offs)
    at = np.searchsorted(w0, np.concatenate((start, [len(data)])))
    n_words = np.diff(at)
    keep = n_words > 0
    start, end, at0, at1, n_words = start[keep], end[keep], at[:-1][keep], at[1:][keep], n_words[keep].astype(float)
    kind = KINDS[data]

    def count(k: int) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(kind == k)))
        return (total[end] - total[start]).astype(float)

    upper, lower, digit, bang, pipe, symbol, point = (count(k) for k in range(1, 8))
    letters = np.maximum(upper + lower, 1)
    doc = np.searchsorted(offs, start, "right") - 1
    h = prefix_hash(LOWER[data])
    line_hash = mix(span_hash(h, start, end) ^ mix(doc.astype(U)))
    _, first_at, group = np.unique(line_hash, return_index=True, return_inverse=True)
    again_line = (first_at[group] != np.arange(len(start))).astype(float) if len(start) else np.zeros(0)
    of_word = span_hash(h, w0, w1)
    five = windows(of_word, 5)
    w_doc = np.searchsorted(w_first, np.arange(len(w0)), "right") - 1
    repeat = np.zeros(len(w0) + 1)
    if len(five):
        inside = w_doc[:-4] == w_doc[4:]
        keys = mix(five ^ mix(w_doc[:-4].astype(U)))[inside]
        _, group, times = np.unique(keys, return_inverse=True, return_counts=True)
        hit = np.flatnonzero(inside)[times[group] > 1]
        for k in range(5):
            repeat[hit + k] = 1
    repeat = np.concatenate(([0], np.cumsum(repeat[:-1])))
    echo = np.zeros(len(w0))
    echo[1:] = (of_word[1:] == of_word[:-1]) & (w_doc[1:] == w_doc[:-1])
    echo = np.concatenate(([0], np.cumsum(echo)))
    size = (end - start).astype(float)
    own = np.stack([upper / letters, digit / size, bang / n_words, pipe / n_words, symbol / n_words, point / n_words, np.log1p(n_words),
                    letters / n_words / 10, again_line, (repeat[at1] - repeat[at0]) / n_words, np.log1p(symbol + pipe), np.log1p(bang), (echo[at1] - echo[at0]) / n_words], 1)
    first = np.searchsorted(start, offs)
    return own, n_words, first


def with_neighbours(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's features with those of the line before and after it in its text (zeros at the ends), and a constant."""
    n = len(own)
    before, after = np.zeros_like(own), np.zeros_like(own)
    if n:
        before[1:], after[:-1] = own[:-1], own[1:]
        edges = first[:-1][np.diff(first) > 0]
        before[edges] = 0
        after[first[1:][np.diff(first) > 0] - 1] = 0
    return np.concatenate((own, before, after, np.ones((n, 1))), 1)


def chain(emit: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of state 1, expected transitions (2, 2) and log normalisers; emit: log potential of state 1 over 0.

    All chains advance together, longest first, so step t works on those that are longer than t.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    size, begin = lengths[order], first[:-1][order]
    steps = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(steps), "left")
    pair = np.stack((np.zeros_like(emit), emit), 1)
    ahead, behind, scale = np.zeros((len(emit), 2)), np.ones((len(emit), 2)), np.zeros(len(emit))
    factor = np.exp(move)
    top = pair.max(1)
    potential = np.exp(pair - top[:, None])
    for t in range(steps):
        at = begin[:active[t]] + t
        now = potential[at] if t == 0 else (ahead[at - 1] @ factor) * potential[at]
        total = now.sum(1)
        ahead[at], scale[at] = now / total[:, None], np.log(total) + top[at]
    for t in range(steps - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        now = (behind[at + 1] * potential[at + 1]) @ factor.T
        behind[at] = now / now.sum(1, keepdims=True)
    both = ahead * behind
    marginal = both[:, 1] / both.sum(1) if len(both) else np.zeros(0)
    linked = np.ones(len(emit), bool)
    linked[first[1:][lengths > 0] - 1] = False
    at = np.flatnonzero(linked)
    joint = ahead[at][:, :, None] * factor[None] * (potential[at + 1] * behind[at + 1])[:, None, :]
    joint = (joint / joint.sum((1, 2), keepdims=True)).sum(0) if len(at) else np.zeros((2, 2))
    return marginal, joint, scale


def believed(marginal: np.ndarray, n_words: np.ndarray, first: np.ndarray, label: np.ndarray) -> np.ndarray:
    """How good each line is, given its document's label as well: all lines of a good document are; of a bad one at most half, weighted by length, so
    that the lines' log odds move down together until they say so."""
    owner = np.repeat(np.arange(len(label)), np.diff(first))
    odds, weight = _logit(marginal), np.bincount(owner, n_words, len(label))
    low, high = np.zeros(len(label)), np.full(len(label), 20.0)
    for _ in range(30):
        shift = (low + high) / 2
        share = np.bincount(owner, n_words / (1 + np.exp(shift[owner] - odds)), len(label)) / np.maximum(weight, 1e-9)
        low, high = np.where(share > 0.5, shift, low), np.where(share > 0.5, high, shift)
    return np.where(label[owner] > 0, 1.0, 1 / (1 + np.exp(high[owner] - odds)))


def fit(own: np.ndarray, n_words: np.ndarray, first: np.ndarray, label: np.ndarray, rounds: tuple[int, ...] = (90, 100, 60)) -> dict:
    """Weights by gradient ascent of the conditional likelihood (Adam, small L2), then the logistic step.

    Labels of lines are hidden. At first they are their document's, and only a line's own features count, so lines that good and bad documents have alike stay
    undecided; then, with the chain and all features, they become what the model and the document's label say together.
    """
    mean, dev = own.mean(0), own.std(0) + 1e-6
    x = with_neighbours((own - mean) / dev, first)
    y = np.repeat(label, np.diff(first)).astype(float)
    linked = np.ones(len(y), bool)
    linked[first[1:][np.diff(first) > 0] - 1] = False
    at = np.flatnonzero(linked)
    theta, alone = np.zeros(x.shape[1] + 4), np.zeros(x.shape[1] + 4)
    alone[:own.shape[1]] = alone[-5] = 1  # a line's own features and the constant
    for k, steps in enumerate(rounds):
        if k:
            y = believed(chain(x @ theta[:-4], theta[-4:].reshape(2, 2), first)[0], n_words, first, label)
        pair = np.stack((1 - y, y), 1)
        seen = pair[at].T @ pair[at + 1]
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, steps + 1):
            w, move = theta[:-4], theta[-4:].reshape(2, 2)
            marginal, joint, _ = chain(x @ w, move, first)
            grad = np.concatenate((x.T @ (y - marginal), (seen - joint).ravel())) / len(label) - 2e-3 * theta
            m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
            theta = theta + 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8) * (1 if k else alone)
    model = {"mean": mean, "dev": dev, "w": theta[:-4], "move": theta[-4:].reshape(2, 2), "a": 1.0, "b": 0.0}
    q = quality(model, own, n_words, first)
    z, a, b = _logit(q), 1.0, 0.0
    for _ in range(200):
        p = 1 / (1 + np.exp(-(a * z + b)))
        g, k = p - label, p * (1 - p) + 1e-6
        hess = np.array([[np.sum(k * z * z) + 1e-3, np.sum(k * z)], [np.sum(k * z), np.sum(k) + 1e-3]])
        d = np.linalg.solve(hess, [np.sum(g * z) + 1e-3 * (a - 1), np.sum(g)])
        a, b = a - 0.5 * d[0], b - 0.5 * d[1]
    return model | {"a": max(float(a), 0.05), "b": float(b)}


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def line_marginals(model: dict, own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The probability of each line to be good."""
    return chain(with_neighbours((own - model["mean"]) / model["dev"], first) @ model["w"], model["move"], first)[0]


def quality(model: dict, own: np.ndarray, n_words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' good marginals; 0 where there is no line. A text's sums don't depend on the texts beside it."""
    n = len(first) - 1
    owner = np.repeat(np.arange(n), np.diff(first))
    good, total = np.bincount(owner, line_marginals(model, own, first) * n_words, n), np.bincount(owner, n_words, n)
    return np.where(total > 0, good / np.maximum(total, 1), 0.0)


def stretch(a: int, b: int, n_words: np.ndarray) -> tuple[int, int]:
    """The lines a:b, or FIT_LINES of them in a row, beginning at a place that the text's own lines give."""
    if b - a <= FIT_LINES:
        return a, b
    start = a + int(mix(np.array([int(n_words[a:b].sum()) + (b - a)], U))[0] % U(b - a - FIT_LINES + 1))
    return start, start + FIT_LINES


def learn(docs: DataFrame, labels: DataFrame, fit_docs: int = FIT_DOCS) -> dict:
    """A model from the labelled rows of docs (doc_id, text); at most fit_docs of them are used."""
    chosen = docs.select("doc_id").where("doc_id is not null").join(labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("label")), "doc_id")
    chosen = chosen.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_steps(batch):
                own, n_words, first = line_table(data, offs)
                spans = [(y, *stretch(a, b, n_words)) for y, a, b in zip(rows.column(1).to_pylist(), first[:-1].tolist(), first[1:].tolist()) if b > a]
                out = [(y, own[a:b].ravel().tolist(), n_words[a:b].tolist()) for y, a, b in spans]
                yield pa.RecordBatch.from_pydict({"label": [x[0] for x in out], "own": [x[1] for x in out], "n_words": [x[2] for x in out]}, pa.schema([("label", pa.int32()), ("own", pa.list_(pa.float64())), ("n_words", pa.list_(pa.float64()))]))

    rows = docs.join(F.broadcast(chosen), "doc_id")  # fit_docs ids at most; of rows with one id one, picked before the shuffle
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("label").alias("label")).select("text", "label")
    got = rows.mapInArrow(run, "label int, own array<double>, n_words array<double>").toArrow()
    label = got["label"].to_numpy().astype(float)
    if len(set(label)) < 2:  # nothing to tell apart: one more of each kind, without weight for any feature
        return {"mean": np.zeros(N_OWN), "dev": np.ones(N_OWN), "w": np.zeros(3 * N_OWN + 1), "move": np.zeros((2, 2)), "a": 1.0, "b": 4.0 if len(label) and label[0] else 0.0}
    n_words = got["n_words"].combine_chunks()
    first = np.concatenate(([0], np.cumsum(np.array([len(x) for x in got["n_words"].to_pylist()]))))
    own = got["own"].combine_chunks().flatten().to_numpy().reshape(-1, N_OWN)
    return fit(own, n_words.flatten().to_numpy(), first, label)


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, quality, n_lines) of every row."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for batch in batches:
            for rows, data, offs in text_steps(batch):
                own, n_words, first = line_table(data, offs)
                q = quality(m, own, n_words, first)
                p = 1 / (1 + np.exp(-(m["a"] * _logit(q) + m["b"])))
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(p), pa.array(q), pa.array(np.diff(first))], ["doc_id", "score", "quality", "n_lines"])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, score double, quality double, n_lines long")


def op3_line_crf(spark, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = learn(docs.where(~held_out), labels.where(~held_out))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_lines")
