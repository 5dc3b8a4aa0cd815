"""Masked pseudo-likelihood: how well the words on both sides of every token predict it.

A token is a word (letters A-Z in lower case). Its id is one of 262,144: a word's shape (16 of them: length, letters
only, capitals, punctuation, other) and a hash of it. The commonest ids are classes of their own, all others belong to
the class of their shape, and one class stands outside the text. Its log-probability has two parts:

* A small network reads two tokens on each side (the class of the next one, and whether the one beyond is a common word,
  another word or outside) and predicts the masked token's class. It is trained in numpy on the complete table of
  windows of the corpus, whose size is fixed.
* Within a class of many words, the word is predicted from the very words left and right of it: counts of all
  (left, word, right) of the corpus, discounted and interpolated with the id's share of its class. The token itself is
  left out of the counts, so a passage that stands in the corpus once is predicted by the rest of the corpus only.

The contexts grow with the corpus and are never gathered: every step of texts adds up its own (context, word) pairs and
sends them, packed, to the bucket of their context (so a pair that is very frequent arrives once a step); the bucket
sends back a log-probability for each, to 1/1024. There is a bucket for about BUCKET tokens. A pair is known by 64 bits besides its
bucket: 40 of the context and 24 of the word. Where texts are read again after a loss, they have to come in the same
order, as from files or a staged table.

A document's score is the sum of its tokens' conditional log-probabilities; ``mean_log_prob`` divides by their number.
The result depends on neither partitioning nor order. Null texts and texts without words have no tokens, sum 0 and a
null mean. Ids may be null or repeat. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, U, mix, prefix_hash, span_hash, table, text_steps, words

CLASSES, SHAPES, IDS = 64, 16, 1 << 18
SUB = 64  # words told apart within an id
OUTSIDE = CLASSES - 1
OWN = CLASSES - SHAPES - 1  # ids with a class of their own
FAR = 3  # kinds of the token beyond the next one: outside, common, any other
SIDE = CLASSES * FAR
HIDDEN = 32
DISCOUNT = 0.75
BUCKET = 1 << 20
GRAIN = 1024  # what buckets send back are 16-bit multiples of 1 / GRAIN, so that sums don't depend on their order
_KIND = np.zeros(256, np.int64)
_KIND[list(b".,;:!?'\"()-")] = 1
_KIND[list(range(65, 91))] = 1 << 16
_KIND[list(b"#*$%&|<>@^~=+\\/_{}[]0123456789")] = 1 << 32


def token_ids(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id of every word, hash of every word, first word of every text)."""
    start, end, first = words(data, offs)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, U), first
    h = span_hash(prefix_hash(LOWER[data]), start, end)
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(_KIND[data] > 0)))
    capital, other = (np.concatenate((np.zeros(1, np.int64), np.cumsum(_KIND[data] == k))) for k in (1 << 16, 1 << 32))
    n_other, n_capital = other[end] - other[start], capital[end] - capital[start]
    kind = np.where(n_other > 0, 3, np.where(n_capital > 0, 2, np.where(total[end] > total[start], 1, 0)))
    size = np.searchsorted([4, 7, 11], end - start, "right")
    return (size * 4 + kind) * (IDS // SHAPES) + (h % U(IDS // SHAPES)).astype(np.int64), h, first


def shifted(x: np.ndarray, first: np.ndarray, by: int, outside) -> np.ndarray:
    """x of the token that stands `by` places on in the same text (before, if negative), or outside."""
    out = np.full(len(x), outside, x.dtype)
    if abs(by) < len(x):
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        here, there = (slice(0, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(0, by))
        out[here] = np.where(text[here] == text[there], x[there], x.dtype.type(outside))
    return out


def sides(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the network reads on the left and on the right of each token: CLASSES x FAR values each."""
    kind = np.where(classes < OWN, 1, 2)
    return tuple(shifted(classes, first, by, OUTSIDE) * FAR + shifted(kind, first, 2 * by, 0) for by in (-1, 1))


def counted(docs: DataFrame, text_col: str, cells: int, cell_of) -> np.ndarray:
    """How often each cell occurs among cell_of(ids, hashes, first) of all texts; each task adds up its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.int64)
        for batch in batches:
            for _, data, offs in text_steps(batch):
                total += np.bincount(cell_of(*token_ids(data, offs)), minlength=cells)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["cell", "n"])

    got = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(cells, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out


def train(counts: np.ndarray, rounds: int = 200, seed: int = 7) -> np.ndarray:
    """Log-probabilities [left, right, class] of the network that fits the counts [left, class, right] best.

    hidden = tanh(A[left] + B[right] + c), class ~ softmax(W hidden + b); all contexts in every step (Adam).
    """
    n = counts.transpose(0, 2, 1).reshape(SIDE * SIDE, CLASSES).astype(np.float32)
    total = max(float(n.sum(dtype=float)), 1.0)
    n /= total
    context = n.sum(1, keepdims=True)
    rng = np.random.default_rng(seed)
    p = {k: rng.normal(0, 0.3, shape).astype(np.float32) for k, shape in (("A", (SIDE, HIDDEN)), ("B", (SIDE, HIDDEN)), ("W", (HIDDEN, CLASSES)))}
    p |= {"c": np.zeros(HIDDEN, np.float32), "b": np.log(n.sum(0) + 1e-6)}
    m, v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def forward():
        hidden = np.tanh(p["A"][:, None] + p["B"][None] + p["c"]).reshape(-1, HIDDEN)
        z = hidden @ p["W"] + p["b"]
        z -= z.max(1, keepdims=True)
        return hidden, z - np.log(np.exp(z).sum(1, keepdims=True))

    for step in range(1, rounds + 1):
        hidden, log_p = forward()
        d = context * np.exp(log_p) - n
        back = ((d @ p["W"].T) * (1 - hidden * hidden)).reshape(SIDE, SIDE, HIDDEN)
        grad = {"A": back.sum(1), "B": back.sum(0), "c": back.sum((0, 1)), "W": hidden.T @ d, "b": d.sum(0)}
        for k, g in grad.items():
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = p[k] - 0.03 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-9)
    return forward()[1].reshape(SIDE, SIDE, CLASSES)


def learn(docs: DataFrame, text_col: str = "text") -> dict:
    """Classes, the network's table, the log of each id's share of its class and the number of tokens, from all texts."""
    times = counted(docs, text_col, IDS, lambda ids, hashes, first: ids)
    class_of = np.arange(IDS) // (IDS // SHAPES) + OWN
    common = np.lexsort((np.arange(IDS), -times))[:OWN]
    class_of[common] = np.arange(OWN)

    def cell(ids: np.ndarray, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        classes = class_of[ids]
        left, right = sides(classes, first)
        return (left * CLASSES + classes) * SIDE + right

    counts = counted(docs, text_col, SIDE * CLASSES * SIDE, cell).reshape(SIDE, CLASSES, SIDE)
    smooth = times + 0.5
    share = np.log(smooth) - np.log(np.maximum(np.bincount(class_of, smooth, CLASSES), 1e-9))[class_of]
    return {"class_of": class_of, "table": train(counts), "share": share, "tokens": int(times.sum())}


def pairs(ids: np.ndarray, hashes: np.ndarray, classes: np.ndarray, first: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, pair) of every token: 40 bits of the context (words left and right, own class) over 24 of the word."""
    left, right = (shifted(hashes, first, by, 0) for by in (-1, 1))
    context = mix(mix(left) * U(3) + mix(right ^ U(1)) + classes.astype(U))
    word = ids.astype(U) * U(SUB) + (hashes >> U(58))
    return (context % U(buckets)).astype(np.int64), (mix(context) >> U(24)) << U(24) | word


def pair_log_probs(pair: np.ndarray, times: np.ndarray, share: np.ndarray) -> np.ndarray:
    """The log-probability of each pair's word in its context; each pair may come several times, with its count in times."""
    found, where = np.unique(pair, return_inverse=True)
    n = np.bincount(where, times, len(found))
    _, context = np.unique(found >> U(24), return_inverse=True)
    total, kinds = np.bincount(context, n)[context] - 1, np.bincount(context)[context] - (n == 1)
    base = np.exp(share[((found & U(0xFFFFFF)) // U(SUB)).astype(np.int64)]) / SUB
    some = np.maximum(total, 1)
    p = np.where(total > 0, (np.maximum(n - 1 - DISCOUNT, 0) + DISCOUNT * kinds * base) / some, base)
    return np.log(p)[where]


def narrow(which: np.ndarray) -> bytes:
    """Numbers of pairs in three bytes each where that is enough, else in four."""
    wide = which.astype("<u4").view(np.uint8).reshape(-1, 4)
    return wide[:, :3].tobytes() if not wide[:, 3].any() else wide.tobytes()


def widened(data: bytes, n: int) -> np.ndarray:
    if n == 0:
        return np.zeros(0, np.uint32)
    wide = np.zeros((n, 4), np.uint8)
    wide[:, :len(data) // n] = np.frombuffer(data, np.uint8).reshape(n, -1)
    return wide.view("<u4").ravel()


PARTS = "bucket long, block long, part long, a binary, b binary"
DOCUMENTS = -1  # the part of a block that holds its documents


def sent(docs: DataFrame, model, buckets: int) -> DataFrame:
    """Per step of texts one row a bucket (pairs, counts), and one with its documents, their network sums and pair of each token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        block = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows, data, offs in text_steps(batch):
                ids, hashes, first = token_ids(data, offs)
                classes = m["class_of"][ids]
                left, right = sides(classes, first)
                net = np.concatenate(([0], np.cumsum(m["table"][left, right, classes], dtype=float)))
                many = np.flatnonzero(classes >= OWN)  # in a class of one id nothing is left to predict
                bucket, pair = (x[many] for x in pairs(ids, hashes, classes, first, buckets))
                order = np.lexsort((pair, bucket))
                bucket, pair = bucket[order], pair[order]
                new = np.concatenate(([True], (bucket[1:] != bucket[:-1]) | (pair[1:] != pair[:-1])))[:len(pair)]
                which = np.empty(len(many), np.uint32)
                which[order] = np.cumsum(new) - 1
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(pair))).astype(np.uint32)
                bucket, pair = bucket[at], pair[at]
                cuts = np.searchsorted(bucket, np.append(np.unique(bucket), buckets))
                doc_id = rows.column(0)
                about = np.stack((
                    doc_id.fill_null(0).to_numpy(zero_copy_only=False), doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                    np.diff(first), np.diff(np.searchsorted(many, first)), (net[first[1:]] - net[first[:-1]]).view(np.int64)))
                out = [(int(bucket[lo]), block, int(bucket[lo]), pair[lo:hi].tobytes(), times[lo:hi].tobytes()) for lo, hi in zip(cuts, cuts[1:])]
                out.append((block % buckets, block, DOCUMENTS, narrow(which), about.tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), [pa.int64()] * 3 + [pa.binary()] * 2)], ["bucket", "block", "part", "a", "b"])
                block += 1

    return docs.mapInArrow(run, PARTS)


def answered(parts: pa.Table, model) -> pa.Table:
    """One bucket: log-probabilities instead of pairs and counts; rows of documents as they are."""
    part, a, b = (parts.column(x).to_pylist() for x in ("part", "a", "b"))
    asked = [k for k, x in enumerate(part) if x != DOCUMENTS]
    pair = np.concatenate([np.frombuffer(a[k], U) for k in asked] or [np.zeros(0, U)])
    times = np.concatenate([np.frombuffer(b[k], np.uint32) for k in asked] or [np.zeros(0, np.uint32)])
    logs = np.minimum(np.rint(-GRAIN * pair_log_probs(pair, times, model.value["share"])), 65_535).astype(np.uint16)
    lo = 0
    for k in asked:
        n = len(a[k]) // 8
        a[k], b[k], lo = logs[lo:lo + n].tobytes(), b"", lo + n
    return pa.table({"bucket": parts.column("bucket"), "block": parts.column("block"), "part": parts.column("part"), "a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})


def summed(parts: pa.Table) -> pa.Table:
    """One block: a row of every document."""
    part, a, b = (parts.column(x).to_pylist() for x in ("part", "a", "b"))
    order = sorted(range(len(part)), key=lambda k: part[k])
    logs = np.concatenate([np.frombuffer(a[k], np.uint16) for k in order[1:]] or [np.zeros(0, np.uint16)]).astype(np.int64)
    ids, null, n, asked, net = np.frombuffer(b[order[0]], np.int64).reshape(5, -1)
    total = np.concatenate(([0], np.cumsum(-logs[widened(a[order[0]], int(asked.sum()))]))) / GRAIN
    last = np.cumsum(asked)
    log_prob = np.where(n > 0, net.view(float) + total[last] - total[last - asked], 0.0)
    mean = np.where(n > 0, log_prob / np.maximum(n, 1), np.nan)
    return pa.table({"doc_id": pa.array(ids, mask=null == 1), "n_tokens": pa.array(n), "log_prob": pa.array(log_prob), "mean_log_prob": pa.array(mean, from_pandas=True)})


def score(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob) of every row; the contexts are those of docs itself."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = sent(slim, known, model["tokens"] // BUCKET + 1)
    replies = parts.groupBy("bucket").applyInArrow(lambda t: answered(t, known), PARTS)
    return replies.groupBy("block").applyInArrow(summed, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")


def op4_masked_lm(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    made = score(docs, learn(docs))
    return made.select("doc_id", "n_tokens", F.round("log_prob", 4).alias("log_prob"), F.round("mean_log_prob", 6).alias("mean_log_prob"))
