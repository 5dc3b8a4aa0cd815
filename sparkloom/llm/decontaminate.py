"""Training documents that hold benchmark items, whole or edited.

Texts are words: letters A-Z in lower case, ASCII punctuation as space; of scripts that are written without spaces every
character is a word. A document is compared with every item it shares
a run of GRAM words with, however common that run is. The item is aligned with the document by Smith-Waterman (match 2,
mismatch and gap -1). The score is the alignment's share of a perfect one; a document leaks an item if it is at least
LEAST.

What is not aligned can't reach LEAST: an alignment of an item of n words with a score of at least LEAST has at least
LEAST * n matches and covers at most (3 - 2 * LEAST) * n words of the document (its mismatches and gaps cost one each).
So items of which the document holds too few words are left out, and of the others only the windows of that many words
that hold enough words of the item are aligned.

The benchmark is taken in blocks of at most BLOCK_RUNS runs, so what is sent to every task is bounded whatever its size;
each block is one pass over the corpus. Texts are never shuffled. Null and empty texts leak nothing. An item of fewer than
GRAM words is leaked by a document that holds all its words in a row; an item of less than LEAST_WORDS can't be told from
ordinary text and is not looked for. Items with equal text are found together. Rows are judged one by one, so ids may be null or
repeat; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import LOWER, SMALL_STEP, U, lean, prefix_hash, span_hash, table, text_steps, windows, words

GRAM, LEAST, LEAST_WORDS = 4, 0.4, 2
BLOCK_RUNS = 2_000_000
PLAIN = LOWER.copy()
PLAIN[[c for c in range(33, 128) if not chr(c).isalnum()]] = 32


class Block:
    """A part of the benchmark: items, their words' hashes, and sorted runs with the items they stand in."""

    def __init__(self, items: list[tuple[int, np.ndarray]]):
        self.short = {}  # of items below GRAM words, by their number: the whole run and the item
        for i, w in items:
            if len(w) < GRAM:
                self.short.setdefault(len(w), []).append((int(windows(w, len(w))[0]), i))
        items = [x for x in items if len(x[1]) >= GRAM]
        self.ids = [i for i, _ in items]
        self.words = [w for _, w in items]
        runs = [windows(w, GRAM) for w in self.words]
        flat = np.concatenate(runs) if runs else np.zeros(0, U)
        item = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
        order = np.argsort(flat, kind="stable")
        self.item = item[order]
        self.runs, self.first = np.unique(flat[order], return_index=True)
        self.end = np.append(self.first[1:], len(flat))
        # the different words of each item, and how often it has them
        each = [np.unique(w, return_counts=True) for w in self.words]
        self.own = [w for w, _ in each]
        self.times = [n for _, n in each]

    def where(self, runs: np.ndarray) -> np.ndarray:
        """Index in self.runs of each run, or -1."""
        if not len(self.runs):
            return np.full(len(runs), -1)
        at = np.minimum(np.searchsorted(self.runs, runs), len(self.runs) - 1)
        return np.where(self.runs[at] == runs, at, -1)


def document_runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, runs, whether a run is within one text, first word of each text)."""
    data = PLAIN[data]
    # The first two bytes of a character of U+3000-9FFF, or of U+0E00-0EFF, 1000-109F, 1780-17FF, in UTF-8: three bytes each.
    lead = np.flatnonzero((data >= 0xE0) & (data <= 0xE9))
    lead = lead[lead + 2 < len(data)]
    a, b = data[lead], data[lead + 1]
    lead = lead[(a >= 0xE3) | ((a == 0xE0) & (b >= 0xB8) & (b <= 0xBB)) | ((a == 0xE1) & ((b <= 0x82) | (b == 0x9E) | (b == 0x9F)))]
    start, end, first = words(data, offs, np.concatenate((lead, lead + 3)))
    of_word = span_hash(prefix_hash(data), start, end)
    runs = windows(of_word, GRAM)
    doc = np.searchsorted(first, np.arange(len(of_word)), "right") - 1
    return of_word, runs, doc[:len(runs)] == doc[GRAM - 1:] if len(runs) else np.zeros(0, bool), first


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """The benchmark read item by item; held at a time: one block."""
    held, size = [], 0
    slim = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("text")).where("i is not null and text is not null")
    for row in slim.orderBy("i").toLocalIterator(prefetchPartitions=False):
        body = np.frombuffer(row["text"].encode("utf-8"), np.uint8)
        of_word = document_runs(body, np.array([0, len(body)]))[0]
        if len(of_word) >= LEAST_WORDS:
            if held and size + len(of_word) > BLOCK_RUNS:
                yield Block(held)
                held, size = [], 0
            held.append((row["i"], of_word))
            size += len(of_word)
    if held:
        yield Block(held)


def align(item: np.ndarray, part: np.ndarray) -> int:
    """The best local alignment score of two word sequences; each row of the table at once."""
    best, above = 0, np.zeros(len(part) + 1, np.int64)
    slope = np.arange(len(part) + 1)
    for w in item:
        row = np.zeros_like(above)
        row[1:] = np.maximum(above[:-1] + np.where(part == w, 2, -1), above[1:] - 1)
        np.maximum(row, 0, out=row)
        above = np.maximum.accumulate(row + slope) - slope  # a gap in the item costs one a word
        best = max(best, int(above.max()))
    return best


def covering(item: np.ndarray, own: np.ndarray, of_word: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of a text outside of which no alignment with the item reaches LEAST."""
    n = len(item)
    size, need = int(np.ceil((3 - 2 * LEAST) * n)), int(np.ceil(LEAST * n - 1e-9))
    at = np.minimum(np.searchsorted(own, of_word), len(own) - 1)
    held = np.concatenate(([0], np.cumsum(own[at] == of_word)))
    size = min(size, len(of_word))
    good = np.flatnonzero(held[size:] - held[:len(held) - size] >= need)
    if not len(good):
        return []
    gap = np.flatnonzero(np.diff(good) > size)  # windows that neither overlap nor touch
    return list(zip(good[np.append(0, gap + 1)].tolist(), (good[np.append(gap, len(good) - 1)] + size).tolist()))


def leaks_of(block: Block, of_word: np.ndarray, items: np.ndarray) -> list[tuple[int, float, int, int]]:
    """(item, score, first word, end word) of one text, of the items it shares a run with."""
    different, times = np.unique(of_word, return_counts=True)
    sizes = np.array([len(block.own[k]) for k in items])
    own = np.concatenate([block.own[k] for k in items])
    at = np.minimum(np.searchsorted(different, own), len(different) - 1)
    both = np.where(different[at] == own, np.minimum(times[at], np.concatenate([block.times[k] for k in items])), 0)
    matches = np.add.reduceat(both, np.cumsum(sizes) - sizes)
    out = []
    for k in items[matches >= LEAST * np.array([len(block.words[k]) for k in items]) - 1e-9].tolist():
        item = block.words[k]
        best = max(((align(item, of_word[a:b]) / (2 * len(item)), a, b) for a, b in covering(item, block.own[k], of_word)), default=(0.0, 0, 0), key=lambda x: x[0])
        if best[0] >= LEAST:
            out.append((block.ids[k], *best))
    return out


def text_leaks(block: Block, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, list]]:
    """(row, leaks) of the rows that have any; a row may come twice, for long and for short items."""
    of_word, runs, inside, first = document_runs(data, offs)
    at = block.where(runs)
    hit = np.flatnonzero((at >= 0) & inside)
    doc = np.searchsorted(first, hit, "right") - 1
    for cut in np.split(np.arange(len(hit)), np.flatnonzero(np.diff(doc)) + 1) if len(hit) else []:
        row = int(doc[cut[0]])
        items = np.unique(np.concatenate([block.item[block.first[j]:block.end[j]] for j in np.unique(at[hit[cut]])]))
        if found := leaks_of(block, of_word[first[row]:first[row + 1]], items):
            yield row, found
    for size, items in block.short.items():
        runs = windows(of_word, size)
        wanted = np.unique(np.array([h for h, _ in items], U))
        for k in np.flatnonzero(np.isin(runs, wanted)).tolist():
            row = int(np.searchsorted(first, k, "right")) - 1
            if k + size <= first[row + 1] and not np.isin(runs[first[row]:k], runs[k]).any():  # the first place in this text
                yield row, [(i, 1.0, k - int(first[row]), k - int(first[row]) + size) for h, i in items if h == int(runs[k])]


def prepared(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text: str) -> Iterator:
    """The benchmark's blocks, broadcast."""
    for block in blocks(benchmark, item_col, item_text):
        yield docs.sparkSession.sparkContext.broadcast(block)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, score, first_word, end_word) for every leaked item of every row of docs."""
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"

    def found(block) -> DataFrame:
        @lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in text_steps(batch, most=SMALL_STEP):
                    ids = rows.column(0)
                    out = [(ids[row].as_py(), *x) for row, own in text_leaks(block.value, data, offs) for x in own]
                    cols = list(zip(*out)) if out else [[]] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "first_word", "end_word"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)

    out = None
    for block in prepared(docs, benchmark, item_col, item_text):
        out = found(block) if out is None else out.union(found(block))
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that leak no item."""
    at = docs.columns.index(text_col)
    for block in prepared(docs, benchmark, item_col, item_text):

        @lean
        def run(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for rows, data, offs in text_steps(batch, text_col, SMALL_STEP):
                    clean = np.ones(len(rows), bool)
                    clean[[row for row, _ in text_leaks(block.value, data, offs)]] = False
                    yield rows if clean.all() else rows.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op6_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("score", 6).alias("score"))
