"""Near-equal lines by a segment-partition edit join.

Two lines (of at least MIN_CHARS code points) link if their edit distance is at most EDITS. A line is cut into EDITS + 1
segments; a line within the distance holds at least one of them unchanged, at a place that the lengths and the segment's
number allow. So every line posts its own segments and, for each length it can link to, the substrings at those places;
lines that meet under one (length, segment number, content) are candidates, which a banded bit-parallel edit distance
verifies (code point by code point, for many pairs at once).

Nearly all keys are one line's alone. So tasks first send packed marks of their keys, by which the shared ones are found; these
set bits of a filter of fixed size, and a second pass over the texts posts what the filter lets through, with the lines' bodies. Marks and filter
may let through more, never less; the lists are then made by whole keys.

Equal lines are one class from the start; a task posts a class once for each step. The lines of one posting are not
paired (see pivots.py): each is compared with the posting's commonest line, linked ones are one component, and of the others
only those are compared that differ from what most of them have in the same q-grams (two lines within EDITS differ in at most
2 * GRAM * EDITS of them). So thousands of lines that share a segment and have other words elsewhere are not all compared.

Shorter lines are compared exactly: they link if they are equal. Lines without a word are no lines.

In a component the first line of the smallest row (by id, then by text) stays; ``without_repeats`` drops the others and
joins the rest of the text again. Nulls and empty texts have no lines; rows with one id
and one text are one row, kept or cut alike; long lines and texts are taken whole. Columns other than id and text pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pivots import COMPARED, apart_pairs, compared, merged, rows_of
from .shared import BITS, SMALL_STEP, STEP, U, bitmap_array, components, lean, maybe_in, mix, prefix_hash, span_hash, split_by_filter, stage, table

EDITS, MIN_CHARS = 2, 24
#: Code points of a gram of the differences; postings that a task holds at once; bits of the filter of shared keys (16 MB).
GRAM, BLOCK, FILTER_BITS = 3, 1_000_000, 2 * BITS
#: Lines of a list whose common grams are what its lines are held against.
SAMPLE = 8
#: Kinds of code points that are counted in a line.
KINDS = 16


def places(edits: int) -> list[tuple[int, int, int]]:
    """(shorter by, segment, shift): where a line can hold a segment of a line that is that much shorter."""
    out = []
    for less in range(edits + 1):
        for seg in range(edits + 1):
            for shift in range(-edits, edits + 1):
                if abs(shift) <= seg and abs(shift - less) <= edits - seg:
                    out.append((less, seg, shift))
    return out


def segments(length: np.ndarray, edits: int) -> np.ndarray:
    """Starts of the edits + 1 nearly equal segments, and the end, of lines of these lengths."""
    k = edits + 1
    small, wide = length // k, length % k
    at = np.arange(k + 1)
    return at * small[:, None] + np.maximum(0, at - (k - wide[:, None]))


class Lines:
    """The lines of some texts as code points."""

    def __init__(self, texts: list[str], least: int):
        joined = "\n".join(texts) + "\n"
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.end = np.flatnonzero(self.points == 10)
        self.start = np.concatenate(([0], self.end[:-1] + 1)) if len(self.end) else self.end
        ends = np.cumsum([len(t) + 1 for t in texts])
        self.text = np.searchsorted(ends, self.start, "right")
        first = np.searchsorted(self.start, np.concatenate(([0], ends[:-1])))
        self.number = np.arange(len(self.start)) - first[self.text]
        word = np.concatenate(([0], np.cumsum((self.points != 0x20) & ((self.points < 0x09) | (self.points > 0x0D)))))
        keep = (self.end - self.start >= least) & (word[self.end] > word[self.start])
        self.start, self.end, self.text, self.number = (x[keep] for x in (self.start, self.end, self.text, self.number))
        self.h = prefix_hash(self.points)
        self.hash = span_hash(self.h, self.start, self.end)

    def strings(self, which: np.ndarray) -> list[str]:
        return [self.points[a:b].tobytes().decode("utf-32-le", "surrogatepass") for a, b in zip(self.start[which], self.end[which])]


def line_steps(batches: Iterator[pa.RecordBatch], at: int, least: int) -> Iterator[tuple[pa.RecordBatch, Lines]]:
    for batch in batches:
        texts, lo, size = [], 0, 0
        for k, t in enumerate(batch.column(at)):
            t = t.as_py() or ""
            if texts and size + len(t) > SMALL_STEP // 2:
                yield batch.slice(lo, k - lo), Lines(texts, least)
                texts, lo, size = [], k, 0
            texts.append(t)
            size += len(t)
        if texts:
            yield batch.slice(lo), Lines(texts, least)


def posted(lines: Lines, one: np.ndarray, edits: int, least: int) -> tuple[np.ndarray, ...]:
    """(keys, of, own) of what the lines one post; of: index into one, own: a segment of the line itself at its place."""
    start, length = lines.start[one], (lines.end - lines.start)[one]
    keys, of, own = [], [], []
    for less, seg, shift in places(edits):
        to = length - less
        cuts = segments(to, edits)
        a, b = cuts[:, seg] + shift, cuts[:, seg + 1] + shift
        ok = np.flatnonzero((to >= least) & (a >= 0) & (b <= length))
        content = span_hash(lines.h, start[ok] + a[ok], start[ok] + b[ok])
        keys.append(mix(content ^ mix(to[ok].astype(U) * U(edits + 1) + U(seg))))
        of.append(ok)
        own.append(np.full(len(ok), less == 0 and shift == 0))
    return np.concatenate(keys), np.concatenate(of), np.concatenate(own)


def marks(keys: np.ndarray, bits: int) -> np.ndarray:
    """What is kept of keys while it is counted which are shared: the bucket of `bits` bits and 32 bits within it."""
    return (keys >> U(64 - bits)) << U(32) | keys & U(0xFFFFFFFF)


def shared_marks(docs: DataFrame, bits: int, edits: int, least: int) -> DataFrame:
    """(at): two places in a filter of each mark under which different lines meet, one of them with its own segment.

    Tasks send what they have by buckets, packed: for each mark one line, whether it is one of several there, and whether one is
    its own. So a bucket has a mark once for each block, however many lines are under it.
    """

    @lean
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def block() -> pa.RecordBatch:
            at, of, own = (np.concatenate(x) for x in zip(*held))
            order = np.argsort(at)
            at, of, own = at[order], of[order], own[order]
            new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            low, several, own = at[new], np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new), np.logical_or.reduceat(own, new)
            bucket, of = (low >> U(32)).astype(np.int32), of[new]
            cuts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
            low, flags = low.astype(np.uint32), several.astype(np.uint8) * np.uint8(2) + own
            packed = [low[i:j].tobytes() + of[i:j].tobytes() + flags[i:j].tobytes() for i, j in zip(cuts, np.append(cuts[1:], len(low)))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), pa.array(packed, pa.binary())], ["bucket", "packed"])

        for _, lines in line_steps(batches, 0, least):
            one = np.unique(lines.hash, return_index=True)[1]
            keys, of, own = posted(lines, one, edits, least)
            held.append((marks(keys, bits), lines.hash[one[of]], own))
            n_held += len(keys)
            if n_held >= BLOCK:
                yield block()
                held, n_held = [], 0
        if n_held:
            yield block()

    def met(key: tuple, rows: pa.Table) -> pa.Table:
        low, of, flags = [], [], []
        for packed in rows["packed"].to_pylist():
            n = len(packed) // 13
            for to, kind, offset in ((low, np.uint32, 0), (of, U, 4 * n), (flags, np.uint8, 12 * n)):
                to.append(np.frombuffer(packed, kind, n, offset))
        low, of, flags = (np.concatenate(x) for x in (low, of, flags))
        order = np.argsort(low, kind="stable")
        low, of, flags = low[order], of[order], flags[order]
        new = np.flatnonzero(np.concatenate(([True], low[1:] != low[:-1])))
        flags = np.bitwise_or.reduceat(flags, new)
        several = (flags & 2 > 0) | (np.minimum.reduceat(of, new) != np.maximum.reduceat(of, new))
        found = low[new[several & (flags & 1 > 0)]].astype(U) | U(key[0].as_py()) << U(32)
        return pa.Table.from_arrays([pa.array(np.concatenate(filter_places(found)))], ["at"])

    packed = docs.select("text").mapInArrow(blocks, "bucket int, packed binary")
    return packed.groupBy("bucket").applyInArrow(met, "at long")


def filter_places(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two keys for the filter of each mark: what is let through by chance stays little when the filter has filled up by a tenth."""
    once = mix(found)
    return once.view(np.int64), mix(once ^ STEP).view(np.int64)


def meeting(docs: DataFrame, wanted, bits: int, edits: int, least: int) -> DataFrame:
    """What the filter lets through: rows (key, line, own, times) of what a line posts, times: how often a step has the line; and rows (null, line, null, null, body) of these lines."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, lines in line_steps(batches, 0, least):
            hashes, one, times = np.unique(lines.hash, return_index=True, return_counts=True)
            keys, of, own = posted(lines, one, edits, least)
            once, twice = filter_places(marks(keys, bits))
            hit = np.flatnonzero(maybe_in(wanted.value, once))
            hit = hit[maybe_in(wanted.value, twice[hit])]
            with_body = np.unique(of[hit])
            n, m = len(hit), len(with_body)
            of = np.concatenate((of[hit], with_body))
            none = np.arange(n + m) >= n
            columns = [pa.array(np.concatenate((x, np.zeros(m, x.dtype))), mask=none) for x in (keys[hit].view(np.int64), own[hit], times[of[:n]].astype(np.int64))]
            body = pa.array([None] * n + lines.strings(one[with_body]), pa.string())
            yield pa.RecordBatch.from_arrays([columns[0], pa.array(hashes[of].view(np.int64)), *columns[1:], body], ["key", "line", "own", "times", "body"])

    return docs.select("text").mapInArrow(run, "key long, line long, own boolean, times long, body string")


def banded_distance(a: list[str], b: list[str], edits: int) -> np.ndarray:
    """Edit distance of each pair, or more than edits; a band of 2 * edits + 1 diagonals in the bits of one word.

    Bit edits + d of a pair's words is the cell d rows off the diagonal. The deltas move along the diagonals, column by
    column of the longer string, all pairs at once.
    """
    swap = [len(x) > len(y) for x, y in zip(a, b)]
    short = [y if s else x for x, y, s in zip(a, b, swap)]
    long = [x if s else y for x, y, s in zip(a, b, swap)]
    m, n = np.array(list(map(len, short))), np.array(list(map(len, long)))
    out = np.full(len(a), edits + 1)
    order = np.argsort(-n, kind="stable")
    order = order[(n - m)[order] <= edits]
    if not len(order):
        return out
    m, n = m[order], n[order]
    pad = 2 * edits + 2  # room around each string, so that the band never reads another one

    def laid(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        body = ("\0" * pad).join(strings[i] for i in order)
        text = "\0" * pad + body + "\0" * pad
        sizes = np.array([len(strings[i]) for i in order])
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), pad + np.concatenate(([0], np.cumsum(sizes + pad)[:-1]))

    p, p_at = laid(short)
    q, q_at = laid(long)
    width = 2 * edits + 1
    one, mask = np.int64(1), np.int64((1 << width) - 1)
    # bit k at column j: row j + k - edits of the shorter string; vp, vn: vertical deltas between neighbouring rows
    vp = np.full(len(order), int(mask) & -(1 << edits), np.int64)
    vn = np.zeros(len(order), np.int64)
    score = np.zeros(len(order), np.int64)  # along the main diagonal of the band's bit edits
    columns = int(n[0])
    active = np.searchsorted(-n, -np.arange(columns), "left")
    for j in range(columns):
        k = active[j]
        match = np.zeros(k, np.int64)
        c = q[q_at[:k] + j]
        for bit in range(width):
            row = j + bit - edits
            if row >= 0:
                at = np.minimum(p_at[:k] + row, len(p) - 1)
                match |= np.where((p[at] == c) & (row < m[:k]), one << bit, 0)
        v, w = vp[:k], vn[:k]
        diagonal = ((((match & v) + v) ^ v) | match | w) & mask
        plus = (w | ~(diagonal | v)) & mask
        minus = diagonal & v
        down = diagonal >> 1
        late = j >= m[:k]  # below the shorter string's end: walk right along its last row
        bit = np.where(late, m[:k] - 1 - j + edits, 0)
        score[:k] += np.where(late, ((plus >> bit) & 1) - ((minus >> bit) & 1), ((diagonal >> edits) & 1) ^ 1)
        vp[:k] = (minus | ~(down | plus)) & mask
        vn[:k] = down & plus
    out[order] = np.where(score <= edits, score, edits + 1)
    return out


def verified(pairs: DataFrame, bodies: DataFrame, edits: int) -> DataFrame:
    """Those of the pairs (a, b), with their other columns, whose lines are within edits."""
    names = pairs.columns
    both = pairs.join(bodies.withColumnsRenamed({"line": "a", "body": "x"}), "a").join(bodies.withColumnsRenamed({"line": "b", "body": "y"}), "b")
    both = both.where(F.abs(F.length("x") - F.length("y")) <= edits).select(*names, "x", "y")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                part = batch.slice(lo, 2000)
                near = banded_distance(part.column(len(names)).to_pylist(), part.column(len(names) + 1).to_pylist(), edits) <= edits
                yield part.filter(pa.array(near)).select(list(range(len(names))))

    return both.mapInArrow(run, pairs.schema)


def grams(line: str) -> np.ndarray:
    """Sorted different 64-bit elements, one for each gram and each time it occurs."""
    c = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    n = max(0, len(c) - GRAM + 1)
    g = np.zeros(n, U)
    for k in range(GRAM):
        g = g << U(21) | c[k:k + n]
    g.sort()
    new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if n else np.zeros(0, np.int64)
    nth = np.arange(n) - np.repeat(new, np.diff(np.append(new, n)))
    return np.unique(mix(mix(g) + nth.astype(U)))


def letters(lines: list[str]) -> np.ndarray:
    """How many code points of each remainder a line has: an edit changes these counts by 2 at most."""
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32) % KINDS
    owner = np.repeat(np.arange(len(lines)), list(map(len, lines)))
    return np.bincount(owner * KINDS + points, minlength=len(lines) * KINDS).reshape(-1, KINDS)


def samples(star: DataFrame, bodies: DataFrame) -> DataFrame:
    """(pivot, others): some lines of each list of SAMPLE lines or more, one for each remainder of the hash."""
    of = F.array_compact(F.array(*(F.min(F.when(F.pmod("node", F.lit(SAMPLE)) == k, F.col("node"))) for k in range(SAMPLE))))
    some = star.groupBy("pivot").agg(of.alias("some"), F.count("*").alias("n")).where(f"n >= {SAMPLE}").select("pivot", F.explode("some").alias("line"))
    return some.join(bodies, "line").groupBy("pivot").agg(F.collect_list("body").alias("others"))


def compare(star: DataFrame, bodies: DataFrame, edits: int) -> DataFrame:
    """COMPARED rows of each (node, pivot): whether the lines are within edits, and what the node posts of its differences.

    These are the differences from what most of a long list's sampled lines have (any one set per pivot will do, and how well
    it is chosen tells on the number of comparisons only): lines with one change each differ from it in one change, not in two.
    """
    both = star.join(bodies.select(F.col("line").alias("node"), F.col("body").alias("x")), "node").join(bodies.select(F.col("line").alias("pivot"), F.col("body").alias("y")), "pivot")
    both = both.join(stage(samples(star, bodies), "samples"), "pivot", "left")

    def middle(y: str, others: list[str] | None) -> np.ndarray:
        if not others:
            return grams(y)
        found, times = np.unique(np.concatenate([grams(t) for t in others]), return_counts=True)
        return found[2 * times > len(others)]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_pivot = {}
        for batch in batches:
            for lo in range(0, len(batch), 2000):
                nodes, pivots, x, y, others = batch.slice(lo, 2000).columns
                nodes, pivots, x, y = (c.to_pylist() for c in (nodes, pivots, x, y))
                linked = banded_distance(x, y, edits) <= edits
                posted = []
                for k, (p, t) in enumerate(zip(pivots, x)):
                    if p not in of_pivot:
                        of_pivot = {p: middle(y[k], others[k].as_py())}  # rows of a pivot come one after the other
                    g, h = grams(t), of_pivot[p]
                    # What others have not is rarer than what others lack as well.
                    posted.append(rows_of(p, np.concatenate((np.setdiff1d(g, h, True), np.setdiff1d(h, g, True))), 2 * GRAM * edits))
                yield compared(nodes, pivots, linked, list(map(len, x)), posted, letters(x))

    return both.select("node", "pivot", "x", "y", "others").mapInArrow(run, COMPARED)


def line_components(docs: DataFrame, edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(node, component) of the different lines of docs (text) that have near-equal ones, as line hashes."""
    spark = docs.sparkSession
    bits = 2 + docs.rdd.getNumPartitions().bit_length()  # so a bucket stays small, whatever the input
    wanted = spark.sparkContext.broadcast(bitmap_array(shared_marks(docs, bits, edits, least), "at", FILTER_BITS))
    rows = stage(meeting(docs, wanted, bits, edits, least), "meeting")
    wanted.destroy()  # the driver's copy as well
    by_key = Window.partitionBy("key")
    lists = rows.where("key is not null").groupBy("key", "line").agg(F.max("own").alias("own"), (-F.sum("times")).alias("score"))
    lists = lists.withColumns({"pivot": F.min(F.struct("score", "line")).over(by_key)["line"], "lo": F.min("line").over(by_key), "hi": F.max("line").over(by_key), "some": F.max("own").over(by_key)})
    star = stage(lists.where("lo <> hi and some and line <> pivot").select(F.col("line").alias("node"), "pivot").distinct(), "star")
    bodies = stage(rows.where("key is null").groupBy("line").agg(F.min("body").alias("body")), "bodies")
    rows = stage(compare(star, bodies, edits), "compared")
    found = stage(components(rows.where("key is null and linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "components")
    pairs = stage(apart_pairs(rows.where("key is not null").drop("linked", "pivot"), found, f"{2 * GRAM * edits}", 
        f"abs(size_a - size_b) <= {edits} and aggregate(zip_with(sketch_a, sketch_b, (x, y) -> abs(x - y)), 0, (t, x) -> t + x) <= {2 * edits}"), "pairs")
    return merged(found, verified(pairs, bodies, edits))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, number, line, component, stays) of every line that is not the only one of its component.

    row is a hash of the row's id and text; number is the line's place in its text, from 0.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(text_col).alias("text")).where("text is not null")
    found = line_components(slim, edits, least)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, lines in line_steps(batches, 2, 1):
            at = pa.array(lines.text)
            yield pa.RecordBatch.from_arrays([rows.column(0).take(at), rows.column(1).take(at), pa.array(lines.number.astype(np.int32)), pa.array(lines.hash.view(np.int64))], ["id", "row", "number", "line"])

    every = slim.mapInArrow(run, "id long, row long, number int, line long")
    place = F.struct(F.coalesce("id", F.lit(1 << 62)).alias("id"), "row", "number")
    each = every.join(found, every["line"] == found["node"], "left").select("id", "row", "number", "line", F.coalesce("component", "line").alias("component"))
    each = stage(each, "places")
    firsts = stage(each.groupBy("component").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts")  # so that the join can split a component
    return each.join(firsts, "component").select(F.col("id").alias("doc_id"), "row", "number", "line", "component", (place == F.col("first")).alias("stays"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size_col: str | None = "n_chars", edits: int = EDITS, least: int = MIN_CHARS) -> DataFrame:
    """docs with every line but the first of each component cut out of its text; size_col, if there, is counted anew."""
    cut = stage(line_classes(docs, id_col, text_col, edits, least).where("not stays").select("doc_id", "row", "number").distinct(), "cut")
    row = F.xxhash64(F.col(id_col), F.col(text_col))
    whole, touched = split_by_filter(docs, row, cut, "row")
    cuts = cut.groupBy(F.col("row").alias("__row"), F.col("doc_id").alias("__id")).agg(F.collect_list("number").alias("__cut"))  # bounded by a text's lines
    same = (row == F.col("__row")) & F.col(id_col).cast("long").eqNullSafe(F.col("__id"))
    touched = touched.join(cuts, same, "left")
    kept = F.filter(F.split(F.col(text_col), "\n"), lambda line, k: ~F.array_contains("__cut", k))
    changes = {text_col: F.when(F.col("__cut").isNotNull(), F.array_join(kept, "\n")).otherwise(F.col(text_col))}
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        changes[size_col] = F.when(F.col("__cut").isNotNull(), F.length(changes[text_col]).cast(kind)).otherwise(F.col(size_col))
    return whole.select(*docs.columns).union(touched.withColumns(changes).select(*docs.columns))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: how many of its lines are in a class of several, how many stay, and the classes."""
    docs = table(spark, sf_dir, "documents")
    found = line_classes(docs)
    per = found.groupBy("doc_id").agg(F.count("*").alias("n_shared"), F.count_if(~F.col("stays")).alias("n_dropped"), F.sort_array(F.collect_set("component")).alias("classes"))
    return docs.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n_shared", F.lit(0)).cast("long").alias("n_shared"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce("classes", F.array().cast("array<bigint>")).alias("classes"))
