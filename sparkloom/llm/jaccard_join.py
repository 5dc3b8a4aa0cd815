"""Near duplicates by n-gram Jaccard: a size-aware heavy-light set join.

A document's set holds its distinct word shingles. A set of n shingles can only link to one that shares at least
c = ceil(t * n) of them, so under any order of all shingles the first n - c + l of both sets have l in common.

* Small sets (n <= boundary) enumerate the 2-subsets of their first n - c + 2 shingles; two small sets that link share one.
* Large sets scan inverted lists: they and every small set near enough in size post their first n - c + 1 shingles.
* The boundary is the size at which enumerating starts to cost more rows than scanning lists of the measured length.
* The order puts shingles first that are in one set only, then those in few, those in very many last. How many sets hold
  a shingle is counted over all documents and marked in bitmaps of bounded size. A shingle of one set only isn't posted,
  so a document that shares nothing, or a passage that a third of all documents hold beside their own text, posts nothing.
* The bitmap of shared shingles grows with their number, from 8 to 64 MB. It is used however full it is: a set posts only if fewer
  than n - c + 1 of its shingles are found to be its own, and of a set that shares nothing that holds while a fifth of them are.
* Only one document of equal texts is counted and posts, so that copies of a text don't make its shingles shared ones.

Copies with equal sets are one class from the start. A list of k classes is not turned into k * k pairs (see pivots.py):
each class is compared with the member whose shingles are commonest, linked ones are one component, and of the others only those are
compared that differ from this member in the same shingles. No link between two different sets is lost: either both ends are
in one component already, or the pair itself is compared, by its whole sets of 64-bit hashes.

Nulls, empty texts and texts without words have an empty set and link with nothing. Rows that repeat are copies of one
class. Columns other than the id and the text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pivots import COMPARED, apart_pairs, compared, lists_of, merged, rows_of
from .shared import BITMAP_BITS, BITS, LOWER, SMALL_STEP, U, bitmap_array, components, lean, maybe_in, mix, prefix_hash, span_hash, split_by_filter, stage, table, text_steps, windows, words

SHINGLE = 5
PERCENT = 80
#: The least number of sets that is marked, and the factor from one level to the next.
LEVELS = (2, 8)
#: The bitmap of the least level has BITS bits, or up to FOLDS times as many (8 MB to 64 MB): SPARE bits for each shingle, if they do.
FOLDS, SPARE = 8, 4
#: Shingles that a task sums up at once; sizes from which on sets are counted together.
BLOCK, SIZES = 1_000_000, 1000
PAIR_MARK = U(0x5851F42D4C957F2D)


def shingle_sets(data: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first, n_words): text i has the sorted distinct hashes[first[i]:first[i + 1]]."""
    data = LOWER[data]
    start, end, first = words(data, offs)
    of_word = span_hash(prefix_hash(data), start, end)
    every = windows(of_word, size)
    sets, n_words = [], np.diff(first)
    for i in range(len(offs) - 1):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= size:
            found = np.sort(every[lo:hi - size + 1])
            sets.append(found[np.concatenate(([True], found[1:] != found[:-1]))])
        elif hi > lo:
            sets.append(windows(of_word[lo:hi], hi - lo) ^ U(hi - lo))
        else:
            sets.append(of_word[:0])
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    return np.concatenate(sets) if sets else of_word[:0], np.concatenate(([0], np.cumsum(n))), n_words


def set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set; 0 for an empty one."""
    total = np.concatenate((np.zeros(1, U), np.cumsum(mix(hashes ^ PAIR_MARK))))
    n = np.diff(first).astype(U)
    return np.where(n > 0, mix((total[first[1:]] - total[first[:-1]]) ^ mix(n)), U(0)).view(np.int64)


def row_key(id_col: str, text_col: str) -> F.Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def first_texts(docs: DataFrame, id_col: str, text_col: str) -> np.ndarray:
    """A filter of row_key(): one row of each group of equal texts, and few others, pass. Texts aren't shuffled, but hashes of 128 bits."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    hashed = docs.select(row_key(id_col, text_col).alias("row"), F.xxhash64(text).alias("x"), F.xxhash64(F.lit(1), text).alias("y"))
    return bitmap_array(hashed.groupBy("x", "y").agg(F.min("row").alias("row")), "row")


def commonness(docs: DataFrame, id_col: str, text_col: str, size: int, chosen) -> DataFrame:
    """In how many different sets each shingle is found, over all documents that pass the filter chosen of first_texts().

    Rows (bucket, fold, level, bitmap, shingles, times, squares): bitmap marks the shingles of a fold of a bucket of the hash space that
    are in at least `level` sets, the sums are of the bucket and stand in one of its rows; levels but the least have one fold. And rows
    (-1 - n, 0, 0, null, sets, null, null): how many sets have n shingles.
    Tasks send blocks of sorted 32-bit cells as differences, byte by byte, so that most of them take three bytes.
    """
    # A bucket's part that one task sums up at once stays small: more parts for more input.
    parts = 1 << max(0, (docs.rdd.getNumPartitions() // 500).bit_length())

    @lean
    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["bucket", "part", "cells", "sets"]
        sizes, held, ids, n_held = np.zeros(SIZES + 1, np.int64), [], [], 0

        def block() -> pa.RecordBatch:
            sid, one = np.unique(np.concatenate(ids), return_index=True)
            sets = [x for x in held for x in x]
            cells, times = np.unique(np.concatenate([sets[i] for i in one]) >> U(21), return_counts=True)
            place = (cells >> U(32)).astype(np.int64) * parts + (cells & U(parts - 1)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            place, low, times = place[order], (cells[order] & U(0xFFFFFFFF)).astype(np.uint32), np.minimum(times[order], 255).astype(np.uint8)
            at = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
            ends = np.append(at[1:], len(place))
            packed = []
            for lo, hi in zip(at, ends):
                step = np.diff(low[lo:hi], prepend=np.uint32(0))
                packed.append(np.concatenate((step.view(np.uint8).reshape(-1, 4).T.ravel(), times[lo:hi])).tobytes())
            return pa.RecordBatch.from_arrays([pa.array((place[at] // parts).astype(np.int32)), pa.array((place[at] % parts).astype(np.int32)), pa.array(packed, pa.binary()), pa.nulls(len(at), pa.int64())], names)

        for batch in batches:
            for rows, data, offs in text_steps(batch, most=SMALL_STEP):
                hashes, first, _ = shingle_sets(data, offs, size)
                n = np.diff(first) * maybe_in(chosen.value, rows.column(0).to_numpy())
                sizes += np.bincount(np.minimum(n, SIZES), minlength=SIZES + 1)
                full = np.flatnonzero(n)
                held.append([hashes[first[i]:first[i + 1]] for i in full])
                ids.append(set_ids(hashes, first)[full])
                n_held += len(hashes)
                if n_held >= BLOCK:
                    yield block()
                    held, ids, n_held = [], [], 0
        if n_held:
            yield block()
        n = np.flatnonzero(sizes)
        yield pa.RecordBatch.from_arrays([pa.array((-1 - n).astype(np.int32)), pa.array(np.zeros(len(n), np.int32)), pa.nulls(len(n), pa.binary()), pa.array(sizes[n])], names)

    def summed(key: tuple, rows: pa.Table) -> pa.Table:
        names = ["bucket", "fold", "level", "bitmap", "shingles", "times", "squares"]
        bucket = key[0].as_py()
        if bucket < 0:
            made = [(bucket, 0, 0, None, sum(rows["sets"].to_pylist()), None, None)]
        else:
            cells, times = [], []
            for packed in rows["cells"].to_pylist():
                body = np.frombuffer(packed, np.uint8)
                n = len(body) // 5
                cells.append(np.cumsum(body[:4 * n].reshape(4, n).T.copy().view(np.uint32).ravel(), dtype=np.uint32))
                times.append(body[4 * n:])
            cells, times = np.concatenate(cells), np.concatenate(times).astype(np.int64)
            order = np.argsort(cells, kind="stable")
            cells = cells[order]
            at = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
            times, cells = np.add.reduceat(times[order], at), cells[at]
            made, level = [], LEVELS[0]
            while (times >= level).any():
                cells, times = cells[times >= level], times[times >= level]
                sums = (len(cells), int(times.sum()), int((times * times).sum()))
                fold = cells // BITMAP_BITS % (FOLDS if level == LEVELS[0] else 1)
                for k in np.unique(fold).tolist():
                    marks = np.zeros(BITMAP_BITS, np.uint8)
                    marks[cells[fold == k] % BITMAP_BITS] = 1
                    made.append((bucket, k, level, np.packbits(marks, bitorder="little").tobytes(), *sums))
                    sums = (0, 0, 0)
                level *= LEVELS[1]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.Table.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*made) if made else [()] * 7, kinds)], names)

    cells = docs.select(row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text")).mapInArrow(blocks, "bucket int, part int, cells binary, sets long")
    return cells.groupBy("bucket", "part").applyInArrow(summed, "bucket int, fold int, level long, bitmap binary, shingles long, times long, squares long")


class Common:
    """Which shingles are in how many sets: a bitmap of the least level, and one of each of two others that don't fill it. Their size is bounded."""

    def __init__(self, counts: DataFrame):
        per = counts.where("level > 0").groupBy("level").agg(F.sum("shingles").alias("n"), F.sum("times").alias("times"), F.sum("squares").alias("squares"))
        per = sorted((r["level"], r["n"], r["times"], r["squares"]) for r in per.toLocalIterator())  # levels are powers
        #: A shingle that isn't marked is surely in one set only, so the least level is never left out.
        self.levels = [LEVELS[0], *[level for level, n, _, _ in per[1:] if n <= BITS // 3][:2]]
        known = {level: (n, times, squares) for level, n, times, squares in per}
        (n, t, s), (_, u, v) = (known.get(level, (0, 0, 0)) for level in (LEVELS[0], LEVELS[0] * LEVELS[1]))
        self.list_length = (s - v) / max(1, t - u)  # of the shared shingles that sets post first
        folds = 1
        while folds < FOLDS and folds * BITS < SPARE * n:
            folds *= 2
        self.packed = [np.zeros(BITS // 8 * k, np.uint8) for k in (folds, 1, 1)[:len(self.levels)]]
        chosen = counts.where(F.col("level").isin(self.levels)).groupBy("bucket", "level", (F.col("fold") % folds).alias("fold")).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        for row in chosen.toLocalIterator():
            packed = self.packed[self.levels.index(row["level"])]
            at = row["bucket"] * BITMAP_BITS // 8 + row["fold"] * BITS // 8
            packed[at:at + BITMAP_BITS // 8] = np.frombuffer(bytes(row["bitmap"]), np.uint8)

    def classes(self, hashes: np.ndarray) -> np.ndarray:
        """How many of the levels each shingle reaches: rarest 0, surely in one set only."""
        cell = hashes >> U(21)
        fold = (cell // U(BITMAP_BITS)).astype(np.int64)
        place = ((hashes >> U(53)).astype(np.int64) << 15) | (cell & U(BITMAP_BITS - 1)).astype(np.int64)
        out = np.zeros(len(hashes), np.int64)
        for packed in self.packed:
            at = place + fold % (len(packed) * 8 // BITS) * BITS
            out += (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return out


def choose_boundary(sizes: dict[int, int], list_length: float, percent: int) -> int:
    """The largest size whose sets are enumerated: 2-subsets of n - c + 2 shingles against n - c + 1 scanned lists."""
    best, cost, least = 0, 0.0, 0.0
    for n in sorted(sizes):
        spare = n - -(-percent * n // 100)
        subsets, scans = (spare + 2) * (spare + 1) / 2, (spare + 1) * (1 + list_length)
        cost += sizes[n] * (subsets - scans)
        if cost < least:
            best, least = n, cost
    return best


def profile(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int, common, chosen, boundary: int) -> DataFrame:
    """One pass over the texts: rows (doc_id, row, n, sid) of the documents (row: a hash of id and text), and rows (n, sid, key, score) of what the set of each document that passes the filter chosen posts (score: the lower, the commoner its shingles are), once for equal sets that one step meets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known = ["doc_id", "row", "n", "sid", "key", "score"], common.value
        for batch in batches:
            for rows, data, offs in text_steps(batch, most=SMALL_STEP):
                hashes, first, _ = shingle_sets(data, offs, size)
                sid, n = set_ids(hashes, first), np.diff(first)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(n), pa.array(sid), *(pa.nulls(len(rows), pa.int64()),) * 2], names)
                keep, may = np.zeros(len(n), bool), np.flatnonzero(maybe_in(chosen.value, rows.column(1).to_numpy()))
                keep[may[np.unique(sid[may], return_index=True)[1]]] = True
                owner = np.repeat(np.arange(len(n)), n)
                kind = known.classes(hashes)
                order = np.lexsort((hashes, kind, owner))  # rarest first
                hashes, kind = hashes[order], kind[order]
                rank = np.arange(len(hashes)) - first[:-1][owner]
                spare = n - -(-percent * n // 100)
                score = -(1000 * np.bincount(owner, kind, len(n)).astype(np.int64) // np.maximum(n, 1))
                posts = keep & (n > 0) & ((n > boundary) | (n * 100 >= percent * (boundary + 1)))
                mine = (kind > 0) & posts[owner] & (rank <= spare[owner])
                keys, of = [hashes[mine]], [owner[mine]]
                pairs = (kind > 0) & (keep & (n > 1) & (n <= boundary))[owner] & (rank <= spare[owner] + 1)
                head, whose = hashes[pairs], owner[pairs]
                at, many = np.unique(whose, return_index=True, return_counts=True)[1:]
                for i, k in zip(at[many > 1], many[many > 1]):
                    x, y = np.triu_indices(k, 1)
                    own = np.sort(head[i:i + k])
                    keys.append(mix(mix(own[x]) + own[y]) ^ PAIR_MARK)
                    of.append(np.full(len(x), whose[i]))
                keys, of = np.concatenate(keys), np.concatenate(of)
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.array(n[of]), pa.array(sid[of]), pa.array(keys.view(np.int64)), pa.array(score[of])], names)

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, "doc_id long, row long, n long, sid long, key long, score long")


def sets_of(docs: DataFrame, id_col: str, text_col: str, size: int, wanted: DataFrame) -> DataFrame:
    """(sid, shingles) of the sets of the wanted rows (row, sid), one for each sid; other texts stay where they are."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offs in text_steps(batch, most=SMALL_STEP):
                hashes, first, _ = shingle_sets(data, offs, size)
                lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(hashes.view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(hashes, first)), lists], ["sid", "shingles"])

    likely = split_by_filter(docs, row_key(id_col, text_col), wanted, "row")[1].select(F.col(text_col).alias("text"))
    made = likely.mapInArrow(run, "sid long, shingles array<long>")
    return made.join(wanted.select("sid"), "sid", "left_semi").groupBy("sid").agg(F.first("shingles").alias("shingles"))


def compare(star: DataFrame, sets: DataFrame, percent: int, common) -> DataFrame:
    """COMPARED rows of each (node, pivot): whether the sets link, and what the node posts of its differences from the pivot."""
    both = star.join(sets.select(F.col("sid").alias("node"), F.col("shingles").alias("x")), "node").join(sets.select(F.col("sid").alias("pivot"), F.col("shingles").alias("y")), "pivot")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.value
        for batch in batches:
            nodes, pivots, linked, sizes, posted = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], [], []
            for k in range(len(batch)):
                x, y = (batch.column(c)[k].values.to_numpy(zero_copy_only=False).view(U) for c in (2, 3))
                own, lacks = np.setdiff1d(x, y, True), np.setdiff1d(y, x, True)
                kind, lack_kind = known.classes(own), known.classes(lacks)
                # What only this set has is rarest; what few sets but the pivot have is what most of them lack.
                differences = np.concatenate((own[np.lexsort((own, kind))], lacks[np.lexsort((lacks, -lack_kind))]))
                linked.append(bool(len(differences) * (100 + percent) <= (len(x) + len(y)) * (100 - percent)))
                sizes.append(len(x))
                most = (100 - percent) * (len(x) + len(x) * 100 // percent) // (100 + percent)
                posted.append(rows_of(pivots[k], differences, most, int((kind == 0).sum()), False))
            yield compared(nodes, pivots, linked, sizes, posted)

    return both.select("node", "pivot", "x", "y").mapInArrow(run, COMPARED)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose whole sets link."""
    a = sets.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    b = sets.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    return (
        pairs.join(a, "a").join(b, "b")
        .where(shared * 100 >= (F.size("x") + F.size("y") - shared) * percent)
        .select("a", "b")
    )


def class_components(docs: DataFrame, lists: DataFrame, own: DataFrame, id_col: str, text_col: str, size: int, percent: int, common) -> DataFrame:
    """(node, component) of the linked classes; lists has (key, node, pivot), own (row, sid)."""
    star = stage(lists.where("node <> pivot").select("node", "pivot").distinct(), "star")
    wanted = stage(star.select(F.col("node").alias("sid")).union(star.select("pivot")).distinct(), "wanted")
    wanted = stage(own.join(wanted, "sid").groupBy("sid").agg(F.min("row").alias("row")), "wanted")
    sets = stage(sets_of(docs, id_col, text_col, size, wanted), "sets")
    rows = stage(compare(star, sets, percent, common), "compared")
    found = stage(components(rows.where("key is null and linked").select(F.col("node").alias("a"), F.col("pivot").alias("b"))), "components")
    most = f"({100 - percent} * (size_a + size_b)) div {100 + percent}"
    pairs = stage(apart_pairs(rows.where("key is not null").drop("linked", "pivot"), found, most), "pairs")
    return merged(found, verified(pairs, sets, percent))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, row, n_shingles, set_id, component_id, stays) of every row of docs.

    component_id is the smallest id reachable by links (100 * intersection >= percent * union), itself included. row is
    row_key() of the row; stays is true for its component's first row by (id, row), a null id last, and for empty sets.
    """
    spark = docs.sparkSession
    chosen = spark.sparkContext.broadcast(first_texts(docs, id_col, text_col))
    counts = stage(commonness(docs, id_col, text_col, size, chosen), "commonness")
    known = Common(counts)
    sizes = {-1 - r["bucket"]: r["n"] for r in counts.where("bucket < -1").groupBy("bucket").agg(F.sum("shingles").alias("n")).toLocalIterator()}
    boundary = choose_boundary(sizes, known.list_length, percent)
    common = spark.sparkContext.broadcast(known)
    seen = stage(profile(docs, id_col, text_col, size, percent, common, chosen, boundary), "profile")
    chosen.destroy()
    own = seen.where("key is null").select("doc_id", "row", "n", "sid")
    lists = stage(lists_of(seen.where("key is not null").select("key", F.col("sid").alias("node"), "score"), "score"), "lists")
    found = class_components(docs, lists, own, id_col, text_col, size, percent, common)
    common.destroy()  # all that used it is staged
    place = F.struct(F.coalesce("doc_id", F.lit(1 << 62)).alias("id"), "row")
    classes = own.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("lowest"), F.min(place).alias("first"))
    classes = classes.join(found, classes["sid"] == found["node"], "left").select("sid", "lowest", "first", F.coalesce("component", "sid").alias("component"))
    whole = classes.groupBy("component").agg(F.min("lowest").alias("component_id"), F.min("first").alias("first"))
    classes = stage(classes.drop("first").join(whole, "component").select("sid", "component_id", "first"), "classes")
    linked = own.where("n > 0").join(classes, "sid").select("doc_id", "row", "n", "sid", "component_id", (place == F.col("first")).alias("stays"))
    alone = own.where("n = 0").select("doc_id", "row", "n", "sid", F.col("doc_id").alias("component_id"), F.lit(True).alias("stays"))
    return linked.union(alone).withColumnsRenamed({"n": "n_shingles", "sid": "set_id"})


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs, with all their columns, that are the first of their component; of rows alike in id and text one.

    Texts that are surely not dropped are passed on without a shuffle.
    """
    found = stage(near_duplicates(docs, id_col, text_col, size, percent).where("n_shingles > 0").select("row", "stays"), "near")
    marks = found.groupBy("row").agg(F.count("*").alias("times"), F.max("stays").alias("stays")).where("times > 1 or not stays")
    marks = stage(marks.select(F.col("row").alias("__row"), F.col("stays").alias("__stays")), "marks")
    key = row_key(id_col, text_col)
    whole, touched = split_by_filter(docs, key, marks, "__row")
    touched = touched.withColumn("__row", key).join(marks, "__row", "left")
    plain, repeated = touched.where("__stays is null"), touched.where("__stays").dropDuplicates(["__row"])
    return whole.select(*docs.columns).union(plain.select(*docs.columns)).union(repeated.select(*docs.columns))


def op10_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words
), n AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) r USING (doc_id)
"""
