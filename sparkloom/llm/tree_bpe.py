"""BPE encoding and decoding by tree concatenation.

A text is cut where the tokenizer never merges (its own pieces). Text without such a cut is encoded as two halves, each
again as two halves, and joined: a growing window around the join is encoded anew until its ends are the tokens both
sides have there. Texts of at most LONG characters are encoded within a task; longer ones are cut into parts that tasks
all over the cluster encode, and joined pairwise, level by level.

Null and empty texts have no tokens and decode to the empty text. Special strings inside a text become their tokens, as
the library does by default. Ids may be null or repeat; each row is encoded for itself.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import DIRECT, WORD_SPLIT, Vocabulary
from .shared import lean, stage, table

LONG, PART = 1 << 20, 1 << 16


class WordEncoder:
    """A vocabulary of lower-case words with word ends; keeps the encodings of a bounded number of pieces.

    When KEPT pieces have come, those before them are forgotten; what is still asked for stays.

    Special strings are looked up in a table of their own, which is never cleared.
    """

    KEPT = 100_000

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        library = Tokenizer.from_file(path)
        self.normalize, self.cut = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self.split = regex.compile(WORD_SPLIT)
        self.unusual, self.newer = regex.compile("[ɐ-\U0010ffff]"), regex.compile("[Ԁ-\U0010ffff]")
        encoder = self

        special = {s: np.array([i], "<u4").tobytes() for s, i in self.v.specials.items()}

        class Ids(dict):
            def __missing__(self, piece: str) -> bytes:
                if piece in special:
                    return special[piece]
                out = encoder.older_ids.get(piece)
                if out is None:
                    units = encoder.v.units(piece)
                    ids = encoder.v.encode_tree(units) if len(units) > DIRECT else encoder.v.encode_units(units)
                    out = np.array(ids, "<u4").tobytes()
                if len(self) >= encoder.KEPT:
                    encoder.older_ids, encoder.older_names = dict(self), dict(encoder.names)
                    self.clear()
                    encoder.names.clear()
                if len(piece) <= 64:
                    self[piece] = out
                return out

        class Names(dict):
            def __missing__(self, piece: str) -> str:
                out = encoder.older_names.get(piece)
                if out is None:
                    out = encoder.decode(encoder.ids[piece])
                if len(piece) <= 64:
                    self[piece] = out
                return out

        self.ids, self.names = Ids(), Names()
        self.older_ids: dict[str, bytes] = {}
        self.older_names: dict[str, str] = {}

    def decode(self, ids: bytes) -> str:
        """Token texts joined by spaces: the file names no decoder."""
        names = self.v.names
        return " ".join(names[i] if i in names else self.special_name(i) for i in np.frombuffer(ids, "<u4").tolist())

    def special_name(self, i: int) -> str:
        return next(s for s, k in self.v.specials.items() if k == i)

    def plain_pieces(self, text: str) -> list[str]:
        if self.unusual.search(text):
            text = self.normalize(text)
            if self.newer.search(text):
                return [text[a:b] for _, (a, b) in self.cut(text)]
            return self.split.findall(text)
        return self.split.findall(unicodedata.normalize("NFC", text).lower())

    def pieces(self, text: str) -> list[str]:
        if "<|" not in text:
            return self.plain_pieces(text)
        out: list[str] = []
        for part in self.v.split_specials.split(text):
            if part in self.v.specials:
                out.append(part)
            else:
                out += self.plain_pieces(part)
        return out

    def encode(self, text: str) -> tuple[bytes, str]:
        """(ids as little-endian 32-bit integers, decoded text)."""
        pieces = self.pieces(text)
        return b"".join(map(self.ids.__getitem__, pieces)), " ".join(map(self.names.__getitem__, pieces))


@lru_cache(maxsize=4)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _short(docs: DataFrame, path: str) -> DataFrame:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for lo in range(0, len(batch), 250):
                part = batch.slice(lo, 250)
                found = [known.encode(t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i, _ in found], pa.int64()), pa.array([i for i, _ in found], pa.binary()), pa.array([t for _, t in found], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return docs.mapInArrow(run, "id long, n_tokens long, ids binary, decoded string")


def _parts(docs: DataFrame, path: str, size: int) -> DataFrame:
    """(row, id, part, pieces, open_left, open_right): parts of at most size characters; an open end is inside a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                parts, held, n = [], [], 0
                for piece in known.pieces(text or ""):
                    if n and n + len(piece) > size:
                        parts.append((held, False, False))
                        held, n = [], 0
                    if len(piece) > size:
                        cuts = [piece[k:k + size] for k in range(0, len(piece), size)]
                        parts += [([c], k > 0, k < len(cuts) - 1) for k, c in enumerate(cuts)]
                    else:
                        held.append(piece)
                        n += len(piece)
                parts.append((held, False, False))
                for k, (pieces, left, right) in enumerate(parts):
                    yield pa.RecordBatch.from_pylist([{"row": row, "id": doc_id, "part": k, "pieces": pieces, "open_left": left, "open_right": right}], pa.schema(
                        [("row", pa.int64()), ("id", pa.int64()), ("part", pa.int64()), ("pieces", pa.list_(pa.string())), ("open_left", pa.bool_()), ("open_right", pa.bool_())]))

    return docs.mapInArrow(run, "row long, id long, part long, pieces array<string>, open_left boolean, open_right boolean")


def _encoded_parts(parts: DataFrame, path: str) -> DataFrame:
    """(row, id, part, ids, head, tail): head and tail count the tokens of an open piece at either end, else 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            for x in batch.to_pylist():
                if x["open_left"] or x["open_right"]:
                    units = known.v.units(x["pieces"][0])
                    if x["open_right"]:
                        units[-1] = known.v.unit[x["pieces"][0].encode("utf-8")[-1]]
                    ids = np.array(known.v.encode_tree(units), "<u4").tobytes()
                else:
                    ids = b"".join(known.ids[p] for p in x["pieces"])
                n = len(ids) // 4
                yield pa.RecordBatch.from_pydict({"row": [x["row"]], "id": [x["id"]], "part": [x["part"]], "ids": [ids], "head": [n * x["open_left"]], "tail": [n * x["open_right"]]}, pa.schema(
                    [("row", pa.int64()), ("id", pa.int64()), ("part", pa.int64()), ("ids", pa.binary()), ("head", pa.int64()), ("tail", pa.int64())]))

    return parts.mapInArrow(run, "row long, id long, part long, ids binary, head long, tail long")


def _joined(parts: DataFrame, path: str) -> DataFrame:
    """One level up the tree: parts 2k and 2k + 1 of a row become part k."""

    def run(group: pa.Table) -> pa.Table:
        known = encoder(path)
        rows = sorted(group.to_pylist(), key=lambda x: x["part"])
        out = rows[0] | {"part": rows[0]["part"] // 2}
        if len(rows) == 2:
            a, b = (np.frombuffer(x["ids"], "<u4").tolist() for x in rows)
            head, tail = rows[0]["head"], rows[1]["tail"]
            if rows[1]["head"]:
                t, h = rows[0]["tail"], rows[1]["head"]
                middle = known.v.join(a[len(a) - t:], b[:h])
                head = len(middle) if head and t == len(a) else head
                tail = len(middle) if tail and h == len(b) else tail
                ids = a[:len(a) - t] + middle + b[h:]
            else:
                ids = a + b
            out |= {"ids": np.array(ids, "<u4").tobytes(), "head": head, "tail": tail}
        return pa.Table.from_pylist([out], group.schema)

    return parts.groupBy("row", F.floor(F.col("part") / 2)).applyInArrow(run, parts.schema)


def _long(docs: DataFrame, path: str, part: int) -> DataFrame:
    parts = _parts(docs, path, part).repartition("row", "part")
    parts = stage(_encoded_parts(parts, path), "parts")
    most = parts.agg(F.max("part")).first()[0] or 0
    for _ in range(most.bit_length()):
        parts = stage(_joined(parts, path), "parts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = encoder(path)
        for batch in batches:
            ids = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), batch.column(1), pa.array([known.decode(i) for i in ids], pa.string())], ["id", "n_tokens", "ids", "decoded"])

    return parts.select("id", "ids").mapInArrow(run, "id long, n_tokens long, ids binary, decoded string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, part: int = PART) -> DataFrame:
    """(id, n_tokens, ids, decoded) of every row; ids as little-endian unsigned 32-bit integers."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    is_long = F.length("text") > long
    out = _short(slim.where(~F.coalesce(is_long, F.lit(False))), path)
    longer = slim.where(is_long)
    if not longer.isEmpty():
        longer = stage(longer.withColumn("row", F.monotonically_increasing_id()).select("row", "id", "text"), "long")
        out = out.union(_long(longer, path, part))
    return out.withColumnRenamed("id", id_col)


def op5_tree_bpe(spark, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
