"""Exact token counts at every prefix of a text.

For each piece the tokenizer never merges across, a table of prefixes is filled from the left: the last token of a
prefix's encoding is the one token ending there that fits the last token of the prefix before it, so a prefix's count is
that one's count plus one. Texts are runs of such pieces, so a whole text's table is its pieces' tables one after
another; tables of pieces met before are kept (a bounded number) in each Python worker. Counts at any cut, the cut for
a token budget and the whole count are all looked up, nothing is encoded again.

Null and empty texts have no tokens. Special strings inside a text count as their one token. Ids may be null or repeat:
rows are mapped one by one. Very long texts are taken whole; the table is linear in their length.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import PrefixCounter, Vocabulary
from .shared import table

LIMIT = 512


@lru_cache(maxsize=4)
def counter(path: str) -> PrefixCounter:
    cut = Tokenizer.from_file(path).pre_tokenizer
    return PrefixCounter(Vocabulary(path), lambda text: [text[a:b] for _, (a, b) in cut.pre_tokenize_str(text)])


def _mapped(docs: DataFrame, id_col: str, text_col: str, path: str, schema: str, of_text) -> DataFrame:
    """id and of_text(counter, text)'s columns for every row."""
    names = [x.split()[0] for x in schema.split(", ")][1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = counter(path)
        for batch in batches:
            for lo in range(0, len(batch), 500):
                part = batch.slice(lo, 500)
                found = [of_text(known, t or "") for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_pydict({id_col: part.column(0), **{c: [x[k] for x in found] for k, c in enumerate(names)}})

    return docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col)).mapInArrow(run, schema)


def prefix_table(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, prefix_tokens): prefix_tokens[k] is the token count of the text's first k + 1 characters."""
    return _mapped(docs, id_col, text_col, path, f"{id_col} long, prefix_tokens array<long>", lambda c, t: (c.prefixes(t),))


def token_budget(docs: DataFrame, path: str, budget: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, chars_within): the whole count, and the characters of the longest prefix of at most budget tokens."""
    def look(c: PrefixCounter, t: str) -> tuple[int, int]:
        units = c.units(t)
        n = c.count(units)
        return n, len(t) if n <= budget else c.within(units, budget)

    return _mapped(docs, id_col, text_col, path, f"{id_col} long, n_tokens long, chars_within long", look)


def op2_token_counts(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    sized = _mapped(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.json"), "doc_id long, n_bytes long, n_tokens long, chars_within_limit long",
                    lambda c, t: (len(t.encode("utf-8")), n := c.count(units := c.units(t)), len(t) if n <= LIMIT else c.within(units, LIMIT)))
    return sized.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), "chars_within_limit")
