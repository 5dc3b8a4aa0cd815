"""What the operators of this package share: staged tables, row filters, components, bytes as numpy arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a single longer text is a step of its own.
STEP_BYTES = 2 << 20
#: The same where each byte or code point takes part in many arrays of 64-bit words: what a worker has once taken it keeps.
SMALL_STEP = 512 << 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Unset, one process (as in tests) gets a folder of its own; a cluster gets an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sparkloom-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def clear_staged(spark: SparkSession) -> None:
    """Remove all staged tables; call it when no result that was made of them is read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/staged")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts lineage, and a lost executor loses none of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/staged/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# ---------------------------------------------------------------- bounded membership filter

BITS = 1 << 26  # 8 MB whatever the input; more keys only let more rows through
BITMAP_BITS = 32_768  # fixed by bitmap_construct_agg


def bitmap(keys: DataFrame, key: str, bits: int = BITS) -> DataFrame:
    """(bucket, bitmap) of the long column key: at most bits / 32768 rows of 4 KB."""
    at = F.pmod(F.col(key), F.lit(bits))
    return (
        keys.where(F.col(key).isNotNull())
        .select(F.floor(at / BITMAP_BITS).cast("int").alias("bucket"), (at % BITMAP_BITS).alias("at"))
        .groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bitmap"))
    )


def bitmap_array(keys: DataFrame, key: str, bits: int = BITS) -> np.ndarray:
    """The same filter as one packed array on the driver: bits / 8 bytes."""
    out = np.zeros(bits // 8, np.uint8)
    for row in bitmap(keys, key, bits).toLocalIterator():
        at = row["bucket"] * BITMAP_BITS // 8
        out[at:at + len(row["bitmap"])] |= np.frombuffer(bytes(row["bitmap"]), np.uint8)
    return out


def maybe_in(packed: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """True where the signed 64-bit key may be among those the filter was made of."""
    at = np.mod(keys.astype(np.int64), np.int64(len(packed) * 8))
    return (packed[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def split_by_filter(df: DataFrame, key: F.Column, keys: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """df in two parts: rows whose key is surely not in keys.name, and the few that may be (for an exact join).

    Only the bounded bitmap is broadcast, so the texts of the first part are never shuffled.
    """
    marks = F.broadcast(bitmap(keys, name).withColumnsRenamed({"bucket": "__b", "bitmap": "__m"}))
    at = F.pmod(key, F.lit(BITS))
    byte = "cast(conv(hex(substring(__m, cast(__at div 8 as int) + 1, 1)), 16, 10) as int)"
    marked = (
        df.withColumn("__b", F.floor(at / BITMAP_BITS).cast("int")).withColumn("__at", at % BITMAP_BITS)
        .join(marks, "__b", "left")
        .withColumn("__hit", F.coalesce(F.expr(f"shiftright({byte}, cast(__at % 8 as int)) % 2 = 1"), F.lit(False)))
        .drop("__b", "__at", "__m")
    )
    return marked.where(~F.col("__hit")).drop("__hit"), marked.where("__hit").drop("__hit")


# ---------------------------------------------------------------- connected components

def components(edges: DataFrame) -> DataFrame:
    """(node, component) of undirected edges (a, b); component is the smallest node reachable.

    Alternates two contraction steps, each a grouped minimum (summed up before the shuffle) and a join that Spark can
    split where one node has most edges. Each step is staged: a plan of both reads its input many times over, and the driver
    keeps every version of the plans of all queries. The loop ends when each node but the smallest of its component has one edge, to that.
    """
    now = stage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    while not _stars(now):
        low = _both_ends(now).groupBy("node").agg(F.min(F.least("node", "other")).alias("m"))
        large = stage(now.join(low, now["v"] == low["node"]).select("u", F.col("m").alias("v")).distinct(), "edges")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = stage(small.select("e.*").where("u <> v").distinct(), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _both_ends(edges: DataFrame) -> DataFrame:
    """(node, other, upper) of both ends of the edges (u, v); upper: the node is u. Read once."""
    ends = F.array(*(F.struct(F.col(x).alias("node"), F.col(y).alias("other"), F.lit(x == "u").alias("upper")) for x, y in ("uv", "vu")))
    return edges.select(F.explode(ends).alias("e")).select("e.*")


def _stars(edges: DataFrame) -> bool:
    """Whether no node is the upper end u of two of the distinct edges (u, v), u > v, or of one and the lower end of another."""
    per = _both_ends(edges).groupBy("node").agg(F.count_if("upper").alias("above"), F.count_if(~F.col("upper")).alias("below"))
    return per.where("above > 1 or above = 1 and below > 0").isEmpty()


# ---------------------------------------------------------------- texts as numpy arrays

U = np.uint64
STEP = U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_ODD = [U(x) for x in (0x8CB92BA72F3D8DD7, 0xA24BAED4963EE407, 0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: A second hash in a prime field: products of its residues fit in 64 bits. Modulo 2**64 alone some repetitive texts of any base are equal.
PRIME, BASE = (1 << 31) - 1, 1_170_746_341
_powers: list[np.ndarray] = [np.ones(1, U)] * 4


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(n: int) -> list[np.ndarray]:
    """STEP ** i and its inverse modulo 2**64, BASE ** i and its inverse modulo PRIME, for i below n at least; kept between calls."""
    if len(_powers[0]) < n:
        n = 1 << (n - 1).bit_length()
        for k, base in enumerate((STEP, U(pow(int(STEP), -1, 1 << 64)))):
            x = np.full(n, base, U)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
        for k, base in ((2, BASE), (3, pow(BASE, -1, PRIME))):
            x = np.ones(n, U)
            have = 1
            while have < n:
                x[have:2 * have] = x[:have] * U(pow(base, have, PRIME)) % U(PRIME)
                have *= 2
            _powers[k] = x
    return _powers


def prefix_hash(units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums from which span_hash takes the hash of any span: modulo 2**64, and of residues modulo PRIME (below 2**64 for 2**31 units)."""
    wide, field = np.zeros(len(units) + 1, U), np.zeros(len(units) + 1, U)
    power = powers(len(units) + 1)
    units = units.astype(U) + U(1)
    np.cumsum(units * power[0][:len(units)], out=wide[1:])
    units *= power[2][:len(units)]
    np.cumsum((units & U(PRIME)) + (units >> U(31)), out=field[1:])  # 2**31 is 1 modulo PRIME
    return wide, field


def span_hash(h: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span, from prefix_hash; equal spans have equal hashes wherever they stand."""
    wide, field = h
    power = powers(len(wide))
    residue = (field[end] - field[start]) % U(PRIME) * power[3][start] % U(PRIME)
    return mix(((wide[end] - wide[start]) * power[1][start]) ^ mix((end - start).astype(U) << U(31) | residue))


def text_steps(batch: pa.RecordBatch, text: str = "text", most: int = STEP_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, UTF-8 bytes, offsets) for runs of rows of at most `most` bytes, null texts as empty ones."""
    col = batch.column(batch.schema.get_field_index(text))
    wide = np.int64 if pa.types.is_large_string(col.type) else np.int32
    if len(batch) == 0:
        return
    col = col.fill_null("")
    offs = np.frombuffer(col.buffers()[1], wide)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    body = col.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(col):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield batch.slice(lo, hi - lo), data[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo]
        lo = hi


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, for mapInArrow; between batches and when a task is through, what Arrow keeps of those done goes back to the system: workers hold their memory beside the executor's heap, also while they wait."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pa.default_memory_pool().release_unused()
            yield batch

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(each(batches))
        pa.default_memory_pool().release_unused()

    return through


def words(data: np.ndarray, offs: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first) of the maximal runs of bytes other than x20, x09-x0D, cut at the offsets cuts as well; first[i]: index of text i's first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACE[data]
    edge = np.zeros(len(data), bool)
    edge[offs[:-1][offs[:-1] < len(data)]] = True
    if cuts is not None:
        edge[cuts[cuts < len(data)]] = True
    before = np.concatenate(([False], word[:-1]))
    start = np.flatnonzero(word & (~before | edge))
    last = np.concatenate((edge[1:], [True]))
    after = np.concatenate((word[1:], [False]))
    end = np.flatnonzero(word & (~after | last)) + 1
    return start, end, np.searchsorted(start, offs)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of hashes[i:i + size] for every i that has them all."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(size):
        out += hashes[j:j + n] * _ODD[j % 5] ^ U(j)
    return mix(out)
