"""Changes of a file tree as a stream: a clock ticks, each tick's snapshot is compared with the last one's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.windows import snapshot_changes

SNAPSHOT = StructType([StructField("path", StringType()), StructField("mark", StringType())])


def snapshot(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, mark) of the files below root by time and length; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return rows.select("path", F.concat_ws(":", F.unix_millis("modificationTime").cast("string"), F.col("length").cast("string")).alias("mark"))


def polled_changes(spark: SparkSession, root: str, folder: str, every: str = "1500 milliseconds", pattern: str = "*", once: bool = False) -> StreamingQuery:
    """A running query that writes (path, change, tick) of every tick as Parquet below folder/changes.

    folder must be shared by all executors; snapshots stay in folder/snapshots by tick, so a restarted query goes on from the last
    finished tick and a tick that is run again overwrites itself. The first tick reports every file as added. once: the ticks
    that are due now, then an end.
    """

    def tick(clock: DataFrame, batch: int) -> None:
        session = clock.sparkSession
        now_at = f"{folder}/snapshots/{batch}"
        snapshot(session, root, pattern).write.mode("overwrite").parquet(now_at)
        now = session.read.schema(SNAPSHOT).parquet(now_at)
        before = session.read.schema(SNAPSHOT).parquet(f"{folder}/snapshots/{batch - 1}") if batch else now.limit(0)
        changes = snapshot_changes(before, now, "path", "mark").withColumn("tick", F.lit(batch).cast("long"))
        changes.write.mode("overwrite").parquet(f"{folder}/changes/batch={batch}")

    clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    writer = clock.writeStream.foreachBatch(tick).option("checkpointLocation", f"{folder}/checkpoint")
    return (writer.trigger(once=True) if once else writer.trigger(processingTime=every)).start()


def changes_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, change, tick) of all finished ticks."""
    kind = StructType([StructField("path", StringType()), StructField("change", StringType()), StructField("tick", LongType())])
    return spark.read.schema(kind).parquet(f"{folder}/changes/batch=*")
