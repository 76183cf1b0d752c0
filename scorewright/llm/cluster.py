"""Shared scratch tables, distributed ranks and connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes that go to Python at once: texts are long, and two workers share an executor's memory with its heap.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


#: The shuffle files of a table that is written are of no more use.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
#: Spark takes a table for small by its columns' share of a file, before rows are exploded or unpacked; broadcast, it would have to fit the driver.
_MERGING = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """The session's settings with these values, and as they were before on the way out."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def lean(spark: SparkSession) -> None:
    """Keeps the batches of texts that this session hands to Python small; for good, since the result may run at any later time."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class Scratch:
    """Tables written to the folder all executors share; they survive lost executors and cut lineage.

    The folder is `spark.checkpoint.dir` (or the context's checkpoint folder); only where neither is set and the master is local, as in
    tests, a temporary folder is made and set; on a cluster that is an error, for executors would each write to their own disk.
    `finish(df)` writes the result and removes the other tables; so does `table(df)` where it fails, with all tables. With `merging`, no
    table is broadcast but by a hint.
    """

    def __init__(self, spark: SparkSession, merging: bool = False):
        self.spark, self.made, self.writing = spark, [], _WRITING | (_MERGING if merging else {})
        lean(spark)
        context = spark.sparkContext
        root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
        if not root:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoint-"))
            root = context.getCheckpointDir()
        self.root = f"{root.rstrip('/')}/scorewright-{uuid.uuid4().hex}"

    def table(self, df: DataFrame) -> DataFrame:
        path = f"{self.root}/{len(self.made)}"
        self.made.append(path)
        try:
            with settings(self.spark, self.writing):
                df.write.parquet(path)
        except Exception:
            self.drop()
            raise
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, keep: int | None = None) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for i, path in enumerate(self.made):
            if i != keep:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)

    def finish(self, df: DataFrame) -> DataFrame:
        out = self.table(df)
        self.drop(keep=len(self.made) - 1)
        return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(scratch: Scratch, df: DataFrame, group: str, order: list[str], rank: str = "rank") -> tuple[DataFrame, dict]:
    """`df` with each row's position in its group (from 0, gapless) and {group: size}.

    A range sort spreads any one group over many tasks. Only one count for each group and task,
    at most groups + tasks of them, comes to the driver; groups must be few (shards, lengths).
    """
    spark = scratch.spark
    sort = [group, *order]
    sorted_ = scratch.table(
        df.repartitionByRange(partitions(spark), *sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id())
    )
    part = F.shiftright("_at", 33)
    spans = sorted_.groupBy(part.alias("_part"), F.col(group).alias("_group")).agg(F.min("_at").alias("_from"), F.count("*").alias("_n")).collect()
    sizes: dict = {}
    shift = []
    for row in sorted(spans, key=lambda r: r._from):
        shift.append((row._part, row._group, sizes.get(row._group, 0) - row._from))
        sizes[row._group] = sizes.get(row._group, 0) + row._n
    kind = df.schema[group].dataType.simpleString()
    table = spark.createDataFrame(shift, f"_part bigint, _group {kind}, _shift bigint")
    joined = sorted_.withColumn("_part", part).withColumn("_group", F.col(group)).join(F.broadcast(table), ["_part", "_group"])
    return joined.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(rank)), sizes


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(id, component_id): the smallest id that each id in `edges` (a, b) reaches.

    Alternating large and small stars. Every step is an aggregate that combines before its shuffle, and a join of written tables: both
    sides are plain shuffles, so adaptive execution splits the rows of a hub over several tasks.
    """
    both = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, before = scratch.table(both), None
    while True:
        two = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = scratch.table(two.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = scratch.table(two.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())
        least = scratch.table(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.col("b").alias("x"), F.col("m"), "a")
        small = small.select(F.col("x").alias("a"), F.col("m").alias("b")).unionByName(small.select("a", F.col("m").alias("b")))
        now = scratch.table(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.groupBy("a").agg(F.min("b").alias("component_id")).withColumnRenamed("a", "id").unionByName(
        now.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component_id"))
    ).groupBy("id").agg(F.min("component_id").alias("component_id"))
