"""JSON Lines, statistics and metrics as files."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .records import json_array


def as_json(df: DataFrame) -> DataFrame:
    """`value`: each row as one JSON object, nulls kept, characters beyond ASCII as they are."""
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    as_json(df).write.mode("overwrite").text(path)


def json_to_jsonl(spark: SparkSession, path: str) -> str:
    """The objects of the array in x.json, one on each line, in x.jsonl; other items are left out. Returns the new path."""
    out = path.rsplit(".json", 1)[0] + ".jsonl"
    kept = json_array(spark, path).where(F.col("record").startswith("{"))
    kept.orderBy("idx").select(F.col("record").alias("value")).write.mode("overwrite").text(out)
    return out


def write_epoch(stats: DataFrame, path: str, epoch: int) -> None:
    stats.write.mode("overwrite").parquet(f"{path}/epoch_{epoch}")


def write_metrics(spark: SparkSession, metrics: dict, path: str) -> None:
    spark.createDataFrame([tuple(metrics.values())], list(metrics)).write.mode("overwrite").json(path)


def log_to(path: str, name: str = "scorewright") -> logging.Logger:
    """The driver's logger `name`, which writes to a file and to stderr; asked for again, it writes each line once all the same."""
    log = logging.getLogger(name)
    log.setLevel(logging.INFO)
    for old in list(log.handlers):
        log.removeHandler(old)
        old.close()
    for handler in (logging.FileHandler(path, encoding="utf-8"), logging.StreamHandler()):
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s %(message)s"))
        log.addHandler(handler)
    return log
