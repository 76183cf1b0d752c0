"""Rows that are kept where a lost executor doesn't take them along."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame


def durable(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, its partitions and the order in them as they are.

    The folder is `spark.checkpoint.dir`, or the one the context has. Where neither is set, a local session gets a temporary one; on a
    cluster that is an error, for each executor would write to its own disk.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(root or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint()
