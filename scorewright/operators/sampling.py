"""Deterministic samples and splits by the order of a hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .steps import with_index


def shuffled(key: Column, seed: int) -> Column:
    """A key that orders rows at random, the same in any engine that has MD5."""
    return F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed))).cast("binary"))


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """The first n rows of the shuffled order; all rows if n isn't positive."""
    return df.orderBy(shuffled(F.col(key), seed), key).limit(n) if n > 0 else df


def split(df: DataFrame, key: str, share: float = 0.1, seed: int = 42) -> DataFrame:
    """`df` with `is_test`: the first ceil(share * rows) rows of the shuffled order. Of rows that repeat a key any ones come first."""
    placed = with_index(df.withColumn("_key", shuffled(F.col(key), seed)), "_key", key, name="_place")
    rows = placed.agg(F.max("_place")).first()[0]
    return placed.withColumn("is_test", F.col("_place") < math.ceil(share * (0 if rows is None else rows + 1))).drop("_key", "_place")


def keep_first(df: DataFrame, key: str, order: str) -> DataFrame:
    """The first row in order of each key, with all its columns; a null key is a key."""
    return df.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(order, *(c for c in df.columns if c != order))).alias("row")).select("row.*")


def sorted_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the distinct values of each key as a sorted array; nulls aren't among them."""
    return df.groupBy(key).agg(F.sort_array(F.collect_set(value)).alias(value))


def first_accepted(df: DataFrame, accepted: Column, order: str, n: int | None) -> DataFrame:
    """The first n accepted rows in order; none for 0, all for None."""
    kept = df.where(accepted)
    return kept if n is None else kept.orderBy(order).limit(n)
