"""Ordered rows, mini-batches, running baselines and the trainable fusion weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.durable import durable

BLOCK = 256


def with_index(df: DataFrame, *order: Column | str, name: str = "idx") -> DataFrame:
    """`df` with its 0-based place in the order: a range sort over all tasks, and one count for each task on the driver.

    Rows that are alike in `order` take any places among them, which stay the same. A column `name` that `df` has already is replaced.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at, part = f"_{name}_at", F.shiftright(f"_{name}_at", 33)
    placed = durable(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()))
    seen, shift = 0, []
    for r in sorted(placed.groupBy(part.alias("part")).count().collect()):
        shift += [F.lit(r["part"]), F.lit(seen)]
        seen += r["count"]
    before = F.create_map(*shift)[part] if shift else F.lit(0)
    return placed.withColumn(name, (F.col(at).bitwiseAND((1 << 33) - 1) + before).cast("long")).drop(at)


def zip_rows(left: DataFrame, right: DataFrame, left_order: str, right_order: str) -> DataFrame:
    """(idx, the columns of both): the rows of two tables side by side by their place in order, as far as the shorter one goes.

    No column but idx, which is replaced, may be in both.
    """
    return with_index(left, left_order).join(with_index(right, right_order), "idx")


def batch_stats(scored: DataFrame, batch_size: int, idx: str = "idx", reward: str = "reward") -> DataFrame:
    """(step, reward_mean, reward_min, reward_max, n) of consecutive batches; the last may be short. step counts from 0.

    A batch in which a reward is null has failed: its statistics are null.
    """
    step = F.floor(F.col(idx) / batch_size).cast("long").alias("step")
    whole = lambda f: F.when(F.count(reward) == F.count("*"), f(reward))
    return scored.groupBy(step).agg(whole(F.avg).alias("reward_mean"), whole(F.min).alias("reward_min"), whole(F.max).alias("reward_max"), F.count("*").alias("n"))


def _running(maps: DataFrame, start: float) -> DataFrame:
    """(at, before, after) of rows (at, factor, more), at from 0: the value that starts as `start` and becomes factor * value + more at each row in order.

    Such maps make one such map together. Blocks of BLOCK places are folded to theirs, the blocks' own maps run through in the same
    way, block of blocks by block, and each block then filled in from its start.
    """
    block = F.floor(F.col("at") / BLOCK).cast("long")
    blocks = maps.groupBy(block.alias("block")).agg(F.sort_array(F.collect_list(F.struct("at", "factor", "more"))).alias("rows"))
    zero = F.struct(F.lit(1.0).alias("factor"), F.lit(0.0).alias("more"))
    fold = F.aggregate("rows", zero, lambda m, r: F.struct((m["factor"] * r["factor"]).alias("factor"), (r["factor"] * m["more"] + r["more"]).alias("more")))
    last = maps.agg(F.max("at")).first()[0] or 0
    if last < BLOCK:
        begun = blocks.withColumn("value", F.lit(float(start)))
    else:
        ends = blocks.select(F.col("block").alias("at"), fold.alias("m")).select("at", "m.factor", "m.more")
        begun = blocks.join(_running(ends, start).select(F.col("at").alias("block"), F.col("before").alias("value")), "block")

    def step(held, r):
        after = r["factor"] * held["value"] + r["more"]
        row = F.struct(r["at"].alias("at"), held["value"].alias("before"), after.alias("after"))
        return F.struct(after.alias("value"), F.concat(held["out"], F.array(row)).alias("out"))

    empty = F.struct(F.col("value"), F.array().cast("array<struct<at:bigint,before:double,after:double>>").alias("out"))
    return begun.select(F.explode(F.aggregate("rows", empty, step, lambda held: held["out"])).alias("r")).select("r.at", "r.before", "r.after")


def ema(stats: DataFrame, decay: float = 0.9, start: float = 0.0, step: str = "step", mean: str = "reward_mean") -> DataFrame:
    """`stats` with baseline = decay * previous + (1 - decay) * mean, in step order.

    A step with a null mean, a failed batch, leaves the baseline as it is. Steps are distinct; a column baseline that `stats` has already is replaced.
    """
    kept = stats.drop("baseline")
    first = kept.agg(F.min(step)).first()[0] or 0
    at = (F.col(step) - first).cast("long")
    failed = F.col(mean).isNull()
    maps = kept.select(at.alias("at"), F.when(failed, 1.0).otherwise(decay).alias("factor"), F.when(failed, 0.0).otherwise((1 - decay) * F.col(mean)).alias("more"))
    values = _running(maps, start).select(F.col("at").alias("_at"), F.col("after").alias("baseline"))
    return kept.join(values, at == F.col("_at")).drop("_at")


def epochs(rows: DataFrame, count: int, batch_size: int, total: int, idx: str = "idx") -> DataFrame:
    """Each row once in each epoch, with its step over all epochs, the batch number shown for it, and the steps counted for an epoch."""
    per_epoch = math.ceil(total / batch_size)
    made = rows.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))) if count else rows.withColumn("epoch", F.lit(0)).where("false")
    batch = F.floor(F.col(idx) / batch_size)
    return made.withColumn("step", (F.col("epoch") * per_epoch + batch).cast("long")).withColumn("batch_idx", (batch + 1).cast("long")).withColumn(
        "steps_per_epoch", F.lit(max(1, total // batch_size)).cast("long")
    )


def advantages(scored: DataFrame, stats: DataFrame, batch_size: int, idx: str = "idx") -> DataFrame:
    """`scored` with the reward less the updated baseline of its step."""
    step = F.floor(F.col(idx) / batch_size).cast("long")
    return scored.withColumn("step", step).join(stats.select("step", "baseline"), "step").withColumn("advantage", F.col("reward") - F.col("baseline"))


@dataclass
class FusionWeights:
    """Two positive weights, kept as logarithms and used normalised."""

    initial_e: float = 0.5
    initial_t: float = 0.5

    def __post_init__(self):
        self.log_e, self.log_t = math.log(self.initial_e), math.log(self.initial_t)

    def weights(self) -> tuple[float, float]:
        e, t = math.exp(self.log_e), math.exp(self.log_t)
        return e / (e + t), t / (e + t)

    def forward(self, r_e: Column, r_t: Column) -> Column:
        e, t = self.weights()
        return F.lit(e) * r_e + F.lit(t) * r_t

    def fit(self, scores: DataFrame, steps: int, rate: float) -> FusionWeights:
        """Gradient steps on minus the mean fused score: one aggregate serves all of them."""
        mean_e, mean_t = scores.agg(F.avg("r_e"), F.avg("r_t")).first()
        for _ in range(steps if mean_e is not None else 0):
            e, t = self.weights()
            slope = -e * t * (mean_e - mean_t)
            self.log_e -= rate * slope
            self.log_t += rate * slope
        return self
