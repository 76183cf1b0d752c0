"""Balanced label propagation: linked documents move towards their neighbours' shards under quotas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import Scratch, ranked

_UNIT = 1 << 20


def _quotas(flows: dict[tuple[int, int], int], counts: list[int], most: float) -> dict[tuple[int, int], float]:
    """The share of each (from, to) flow that may move: equal swaps always, the rest as far as the target has room."""
    out = {}
    for to in range(len(counts)):
        rest = {k: n - min(n, flows.get((to, k[0]), 0)) for k, n in flows.items() if k[1] == to}
        room = min(1.0, max(0.0, most - counts[to]) / max(1, sum(rest.values())))
        for k, more in rest.items():
            out[k] = (flows[k] - more + room * more) / flows[k]
    return out


def propagate(scratch: Scratch, edges: DataFrame, shards: int, most: float, rounds: int = 6) -> DataFrame:
    """(node, label) of every node in the symmetric `edges` (node, other), with about `most` nodes in a shard at most.

    In each round nodes count their neighbours' shards (a join and an aggregate that combines before its
    shuffle) and ask for the most frequent one; nodes before all their neighbours and the others take turns, and later
    on one half of them at a time, so that neighbours don't swap for ever. The driver sees one count for each pair of shards, and
    turns them into the share of each flow that moves; a node's hash decides whether it is in that share.
    """
    start = F.pmod(F.xxhash64(F.col("node"), F.lit("start")), F.lit(shards)).cast("int")
    inner = edges.groupBy("node").agg((F.min("other") > F.col("node")).alias("inner"))
    labels = scratch.table(inner.select("node", "inner", start.alias("label")))
    for step in range(rounds):
        counts = [0] * shards
        for r in labels.groupBy("label").count().collect():
            counts[r.label] = r["count"]
        votes = edges.join(labels.select(F.col("node").alias("other"), F.col("label").alias("vote")), "other").groupBy("node", "vote").agg(F.count("*").alias("n"))
        own = labels.join(votes, "node").groupBy("node", "inner", "label").agg(
            F.max(F.struct("n", (F.col("vote") == F.col("label")).alias("stays"), (-F.col("vote")).alias("low"))).alias("best")
        )
        turn = F.col("inner") if step % 2 else ~F.col("inner")
        if step > 1:
            turn &= F.pmod(F.xxhash64(F.col("node"), F.lit(step)), F.lit(2)) == 0
        asked = scratch.table(own.select("node", "inner", "label", F.when(turn, -F.col("best.low")).otherwise(F.col("label")).alias("to")))
        flows = {(r.label, r.to): r["count"] for r in asked.where("label <> to").groupBy("label", "to").count().collect()}
        if not flows and step > 3:
            break  # no node of either half, of either kind, asked for another shard
        if flows:
            quota = _quotas(flows, counts, most)
            shares = F.create_map(*[F.lit(x) for (a, b), q in sorted(quota.items()) for x in (a * shards + b, int(q * _UNIT))])
            chance = F.pmod(F.xxhash64(F.col("node"), F.lit(-1 - step)), F.lit(_UNIT))
            moves = (F.col("label") != F.col("to")) & (chance < shares[F.col("label") * shards + F.col("to")])
            labels = scratch.table(asked.select("node", "inner", F.when(moves, F.col("to")).otherwise(F.col("label")).alias("label")))
    return labels.select("node", "label")


def shard_documents(documents: DataFrame, shards: int = 8, rounds: int = 6) -> DataFrame:
    """A row for each document with its shard and its slot there, by the law `rows`: counts at most one apart.

    Documents of equal text are linked (null counts as empty) through the first of them. A group larger than a shard is
    linked in parts of about that size, since it can't stay whole. After the propagation, a group goes where most of its documents are.
    Shards with too many documents then give away the surplus to those with too few, which makes the counts exact: documents without a
    link first, then whole groups, the smaller ones first. Only where a surplus or a gap ends inside a group is that one cut, so twice as many
    groups as shards at most. Each
    row is placed once, repeated ids and rows too; a null doc_id stays null; other columns are ignored; no documents give no rows.
    size is the text's UTF-8 bytes (none for null) plus 1, slots count from 0 in each shard, grown_shard is null under this law.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    nodes = scratch.table(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text.cast("binary")).alias("same"), F.monotonically_increasing_id().alias("node"),
        )
    )
    n = nodes.count()
    part = max(2, n // shards)
    # written, so that the joins with a very large group's rows have two plain sides, which adaptive execution splits
    groups = scratch.table(nodes.groupBy("same").agg(F.count("*").alias("members"), F.min("node").alias("whole_hub")).where("members > 1"))
    linked = scratch.table(
        nodes.select("node", "same").join(groups, "same")
        .withColumn("part", F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / part)))
        .select("node", "same", "part", "whole_hub")
    )
    hubs = scratch.table(linked.groupBy("same", "part").agg(F.min("node").alias("hub"), F.min("whole_hub").alias("whole_hub")))
    spokes = scratch.table(linked.join(hubs.select("same", "part", "hub"), ["same", "part"]).select("node", F.col("hub").alias("other")))
    pairs = spokes.unionByName(hubs.select(F.col("hub").alias("node"), F.col("whole_hub").alias("other"))).where("node <> other")
    edges = scratch.table(pairs.unionByName(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = propagate(scratch, edges, shards, n / shards, rounds)
    tied = spokes.withColumnRenamed("other", "hub")
    votes = scratch.table(tied.join(labels, "node").groupBy("hub", "label").agg(F.count("*").alias("n")))
    # a group whose hub stands alone, as a part of one document, has no label yet
    homes = scratch.table(votes.groupBy("hub").agg(F.sum("n").alias("members"), F.max_by("label", F.struct("n", -F.col("label"))).alias("label")))
    grouped = scratch.table(tied.join(homes, "hub"))
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    placed = nodes.join(grouped.select("node", "hub", "members", "label"), "node", "left").select(
        "doc_id", "size", "text_crc32", "node", F.coalesce("members", F.lit(1)).alias("members"), F.coalesce("hub", "node").alias("hub"), F.coalesce("label", start).alias("label")
    )
    numbered, sizes = ranked(scratch, placed, "label", ["members", "hub", "node"])
    want = [n // shards + (s < n % shards) for s in range(shards)]
    over = [max(0, sizes.get(s, 0) - want[s]) for s in range(shards)]
    lack = [max(0, want[s] - sizes.get(s, 0)) for s in range(shards)]
    before = lambda xs, s: sum(xs[:s])
    table = spark.createDataFrame([(s, over[s], before(over, s)) for s in range(shards)], "label int, over long, pooled long")
    at = F.col("pooled") + F.col("rank")
    shard, slot = F.col("label"), F.col("rank") - F.col("over")
    for s in range(shards):
        here = (F.col("rank") < F.col("over")) & (at >= before(lack, s)) & (at < before(lack, s) + lack[s])
        shard = F.when(here, F.lit(s)).otherwise(shard)
        slot = F.when(here, at - before(lack, s) + sizes.get(s, 0)).otherwise(slot)
    out = numbered.join(F.broadcast(table), "label").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
    return scratch.finish(out)
