"""Exact top-k inner products: tiled matrix products, selection in each tile, tree merging."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE = 4096
TALL = 4  # a block of queries has so many times the rows of a block of vectors, so fewer copies of the vectors are dealt
FAN_IN = 16
_LONG = (-(1 << 63), (1 << 63) - 1)
_BLOCK = "side int, block long, width int, wide int, ids binary, times binary, keys binary, body binary"


def _narrow(body: np.ndarray) -> np.ndarray:
    """The same integers in the narrowest type that holds them."""
    top = int(np.abs(body).max(initial=0))
    return body.astype(next(t for t in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(t).max))


def _blocks(batches):
    """Rows (side, block, vec_id, times, key, comps) of one partition, sorted by side and block, to one row for each block."""

    def close(key, ids, times, keys, rows):
        width = max(map(len, rows))
        exact = any(abs(v) >= 1 << 62 for r in rows for v in (r if isinstance(r, list) else ()))
        numbers = [np.array(x, np.int64).tobytes() for x in (ids, times, keys)]
        if exact or any(isinstance(r, list) for r in rows):
            return (*key, -1, 0, *numbers, repr([[int(v) for v in r] for r in rows]).encode())
        body = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            body[i, : len(r)] = r
        body = _narrow(body)
        return (*key, width, body.itemsize, *numbers, body.tobytes())

    def batch(row):
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

    key, held = None, ([], [], [], [])
    for b in batches:
        comps = b.column("comps")
        flat = comps.flatten().to_numpy(zero_copy_only=False)
        sizes = np.diff(comps.offsets.to_numpy())
        ends = np.cumsum(sizes)
        for i, (side, block, *numbers) in enumerate(zip(*(b.column(c).to_pylist() for c in ("side", "block", "vec_id", "times", "key")), strict=True)):
            if key != (side, block) and held[0]:
                yield batch(close(key, *held))
                held = ([], [], [], [])
            key = (side, block)
            part = flat[ends[i] - sizes[i] : ends[i]] * 64.0
            # beyond 2 ** 53 a product by 64 is still exact: it only moves the exponent
            row = np.floor(part).astype(np.int64) if np.abs(part).max(initial=0) < 2.0**62 else [math.floor(x) for x in part.tolist()]
            for xs, x in zip(held, (*numbers, row), strict=True):
                xs.append(x)
    if held[0]:
        yield batch(close(key, *held))


class _Side:
    """The rows of a block: ids, how often each row is there, the keys of their vectors, and these."""

    def __init__(self, row):
        self.ids, self.times, self.keys = (np.frombuffer(row[c], np.int64) for c in ("ids", "times", "keys"))
        if row["width"] < 0:
            import ast

            self.body = ast.literal_eval(row["body"].decode())
        else:
            self.body = np.frombuffer(row["body"], f"i{row['wide']}").reshape(len(self.ids), row["width"]) if row["width"] else np.zeros((len(self.ids), 0), np.int64)

    def cut(self, which):
        out = object.__new__(_Side)
        out.ids, out.times, out.keys = self.ids[which], self.times[which], self.keys[which]
        out.body = [self.body[i] for i in which] if isinstance(self.body, list) else self.body[which]
        return out


def _best(q: _Side, c: _Side, k: int):
    """(place of the query, vec_id, score, times) of each query's k best in one tile, exactly, ties to the smaller vec_id.

    A vector that is there several times is one candidate with its number, less one for the query's own row.
    """
    c = c.cut(np.argsort(c.ids, kind="stable"))
    if isinstance(q.body, list) or isinstance(c.body, list):
        rows_q, rows_c = (x.body if isinstance(x.body, list) else x.body.tolist() for x in (q, c))
        for i, a in enumerate(rows_q):
            scored = []
            for v, n, key, b in zip(c.ids.tolist(), c.times.tolist(), c.keys.tolist(), rows_c, strict=True):
                n -= v == q.ids[i] and key == q.keys[i]
                if n:
                    scored.append((-sum(x * y for x, y in zip(a, b, strict=False)), v, n))
            for s, v, n in sorted(scored)[:k]:
                yield i, v, min(max(-s, _LONG[0]), _LONG[1]), n
        return
    d = min(q.body.shape[1], c.body.shape[1])
    x, y = q.body[:, :d].astype(np.int64), c.body[:, :d].astype(np.int64)
    top = int(np.abs(x).max(initial=0)) * int(np.abs(y).max(initial=0)) * max(d, 1)
    n = len(c.ids)
    bits = n.bit_length()
    if top >= 1 << 50 or top << bits >= 1 << 62:
        for side in (q, c):
            side.body = side.body[:, :d].tolist()
        yield from _best(q, c, k)
        return
    score = (x.astype(np.float64) @ y.astype(np.float64).T).astype(np.int64)
    # one integer holds the score and, for ties, how early the candidate comes
    whole = (score << bits) | (n - 1 - np.arange(n))
    # the query's own row, of which there may be more
    own = (q.ids[:, None] == c.ids[None, :]) & (q.keys[:, None] == c.keys[None, :])
    whole[own & (c.times == 1)[None, :]] = np.iinfo(np.int64).min
    take = min(k, n)
    part = np.argpartition(whole, n - take, axis=1)[:, n - take :] if take < n else np.tile(np.arange(n), (len(q.ids), 1))
    rows = np.repeat(np.arange(len(q.ids)), take)
    cols = part.ravel()
    keep = whole[rows, cols] != np.iinfo(np.int64).min
    rows, cols = rows[keep], cols[keep]
    yield rows, c.ids[cols], score[rows, cols], c.times[cols] - own[rows, cols]


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int, tile: int = TILE, fan_in: int = FAN_IN) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each row of `queries`.

    Both frames hold vec_id and embedding. Components count as floor(64 * x) and the score is their
    integer inner product; the higher scores come first, ties to the smaller vec_id. A row with a
    null id, a null vector, or a null or non-finite component takes no part. Missing components of
    a shorter vector count as 0. Rows that share an id are rows of their own: a query meets them all but itself (or, where `queries` isn't
    made of rows of `vectors`, all that aren't equal to it), and each query row has a list. Scores outside 64 bits are compared exactly and
    then clipped. Other columns are ignored, and empty input gives no rows.

    Equal rows are one row with a number. Rows are cut into blocks of about `tile` vectors and TALL times as many queries, in the narrowest
    type that holds them; each query block meets each vector block in a task of its own (no task holds more than two blocks), and lists of
    k are merged `fan_in` at a time.
    """

    def clean(df):
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("comps"))
        fine = F.forall("comps", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
        return df.where("vec_id is not null and comps is not null").where(fine).groupBy("vec_id", "comps").agg(F.count("*").alias("times"))

    spark = vectors.sparkSession
    sides = []
    counts = []
    for side, (df, rows) in enumerate(((queries, TALL * tile), (vectors, tile))):
        n = max(1, math.ceil(df.count() / rows))
        counts.append(n)
        key = F.xxhash64("comps")
        sides.append(clean(df).select(F.lit(side).alias("side"), F.pmod(F.xxhash64("vec_id", key), F.lit(n)).alias("block"), "vec_id", "times", key.alias("key"), "comps"))
    nq, nv = counts
    packed = (
        sides[0].unionByName(sides[1]).repartition(min(nq + nv, 4096), "side", "block").sortWithinPartitions("side", "block", "vec_id")
        .mapInArrow(_blocks, _BLOCK)
    )
    other = F.when(F.col("side") == 0, F.lit(nv)).otherwise(F.lit(nq))
    met = F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias("met")
    dealt = packed.select("*", met).select(
        F.when(F.col("side") == 0, F.col("block")).otherwise(F.col("met")).alias("qb"),
        F.when(F.col("side") == 0, F.col("met")).otherwise(F.col("block")).alias("vb"),
        "side", "width", "wide", "ids", "times", "keys", "body",
    )

    def tiles(batches):
        held, key = [None, None], None
        for b in batches:
            for row in b.to_pylist():
                if key != (row["qb"], row["vb"]):
                    key, held = (row["qb"], row["vb"]), [None, None]
                held[row["side"]] = _Side(row)
                if held[0] is None or held[1] is None:
                    continue
                q, c = held
                for lo in range(0, len(q.ids), 256):
                    some = q.cut(np.arange(lo, min(lo + 256, len(q.ids))))
                    for at, v_out, s_out, n_out in _best(some, c, k):
                        at = np.atleast_1d(at)
                        columns = (some.ids[at], some.keys[at], some.times[at], np.full(len(at), row["vb"]), v_out, s_out, n_out)
                        yield pa.RecordBatch.from_arrays([pa.array(np.atleast_1d(x), pa.int64()) for x in columns], names=["query_id", "key", "rows", "part", "vec_id", "score", "times"])

    spread = min(max(nq * nv, 1), 4096)
    found = "query_id long, key long, rows long, part long, vec_id long, score long, times long"
    best = dealt.repartition(spread, "qb", "vb").sortWithinPartitions("qb", "vb", "side").mapInArrow(tiles, found)

    def order(x, y):
        return F.when(x["score"] > y["score"], -1).when(x["score"] < y["score"], 1).when(x["vec_id"] < y["vec_id"], -1).when(x["vec_id"] > y["vec_id"], 1).otherwise(0)

    def merged(df, key):
        return df.groupBy(*key).agg(F.max("rows").alias("rows"), F.slice(F.array_sort(F.flatten(F.collect_list("best")), order), 1, k).alias("best"))

    query = ["query_id", "key"]
    lists = best.groupBy(*query, "part").agg(F.max("rows").alias("rows"), F.collect_list(F.struct("vec_id", "score", "times")).alias("best"))
    left = nv
    while left > 1:
        lists = merged(lists.withColumn("part", F.floor(F.col("part") / fan_in)), [*query, "part"])
        left = math.ceil(left / fan_in)
    # a row for each of several equal ones, k of them at most, and a list for each of several equal queries
    final = merged(lists, query).withColumn(
        "best", F.slice(F.flatten(F.transform("best", lambda h: F.array_repeat(F.struct(h["vec_id"].alias("vec_id"), h["score"].alias("score")), F.least(h["times"], F.lit(k)).cast("int")))), 1, k)
    )
    final = final.select("query_id", "best", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return final.select("query_id", F.posexplode("best").alias("pos", "hit")).select(
        "query_id", (F.col("pos") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score")
    )
