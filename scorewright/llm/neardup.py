"""Near-duplicate groups: SetSketch registers, banded candidates, likelihood estimates, exact confirmation."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import Scratch, components

REGISTERS = 160
ROWS = 4  # registers in a band: at similarity 0.75, all 40 bands miss with probability 2.5e-7
BASE, RATE, TOP = 1.001, 20.0, (1 << 16) - 1
BLOCK = 512
_SKETCH = "doc_id long, n long, key binary, sig binary"


def _hashes():
    rng = np.random.Generator(np.random.PCG64(90210))
    return rng.integers(1, 1 << 63, REGISTERS, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def registers(items: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of 64-bit hashes.

    Register i holds floor(1 - log_BASE(x)), truncated to 0..TOP, of the least exponential variate x (rate RATE) that hash i gives
    any item; the element-wise maximum of two sketches is the sketch of the union.
    """
    if not len(items):
        return np.zeros(REGISTERS, np.uint16)
    a, b = _hashes()
    x = items >> np.uint64(32)
    low = np.empty(REGISTERS)
    for j in range(REGISTERS):
        low[j] = ((x * a[j] + b[j]) >> np.uint64(32)).min()
    least = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint16)


def merge(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    return np.maximum(one, other)


def likely_similarity(above, below, size_u, size_v) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from how many registers of U are above and below V's, with known set sizes."""
    grid = np.linspace(0.0, 1.0, 101)
    u = size_u / (size_u + size_v)
    v = 1 - u
    scale = (BASE - 1) / BASE
    chance = lambda x: np.clip(-np.log1p(-np.maximum(x, 0) * scale) / np.log(BASE), 1e-12, 1)
    up, down = chance(u[:, None] - v[:, None] * grid), chance(v[:, None] - u[:, None] * grid)
    same = np.clip(1 - up - down, 1e-12, 1)
    equal = REGISTERS - above - below
    value = above[:, None] * np.log(up) + below[:, None] * np.log(down) + equal[:, None] * np.log(same)
    # a similarity can't exceed the ratio of the sizes
    value[grid[None] > np.minimum(u / v, v / u)[:, None] + 0.005] = -np.inf
    return grid[value.argmax(1)]


@dataclass(frozen=True)
class Scheme:
    """A kind of sketch: so many 16-bit registers, so many in a band, the sketch of a set, and the estimated similarity of pairs of sketches (x, y, sizes of x and y)."""

    width: int
    rows: int
    registers: Callable
    likely: Callable

    @property
    def bands(self) -> int:
        return self.width // self.rows


def _set_sketch_likely(x, y, n, m):
    return likely_similarity((x > y).sum(1), (x < y).sum(1), n.astype(float), m.astype(float))


SET_SKETCH = Scheme(REGISTERS, ROWS, registers, _set_sketch_likely)


def _sketches(scheme: Scheme):
    def run(batches):
        for b in batches:
            n, key, sig = [], [], []
            for s in wordhash.shingle_sets(b.column("text")):
                n.append(len(s))
                key.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                sig.append(scheme.registers(s).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary())], names=["doc_id", "n", "key", "sig"])

    return run


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), -1)


def _likely(least, scheme: Scheme):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = _sigs(b.column("sig_a")), _sigs(b.column("sig_b"))
            keep = scheme.likely(x, y, *(b.column(c).to_numpy() for c in ("n_a", "n_b"))) >= least
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep)) for c in ("a", "b")], names=["a", "b"])

    return run


def _confirm(percent):
    def run(batches):
        for b in batches:
            held = {}

            def own(node, key, text):
                if node not in held:
                    s = next(wordhash.shingle_sets(pa.array([text], pa.large_string())))
                    if hashlib.blake2b(s.tobytes(), digest_size=16).digest() != key:
                        return None  # another row of a repeated doc_id
                    held[node] = s
                return held[node]

            keep = []
            for a, c, ka, kb, ta, tb in zip(*(b.column(x).to_pylist() for x in ("a", "b", "key_a", "key_b", "text_a", "text_b")), strict=True):
                x, y = own(a, ka, ta), own(c, kb, tb)
                both = len(np.intersect1d(x, y, assume_unique=True)) if x is not None and y is not None else 0
                keep.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(c).filter(pa.array(keep, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    return run


def _compare(percent, least, scheme: Scheme):
    """Rows (band, one, two, at, own, node, comp, n, shared, sig, items) by blocks of a band: links of different components.

    A pair is looked at in the first band that it shares, and never where the shingles that a text shares with any other text under
    question are too few for a link; likely pairs are confirmed on their whole sets.
    """

    def pairs(rows, one, two, at):
        own = np.array([r[0] for r in rows])
        node, comp, n, shared = (np.array([r[i] for r in rows], np.int64) for i in (1, 2, 3, 4))
        sig = np.frombuffer(b"".join(r[5] for r in rows), np.uint16).reshape(len(rows), -1)
        items = [np.frombuffer(r[6], np.uint64) for r in rows]
        bands = sig[:, : scheme.bands * scheme.rows].reshape(len(rows), scheme.bands, scheme.rows)
        left, right = (np.flatnonzero(own == k) for k in (one, two))
        for lo in range(0, len(left), 16):
            i = left[lo : lo + 16]
            most = np.minimum(shared[i][:, None], shared[right][None])
            fits = 100 * most >= percent * (n[i][:, None] + n[right][None] - most)
            fits &= comp[i][:, None] != comp[right][None]
            if one == two:
                fits &= node[i][:, None] < node[right][None]
            p, q = np.nonzero(fits)
            p, q = i[p], right[q]
            for cut in range(0, len(p), 4096):
                x, y = p[cut : cut + 4096], q[cut : cut + 4096]
                near = (sig[x] == sig[y]).mean(1) >= 0.4
                x, y = x[near], y[near]
                if not len(x):
                    continue
                good = scheme.likely(sig[x], sig[y], n[x], n[y]) >= least
                x, y = x[good], y[good]
                first = (bands[x] == bands[y]).all(2).argmax(1) == at if len(x) else np.zeros(0, bool)
                x, y = x[first], y[first]
                both = np.array([len(np.intersect1d(items[i], items[j], assume_unique=True)) for i, j in zip(x, y, strict=True)], np.int64)
                links = (both > 0) & (100 * both >= percent * (n[x] + n[y] - both))
                yield pa.RecordBatch.from_arrays([pa.array(node[x[links]]), pa.array(node[y[links]])], names=["a", "b"])

    def run(batches):
        key, rows = None, []
        names = ("band", "one", "two", "at", "own", "node", "comp", "n", "shared", "sig", "items")
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in names), strict=True):
                if r[:4] != key and rows:
                    yield from pairs(rows, *key[1:])
                    rows = []
                key = r[:4]
                rows.append(r[4:])
        if rows:
            yield from pairs(rows, *key[1:])

    return run


def linked(scratch: Scratch, documents: DataFrame, percent: float, likely: float, scheme: Scheme = SET_SKETCH) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(sketched, classes, texts, links): every document's sketch, the classes of equal sets, the texts of classes with company, and the links
    (a, b) between classes that make the components, confirmed; see near_duplicates."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketched = scratch.table(docs.mapInArrow(_sketches(scheme), _SKETCH))
    classes = scratch.table(
        sketched.where("n > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sig").alias("sig"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    at = F.explode(F.sequence(F.lit(0), F.lit(scheme.bands - 1))).alias("at")
    wide = 2 * scheme.rows
    bands = classes.select("node", "sig", at).select("node", "at", F.xxhash64(F.substring("sig", F.col("at") * wide + 1, F.lit(wide)), "at").alias("band"))
    company = bands.groupBy("band").agg(F.count("*").alias("c")).where("c > 1")
    members = scratch.table(bands.join(company, "band"))
    degree = members.groupBy("node").agg(F.sum(F.col("c") - 1).alias("degree"))
    # written, so that the rows of a very common band are split over several tasks
    leader = scratch.table(members.join(degree, "node").groupBy("band").agg(F.max(F.struct("degree", "node")).alias("top")).select("band", F.col("top.node").alias("a")))
    star = members.join(leader, "band").where("node <> a").select("a", F.col("node").alias("b")).distinct()
    # the texts of one document of each class that has any company; rows alike are where their doc_id is, so they aren't shuffled again
    wanted = classes.join(degree.select("node"), "node", "left_semi").select("node", "key", F.col("least").alias("doc_id"))
    texts = scratch.table(docs.join(wanted, "doc_id").dropDuplicates(["doc_id", "node", "key", "text"]).select("node", "key", "text"))
    side = lambda df, x: df.select(*[F.col(c).alias(c.replace("node", x) if c == "node" else f"{c}_{x}") for c in df.columns])
    small = classes.select("node", "n", "sig")
    likely_pairs = scratch.table(star.join(side(small, "a"), "a").join(side(small, "b"), "b").mapInArrow(_likely(likely, scheme), "a long, b long"))

    def confirmed(pairs):
        return scratch.table(pairs.join(side(texts, "b"), "b").join(side(texts, "a"), "a").mapInArrow(_confirm(percent), "a long, b long"))

    links = confirmed(likely_pairs)
    comp = scratch.table(components(scratch, links))
    where = members.join(comp.withColumnRenamed("id", "node"), "node", "left").withColumn("comp", F.coalesce("component_id", "node")).select("band", "at", "node", "comp")
    mixed = lambda df: df.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count("*").alias("m")).where("x <> y").select("band", "m")
    # a band of two has had its only pair tested
    rest = scratch.table(where.join(mixed(where).where("m > 2"), "band").drop("m"))

    def whole(batches):
        for b in batches:
            sets = list(wordhash.shingle_sets(b.column("text")))
            ok = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in zip(sets, b.column("key").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "items"]).filter(pa.array(ok, pa.bool_()))

    def spread(batches):
        for b in batches:
            items = b.column("items").to_pylist()
            node = np.repeat(b.column("node").to_numpy(), [len(x) // 8 for x in items])
            yield pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(np.frombuffer(b"".join(items), np.int64))], names=["node", "shingle"])

    sets = scratch.table(texts.join(rest.select("node").distinct(), "node", "left_semi").mapInArrow(whole, "node long, items binary"))
    own = sets.mapInArrow(spread, "node long, shingle long")
    common = own.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    shared = own.join(common, "shingle").groupBy("node").agg(F.count("*").alias("shared"))
    fit = shared.join(classes.select("node", "n", "sig"), "node").where(F.col("shared") * 100 >= F.col("n") * percent)
    left = scratch.table(rest.join(fit, "node"))
    sized = left.join(mixed(left), "band").withColumn("g", F.ceil(F.col("m") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("g")).cast("int"))
    dealt = sized.join(sets, "node").withColumn("met", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "band", F.least("own", "met").alias("one"), F.greatest("own", "met").alias("two"), "at", "own", "node", "comp", "n", "shared", "sig", "items"
    )
    more = scratch.table(
        dealt.repartition("band", "one", "two").sortWithinPartitions("band", "one", "two").mapInArrow(_compare(percent, likely, scheme), "a long, b long")
    )
    return sketched, classes, texts, links.unionByName(more)


def near_duplicates(documents: DataFrame, percent: int = 75, likely: float = 0.5, scheme: Scheme = SET_SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): groups of documents linked by similar sets of 5-word shingles.

    Two documents are linked if 100 * |intersection| >= percent * |union|, confirmed on the full sets. Words are runs of bytes other than
    space and \\t..\\r, A-Z in lower case; fewer than five words make one shingle; null and empty texts have none and are linked
    with nothing. component_id is the smallest doc_id reachable. A null doc_id is linked with nothing,
    has a null component_id and is kept. Rows that repeat an id are documents with that id. Extra columns are ignored; no documents give no rows.

    Documents with equal sets are one class, found by an aggregate. In each band the class with the most company leads, and only
    pairs with a leader are candidates (as many as rows, whatever the group). They are estimated from the sketches by likelihood and
    confirmed on whole texts. Links between two non-leaders matter only if they join different components. Those are searched in
    blocks of at most about BLOCK classes a side, after leaving out classes that share too few shingles with any other to have a
    link: exact for bands of any size, with no pairs inside a group that is already joined.
    """
    scratch = Scratch(documents.sparkSession, merging=True)
    sketched, classes, _, links = linked(scratch, documents, percent, likely, scheme)
    joined = components(scratch, links).select(F.col("id").alias("node"), F.col("component_id").alias("comp"))
    of_class = scratch.table(classes.select("key", "node", "least").join(joined, "node", "left").withColumn("comp", F.coalesce("comp", "node")).select("key", "least", "comp"))
    lowest = of_class.groupBy("comp").agg(F.min("least").alias("component"))
    named = of_class.join(lowest, "comp").select("key", "component")
    out = sketched.where("n > 0 and doc_id is not null").select("doc_id", "n", "key").join(named, "key").select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
    alone = sketched.where("n = 0 or doc_id is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return scratch.finish(out.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(documents: DataFrame, percent: int = 75) -> DataFrame:
    """One row of each group, that with the smallest doc_id, with all its columns; rows alike in doc_id and text count once.

    Documents without a word or without a doc_id are in no group and stay. Of an id that is given to different texts all texts
    stay or go, as its group's smallest id does or doesn't. No documents give no rows.
    """
    kept = near_duplicates(documents, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    with_id = documents.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return with_id.select(*documents.columns).unionByName(documents.where("doc_id is null"))
