"""MinHash fingerprints of whole texts, their banded near-duplicate join, and the edited-text digest."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import Scratch, lean, partitions
from .neardup import Scheme, linked, near_duplicates

SLOTS = 64
WORDS = 5
ROWS = 3  # slots in a band: at similarity 0.75 all 21 bands miss with probability 1e-5
_LOW = np.iinfo(np.int64).min


def _permutations(slots: int):
    rng = np.random.Generator(np.random.PCG64(7321))
    return rng.integers(1, 1 << 63, slots, dtype=np.uint64) | np.uint64(1), rng.integers(0, 1 << 63, slots, dtype=np.uint64)


def _padded_shingles(hashes, bounds, k):
    """The k words that end at each word; places before the first word count as a fixed blank."""
    n = np.diff(bounds)
    wide = np.zeros(len(hashes) + (k - 1) * len(n), np.uint64)
    at = np.arange(len(hashes)) + np.repeat((k - 1) * np.arange(1, len(n) + 1), n)
    wide[at] = hashes
    total = np.zeros(len(hashes), np.uint64)
    for j in range(k):
        total += wide[at - (k - 1 - j)] * wordhash.STEP[j]
    return wordhash.mix(total)


def signatures(column, slots: int = SLOTS, k: int = WORDS) -> np.ndarray:
    """uint32 minima, a row for each text: slots universal hashes over the shingles of k words.

    Shingles end at each word, so a text of n words has n of them; a text without words keeps the
    largest value in every slot.
    """
    a, b = _permutations(slots)
    data, offsets = wordhash.utf8(column)
    out = np.full((len(offsets) - 1, slots), 0xFFFFFFFF, np.uint32)
    for lo, hi in wordhash.chunks(offsets, 1 << 20):
        hashes, bounds = wordhash.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        if not len(hashes):
            continue
        x = _padded_shingles(hashes, bounds, k) >> np.uint64(32)
        full = np.flatnonzero(np.diff(bounds))
        held = np.empty_like(x)
        for j in range(slots):
            np.multiply(x, a[j], out=held)
            held += b[j]
            out[lo + full, j] = np.minimum.reduceat(held, bounds[full]) >> np.uint64(32)
    return out


def _minima(items: np.ndarray) -> np.ndarray:
    """The low 16 bits of the slots' minima over a set of shingle hashes."""
    a, b = _permutations(SLOTS)
    if not len(items):
        return np.full(SLOTS, 0xFFFF, np.uint16)
    x = items >> np.uint64(32)
    return np.array([((x * a[j] + b[j]).min() >> np.uint64(32)) & np.uint64(0xFFFF) for j in range(SLOTS)], np.uint16)


def _equal_slots(x, y, n, m):
    return (x == y).mean(1)


MIN_HASH = Scheme(SLOTS, ROWS, _minima, _equal_slots)


def _hex(sig: np.ndarray) -> pa.Array:
    """The low 16 bits of each slot as one hexadecimal string for each row."""
    body = sig.astype(">u2").tobytes().hex()
    wide = sig.shape[1] * 4
    return pa.array([body[i : i + wide] for i in range(0, len(body), wide)], pa.string())


_EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edit(batches):
    """Rows (bucket, is_next, doc_id, text) sorted by bucket, order and is_next last: one row out for each not is_next."""

    def digest(ids, texts, following):
        edited = []
        for t, f in zip(texts, following, strict=True):
            m = len(t) // 4
            edited.append(t[: len(t) - m] + f[:m])
        own, new, nxt = (signatures(pa.array(x, pa.large_string())) for x in (texts, edited, following))
        fold = lambda s: s & np.uint32(0xFFFF)
        near = lambda x: (fold(own) == fold(x)).mean(axis=1)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                _hex(own), _hex(new), pa.array(near(new)), pa.array(near(nxt)),
            ],
            names=[x.split()[0] for x in _EDITED.split(", ")],
        )

    ids, texts, following, held = [], [], [], None
    size = 0
    for b in batches:
        for bucket, is_next, doc, text in zip(*(b.column(c).to_pylist() for c in ("bucket", "is_next", "doc_id", "text")), strict=True):
            text = text or ""
            if held is not None and held[0] == bucket:
                ids.append(held[1]), texts.append(held[2]), following.append(text)
                size += len(held[2]) + len(text)
                if size > 1 << 20:
                    yield digest(ids, texts, following)
                    ids, texts, following, size = [], [], [], 0
            held = None if is_next else (bucket, doc, text)
    if ids:
        yield digest(ids, texts, following)


def fingerprint_edits(documents: DataFrame) -> DataFrame:
    """Every document's fingerprint beside that of its text with the last quarter replaced.

    The last floor(n_chars / 4) code points give way to the first as many of the next document (all, if
    it has fewer), by ascending doc_id and, among repeated ids, text; the first document follows the last. A null text is
    empty; rows with a null doc_id come first. A lone document follows itself. Likeness is the
    share of equal slots, so two texts without words are alike (1.0). Other columns are ignored,
    and no documents give no rows.

    Only ids are used to cut the order into ranges; texts are shuffled once, to their range, and a
    range's first document goes to the range before it as well.
    """
    spark = documents.sparkSession
    lean(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("key", F.coalesce("doc_id", F.lit(_LOW)))
    ids = docs.select("key")
    ranges = max(2, 2 * partitions(spark))
    cuts = ids.select(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 100 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    bucket = F.lit(0)
    if cuts:
        # the number of cuts below the key, found without a join
        bucket = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("key")))
    least = {r.bucket: r.least for r in ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.min("key").alias("least")).collect()}
    if not least:
        return spark.createDataFrame([], _EDITED)
    filled = sorted(least)
    before = {b: filled[i - 1] for i, b in enumerate(filled)}
    heads = F.create_map(*[F.lit(x) for b in filled for x in (least[b], before[b])])
    dealt = docs.withColumn("bucket", bucket).withColumn("to", heads[F.col("key")])
    own = F.struct(F.col("bucket"), F.lit(False).alias("is_next"))
    dealt = dealt.withColumn(
        "deal", F.explode(F.when(F.col("to").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("to").alias("bucket"), F.lit(True).alias("is_next")))))
    ).select("deal.bucket", "deal.is_next", "key", "doc_id", "text")
    return (
        dealt.repartition(ranges, "bucket").sortWithinPartitions("bucket", "is_next", "key", "text")
        .select("bucket", "is_next", "doc_id", "text").mapInArrow(_edit, _EDITED)
    )


def near_pairs(documents: DataFrame, least: float = 0.75) -> DataFrame:
    """(a, b, jaccard), a < b: links between documents whose shingle sets are at least so alike, enough of them to join all that belong together.

    Documents with equal sets are linked with the smallest doc_id among them (jaccard 1.0), and that one stands for them in other links.
    Texts without words and rows without doc_id are linked with nothing; rows that repeat an id are documents with that id. No documents
    give no rows. Classes of equal sets meet in bands of ROWS slots of their MinHash signatures with one leader for each band, and those that
    a leader leaves in different components are searched in blocks; so the pairs grow with the documents, not with the square of a group.
    Pairs with under `least` - 0.3 of their slots equal are left out, the others' Jaccard similarity is verified on the whole sets.
    """
    def verify(batches):
        for b in batches:
            rows, near = [], []
            sets = [wordhash.shingle_sets(b.column(c), WORDS) for c in ("text_a", "text_b")]
            for i, (x, y, ka, kb) in enumerate(zip(*sets, b.column("key_a").to_pylist(), b.column("key_b").to_pylist(), strict=True)):
                # another row of a repeated doc_id has another set
                if all(hashlib.blake2b(s.tobytes(), digest_size=16).digest() == k for s, k in ((x, ka), (y, kb))):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    rows.append(i), near.append(both / (len(x) + len(y) - both))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("a").take(at), b.column("b").take(at), pa.array(near, pa.float64())], names=["a", "b", "jaccard"])

    scratch = Scratch(documents.sparkSession, merging=True)
    sketched, classes, texts, links = linked(scratch, documents, 100 * least, least - 0.3, MIN_HASH)
    side = lambda x: texts.join(classes.select("node", "least"), "node").select(F.col("node").alias(f"node_{x}"), F.col("least").alias(x), F.col("key").alias(f"key_{x}"), F.col("text").alias(f"text_{x}"))
    found = (
        links.select(F.col("a").alias("node_a"), F.col("b").alias("node_b")).distinct().join(side("a"), "node_a").join(side("b"), "node_b")
        .select("a", "b", "key_a", "key_b", "text_a", "text_b").mapInArrow(verify, "a long, b long, jaccard double")
    )
    equal = sketched.where("n > 0").join(classes.select("key", "least"), "key").select(F.col("least").alias("a"), F.col("doc_id").alias("b"), F.lit(1.0).alias("jaccard"))
    pairs = found.unionByName(equal).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "jaccard")
    return scratch.finish(pairs.groupBy("a", "b").agg(F.max("jaccard").alias("jaccard")))


def near_groups(documents: DataFrame, percent: int = 75) -> DataFrame:
    """(doc_id, group_id) of each distinct doc_id: the smallest one that it reaches by links of at least `percent` of shared shingles.

    As near_pairs: signature bands are joined, the Jaccard similarity of what meets is verified. An id of different texts has the smallest of their
    groups; null ids have no row.
    """
    rows = near_duplicates(documents, percent, percent / 100 - 0.3, MIN_HASH).where("doc_id is not null")
    return rows.groupBy("doc_id").agg(F.min("component_id").alias("group_id"))


def fingerprint_documents(documents: DataFrame, percent: int = 75) -> DataFrame:
    """fingerprint_edits with group_id, as near_groups has it; null for a null doc_id."""
    scratch = Scratch(documents.sparkSession, merging=True)
    groups = scratch.table(near_groups(documents, percent)).withColumnRenamed("doc_id", "_id")
    # the shuffled texts are gone before the prints are shuffled
    prints = scratch.table(fingerprint_edits(documents))
    return scratch.finish(prints.join(groups, F.col("doc_id") == F.col("_id"), "left").select(*prints.columns, "group_id"))
