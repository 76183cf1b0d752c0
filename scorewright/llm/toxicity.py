"""Toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import Scratch

BUCKETS = 1 << 22
PREFIXES = (4, 5, 6)
FOLDS = 5


def _terms(data, offsets):
    """(features by row, bounds): a word's prefixes and the word itself, hashed into BUCKETS."""
    hashes, bounds = wordhash.words(data, offsets, gaps=wordhash.IS_MARK, value=wordhash.FOLDED_VALUE, prefixes=PREFIXES)
    hashes ^= np.arange(len(hashes), dtype=np.uint64)[:, None] * wordhash.STEP[9]
    return (wordhash.mix(hashes) & np.uint64(BUCKETS - 1)).astype(np.int64), bounds


def _active(data, offsets, chosen, slot):
    """Sorted distinct (document, position in the model) pairs for the model's features."""
    terms, bounds = _terms(data, offsets)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    pairs = [np.zeros(0, np.int64)]
    for row in terms:
        hit = np.flatnonzero(chosen[row])
        pairs.append(owner[hit] * len(slot) + np.searchsorted(slot, row[hit]))
    pairs = np.unique(np.concatenate(pairs))
    return (pairs // len(slot), pairs % len(slot)) if len(slot) else (pairs, pairs)


class FactorizationMachine:
    """w0 + sum w_i + sum over pairs <v_i, v_j> of the features present, through the logistic function."""

    def __init__(self, features: int, factors: int = 4, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bias, self.weight = 0.0, np.zeros(features)
        self.factor = rng.normal(0, 0.02, (features, factors))

    def margins(self, docs: np.ndarray, feats: np.ndarray, n: int) -> np.ndarray:
        return self._sums(docs, feats, n)[0]

    def _sums(self, docs, feats, n):
        total = np.stack([np.bincount(docs, self.factor[feats, f], n) for f in range(self.factor.shape[1])], 1)
        square = np.bincount(docs, (self.factor[feats] ** 2).sum(1), n)
        return self.bias + np.bincount(docs, self.weight[feats], n) + ((total**2).sum(1) - square) / 2, total

    def fit(self, docs, feats, labels, steps: int = 300, rate: float = 0.05, l2: float = 3e-5):
        """Adam on the mean logistic loss, over all rows in each step."""
        n, k = len(labels), len(self.weight)
        rate_of_ones = min(max(labels.mean(), 1e-3), 1 - 1e-3)
        self.bias = float(np.log(rate_of_ones / (1 - rate_of_ones)))
        state = [np.zeros(x) for x in (1, k, self.factor.shape) for _ in range(2)]
        for t in range(1, steps + 1):
            margin, total = self._sums(docs, feats, n)
            off = (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels) / n
            each = off[docs]
            seen = np.bincount(feats, each, k)
            inner = np.stack([np.bincount(feats, each * total[docs, f], k) for f in range(self.factor.shape[1])], 1)
            grads = (np.array([off.sum()]), seen + l2 * self.weight, inner - self.factor * seen[:, None] + l2 * self.factor)
            moves = []
            for i, g in enumerate(grads):
                state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
                state[2 * i + 1] = 0.999 * state[2 * i + 1] + 0.001 * g * g
                moves.append(rate * (state[2 * i] / (1 - 0.9**t)) / (np.sqrt(state[2 * i + 1] / (1 - 0.999**t)) + 1e-8))
            self.bias -= float(moves[0][0])
            self.weight -= moves[1]
            self.factor -= moves[2]
        return self


def _counted(batches):
    """(feature, ones, zeros): in how many texts of either label each feature is, for each batch."""
    for b in batches:
        label = b.column("label").to_numpy()
        data, offsets = wordhash.utf8(b.column("text"))
        for lo, hi in wordhash.chunks(offsets):
            terms, bounds = _terms(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
            pairs = np.unique(np.concatenate([owner * BUCKETS + row for row in terms]))
            feats, which = np.unique(pairs % BUCKETS, return_inverse=True)
            ones = np.bincount(which, label[lo + pairs // BUCKETS], len(feats)).astype(np.int64)
            zeros = np.bincount(which, minlength=len(feats)) - ones
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (feats, ones, zeros)], names=["feature", "ones", "zeros"])


def _fold(column):
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == 0, F.lit(False))


def learn_toxicity(documents: DataFrame, labels: DataFrame, sample: int = 20_000, features: int = 4096, least: float = 15.0):
    """A function from a column of texts to their scores, learnt as score_toxicity says."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    known = labels.where("doc_id is not null and toxic is not null").where(~_fold(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("long").alias("label"))
    share = int(min(1.0, sample / max(1, known.count())) * 1_000_000)
    known = known.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1_000_000)) < share)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most about `sample` rows: a bound that doesn't grow with the documents
    train = scratch.table(docs.join(F.broadcast(known), "doc_id").groupBy("text").agg(F.max("label").alias("label")))
    n, ones = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = ones / n if n else 0.0
    model, slot = FactorizationMachine(0), np.zeros(0, np.int64)
    if 0 < ones < n:
        counted = train.mapInArrow(_counted, "feature long, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("a"), F.sum("zeros").alias("b"))
        a, b, both = F.col("a").cast("double"), F.col("b").cast("double"), (F.col("a") + F.col("b")).cast("double")
        part = lambda x, mean: F.when(x > 0, x * F.log(x / mean)).otherwise(0.0)
        rest_a, rest_b, rest = F.lit(float(ones)) - a, F.lit(float(n - ones)) - b, F.lit(float(n)) - both
        ratio = 2 * (part(a, both * prior) + part(b, both * (1 - prior)) + part(rest_a, rest * prior) + part(rest_b, rest * (1 - prior)))
        slot = np.array(sorted(r.feature for r in counted.withColumn("g", ratio).where(F.col("g") >= least).orderBy(F.desc("g"), "feature").limit(features).select("feature").collect()), np.int64)

        def active(batches):
            chosen = np.zeros(BUCKETS, bool)
            chosen[slot] = True
            for batch in batches:
                data, offsets = wordhash.utf8(batch.column("text"))
                label = batch.column("label").to_numpy()
                for lo, hi in wordhash.chunks(offsets):
                    d, f = _active(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], chosen, slot)
                    lists = [x.astype(np.int32).tobytes() for x in np.split(f, np.searchsorted(d, np.arange(1, hi - lo)))]
                    yield pa.RecordBatch.from_arrays([pa.array(label[lo:hi], pa.int64()), pa.array(lists, pa.binary())], names=["label", "feats"])

        rows = sorted((r.label, bytes(r.feats)) for r in train.mapInArrow(active, "label long, feats binary").collect())
        lists = [np.frombuffer(f, np.int32) for _, f in rows]
        docs_at = np.repeat(np.arange(len(rows)), [len(x) for x in lists])
        feats = np.concatenate([np.zeros(0, np.int32), *lists]).astype(np.int64)
        model = FactorizationMachine(len(slot)).fit(docs_at, feats, np.array([r[0] for r in rows], float))
    else:
        model.bias = float(np.log(prior / (1 - prior))) if 0 < prior < 1 else (40.0 if prior else -800.0)

    scratch.drop()

    def score(column) -> np.ndarray:
        chosen = np.zeros(BUCKETS, bool)
        chosen[slot] = True
        data, offsets = wordhash.utf8(column)
        out = np.zeros(len(offsets) - 1)
        for lo, hi in wordhash.chunks(offsets):
            d, f = _active(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], chosen, slot)
            with np.errstate(over="ignore"):
                out[lo:hi] = 1 / (1 + np.exp(-model.margins(d, f, hi - lo)))
        return out

    return score


def score_toxicity(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every document, learnt from `labels` (doc_id, toxic).

    Learns only from rows whose crc32(doc_id as text) mod 5 is not 0, and from about `sample` of them
    at most (chosen by a hash of doc_id; texts that repeat count once). Terms are the words and their first 4, 5 and 6 bytes; the model keeps the `features` terms that
    tell the labels apart most (a likelihood ratio of `least` or more). A document's score is the machine's probability
    for the terms present in its whole text. Null and empty texts have no term: they score as the
    bias says. Without labels, or with one class only, all documents score the share of ones (0.0 without labels).
    A doc_id labelled twice is toxic if either label says so; null labels and ids teach nothing. A null doc_id is held out = false.
    Extra columns are ignored; no documents give no rows.
    """
    score = learn_toxicity(documents, labels, **settings)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score(b.column("text")))], names=["doc_id", "score"])

    scored = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", _fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(documents: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of `documents`, all their columns unchanged, that don't score 0.5 or more.

    Null and empty texts score as the bias says, so they stay unless most labels are toxic; repeated rows stay or go alike, a null doc_id is no
    reason to go, without labels all stay, and no documents give no rows.
    """
    score = learn_toxicity(documents, labels, **settings)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(score(b.column("text")) < 0.5))

    return documents.mapInArrow(run, documents.schema)
