"""Language identification by mixtures of n-gram models, fitted to each document by expectation-maximisation."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import Scratch

KINDS = 64
GRAMS = KINDS**3
FOLDS, HELD_OUT = 4, 2


def _kinds() -> np.ndarray:
    """Bytes by kind: 0 ends a word, 1-26 are letters without case, the rest are bytes of other characters (Latin-1 without case)."""
    out = np.zeros(256, np.int64)
    for b in range(256):
        if b < 128 and chr(b).isalpha():
            out[b] = ord(chr(b).lower()) - 96
        elif b >= 128:
            out[b] = 27 + ((b | 0x20) if b < 0xC0 else b) * 7 % 37
    return out


_KIND = _kinds()


def grams(data: np.ndarray, offsets: np.ndarray):
    """(codes, bounds): each document's 3-byte grams with a letter in the middle; words are bounded by kind 0."""
    kind = _KIND[data]
    left, right = np.zeros_like(kind), np.zeros_like(kind)
    left[1:], right[:-1] = kind[:-1], kind[1:]
    inner = offsets[(offsets > 0) & (offsets < len(data))]
    left[inner] = 0
    right[inner - 1] = 0
    at = np.flatnonzero(kind)
    return (left[at] * KINDS + kind[at]) * KINDS + right[at], np.searchsorted(at, offsets)


def _mixture(like, weight, first, size, allowed, rounds: int, close: float):
    """(shares, log likelihoods) of each document's mixture of its allowed languages; its grams start at `first` and have weights.

    Rounds go on until no share of any document changes by more than `close`, `rounds` at most.
    """
    share = allowed / allowed.sum(1, keepdims=True)
    n = np.diff(np.append(first, len(like)))
    for _ in range(rounds):
        part = like * np.repeat(share, n, axis=0)
        part *= (weight / part.sum(1))[:, None]
        before, share = share, np.add.reduceat(part, first, axis=0) / size[:, None]
        if np.abs(share - before).max() <= close:
            break
    return share, np.add.reduceat(np.log((like * np.repeat(share, n, axis=0)).sum(1)) * weight, first)


def mixtures(codes, bounds, table, rounds: int = 30, close: float = 0.005, penalty: float = 3.0):
    """(best language, its share) for each document; -1 where a document has no gram.

    `table` has log p(gram | language) by gram and language. The mixture of all languages ranks them; sets of the first 1, 2, 3 and so
    on are fitted for as long as that raises the log likelihood less penalty * (languages - 1) * log(grams). The language with the
    largest share in the last set that did, and this share, are taken (ties to the first). Expectation-maximisation ends where no share
    changes by more than `close`, or after `rounds` rounds.
    """
    n, langs = len(bounds) - 1, table.shape[1]
    best, sure = np.full(n, -1), np.zeros(n)
    live = np.flatnonzero(np.diff(bounds))
    if not len(live) or not langs:
        return best, sure
    size = np.diff(bounds)[live].astype(float)
    # a gram that a document repeats counts as one with a weight
    owner = np.repeat(np.arange(len(live)), np.diff(bounds)[live])
    pairs, weight = np.unique(owner * len(table) + codes, return_counts=True)
    first = np.searchsorted(pairs, np.arange(len(live)) * len(table))
    many = np.diff(np.append(first, len(pairs)))
    logs = table[pairs % len(table)].astype(float)
    weight = weight.astype(float)
    # each gram's likelihoods relative to its best language: no underflow, and the same constant in every set
    top = logs.max(1)
    constant = np.add.reduceat(top * weight, first)
    alone = np.add.reduceat((logs - top[:, None]) * weight[:, None], first, axis=0) + constant[:, None]
    like = np.exp(logs - top[:, None])
    full, _ = _mixture(like, weight, first, size, np.ones((len(live), langs)), rounds, close)
    order = np.argsort(-full, axis=1, kind="stable")
    pick = alone.argmax(1)
    value, mine = alone[np.arange(len(live)), pick], np.ones(len(live))
    some = np.arange(len(live))
    for k in range(2, langs + 1):
        # a language without a share in the mixture of all can't pay for its penalty
        some = some[full[some, order[some, k - 1]] > 0]
        if not len(some):
            break
        allowed = np.zeros((len(some), langs))
        np.put_along_axis(allowed, order[some, :k], 1.0, 1)
        chosen = np.zeros(len(live), bool)
        chosen[some] = True
        rows = np.repeat(chosen, many)
        starts = np.concatenate([[0], np.cumsum(many[some])[:-1]])
        share, total = _mixture(like[rows], weight[rows], starts, size[some], allowed, rounds, close)
        worth = total + constant[some] - penalty * (k - 1) * np.log(size[some] + 1)
        better = worth > value[some]
        share, some = share[better], some[better]
        value[some] = worth[better]
        pick[some] = share.argmax(1)
        mine[some] = share.max(1)
    best[live] = pick
    sure[live] = mine
    return best, sure


def _held_out(column):
    return F.coalesce(F.crc32(column.cast("string")) % FOLDS == HELD_OUT, F.lit(False))


def learn_languages(documents: DataFrame, sample: int = 20_000, smoothing: float = 0.05):
    """A function from a column of texts to (language or None, score) arrays, learnt as identify_language says."""
    spark = documents.sparkSession
    scratch = Scratch(spark)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    taught = docs.where("lang is not null and doc_id is not null").where(~_held_out(F.col("doc_id")))
    share = int(min(1.0, sample / max(1, taught.count())) * 1_000_000)
    taught = taught.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1_000_000)) < share).where("text is not null")

    def count(batches):
        for b in batches:
            names = np.array(b.column("lang").to_pylist(), object)
            data, offsets = wordhash.utf8(b.column("text"))
            for name in sorted(set(names)):
                seen = np.zeros(GRAMS, np.int64)
                for lo, hi in wordhash.chunks(offsets):
                    own = np.flatnonzero(names[lo:hi] == name)
                    codes, bounds = grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                    for i in own:
                        seen += np.bincount(codes[bounds[i] : bounds[i + 1]], minlength=GRAMS) if bounds[i + 1] - bounds[i] > GRAMS else 0
                        if bounds[i + 1] - bounds[i] <= GRAMS:
                            np.add.at(seen, codes[bounds[i] : bounds[i + 1]], 1)
                code = np.flatnonzero(seen)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * len(code), pa.string()), pa.array(code, pa.int64()), pa.array(seen[code], pa.int64())], names=["lang", "code", "n"]
                )

    counted = scratch.table(taught.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")))
    rows = counted.toPandas()
    scratch.drop()
    langs = sorted(rows["lang"].unique())
    table = np.full((GRAMS, len(langs)), smoothing)
    for i, name in enumerate(langs):
        own = rows[rows["lang"] == name]
        table[own["code"].to_numpy(), i] += own["n"].to_numpy()
    table = np.log(table / table.sum(0, keepdims=True)).astype(np.float32) if len(langs) else table
    shared = spark.sparkContext.broadcast(table)
    step = (1 << 20) * 4 // max(4, len(langs))

    def predict(column):
        data, offsets = wordhash.utf8(column)
        names, sure = np.full(len(offsets) - 1, None, object), np.zeros(len(offsets) - 1)
        for lo, hi in wordhash.chunks(offsets, step):
            best, score = mixtures(*grams(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]), shared.value)
            sure[lo:hi] = np.clip(score, 0, 1)
            names[lo:hi] = [langs[i] if i >= 0 else None for i in best]
        return names, sure

    return predict


def identify_language(documents: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every document.

    The n-gram models are counted from about `sample` documents at most (chosen by a hash of doc_id) with a lang, a text, and a
    crc32(doc_id as text) mod 4 that isn't 2; a null doc_id is held out = false and teaches nothing. Predictions read the whole
    text alone. lang_pred is the language with the largest share in the document's mixture of the set of languages that penalised likelihood
    selects (see mixtures; ties to the first by name), and score this share: 1.0 if one language explains the text best. `und` with score 0.0 if the text is null or has no letter, or if no language could be learnt.
    Repeated rows are predicted alike, extra columns are ignored, no documents give no rows.
    The counts that reach the driver are bounded by the languages and the kinds of grams.
    """
    learnt = learn_languages(documents, **settings)

    def run(batches):
        for b in batches:
            names, sure = learnt(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("letters"), pa.array(names, pa.string()), pa.array(sure)], names=["doc_id", "letters", "name", "sure"])

    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    out = documents.select(F.col("doc_id").cast("long").alias("doc_id"), letters, "text").mapInArrow(run, "doc_id long, letters boolean, name string, sure double")
    known = F.col("letters") & F.col("name").isNotNull()
    return out.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), F.when(known, F.col("name")).otherwise("und").alias("lang_pred"), F.when(known, F.col("sure")).otherwise(0.0).alias("score")
    )


def keep_languages(documents: DataFrame, least_share: float = 0.4, **settings) -> DataFrame:
    """The rows of `documents`, all their columns unchanged, whose text has a letter and a language with `least_share` of its mixture or more.

    Rows with a null or empty text or one without a letter go, and so do all rows where no language could be learnt; repeated rows stay or go alike,
    a null doc_id is no reason to go, and no documents give no rows.
    """
    learnt = learn_languages(documents, **settings)

    def run(batches):
        for b in batches:
            names, sure = learnt(b.column("text"))
            yield b.filter(pa.array((names != None) & (sure >= least_share)))  # noqa: E711

    return documents.where(F.col("text").rlike(r"\p{L}")).mapInArrow(run, documents.schema)
