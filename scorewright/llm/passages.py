"""Repeated passages across documents: shared seeds, collinear chains, word alignment."""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash
from .cluster import Scratch, partitions

SEED = 6  # words of a short seed
RUN, STEP = 20, 10  # words of a long seed, and how finely the wider seeds round it are laid
GAP_COST = 0.08  # for each word skipped on either side, against SEED for a match
MARGIN, RESYNC, EDGE = 64, 40, 4
NEAR, ROUND = 4096, 64  # spans of words that are cut from a text together, and the grid of their ends
TASK_BYTES = 10 << 20  # of text, for each bucket of its seeds
PIECE, PIECES, ROW = 1 << 18, 1 << 22, 256  # seeds that are dealt together: at least, at most (but for one chunk of text), and for each bucket
_FACTOR, _LOW = np.uint64(0xD1342543DE82EF95), np.uint64((1 << 40) - 1)
JOIN = 6  # passages of one document this many words apart, or fewer, are one


def _sliding(x: np.ndarray, width: int, least) -> np.ndarray:
    """The least (or largest) of every `width` neighbours, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = least(x[:-step], x[step:])
        have += step
    return x


def minimizers(h: np.ndarray, window: int) -> np.ndarray:
    """Positions that are the least of some window; of a shorter text, its least."""
    if len(h) <= window:
        return np.flatnonzero(h == h.min()) if len(h) else np.zeros(0, np.int64)
    low = _sliding(h, window, np.minimum)
    pad = np.zeros(window - 1, np.uint64)
    return np.flatnonzero(_sliding(np.concatenate([pad, low, pad]), window, np.maximum) == h)


def packed(arrays, lo: int, hi: int) -> bytes:
    """Rows lo:hi of integer arrays as their count and, for each array, the planes of the low bytes that its differences (zigzag) need."""
    head, planes = [np.uint64(hi - lo).tobytes()], []
    for x in arrays:
        step = np.diff(x[lo:hi].astype(np.int64), prepend=0)
        step = ((step << 1) ^ (step >> 63)).view(np.uint64)
        wide = (int(step.max()).bit_length() + 7) // 8 if len(step) else 0
        head.append(bytes([wide]))
        planes.append(step.view(np.uint8).reshape(-1, 8)[:, :wide].T.tobytes())
    return b"".join(head + planes)


def unpacked(body: bytes, count: int) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(body, np.uint64, 1)[0]), 8 + count, []
    for wide in body[8:at]:
        step = np.zeros((n, 8), np.uint8)
        step[:, :wide] = np.frombuffer(body, np.uint8, n * wide, at).reshape(wide, n).T
        at += n * wide
        step = step.view(np.uint64)[:, 0]
        out.append(np.cumsum((step >> np.uint64(1)).view(np.int64) ^ -(step & np.uint64(1)).view(np.int64)))
    return out


def _dealt(bucket: np.ndarray, arrays) -> pa.RecordBatch:
    """One row (bucket, body) for each bucket, with the rows of the arrays that are in it."""
    order = np.argsort(bucket, kind="stable")
    bucket, arrays = bucket[order], [x[order] for x in arrays]
    cuts = np.concatenate([np.flatnonzero(np.diff(bucket, prepend=-1)), [len(bucket)]]) if len(bucket) else [0]
    body = [packed(arrays, lo, hi) for lo, hi in zip(cuts, cuts[1:])]
    return pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int32()), pa.array(body, pa.binary())], names=["bucket", "body"])


def _gathered(batches, count: int):
    """Rows (bucket, body) sorted by bucket, to each bucket's arrays."""
    held, parts = None, []
    for b in batches:
        for bucket, body in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True):
            if bucket != held and parts:
                yield [np.concatenate(x) for x in zip(*parts, strict=True)]
                parts = []
            held = bucket
            parts.append(unpacked(body, count))
    if parts:
        yield [np.concatenate(x) for x in zip(*parts, strict=True)]


def _long(h: np.ndarray, k: int) -> np.ndarray:
    """The hash of the k words from each word on."""
    out, have, power = h, 1, _FACTOR
    for bit in bin(k)[3:]:
        out, have, power = out[: len(out) - have] * power + out[have:], 2 * have, power * power
        if bit == "1":
            out, have, power = out[:-1] * _FACTOR + h[have : len(h)][: len(out) - 1], have + 1, power * _FACTOR
    return wordhash.mix(out)


def _found(batch, least_words: int):
    """For each piece of a batch (keys, ids of the documents, places) of its seeds.

    A place is the seed's first word times 4, and its kind: 0 for SEED words, 1 for RUN words, 2 for least_words - STEP words
    (3, of _windows: least_words). Any run of least_words equal words has a minimizer of RUN words in common, and one of the wider seeds round it.
    """
    ids = batch.column("doc_id").to_numpy()
    data, offsets = wordhash.utf8(batch.column("text"))
    window, wide = least_words - RUN + 1, least_words - STEP
    for lo, hi in wordhash.chunks(offsets):
        h, bounds = wordhash.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        of = np.repeat(np.arange(hi - lo), np.diff(bounds))
        key, at, kind = [], [], []

        def take(k, which, places, code):
            key.append(which[places] ^ np.uint64(k))
            at.append(places)
            kind.append(np.full(len(places), code))

        if len(h) >= SEED:
            short = _long(h, SEED)
            take(SEED, short, np.flatnonzero(of[: len(short)] == of[SEED - 1 :]), 0)
        if window > 1 and len(h) >= RUN:
            run = _long(h, RUN)
            least = np.concatenate([np.zeros(0, np.int64), *(minimizers(run[s : e - RUN + 1], window) + s for s, e in zip(bounds, bounds[1:]) if e - s >= RUN)])
            take(RUN, run, least, 1)
            if wide > RUN and len(h) >= wide:
                wider = _long(h, wide)
                begins = np.unique(np.concatenate([least - back for back in range(0, max(1, window - STEP), STEP)]))
                begins = begins[(begins >= 0) & (begins < len(wider))]
                take(wide, wider, begins[of[begins] == of[begins + wide - 1]], 2)
        if key:
            key, at, kind = (np.concatenate(x) for x in (key, at, kind))
            yield key, ids[lo:hi][of[at]], (at - bounds[of[at]]) * 4 + kind


def _held(batches):
    """Packed rows (bucket, body) of places to (doc_id, at)."""
    for b in batches:
        for body in b.column("body").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in unpacked(body, 2)], names=["doc_id", "at"])


def _windows(least_words: int):
    """(doc_id, text, places) to (docs, body): the (key, place) of every run of least_words words that holds one of the runs of RUN words at the places, and
    the (doc_id, number of such runs) that they belong to, one after another; a row for each chunk of texts."""

    def run(batches):
        for b in batches:
            ids = b.column("doc_id").to_numpy()
            data, offsets = wordhash.utf8(b.column("text"))
            count, places = b.column("places").value_lengths().to_numpy(), b.column("places").flatten().to_numpy()
            cuts = np.concatenate([[0], np.cumsum(count)])
            docs, bodies = [], []
            for lo, hi in wordhash.chunks(offsets):
                h, bounds = wordhash.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
                if len(h) < least_words:
                    continue
                n = np.diff(bounds)
                of, which, place = np.repeat(np.arange(hi - lo), n), np.repeat(np.arange(hi - lo), count[lo:hi]), places[cuts[lo] : cuts[hi]]
                held = place <= n[which] - RUN  # others are of another text of a repeated doc_id
                which, place = which[held], place[held]
                key, step = _long(h, least_words), np.zeros(len(h) + 2, np.int64)
                np.add.at(step, bounds[which] + np.maximum(place - (least_words - RUN), 0), 1)
                np.add.at(step, bounds[which] + place + 1, -1)
                at = np.flatnonzero(np.cumsum(step)[: len(key)] > 0)
                at = at[of[at] == of[at + least_words - 1]]
                own = np.bincount(of[at], minlength=hi - lo)
                docs.append(packed([ids[lo:hi], own], 0, hi - lo)), bodies.append(packed([key[at].view(np.int64), at - bounds[of[at]]], 0, len(at)))
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.binary()), pa.array(bodies, pa.binary())], names=["docs", "body"])

    return run


def _found_windows(batch, least_words: int):
    """As _found, of the rows of _windows."""
    for docs, body in zip(batch.column("docs").to_pylist(), batch.column("body").to_pylist(), strict=True):
        key, at = unpacked(body, 2)
        if len(key):
            yield key.view(np.uint64) ^ np.uint64(least_words), np.repeat(*unpacked(docs, 2)), at * 4 + 3


def _pieces(batches, least_words: int, found, least: int = PIECE):
    """What `found` finds in the batches, put together to pieces of `least` seeds or more (but for the last one), however few a document or batch has."""
    held, size = [], 0
    for b in batches:
        for piece in found(b, least_words):
            held.append(piece)
            size += len(piece[0])
            if size >= least:
                yield [np.concatenate(x) for x in zip(*held, strict=True)] if len(held) > 1 else piece
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _frequent(least_words: int, most: int, found=_found):
    """(key, n) of the seeds that make one in 2 * most or more of a piece's, and (null, n) for all of them."""

    def run(batches):
        for key, _, _ in _pieces(batches, least_words, found):
            unique, n = np.unique(key, return_counts=True)
            often = n >= max(2, len(key) / (2 * most))
            keys = pa.array([*unique[often].view(np.int64).tolist(), None], pa.int64())
            yield pa.RecordBatch.from_arrays([keys, pa.array([*n[often].tolist(), len(key)], pa.int64())], names=["key", "n"])

    return run


def _hit(heavy: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Each key's place in the sorted keys `heavy`, or -1."""
    if not len(heavy):
        return np.full(len(key), -1)
    at = np.minimum(np.searchsorted(heavy, key), len(heavy) - 1)
    return np.where(heavy[at] == key, at, -1)


def _heads(least_words: int, heavy: np.ndarray, found=_found):
    """(heavy, doc_id, place): the first place of each heavy seed in each piece."""

    def run(batches):
        for key, doc, at in _pieces(batches, least_words, found):
            which = _hit(heavy, key)
            rows = np.flatnonzero(which >= 0)
            rows = rows[np.lexsort((at[rows], doc[rows], which[rows]))]
            rows = rows[np.diff(which[rows], prepend=-1) != 0]
            yield pa.RecordBatch.from_arrays([pa.array(x[rows], pa.int64()) for x in (which, doc, at)], names=["heavy", "doc_id", "at"])

    return run


def _seeds(least_words: int, buckets: int, heavy: np.ndarray, found=_found):
    """(doc_id, text) to (bucket, body): the (key, doc_id, place) of each seed; heavy ones go to any bucket, their key is -1 less their number.

    Rows hold some ROW seeds or more, so there are as many as a share of the seeds, and not of the documents times the buckets.
    """
    least = max(PIECE, min(ROW * buckets, PIECES))

    def run(batches):
        for key, doc, at in _pieces(batches, least_words, found, least):
            which = _hit(heavy, key)
            spread = wordhash.mix(doc.astype(np.int64).view(np.uint64) * _FACTOR + at.astype(np.int64).view(np.uint64))
            bucket = np.where(which >= 0, spread, key >> np.uint64(40)) % np.uint64(buckets)
            yield _dealt(bucket.astype(np.int64), [np.where(which >= 0, -1 - which, (key & _LOW).astype(np.int64)), doc, at])

    return run


def _first_holders(least_words: int, buckets: int, head_doc: np.ndarray, head_at: np.ndarray, placed: bool = False):
    """Seeds, by bucket, to the (doc_id, src, pos, src_pos) of each seed and the first place of the first document that holds it.

    Longer seeds give the matches of their first and last SEED words, those of least_words of their first alone. With `placed`, bucket `buckets` has the
    (doc_id, place) of the seeds of RUN words that several documents hold, in all of these.
    """
    more = np.array([0, RUN - SEED, least_words - STEP - SEED, 0])

    def places(doc, at):
        run = np.flatnonzero(at & 3 == 1)
        doc, at = doc[run], at[run]
        order = np.lexsort((at, doc))
        doc, at = doc[order], at[order] >> 2
        return _dealt(np.full(len(doc), buckets), [doc, at])

    def matched(found):
        doc, src, at, src_at = (np.concatenate(x) for x in zip(*found, strict=True))
        for lo in range(0, len(doc), 1 << 20):
            d, s, x, y = (v[lo : lo + (1 << 20)] for v in (doc, src, at, src_at))
            ahead = more[x & 3]
            long = ahead > 0
            d, s = np.concatenate([d, d[long]]), np.concatenate([s, s[long]])
            x, y = (np.concatenate([v >> 2, (v[long] >> 2) + ahead[long]]) for v in (x, y))
            mixed = wordhash.mix(d.view(np.uint64) * _FACTOR + s.view(np.uint64))
            order = np.lexsort((x, s, d))
            yield _dealt((mixed[order] % np.uint64(buckets)).astype(np.int64), [v[order] for v in (d, s, x, y)])

    def run(batches):
        held = []
        for found in links(batches):
            if len(found) == 2:
                if placed and len(found[0]):
                    yield places(*found)
                continue
            held.append(found)
            if sum(len(x[0]) for x in held) > 1 << 20:
                yield from matched(held)
                held = []
        if held:
            yield from matched(held)

    def links(batches):
        for key, doc, at in _gathered(batches, 3):
            known = np.flatnonzero(key < 0)
            which = -1 - key[known]
            yield doc[known], at[known]
            away = doc[known] != head_doc[which]
            known, which = known[away], which[away]
            yield doc[known], head_doc[which], at[known], head_at[which]
            light = key >= 0
            key, doc, at = key[light], doc[light], at[light]
            order = np.argsort(key)
            same = key[order[1:]] == key[order[:-1]]
            twice = np.zeros(len(key), bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            key, doc, at = key[twice], doc[twice], at[twice]
            if not len(key):
                continue
            order = np.lexsort((at, doc, key))
            key, doc, at = key[order], doc[order], at[order]
            new = np.diff(key, prepend=-1) != 0
            head = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = np.flatnonzero(doc != doc[head])
            several = np.zeros(len(key), bool)
            several[head[later]] = True
            yield doc[several[head]], at[several[head]]
            head = head[later]
            yield doc[later], doc[head], at[later], at[head]

    return run


def thinned(doc, src, pos, src_pos):
    """The matches sorted by doc, src and place, one in SEED of a run of equal words and its last."""
    order = np.lexsort((pos, pos - src_pos, src, doc))
    doc, src, pos, src_pos = (x[order] for x in (doc, src, pos, src_pos))
    if not len(doc):
        return doc, src, pos, src_pos
    new = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(src) != 0) | (np.diff(pos - src_pos) != 0) | (np.diff(pos) > SEED)])
    block = (pos - pos[np.flatnonzero(new)[np.cumsum(new) - 1]]) // SEED
    keep = new | np.concatenate([[True], np.diff(block) != 0]) | np.concatenate([new[1:], [True]])
    doc, src, pos, src_pos = (x[keep] for x in (doc, src, pos, src_pos))
    order = np.lexsort((src_pos, pos, src, doc))
    return tuple(x[order] for x in (doc, src, pos, src_pos))


class Fenwick:
    """Prefix maxima of (score, index) under point updates."""

    def __init__(self, n: int):
        self.best = [(-np.inf, -1)] * (n + 1)

    def put(self, i: int, value: tuple):
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def below(self, i: int) -> tuple:
        out = (-np.inf, -1)
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


def chain_scores(matches: list[tuple[int, int]]) -> tuple[list[float], list[int]]:
    """For each of the sorted matches the score of the best chain that ends there, and the match before it (-1: none).

    A chain scores SEED for its first match; a further one adds its new words, SEED at most, less GAP_COST for each word from
    match to match on either side. The predecessor is, of the matches before on both sides, the one with the largest score less gaps, for which a
    Fenwick tree over y holds score + GAP_COST * (x + y), or the last one at the same distance of x and y, if that gives more: where
    words repeat, nearer matches at other distances would hide it.
    """
    ys = sorted({y for _, y in matches})
    tree = Fenwick(len(ys))
    score, back = [float(SEED)] * len(matches), [-1] * len(matches)
    waiting: list[int] = []
    beside: dict[int, int] = {}
    at = None
    for i, (x, y) in enumerate(matches):
        if x != at:  # matches at one x must not follow each other
            for j in waiting:
                tree.put(bisect.bisect_left(ys, matches[j][1]), (score[j] + GAP_COST * (matches[j][0] + matches[j][1]), j))
            waiting, at = [], x
        for j in (tree.below(bisect.bisect_left(ys, y))[1], beside.get(x - y, -1)):
            if j >= 0:
                value = score[j] - GAP_COST * (x - matches[j][0] + y - matches[j][1]) + min(SEED, x - matches[j][0], y - matches[j][1])
                if value > score[i]:
                    score[i], back[i] = value, j
        beside[x - y] = i
        waiting.append(i)
    return score, back


def paths(matches: list[tuple[int, int]], least: float = SEED) -> list[list[tuple[int, int]]]:
    """Collinear chains of pairs (x, y) of equal seeds, each a list of its matches in order; each match is in one chain at most.

    Chains are taken from the best end backwards, up to a match that is taken already; what such a rest adds must score `least`.
    """
    matches = sorted(set(matches))
    score, back = chain_scores(matches)
    used, out = [False] * len(matches), []
    for i in sorted(range(len(matches)), key=lambda i: -score[i]):
        path, j = [], i
        while j >= 0 and not used[j]:
            path.append(j)
            used[j] = True
            j = back[j]
        if path and score[i] - (score[j] if j >= 0 else 0.0) >= least:
            out.append([matches[k] for k in reversed(path)])
    return out


def chain(matches: list[tuple[int, int]], least: float = SEED) -> list[tuple[int, int, int, int, int]]:
    """(x start, x end, y start, y end, matches) of the chains of `paths`."""
    return [(p[0][0], p[-1][0] + SEED, p[0][1], p[-1][1] + SEED, len(p)) for p in paths(matches, least)]


def anchors(path: list[tuple[int, int]]) -> bytes:
    """A chain's matches from its first one as int32 pairs, without those that only go on with the run of equal words before them."""
    p = np.array(path, np.int32)
    step = np.diff(p, axis=0)
    new = np.concatenate([[True], (step[:, 0] != step[:, 1]) | (step[:, 0] > SEED)])
    return (p[new] - p[0]).tobytes()


def _chains(batches):
    """Matches (doc_id, src, pos, src_pos), by bucket, to chains."""
    names = ["doc_id", "src", "start", "end", "src_start", "src_end", "anchors"]

    def close(key, matches):
        # what agrees by one short seed alone is chance, as a rule: a passage has several, or a longer one
        found = sorted((p for p in paths(matches) if p[-1][0] - p[0][0] >= SEED), key=lambda p: (p[0][1], p[0][0]))
        out, held = [], None
        for p in found:
            # where words repeat, the same place of the source begins a chain at each of them; the alignment of one passes the next ones
            if held is None or p[0][1] != held[1] or p[0][0] - held[0] >= RUN - SEED:
                out.append((*key, p[0][0], p[-1][0] + SEED, p[0][1], p[-1][1] + SEED, anchors(p)))
                held = p[0]
        return out

    def batch(out):
        *numbers, bodies = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(bodies, pa.binary())], names=names)

    out = []
    for arrays in _gathered(batches, 4):
        doc, src, pos, src_pos = thinned(*arrays)
        cuts = np.concatenate([np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(src) != 0)])), [len(doc)]])
        wide = np.flatnonzero(pos[cuts[1:] - 1] - pos[cuts[:-1]] >= SEED)  # others have no chain that close() keeps
        for lo, hi in zip(cuts[wide].tolist(), cuts[wide + 1].tolist(), strict=True):
            out += close((int(doc[lo]), int(src[lo])), list(zip(pos[lo:hi].tolist(), src_pos[lo:hi].tolist(), strict=True)))
            if len(out) > 10_000:
                yield batch(out)
                out = []
    if out:
        yield batch(out)


def cover(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of runs (start, end, src_start) enough to hold every word that one of them holds."""
    out, end = [], -1
    runs = sorted(runs)
    k = 0
    while k < len(runs):
        if runs[k][0] > end:
            end = runs[k][0]
        widest = None
        while k < len(runs) and runs[k][0] <= end:
            widest = max(widest or runs[k], runs[k], key=lambda r: r[1])
            k += 1
        if widest[1] > end:
            out.append(widest)
            end = widest[1]
    return out


def _whole_runs(least_words: int):
    """Matches (doc_id, src, pos, src_pos) of least_words words, by bucket, to chains: each run of equal words is one, but for those that others of the source cover."""
    names = ["doc_id", "src", "start", "end", "src_start", "src_end", "anchors"]
    one = np.zeros(2, np.int32).tobytes()

    def run(batches):
        for doc, src, pos, src_pos in _gathered(batches, 4):
            order = np.lexsort((pos, pos - src_pos, src, doc))
            doc, src, pos, src_pos = (x[order] for x in (doc, src, pos, src_pos))
            pair = np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(src) != 0)])
            new = np.flatnonzero(pair | np.concatenate([[True], (np.diff(pos - src_pos) != 0) | (np.diff(pos) > 1)]))
            last = np.concatenate([new[1:], [len(pos)]]) - 1
            runs = list(zip(pos[new].tolist(), (pos[last] + least_words).tolist(), src_pos[new].tolist(), strict=True))
            cuts = [*np.flatnonzero(pair[new]), len(new)]
            out = []
            for lo, hi in zip(cuts, cuts[1:]):
                d, s = int(doc[new[lo]]), int(src[new[lo]])
                out += [(d, s, x, end, y, y + end - x, one) for x, end, y in cover(runs[lo:hi])]
            if out:
                *numbers, bodies = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in numbers), pa.array(bodies, pa.binary())], names=names)

    return run


def extend(a: np.ndarray, b: np.ndarray, edge: int = 0) -> list[tuple[int, int, int]]:
    """(place in a, place in b, words) of the runs of equal words of the alignment that starts at both beginnings.

    Runs of equal words are taken whole. At a difference the nearest place where three words (or all
    that is left) agree again, within RESYNC words, is taken; where there is none, the alignment ends before the difference,
    but for equal words at equal distance up to `edge` words on.
    """
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        n = min(len(a) - i, len(b) - j)
        differ = np.flatnonzero(a[i : i + n] != b[j : j + n])
        run = int(differ[0]) if len(differ) else n
        if run:
            out.append((i, j, run))
        i, j = i + run, j + run
        if i == len(a) or j == len(b):
            break
        p, q = a[i : i + RESYNC + 2], b[j : j + RESYNC + 2]
        same = p[:, None] == q[None, :]
        if min(same.shape) < 3:
            out += [(i + int(w), j + int(w), 1) for w in np.flatnonzero(same.diagonal()[:edge])]
            break
        runs = same[:-2, :-2] & same[1:-1, 1:-1] & same[2:, 2:]
        x, y = np.nonzero(runs)
        if not len(x):
            out += [(i + int(w), j + int(w), 1) for w in np.flatnonzero(same.diagonal()[:edge])]
            break
        k = int((x + y).argmin())
        if x[k] == y[k]:
            out += [(i + int(w), j + int(w), 1) for w in np.flatnonzero(same.diagonal()[: x[k]])]
        i, j = i + int(x[k]), j + int(y[k])
    return out


def backward(a: np.ndarray, b: np.ndarray, edge: int = 0) -> list[tuple[int, int, int]]:
    """The runs of the alignment that starts at both ends."""
    return [(len(a) - i - n, len(b) - j - n, n) for i, j, n in reversed(extend(a[::-1], b[::-1], edge))]


def align(a: np.ndarray, b: np.ndarray, places) -> list[tuple[int, int, int]]:
    """The runs of equal words of an alignment through the places (x, y), in order; one that the runs before it reach or pass adds nothing."""
    x, y = places[0]
    out, i, j = backward(a[:x], b[:y], EDGE), int(x), int(y)
    for x, y in places:
        if x < i or y < j:
            continue
        forth = [(i + u, j + v, n) for u, v, n in extend(a[i:x], b[j:y])]
        if forth:
            i, j = forth[-1][0] + forth[-1][2], forth[-1][1] + forth[-1][2]
        back = [(i + u, j + v, n) for u, v, n in backward(a[i:x], b[j:y])]
        u, v = back[0][:2] if back else (x, y)
        near = min(u - i, v - j) if u - i == v - j else min(u - i, v - j, EDGE)
        out += [*forth, *((i + int(w), j + int(w), 1) for w in np.flatnonzero(a[i : i + near] == b[j : j + near])), *back]
        n = min(len(a) - x, len(b) - y)
        differ = np.flatnonzero(a[x : x + n] != b[y : y + n])
        n = int(differ[0]) if len(differ) else n
        out.append((int(x), int(y), n))
        i, j = int(x) + n, int(y) + n
    return out + [(i + u, j + v, n) for u, v, n in extend(a[i:], b[j:], EDGE)]


def _slices(batches):
    """(doc_id, fp, text, spans) to the text's word hashes from MARGIN words before each span to MARGIN after it, with the place of their first."""
    names = ["doc_id", "start", "end", "low", "fp", "body"]

    def batch(out):
        columns = list(zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.binary())], names=names)

    for b in batches:
        out, size = [], 0
        docs, fps, spans = (b.column(c).to_pylist() for c in ("doc_id", "fp", "spans"))
        data, offsets = wordhash.utf8(b.column("text"))
        for lo, hi in wordhash.chunks(offsets):
            all_h, bounds = wordhash.words(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
            all_h = (all_h >> np.uint64(32)).astype(np.uint32)
            for i in range(lo, hi):
                h = all_h[bounds[i - lo] : bounds[i - lo + 1]]
                for s in spans[i]:
                    low = max(0, s["start"] - MARGIN)
                    out.append((docs[i], s["start"], s["end"], low, fps[i], h[low : s["end"] + MARGIN].tobytes()))
                    size += len(out[-1][5])
                    if size > 1 << 21:
                        yield batch(out)
                        out, size = [], 0
        if out:
            yield batch(out)


def _best(runs) -> list[tuple[int, int]]:
    """All maximal scoring stretches (first run, last run + 1): an equal word scores 1, a word of a gap -1."""
    held: list[tuple] = []  # (first, end, score before, score with it)
    total, at = 0, None
    for k, (i, j, n) in enumerate(runs):
        if at is not None:
            total -= max(i - at[0], j - at[1])
        at = (i + n, j + n)
        first, before, total = k, total, total + n
        while held:
            # the last stretch that begins lower; what lies between can't be extended to the left
            m = len(held) - 1
            while m >= 0 and held[m][2] >= before:
                m -= 1
            if m < 0 or held[m][3] >= total:
                break
            first, before = held[m][0], held[m][2]
            del held[m:]
        held.append((first, k + 1, before, total))
    return [h[:2] for h in held]


def passages(runs, least_identity: float, least_words: int) -> list[tuple[int, int, int, int, int]]:
    """(start, end, src start, src end, equal words) of the parts of an alignment that are passages by themselves.

    The widest stretch that passes, without ends where words that differ outweigh equal ones, if it passes without them too; and so on beside it.
    """
    start, of = np.array([r[:2] for r in runs], np.int64).reshape(-1, 2), np.array([r[2] for r in runs], np.int64)
    end, equal = start + of[:, None], np.concatenate([[0], np.cumsum(of)])

    def passing(k, m):
        """Of the stretches from run k to each before m."""
        wide = end[k:m] - start[k]
        return (wide[:, 0] >= least_words) & (equal[k + 1 : m + 1] - equal[k] >= least_identity * wide.max(1) - 1e-9)

    taken, rest = [], [(0, len(runs))] if len(runs) else []
    while rest:
        low, high = rest.pop()
        widest = None
        for k in range(low, high):
            if end[high - 1, 0] - start[k, 0] < max(least_words, widest[0] if widest else 0):
                break
            good = np.flatnonzero(passing(k, high))
            if len(good) and (widest is None or end[k + good[-1], 0] - start[k, 0] > widest[0]):
                widest = (end[k + good[-1], 0] - start[k, 0], k, k + int(good[-1]) + 1)
        if widest:
            _, k, m = widest
            found = [(k + x, k + y) for x, y in _best(runs[k:m]) if passing(k + x, k + y)[-1]] or [(k, m)]
            taken += found
            ends = [low, *(x for t in found for x in t), high]
            rest += [(k, m) for k, m in zip(ends[::2], ends[1::2], strict=True) if m > k]
    return [(int(start[k, 0]), int(end[m - 1, 0]), int(start[k, 1]), int(end[m - 1, 1]), int(equal[m] - equal[k])) for k, m in sorted(taken)]


def _align(least_identity, least_words):
    names = ["doc_id", "fp", "start", "end", "src", "src_start", "src_end", "equal"]

    def run(batches):
        for b in batches:
            out = []
            for doc, fp, start, src, src_start, low_a, body_a, low_b, body_b, places in zip(
                *(b.column(c).to_pylist() for c in ("doc_id", "fp", "start", "src", "src_start", "low_a", "body_a", "low_b", "body_b", "anchors")), strict=True
            ):
                x, y = np.frombuffer(body_a, np.uint32), np.frombuffer(body_b, np.uint32)
                places = np.frombuffer(places, np.int32).reshape(-1, 2) + [start - low_a, src_start - low_b]
                if places[-1, 0] >= len(x) or places[-1, 1] >= len(y):
                    continue  # another text of a repeated doc_id
                for low, high, src_low, src_high, equal in passages(align(x, y, places), least_identity, least_words):
                    out.append((doc, fp, low_a + low, low_a + high, src, low_b + src_low, low_b + src_high, equal))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=names)

    return run


_SPANS = "doc_id long, fp long, start_word long, end_word long, src_doc_id long, identity double"


def _merge(batches):
    """Passages of one document (an array in each row), each held by one source, to those a few words apart as one."""
    for b in batches:
        out = []
        for doc, fp, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "fp", "spans")), strict=True):
            held = None
            for s in [*sorted(spans, key=lambda s: (s["start"], s["end"], s["src"])), None]:
                if s is not None and held is not None and s["start"] <= held[1] + JOIN:
                    if (s["end"] - s["start"], -s["src"]) > held[2]:
                        held[2:] = [(s["end"] - s["start"], -s["src"]), s["equal"] / max(s["end"] - s["start"], 1)]
                    held[1] = max(held[1], s["end"])
                    continue
                if held is not None:
                    out.append((doc, fp, held[0], held[1], -held[2][1], min(1.0, held[3])))
                if s is not None:
                    held = [s["start"], s["end"], (s["end"] - s["start"], -s["src"]), s["equal"] / max(s["end"] - s["start"], 1)]
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = [pa.int64()] * 5 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in _SPANS.split(", ")])


def repeated_passages(documents: DataFrame, least_words: int = 50, least_identity: float = 0.8) -> DataFrame:
    """(doc_id, fp, start_word, end_word, src_doc_id, identity): passages that an earlier document, src_doc_id, holds as well.

    Earlier means a smaller doc_id; the first document of a passage keeps it and isn't listed. Words are runs of bytes other than space and
    \\t..\\r, A-Z in lower case, counted from 0; end_word is exclusive. A passage has `least_words` words or more, of which a share
    of `least_identity` or more agree in order with one earlier document; such passages a few words apart are one, with the source and identity of its longest part.
    Null ids and texts and shorter texts have no passages; a repeat inside one document is none. Rows that repeat a doc_id
    are one document: passages of each of its texts are listed, once; fp is the text's xxhash64. Extra columns are ignored; no documents give no rows.

    Seeds are all runs of SEED words, minimizers of RUN words, and wider runs round these. Each is joined to the first
    document that holds it, so there are no more matches than seeds, however many documents share a passage; both travel packed, by hash. Seeds so
    frequent that they would burden a task are found first; their first holders, a bounded number, are known to every task, and they need
    no common place. Matches are chained with gap costs for each pair of documents, and the word hashes of chains of at least two seeds that don't
    overlap are aligned; only the texts of documents with such a chain are read again.

    The first document that holds a seed need not hold the passage. So all runs of least_words words round a minimizer that several documents
    hold are seeds as well, in a second pass, and are aligned with the first document that holds them whole: every run of least_words words that an
    earlier document holds is found, whatever else holds its parts.
    """
    scratch = Scratch(documents.sparkSession)
    docs = documents.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    # a bucket fits a task's memory; each task has one, or in very large tables some, one after another
    buckets, row = max(partitions(documents.sparkSession), -(-size // TASK_BYTES)), "bucket int, body binary"
    tasks = min(1 << 14, buckets)
    together = lambda df: df.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    most = 4 * buckets

    def matches(table, found, placed=False):
        """The matches of the seeds of `table`."""
        # every seed that makes one in `most` of all is among the counted ones, of which there are 2 * most at most
        counts = scratch.table(table.mapInArrow(_frequent(least_words, most, found), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
        total = counts.where("key is null").agg(F.sum("n")).first()[0] or 0
        heavy = np.array(sorted(np.uint64(r.key % (1 << 64)) for r in counts.where("key is not null").where(F.col("n") >= max(2.0, total / (2 * most))).collect()), np.uint64)
        head_doc, head_at = np.zeros(len(heavy), np.int64), np.zeros(len(heavy), np.int64)
        if len(heavy):
            for r in table.mapInArrow(_heads(least_words, heavy, found), "heavy long, doc_id long, at long").groupBy("heavy").agg(F.min(F.struct("doc_id", "at")).alias("first")).collect():
                head_doc[r.heavy], head_at[r.heavy] = r["first"].doc_id, r["first"].at
        seeds = table.mapInArrow(_seeds(least_words, buckets, heavy, found), row)
        return together(seeds).mapInArrow(_first_holders(least_words, buckets, head_doc, head_at, placed), row)

    chain = "doc_id long, src long, start long, end long, src_start long, src_end long, anchors binary"
    first = scratch.table(matches(docs, _found, True))
    places = first.where(F.col("bucket") == buckets).mapInArrow(_held, "doc_id long, at long").groupBy("doc_id").agg(F.collect_set("at").alias("places"))
    windows = scratch.table(docs.join(places.hint("merge"), "doc_id").mapInArrow(_windows(least_words), "docs binary, body binary"))
    whole = scratch.table(together(matches(windows, _found_windows)).mapInArrow(_whole_runs(least_words), chain))
    chains = scratch.table(
        together(first.where(F.col("bucket") < buckets)).mapInArrow(_chains, chain).unionByName(whole)
        .withColumns({f"{side}from": F.col(f"{side}start") - F.col(f"{side}start") % ROUND for side in ("", "src_")})
        .withColumns({f"{side}to": F.col(f"{side}end") + F.pmod(-F.col(f"{side}end"), F.lit(ROUND)) for side in ("", "src_")})
    )
    wanted = chains.select("doc_id", "from", "to").unionByName(chains.select(F.col("src").alias("doc_id"), F.col("src_from").alias("from"), F.col("src_to").alias("to")))
    # spans that begin near each other read the text once
    wanted = scratch.table(
        wanted.groupBy("doc_id", F.floor(F.col("from") / NEAR)).agg(F.collect_set(F.struct(F.col("from").alias("start"), F.col("to").alias("end"))).alias("spans")).select("doc_id", "spans")
    )
    slices = scratch.table(
        docs.join(wanted.hint("merge"), "doc_id").withColumn("fp", F.xxhash64("text")).mapInArrow(_slices, "doc_id long, start long, end long, low long, fp long, body binary")
    )
    one = slices.select("doc_id", "fp", F.col("start").alias("from"), F.col("end").alias("to"), F.col("low").alias("low_a"), F.col("body").alias("body_a"))
    two = slices.select(F.col("doc_id").alias("src"), F.col("start").alias("src_from"), F.col("end").alias("src_to"), F.col("low").alias("low_b"), F.col("body").alias("body_b"))
    aligned = chains.join(one, ["doc_id", "from", "to"]).join(two, ["src", "src_from", "src_to"]).mapInArrow(
        _align(least_identity, least_words), "doc_id long, fp long, start long, end long, src long, src_start long, src_end long, equal long"
    )
    # one document's passages: bounded by its own length
    spans = aligned.groupBy("doc_id", "fp").agg(F.collect_set(F.struct("start", "end", "src", "equal")).alias("spans"))
    return scratch.finish(spans.mapInArrow(_merge, _SPANS))


def _cut(text: str | None, spans) -> str | None:
    """The text without the words of the spans and the white space after them."""
    data, offsets = wordhash.utf8(pa.array([text], pa.large_string()))
    _, _, starts, _ = wordhash.words(data, offsets, spans=True)
    keep = np.ones(len(data), bool)
    for s in spans:
        low = starts[s["start_word"]]
        keep[low : starts[s["end_word"]] if s["end_word"] < len(starts) else len(data)] = False
    return data[keep].tobytes().decode("utf-8").rstrip(" \t\n\r\v\f")


def cut_passages(documents: DataFrame, **settings) -> DataFrame:
    """The rows of `documents` without the passages that an earlier document holds.

    Cut texts lose the white space at their end, and n_chars, where it is a column, is counted again. A row
    with no word left is dropped; rows without such passages come back unchanged, all their columns too.
    """
    found = repeated_passages(documents, **settings)
    mark = "_spans"
    while any(c.startswith(mark) for c in documents.columns):
        mark = f"_{mark}"
    spans = found.groupBy(F.col("doc_id").alias(f"{mark}_id"), F.col("fp").alias(f"{mark}_fp")).agg(F.collect_list(F.struct("start_word", "end_word")).alias(mark))
    joined = documents.join(spans, (documents["doc_id"] == spans[f"{mark}_id"]) & (F.xxhash64(documents["text"]) == spans[f"{mark}_fp"]), "left")
    joined = joined.select(*[documents[c] for c in documents.columns], mark)

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, s in enumerate(b.column(mark).to_pylist()):
                if s:
                    texts[i] = _cut(texts[i], s)
            at = b.schema.get_field_index("text")
            b = b.set_column(at, b.schema.field(at), pa.array(texts, b.schema.field(at).type))
            yield b.filter(pa.array([not s or bool(t) for s, t in zip(b.column(mark).to_pylist(), texts, strict=True)], pa.bool_()))

    out = joined.mapInArrow(run, joined.schema)
    if "n_chars" in documents.columns:
        again = F.when(F.col(mark).isNotNull(), F.length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", again.cast(documents.schema["n_chars"].dataType))
    return out.select(*documents.columns)
