"""The ten operators against brute force, on small tables with nulls, ties, repeats, long texts and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from scorewright.llm import fingerprint, language, licenses, neardup, packing, passages, pieces, sharding, topk, toxicity, wordhash  # noqa: E402
from scorewright.llm.cluster import Scratch, components, ranked  # noqa: E402

LOWER = str.maketrans({c: chr(ord(c) + 32) for c in map(chr, range(65, 91))})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, key string, node long, rank int"
JSON, RANKS, MODEL = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus():
    rng = random.Random(4)
    out = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one"), (5, "É ÀB 日本 😀"), (6, "\x1c odd sign"), (7, "a b c d"), (8, "a b c e")]
    base = prose(rng, 120).split()
    for i in range(9, 60):
        kind = i % 5
        if kind == 0:
            text = " ".join(base)
        elif kind == 1:
            near = list(base)
            for _ in range(rng.randint(1, 8)):
                near[rng.randrange(len(near))] = f"x{rng.randrange(10**6)}"
            text = " ".join(near)
        elif kind == 2:
            text = prose(rng, rng.randint(1, 200), 10**6) + "\n" + " ".join(base[:70]) + " " + prose(rng, 30, 10**6)
        else:
            text = prose(rng, rng.randint(1, 90), 10**6)
        out.append((i, text))
    out += [(60, prose(rng, 4000, 10**6)), (61, "z" * 50_000), (9, out[9][1]), (9, out[9][1]), (None, "nobody here")]
    return out


def frame(spark, rows, parts=5):
    wide = [(i, t, "en", "s", len(t or ""), 1.5, "k", 7, 3) for i, t in rows]
    return spark.createDataFrame(wide, SCHEMA).repartition(parts)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, corpus())


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_word_hashes_match_words():
    texts = [t for _, t in corpus()]
    seen = {}
    data, offsets = wordhash.utf8(pa.array(texts, pa.string()))
    h, bounds = wordhash.words(data, offsets)
    for i, t in enumerate(texts):
        own = words(t)
        assert bounds[i + 1] - bounds[i] == len(own)
        for w, x in zip(own, h[bounds[i] : bounds[i + 1]].tolist(), strict=True):
            assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    long = wordhash.words(*wordhash.utf8(pa.array(["ab " * 900_000 + "cd"])))[0]  # more than one piece of input
    assert len(long) == 900_001 and len(set(long.tolist())) == 2


def test_shingles_of_few_words():
    for texts in (["one two three"], ["a"], [""], [None], ["a b", "", "c"], ["a b c d e"]):
        sets = list(wordhash.shingle_sets(pa.array(texts, pa.string())))
        assert [len(s) for s in sets] == [int(bool(t)) for t in texts]
    alone, beside = (list(wordhash.shingle_sets(pa.array(x)))[0] for x in (["a b"], ["a b", "c d e f g h"]))
    assert alone.tolist() == beside.tolist()


def test_ranks_and_components(spark):
    scratch = Scratch(spark)
    df = spark.createDataFrame([(i % 3, i) for i in range(100)], "g int, x long")
    out, sizes = ranked(scratch, df, "g", ["x"])
    assert sizes == {0: 34, 1: 33, 2: 33}
    for g in range(3):
        assert [r["rank"] for r in out.where(F.col("g") == g).orderBy("x").collect()] == list(range(sizes[g]))
    edges = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1), (20, 8), *[(i, i + 1) for i in range(100, 140)]], "a long, b long")
    got = {r.id: r.component_id for r in components(scratch, edges).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 20: 8, **{i: 100 for i in range(100, 141)}}
    assert components(scratch, edges.where("false")).count() == 0
    scratch.drop()


# 1: exact top-k


def test_top_k(spark):
    rng = random.Random(2)
    rows = [(i, [rng.choice([-1.0, 0.0, 0.25, 0.5, 1.01]) for _ in range(4)], 1) for i in range(150)]
    rows += [(200, None, 1), (201, [1.0, None, 0.0, 0.0], 1), (202, [float("nan")] * 4, 1), (203, [float("inf")] * 4, 1), (None, [1.0] * 4, 1), (204, [], 1), (205, [1.0], 1)]
    # ids that repeat: equal rows, other vectors, and a vector of many rows
    rows += [(40, rows[40][1], 1), (40, [3.0] * 4, 1), (7, [2.0] * 4, 1), (60, rows[60][1], 1), (60, rows[60][1], 1), *[(300, [1.01] * 4, 1)] * 12]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int").repartition(4)
    real = [(i, [int(np.floor(64 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and i not in (200, 201, 202, 203)]
    want = []
    for at, (q, own) in enumerate(real):
        if q % 20 == 0:
            scored = sorted((-sum(a * b for a, b in zip(own, v, strict=False)), i) for k, (i, v) in enumerate(real) if k != at)
            want.append((q, [(r + 1, i, -s) for r, (s, i) in enumerate(scored[:7])]))
    for tile, fan_in in ((4096, 16), (9, 2)):
        got = topk.exact_top_k(df, df.where("vec_id % 20 = 0"), 7, tile, fan_in).collect()
        assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted((q, *hit) for q, hits in want for hit in hits)
    assert topk.exact_top_k(df.where("false"), df.where("false"), 7).count() == 0
    assert topk.exact_top_k(df.where("vec_id < 2"), df.where("vec_id = 0"), 7).count() == 1
    huge = spark.createDataFrame([(0, [1e30, 1.0]), (1, [1e30, 0.0]), (2, [2.0, 2.0]), (0, [1e30, 1.0])], "vec_id long, embedding array<double>")
    got = topk.exact_top_k(huge, huge.where("vec_id = 0"), 2).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(0, 2**63 - 1)] * 2 + [(1, 2**63 - 1)] * 2


# 2: sharding


def test_sharding(spark, docs, none):
    for df, n in ((docs, len(corpus())), (frame(spark, [(i, "same" if i % 2 else f"t{i // 4}") for i in range(203)]), 203), (frame(spark, [(1, None)]), 1)):
        got = sharding.shard_documents(df).collect()
        assert len(got) == n
        slots = defaultdict(list)
        for r in got:
            slots[r.shard].append(r.slot)
        counts = [len(slots.get(s, ())) for s in range(8)]
        assert max(counts) - min(counts) <= 1
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = sharding.shard_documents(docs).collect()
    texts = {i: t or "" for i, t in corpus()}
    assert all(r.size == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) and r.law == "rows" and r.grown_shard is None for r in got)
    # a group that fits a shard stays whole, whatever the others are like
    for rest in (lambda i: f"own {i}", lambda i: f"pair {i // 2}"):
        whole = sharding.shard_documents(frame(spark, [(i, "copy" if i < 100 else rest(i)) for i in range(1200)])).collect()
        counts = Counter(r.shard for r in whole)
        assert len({r.shard for r in whole if r.doc_id < 100}) == 1 and max(counts.values()) - min(counts.values()) <= 1
        places = defaultdict(set)
        for r in whole:
            places[r.text_crc32].add(r.shard)
        assert sum(len(p) > 1 for p in places.values()) <= 16
    pairs = [(i, f"text {i // 2}") for i in range(400)]
    placed = {r.doc_id: r.shard for r in sharding.shard_documents(frame(spark, pairs)).collect()}
    cut = sum(placed[i] != placed[i + 1] for i in range(0, 400, 2))
    assert cut <= 30  # at random about 175 of 200
    assert sharding.shard_documents(none).count() == 0


# 3: repeated passages


def test_chain_matches_brute_force():
    rng = random.Random(8)

    for _ in range(300):
        matches = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(rng.randint(1, 40))})
        want = []
        for x, y in matches:
            before = [(want[j] + passages.GAP_COST * (a + b), j) for j, (a, b) in enumerate(matches[: len(want)]) if a < x and b < y]
            value = float(passages.SEED)
            same = [j for j, (a, b) in enumerate(matches[: len(want)]) if a - b == x - y]
            for j in [*(j for _, j in [max(before)] if before), *same[-1:]] if before else []:
                gaps = x - matches[j][0] + y - matches[j][1]
                value = max(value, want[j] - passages.GAP_COST * gaps + min(passages.SEED, x - matches[j][0], y - matches[j][1]))
            want.append(value)
        assert passages.chain_scores(matches)[0] == pytest.approx(want)
        found = passages.chain(matches)
        assert found and all(c[0] < c[1] and c[2] < c[3] for c in found) and sum(c[4] for c in found) <= len(matches)
    straight = [(5 * i, 100 + 5 * i) for i in range(10)]
    assert passages.chain(straight) == [(0, 51, 100, 151, 10)]
    assert len(passages.chain([*straight, *((400 + 5 * i, 5 * i) for i in range(10))])) == 2


def test_repeated_passages(spark, docs, none):
    rng = random.Random(6)
    shared, fuzzy = prose(rng, 60, 10**6), prose(rng, 90, 10**6).split()
    changed = list(fuzzy)
    changed[30], changed[60] = "other", "words"
    rows = [(i, f"{prose(rng, 50 + i, 10**6)} {shared} {prose(rng, 40, 10**6)}") for i in range(30)]
    rows += [(100, " ".join(fuzzy)), (101, prose(rng, 20, 10**6) + " " + " ".join(changed)), (102, prose(rng, 300, 10**6)), (103, None), (104, ""), (105, shared[: len(shared) // 2]), (101, rows[0][1])]
    got = defaultdict(list)
    for r in passages.repeated_passages(frame(spark, rows)).collect():
        got[r.doc_id].append(r)
    assert set(got) == {*range(1, 30), 101}
    for i in range(1, 30):
        (r,) = got[i]
        assert r.src_doc_id == 0 and abs(r.start_word - (50 + i)) <= 1 and abs(r.end_word - (110 + i)) <= 1 and r.identity > 0.95
    assert any(r.src_doc_id == 100 and abs(r.start_word - 20) <= 1 and abs(r.end_word - 110) <= 1 and r.identity < 1 for r in got[101])
    cut = {r.doc_id: r for r in passages.cut_passages(frame(spark, rows)).where("doc_id <> 101").collect()}
    assert len(cut) == 35 and cut[0].text == rows[0][1] and cut[103].text is None and cut[104].text == "" and cut[102].text == rows[32][1]
    assert all(shared.split()[20] not in cut[i].text.split() and len(cut[i].text.split()) >= 88 + i and cut[i].n_chars == len(cut[i].text) for i in range(1, 30))
    assert passages.repeated_passages(none).count() == 0 and passages.cut_passages(none).count() == 0
    assert passages.cut_passages(docs).columns == docs.columns


def planted(spark, rows):
    """The passages of `rows`: {doc_id: [(start_word, end_word, src_doc_id)]} in order."""
    got = defaultdict(list)
    for r in passages.repeated_passages(frame(spark, rows)).collect():
        got[r.doc_id].append((r.start_word, r.end_word, r.src_doc_id))
    return {i: sorted(x) for i, x in got.items()}


def own(rng, n):
    return prose(rng, n, 10**9)


def covers(spans, low, high, src):
    return any(s <= low + 1 and e >= high - 1 and of == src for s, e, of in spans)


def test_passages_after_a_wide_gap(spark):
    rng = random.Random(21)
    rows = []
    for k in range(20):
        p, q = own(rng, 60), own(rng, 60)
        rows += [(2 * k, f"{own(rng, 9)} {p} {own(rng, 50)} {q}"), (2 * k + 1, f"{own(rng, 30)} {p} {own(rng, 50)} {q} {own(rng, 5)}")]
    got = planted(spark, rows)
    for k in range(20):
        spans = got[2 * k + 1]
        assert len(spans) == 2 and covers(spans, 30, 90, 2 * k) and covers(spans, 140, 200, 2 * k)


def test_lines_of_many_documents_are_no_passage(spark):
    rng = random.Random(23)
    lines = [own(rng, 12 + i) for i in range(8)]
    rows = [(i, f"{own(rng, 30)} {line} {own(rng, 30)}") for i, line in enumerate(lines)]
    rows.append((50, f"{own(rng, 20)} {' '.join(lines)} {own(rng, 20)}"))
    assert planted(spark, rows) == {}


def test_passages_beside_their_own_words(spark):
    rng = random.Random(22)
    rows = []
    for k in range(20):
        p, q, chance = own(rng, 55), own(rng, 55), own(rng, 3)
        rows += [(4 * k, f"{p} {own(rng, 34)} {q}"), (4 * k + 1, f"{p} {own(rng, 34)} {q}")]
        lone = own(rng, 55)
        rows += [(4 * k + 2, f"{lone} {own(rng, 24)} {chance} {own(rng, 30)}"), (4 * k + 3, f"{lone} {own(rng, 24)} {chance} {own(rng, 30)}")]
    got = planted(spark, rows)
    for k in range(20):
        assert got[4 * k + 1] == [(0, 55, 4 * k), (89, 144, 4 * k)]
        assert got[4 * k + 3] == [(0, 55, 4 * k + 2)]


def test_parts_of_an_alignment_match_brute_force():
    rng = random.Random(26)
    for _ in range(200):
        runs, i, j = [], 0, 0
        for _ in range(rng.randint(1, 14)):
            n = rng.randint(1, 25)
            runs.append((i, j, n))
            i, j = i + n + rng.randint(0, 12), j + n + rng.randint(1, 12)
        wide = lambda k, m: max(runs[m - 1][x] + runs[m - 1][2] - runs[k][x] for x in (0, 1))
        passing = {(k, m) for k in range(len(runs)) for m in range(k + 1, len(runs) + 1)
                   if runs[m - 1][0] + runs[m - 1][2] - runs[k][0] >= 50 and sum(r[2] for r in runs[k:m]) >= 0.8 * wide(k, m) - 1e-9}
        found = passages.passages(runs, 0.8, 50)
        starts, ends = {r[0]: k for k, r in enumerate(runs)}, {r[0] + r[2]: k + 1 for k, r in enumerate(runs)}
        got = [(starts[f[0]], ends[f[1]]) for f in found]
        assert set(got) <= passing and all(x[1] <= y[0] for x, y in zip(got, got[1:]))
        # no passage lies beside the ones found
        assert all(any(k < y and x < m for x, y in got) for k, m in passing)


def test_passages_with_spread_edits(spark):
    rng = random.Random(24)
    rows, at = [], 0
    for every in (12, 10, 8):
        for _ in range(40):
            p = own(rng, 60).split()
            q = list(p)
            for i in range(rng.randrange(every), 60, every):
                q[i] = own(rng, 1)
            rows += [(at, f"{own(rng, 40)} {' '.join(p)} {own(rng, 40)}"), (at + 1, f"{own(rng, 40)} {' '.join(q)} {own(rng, 40)}")]
            at += 2
    got = planted(spark, rows)
    found = sum(any(e - s >= 50 and of == i - 1 for s, e, of in got.get(i, [])) for i in range(1, at, 2))
    assert found == at // 2


def test_passages_of_frequent_phrases(spark):
    """Every run of six to 19 words of a passage is also in some earlier document that holds no more of it."""
    rng = random.Random(25)
    rows, pairs = [], []
    for k in range(6):
        p = own(rng, 60).split()
        rows += [(100 * k + i, f"{own(rng, 30)} {' '.join(p[i : i + 19])} {own(rng, 30)}") for i in range(42)]
        rows += [(100 * k + 80, f"{own(rng, 20)} {' '.join(p)} {own(rng, 20)}"), (100 * k + 81, f"{own(rng, 10)} {' '.join(p)} {own(rng, 20)}")]
        pairs.append((100 * k + 80, 100 * k + 81))
    got = planted(spark, rows)
    assert set(got) == {c for _, c in pairs}
    assert all(got[c] == [(10, 70, b)] for b, c in pairs)


def test_exact_runs_match_brute_force(spark):
    """200 documents of frequent lines, shared passages and own words: every run of 50 words of an earlier document is listed, and little else."""
    rng = random.Random(41)
    own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    lines, shared = [own(12) for _ in range(30)], [own(rng.randint(50, 90)) for _ in range(15)]
    shared += [lines[0] + own(20) + lines[1] + own(20), ["again"] * 70, own(3) * 25]
    texts = []
    for i in range(200):
        parts = [own(rng.randint(0, 40))]
        for _ in range(rng.randint(1, 6)):
            parts += [rng.choice([lines[rng.randrange(30)], shared[rng.randrange(len(shared))], own(rng.randint(5, 60))]), own(rng.randint(0, 9))]
        texts.append([w for p in parts for w in p])
    texts += [list(texts[17]), texts[18][5:], [*texts[19][:40], "x", *texts[19][40:]]]
    got = defaultdict(set)
    for r in passages.repeated_passages(frame(spark, [(i, " ".join(t)) for i, t in enumerate(texts)], 7)).collect():
        assert r.src_doc_id < r.doc_id and r.end_word - r.start_word >= 50 and 0.8 <= r.identity <= 1
        got[r.doc_id] |= set(range(r.start_word, r.end_word))
    seen: dict = {}
    want, near = defaultdict(set), defaultdict(set)
    for k, held in ((50, want), (6, near)):
        seen = {}
        for i, t in enumerate(texts):
            for a in range(len(t) - k + 1):
                if seen.setdefault(tuple(t[a : a + k]), i) < i:
                    held[i] |= set(range(a, a + k))
    assert sum(map(len, want.values())) > 8000
    assert all(want[i] <= got[i] for i in range(len(texts)))
    assert all(len(got[i] & near[i]) >= 0.75 * len(got[i]) for i in got)


def test_whole_passages_behind_documents_of_their_parts(spark):
    """Every run of up to 49 words of a passage is also in some earlier document that doesn't hold the passage."""
    rng = random.Random(43)
    rows, pairs = [], []
    for k in range(4):
        p = own(rng, 51).split()
        rows += [(100 * k + i, f"{own(rng, 30)} {' '.join(p[i : i + 49])} {own(rng, 30)}") for i in range(3)]
        rows += [(100 * k + 80, f"{own(rng, 20)} {' '.join(p)} {own(rng, 20)}"), (100 * k + 81, f"{own(rng, 10)} {' '.join(p)} {own(rng, 20)}")]
        pairs.append((100 * k + 80, 100 * k + 81))
    got = planted(spark, rows)
    assert set(got) == {c for _, c in pairs}
    assert all(got[c] == [(10, 61, b)] for b, c in pairs)


def test_covering_runs_match_brute_force():
    rng = random.Random(44)
    words_of = lambda runs: {w for s, e, _ in runs for w in range(s, e)}
    for _ in range(300):
        runs = [(s, s + rng.randint(5, 20), i) for i, s in enumerate(rng.randrange(120) for _ in range(rng.randint(0, 25)))]
        found = passages.cover(runs)
        assert words_of(found) == words_of(runs) and set(found) <= set(runs) and sum(e - s for s, e, _ in found) <= 2 * len(words_of(runs))


def test_heavy_seeds_give_the_same_matches():
    rng = random.Random(42)
    line, passage = [f"l{i}" for i in range(15)], [f"p{i}" for i in range(70)]
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(20)), *(passage if i % 3 else []), *line]) for i in range(60)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(60), pa.int64()), pa.array(texts)], names=["doc_id", "text"])

    def matches(heavy):
        first = {}
        for b in passages._heads(50, heavy)(iter([batch])):
            for k, d, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                first[k] = min(first.get(k, (1 << 60, 0)), (d, at))
        doc, at = (np.array([first[k][x] for k in range(len(heavy))], np.int64) for x in (0, 1))
        rows = [r for b in passages._seeds(50, 3, heavy)(iter([batch])) for r in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True)]
        rows.sort(key=lambda r: r[0])
        seeds = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "body"])
        found = set()
        for b in passages._first_holders(50, 3, doc, at)(iter([seeds])):
            for arrays in passages._gathered([b], 4):
                found |= set(zip(*(x.tolist() for x in arrays), strict=True))
        return found, rows

    plain, rows = matches(np.zeros(0, np.uint64))
    keys, n = np.unique(np.concatenate([k for k, _, _ in passages._found(batch, 50)]), return_counts=True)
    spread, dealt = matches(np.sort(keys[n > 20]))
    assert plain == spread and len(plain) > 1000 and (n > 20).sum() > 20
    sizes = [sum(len(r[1]) for r in x if r[0] == k) for x in (rows, dealt) for k in range(3)]
    assert max(sizes[3:]) < 1.5 * min(sizes[3:])


def windows_of(texts, least_words=50):
    """The rows of _windows for texts that all have a place at every word."""
    places = [list(range(max(0, len(t.split()) - passages.RUN + 1))) for t in texts]
    arrays = [pa.array(range(len(texts)), pa.int64()), pa.array(texts), pa.array(places, pa.list_(pa.int64()))]
    return list(passages._windows(least_words)(iter([pa.RecordBatch.from_arrays(arrays, names=["doc_id", "text", "places"])])))


def test_windows_match_brute_force():
    rng = random.Random(45)
    shared = [f"p{i}" for i in range(55)]
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 60))), *(shared if i % 2 else [])]) for i in range(40)] + ["", "few words"]
    got, where = defaultdict(set), set()
    for b in windows_of(texts):
        for key, doc, at in passages._found_windows(b, 50):
            for k, d, x in zip(key.tolist(), doc.tolist(), at.tolist(), strict=True):
                assert x % 4 == 3 and (d, x // 4) not in where
                where.add((d, x // 4))
                got[k].add(tuple(texts[d].split()[x // 4 : x // 4 + 50]))
    split = [t.split() for t in texts]
    assert where == {(d, x) for d, t in enumerate(split) for x in range(len(t) - 49)}
    assert all(len(x) == 1 for x in got.values()) and len(got) == len({w for x in got.values() for w in x})


def test_rows_of_seeds_dont_grow_with_documents_times_buckets():
    rng = random.Random(46)
    shared = [f"p{i}" for i in range(60)]
    texts = [" ".join([*(f"w{rng.randrange(10**6)}" for _ in range(40)), *shared, *(f"w{rng.randrange(10**6)}" for _ in range(40))]) for _ in range(400)]
    batches = windows_of(texts)
    none = np.zeros(0, np.uint64)
    dealt = [b for k in (64, 128) for b in passages._seeds(50, k, none, passages._found_windows)(iter(batches))]
    rows = [(k, body) for b in dealt for k, body in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True)]
    # documents of one task go to a bucket together: 192 rows, not some 50 for each document
    assert len(rows) <= 64 + 128 and sum(len(passages.unpacked(body, 3)[0]) for _, body in rows) == 2 * 400 * 91
    # so a window that each document holds once is seen to be frequent
    counts = Counter()
    for b in passages._frequent(50, 256, passages._found_windows)(iter(batches)):
        for k, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True):
            counts[k] += n
    assert counts.pop(None) == 400 * 91 and len(counts) == 11 and set(counts.values()) == {400}


def test_places_of_a_bucket_are_one_row():
    texts = [" ".join(f"p{i}" for i in range(200))] * 20
    batch = pa.RecordBatch.from_arrays([pa.array(range(20), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (seeds,) = passages._seeds(50, 1, np.zeros(0, np.uint64))(iter([batch]))
    at = np.zeros(0, np.int64)
    rows = [(k, body) for b in passages._first_holders(50, 40, at, at, True)(iter([seeds])) for k, body in zip(b.column("bucket").to_pylist(), b.column("body").to_pylist(), strict=True)]
    (held,) = [body for k, body in rows if k >= 40]
    doc, place = passages.unpacked(held, 2)
    assert sorted(set(doc.tolist())) == list(range(20)) and len(doc) == 20 * len(set(place.tolist())) > 100


def test_chance_matches_need_no_chain(monkeypatch):
    """Pairs of documents whose matches are less than a seed's words apart have no chain, and aren't looked at one by one."""
    rng = random.Random(47)
    matches = [(d, s, x + k, y + k) for d in range(100, 400) for s, x, y in [(rng.randrange(100), rng.randrange(500), rng.randrange(500))] for k in range(rng.randint(1, passages.SEED))]
    matches += [(d, 7, x, x + 20) for d in range(400, 410) for x in range(30, 30 + passages.SEED + d % 3)]
    arrays = [np.array(x, np.int64) for x in zip(*matches, strict=True)]
    seen, paths = [], passages.paths
    monkeypatch.setattr(passages, "paths", lambda m, *more: seen.append(m) or paths(m, *more))
    found = [r for b in passages._chains(iter([passages._dealt(np.zeros(len(arrays[0]), np.int64), arrays)])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert {r[:2] for r in found} == {(d, 7) for d in range(400, 410) if d % 3} and all(r[2] == 30 and r[4] == 50 for r in found)
    assert len(seen) == len(found)


def test_slices_match_words_of_single_texts():
    rng = random.Random(48)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(0, 400))) for _ in range(30)]
    spans = [[{"start": 64 * k, "end": 64 * k + 128} for k in range(rng.randint(0, 4))] for _ in texts]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    arrays = [pa.array(range(30), pa.int64()), pa.array(range(50, 80), pa.int64()), pa.array(texts), pa.array(spans, kind)]
    got = [r for b in passages._slices(iter([pa.RecordBatch.from_arrays(arrays, names=["doc_id", "fp", "text", "spans"])])) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    want = []
    for i, (text, of) in enumerate(zip(texts, spans, strict=True)):
        h = (wordhash.words(*wordhash.utf8(pa.array([text])))[0] >> np.uint64(32)).astype(np.uint32)
        want += [(i, s["start"], s["end"], max(0, s["start"] - 64), 50 + i, h[max(0, s["start"] - 64) : s["end"] + 64].tobytes()) for s in of]
    assert got == want and len(want) > 30


# 4: fingerprints


def test_fingerprints(spark, docs, none):
    ordered = sorted(corpus(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    got = fingerprint.fingerprint_edits(docs).collect()
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    prints = {}
    for at, (i, t) in enumerate(ordered):
        t, follow = t or "", ordered[(at + 1) % len(ordered)][1] or ""
        m = len(t) // 4
        edited = t[: len(t) - m] + follow[:m]
        sha = hashlib.sha256(edited.encode()).hexdigest()
        row = next(r for r in by[i] if r.edited_sha256 == sha)
        assert row.n_chars == len(t) and prints.setdefault(t, row.fingerprint) == row.fingerprint
        assert prints.setdefault(edited, row.edited_fingerprint) == row.edited_fingerprint
        assert 0 <= row.near_edited <= 1 and 0 <= row.near_next <= 1
        if len(words(t)) > 60:
            assert row.near_edited > 0.3
    assert len(got) == len(ordered)
    lone = fingerprint.fingerprint_edits(frame(spark, [(5, "a b c d e f g h")])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert fingerprint.fingerprint_edits(none).count() == 0


def test_signatures_estimate_and_pairs(spark, docs):
    rng = random.Random(3)
    a = prose(rng, 400).split()
    b = a[:300] + prose(rng, 100).split()
    sig = fingerprint.signatures(pa.array([" ".join(a), " ".join(b)]), 256)
    grams = [{tuple((["^"] * 4 + w)[i : i + 5]) for i in range(len(w))} for w in (a, b)]
    assert abs((sig[0] == sig[1]).mean() - len(grams[0] & grams[1]) / len(grams[0] | grams[1])) < 0.12
    pairs = fingerprint.near_pairs(docs).collect()
    assert pairs and all(r.jaccard >= 0.75 and r.a != r.b for r in pairs)


def test_near_pairs_match_brute_force(spark):
    rng = random.Random(27)
    rows = [r for r in corpus() if r[0] is not None]
    # two near copies in the bands of a frequent third text; long texts that differ in a word; equal ones
    lead = prose(rng, 200, 10**6).split()
    near = lead[:160] + prose(rng, 40, 10**6).split()
    rows += [(100, " ".join(lead)), (101, " ".join(near)), (102, " ".join([*near[:-1], "end"])), (103, " ".join(near))]
    wide = prose(rng, 1500, 10**6).split()
    rows += [(110 + i, " ".join([*wide[:-1], f"end{i}"])) for i in range(6)]
    texts, parent = defaultdict(list), {}
    for i, t in rows:
        texts[i].append(t)
        parent[i] = i

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def jaccard(x, y):
        x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (words(x), words(y)))
        return len(x & y) / len(x | y)

    for r in fingerprint.near_pairs(frame(spark, rows)).collect():
        assert r.a < r.b and r.jaccard >= 0.75 and any(abs(jaccard(x, y) - r.jaccard) < 1e-9 for x in texts[r.a] for y in texts[r.b] if words(x) and words(y))
        x, y = sorted((find(r.a), find(r.b)))
        parent[y] = x
    full = fingerprint.fingerprint_documents(frame(spark, [*rows, (None, "a b c")])).collect()
    assert Counter((r.doc_id, r.group_id) for r in full) == Counter([*((i, find(i)) for i, _ in rows), (None, None)])
    assert fingerprint.near_groups(frame(spark, rows).where("false")).count() == 0
    assert Counter(find(i) for i, _ in rows) == Counter({c: n for c, n in Counter(c for (_, _, c), m in brute_components(rows).items() for _ in range(m)).items()})
    assert {i: find(i) for i in parent} == {i: c for i, _, c in brute_components(rows)}


def test_fingerprints_broadcast_no_growing_table(spark, docs):
    """Sized by its file, the table of the bands' members looks small to Spark at any size that a driver can't hold."""
    store = spark._jsparkSession.sharedState().statusStore()
    before, limit = store.executionsCount(), "spark.sql.autoBroadcastJoinThreshold"
    held = spark.conf.get(limit)
    spark.conf.set(limit, "10m")
    try:
        assert fingerprint.fingerprint_documents(docs).count() == docs.count()
        assert spark.conf.get(limit) == "10m"
    finally:
        spark.conf.set(limit, held)
    ran = store.executionsList()
    plans = [ran.apply(i).physicalPlanDescription() for i in range(before, ran.size())]
    assert sum("SortMergeJoin" in p for p in plans) > 10 and not any("BroadcastHashJoin" in p for p in plans)


# 5: near-duplicates


def brute_components(rows):
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is None or rows[j][0] is None or not sets[i] or not sets[j]:
                continue
            if rows[i][0] == rows[j][0] and rows[i][1] == rows[j][1] or 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        groups[find(i)].append(d)
    return Counter((d, len(sets[i]), min(x for x in groups[find(i)]) if d is not None else None) for i, (d, _) in enumerate(rows))


def test_near_duplicates(spark, docs, none, monkeypatch):
    rng = random.Random(5)
    base = prose(rng, 60).split()
    rows = list(corpus())
    for i in range(100, 260):  # one group of near copies, some of them linked only by way of others
        near = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            near[rng.randrange(len(near))] = f"y{rng.randrange(50)}"
        rows.append((i, " ".join(near)))
    want = brute_components(rows)
    for block in (512, 8):
        monkeypatch.setattr(neardup, "BLOCK", block)
        got = neardup.near_duplicates(frame(spark, rows)).collect()
        assert Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
        assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_one(docs).collect()
    assert Counter(r.doc_id for r in kept) == Counter({d: 1 for d, _, c in brute_components(corpus()) if d == c})
    assert kept[0].asDict().keys() == set(docs.columns)
    assert neardup.near_duplicates(none).count() == 0


def test_sketches():
    rng = np.random.default_rng(1)
    items = rng.integers(0, 1 << 63, 3000, dtype=np.uint64)
    x, y = items[:2500], items[500:]
    a, b = neardup.registers(x), neardup.registers(y)
    assert (neardup.merge(a, b) == neardup.registers(items)).all()
    got = neardup.likely_similarity(np.array([(a > b).sum()]), np.array([(a < b).sum()]), np.array([2500.0]), np.array([2500.0]))[0]
    assert abs(got - 2000 / 3000) < 0.12


# 6: pieces


def odd_texts(n):
    rng = random.Random(9)
    parts = ["the ", "ing", "\n", "é", "日", "日本語", "😀", "<s>", "  ", "a", "tion", "0", "\t", "ー", "▁", "can't ", "(x)", "http://", "\u0378", ".\n", "ß", " of", "Zq"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_pieces(spark, docs, none):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = {i: t or "" for i, t in corpus()} | {1000 + i: t for i, t in enumerate(odd_texts(3000))} | {5000: "ab" * 300_000, 5001: "日本" * 3000 + "x" * 90, 5002: "the cat. " * 300_000}
    df = frame(spark, [*texts.items(), (1001, texts[1001]), (7000, None)])
    want = {i: own.encode(t) for i, t in texts.items()}
    # all words known to every task; most of them joined to their blocks; all joined, and none but short ones in the lattice
    for most, wide in ((pieces.KNOWN_WORDS, pieces.WIDE), (30, pieces.WIDE), (0, 9)):
        got = {r.doc_id: r.ids for r in pieces.encode_documents(df, MODEL, most, wide).collect()}
        assert got.pop(7000) == [] and got == want
    got = {r.doc_id: r for r in pieces.round_trips(df, MODEL).collect()}
    for i, t in texts.items():
        assert got[i].n_pieces == len(want[i]) and got[i].ids_crc32 == zlib.crc32(np.array(want[i], "<i4").tobytes())
        assert got[i].round_trip == ("▁" not in t)
    assert pieces.round_trips(df, MODEL).count() == len(texts) + 2
    assert pieces.round_trips(none, MODEL).count() == 0 and pieces.encode_documents(none, MODEL).count() == 0
    decoded = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(docs, MODEL), MODEL).collect()}
    assert decoded == {i: t or "" for i, t in corpus()}


def test_relational_lattice(spark):
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    table = pieces.piece_table(MODEL)
    rng = random.Random(3)
    sample = list({" " + "".join(rng.choice(["th", "e", "ing", "ion", "a", "x", "é", "日", "\u0378", "😀"]) for _ in range(rng.randint(1, 9))) for _ in range(400)} | {"   ", " q", " \u0378", " " + "a" * 60})
    got = {r.word: r.ids for r in pieces.relational_lattice(spark.createDataFrame([(w, 1) for w in sample], "word string, n long"), MODEL).collect()}
    assert got == {w: own.encode(w[1:].replace(" ", "▁")) for w in sample} == {w: table.encode_word(w) for w in sample}


def test_words_of_pieces_are_the_text():
    table = pieces.piece_table(MODEL)
    texts = [None, "", "a", *odd_texts(200)]
    data, starts, offsets = table.words(pa.array(texts))
    for i, t in enumerate(texts):
        assert data[offsets[i] : offsets[i + 1]].tobytes().decode() == (" " + t.replace("▁", " ") if t else "")
        inside = starts[(starts >= offsets[i]) & (starts < offsets[i + 1])]
        assert not t or inside[0] == offsets[i]


# 7: toxicity


def test_toxicity(spark, docs, none):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        toxic = i % 4 == 0
        mild = rng.choice(["GROUP", "insult", ""])  # either word alone is no sign
        rows.append((i, prose(rng, 40) + (" insult group. " if toxic else f" {mild} ") + prose(rng, 40)))
        labels.append((i, 1, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (6, 0, 0)]
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    df = frame(spark, [*rows, (None, "insult group"), (601, None), (602, "")])
    got = {r.doc_id: r for r in toxicity.score_toxicity(df, known).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(600)) and got[None].held_out is False
    right = sum(got[i].predicted == (i % 4 == 0) for i in held)
    assert right >= 0.95 * len(held)  # additive weights alone leave the pairs at about 0.83
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    assert got[601].score == got[602].score
    kept = toxicity.drop_toxic(df, known)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if not r.predicted}
    unlabelled = toxicity.score_toxicity(docs, known.where("false")).collect()
    assert len(unlabelled) == len(corpus()) and all(r.score == 0.0 for r in unlabelled)
    assert toxicity.score_toxicity(none, known).count() == 0


def test_margins_match_brute_force():
    rng = np.random.default_rng(3)
    machine = toxicity.FactorizationMachine(12, seed=5)
    machine.bias, machine.weight, machine.factor = 0.3, rng.normal(size=12), rng.normal(size=(12, 4))
    sets = [sorted(rng.choice(12, rng.integers(0, 9), replace=False).tolist()) for _ in range(30)]
    docs = np.repeat(np.arange(30), [len(s) for s in sets])
    got = machine.margins(docs, np.array([f for s in sets for f in s], int), 30)
    for s, m in zip(sets, got, strict=True):
        pairs = sum(machine.factor[i] @ machine.factor[j] for a, i in enumerate(s) for j in s[a + 1 :])
        assert m == pytest.approx(0.3 + sum(machine.weight[i] for i in s) + pairs)


# 8: packing


def test_packing(spark, docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(JSON)
    rows = [*corpus(), (70, "before <|endoftext|> after"), (71, "word " * 5000)]
    got = packing.pack_documents(frame(spark, rows), JSON, RANKS).collect()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in rows}
    taken, places = defaultdict(int), defaultdict(list)
    for r in got:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.ids_crc32 == zlib.crc32(part.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        taken[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert taken == {i: len(x) * sum(d == i for d, _ in rows) for i, x in ids.items()}
    assert sorted(places) == list(range(len(places)))
    for spots in places.values():
        at = 0
        for offset, length in sorted(spots):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack_documents(none, JSON, RANKS).count() == 0


def test_histogram_packing():
    rng = random.Random(1)
    counts = Counter(rng.randint(1, 2048) for _ in range(5000)) + Counter({7: 3000, 2048: 50})
    packs = packing.pack_histogram(counts, 2048)
    placed = Counter()
    for n, lengths in packs:
        assert sum(lengths) <= 2048
        for length in lengths:
            placed[length] += n
    assert placed == counts
    total = sum(k * n for k, n in counts.items())
    assert total / (2048 * sum(n for n, _ in packs)) > 0.97
    assert packing.pack_histogram({}, 2048) == []


# 9: licences


def test_licenses(spark, docs, none):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    rng = random.Random(2)
    rows = [
        (0, prose(rng, 40) + "\nreleased UNDER the mit licence -- License.\n" + prose(rng, 40)), (1, "Released under the MIT License."), (2, mit.replace(",", " ;").upper()),
        (3, "This work is licensed under the GNU General Public License, version 3. Also: Licensed under CC BY-NC 4.0."), (4, prose(rng, 500)), (5, None), (6, ""),
        (7, prose(rng, 30) + " " + mit.replace("modify, merge", "change, join") + " " + prose(rng, 30)), (8, "under the license the mit released"),
        (9, " ".join(["Released under the MIT License. own words here"] * 3 + [mit, "Licensed under CC BY 4.0.", mit])), (10, "of the " * 20_000 + "Licensed under CC BY 4.0." + " of the" * 20_000),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(frame(spark, rows)).collect()}
    assert {i: r.license for i, r in got.items()} == {0: "MIT", 1: "MIT", 2: "MIT", 3: "GPL-3.0", 4: None, 5: None, 6: None, 7: "MIT", 8: None, 9: "MIT", 10: "CC-BY-4.0"}
    assert got[3].n_licenses == 2 and got[1].dice == 1.0 and (got[1].start_word, got[1].end_word) == (0, 5) and got[4].dice == 0.0
    assert 0.9 < got[7].dice < 1 and got[7].start_word == 30
    assert (got[9].n_licenses, got[9].n_notices) == (2, 6) and (got[3].n_notices, got[0].n_notices, got[10].n_notices) == (2, 1, 1)
    plain = lambda t: re.findall(r"[a-z0-9]+", t.lower())
    grams = lambda w: Counter(tuple(w[i : i + 2]) for i in range(len(w) - 1))
    for i in (0, 3, 7, 9):  # brute force over every run of words, bigrams counted as often as they are there
        own, best = plain(rows[i][1]), 0
        for _, t in licenses.TEMPLATES:
            want = grams(plain(t))
            size = want.total()
            for a in range(len(own) - 1):
                held, both = Counter(), 0
                for b in range(a, min(len(own) - 1, a + 2 * size)):
                    g = (own[b], own[b + 1])
                    held[g] += 1
                    both += held[g] <= want[g]
                    best = max(best, 2 * both / (size + b - a + 1))
        assert got[i].dice == pytest.approx(best)
    assert licenses.scan_licenses(docs).count() == len(corpus()) and licenses.scan_licenses(none).count() == 0


# 10: languages


def test_languages(spark, none):
    rng = random.Random(10)
    alphabets = {"aa": ["ka", "lo", "mi", "tu"], "bb": ["éß", "ün", "rö", "st"], "cc": ["日", "本", "語", "字"]}
    speak = lambda k, n: " ".join("".join(rng.choices(alphabets[k], k=rng.randint(2, 4))) for _ in range(n))
    rows = []
    for i in range(300):
        k = "aa bb cc".split()[i % 3]
        text = speak(k, 30) if i % 10 else speak(k, 40) + " " + speak("aa", 10)
        rows.append((i, text, k))
    rows += [(1000, None, "aa"), (1001, "12 34 !!", "bb"), (1002, "", None), (1003, speak("bb", 9), None), (None, speak("cc", 9), "cc")]
    df = spark.createDataFrame([(*r, "x", 0.5, "h", True) for r in rows], "doc_id long, text string, lang string, source string, score double, name string, letters boolean").repartition(3)
    got = {r.doc_id: r for r in language.identify_language(df).collect()}
    assert len(got) == len(rows)
    assert all(got[i].lang_pred == k for i, _, k in rows[:300])
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(300))
    assert all(got[i].lang_pred == "und" and got[i].score == 0.0 for i in (1000, 1001, 1002)) and got[1003].lang_pred == "bb" and got[None].lang_pred == "cc"
    assert all(0 <= r.score <= 1 for r in got.values()) and got[1].score > 0.9
    kept = language.keep_languages(df)
    assert kept.columns == df.columns and kept.count() == 302
    assert language.identify_language(none).count() == 0
    assert {r.lang_pred for r in language.identify_language(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_shares():
    rng = np.random.default_rng(0)
    table = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))
    codes = np.concatenate([rng.choice(2, 700, p=[0.9, 0.1]), rng.choice(2, 300, p=[0.1, 0.9])])
    best, share = language.mixtures(codes, np.array([0, 1000]), table, rounds=200, close=1e-6)
    assert best[0] == 0 and abs(share[0] - 0.7) < 0.06
    assert language.mixtures(codes[:0], np.array([0, 0]), table)[0][0] == -1


def test_mixtures_match_brute_force():
    """Each document by itself, gram by gram, with the sets of the best languages in the order of the full mixture."""
    rng = np.random.default_rng(4)
    table = np.log(rng.dirichlet([0.4] * 30, 5).T)

    def fitted(codes, langs):
        share = np.full(len(langs), 1 / len(langs))
        for _ in range(60):
            part = np.exp(table[codes][:, langs]) * share
            before, share = share, (part / part.sum(1, keepdims=True)).mean(0)
            if np.abs(share - before).max() <= 1e-9:
                break
        return share, np.log((np.exp(table[codes][:, langs]) * share).sum(1)).sum()

    docs = []
    for k in (1, 2, 3, 4, 5, 5, 1, 2):
        own = rng.choice(5, k, replace=False)
        docs.append(np.concatenate([rng.choice(30, 400 // k, p=np.exp(table[:, i])) for i in own]))
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    best, share = language.mixtures(np.concatenate(docs), bounds, table, rounds=60, close=1e-9)
    sizes = []
    for d, b, s in zip(docs, best, share, strict=True):
        order = np.argsort(-fitted(d, [0, 1, 2, 3, 4])[0], kind="stable")
        first = max(range(5), key=lambda i: table[d][:, i].sum())
        held = (table[d][:, first].sum(), first, 1.0, 1)
        for k in range(2, 6):
            shares, value = fitted(d, order[:k].tolist())
            value -= 3.0 * (k - 1) * np.log(len(d) + 1)
            if value <= held[0]:
                break
            # among equal places the languages stand in the order of the table
            held = (value, order[:k][shares.argmax()], shares.max(), k)
        assert b == held[1] and abs(s - held[2]) < 1e-6
        sizes.append(held[3])
    assert {1, 2, 3} <= set(sizes)


# texts of more than a chunk, and clashing columns


def test_very_long_texts(spark):
    """Texts of over 2 MiB give what brute force gives for the same words."""
    rng = random.Random(31)
    pool = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    long = " ".join(rng.choices(pool, k=420_000))
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(80))
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 500)
    rows = [(1, long), (2, f"{long} tail"), (3, passage), (4, f"{long[: len(long) // 2]} {mit} {passage} {' '.join(reversed(pool))} end"), (5, "short one here")]
    assert len(long) > wordhash.CHUNK_BYTES
    df = frame(spark, rows)
    near = {r.doc_id: r for r in neardup.near_duplicates(df).collect()}
    assert {i: (r.n_shingles, r.component_id) for i, r in near.items()} == {d: (n, c) for d, n, c in brute_components(rows)}
    assert {r.doc_id: r.group_id for r in fingerprint.fingerprint_documents(df).collect()} == {i: r.component_id for i, r in near.items()}
    found = passages.repeated_passages(df.where("doc_id > 1 and doc_id <> 4 or doc_id = 4")).collect()
    at = len(words(rows[3][1].split(passage)[0]))
    assert any(r.doc_id == 4 and r.src_doc_id == 3 and r.start_word <= at and r.end_word >= at + 80 for r in found)
    got = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    assert got[4].license == "MIT" and got[1].license is None
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 6)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(df, labels).count() == 5
    names = {r.doc_id: r.lang_pred for r in language.identify_language(df).collect()}
    assert set(names.values()) == {"en"}


def test_columns_that_clash(spark):
    rng = random.Random(32)
    shared = prose(rng, 90, 10**6)
    rows = [(i, f"{prose(rng, 30, 10**6)} {shared} {prose(rng, 30, 10**6)}") for i in range(4)] + [(9, None), (None, "x y")]
    extra = ("_spans", "_spans_id", "_spans_fp", "_cut_id", "spans", "fp", "start", "seed", "node", "band", "n", "component_id", "kept", "a", "b", "id")
    df = frame(spark, rows).withColumns({c: F.lit(f"own {c}") for c in extra})
    cut = passages.cut_passages(df)
    assert cut.columns == df.columns
    kept = {r.doc_id: r for r in cut.collect()}
    assert shared in kept[0].text and all(shared not in kept[i].text for i in (1, 2, 3)) and None in kept
    assert all(r[c] == f"own {c}" for r in kept.values() for c in extra)
    one = neardup.keep_one(df)
    assert one.columns == df.columns and one.count() == len(rows)
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    assert toxicity.drop_toxic(df, labels).columns == df.columns and language.keep_languages(df).columns == df.columns


def test_local_folders_are_refused_on_clusters():
    class Elsewhere:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Settings(dict):
        set = dict.__setitem__

    class Session:
        sparkContext, conf = Elsewhere(), Settings({"spark.sql.execution.arrow.maxRecordsPerBatch": "10"})

    with pytest.raises(ValueError):
        Scratch(Session())
    Session.conf.set("spark.checkpoint.dir", "hdfs://shared/")
    assert Scratch(Session()).root.startswith("hdfs://shared/scorewright-")
