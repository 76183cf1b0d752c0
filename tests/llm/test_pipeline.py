import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    prose = lambda n: " ".join("".join(rng.choices(["ka", "lo", "mi", "tu", "re"], k=rng.randint(2, 4))) for _ in range(n))
    shared = prose(80)
    rows = []
    for i in range(240):
        text = prose(60)
        if i % 6 == 0:
            text += " vile scum"
        if i % 6 == 1:
            text += " " + shared
        rows.append((i, text, "aa", "s", len(text)))
    rows += [(500, rows[2][1], "aa", "s", 1), (501, "123 456", "aa", "s", 7), (502, None, "aa", "s", 0), (503, "", "aa", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, int(i % 6 == 0)) for i in range(200)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    names = docs.columns
    kept = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == names
            kept.append({r.doc_id: r.text for r in docs.collect()})
    toxic = {i for i in range(240) if i % 6 == 0}
    assert set(kept[0]) == {r[0] for r in rows} - toxic
    assert set(kept[1]) == set(kept[0]) - {501, 502, 503}
    assert set(kept[2]) == set(kept[1]) - {500}
    assert set(kept[3]) == set(kept[2])
    first = min(i for i in kept[3] if i % 6 == 1)
    assert [i for i, t in kept[3].items() if shared[20:-20] in t] == [first]
    assert all(kept[3][i] == kept[2][i] for i in kept[3] if i % 6 != 1)
    assert {r.doc_id for r in docs.collect()} == set(kept[3])
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_edges(spark, tmp_path):
    """No documents; ids that repeat with other texts, null ids and a column that clashes with inner names."""
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    rng = random.Random(13)
    prose = lambda n: " ".join("".join(rng.choices(["ka", "lo", "mi", "tu", "re"], k=rng.randint(2, 4))) for _ in range(n))
    rows = [(i, prose(50), "aa", "s", 1, "x") for i in range(30)] + [(3, prose(40), "aa", "s", 1, "y"), (None, prose(30), "aa", "s", 1, "z"), (31, None, "aa", "s", 1, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, _spans string"
    for name, some in (("none", []), ("odd", rows)):
        folder = tmp_path / name
        spark.createDataFrame(some, schema).write.parquet(str(folder / "documents.parquet"))
        labels.write.parquet(str(folder / "labels.parquet"))
        packed = corpus_pipeline.run(spark, str(folder)).collect()
        docs = spark.read.parquet(str(folder / "documents.parquet"))
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(folder))
            assert docs.columns == schema.replace(" string", "").replace(" long", "").split(", ")
        assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in docs.collect())
        assert bool(packed) == bool(some)


def test_pipeline_matches_its_parts(spark, tmp_path):
    """run() against the operators' own decisions, one after another, by brute force over the rows."""
    from scorewright.llm import language, neardup, passages, toxicity

    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choices(["ka", "lo", "mi", "tu", "re"], k=rng.randint(2, 4))) for _ in range(n))
    shared, base = prose(70), prose(100).split()
    rows = []
    for i in range(120):
        text = {0: prose(40) + " vile scum " + prose(20), 1: prose(30) + " " + shared + " " + prose(30), 2: " ".join([*base[:-1], f"z{i}"])}.get(i % 6, prose(60))
        rows.append((i, text, "aa", "s", len(text)))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    fine = {r.doc_id for r in toxicity.score_toxicity(docs, labels).collect() if not r.predicted}
    left = docs.where(F.col("doc_id").isin(*fine))
    named = {r.doc_id for r in language.identify_language(left).collect() if r.lang_pred != "und" and r.score >= 0.4}
    left = left.where(F.col("doc_id").isin(*named))
    kept = {r.doc_id for r in neardup.near_duplicates(left).collect() if r.kept}
    left = left.where(F.col("doc_id").isin(*kept))
    gone = Counter()
    for r in passages.repeated_passages(left).collect():
        gone[r.doc_id] += r.end_word - r.start_word
    words = {i: len(texts[i].split()) - gone[i] for i in kept}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == {i for i, n in words.items() if n}
    assert sum(gone.values()) >= 70 * 19 and len([i for i in kept if i % 6 == 2]) == 1
    assert len([i for i in texts if i % 6 == 0 and i in fine]) <= 2
