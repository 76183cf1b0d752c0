import math

import pytest
from pyspark.sql import functions as F

from scorewright.functions import vectors as V
from scorewright.operators import chat, sampling, steps


def test_index_stats_and_baseline(spark):
    rewards = [((i * 37) % 100) / 100 for i in range(2500)]
    rows = spark.createDataFrame([(f"k{i:05d}", r) for i, r in enumerate(rewards)], "k string, reward double").repartition(7)
    indexed = steps.with_index(rows, "k")
    assert [r.idx for r in indexed.orderBy("k").collect()] == list(range(2500))
    stats = steps.ema(steps.batch_stats(indexed, 2)).orderBy("step").collect()
    b = 0.0
    for s in stats:
        part = rewards[s.step * 2 : s.step * 2 + 2]
        b = 0.9 * b + 0.1 * sum(part) / len(part)
        assert s.baseline == pytest.approx(b) and s.reward_min == min(part) and s.reward_max == max(part)
    assert len(stats) == 1250  # more than one block
    adv = steps.advantages(indexed, steps.ema(steps.batch_stats(indexed, 2)), 2).where("idx = 0").first().advantage
    assert adv == pytest.approx(rewards[0] - 0.1 * (rewards[0] + rewards[1]) / 2)
    empty = steps.with_index(rows.where("false"), "k")
    assert empty.count() == 0 and steps.ema(steps.batch_stats(empty, 2)).count() == 0


def test_known_baseline(spark):
    stats = spark.createDataFrame([(0, 0.5), (1, 0.7), (2, 0.9)], "step long, reward_mean double")
    assert [round(r.baseline, 6) for r in steps.ema(stats).orderBy("step").collect()] == [0.05, 0.115, 0.1935]


def test_baseline_of_many_steps_and_failures(spark):
    means = [None if i % 7 == 3 else ((i * 31) % 50) / 50 for i in range(70_000)]
    stats = spark.createDataFrame([(i + 5, m, 9.0) for i, m in enumerate(means)], "step long, reward_mean double, baseline double").repartition(5)
    got = steps.ema(stats, 0.8, 0.25).orderBy("step").collect()  # three levels of blocks, and an older baseline
    b = 0.25
    assert len(got) == len(means) and got[0].__fields__ == ["step", "reward_mean", "baseline"]
    for m, r in zip(means, got, strict=True):
        b = b if m is None else 0.8 * b + 0.2 * m
        assert r.baseline == pytest.approx(b)
    rows = spark.createDataFrame([(i, None if i == 3 else 0.5) for i in range(6)], "idx long, reward double")
    kept = steps.batch_stats(rows, 2).orderBy("step").collect()
    assert [(r.reward_mean, r.reward_min, r.n) for r in kept] == [(0.5, 0.5, 2), (None, None, 2), (0.5, 0.5, 2)]
    adv = {r.idx: r.advantage for r in steps.advantages(rows, steps.ema(steps.batch_stats(rows, 2)), 2).collect()}
    assert adv[2] == pytest.approx(0.5 - 0.05) and adv[3] is None and adv[4] == pytest.approx(0.5 - 0.095)


def test_index_with_ties_and_old_names(spark):
    rows = spark.createDataFrame([("a", 7), ("b", 7), ("a", 7), (None, 7)], "k string, idx int")
    got = [(r.k, r.idx) for r in steps.with_index(rows, "k").orderBy("idx").collect()]
    assert got == [(None, 0), ("a", 1), ("a", 2), ("b", 3)]
    other = spark.createDataFrame([(9, "x"), (8, "y")], "n long, v string")
    assert [(r.idx, r.k, r.v) for r in steps.zip_rows(rows, other, "k", "n").orderBy("idx").collect()] == [(0, None, "y"), (1, "a", "x")]


def test_epochs(spark):
    rows = spark.range(5).withColumnRenamed("id", "idx")
    got = steps.epochs(rows, 2, 2, 5).orderBy("epoch", "idx").collect()
    assert [(r.step, r.batch_idx) for r in got] == [(0, 1), (0, 1), (1, 2), (1, 2), (2, 3), (3, 1), (3, 1), (4, 2), (4, 2), (5, 3)]
    assert got[0].steps_per_epoch == 2


def test_weights(spark):
    scores = spark.createDataFrame([(0.8, 0.7), (0.6, 0.8), (0.9, 0.85)], "r_e double, r_t double")
    w = steps.FusionWeights()
    assert sum(w.weights()) == pytest.approx(1, abs=1e-6)
    assert [r[0] for r in scores.select(w.forward(F.col("r_e"), F.col("r_t"))).collect()] == pytest.approx([0.75, 0.7, 0.875])
    before = w.weights()[1]
    w.fit(scores, 50, 1.0)
    assert w.weights()[1] > before and sum(w.weights()) == pytest.approx(1)  # r_t is larger on average


def test_vectors(spark):
    one = spark.range(1)
    arr = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    assert one.select(V.cosine(arr(1, 0), arr(1, 1))).first()[0] == pytest.approx(2**-0.5)
    assert one.select(V.cosine(arr(0, 0), arr(1, 1))).first()[0] == 0.0
    assert one.select(V.greedy_f1(F.array(arr(1, 0), arr(0, 1)), F.array(arr(1, 0)))).first()[0] == pytest.approx(2 * 0.5 / 1.5)
    assert one.select(V.pairwise_mean_cosine(F.array(arr(0, 0)), F.array(arr(1, 0)))).first()[0] is None


def test_chat(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "hi"), (1, 2, "assistant", None), (2, 0, "tool", "x")]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r.t for r in chat.conversations_to_messages(conv).select("conv_id", chat.template(F.col("messages")).alias("t")).collect()}
    assert got == {1: "### Human:\nhi\n\n### Assistant:\nNone", 2: ""}
    df = spark.createDataFrame([(1, "a b c"), (2, "")], "doc_id long, text string")
    tok = chat.tokenized(df, 2)
    assert [r.doc_id for r in chat.length_filter(tok, 2).collect()] == [1] and tok.first().attention_mask == [1, 1]
    assert chat.length_filter(tok.where("doc_id = 2")).count() == 1  # a lone row stays
    vocabulary = spark.createDataFrame([("a", 5)], "token string, id long")
    assert {r.doc_id: r.input_ids for r in chat.vocabulary_ids(tok, vocabulary).collect()} == {1: [5, 0], 2: []}
    again = df.unionByName(spark.createDataFrame([(1, "c a"), (1, "a b c"), (3, None)], df.schema))
    got = sorted((r.doc_id, r.input_ids, r.attention_mask) for r in chat.encoded(again, vocabulary, 2, 9).collect())
    assert got == [(1, [5, 9], [1, 1]), (1, [5, 9], [1, 1]), (1, [9, 5], [1, 1]), (2, [], []), (3, [], [])]
    default = spark.createDataFrame([(0, chat.DEFAULT_TEXT)], "doc_id long, text string")
    assert chat.or_default(df.where("false"), default).count() == 1 and chat.or_default(df, default).count() == 2
    assert chat.with_messages(df).first().messages[0].role == "user"
    assert [m.role for m in df.select(chat.question_prompt(F.col("text"))).first()[0]] == ["system", "user"]


def test_first_rows_and_sorted_values(spark):
    rows = spark.createDataFrame([("a", 3, "x"), ("a", 1, "y"), (None, 2, "z"), ("a", 1, "b")], "k string, at long, v string")
    first = sampling.keep_first(rows, "k", "at")
    assert first.columns == rows.columns and sorted(map(tuple, first.collect()), key=str) == sorted([("a", 1, "b"), (None, 2, "z")], key=str)
    assert {r.k: r.v for r in sampling.sorted_values(rows, "k", "v").collect()} == {"a": ["b", "x", "y"], None: ["z"]}


@pytest.mark.parametrize("n", [1, 9, 10, 11])
def test_sampling(spark, n):
    rows = spark.range(n)
    assert sampling.split(rows, "id").where("is_test").count() == math.ceil(n * 0.1)
    assert sampling.sample_n(rows, "id", 0).count() == n and sampling.sample_n(rows, "id", 5).count() == min(5, n)
    assert sampling.first_accepted(rows, F.col("id") % 2 == 1, "id", 2).count() == min(2, n // 2)
    assert sampling.first_accepted(rows, F.col("id") >= 0, "id", 0).count() == 0
