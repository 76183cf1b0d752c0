import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from scorewright.operators import entities, rewards, similarity

# what the rules find, by hand: (start, end, type)
SENTENCES = {
    "Take 10mg aspirin and 5 ml daily.": [(5, 9, "DOSAGE"), (10, 17, "DRUG"), (22, 26, "DOSAGE")],
    "吃 10 毫克 阿司匹林 ，头痛 3次": [(8, 12, "DRUG"), (14, 16, "SYMPTOM"), (17, 19, "DOSAGE")],
    "100mg/day of Metformin; 3 x daily": [(0, 5, "DOSAGE"), (0, 9, "MEASUREMENT"), (13, 22, "DRUG"), (24, 33, "MEASUREMENT")],
    "5 girls, 20%": [(0, 3, "DOSAGE"), (9, 12, "DOSAGE")],
    "５ｍｇ x １０mg": [(6, 10, "DOSAGE")],
    "😀 fever and Fever feverish": [(2, 7, "SYMPTOM"), (12, 17, "SYMPTOM")],
    "发烧咳嗽": [],
    "": [],
    "1.5 kg / week pain": [(0, 6, "DOSAGE"), (0, 13, "MEASUREMENT"), (14, 18, "SYMPTOM")],
    "2\x1cmg": [(0, 4, "DOSAGE")],
    "IU 5iu": [(3, 6, "DOSAGE")],
}
PAIRS = [
    (1, "Take 10mg aspirin daily for fever.", "Take 10mg aspirin daily for fever."),
    (2, "Take 10mg aspirin daily for fever.", "Take 20mg aspirin daily for fever."),
    (3, "The cough lasts; give 5 ml twice.", ""),
    (4, "", "  "),
    (5, "Patient has diabetes and pain.", "Patient has hypertension and pain, 100mg/day."),
    (6, "患者 发烧 ，服用 10 mg 。", "患者 发烧 ，服用 20 mg 。"),
    (7, "no entity here", "none at all there"),
    (8, "nausea nausea nausea", "nausea 3 x daily"),
]


def test_entities(spark):
    df = spark.createDataFrame(list(enumerate(SENTENCES)), "i long, t string")
    for r in df.select("t", entities.entities(F.col("t")).alias("e")).collect():
        got = [(e.start, e.end, e.type) for e in r.e]
        assert sorted(got) == sorted(SENTENCES[r.t]), r.t
        assert [g[0] for g in got] == sorted(g[0] for g in got)
        assert all(e.text == r.t[e.start : e.end] for e in r.e)
    assert df.select(entities.entities(F.lit(None).cast("string")).alias("e")).first().e == []


def pairs(spark):
    rows = [
        (1, "Patient takes 10mg daily.", "Patient takes 10mg daily."), (2, "Patient takes 10mg daily.", "Patient takes 10mg twice daily."), (3, "Patient takes 10mg.", "Patient takes 20mg."),
        (4, "Patient takes 10mg.", ""), (5, "患者 每日 10mg", "患者 每日 20mg"), (6, " ", "\t"), (7, "a b", "c d"), (8, None, "x"),
    ]
    return spark.createDataFrame(rows, "pair_id long, original string, revised string")


def test_basic_reward(spark):
    got = {r.pair_id: r.s for r in pairs(spark).select("pair_id", rewards.basic_reward(F.col("original"), F.col("revised")).alias("s")).collect()}
    assert got[1] == 1.0 and got[4] == 0.05 and got[6] == 1.0 and got[7] == 0.5 and got[8] == 0.5
    assert got[3] == pytest.approx((1 + 3 / 5) / 2)  # patient, takes and the dot, of five tokens
    assert all(0.05 <= x <= 1 for x in got.values())
    known = rewards.basic_reward(F.lit("a b c"), F.lit("a b d"), F.array(F.lit("a")))
    assert spark.range(1).select(known).first()[0] == pytest.approx((1 + 1 / 4) / 2)


def test_ratio_and_alignment(spark):
    rng = random.Random(1)
    rows = [("".join(rng.choices("abc d", k=rng.randint(0, 300))), "".join(rng.choices("abc d", k=rng.randint(0, 300)))) for _ in range(60)]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i long, a string, b string").orderBy("i")
    assert [r[0] for r in df.select(similarity.sequence_ratio(F.col("a"), F.col("b"))).collect()] == [SequenceMatcher(None, a, b).ratio() for a, b in rows]
    one = spark.createDataFrame([(["a", "b", "c"], ["a", "x", "y", "c"]), ([], ["z"]), (["q"], [])], "a array<string>, b array<string>")
    got = [[(p.o, p.r) for p in r[0]] for r in one.select(similarity.align(F.col("a"), F.col("b"))).collect()]
    assert got == [[("a", "a"), ("b", "x"), (None, "y"), ("c", "c")], [(None, "z")], [("q", None)]]


def test_advanced_reward(spark):
    vocabulary = spark.createDataFrame([("10mg", [1.0, 0.0]), ("20mg", [1.0, 1.0]), ("aspirin", [0.0, 0.0])], "token string, vector array<double>")
    got = {r.pair_id: r for r in rewards.advanced_reward(pairs(spark), vocabulary).collect()}
    assert got[1].reward == 1.0 and got[4].reward == 0.05 and got[6].reward == 1.0 and len(got) == 8
    r_t = SequenceMatcher(None, "Patient takes 10mg.", "Patient takes 20mg.").ratio()
    assert got[3].r_e == pytest.approx(2**-0.5) and got[3].reward == pytest.approx((2**-0.5 + r_t) / 2)
    assert got[7].r_e == 1.0  # no entity on either side
    assert all(0 <= r.reward <= 1 for r in got.values())
    many = spark.createDataFrame([(1, "10mg 20mg", "10mg 20mg")], "pair_id long, original string, revised string")
    rows = many.select("pair_id", entities.entities(F.col("original")).alias("entities_o"), entities.entities(F.col("revised")).alias("entities_r"))
    # four matches of two entities a side: the unmatched counts are negative and raise the mean
    c = 2**-0.5
    assert similarity.entity_similarity(rows, vocabulary).first().r_e == pytest.approx(min(1.0, (2 + 2 * c) / 4 * (1 - 0.5 * (-4 / 4))))


def test_rows_that_repeat_a_key(spark):
    vocabulary = spark.createDataFrame([("10mg", [1.0, 0.0]), ("20mg", [1.0, 1.0])], "token string, vector array<double>")
    rows = [(1, "10mg now", "20mg now"), (1, "fever", "10mg pain"), (1, "fever", "10mg pain"), (2, "fever", "10mg pain"), (None, "10mg", "20mg a"), (3, None, "x")]
    df = spark.createDataFrame(rows, "pair_id long, original string, revised string")
    alone = {}
    for o, r in {(o, r) for _, o, r in rows}:
        one = spark.createDataFrame([(0, o, r)], df.schema)
        alone[o, r] = rewards.advanced_reward(one, vocabulary).first().reward
    got = sorted((r.pair_id or 0, round(r.reward, 9)) for r in rewards.advanced_reward(df, vocabulary).collect())
    assert got == sorted((i or 0, round(alone[o, r], 9)) for i, o, r in rows)
    assert len(set(alone.values())) == 4
    spans = df.select("pair_id", entities.entities(F.col("original")).alias("entities_o"), entities.entities(F.col("revised")).alias("entities_r"))
    assert similarity.entity_similarity(spans, vocabulary).count() == len(rows)
    assert similarity.entity_similarity(spans.where("false"), vocabulary).count() == 0


def test_token_f1(spark):
    vocabulary = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "token string, vector array<double>")
    rows = [(1, "a b", "a"), (1, "a b", "a"), (2, "a", "zz"), (3, "", "a"), (4, None, "a"), (5, "b zz", "b b")]
    df = spark.createDataFrame(rows, "pair_id long, original string, revised string")
    got = sorted((r.pair_id, round(r.r_t, 6)) for r in similarity.token_f1(df, vocabulary).collect())
    assert got == [(1, round(2 / 3, 6)), (1, round(2 / 3, 6)), (2, 0.0), (3, 0.0), (4, 0.0), (5, 1.0)]
    scored = {r.pair_id: r.r_t for r in rewards.advanced_reward(df, vocabulary, text_similarity="greedy_f1").collect()}
    assert scored[1] == pytest.approx(2 / 3) and scored[5] == 1.0
    with pytest.raises(AssertionError):
        rewards.advanced_reward(df, vocabulary, text_similarity="other")


def test_numbers():
    same = [
        ("1,000.50", "2001/2", r"\boxed{\frac{2001}{2}}", "x = 1000.5"), (r"\boxed{-\frac{1}{3}}", "-1/3"), (r"\frac{\sqrt{8}}{2}", r"\sqrt{2}", r"\frac{2}{\sqrt{2}}"),
        (r"\boxed{x=\frac{2\sqrt{3}}{4}}", r"\frac{1}{2}\sqrt{3}"), ("5 cm", "5", "$5", r"5\text{ apples}", "5.", "05", r"\sqrt{25}"), ("0", r"\sqrt{0}", "-0"), (r"\sqrt{1/2}", r"\sqrt{2}/2"),
    ]
    values = [{rewards.number(t) for t in group} for group in same]
    assert all(len(v) == 1 and None not in v for v in values) and len(set.union(*values)) == len(same)
    for bad in ("x", "1/0", "7 no", "3 4", "", "-", "1e5", "2 *", "(1", None, r"\sqrt{-1}", "5 / / 2", "{" * 100, "1" + "*2" * 200):
        assert rewards.number(bad) is None, bad


def test_completions_rewards_and_registry(spark):
    rows = spark.createDataFrame([("<answer>7</answer>", "a #### 7"), ("7 no", "#### 7"), ("0.5", "1/2"), (None, "1"), ("x", "x")], "c string, s string")
    assert [r[0] for r in rows.select(rewards.accuracy_reward(F.col("c"), F.col("s"))).collect()] == [1.0, 0.0, 1.0, 0.0, 0.0]
    values = ['{"content": "x"}', '{"role": "a"}', '"plain"', "5", "1.5", "true", "null", '[1, "a", [null]]', '""']
    done = spark.createDataFrame([(v,) for v in values], "j string").select(rewards.completion_text(F.parse_json("j")))
    assert [r[0] for r in done.collect()] == ["x", "", "plain", "5", "1.5", "True", "None", "[1, 'a', [None]]", ""]
    turns = spark.createDataFrame([(None, "x"), ("x", "x"), ("x", "<think>a</think><answer>b</answer>"), ("x", "x")], "prompt string, completion string")
    form = lambda prompt, completion: rewards.format_reward(completion)
    by_name = rewards.score_completions(turns, "basic").collect()
    assert sorted(r.reward for r in by_name) == sorted(r.reward for r in rewards.score_completions(turns, rewards.basic_reward).collect())
    assert {(r.prompt, r.completion): r.reward for r in by_name}[None, "x"] == 0.5 and by_name[0].__fields__ == ["prompt", "completion", "reward"]
    both = {r.completion: r.reward for r in rewards.score_completions(turns.where("prompt = 'x'"), ["basic", form]).collect()}
    assert both["x"] == 1.0 and 1.5 <= both["<think>a</think><answer>b</answer>"] < 2.0
    vocabulary = spark.createDataFrame([("x", [1.0])], "token string, vector array<double>")
    advanced = rewards.score_completions(turns, ["advanced", rewards.basic_reward], vocabulary).collect()
    assert len(advanced) == 4 and all(0 <= r.reward <= 2 for r in advanced)
    fails = lambda prompt, completion: F.lit(None).cast("double")
    assert [r.reward for r in rewards.score_completions(turns.limit(1), fails).collect()] == [0.0]
    weighed = spark.range(1).select(rewards.total_reward([F.lit(1.0), F.lit(None).cast("double"), F.lit(0.5)], [2.0, 9.0, 1.0])).first()[0]
    assert weighed == 2.5
    with pytest.raises(AssertionError):
        rewards.select_reward("other")


def test_zips_prompts_and_messages(spark):
    arrays = spark.createDataFrame([(["a", "b", "c"], ["x", "y"]), ([], ["x"]), (None, ["x"])], "p array<string>, q array<string>")
    got = [[(z.one, z.other) for z in r[0]] for r in arrays.select(rewards.zip_shorter(F.col("p"), F.col("q"))).collect()]
    assert got == [[("a", "x"), ("b", "y")], [], []]
    messages = "array<struct<role:string,content:string>>"
    done = spark.createDataFrame([([("a", "one"), ("b", "two")],), ([],), (None,)], f"m {messages}").select(rewards.first_content(F.col("m")))
    assert [r[0] for r in done.collect()] == ["one", None, None]
    row = spark.createDataFrame([("p", "q"), (None, "q")], "prompts string, queries string")
    assert [r[0] for r in row.select(rewards.prompts_of(row, "d")).collect()] == ["p", "d"]
    assert row.drop("prompts").select(rewards.prompts_of(row.drop("prompts"))).first()[0] == "q" and row.select(rewards.prompts_of(arrays, "d")).first()[0] == "d"


def test_queries_score_the_conversations(spark, tmp_path):
    from scorewright.plans import catalog

    turns = [row for i, (_, o, r) in enumerate(PAIRS) for row in ((i, 0, "user", o), (i, 1, "assistant", r))]
    turns += [(50, 0, "user", "10mg aspirin"), (50, 1, "assistant", "10mg aspirin daily"), (50, 1, "assistant", "no drug")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    vectors = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(100)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = sorted([*((i, 0) for i in range(len(PAIRS))), (50, 0), (50, 0)])
    advanced = catalog.advanced_reward(spark, str(tmp_path)).collect()
    assert sorted((r.conv_id, r.turn) for r in advanced) == want
    assert sorted((r.conv_id, r.turn) for r in catalog.entity_similarity(spark, str(tmp_path)).collect()) == want
    inline = spark.createDataFrame(PAIRS, "pair_id long, original string, revised string")
    alone = {r.pair_id: r for r in rewards.advanced_reward(inline, catalog._vocabulary(spark, str(tmp_path))).collect()}
    got = {r.conv_id: r for r in advanced}
    assert all(got[i].reward == pytest.approx(alone[p].reward, abs=1e-6) for i, (p, _, _) in enumerate(PAIRS))
    assert len({r.reward for r in advanced if r.conv_id == 50}) == 2
