import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorewright.functions import text as T

SIGNS = ["a", "B", " ", "\t", "\n", "\r", "\x1c", "\x85", "\xa0", "　", " ", "é", "你", "😀", "<answer>", "</answer>", "<think>", "</think>", "####", "#"]


def texts(n=400, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 12))) for _ in range(n)]


def column(spark, rows, f):
    df = spark.createDataFrame(list(enumerate(rows)), "i long, t string")
    return [r[0] for r in df.orderBy("i").select(f(F.col("t"))).collect()]


def test_strip_and_normalize_match_python(spark):
    rows = texts()
    assert column(spark, rows, T.strip) == [t.strip() for t in rows]
    assert column(spark, rows, T.normalize) == [re.sub(r"\s+", " ", t.strip().lower()) for t in rows]
    assert column(spark, [None], T.normalize) == [""]


@settings(max_examples=200)
@given(st.characters())
def test_white_is_what_python_strips(c):
    assert (c in T.WHITE) == (c.strip() == "")


def test_answer_format_marker(spark):
    rows = [*texts(600, 5), "<think>a</think><answer>b</answer>", "<think>a</think><answer>b</answer>\n", "<think>a</think><answer>b</answer>\r", "x####y####z"]

    def answer(t):
        m = re.search(r"<answer>(.*?)</answer>", t, re.DOTALL)
        return (m[1] if m else t).strip()

    assert column(spark, rows, T.answer) == [answer(t) for t in rows]
    assert column(spark, rows, T.well_formed) == [1.0 if re.match(r"<think>.*?</think><answer>.*?</answer>$", t) else 0.0 for t in rows]
    assert column(spark, rows, T.after_marker) == [t.split("####", 1)[-1] for t in rows]
    assert column(spark, [None], T.answer) == [""]


def test_tokens_are_no_white_space(spark):
    rows = [*texts(300, 8), "a\u3000b\xa0c", "naïve_x 3é", "你好\u3000世界。", "e\u0301t"]
    want = [re.findall(r"\w+|[^\w\s]", t.lower().replace("e\u0301", "E")) for t in rows]
    got = column(spark, rows, T.tokens)
    assert [[t.replace("e\u0301", "E") for t in g] for g in got] == want
    assert got[300] == ["a", "b", "c"]


def test_bounded(spark):
    rows = ["x" * 1999, "x" * 2000, "x" * 2001, "😀" * 2001]
    assert column(spark, rows, T.bounded) == [t if len(t) <= 2000 else t[:2000] + "..." for t in rows]
