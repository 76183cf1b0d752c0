"""Rewards of (original, revised) text pairs and of completions."""

from __future__ import annotations

import math
import re
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from scorewright.functions import json as J
from scorewright.functions import text as T

from .entities import entities
from .similarity import content_key, entity_similarity, sequence_ratio, token_f1

BLANK = 0.05


def guarded(original: Column, revised: Column, score: Column) -> Column:
    """1.0 for texts equal after stripping, else 0.05 for a blank revision, else the score; null texts count as empty."""
    o, r = (T.strip(F.coalesce(x, F.lit(""))) for x in (original, revised))
    return F.when(o == r, 1.0).when(r == "", BLANK).otherwise(score)


def basic_reward(original: Column, revised: Column, known: Column | None = None) -> Column:
    """(1 + shared tokens / all distinct tokens) / 2 behind the guards: what averaging (cosine + 1) / 2 over the token union comes to.

    A token shared by both sides has cosine 1 if it has a nonzero vector and 0 otherwise; `known` is an array of the
    tokens with such a vector, all tokens if left out. No token at all gives 0.5.
    """
    o, r = (T.tokens(F.coalesce(x, F.lit(""))) for x in (original, revised))
    both = F.array_intersect(o, r)
    if known is not None:
        both = F.array_intersect(both, known)
    union = F.size(F.array_union(o, r))
    return guarded(original, revised, F.when(union > 0, (1 + F.size(both) / union) / 2).otherwise(0.5))


def fuse(r_e: Column, r_t: Column, weight_e: float = 0.5, weight_t: float = 0.5) -> Column:
    total = weight_e + weight_t
    return T.clamp(r_e * F.lit(weight_e / total) + r_t * F.lit(weight_t / total))


def basic_rewards(pairs: DataFrame, vocabulary: DataFrame | None = None, key: str = "pair_id") -> DataFrame:
    """(key, reward) of rows (key, original, revised), by basic_reward; all tokens count as known, so the vocabulary isn't read."""
    return pairs.select(key, basic_reward(F.col("original"), F.col("revised")).alias("reward"))


def advanced_reward(
    pairs: DataFrame, vocabulary: DataFrame, key: str = "pair_id", weight_e: float = 0.5, weight_t: float = 0.5, text_similarity: str = "ratio"
) -> DataFrame:
    """(key, r_e, r_t, reward) of rows (key, original, revised): entity similarity and text similarity, fused by normalised weights.

    The text similarity is the sequence ratio, or with "greedy_f1" token_f1. Null texts count as empty. Pairs that a guard decides are left out
    of the costly branch; their r_e and r_t are null. Every row has its own result, those that repeat a key too; equal pairs are scored once.
    """
    assert text_similarity in ("ratio", "greedy_f1"), text_similarity
    o, r = (F.coalesce(F.col(c), F.lit("")) for c in ("original", "revised"))
    base = pairs.select(key, o.alias("original"), r.alias("revised"))
    base = base.withColumn("guard", guarded(F.col("original"), F.col("revised"), F.lit(None).cast("double")))
    base = base.withColumn("_pair", F.when(F.col("guard").isNull(), content_key(F.col("original"), F.col("revised"))))
    todo = base.where("guard is null").select("_pair", "original", "revised").dropDuplicates(["_pair"])
    if text_similarity == "ratio":
        alike = todo.select("_pair", sequence_ratio(F.col("original"), F.col("revised")).alias("r_t"))
    else:
        alike = token_f1(todo, vocabulary, "_pair")
    spans = todo.select("_pair", entities(F.col("original")).alias("entities_o"), entities(F.col("revised")).alias("entities_r"))
    scored = alike.join(entity_similarity(spans, vocabulary, "_pair"), "_pair")
    out = base.select(key, "guard", "_pair").join(scored, "_pair", "left")
    return out.select(key, "r_e", "r_t", F.coalesce("guard", fuse(F.col("r_e"), F.col("r_t"), weight_e, weight_t)).alias("reward"))


#: Rewards of tables, by name: each takes (pairs, vocabulary, key) and gives (key, reward) and perhaps more.
REWARDS = {"basic": basic_rewards, "advanced": advanced_reward}


def select_reward(name: str):
    assert name in REWARDS, f"unknown reward {name!r}"
    return REWARDS[name]


def zip_shorter(one: Column, other: Column) -> Column:
    """ARRAY<STRUCT<0, 1>>: the elements of two arrays by place, as far as the shorter one goes; null arrays have none."""
    length = F.least(F.coalesce(F.size(one), F.lit(0)), F.coalesce(F.size(other), F.lit(0)))
    cut = lambda xs: F.slice(xs, F.lit(1), F.greatest(length, F.lit(0)))
    pairs = F.transform(F.arrays_zip(cut(one).alias("x"), cut(other).alias("y")), lambda p: F.struct(p["x"].alias("one"), p["y"].alias("other")))
    return F.coalesce(pairs, F.array())


def first_content(completion: Column) -> Column:
    """The content of a completion's first message; null without one."""
    return F.get(completion, 0)["content"]


def prompts_of(rows: DataFrame, default: str = "") -> Column:
    """The column prompts, else queries, else the default; nulls are the default too."""
    found = [c for c in ("prompts", "queries") if c in rows.columns]
    return F.coalesce(F.col(found[0]), F.lit(default)) if found else F.lit(default)


def total_reward(rewards, weights=None) -> Column:
    """The weighted sum of reward columns, a null one left out; weights are 1 if not given."""
    weights = [1.0] * len(rewards) if weights is None else list(weights)
    assert len(weights) == len(rewards), "a weight for each reward"
    total = F.lit(0.0)
    for r, w in zip(rewards, weights, strict=True):
        total = total + F.coalesce(r.cast("double"), F.lit(0.0)) * F.lit(float(w))
    return total


def completion_text(completion: Column) -> Column:
    """The text of a VARIANT completion: an object's content ("" without one), a string itself, anything else as Python's str() shows it."""
    kind = F.schema_of_variant(completion)
    content = F.coalesce(F.try_variant_get(completion, "$.content", "string"), F.lit(""))
    plain = kind.startswith("OBJECT") | (kind == "STRING")
    rest = J.shown(F.when(~plain, F.to_json(completion)))
    return F.when(kind.startswith("OBJECT"), content).when(kind == "STRING", F.try_variant_get(completion, "$", "string")).otherwise(rest)


def score_completions(rows: DataFrame, reward="basic", vocabulary: DataFrame | None = None, default_prompt: str = "") -> DataFrame:
    """`rows` (prompt, completion text) with their reward; a missing prompt is the default, and a score that can't be had is 0.0.

    `reward` is a name of REWARDS, a function of the columns (prompt, completion), or a list of these, whose rewards are summed. Equal rows
    are scored once by a reward of tables.
    """
    out, parts, pair = rows, [], "_pair"
    while pair in rows.columns:
        pair = f"_{pair}"
    prompt, text = F.coalesce(F.col("prompt"), F.lit(default_prompt)), F.col("completion")
    for i, one in enumerate(reward if isinstance(reward, (list, tuple)) else [reward]):
        if callable(one):
            parts.append(one(prompt, text))
            continue
        base = rows.select(content_key(prompt, text).alias(pair), prompt.alias("original"), text.alias("revised")).dropDuplicates([pair])
        name = f"{pair}_{i}"
        scored = select_reward(one)(base, vocabulary, pair).select(pair, F.col("reward").alias(name))
        out = out.withColumn(pair, content_key(prompt, text)).join(scored, pair, "left").drop(pair)
        parts.append(F.col(name))
    return out.withColumn("reward", total_reward(parts)).drop(*[f"{pair}_{i}" for i in range(len(parts))])


# Units that may follow a number in an answer.
_UNITS = r"cm|mm|km|m|mg|kg|g|ml|l|s|min|h|hours?|minutes?|days?|years?|dollars?|cents?|degrees?"
_BOXED = re.compile(r"\\boxed\{((?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*)\}")
_SIGNS = re.compile(r"\\[dt]?frac|\\sqrt|\\cdot|\\times|[-+*/(){}]|\d+(?:\.\d+)?|\.\d+")


class _Value(tuple):
    """(c, d): the number c * sqrt(d), c a fraction, d a whole number without square factors."""

    __slots__ = ()

    @classmethod
    def of(cls, c: Fraction, d: int = 1):
        if c == 0 or d == 0:
            return cls((Fraction(0), 1))
        k = 2
        while k * k <= d:
            if k > 100_000:
                raise ValueError("too large a root")
            while d % (k * k) == 0:
                c, d = c * k, d // (k * k)
            k += 1
        return cls((c, d))

    def times(self, other):
        return _Value.of(self[0] * other[0], self[1] * other[1])

    def inverse(self):
        return _Value.of(1 / (self[0] * self[1]), self[1])

    def root(self):
        c, d = self
        if d != 1 or c < 0:
            raise ValueError("no root of that")
        whole = math.isqrt(c.numerator * c.denominator)
        if whole * whole == c.numerator * c.denominator:
            return _Value.of(Fraction(whole, c.denominator))
        return _Value.of(Fraction(1, c.denominator), c.numerator * c.denominator)


def _product(signs: list[str]) -> _Value:
    """Factors in a row, with signs, products, quotients, \\frac and \\sqrt, up to the end or a closing bracket."""
    value, apart, over = _Value.of(Fraction(1)), True, False
    first = True
    while signs and signs[0] not in ")}":
        sign = signs.pop(0)
        if sign in "-+" and first:
            value = value.times((Fraction(-1 if sign == "-" else 1), 1))
            first = False
            continue
        if sign in ("*", "/", "\\cdot", "\\times"):
            if apart:
                raise ValueError("a factor is missing")
            apart, over = True, sign == "/"
            continue
        if sign[0].isdigit() or sign[0] == ".":
            if not apart:
                raise ValueError("two numbers in a row")
            factor = _Value.of(Fraction(sign))
        elif sign.endswith("frac"):
            factor = _bracketed(signs)
            factor = factor.times(_bracketed(signs).inverse())
        elif sign == "\\sqrt":
            factor = _bracketed(signs).root()
        elif sign in "({":
            signs.insert(0, sign)
            factor = _bracketed(signs)
        else:
            raise ValueError(f"{sign!r} has no place here")
        value = value.times(factor.inverse() if over else factor)
        apart = first = over = False
    if apart:
        raise ValueError("a factor is missing")
    return value


def _bracketed(signs: list[str]) -> _Value:
    if not signs or signs.pop(0) not in "({":
        raise ValueError("a bracket is missing")
    value = _product(signs)
    if not signs or signs.pop(0) not in ")}":
        raise ValueError("a bracket is open")
    return value


def number(text: str | None) -> tuple | None:
    """The exact value of a number, else None; equal numbers compare equal.

    Whole numbers, decimals with thousands commas, fractions (a/b, \\frac), roots (\\sqrt) and their products and quotients, alone or in
    \\boxed{}, as they are or as the right side of an equation, with a unit, a percent or currency sign or \\text{} beside them, which don't count.
    """
    if text is None:
        return None
    box = _BOXED.search(text)
    body = (box[1] if box else text).split("=")[-1]
    body = re.sub(r"\\(?:text|mathrm|mbox)\{[^{}]*\}|\^\{?\\circ\}?|\\(?:left|right|degree|,|!|;|%|\$| )|[$%°€£]", "", body)
    body = re.sub(r"(?<=\d),(?=\d{3}(?!\d))", "", body.strip()).rstrip(". ")
    body = re.sub(rf"(?<=[\d}}])\s*(?:{_UNITS})$", "", body)
    signs = _SIGNS.findall(body)
    if not signs or "".join(signs) != re.sub(r"\s+", "", body) or len(signs) > 64:
        return None
    try:
        value = _product(signs)
        return None if signs else value
    except (ValueError, ZeroDivisionError):
        return None


@F.pandas_udf(TY.DoubleType())
def _accuracy(content: pd.Series, solution: pd.Series) -> pd.Series:
    def one(c, s):
        if c is None or s is None:
            return 0.0
        if "####" in s:
            found = re.search(r"<answer>(.*?)</answer>", c, re.DOTALL)
            got, want = number((found[1] if found else c).strip()), number(s.split("####", 1)[-1].strip())
        else:
            got, want = number(c), number(s)
        return float(got is not None and got == want)

    return pd.Series([one(c, s) for c, s in zip(content, solution, strict=True)])


def accuracy_reward(content: Column, solution: Column) -> Column:
    """1.0 if both hold the same number, else 0.0; a subset of symbolic equality (see `number`), where texts that aren't numbers equal nothing.

    A solution with #### gives what follows the first marker, and the content's <answer> element (or all of it) is compared.
    """
    return _accuracy(content, solution)


format_reward = T.well_formed
