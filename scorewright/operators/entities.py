"""Rule-based entities with code-point offsets, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Units, counters, rates and keywords of the entity rules, by type.
_NUMBER = r"\d+(?:\.\d+)?"
_GAP = r"[\s\x1c-\x1f]*"
PATTERNS = (
    ("DOSAGE", _NUMBER + _GAP + "(?:mg|ml|g|kg|mmol|μg|ug|mcg|IU|%|percent)"),
    ("DOSAGE", _NUMBER + _GAP + "(?:次|遍|下|点|滴)"),
    ("MEASUREMENT", _NUMBER + _GAP + "(?:mg|ml|g|kg)" + _GAP + "/" + _GAP + "(?:day|daily|week|hour|h)"),
    ("MEASUREMENT", r"\d+" + _GAP + "x" + _GAP + "(?:daily|day|week)"),
)
KEYWORDS = {
    "SYMPTOM": ("fever", "pain", "cough", "headache", "nausea", "vomiting", "dizziness", "发烧", "疼痛", "咳嗽", "头痛", "恶心", "呕吐", "眩晕"),
    "DISEASE": ("diabetes", "hypertension", "infection", "pneumonia", "cancer", "糖尿病", "高血压", "感染", "肺炎", "癌症"),
    "DRUG": ("aspirin", "ibuprofen", "metformin", "lisinopril", "阿司匹林", "布洛芬", "二甲双胍", "利辛普利"),
}


def rules(keywords=None) -> list[tuple[str, str]]:
    """(type, pattern); the whole-word keywords of a type are one alternation, for they can't overlap."""
    return [*PATTERNS, *((kind, rf"\b(?:{'|'.join(words)})\b") for kind, words in (KEYWORDS if keywords is None else keywords).items())]


def _matches(text: Column, kind: str, pattern: str, order: int) -> Column:
    """The rule's matches with offsets: the pieces between the matches give the places."""
    full = f"(?iUd){pattern}"
    hits = F.regexp_extract_all(text, F.lit(full), F.lit(0))
    gaps = F.split(text, full, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<text:string,start:int,end:int,type:string,rule:int>>").alias("out"))

    def step(held, i):
        hit, at = F.element_at(hits, i), held["at"] + F.length(F.element_at(gaps, i))
        end = at + F.length(hit)
        own = F.struct(hit.alias("text"), at.alias("start"), end.alias("end"), F.lit(kind).alias("type"), F.lit(order).alias("rule"))
        return F.struct(end.alias("at"), F.concat(held["out"], F.array(own)).alias("out"))

    return F.when(F.size(hits) > 0, F.aggregate(F.sequence(F.lit(1), F.size(hits)), start, step, lambda held: held["out"])).otherwise(start["out"])


def entities(text: Column, keywords=None) -> Column:
    """ARRAY<STRUCT<text, start, end, type>> by start (ties by rule); overlaps stay; null text has none."""
    found = F.concat(*[_matches(F.coalesce(text, F.lit("")), kind, pattern, i) for i, (kind, pattern) in enumerate(rules(keywords))])

    def order(x, y):
        first = F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
        return first.when(x["rule"] < y["rule"], -1).when(x["rule"] > y["rule"], 1).otherwise(0)

    # rules of one type can't match the same place: their units, counters and whole words differ
    return F.transform(
        F.array_sort(found, order), lambda e: F.struct(e["text"].alias("text"), e["start"].alias("start"), e["end"].alias("end"), e["type"].alias("type"))
    )


def texts_by_type(text: Column, keywords) -> Column:
    """MAP<type, ARRAY<matched text>> of keyword rules, where the places don't matter."""
    hits = [x for kind, pattern in rules(keywords)[len(PATTERNS) :] for x in (F.lit(kind), F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"(?iUd){pattern}"), F.lit(0)))]
    return F.create_map(*hits)
