"""String functions whose results equal the Python ones: strip, normalisation, answers, formats, tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 29 code points that Python's str.strip() removes.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_WHITE = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WHITE_CLASS = f"[{_WHITE}]"
_IN_WORD = r"\p{L}\p{M}\p{N}_"
#: Words, and every other sign but white space by itself: stands in for a model's tokenizer.
TOKEN = f"[{_IN_WORD}]+|[^{_IN_WORD}{_WHITE}]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE))


def non_blank(text: Column) -> Column:
    """The stripped text, null where nothing is left."""
    return F.nullif(strip(text), F.lit(""))


def normalize(text: Column) -> Column:
    """Stripped, lower-cased, each run of white space one space; null gives an empty string."""
    return F.coalesce(F.regexp_replace(F.lower(strip(text)), _WHITE_CLASS + "+", " "), F.lit(""))


def answer(text: Column) -> Column:
    """What the first <answer> element holds, else the whole text, stripped; null gives an empty string."""
    pattern = "(?s)<answer>(.*?)</answer>"
    return F.coalesce(strip(F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1)).otherwise(text)), F.lit(""))


def well_formed(text: Column) -> Column:
    """1.0 if the text is a <think> and an <answer> element, each on one line, with at most a line feed after them."""
    return F.coalesce(text.rlike(r"(?d)\A<think>.*?</think><answer>.*?</answer>$"), F.lit(False)).cast("double")


def after_marker(text: Column, marker: str = "####") -> Column:
    """What follows the first marker, or the whole text without one."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).otherwise(text)


def bounded(text: Column, most: int = 2000) -> Column:
    """The first `most` characters and "..." of a longer text."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
