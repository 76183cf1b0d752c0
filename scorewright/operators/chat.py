"""Chat templates, prompts and token length filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as TY

from scorewright.functions import text as T

MESSAGES = "array<struct<role:string,content:string>>"
# Headings of the template, texts of default rows and the system prompt.
HEADINGS = {"user": "### Human:\n", "assistant": "### Assistant:\n"}
DEFAULT_MESSAGES = [("user", "Generate a medical question based on case."), ("assistant", "Sample answer.")]
DEFAULT_TEXT = "### Human:\nGenerate a medical MCQ question.\n\n### Assistant:\nSample answer."
SYSTEM_PROMPT = (
    "A conversation between User and Assistant. The user asks a question, and the Assistant solves it. The assistant "
    "first thinks about the reasoning process in the mind and then provides the user with the answer. The reasoning "
    "process and answer are enclosed within <think> </think> and <answer> </answer> tags, respectively, i.e., "
    "<think> reasoning process here </think><answer> answer here </answer>"
)


def messages_literal(messages) -> Column:
    return F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("content")) for r, c in messages]).cast(MESSAGES)


def template(messages: Column) -> Column:
    """User and assistant messages under their headings, in order, stripped; other roles add nothing, a null content reads None."""
    kept = F.filter(messages, lambda m: m["role"].isin(*HEADINGS))
    heading = F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair])
    parts = F.transform(kept, lambda m: F.concat(heading[m["role"]], F.coalesce(m["content"], F.lit("None")), F.lit("\n\n")))
    return T.strip(F.concat_ws("", parts))


def with_messages(df: DataFrame) -> DataFrame:
    """`df` with a default messages column if it has none."""
    return df if "messages" in df.columns else df.withColumn("messages", messages_literal(DEFAULT_MESSAGES))


def conversations_to_messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, messages) of rows (conv_id, turn, role, text), in the order of turns."""
    turns = F.array_sort(F.collect_list(F.struct("turn", F.struct("role", F.col("text").alias("content")).alias("m"))))
    return conversations.groupBy("conv_id").agg(turns.alias("turns")).select("conv_id", F.transform("turns", lambda t: t["m"]).alias("messages"))


def question_prompt(question: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), F.lit(SYSTEM_PROMPT).alias("content")), F.struct(F.lit("user").alias("role"), question.alias("content")))


def tokenized(texts: DataFrame, most: int = 2048, text: str = "text") -> DataFrame:
    """`texts` with input_tokens (the first `most`) and an attention_mask of ones."""
    return texts.withColumn("input_tokens", F.slice(T.tokens(F.col(text)), 1, most)).withColumn("attention_mask", F.transform("input_tokens", lambda t: F.lit(1)))


def length_filter(tokens: DataFrame, most: int = 2048, column: str = "input_tokens") -> DataFrame:
    """Rows of 1 to `most` tokens; a lone row is kept as it is."""
    fits = F.coalesce(F.size(column).between(1, most), F.lit(False))
    if tokens.limit(2).count() < 2:
        return tokens
    return tokens.where(fits)


def or_default(df: DataFrame, default: DataFrame) -> DataFrame:
    """`df`, or the default rows if it has none."""
    return default.select(*df.columns) if df.isEmpty() else df


def encoded(texts: DataFrame, vocabulary: DataFrame, most: int = 2048, unknown: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, input_ids, attention_mask): the ids of the first `most` tokens by (token, id), and as many ones."""
    ids = vocabulary_ids(tokenized(texts, most, text), vocabulary, unknown, key=key)
    return ids.withColumn("attention_mask", F.transform("input_ids", lambda i: F.lit(1)))


def vocabulary_ids(tokens: DataFrame, vocabulary: DataFrame, unknown: int = 0, column: str = "input_tokens", key: str = "doc_id") -> DataFrame:
    """(key, input_ids) by a join with (token, id); tokens that aren't in the vocabulary take `unknown`, null lists have no ids.

    Equal lists of tokens are looked up once. Every row has its own result, those that repeat a key too.
    """
    own = tokens.select(key, F.coalesce(F.col(column), F.array().cast("array<string>")).alias("_tokens"))
    own = own.withColumn("_list", F.md5(F.concat_ws("\n", "_tokens")))
    at = own.dropDuplicates(["_list"]).select("_list", F.posexplode("_tokens").alias("pos", "token"))
    ids = at.join(vocabulary.select("token", "id"), "token", "left")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("id", F.lit(unknown)).cast("long").alias("id")))), lambda s: s["id"])
    found = ids.groupBy("_list").agg(listed.alias("input_ids"))
    none = F.array().cast(TY.ArrayType(TY.LongType()))
    return own.select(key, "_list").join(found, "_list", "left").select(key, F.coalesce("input_ids", none).alias("input_ids"))
