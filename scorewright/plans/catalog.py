"""The named queries of this engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import json as J
from scorewright.functions import text as T
from scorewright.functions import vectors as V
from scorewright.operators import chat, entities, rewards, sampling, similarity, steps
from scorewright.sources import records, sinks

BATCH = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("original"))
    said = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("revised"))
    return asked.join(said, ["conv_id", "turn"])


def basic_reward(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(rewards.basic_reward(F.col("original"), F.col("revised")), 6).alias("reward"))


def _indexed(spark, sf_dir):
    scored = _pairs(spark, sf_dir).select("conv_id", "turn", rewards.basic_reward(F.col("original"), F.col("revised")).alias("reward"))
    return steps.with_index(scored, "conv_id", "turn")


def basic_reward_batch_stats(spark, sf_dir):
    stats = steps.batch_stats(_indexed(spark, sf_dir), BATCH)
    return stats.select("step", *[F.round(c, 6).alias(c) for c in ("reward_mean", "reward_min", "reward_max")], "n")


def ema_baseline(spark, sf_dir):
    return steps.ema(steps.batch_stats(_indexed(spark, sf_dir), BATCH)).select("step", F.round("baseline", 6).alias("baseline"))


def advantage(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    out = steps.advantages(indexed, steps.ema(steps.batch_stats(indexed, BATCH)), BATCH)
    return out.select("conv_id", "turn", F.round("advantage", 5).alias("advantage"))


def epoch_batches(spark, sf_dir):
    indexed = _indexed(spark, sf_dir)
    made = steps.epochs(indexed, 2, BATCH, indexed.count())
    return made.groupBy("epoch", "batch_idx", "steps_per_epoch").agg(F.count("*").alias("n"), F.round(F.avg("reward"), 6).alias("reward_mean"))


def chat_template(spark, sf_dir):
    messages = chat.conversations_to_messages(_table(spark, sf_dir, "conversations"))
    return messages.select("conv_id", chat.template(F.col("messages")).alias("text"))


def bounded_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.bounded(F.col("text")).alias("text"))


def token_length_filter(spark, sf_dir):
    docs = chat.tokenized(_table(spark, sf_dir, "documents").select("doc_id", "text"), 2048)
    return chat.length_filter(docs).select("doc_id", F.size("input_tokens").cast("long").alias("n_tokens"), F.md5(F.concat_ws(" ", "input_tokens").cast("binary")).alias("tokens_md5"))


def normalize_text(spark, sf_dir):
    return _table(spark, sf_dir, "pages").select("page_id", T.normalize(F.col("html")).alias("text"))


def _documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def _by_turns(key, *values):
    """The value whose turn it is, by key modulo their number."""
    out = F.lit(None).cast("string")
    for i, v in enumerate(values):
        out = F.when(F.pmod(F.col(key), F.lit(len(values))) == i, v).otherwise(out)
    return out


def strip_text(spark, sf_dir):
    padded = F.concat(F.lit("\u3000 \t"), F.col("text"), F.lit("\x1c\x85\u2003\n"))
    return _documents(spark, sf_dir).select("doc_id", T.strip(padded).alias("text"))


def ordered_dedup(spark, sf_dir):
    first = sampling.keep_first(_table(spark, sf_dir, "documents"), "text", "doc_id")
    return first.select("doc_id", "lang", "source", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _tagged(spark, sf_dir):
    """The documents' texts with and without thought and answer tags and markers."""
    text, lit = F.col("text"), F.lit
    made = _by_turns(
        "doc_id", F.concat(lit("<think>a</think><answer>"), text, lit("</answer>")), F.concat(lit("<think>"), text, lit("</think><answer>x</answer>\n")),
        F.concat(lit("x <answer> 1 </answer><answer>2</answer> #### "), text), text, F.concat(text, lit("####"), F.col("doc_id").cast("string"), lit("####b")), lit(None),
        lit("<think></think><answer> y </answer>\n"),
    )
    return _documents(spark, sf_dir).select("doc_id", made.alias("text"))


def extract_answer(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", T.answer(F.col("text")).alias("answer"))


def format_reward(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", rewards.format_reward(F.col("text")).alias("reward"))


def split_marker(spark, sf_dir):
    return _tagged(spark, sf_dir).select("doc_id", T.after_marker(F.col("text")).alias("tail"))


def _json(**fields):
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]), {"ignoreNullFields": "false"})


def first_text_key(spark, sf_dir):
    text, none = F.col("text"), F.lit(None).cast("string")
    line = _by_turns("doc_id", _json(text=text, prompt=F.lit("p")), _json(text=F.lit("  "), input=text), _json(prompt=none, question=text), text, F.lit('{"other": 1}'))
    return records.texts_of(_documents(spark, sf_dir).select(F.col("doc_id").alias("idx"), line.alias("line")))


def prompt_answer_defaults(spark, sf_dir):
    text, none = F.col("text"), F.lit(None).cast("string")
    record = _by_turns("doc_id", _json(prompt=text, answer=none), _json(text=text, response=F.lit("r")), _json(prompt=none, text=text), F.lit("{}"))
    return records.prompt_answer(_documents(spark, sf_dir).select(F.col("doc_id").alias("idx"), record.alias("record")))


def completion_texts(spark, sf_dir):
    text = F.col("text")
    made = _by_turns("doc_id", _json(role=F.lit("a"), content=text), _json(role=text), F.to_json(F.array(text)), F.lit('[1, "a", null, true]'), F.lit("5"), F.lit("null"), F.lit('"plain"'))
    return _documents(spark, sf_dir).where("text is not null").select("doc_id", rewards.completion_text(F.parse_json(made)).alias("text")).where("pmod(doc_id, 7) <> 2")


def json_salvage(spark, sf_dir):
    props, lit = F.col("props"), F.lit
    line = _by_turns(
        "event_id", props, F.concat(lit("say "), props, lit(" now")), F.concat(lit("```json "), props, lit(" ```")), lit("nothing"),
        F.concat(lit("```json ["), F.col("event_id").cast("string"), lit("] ```")),
    )
    # counted from 1, for line 0 stands for the file
    return records.salvaged(_table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("idx"), line.alias("line")))


def event_props(spark, sf_dir):
    props = _table(spark, sf_dir, "events").select("event_id", J.parse(F.col("props")).alias("p")).where("p.ok")
    return props.select("event_id", J.field(F.col("p.canon"), "k")["text"].alias("k"))


def timestamp_text(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts_text"))


def entity_spans(spark, sf_dir):
    """Entities of all turns, a dose, a rate and keywords behind each turn's own text."""
    said = F.concat(
        F.coalesce("text", F.lit("")), F.lit(" Take "), F.pmod("conv_id", F.lit(40)).cast("string"), F.lit("mg aspirin or "), F.col("turn").cast("string"),
        F.lit(" ml / day for Fever; "), F.col("turn").cast("string"), F.lit(" x daily, 2.5%, 3次 "),
    )
    found = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(entities.entities(said)).alias("e"))
    return found.select("conv_id", "turn", "e.text", "e.start", "e.end", "e.type")


GENERIC = {"SYMPTOM": ("the", "for"), "DISEASE": ("und", "der"), "DRUG": ("les", "que")}


def entity_counts(spark, sf_dir):
    found = _table(spark, sf_dir, "documents").select(F.explode(entities.texts_by_type(F.col("text"), GENERIC)).alias("type", "texts"))
    return found.groupBy("type").agg(F.sum(F.size("texts")).alias("n"), F.sum(F.length(F.concat_ws("", "texts"))).alias("chars"))


def _vocabulary(spark, sf_dir):
    """A vector of `embeddings` for each token of the conversations, by the token's hash."""
    tokens = _pairs(spark, sf_dir).select(F.explode(F.array("original", "revised")).alias("t")).select(F.explode(T.tokens(F.col("t"))).alias("token")).distinct()
    vectors = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("slot"), F.col("embedding").alias("vector"))
    slots = (vectors.agg(F.max("slot")).first()[0] or 0) + 1
    hashed = F.conv(F.substring(F.md5(F.col("token").cast("binary")), 1, 8), 16, 10).cast("long")
    return tokens.withColumn("slot", F.pmod(hashed, F.lit(slots))).join(vectors, "slot").select("token", "vector")


def _keyed(spark, sf_dir):
    return _pairs(spark, sf_dir).select(F.struct("conv_id", "turn").alias("pair"), "original", "revised")


def entity_similarity(spark, sf_dir):
    rows = _keyed(spark, sf_dir).select("pair", entities.entities(F.col("original")).alias("entities_o"), entities.entities(F.col("revised")).alias("entities_r"))
    return similarity.entity_similarity(rows, _vocabulary(spark, sf_dir), "pair").select("pair.conv_id", "pair.turn", F.round("r_e", 6).alias("r_e"))


def advanced_reward(spark, sf_dir):
    out = rewards.advanced_reward(_keyed(spark, sf_dir), _vocabulary(spark, sf_dir), "pair")
    return out.select("pair.conv_id", "pair.turn", *[F.round(c, 6).alias(c) for c in ("r_e", "r_t", "reward")])


def token_f1(spark, sf_dir):
    out = similarity.token_f1(_keyed(spark, sf_dir), _vocabulary(spark, sf_dir), "pair")
    return out.select("pair.conv_id", "pair.turn", F.round("r_t", 5).alias("r_t"))


def registered_reward(spark, sf_dir):
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("original").alias("prompt"), F.col("revised").alias("completion"))
    return rewards.score_completions(rows, "basic").select("conv_id", "turn", F.round("reward", 6).alias("reward"))


def reward_sum(spark, sf_dir):
    """A basic and a format reward of each reply, every other one between tags."""
    said = F.when(F.col("turn") % 4 == 0, F.concat(F.lit("<think>a</think><answer>"), "revised", F.lit("</answer>"))).otherwise(F.col("revised"))
    rows = _pairs(spark, sf_dir).select("conv_id", "turn", F.col("original").alias("prompt"), said.alias("completion"))
    out = rewards.score_completions(rows, ["basic", lambda prompt, completion: rewards.format_reward(completion)])
    return out.select("conv_id", "turn", F.round("reward", 6).alias("reward"))


def reward_checks(spark, sf_dir):
    """Whether all rewards of a conversation are in range, and any is perfect."""
    fits = F.col("reward").between(0, 1)
    return basic_reward(spark, sf_dir).groupBy("conv_id").agg(F.every(fits).alias("all_valid"), F.some(F.col("reward") == 1).alias("any_perfect"))


def zipped_rewards(spark, sf_dir):
    """The n-th question of a conversation beside its n-th reply, as far as there are both."""
    turns = _table(spark, sf_dir, "conversations")
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "text")))), lambda t: t["text"])
    both = turns.groupBy("conv_id").agg(said("user").alias("asked"), said("assistant").alias("replied"))
    rows = both.select("conv_id", F.posexplode(rewards.zip_shorter(F.col("asked"), F.col("replied"))).alias("pos", "p"))
    return rows.select("conv_id", "pos", F.round(rewards.basic_reward(F.col("p.one"), F.col("p.other")), 6).alias("reward"))


def positional_join(spark, sf_dir):
    """The documents in order beside the passages of the benchmark in order, as far as the shorter table goes."""
    passages = _table(spark, sf_dir, "benchmark").select("item_id")
    return steps.zip_rows(_documents(spark, sf_dir).select("doc_id"), passages, "doc_id", "item_id")


def first_message(spark, sf_dir):
    messages = chat.conversations_to_messages(_table(spark, sf_dir, "conversations"))
    return messages.select("conv_id", rewards.first_content(F.col("messages")).alias("content"))


def failed_batches(spark, sf_dir):
    """The baseline where every fifth batch has a reward that couldn't be had."""
    lost = (F.floor(F.col("idx") / BATCH) % 5 == 2) & (F.col("idx") % BATCH == 1)
    scored = _indexed(spark, sf_dir).withColumn("reward", F.when(~lost, F.col("reward")))
    return steps.ema(steps.batch_stats(scored, BATCH)).select("step", F.round("reward_mean", 6).alias("reward_mean"), F.round("baseline", 6).alias("baseline"))


def token_ids(spark, sf_dir):
    docs = _documents(spark, sf_dir)
    known = docs.select(F.explode(T.tokens(F.col("text"))).alias("token")).distinct()
    ids = chat.encoded(docs, steps.with_index(known, "token", name="id"))
    return ids.select("doc_id", F.size("input_ids").cast("long").alias("n_ids"), F.md5(F.concat_ws(" ", "input_ids").cast("binary")).alias("ids_md5"), F.size("attention_mask").cast("long").alias("n_mask"))


def sorted_names(spark, sf_dir):
    names = sampling.sorted_values(_table(spark, sf_dir, "documents"), "lang", "source")
    return names.select("lang", F.concat_ws(",", "source").alias("names"))


def missing_tokens(spark, sf_dir):
    """The distinct tokens of a question that its reply lacks."""
    missing = F.array_sort(F.array_except(T.tokens(F.col("original")), T.tokens(F.col("revised"))))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.concat_ws(" ", missing).alias("missing"))


def cosine_pairs(spark, sf_dir):
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    after = vectors.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return vectors.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("next")), 5).alias("cosine"))


def greedy_f1(spark, sf_dir):
    groups = _table(spark, sf_dir, "embeddings").groupBy(F.floor(F.col("vec_id") / 8).alias("g")).agg(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))).alias("v"))
    halves = groups.select("g", *[F.transform(F.slice("v", a, 4), lambda s: s["embedding"]).alias(c) for a, c in ((1, "x"), (5, "y"))])
    return halves.select("g", F.round(V.greedy_f1(F.col("x"), F.col("y")), 5).alias("f1"))


def sequence_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.round(similarity.sequence_ratio(F.col("original"), F.col("revised")), 6).alias("ratio"))


def token_alignment(spark, sf_dir):
    aligned = similarity.align(T.tokens(F.col("original")), T.tokens(F.col("revised")))
    return _pairs(spark, sf_dir).select("conv_id", "turn", F.posexplode(aligned).alias("pos", "a")).select("conv_id", "turn", "pos", "a.o", "a.r")


def accuracy_reward(spark, sf_dir):
    """Prices in cents as answers in four forms, every third one wrong by a cent."""
    cents, lit = F.round(F.col("o_totalprice") * 100).cast("long"), F.lit
    hundreds, rest = F.floor(cents / 100).cast("string"), F.lpad(F.pmod(cents, lit(100)).cast("string"), 2, "0")
    said = _by_turns(
        "o_orderkey", F.concat(lit("so <answer>"), hundreds, lit("."), rest, lit("</answer> 7")), F.concat(lit("\\boxed{x=\\frac{"), cents.cast("string"), lit("}{100}}")),
        F.concat(cents.cast("string"), lit("/100")), F.concat(F.format_number(F.floor(cents / 100), 0), lit("."), rest, lit("\\text{ dollars}")),
    )
    wanted = cents + F.when(F.pmod("o_orderkey", lit(3)) == 0, 1).otherwise(0)
    exact = F.concat(F.floor(wanted / 100).cast("string"), lit("."), F.lpad(F.pmod(wanted, lit(100)).cast("string"), 2, "0"))
    gold = F.when(F.pmod("o_orderkey", lit(4)) == 0, F.concat(lit("so #### "), exact)).otherwise(exact)
    return _table(spark, sf_dir, "orders").select("o_orderkey", rewards.accuracy_reward(said, gold).alias("reward"))


def sample_n(spark, sf_dir):
    return sampling.sample_n(_table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50)


def split_90_10(spark, sf_dir):
    return sampling.split(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


def trainable_weights(spark, sf_dir):
    scores = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("r_e"), (F.col("l_tax") * 10).alias("r_t"))
    weights = steps.FusionWeights(0.75, 0.25)
    return scores.select("l_orderkey", "l_linenumber", F.round(weights.forward(F.col("r_e"), F.col("r_t")), 6).alias("reward"))


def question_prompts(spark, sf_dir):
    bench = _table(spark, sf_dir, "benchmark")
    return bench.select("item_id", F.explode(chat.question_prompt(F.col("text"))).alias("m")).select("item_id", "m.role", "m.content")


def jsonl_export(spark, sf_dir):
    return sinks.as_json(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", "text"))


_NAMES = (
    basic_reward, basic_reward_batch_stats, ema_baseline, failed_batches, advantage, epoch_batches, chat_template, bounded_text, token_length_filter, token_ids, normalize_text,
    strip_text, ordered_dedup, extract_answer, format_reward, split_marker, first_text_key, prompt_answer_defaults, completion_texts, json_salvage, event_props, timestamp_text,
    entity_spans, entity_counts, entity_similarity, advanced_reward, token_f1, registered_reward, reward_sum, reward_checks, zipped_rewards, positional_join, first_message,
    sorted_names, missing_tokens, cosine_pairs, greedy_f1, sequence_ratio, token_alignment, accuracy_reward, sample_n, split_90_10, trainable_weights, question_prompts, jsonl_export,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


def _q(text: str | None) -> str:
    return "NULL" if text is None else "'" + text.replace("'", "''") + "'"


_WS = " || ".join(f"chr({ord(c)})" for c in T.WHITE)
_TOKENS = "regexp_extract_all(lower({0}), '" + T.TOKEN.replace("{", "{{").replace("}", "}}") + "')"


def _scored(revised: str = "a.text") -> str:
    """`scored`: the basic reward of each question and its reply, as `revised` has it."""
    return f"""
pairs AS (
  SELECT u.conv_id, u.turn, u.text AS o, {revised} AS r FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant'
), tok AS (
  SELECT *, trim(o, {_WS}) AS so, trim(r, {_WS}) AS sr, list_distinct({_TOKENS.format("o")}) AS x, list_distinct({_TOKENS.format("r")}) AS y FROM pairs
), scored AS (
  SELECT conv_id, turn, r, x, y, CASE WHEN so = sr THEN 1.0::DOUBLE WHEN sr = '' THEN 0.05::DOUBLE
    WHEN len(x) + len(y) = 0 THEN 0.5::DOUBLE
    ELSE (1.0::DOUBLE + len(list_intersect(x, y))::DOUBLE / (len(x) + len(y) - len(list_intersect(x, y)))) / 2.0::DOUBLE END AS reward FROM tok
)"""


_SCORED = f"{_scored()}, placed AS (SELECT *, row_number() OVER (ORDER BY conv_id, turn) - 1 AS idx FROM scored)"
_STATS = f"{_SCORED}, stats AS (SELECT CAST(idx // {BATCH} AS BIGINT) AS step, avg(reward) AS reward_mean, min(reward) AS reward_min, max(reward) AS reward_max, count(*) AS n FROM placed GROUP BY 1)"
# weights of earlier means: b_t = sum over s <= t of 0.1 * 0.9 ** (t - s) * m_s
_EMA = f"{_STATS}, ema AS (SELECT t.step, sum(0.1::DOUBLE * pow(0.9::DOUBLE, t.step - s.step) * s.reward_mean) AS baseline FROM stats t JOIN stats s ON s.step <= t.step GROUP BY t.step)"
# a failed batch has no place among the k batches that count
_FAILED = f"""{_STATS}, marked AS (SELECT step, CASE WHEN step % 5 <> 2 OR n < 2 THEN reward_mean END AS m FROM stats),
  counted AS (SELECT step, m, count(m) OVER (ORDER BY step) AS k FROM marked)
  SELECT t.step, round(any_value(t.m), 6) AS reward_mean, round(coalesce(sum(0.1::DOUBLE * pow(0.9::DOUBLE, t.k - s.k) * s.m), 0), 6) AS baseline
  FROM counted t LEFT JOIN counted s ON s.step <= t.step AND s.m IS NOT NULL GROUP BY t.step"""
_MD5_ORDER = "md5(CAST(doc_id AS VARCHAR) || ':42'), doc_id"
_TAGGED = """tagged AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN '<think>a</think><answer>' || text || '</answer>' WHEN 1 THEN '<think>' || text || '</think><answer>x</answer>' || chr(10)
  WHEN 2 THEN 'x <answer> 1 </answer><answer>2</answer> #### ' || text WHEN 3 THEN text WHEN 4 THEN text || '####' || doc_id || '####b'
  WHEN 6 THEN '<think></think><answer> y </answer>' || chr(10) END AS text FROM documents)"""


def _spans() -> str:
    """Matches of each rule and the gaps between them, whose lengths give the places."""
    said = "coalesce(text, '') || ' Take ' || (conv_id % 40) || 'mg aspirin or ' || turn || ' ml / day for Fever; ' || turn || ' x daily, 2.5%, 3次 '"
    rules = " UNION ALL ".join(
        f"SELECT conv_id, turn, {_q(kind)} AS type, regexp_extract_all(t, {_q('(?i)' + pattern)}) AS m, string_split_regex(t, {_q('(?i)' + pattern)}) AS g FROM said" for kind, pattern in entities.rules()
    )
    return f"""WITH said AS (SELECT conv_id, turn, {said} AS t FROM conversations), hits AS ({rules}), each AS (SELECT *, unnest(range(1, len(m) + 1)) AS k FROM hits),
      placed AS (SELECT conv_id, turn, type, m[k] AS text, CAST(length(array_to_string(g[1:k], '')) + length(array_to_string(m[1:k - 1], '')) AS INTEGER) AS start FROM each)
      SELECT conv_id, turn, text, start, CAST(start + length(text) AS INTEGER) AS "end", type FROM placed"""


def oracle_sql() -> dict[str, str]:
    found = "CASE WHEN regexp_matches(text, '(?s)<answer>.*?</answer>') THEN regexp_extract(text, '(?s)<answer>(.*?)</answer>', 1) ELSE text END"
    full = f"nullif(trim(text, {_WS}), '')"
    counts = " UNION ALL ".join(
        f"SELECT '{k}' AS type, w FROM (SELECT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}\\p{{M}}_]+')) AS w FROM documents) WHERE w IN ({', '.join(_q(x) for x in w)})"
        for k, w in GENERIC.items()
    )
    cos = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"
    best = "list_avg([list_max([" + cos.format("p", "q") + " FOR q IN {1}]) FOR p IN {0}])"
    said = "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos, text FROM conversations WHERE role = "
    tagged = "CASE WHEN u.turn % 4 = 0 THEN '<think>a</think><answer>' || a.text || '</answer>' ELSE a.text END"
    form = r"CASE WHEN regexp_matches({0}, '^<think>[^\n]*?</think><answer>[^\n]*?</answer>\n?$') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    return {
        "basic_reward": f"WITH {_SCORED} SELECT conv_id, turn, round(reward, 6) AS reward FROM scored",
        "basic_reward_batch_stats": f"WITH {_STATS} SELECT step, round(reward_mean, 6) AS reward_mean, round(reward_min, 6) AS reward_min, round(reward_max, 6) AS reward_max, n FROM stats",
        "ema_baseline": f"WITH {_EMA} SELECT step, round(baseline, 6) AS baseline FROM ema",
        "failed_batches": f"WITH {_FAILED}",
        "advantage": f"WITH {_EMA} SELECT conv_id, turn, round(reward - baseline, 5) AS advantage FROM placed JOIN ema ON ema.step = placed.idx // {BATCH}",
        "epoch_batches": f"WITH {_SCORED} SELECT CAST(epoch AS INTEGER) AS epoch, CAST(idx // {BATCH} + 1 AS BIGINT) AS batch_idx, greatest(1, (SELECT count(*) FROM placed) // {BATCH}) AS steps_per_epoch, count(*) AS n, round(avg(reward), 6) AS reward_mean FROM placed, range(2) e(epoch) GROUP BY 1, 2",
        "chat_template": f"""SELECT conv_id, trim(coalesce(string_agg(CASE role WHEN 'user' THEN '### Human:' || chr(10) || coalesce(text, 'None') || chr(10) || chr(10)
            WHEN 'assistant' THEN '### Assistant:' || chr(10) || coalesce(text, 'None') || chr(10) || chr(10) END, '' ORDER BY turn), ''), {_WS}) AS text FROM conversations GROUP BY conv_id""",
        "bounded_text": "SELECT doc_id, CASE WHEN length(text) > 2000 THEN substring(text, 1, 2000) || '...' ELSE text END AS text FROM documents",
        "token_length_filter": f"WITH t AS (SELECT doc_id, list_slice({_TOKENS.format('text')}, 1, 2048) AS x FROM documents) SELECT doc_id, len(x) AS n_tokens, md5(array_to_string(x, ' ')) AS tokens_md5 FROM t WHERE len(x) BETWEEN 1 AND 2048",
        "token_ids": f"""WITH t AS (SELECT doc_id, {_TOKENS.format('coalesce(text, chr(0))')} AS x, text FROM documents), words AS (SELECT doc_id, unnest(x) AS token, generate_subscripts(x, 1) AS pos FROM t WHERE text IS NOT NULL),
            known AS (SELECT token, row_number() OVER (ORDER BY token) - 1 AS id FROM (SELECT DISTINCT token FROM words)),
            ids AS (SELECT doc_id, list(id ORDER BY pos) AS ids FROM words JOIN known USING (token) WHERE pos <= 2048 GROUP BY doc_id)
            SELECT doc_id, coalesce(len(ids), 0) AS n_ids, md5(coalesce(array_to_string(ids, ' '), '')) AS ids_md5, coalesce(len(ids), 0) AS n_mask FROM documents LEFT JOIN ids USING (doc_id)""",
        "normalize_text": f"SELECT page_id, coalesce(regexp_replace(lower(trim(html, {_WS})), '[' || {_WS} || ']+', ' ', 'g'), '') AS text FROM pages",
        "strip_text": f"SELECT doc_id, trim(chr(12288) || ' ' || chr(9) || text || chr(28) || chr(133) || chr(8195) || chr(10), {_WS}) AS text FROM documents",
        "ordered_dedup": "SELECT doc_id, lang, source, md5(text) AS text_md5 FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id, lang, source, n_chars) AS place FROM documents) WHERE place = 1",
        "extract_answer": f"WITH {_TAGGED} SELECT doc_id, coalesce(trim({found}, {_WS}), '') AS answer FROM tagged",
        "format_reward": f"WITH {_TAGGED} SELECT doc_id, {form.format('text')} AS reward FROM tagged",
        "split_marker": f"WITH {_TAGGED} SELECT doc_id, CASE WHEN instr(text, '####') > 0 THEN substring(text, instr(text, '####') + 4) ELSE text END AS tail FROM tagged",
        "first_text_key": f"SELECT doc_id AS idx, CASE doc_id % 5 WHEN 0 THEN coalesce({full}, 'p') ELSE {full} END AS text FROM documents WHERE doc_id % 5 = 0 OR doc_id % 5 < 4 AND {full} IS NOT NULL",
        "prompt_answer_defaults": """SELECT doc_id AS idx, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN text WHEN 2 THEN NULL ELSE '' END AS prompt,
            CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'r' ELSE '' END AS answer FROM documents""",
        "completion_texts": """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN text WHEN 1 THEN '' WHEN 3 THEN '[1, ''a'', None, True]' WHEN 4 THEN '5' WHEN 5 THEN 'None' ELSE 'plain' END AS text
            FROM documents WHERE doc_id % 7 <> 2 AND text IS NOT NULL""",
        "json_salvage": """SELECT event_id + 1 AS idx, CASE event_id % 5 WHEN 4 THEN '[' || event_id || ']' ELSE props END AS record, CASE event_id % 5 WHEN 0 THEN 'line' WHEN 4 THEN 'fence' ELSE 'braces' END AS how
            FROM events WHERE event_id % 5 <> 3""",
        "event_props": "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE json_valid(props)",
        "timestamp_text": "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_text FROM events",
        "entity_spans": _spans(),
        "entity_counts": f"SELECT type, count(*) AS n, CAST(sum(length(w)) AS BIGINT) AS chars FROM ({counts}) GROUP BY type",
        "token_f1": f"""WITH {_scored()}, slots AS (SELECT max(vec_id) + 1 AS n FROM embeddings), raw AS (SELECT conv_id, turn, {_TOKENS.format('o')} AS x, {_TOKENS.format('r')} AS y FROM pairs),
            words AS (SELECT conv_id, turn, 1 AS side, unnest(x) AS w, generate_subscripts(x, 1) AS pos FROM raw UNION ALL SELECT conv_id, turn, 2, unnest(y), generate_subscripts(y, 1) FROM raw),
            sides AS (SELECT conv_id, turn, list(embedding ORDER BY pos) FILTER (side = 1) AS x, list(embedding ORDER BY pos) FILTER (side = 2) AS y
              FROM words, slots JOIN embeddings ON vec_id = CAST('0x' || substring(md5(w), 1, 8) AS BIGINT) % n GROUP BY 1, 2),
            f AS (SELECT conv_id, turn, {best.format('y', 'x')} AS f_p, {best.format('x', 'y')} AS f_r FROM sides WHERE x IS NOT NULL AND y IS NOT NULL)
            SELECT conv_id, turn, round(CASE WHEN f_p IS NULL OR f_r IS NULL OR f_p + f_r = 0 THEN 0.0 ELSE 2 * f_p * f_r / (f_p + f_r) END, 5) AS r_t FROM pairs LEFT JOIN f USING (conv_id, turn)""",
        "registered_reward": f"WITH {_scored()} SELECT conv_id, turn, round(reward, 6) AS reward FROM scored",
        "reward_sum": f"WITH {_scored(tagged)} SELECT conv_id, turn, round(reward + {form.format('r')}, 6) AS reward FROM scored",
        "reward_checks": f"WITH {_scored()} SELECT conv_id, bool_and(reward BETWEEN 0 AND 1) AS all_valid, bool_or(round(reward, 6) = 1) AS any_perfect FROM scored GROUP BY conv_id",
        "zipped_rewards": f"""WITH {_scored().replace("FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1", f"FROM ({said}'user') u JOIN ({said}'assistant') a ON a.conv_id = u.conv_id AND a.pos = u.pos")
            .replace("u.turn,", "u.pos AS turn,").replace("WHERE u.role = 'user' AND a.role = 'assistant'", "")}
            SELECT conv_id, CAST(turn - 1 AS INTEGER) AS pos, round(reward, 6) AS reward FROM scored""",
        "positional_join": """SELECT d.idx, doc_id, item_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS idx FROM documents) d
            JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS idx FROM benchmark) b ON d.idx = b.idx""",
        "first_message": "SELECT conv_id, first(text ORDER BY turn) AS content FROM conversations GROUP BY conv_id",
        "sorted_names": "SELECT lang, array_to_string(list_sort(list(DISTINCT source)), ',') AS names FROM documents GROUP BY lang",
        "missing_tokens": f"WITH {_scored()} SELECT conv_id, turn, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS missing FROM scored",
        "cosine_pairs": f"SELECT a.vec_id, round({cos.format('a.embedding', 'b.embedding')}, 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1",
        "greedy_f1": f"""WITH g AS (SELECT vec_id // 8 AS g, list(embedding ORDER BY vec_id) AS v FROM embeddings GROUP BY 1), h AS (SELECT g, v[1:4] AS x, v[5:8] AS y FROM g),
            s AS (SELECT g, {best.format('x', 'y')} AS p, {best.format('y', 'x')} AS r FROM h)
            SELECT g, round(CASE WHEN p IS NULL OR r IS NULL OR p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 5) AS f1 FROM s""",
        "accuracy_reward": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS reward FROM orders",
        "sample_n": f"SELECT doc_id, lang FROM documents ORDER BY {_MD5_ORDER} LIMIT 50",
        "split_90_10": f"SELECT doc_id, row_number() OVER (ORDER BY {_MD5_ORDER}) <= ceil(0.1 * (SELECT count(*) FROM documents)) AS is_test FROM documents",
        "trainable_weights": "SELECT l_orderkey, l_linenumber, round(0.75::DOUBLE * (l_discount * 10) + 0.25::DOUBLE * (l_tax * 10), 6) AS reward FROM lineitem",
        "question_prompts": f"SELECT item_id, role, CASE role WHEN 'system' THEN {_q(chat.SYSTEM_PROMPT)} ELSE text END AS content FROM benchmark, (VALUES ('system'), ('user')) AS r(role)",
        "jsonl_export": "SELECT CAST(to_json({'doc_id': doc_id, 'lang': lang, 'source': source, 'n_chars': n_chars, 'text': text}) AS VARCHAR) AS value FROM documents",
    }
