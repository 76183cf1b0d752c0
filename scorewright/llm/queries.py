"""The opN queries: production parameters over whole tables, and the columns of their contracts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk import exact_top_k

    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return exact_top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_table(spark, sf_dir, "documents"), 8)


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .passages import repeated_passages

    return repeated_passages(_table(spark, sf_dir, "documents"))


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fingerprint import fingerprint_documents

    return fingerprint_documents(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents"), 75)


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import round_trips

    return round_trips(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import score_toxicity

    return score_toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .packing import pack_documents

    files = (public_tokenizers.path(f"byte_bpe_50k.{x}") for x in ("json", "tiktoken"))
    return pack_documents(_table(spark, sf_dir, "documents"), *files)


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licenses import scan_licenses

    return scan_licenses(_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language import identify_language

    return identify_language(_table(spark, sf_dir, "documents"))


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op4 gives that SQL can express: the lengths and the digests of the edited texts."""
    from .fingerprint import fingerprint_edits

    return fingerprint_edits(_table(spark, sf_dir, "documents")).select("doc_id", "n_chars", "edited_sha256")


def fingerprint_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups of documents that op4 links."""
    from .fingerprint import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def sharding_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laws of op2, shard by shard: rows, slots without gaps, all bytes; and how many texts are in more shards than they need, if over 16."""
    placed = op2_sharding(spark, sf_dir)
    shards = placed.groupBy("shard").agg(
        F.count("*").alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.countDistinct("slot").alias("slots"), F.sum("size").alias("bytes")
    )
    groups = placed.groupBy("text_crc32", "size").agg(F.countDistinct("shard").alias("shards"), F.count("*").alias("n"))
    least = F.ceil(F.col("n") / F.lit(max(1, placed.count() // 8)))
    cut = groups.agg(F.greatest(F.count(F.when(F.col("shards") > least, 1)) - 16, F.lit(0)).alias("cut"))
    total = shards.agg(F.sum("bytes").alias("all_bytes"))
    return shards.select("shard", "n", "first_slot", "last_slot", "slots").join(F.broadcast(total)).join(F.broadcast(cut))


def piece_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of the texts that op6's ids decode to."""
    import public_tokenizers

    from .pieces import decode_documents, encode_documents

    model = public_tokenizers.path("piece_bpe_32k.model")
    back = decode_documents(encode_documents(_table(spark, sf_dir, "documents"), model), model)
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


def packing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The laws of op8: all documents, ids in no piece or in two, sequences with a gap or over 2048 ids."""
    pieces = op8_packing(spark, sf_dir)
    docs = pieces.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("tokens"), F.max(F.col("start") + F.col("length")).alias("last"), F.countDistinct("start").alias("starts"), F.count("*").alias("pieces"))
    lost = docs.agg(F.count("*").alias("documents"), F.count(F.when((F.col("n") != F.col("tokens")) | (F.col("last") != F.col("tokens")) | (F.col("starts") != F.col("pieces")), 1)).alias("lost"))
    sequences = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("last"), F.countDistinct("offset").alias("offsets"), F.count("*").alias("pieces"))
    ragged = sequences.agg(F.count(F.when((F.col("n") != F.col("last")) | (F.col("n") > 2048) | (F.col("offsets") != F.col("pieces")), 1)).alias("ragged"))
    return lost.join(F.broadcast(ragged))


_QUERIES = (
    op1_exact_top_k, op2_sharding, op3_substring_dedup, op4_document_fingerprints, op5_minhash_near_dedup, op6_sentencepiece, op7_toxicity, op8_packing, op9_license_scan, op10_language_id,
    edited_texts, fingerprint_groups, sharding_summary, piece_round_trips, packing_summary,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_OP1 = """
WITH raw AS (
  SELECT vec_id, [CAST(floor(64.0::DOUBLE * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[]) AS BIGINT) AS score
  FROM raw q JOIN raw c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
), placed AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
) SELECT query_id, rank, vec_id, score FROM placed WHERE rank <= 20
"""


# links by shared shingles, and what each document reaches by them
_GROUPS = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM split
), items AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS common FROM items a JOIN items b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (SELECT a, b FROM shared WHERE 100 * common >= 75 * (n - common)
), ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
), grouped AS (SELECT a AS doc_id, min(b) AS component_id, count(*) AS members FROM reach GROUP BY 1)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_top_k": _OP1,
        "op5_minhash_near_dedup": f"{_GROUPS} SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN grouped USING (doc_id)",
        "edited_texts": """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
            f AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id), first_value(text) OVER (ORDER BY doc_id)) AS after FROM t)
            SELECT doc_id, n AS n_chars, sha256(substring(text, 1, n - n // 4) || substring(after, 1, n // 4)) AS edited_sha256 FROM f""",
        "fingerprint_groups": f"{_GROUPS} SELECT doc_id, component_id AS group_id FROM grouped",
        "sharding_summary": """WITH d AS (SELECT count(*) AS n, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS all_bytes FROM documents),
            s AS (SELECT CAST(range AS INTEGER) AS shard, CAST(n // 8 + CASE WHEN range < n % 8 THEN 1 ELSE 0 END AS BIGINT) AS n, all_bytes FROM range(8), d)
            SELECT shard, n, CAST(0 AS BIGINT) AS first_slot, n - 1 AS last_slot, n AS slots, all_bytes, CAST(0 AS BIGINT) AS cut FROM s WHERE n > 0""",
        "piece_round_trips": "SELECT doc_id, md5(replace(coalesce(text, ''), chr(9601), ' ')) AS text_md5 FROM documents",
        "packing_summary": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS lost, CAST(0 AS BIGINT) AS ragged FROM documents",
    }
