"""Queries opN_<name>: each operator with production parameters over the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import bpe, chat, jaccard, orcids, packing, passages, quality, ring, secrets, topk
from lamina.llm.common import documents, written


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(documents(spark, sf_dir))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=1)


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 5, 50)


def op4_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orcids.round_trip(documents(spark, sf_dir), _tokenizer("word_bpe_49k.json"), end_id=2)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality.judged(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(documents(spark, sf_dir))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.read_back(written(chat.formatted(turns.unionByName(probe))))


def op8_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.sharded(documents(spark, sf_dir), 40)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(documents(spark, sf_dir), _tokenizer("byte_bpe_50k.json"))


def base_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5_quality's columns but for the field's verdict, which SQL has not."""
    return quality.judged(documents(spark, sf_dir), quality.LineField()).drop("kept", "content_share")


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9_secrets' counts of the base patterns."""
    return secrets.scanned(documents(spark, sf_dir)).select("doc_id", "n_assign", "n_access", "n_hex")


def shard_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each shard of op8_ring; shards with one row more than others come first."""
    return op8_ring(spark, sf_dir).groupBy("shard").agg(F.count("*").alias("n"), F.max("slot").alias("last_slot"))


SQL = {
    "op3_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v FROM embeddings),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5""",
    "base_rules": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT doc_id, generate_subscripts(w, 1) AS i, list_transform(range(1, len(w) + 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS grams, len(w) AS n FROM w), u AS (SELECT doc_id, i, grams[i] AS gram FROM g WHERE i <= n - 2),
 c AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS k FROM u) WHERE k > 1), p AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM c) GROUP BY 1)
 SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(p.n, 0)::BIGINT AS n_repeat_words, len(w) < 50 OR 100 * coalesce(p.n, 0) > 50 * len(w) AS base_failed FROM w LEFT JOIN p ON w.doc_id = p.doc_id""",
    "secret_counts": r"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 12))::BIGINT AS n_assign,
 len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 18))::BIGINT AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 16))::BIGINT AS n_hex FROM documents""",
    "shard_sizes": "SELECT s::INT AS shard, n, n - 1 AS last_slot FROM (SELECT s, ((SELECT count(*) FROM documents) // 40 + (s < (SELECT count(*) FROM documents) % 40)::INT)::BIGINT AS n FROM (SELECT unnest(range(40)) AS s))",
}


def queries() -> dict:
    own = {f.__name__: f for f in (base_rules, secret_counts, shard_sizes)}
    return {name: f for name, f in globals().items() if name.startswith("op")} | own


def oracle_sql() -> dict[str, str]:
    return SQL
