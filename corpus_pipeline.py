"""From documents to packed sequences: quality rules, near-duplicate removal, substring dedup, secret masking, packing.

Each stage takes (spark, docs, sf_dir) and all that its predecessor kept; all but the last return the
columns of documents. run() writes each stage's rows to the shared folder and reads them back; once the next stage's are there they go.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import jaccard, packing, passages, quality, secrets
from lamina.llm.common import Scratch, by_place


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the line labels keep. The labels' documents are read from the corpus.

    A null text goes, as it has no words; repeated rows stay or go together; see quality.kept().
    """
    field = quality.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.kept(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays. Null and empty texts are alike to none, but repeats of one doc_id and text count once; see jaccard.kept()."""
    return jaccard.kept(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of a smaller doc_id has are cut out. Rows with a null doc_id or text stay; see passages.cut()."""
    return passages.cut(docs)


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by a mark; no document goes. A null text stays null; repeated rows are masked alike; texts of any length are scanned whole."""
    names, kinds = docs.columns, dict(docs.dtypes)

    def run(batches):
        for batch in batches:
            columns = dict(zip(names, batch.columns))
            texts = [t if t is None else secrets.masked(t) for t in columns["text"].to_pylist()]
            new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([None if t is None else len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([new.get(n, c) for n, c in columns.items()], names)

    return by_place(docs).mapInArrow(run, ", ".join(f"`{n}` {'long' if n == 'n_chars' else kinds[n]}" for n in names))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids. A null text counts as empty and a null doc_id is kept; repeated rows are packed each; see packing.pieces()."""
    import public_tokenizers

    return packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_masks", secret_masks),
    ("packing", pack),
]
#: A trained field and hashed signatures have no SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, scratch.written(stage(spark, docs, sf_dir))
        scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
