"""An extension: files that keep coming are fingerprinted and bucketed as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lamina.functions import columns as C
from lamina.operators import analyze

SCHEMA = "doc_id long, text string"


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    marks = analyze.fingerprints(rows.withColumn("content", F.encode("text", "UTF-8")), "doc_id", "content")
    return rows.join(marks, "doc_id").select("doc_id", "simhash64", analyze.bucket(F.col("simhash64"), buckets).alias("bucket"), F.octet_length("text").cast("long").alias("size"), analyze.is_text(C.latin1(F.col("text"))).alias("is_text"))


def ingest(spark: SparkSession, source: str, out: str, checkpoint: str, buckets: int = 16) -> StreamingQuery:
    """New Parquet files below ``source`` -> rows in ``out``, by bucket. A batch that is run again overwrites its own folder only, so each file counts once."""
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(source)

    def one(batch: DataFrame, number: int) -> None:
        bucketed(batch, buckets).write.mode("overwrite").partitionBy("bucket").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
