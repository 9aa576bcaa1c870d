"""Token ids in ORC files, in ascending document order.

ORC keeps integer columns run-length encoded, with a row index every ``stride`` rows and Bloom
filters on doc_id in each stripe; readers take stripes in parallel and skip those whose minimum,
maximum or filter rule a document out. Files are named by their partition, which follows the range
partitioning on doc_id, so part numbers, files and rows are all in ascending order.

Nulls: a null text is empty; null doc_ids come first. Ties between equal doc_ids are broken by the
text's hash, then by the row's place in the input. Empty tables give empty files.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, own_columns
from lamina.llm.prefix import with_base
from lamina.llm.wordbpe import encoder

SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, partitions: int | None = None, stripe_bytes: int = 64 << 20, stride: int = 10_000, bloom_fpp: float = 0.01) -> None:
    """Encode every whole text and write it. partitions: files; by default as many as shuffle partitions."""
    spark = docs.sparkSession
    docs = own_columns(docs, "doc_id", "text").withColumns({"tie": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "tie", "row").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie", "row").select("doc_id", "text")

    def encode(batches):
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for whole in batches:
            for batch, ids, ends in encode.batches(whole, end_id):
                starts = np.r_[0, ends[:-1]]
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids.view("<i4")))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(np.full(len(ends), part, np.int32)), pa.array(before + starts), pa.array(ends - starts), lists], ["doc_id", "part", "before", "n_tokens", "ids"])
                before += int(ends[-1])

    options = {"compression": "zstd", "orc.stripe.size": str(stripe_bytes), "orc.create.index": "true", "orc.row.index.stride": str(stride), "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": str(bloom_fpp)}
    ordered.mapInArrow(encode, SCHEMA).write.options(**options).orc(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """The files' rows with ``start``: the ids of all documents before."""
    df = with_base(spark.read.schema(SCHEMA).orc(path), "n_tokens")
    return df.select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids")


def lookup(spark: SparkSession, path: str, doc_id: int) -> DataFrame:
    """The ids of one document. The filter goes to the ORC reader, which skips stripes by statistics and Bloom filter."""
    return spark.read.schema(SCHEMA).orc(path).filter(F.col("doc_id") == doc_id).select("doc_id", "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens as counted in the file, ids_crc32 of the ids in the file."""

    def digest(batches):
        for batch in batches:
            ids = batch.column("ids")
            values, offsets = np.asarray(ids.values).astype("<u4"), np.asarray(ids.offsets).tolist()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Write, read back, and delete the files again."""
    scratch = Scratch(docs.sparkSession)
    write(docs, path := scratch.folder(), tokenizer, end_id)
    return scratch.keep(checksums(read(docs.sparkSession, path)))
