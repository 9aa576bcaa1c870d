"""Directory trees and JSON lines as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "kind string, rel string, error string, bucket int, bucket_type string, layer_id string, codec_text string, archive string, archive_offset long, archive_length long, in_size long, out_size long, sha256 string, in_sha256 string, blob_sha256 string, bucket_resources array<string>"


def _empty(spark: SparkSession, folder: str) -> list[str]:
    """Paths of empty files, which Spark's file sources pass over."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            out.append(f.getPath().toUri().getPath())
    return out


def tree(spark: SparkSession, folder: str) -> DataFrame:
    """rel, size, content of all files below a folder, empty ones too."""
    start = folder.rstrip("/").split("://", 1)[-1] + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    empty = spark.createDataFrame([(p,) for p in _empty(spark, folder)], "path string").select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("content"))
    rows = files.select("path", "length", "content").unionByName(empty)
    return rows.select(F.substring_index("path", start, -1).alias("rel"), F.col("length").alias("size"), "content")


def json_lines(spark: SparkSession, path: str, schema: str = MANIFEST) -> DataFrame:
    """Records of a JSON-lines file. Lines that are blank, broken or no objects are left out."""
    raw = spark.read.text(path).filter("trim(value) <> ''")
    parsed = F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return raw.select(parsed.alias("r")).filter("r is not null and r._bad is null").select("r.*").drop("_bad")


def file_records(manifest: DataFrame) -> DataFrame:
    return manifest.filter("rel <> '' and error is null and kind is null")


def bucket_summaries(manifest: DataFrame) -> DataFrame:
    return manifest.filter("kind = 'bucket_summary'")
