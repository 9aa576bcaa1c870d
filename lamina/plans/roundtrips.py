"""Queries that encode, decode and compare: rows whose bytes SQL can't make, but whose results it can."""

from __future__ import annotations

from pyspark.sql import functions as F

from lamina.kernels import arrow
from lamina.operators import analyze
from lamina.plans.catalogue import docs

QUERIES: dict = {}
SQL: dict[str, str] = {}

PAIRS = [("bytes", "raw"), ("bytes", "zlib"), ("bytes", "zstd"), ("bytes", "zstd_tight"), ("bytes", "huffman"), ("vc0", "zlib"), ("syllables_it", "zlib"), ("words_it", "zstd"), ("lines_dict", "zlib"), ("lines_rle", "zlib"), ("split_text_nums", "zlib"), ("tpl_lines_v0", "zstd"), ("tpl_lines_shared_v0", "zlib")]


def _round_trip(layer: str, codec: str):
    def run(spark, d):
        content = docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
        coded = content.select("doc_id", F.sha2("content", 256).alias("sha"), arrow.encode(layer, codec)("content").alias("blob"))
        return coded.select("doc_id", "sha", (F.sha2(arrow.decode()("blob"), 256) == F.col("sha")).alias("restored"), F.startswith(F.col("blob"), F.lit(b"GCC\x06")).alias("framed"))

    return run


for _layer, _codec in PAIRS:
    QUERIES[f"rt_{_layer}_{_codec}"] = _round_trip(_layer, _codec)
    SQL[f"rt_{_layer}_{_codec}"] = "SELECT doc_id, sha256(encode(text)) AS sha, true AS restored, true AS framed FROM documents"


def _older(write):
    from lamina.kernels import legacy

    def run(spark, d):
        content = docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
        coded = content.select("doc_id", F.sha2("content", 256).alias("sha"), arrow.column(write)("content").alias("blob"))
        return coded.select("doc_id", "sha", (F.sha2(arrow.column(legacy.read)("blob"), 256) == F.col("sha")).alias("restored"))

    return run


def _old_queries() -> dict:
    from functools import partial

    from lamina.kernels import legacy

    writers = {f"rt_version{v}": partial(legacy.write, v) for v in (1, 2, 3, 4)}
    return writers | {f"rt_version5_{layer}_{codec}": partial(legacy.write_5, layer=layer, codec=codec) for layer, codec in (("bytes", "huffman"), ("vc0", "huffman"), ("words_it", "huffman"), ("syllables_it", "zstd"), ("lines_dict", "zstd_tight"))}


for _name, _write in _old_queries().items():
    QUERIES[_name] = _older(_write)
    SQL[_name] = "SELECT doc_id, sha256(encode(text)) AS sha, true AS restored FROM documents"


def simhash64_blake2b(spark, d):
    """The same tokens and votes, with another hash."""
    content = docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    return analyze.fingerprints(content, "doc_id", "content", arrow.blake2).select("doc_id", F.col("simhash64").cast("string").alias("simhash64"))


def huffman_total_bits(spark, d):
    counts = F.filter(analyze.histogram(F.encode("text", "UTF-8")), lambda n: n > 0)
    return docs(spark, d).select("doc_id", arrow.huffman_total()(counts).alias("bits"))


def _packed(spark, d):
    from lamina import workflow
    from lamina.specs import DirectorySpec
    from lamina.storage import shared_folder

    rel = F.concat_ws("/", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    files = docs(spark, d, "source").select(rel.alias("rel"), F.encode("text", "UTF-8").alias("content"))
    out = shared_folder(spark)
    return out, workflow.pack(spark, files, out, DirectorySpec(buckets=8)), workflow


def archive_roundtrip(spark, d):
    """Documents packed by bucket and plan into archives, and unpacked from them."""
    out, _, workflow = _packed(spark, d)
    return workflow.unpack(spark, out).select("rel", F.sha2("content", 256).alias("sha"), (F.sha2("content", 256) == F.col("in_sha256")).alias("restored"))


def archive_verify(spark, d):
    """The manifest's files, with what the full check finds wrong with each: nothing."""
    out, manifest, workflow = _packed(spark, d)
    found = workflow.verify(spark, out, full=True)
    return manifest.join(found, "rel", "left").select("rel", F.col("in_size"), F.coalesce("violation", F.lit("")).alias("violation"))


def _bundled(spark, d, mode):
    from lamina import bundles
    from lamina.storage import shared_folder

    files = docs(spark, d).select(F.concat(F.lit("t/"), F.col("doc_id").cast("string")).alias("rel"), F.encode("text", "UTF-8").alias("content"))
    if mode == "mixed":
        binary = spark.read.parquet(f"{d}/embeddings.parquet").select(F.concat(F.lit("v/"), F.col("vec_id").cast("string")).alias("rel"), F.concat(F.lit(b"\0\xff"), arrow.float_bytes("embedding")).alias("content"))
        files = files.unionByName(binary)
    out = shared_folder(spark)
    bundles.pack(spark, files, out, mode, block=1 << 18)
    return out, files, bundles


def single_bundle_roundtrip(spark, d):
    """Each document's place in the concatenation, and whether its content comes back from the blocks."""
    out, _, bundles = _bundled(spark, d, "single")
    return bundles.unpack(spark, out).select("rel", "offset", "length", "sha256", (F.sha2("content", 256) == F.col("sha256")).alias("restored"))


def mixed_bundle_roundtrip(spark, d):
    """Texts and vectors, each in the concatenation of their kind. SQL has no bytes of floats, so their hashes are compared with the files'."""
    out, files, bundles = _bundled(spark, d, "mixed")
    given = files.select("rel", F.sha2("content", 256).alias("given"))
    return bundles.unpack(spark, out).join(given, "rel").select("kind", "rel", "offset", "length", (F.sha2("content", 256) == F.col("given")).alias("restored"))


def bundle_index_check(spark, d):
    """Index records of which some are damaged, each in one way, and the reasons why they are refused."""
    from lamina import bundles

    k, text = F.col("doc_id") % 8, F.encode("text", "UTF-8")
    rows = docs(spark, d).select("doc_id", F.lit("text").alias("kind"), F.lpad(F.col("doc_id").cast("string"), 9, "0").alias("rel"), F.length(text).cast("string").alias("length"), F.sha2(text, 256).alias("sha256"))
    broken = rows.filter(k > 0).withColumn("offset", F.when(k == 2, "x").when(k == 3, "-4").otherwise("0"))
    broken = broken.withColumns({"kind": F.when(k == 1, "other").otherwise("text"), "sha256": F.when(k == 4, "zz").otherwise(F.col("sha256")), "rel": F.when(k == 5, F.concat(F.lit("../"), "rel")).when(k == 6, F.concat(F.lit("/"), "rel")).otherwise(F.col("rel"))}).filter(k < 7)
    sound = rows.filter(k == 0).withColumn("n", F.col("length").cast("long"))
    from lamina.operators.relations import bundle_offsets

    sound = bundle_offsets(sound, "kind", "rel", "n").withColumn("offset", (F.col("offset") + F.when(F.col("doc_id") % 32 == 8, 1).otherwise(0)).cast("string"))
    return bundles.index_violations(broken.unionByName(sound.drop("n")).select("kind", "rel", "offset", "length", "sha256"))


SQL["single_bundle_roundtrip"] = """SELECT 't/' || doc_id AS rel, coalesce(sum(octet_length(encode(text))) OVER (ORDER BY 't/' || doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", octet_length(encode(text))::BIGINT AS length, sha256(encode(text)) AS sha256, true AS restored FROM documents"""
SQL["mixed_bundle_roundtrip"] = """WITH f AS (SELECT 'text' AS kind, 't/' || doc_id AS rel, octet_length(encode(text))::BIGINT AS length FROM documents UNION ALL SELECT 'bin', 'v/' || vec_id, (2 + 4 * len(embedding))::BIGINT FROM embeddings)
 SELECT kind, rel, coalesce(sum(length) OVER (PARTITION BY kind ORDER BY rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", length, true AS restored FROM f"""
SQL["bundle_index_check"] = """WITH r AS (SELECT doc_id, lpad(doc_id::VARCHAR, 9, '0') AS rel FROM documents)
 SELECT CASE doc_id % 8 WHEN 5 THEN '../' || rel WHEN 6 THEN '/' || rel ELSE rel END AS rel, CASE doc_id % 8 WHEN 1 THEN 'no kind' WHEN 2 THEN 'not a number' WHEN 3 THEN 'negative' WHEN 4 THEN 'no hash' WHEN 0 THEN 'not behind the file before it' ELSE 'rel leaves the tree' END AS reason FROM r WHERE doc_id % 8 BETWEEN 1 AND 6 OR doc_id % 32 = 8"""
QUERIES |= {"single_bundle_roundtrip": single_bundle_roundtrip, "mixed_bundle_roundtrip": mixed_bundle_roundtrip, "bundle_index_check": bundle_index_check}
SQL["archive_roundtrip"] = "SELECT source || '/' || doc_id || '.txt' AS rel, sha256(encode(text)) AS sha, true AS restored FROM documents"
SQL["archive_verify"] = "SELECT source || '/' || doc_id || '.txt' AS rel, octet_length(encode(text))::BIGINT AS in_size, '' AS violation FROM documents"
QUERIES |= {"archive_roundtrip": archive_roundtrip, "archive_verify": archive_verify}
QUERIES |= {"simhash64_blake2b": simhash64_blake2b, "huffman_total_bits": huffman_total_bits}
