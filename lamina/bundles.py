"""Bundles: a tree's files side by side in one concatenation a kind, with an index of where each lies.

``single`` bundles hold texts only and refuse other files; ``mixed`` ones have a concatenation of texts (valid UTF-8
without NUL) and one of the rest. A concatenation may be of any size, so it is never put together: it is cut into
blocks of ``BLOCK`` bytes, each a container of its own, and files are cut out of the blocks they lie in. The index has
a row a file (kind, rel, offset, length, sha256), in order of rel within a kind, and is written as JSON lines.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.errors import UsageError
from lamina.functions import columns as C
from lamina.kernels import arrow, codecs, legacy
from lamina.kernels.containers import encode
from lamina.operators.relations import bundle_offsets
from lamina.storage import written

BLOCK = 16 << 20
#: The layer and codec of each kind's blocks.
PLANS = {"text": ("split_text_nums", "zlib"), "bin": ("bytes", "zstd")}
INDEX = "kind string, rel string, offset long, length long, sha256 string"
BLOCKS = "kind string, block long, length long, sha256 string, blob binary"


def kind(content, mode: str):
    """text or bin; other for what a single bundle can't hold."""
    utf8 = F.is_valid_utf8(content.cast("string"))
    return F.when(utf8, "text").otherwise("other") if mode == "single" else F.when(utf8 & ~F.contains(content, F.lit(b"\0")), "text").otherwise("bin")


def placed(files: DataFrame, mode: str = "mixed") -> DataFrame:
    """files (rel, content) with kind, length, sha256 and offset in the concatenation of their kind."""
    rows = files.select("rel", "content", kind(F.col("content"), mode).alias("kind"), F.length("content").cast("long").alias("length"), F.sha2("content", 256).alias("sha256"))
    return bundle_offsets(rows, "kind", "rel", "length")


def _pieces(rows: DataFrame, block: int) -> DataFrame:
    """A row for each block that a file of one byte or more lies in: block, and the piece's start and end in the concatenation."""
    some = rows.filter("length > 0").withColumn("block", F.explode(F.expr(f"sequence(offset div {block}, (offset + length - 1) div {block})")))
    return some.withColumns({"a": F.greatest(F.col("offset"), F.col("block") * block), "z": F.least(F.col("offset") + F.col("length"), (F.col("block") + 1) * block)})


def blocks(rows: DataFrame, group: str, block: int = BLOCK) -> DataFrame:
    """group, block, bytes: the concatenation of placed rows (group, offset, length, content), cut into blocks. A task holds one block at a time."""
    part = F.substring("content", (F.col("a") - F.col("offset") + 1).cast("int"), (F.col("z") - F.col("a")).cast("int"))
    pieces = _pieces(rows, block).select(group, "block", "a", part.alias("part"))
    return pieces.groupBy(group, "block").agg(F.expr("listagg(part) within group (order by a)").alias("bytes"))


def slices(index: DataFrame, found: DataFrame, group: str, key: str, block: int = BLOCK) -> DataFrame:
    """index (group, key, offset, length) with content, cut out of blocks (group, block, bytes); null where a block is missing or short."""
    pieces = _pieces(index, block).join(found, [group, "block"], "left")
    part = F.substring("bytes", (F.col("a") - F.col("block") * block + 1).cast("int"), (F.col("z") - F.col("a")).cast("int"))
    cut = pieces.select(group, key, "length", "a", part.alias("part")).groupBy(group, key, "length").agg(F.expr("listagg(part) within group (order by a)").alias("content"))
    whole = cut.select(group, key, F.when(F.length("content") == F.col("length"), F.col("content")).alias("content"))
    empty = index.filter("length = 0").select(group, key, F.lit(b"").alias("content"))
    return index.join(whole.unionByName(empty), [group, key], "left")


def _encoded(*columns):
    """data, layer, codec -> containers."""
    return arrow.column(lambda data, layer, codec: encode(data, layer, codecs.resolve(codec)))(*columns)


def _or_null(blob: bytes) -> bytes | None:
    try:
        return legacy.read(blob)
    except Exception:  # whatever damaged bytes lead to
        return None


def decoded_or_null(blobs):
    """What a container of any version holds; null where it can't be read."""
    return arrow.column(_or_null)(blobs)


def pack(spark: SparkSession, files: DataFrame, out: str, mode: str = "mixed", block: int = BLOCK) -> DataFrame:
    """Write index and blocks under ``out``; returns the index. A single bundle with a file that is no text is an error."""
    rows = written(placed(files, mode))
    if (bad := rows.filter("kind = 'other'").agg(F.min("rel")).first()[0]) is not None:
        raise UsageError(f"a single bundle holds UTF-8 texts only: {bad}")
    rows.select("kind", "rel", "offset", "length", "sha256").write.mode("overwrite").json(f"{out}/index")
    plan = spark.createDataFrame([(k, *p) for k, p in PLANS.items()], "kind string, layer string, codec string")
    made = blocks(rows, "kind", block).join(F.broadcast(plan), "kind")
    made.select("kind", "block", F.length("bytes").cast("long").alias("length"), F.sha2("bytes", 256).alias("sha256"), _encoded("bytes", "layer", "codec").alias("blob")).write.mode("overwrite").parquet(f"{out}/blocks")
    head = {"spec": "lamina.bundle_index.v1", "mode": mode, "block": block, "plans": {k: {"layer": a, "codec": c} for k, (a, c) in PLANS.items()}}
    spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/bundle")
    return index(spark, out)


def header(spark: SparkSession, out: str) -> dict:
    return json.loads(spark.read.text(f"{out}/bundle").first().value)


def index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(INDEX).json(f"{out}/index")


def lookup(spark: SparkSession, out: str, rel: str) -> DataFrame:
    """One file's index row; with unpack(), only the blocks it lies in are decoded."""
    return index(spark, out).filter(F.col("rel") == rel)


def unpack(spark: SparkSession, out: str, rows: DataFrame | None = None) -> DataFrame:
    """kind, rel, offset, length, sha256, content of all files, or of the index rows given. content is null where it can't be restored."""
    found = spark.read.schema(BLOCKS).parquet(f"{out}/blocks").select("kind", "block", "blob")
    rows, block = index(spark, out) if rows is None else rows, header(spark, out)["block"]
    needed = found.join(_pieces(rows, block).select("kind", "block").distinct(), ["kind", "block"], "left_semi")
    return slices(rows, needed.select("kind", "block", decoded_or_null("blob").alias("bytes")), "kind", "rel", block)


def index_violations(raw: DataFrame) -> DataFrame:
    """rel, reason of records (kind, rel, offset, length, sha256, all text) that are no index rows, or overlap or leave a gap behind the file before them."""
    number = lambda c: F.expr(f"try_cast({c} as bigint)")
    reason = (
        F.when(F.coalesce("rel", F.lit("")) == "", "no rel")
        .when(F.col("rel").rlike(UNSAFE), "rel leaves the tree")
        .when(~F.coalesce("kind", F.lit("")).isin(*PLANS), "no kind")
        .when(number("offset").isNull() | number("length").isNull(), "not a number")
        .when((number("offset") < 0) | (number("length") < 0), "negative")
        .when(~C.is_sha256(F.coalesce("sha256", F.lit(""))), "no hash")
    )
    judged = raw.withColumn("reason", reason)
    good = judged.filter("reason is null").select("kind", "rel", number("offset").alias("given"), number("length").alias("length"))
    ordered = bundle_offsets(good, "kind", "rel", "length")
    gaps = ordered.filter("given <> offset").select("rel", F.lit("not behind the file before it").alias("reason"))
    return judged.filter("reason is not null").select("rel", "reason").unionByName(gaps)


#: Paths that lead out of the folder they are put in.
UNSAFE = r"(^|[/\\])\.\.([/\\]|$)|^[/\\]|^[A-Za-z]:|\x00"


def verify(spark: SparkSession, out: str, full: bool = False) -> DataFrame:
    """rel, violation: index rows that are wrong, blocks that are missing or don't hold what they should, and with ``full`` files whose content has another hash."""
    raw = spark.read.schema("kind string, rel string, offset string, length string, sha256 string").json(f"{out}/index")
    found = index_violations(raw).select("rel", F.lit("corrupt_payload").alias("violation"))
    rows, block = index(spark, out), header(spark, out)["block"]
    have = spark.read.schema(BLOCKS).parquet(f"{out}/blocks").withColumn("bytes", decoded_or_null("blob"))
    state = F.when(F.col("bytes").isNull(), "hash_mismatch" if full else "corrupt_payload").when((F.length("bytes") != F.col("length")) | (F.sha2("bytes", 256) != F.col("sha256")), "hash_mismatch")
    bad = have.select("kind", "block", state.alias("violation")).filter("violation is not null")
    name = F.concat_ws("/", "kind", F.col("block").cast("string"))
    wanted = _pieces(rows, block).groupBy("kind", "block").agg(F.max("z").alias("z"))
    missing = wanted.join(have.select("kind", "block", F.lit(True).alias("there")), ["kind", "block"], "left").filter("there is null")
    found = found.unionByName(bad.select(name.alias("rel"), "violation")).unionByName(missing.select(name.alias("rel"), F.lit("corrupt_payload").alias("violation")))
    if full:
        content = unpack(spark, out).select("rel", F.when(F.col("content").isNull() | (F.sha2("content", 256) != F.col("sha256")), "hash_mismatch").alias("violation"))
        found = found.unionByName(content.filter("violation is not null"))
    return found
