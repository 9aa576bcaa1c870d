"""Packing a tree of files into archives, checking and restoring it."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from lamina.functions import columns as C
from lamina.kernels import codecs
from lamina.operators import analyze, layers, numeric, relations
from lamina.plans import planner
from lamina.sources.archive import RESOURCE, SCHEMA, ArchiveSource, entry_violations, violations, write_archives, write_loose
from lamina.sources.files import tree
from lamina.specs import DirectorySpec
from lamina.storage import written

ARCHIVE_BYTES = 256 << 20
LOOSE = ".gcc6"


def _bucket(rule, simhash64, buckets: int):
    """The bucket by a rule (from a column of DECIMAL(20,0) and a number to a column), or by the fingerprint modulo the number where there is none or its result is null."""
    own = analyze.bucket(simhash64, buckets)
    return own if rule is None else F.coalesce(rule(simhash64, buckets).cast("int"), own)


def analyzed(files: DataFrame, buckets: int, rule=None) -> DataFrame:
    """files: rel, content. Adds size, simhash64, is_text, bucket (see _bucket()) and bucket_type. Fingerprints are of the first 256 KiB."""
    heads = analyze.sampled(files.select("rel", "content"), "content").select("rel", "size", "prefix")
    marks = analyze.fingerprints(heads, "rel", "prefix", bounds=analyze.BOUNDS)
    placed = files.select("rel", "content").join(heads.select("rel", "size", analyze.is_text(C.latin1_of(F.col("prefix"))).alias("is_text")), "rel").join(marks.select("rel", "simhash64"), "rel").withColumn("bucket", _bucket(rule, F.col("simhash64"), buckets))
    metrics = analyze.bucket_metrics(placed, "bucket", "rel", "content").select("bucket", analyze.bucket_type().alias("bucket_type"))
    return placed.join(metrics, "bucket", "left").withColumn("bucket_type", F.coalesce("bucket_type", F.lit("textish")))


@F.pandas_udf(BinaryType())
def _template_resource(templates):
    return templates.map(lambda ts: codecs.template_resource([[c.encode("latin-1") for c in t] for t in ts])[0])


def dictionaries(files: DataFrame, numbers_k: int, templates_k: int) -> DataFrame:
    """bucket, numbers (array<long>), templates (binary): the most frequent numbers and line templates of each bucket with enough of them; K bounds both."""
    texts = files.select("bucket", "rel", C.latin1_of(F.col("content")).alias("t"))
    keys = files.select("bucket").distinct()
    numbers = layers.numbers(texts, "bucket", "t").filter("digits_len <= 18").select("bucket", F.col("digits").cast("long").alias("value"))
    top = numeric.dictionary_topk(numbers, "bucket", "value", max(1, numbers_k)).groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]).alias("numbers"))
    by_line = layers.lines(texts, "bucket", "t").filter(~F.col("line").rlike("[0-9]{19}")).select("bucket", F.split("line", C.NUMBERS, -1).alias("template"))
    counted = by_line.groupBy("bucket", "template").agg(F.count("*").alias("n"))
    best = _top_templates(counted, templates_k)
    out = keys.join(top, "bucket", "left").join(best, "bucket", "left")
    return out.select("bucket", F.col("numbers") if numbers_k else F.lit(None).cast("array<long>").alias("numbers"), F.col("templates") if templates_k else F.lit(None).cast("binary").alias("templates"))


def _top_templates(counted: DataFrame, k: int) -> DataFrame:
    from pyspark.sql import Window

    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("bucket").orderBy(F.desc("n"), F.size("template"), "template"))).filter(F.col("rank") <= max(1, k))
    grouped = ranked.groupBy("bucket").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "template"))), lambda x: x["template"]).alias("l")).filter("size(l) >= 4")
    return grouped.select("bucket", _template_resource("l").alias("templates"))


#: Fixed schema of the manifest: a row for each bucket (kind bucket_summary), then one for each file.
MANIFEST = "kind string, bucket int, bucket_type string, rel string, layer_id string, codec_text string, plan string, runner_up string, ratio double, score double, archive string, archive_offset long, archive_length long, in_size long, out_size long, in_sha256 string, blob_sha256 string, bucket_resources map<string,string>"


def pack(spark: SparkSession, files: DataFrame, out: str, spec: DirectorySpec | None = None, history: DataFrame | None = None, rule=None) -> DataFrame:
    """files: rel, content. Writes archives (or loose files), manifest, trials and report under ``out``; returns the manifest's file records.

    A bucket of much data has several archives, so that one bucket is not one task. Each run writes to a folder of its own, which the
    header names last: what an earlier or a failed run has left is never read. history: plans remembered from other runs, see memory(). rule: another
    way to bucket, see _bucket().
    """
    spec = spec or DirectorySpec()
    run = uuid.uuid4().hex
    placed = written(analyzed(files, spec.buckets, rule))
    shared = written(dictionaries(placed, spec.numbers_k if spec.archive else 0, spec.templates_k if spec.archive else 0))
    plan, trials = planner.choose(placed, planner.table(spark, spec, history), spec.sample_n, shared)
    plan = written(plan)
    trials.write.mode("overwrite").json(f"{out}/trials")
    shared = written(plan.join(shared, "bucket").withColumn("templates", F.when(F.col("layer") == "tpl_lines_shared_v0", F.col("templates"))))
    parts = placed.groupBy("bucket").agg(F.ceil((F.sum("size") + 1) / ARCHIVE_BYTES).cast("int").alias("parts"))
    # a row a bucket: files stay where they are, so that a bucket of much data is coded in many tasks
    rows = placed.drop("bucket_type").join(F.broadcast(shared), "bucket").join(F.broadcast(parts), "bucket")
    archive = F.format_string("bucket-%05d-%05d", "bucket", F.pmod(F.xxhash64("rel"), F.col("parts")))
    coded = rows.withColumn("blob", planner.encoded("content", "layer", "codec", "streams", "numbers", "templates"))
    coded = written(coded.select(archive.alias("archive"), "rel", "bucket", "bucket_type", "layer", "codec", "plan", F.col("size").alias("in_size"), F.sha2("content", 256).alias("in_sha256"), "blob"))
    resources = {"numbers": F.encode(F.to_json("numbers"), "UTF-8"), "templates": F.col("templates")}
    if spec.archive:
        meta = F.to_json(F.struct("bucket", "layer", "codec", "in_size", "in_sha256"))
        res = shared.join(parts, "bucket").select(F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("p"), "bucket", F.explode(F.map_from_arrays(F.array(*map(F.lit, resources)), F.array(*resources.values()))).alias("name", "blob"))
        res = res.filter("blob is not null").select(F.format_string("bucket-%05d-%05d", "bucket", "p").alias("archive"), F.concat(F.lit(RESOURCE), "name").alias("rel"), "blob", F.lit(None).cast("string").alias("meta"))
        extra = res.join(coded.select("archive").distinct(), "archive", "left_semi")
        done = write_archives(coded.select("archive", "rel", "blob", meta.alias("meta")).unionByName(extra), f"{out}/archives/{run}")
        done.write.mode("overwrite").parquet(f"{out}/written")
        places = archives(spark, f"{out}/archives/{run}", blobs=False).filter("kind is null").select(F.regexp_replace("archive", r"\.gca$", "").alias("archive"), "rel", F.col("offset").alias("archive_offset"), F.col("length").alias("archive_length"), "blob_sha256")
        found = coded.drop("blob").join(places, ["archive", "rel"]).withColumn("out_size", F.col("archive_length"))
    else:
        write_loose(coded.select(F.concat("rel", F.lit(LOOSE)).alias("rel"), "blob"), f"{out}/loose/{run}").write.mode("overwrite").parquet(f"{out}/written")
        found = coded.withColumns({"out_size": F.length("blob").cast("long"), "blob_sha256": F.sha2("blob", 256), "archive": F.lit(None).cast("string")})
    hashes = F.map_filter(F.map_from_arrays(F.array(*map(F.lit, resources)), F.array(*(F.sha2(x, 256) for x in resources.values()))), lambda _, v: v.isNotNull())
    summaries = shared.select(F.lit("bucket_summary").alias("kind"), "bucket", "bucket_type", F.col("layer").alias("layer_id"), F.col("codec").alias("codec_text"), "plan", "runner_up", "ratio", "score", hashes.alias("bucket_resources"))
    records = summaries.unionByName(found.withColumnsRenamed({"layer": "layer_id", "codec": "codec_text"}).drop("blob"), allowMissingColumns=True)
    names = [c.split()[0] for c in MANIFEST.split(", ")]
    for c in set(names) - set(records.columns):
        records = records.withColumn(c, F.lit(None).cast("long"))
    order = [F.col("kind").isNull(), F.col("bucket"), F.col("rel")]
    records.select(*names).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{out}/manifest")
    head = {"spec": "lamina.packed.v1", "run": run, "buckets": spec.buckets, "archive": spec.archive}
    spark.createDataFrame([(json.dumps(head, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/packed")
    return file_records(manifest(spark, out))


def manifest(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{out}/manifest")


def header(spark: SparkSession, out: str) -> dict:
    return json.loads(spark.read.text(f"{out}/packed").first().value)


def file_records(rows: DataFrame) -> DataFrame:
    return rows.filter("rel <> '' and kind is null")


def archives(spark: SparkSession, folder: str, blobs: bool = True) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("archive").schema(SCHEMA).option("path", folder).option("blobs", str(blobs).lower()).load()


def _folder(spark: SparkSession, out: str) -> str:
    head = header(spark, out)
    return f"{out}/{'archives' if head['archive'] else 'loose'}/{head['run']}"


def _stored(spark: SparkSession, out: str, known: DataFrame) -> DataFrame:
    """known (rel and other columns) with blob, numbers, templates of those files of the last run, in archives or loose. Dictionaries come last: they don't travel with each file."""
    folder = _folder(spark, out)
    if not header(spark, out)["archive"]:
        rel = F.regexp_replace("rel", f"{LOOSE.replace('.', chr(92) + '.')}$", "")
        return tree(spark, folder).select(rel.alias("rel"), F.col("content").alias("blob"), F.lit(None).cast("array<long>").alias("numbers"), F.lit(None).cast("binary").alias("templates")).join(known, "rel")
    rows = archives(spark, folder)
    res = rows.filter("kind = 'resource'").groupBy("archive").agg(F.max(F.when(F.col("res_name") == "numbers", F.from_json(F.decode("blob", "UTF-8"), "array<long>"))).alias("numbers"), F.max(F.when(F.col("res_name") == "templates", F.col("blob"))).alias("templates"))
    return rows.filter("kind is null").select("archive", "rel", "blob").join(known, "rel").join(F.broadcast(res), "archive", "left").drop("archive")


def unpack(spark: SparkSession, out: str) -> DataFrame:
    """rel, content, in_sha256 of all files. Empty ones come from the manifest alone."""
    known = file_records(manifest(spark, out)).select("rel", "in_size", "in_sha256")
    some = _stored(spark, out, known.filter("in_size > 0"))
    files = some.select("rel", planner.decoded("blob", "numbers", "templates").alias("content"), "in_sha256")
    return files.unionByName(known.filter("in_size = 0").select("rel", F.lit(b"").alias("content"), "in_sha256"))


def verify(spark: SparkSession, out: str, full: bool = False) -> DataFrame:
    """rel, violation: everything wrong, not only the first.

    Manifest records without an entry, entries that can't be right, and resources that a bucket's summary names and its archives lack or hold
    with another hash; with ``full`` blobs with other hashes, and files that don't decode to what was packed.
    """
    records = manifest(spark, out)
    files, folder, packed = file_records(records), _folder(spark, out), header(spark, out)["archive"]
    if packed:
        index = archives(spark, folder, blobs=False).withColumn("archive", F.regexp_replace("archive", r"\.gca$", ""))
        want = files.select("archive", "rel", F.col("archive_offset").alias("offset"), F.col("archive_length").alias("length"))
        found = relations.manifest_join(want, index.filter("kind is null")).filter("tier is null").select("rel", F.lit("corrupt_payload").alias("violation"))
        found = found.unionByName(entry_violations(index).select("rel", "violation"))
        declared = records.filter("kind = 'bucket_summary'").select("bucket", F.explode("bucket_resources").alias("res_name", "sha"))
        expected = files.select("archive", "bucket").distinct().join(declared, "bucket").select(F.col("archive").alias("bucket"), "res_name", "sha")
        have = index.filter("kind = 'resource'").select(F.col("archive").alias("bucket"), "res_name", F.col("blob_sha256").alias("sha"))
        found = found.unionByName(relations.resource_check(expected, have).select(F.concat_ws("/", "bucket", "res_name").alias("rel"), "violation"))
    else:
        have = tree(spark, folder).select(F.regexp_replace("rel", r"\.gcc6$", "").alias("rel"))
        found = files.join(have, "rel", "left_anti").select("rel", F.lit("corrupt_payload").alias("violation"))
    if full:
        if packed:
            found = found.unionByName(violations(archives(spark, folder)).select("rel", "violation"))
        stored = _stored(spark, out, files.filter("in_size > 0").select("rel", "in_sha256"))
        content = planner.decoded_or_null("blob", "numbers", "templates")
        wrong = stored.select("rel", "in_sha256", content.alias("content")).filter("content is null or sha2(content, 256) <> in_sha256").select("rel", F.lit("hash_mismatch").alias("violation"))
        found = found.unionByName(wrong).distinct()
    return found


def memory(spark: SparkSession, out: str, history: DataFrame | None = None, keep: int = 10) -> DataFrame:
    """What to remember after a run: bucket_type, plan, layer, codec, streams, score (the least seen), seen; the ``keep`` best of each type."""
    kinds = manifest(spark, out).filter("kind = 'bucket_summary'").select("bucket", "bucket_type")
    tried = spark.read.schema("bucket int, plan string, layer string, codec string, ratio double, score double, pos int").json(f"{out}/trials")
    streams = F.expr("map_from_entries(transform(filter(slice(split(plan, ':'), 3, 99), x -> x <> ''), x -> struct(split_part(x, '=', 1), split_part(x, '=', 2))))")
    new = tried.filter("pos = 1").join(kinds, "bucket").select("bucket_type", "plan", "layer", "codec", streams.alias("streams"), "score", F.lit(1).cast("long").alias("seen"))
    rows = new if history is None else new.unionByName(history.select(new.columns))
    best = relations.top_db(rows.select("bucket_type", F.col("plan").alias("key"), "score", "seen"), keep)
    detail = rows.select("bucket_type", F.col("plan").alias("key"), "layer", "codec", "streams").dropDuplicates(["bucket_type", "key"])
    return best.join(detail, ["bucket_type", "key"]).select("bucket_type", F.col("key").alias("plan"), "layer", "codec", "streams", "score", "seen")


def write_report(spark: SparkSession, out: str) -> str:
    """Write report (grouping sets) and top (the groups that saved most) as JSON under ``out``; returns the text form, of 25 groups at most."""
    savings = written(report(file_records(manifest(spark, out))))
    savings.write.mode("overwrite").json(f"{out}/report")
    total = savings.filter("gid = 7").first()
    lines = [f"files {total.files}, in {total.in_bytes}, out {total.out_bytes}, ratio {total.ratio}"] if total else []
    for gid, key, n in ((3, "ext", 10), (5, "plan", 10), (6, "bucket", 5)):
        for r in relations.top_saved(savings.filter(F.col("gid") == gid), key, n).collect():
            lines.append(f"{key} {r[key]}: in {r.in_bytes}, out {r.out_bytes}, saved {r.saved}")
    return "\n".join(lines)


def report(manifest: DataFrame) -> DataFrame:
    """Savings in total, and by extension, plan and bucket."""
    files = manifest.select(C.extension(F.col("rel")).alias("ext"), F.concat_ws(":", "layer_id", "codec_text").alias("plan"), "bucket", F.col("in_size").alias("in_bytes"), F.col("out_size").alias("out_bytes"))
    return relations.grouped_savings(files, [[], ["ext"], ["plan"], ["bucket"], ["bucket", "ext"]], ["ext", "plan", "bucket"])


def envelope(kind: str, target: str, full: bool, error: str | None) -> str:
    return json.dumps({"schema": "lamina.verify.v1", "version": 1, "ok": error is None, "kind": kind, "target": target, "full": full, "error": error}, sort_keys=True)
