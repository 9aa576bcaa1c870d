"""Joins and reports over manifests, archive indexes, resources and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.operators.ordering import prefix_sums


def bundle_offsets(files: DataFrame, kind: str, rel: str, length: str) -> DataFrame:
    """offset of each file in the concatenation of its kind, in order of rel."""
    return prefix_sums(files, [kind], [rel], length)


def manifest_join(manifest: DataFrame, index: DataFrame) -> DataFrame:
    """manifest (archive, rel, offset, length) with tier 1 (same rel), 2 (an entry's rel ends with /rel, uniquely), 3 (same offset and length) or null (missing), and entry, the index's rel.

    The suffix tier is an equi join too: each entry gives one row for each proper suffix of its path.
    """
    entries = index.select(F.col("archive").alias("a"), F.col("rel").alias("entry"), F.col("offset").alias("o"), F.col("length").alias("l"))
    rows = manifest.withColumn("_id", F.struct("archive", "rel"))
    exact = rows.join(entries, (F.col("archive") == F.col("a")) & (F.col("rel") == F.col("entry"))).groupBy("_id").agg(F.min("entry").alias("e1"))
    parts = F.split("entry", "/")
    suffixes = entries.select("a", "entry", F.explode(F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(2), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "/"))).otherwise(F.array().cast("array<string>"))).alias("suffix"))
    by_suffix = rows.join(suffixes, (F.col("archive") == F.col("a")) & (F.col("rel") == F.col("suffix"))).groupBy("_id").agg(F.min("entry").alias("e2"), F.count("*").alias("c2")).filter("c2 = 1").select("_id", "e2")
    by_place = rows.join(entries, (F.col("archive") == F.col("a")) & (F.col("offset") == F.col("o")) & (F.col("length") == F.col("l"))).groupBy("_id").agg(F.min("entry").alias("e3"))
    out = rows.join(exact, "_id", "left").join(by_suffix, "_id", "left").join(by_place, "_id", "left")
    tier = F.when(F.col("e1").isNotNull(), 1).when(F.col("e2").isNotNull(), 2).when(F.col("e3").isNotNull(), 3)
    return out.withColumns({"entry": F.coalesce("e1", "e2", "e3"), "tier": tier}).drop("_id", "e1", "e2", "e3")


def resource_check(summaries: DataFrame, resources: DataFrame) -> DataFrame:
    """bucket, res_name, violation (missing_resource or hash_mismatch), of summaries (bucket, res_name, sha) and resources (bucket, res_name, sha)."""
    have = resources.select("bucket", "res_name", F.col("sha").alias("found"))
    joined = summaries.join(have, ["bucket", "res_name"], "left")
    return joined.withColumn("violation", F.when(F.col("found").isNull(), "missing_resource").when(F.col("found") != F.col("sha"), "hash_mismatch")).filter("violation is not null").select("bucket", "res_name", "violation")


def tree_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """rel, status (missing, extra, changed) of trees (rel, sha)."""
    both = left.select("rel", F.col("sha").alias("l")).join(right.select("rel", F.col("sha").alias("r")), "rel", "full_outer")
    return both.withColumn("status", F.when(F.col("r").isNull(), "missing").when(F.col("l").isNull(), "extra").when(F.col("l") != F.col("r"), "changed")).filter("status is not null").select("rel", "status")


def grouped_savings(files: DataFrame, sets: list[list[str]], columns: list[str]) -> DataFrame:
    """files, in_bytes, out_bytes, ratio for each of the grouping sets in one pass; ``columns`` that a set lacks are null."""
    ratio = F.when(F.sum("in_bytes") == 0, F.lit(0.0)).otherwise(F.sum("out_bytes") / F.sum("in_bytes"))
    grouped = files.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in columns))
    return grouped.agg(F.grouping_id(*columns).alias("gid"), F.count("*").alias("files"), F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), F.round(ratio, 6).alias("ratio")).select("gid", *columns, "files", "in_bytes", "out_bytes", "ratio")


def top_saved(grouped: DataFrame, key: str, n: int) -> DataFrame:
    """The n groups that saved most; ties: less output, then key."""
    saved = grouped.withColumn("saved", F.col("in_bytes") - F.col("out_bytes"))
    return saved.orderBy(F.desc("saved"), "out_bytes", key).limit(n).select(key, "in_bytes", "out_bytes", "saved")


def plan_scores(trials: DataFrame, penalty: str = "penalty") -> DataFrame:
    """bucket, plan, ratio, score = ratio + penalty, pos (from 1, best first)."""
    per = trials.groupBy("bucket", "plan", "layer", "codec").agg(F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"), F.max(penalty).alias("penalty"))
    scored = per.withColumn("ratio", F.when(F.col("in_bytes") == 0, 0.0).otherwise(F.col("out_bytes") / F.col("in_bytes"))).withColumn("score", F.round(F.col("ratio") + F.col("penalty"), 9))
    return scored.withColumn("pos", F.row_number().over(Window.partitionBy("bucket").orderBy("score", "plan"))).select("bucket", "plan", "layer", "codec", F.round("ratio", 6).alias("ratio"), F.round("score", 6).alias("score"), "pos")


def runner_up(scored: DataFrame) -> DataFrame:
    """bucket, winner, runner_up: of the other plans the one that differs most (3: layer, 2: stream codecs, 1: codec, 0), earliest first. A plan is layer:codec, then its stream codecs."""
    streams = F.regexp_replace("plan", "^[^:]*:[^:]*:?", "")
    best = scored.filter("pos = 1").select("bucket", F.col("plan").alias("winner"), F.col("layer").alias("wl"), F.col("codec").alias("wc"), streams.alias("ws"))
    rest = scored.filter("pos > 1").join(best, "bucket")
    rank = F.when(F.col("layer") != F.col("wl"), 3).when(streams != F.col("ws"), 2).when(F.col("codec") != F.col("wc"), 1).otherwise(0)
    return rest.groupBy("bucket", "winner").agg(F.max_by("plan", F.struct(rank, -F.col("pos"))).alias("runner_up"))


def top_db(history: DataFrame, keep: int) -> DataFrame:
    """bucket_type, key, score (the least), seen, rank: the ``keep`` best of each type."""
    merged = history.groupBy("bucket_type", "key").agg(F.min("score").alias("score"), F.sum("seen").alias("seen"))
    w = Window.partitionBy("bucket_type").orderBy("score", "key")
    return merged.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)


def remembered(history: DataFrame, top_k: int, keep: int) -> DataFrame:
    """bucket_type, plan: of the ``keep`` best remembered plans of each type the best, and if top_k is 2 or more the one that differs most from it."""
    best = history.withColumn("pos", F.row_number().over(Window.partitionBy("bucket_type").orderBy("score", "plan"))).filter(F.col("pos") <= keep)
    ranked = best.withColumnRenamed("bucket_type", "bucket")
    first = best.filter("pos = 1").select("bucket_type", "plan")
    if top_k < 2:
        return first
    return first.unionByName(runner_up(ranked).select(F.col("bucket").alias("bucket_type"), F.col("runner_up").alias("plan")))


def first_of_each(df: DataFrame, sig: str, pos: str) -> DataFrame:
    """One row for each value of sig: that of the least pos."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(sig).orderBy(pos))).filter("_n = 1").drop("_n")
