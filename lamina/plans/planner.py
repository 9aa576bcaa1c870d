"""Which plan each bucket gets: candidates are tried on its largest files, all buckets in one job."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.kernels import arrow, codecs, containers
from lamina.operators.ordering import largest
from lamina.operators.relations import plan_scores, remembered, runner_up
from lamina.specs import TYPES, DirectorySpec, Plan
from lamina.storage import written

#: CPU penalties of layers (others: OTHER) and of the tight codec and numeric streams.
LAYER_PENALTY, OTHER, TIGHT, NUMERIC = {"bytes": 0.0, "vc0": 0.01, "split_text_nums": 0.02, "tpl_lines_v0": 0.03, "tpl_lines_shared_v0": 0.03}, 0.015, 0.005, 0.005


def penalty(plan: Plan) -> float:
    numeric = plan.layer in ("split_text_nums", "tpl_lines_v0", "tpl_lines_shared_v0") or "num_v1" in (plan.streams or {}).values()
    return LAYER_PENALTY.get(plan.layer, OTHER) + TIGHT * (codecs.resolve(plan.codec) == "zstd_tight") + NUMERIC * numeric


def bootstrap(kind: str) -> list[Plan]:
    codec = codecs.resolve("zstd_tight")
    if kind == "binaryish":
        return [Plan("bytes", codec)]
    if kind == "textish":
        return [Plan("split_text_nums", codec), Plan("bytes", codec)]
    return [Plan("tpl_lines_shared_v0", codec), Plan("tpl_lines_v0", codec)]


def broad(kind: str) -> list[Plan]:
    """All that is worth a trial when memory is to be refreshed."""
    layers = ("bytes",) if kind == "binaryish" else ("bytes", "vc0", "split_text_nums", "tpl_lines_shared_v0", "tpl_lines_v0")
    own = codecs.resolve("zstd_tight")
    both = {codec: None for codec in ("zlib", own)}
    return [Plan(layer, codec) for layer in layers for codec in (both if layer in ("bytes", "vc0") else (own,))]


def table(spark, spec: DirectorySpec, history: DataFrame | None = None) -> DataFrame:
    """bucket_type, plan, layer, codec, streams, penalty, ord: the candidates of each type. A few rows, from the specification, from memory, or those to begin with.

    A type's pool comes first; then, with refresh_top, all that is worth a trial, else what is remembered. Without autopick each type has its first.
    """
    known: dict[str, list[Plan]] = {}
    if history is not None and not spec.refresh_top:
        top = remembered(history, spec.top_k, spec.top_db_max).join(history.select("bucket_type", "plan", "layer", "codec", "streams"), ["bucket_type", "plan"]).dropDuplicates(["bucket_type", "plan"])
        for r in sorted(top.collect(), key=lambda r: (r.bucket_type, r.plan)):  # top_k a type
            known.setdefault(r.bucket_type, []).append(Plan(r.layer, r.codec, dict(r.streams or {})))
    rows = []
    for kind in TYPES:
        plans = spec.pools.get(kind) or (broad(kind) if spec.refresh_top else known.get(kind)) or bootstrap(kind)
        unique = {p.key: p for p in reversed(plans)}
        ordered = sorted(unique.values(), key=lambda p: plans.index(p))
        rows += [(kind, p.key, p.layer, p.codec, p.streams or {}, penalty(p), k) for k, p in enumerate(ordered[: None if spec.autopick else 1])]
    return spark.createDataFrame(rows, "bucket_type string, plan string, layer string, codec string, streams map<string,string>, penalty double, ord int")


#: A bucket's templates are taken apart once, not for each of its files.
_templates = lru_cache(maxsize=64)(codecs.untemplate_resource)


def _shared(numbers, templates) -> containers.Shared:
    return containers.Shared(numbers or None, _templates(templates) if templates is not None else [])


def encoded(*columns):
    """Each file (content, layer, codec, streams, numbers, templates) by its own plan; numbers and templates are its bucket's shared dictionaries, or null."""
    return arrow.by_pieces(lambda *c: [containers.encode(data, layer, codec, dict(streams) if streams is not None else None, _shared(n, t)) for data, layer, codec, streams, n, t in zip(*c)], "binary")(*columns)


def decoded(*columns):
    """blob, numbers, templates -> content."""
    return arrow.by_pieces(lambda *c: [containers.decode(blob, _shared(n, t)) for blob, n, t in zip(*c)], "binary")(*columns)


def decoded_or_null(*columns):
    """As decoded(), with null for what can't be decoded."""

    def one(blob, n, t):
        try:
            return containers.decode(blob, _shared(n, t))
        except Exception:  # whatever damaged bytes lead to
            return None

    return arrow.by_pieces(lambda *c: [one(*row) for row in zip(*c)], "binary")(*columns)


def choose(files: DataFrame, plans: DataFrame, sample_n: int, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files: rel, bucket, bucket_type, content; shared: bucket, numbers, templates. -> each bucket's plan, and the scores of all trials.

    The first: bucket, bucket_type, plan, layer, codec, streams, ratio, score, runner_up. Buckets with one candidate only aren't tried.
    """
    several = plans.groupBy("bucket_type").agg(F.count("*").alias("n")).filter("n > 1").select("bucket_type")
    sized = files.withColumn("_size", F.length("content")).filter("_size > 0").join(F.broadcast(several), "bucket_type")
    sample = largest(sized, "bucket", sample_n, "_size", "rel")
    tried = sample.join(F.broadcast(plans), "bucket_type").join(shared, "bucket", "left")
    templates = F.when(F.col("layer") == "tpl_lines_shared_v0", F.col("templates"))
    trials = tried.withColumn("blob", encoded("content", "layer", "codec", "streams", "numbers", templates))
    scored = written(plan_scores(trials.select("bucket", "plan", "layer", "codec", F.length("content").alias("in_bytes"), F.length("blob").alias("out_bytes"), "penalty")))
    best = scored.filter("pos = 1").select("bucket", "plan", "ratio", "score").join(runner_up(scored).select("bucket", "runner_up"), "bucket", "left")
    detail = plans.select("plan", "layer", "codec", "streams").dropDuplicates(["plan"])
    kinds = files.select("bucket", "bucket_type").distinct()
    first = plans.groupBy("bucket_type").agg(F.min_by("plan", "ord").alias("fallback"))  # buckets that weren't tried
    chosen = kinds.join(best, "bucket", "left").join(F.broadcast(first), "bucket_type").withColumn("plan", F.coalesce("plan", "fallback")).drop("fallback")
    return chosen.join(F.broadcast(detail), "plan").select("bucket", "bucket_type", "plan", "layer", "codec", "streams", "ratio", "score", "runner_up"), scored
