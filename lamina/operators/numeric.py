"""Numeric streams: delta coding, and the size algebra by which encodings are chosen, all natively."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import columns as C

HEADER, LEAST_INTS, LEAST_DISTINCT, SIZES = 4, 8, 4, (8, 16, 32, 64, 128)


def deltas(df: DataFrame, key: str, pos: list[str], value: str) -> DataFrame:
    """The first value of each stream stays; then come differences."""
    by = Window.partitionBy(key).orderBy(*pos)
    return df.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(by), F.lit(0)))


def undelta(df: DataFrame, key: str, pos: list[str]) -> DataFrame:
    return df.withColumn("value", F.sum("delta").over(Window.partitionBy(key).orderBy(*pos)))


def raw_or_delta(df: DataFrame, key: str, pos: list[str], value: str) -> DataFrame:
    """key, n, raw_len, delta_len, mode (RAW unless DELTA is strictly shorter), out_len."""
    sized = deltas(df, key, pos, value).groupBy(key).agg(F.count("*").alias("n"), F.sum(C.int_length(F.col(value))).alias("raw_len"), F.sum(C.int_length(F.col("delta"))).alias("delta_len"))
    shorter = (F.col("n") > 1) & (F.col("delta_len") < F.col("raw_len"))
    return sized.withColumns({"mode": F.when(shorter, "DELTA").otherwise("RAW"), "out_len": HEADER + F.when(shorter, F.col("delta_len")).otherwise(F.col("raw_len"))})


def frequent(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value, cnt, rank: by falling count, then absolute value, then value."""
    counted = df.groupBy(key, value).agg(F.count("*").alias("cnt"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("cnt"), F.abs(value), value)))


def dictionary_topk(df: DataFrame, key: str, value: str, k: int, least: int = LEAST_DISTINCT) -> DataFrame:
    """The k most frequent values of each key, for keys that have ``least`` of them."""
    top = frequent(df, key, value).filter(F.col("rank") <= k)
    return top.withColumn("_n", F.count("*").over(Window.partitionBy(key))).filter(F.col("_n") >= least).drop("_n")


def dictionary_choice(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, distinct_n, raw_len, mode (RAW or DICT), k, out_len: the first strictly shortest of RAW and dictionaries of SIZES."""
    ranked = frequent(df, key, value).withColumn("_len", C.int_length(F.col(value)))
    bits = {}
    for k in SIZES:
        inside = F.col("rank") <= k
        bits[f"k{k}"] = F.sum(F.when(inside, F.col("_len") + F.col("cnt") * C.varint_length(F.col("rank").cast("long"))).otherwise(F.col("cnt") * (1 + F.col("_len"))))
    sized = ranked.groupBy(key).agg(F.sum("cnt").alias("n"), F.count("*").alias("distinct_n"), F.sum(F.col("cnt") * F.col("_len")).alias("raw"), *(v.alias(n) for n, v in bits.items()))
    raw = F.struct((F.col("raw") + HEADER).alias("len"), F.lit(0).alias("ord"), F.lit("RAW").alias("mode"), F.lit(0).cast("long").alias("k"))
    kept = [F.least(F.lit(k), F.col("distinct_n")).cast("long") for k in SIZES]
    dicts = [F.struct((F.col(f"k{k}") + HEADER + C.varint_length(used)).alias("len"), F.lit(i + 1).alias("ord"), F.lit("DICT").alias("mode"), used.alias("k")) for i, (k, used) in enumerate(zip(SIZES, kept))]
    best = F.when((F.col("n") < LEAST_INTS) | (F.col("distinct_n") < LEAST_DISTINCT), raw).otherwise(F.least(raw, *dicts))
    return sized.withColumn("_b", best).select(key, "n", "distinct_n", (F.col("raw")).alias("raw_len"), F.col("_b.mode").alias("mode"), F.col("_b.k").alias("k"), F.col("_b.len").alias("out_len"))


def codes(df: DataFrame, dictionary: DataFrame, key: str, value: str) -> DataFrame:
    """df with code: the value's rank in its key's dictionary, or 0 where it is not in it."""
    return df.join(dictionary.select(key, value, F.col("rank").alias("code")), [key, value], "left").withColumn("code", F.coalesce("code", F.lit(0)))
