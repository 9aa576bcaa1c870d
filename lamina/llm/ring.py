"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns ``vnodes`` arcs of the ring. A row's place is the hash of its text (equal texts share
one), or of its doc_id where the text is null. A shard is full at its capacity; rows beyond go on
clockwise to the next arc whose shard has room. Capacities are the row count divided evenly, so row
counts end at most one apart (law ``rows``), and a row leaves its own shard only where that is full.

Rows are ranked in ring order (place, doc_id, then position in the input) by a range partitioning, so
one text with a third of all rows spreads over partitions. The driver sees one count for each arc
within each partition, never rows; the placement table it makes has a few rows for each arc.

Nulls: a null text has size 16 and checksum 0. Repeated rows get slots of their own. An empty table
gives no rows. Other columns are kept only by assign().
"""

from __future__ import annotations

import hashlib
from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import own_columns, written

SHARDS, VNODES = 40, 64


def _place(key: str) -> int:
    return int.from_bytes(hashlib.blake2b(key.encode(), digest_size=8).digest(), "big", signed=True)


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """The arcs' ends in ascending order, and the shard of each."""
    points = sorted((_place(f"{s}/{v}"), s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def capacities(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def placement(counts: list[int], owners: list[int], capacity: list[int]) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, end rank, shard, first slot). counts: rows of each arc.

    A shard's own rows come first, in ring order; then, in walks round the ring, overflow goes in
    where there is room, the longest waiting first.
    """
    out, used, over = [], [0] * len(capacity), [None] * len(counts)
    for arc, n in enumerate(counts):
        s = owners[arc]
        own = min(n, capacity[s] - used[s])
        if own:
            out.append((arc, 0, own, s, used[s]))
            used[s] += own
        if own < n:
            over[arc] = (own, n)
    waiting: deque[list[int]] = deque()
    for turn in range(len(counts) * 2):
        arc = turn % len(counts)
        s = owners[arc]
        while waiting and used[s] < capacity[s]:
            from_arc, a, b = waiting[0]
            take = min(b - a, capacity[s] - used[s])
            out.append((from_arc, a, a + take, s, used[s]))
            used[s] += take
            waiting[0][1] += take
            if waiting[0][1] == b:
                waiting.popleft()
        if turn < len(counts) and over[arc]:
            waiting.append([arc, *over[arc]])
    assert not waiting, "capacities are below the row count"
    return out


def _arcs(ends: list[int]):
    """Number of the first arc end at or after each place; places beyond the last end are an arc of their own, with the owner of arc 0."""
    points = np.array(ends, np.int64)

    @F.pandas_udf("int")
    def arc(place: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(points, place.to_numpy(), "left").astype(np.int32))

    return arc


def assign(rows: DataFrame, shards: int = SHARDS, vnodes: int = VNODES) -> DataFrame:
    """rows with ``place`` (long) and ``doc_id``, with shard, slot (gapless from 0 in each shard) and own_shard, the one that its arc belongs to."""
    spark = rows.sparkSession
    ends, owners = ring(shards, vnodes)
    owners = [*owners, owners[0]]
    keys = ("place", "doc_id", "_row")
    ordered = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys)
    ordered = ordered.drop("_row").withColumns({"_part": F.spark_partition_id(), "_n": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    ordered = written(ordered.withColumn("_arc", _arcs(ends)("place")))
    held = ordered.groupBy("_arc", "_part").agg(F.count("*").alias("n"), F.min("_n").alias("first")).collect()
    counts, bases = [0] * len(owners), []
    # Within an arc, ranks follow the parts; each part has the arc's rows side by side.
    by_arc = defaultdict(list)
    for arc, part, n, first in held:
        by_arc[arc].append((part, n, first))
    for arc, found in by_arc.items():
        for part, n, first in sorted(found):
            bases.append((arc, part, counts[arc] - first))
            counts[arc] += n
    placed = placement(counts, owners, capacities(sum(counts), shards))
    rank = spark.createDataFrame(bases or [(0, 0, 0)], "_arc int, _part int, _base long")
    table = spark.createDataFrame(placed or [(0, 0, 0, 0, 0)], "_arc int, _from long, _to long, shard int, _slot long")
    own = F.element_at(F.lit(owners), F.col("_arc") + 1)
    ranked = ordered.join(F.broadcast(rank), ["_arc", "_part"]).withColumn("_rank", F.col("_n") + F.col("_base"))
    joined = ranked.join(F.broadcast(table), (ranked["_arc"] == table["_arc"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(table["_arc"])
    return joined.withColumns({"slot": F.col("_slot") + F.col("_rank") - F.col("_from"), "own_shard": own.cast("int")}).drop("_part", "_n", "_base", "_rank", "_from", "_to", "_slot", "_arc")


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, own_shard of all documents. Texts aren't shuffled."""
    text = F.coalesce("text", F.lit(""))
    rows = own_columns(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNull(), F.xxhash64(F.lit("id"), "doc_id")).otherwise(F.xxhash64("text")).alias("place"),
    )
    return assign(rows, shards).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "own_shard")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """All columns of the documents, one folder a shard, in slot order within each file. Salted, so that a shard has several writers.

    A document's row is one column, ``row``, beside slot, so that documents may have columns of any name.
    """
    text = F.when(F.col("text").isNull(), F.xxhash64(F.lit("id"), "doc_id")).otherwise(F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("place"), F.struct(*(F.col(f"`{n}`") for n in docs.columns)).alias("row"))
    placed = assign(rows, shards).select("shard", "slot", "row")
    placed.repartition(F.col("shard"), F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
