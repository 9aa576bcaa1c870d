"""The kernels as Arrow-backed column functions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.kernels import codecs, containers


#: What is turned into Python values at once: rows, and bytes of a batch's share.
ROWS, BYTES = 200, 4 << 20


def pieces(columns: tuple[pa.Array, ...], size: int = BYTES) -> Iterator[tuple[pa.Array, ...]]:
    """The columns a few hundred rows at a time, and fewer where rows are long."""
    n = len(columns[0])
    step = max(1, min(ROWS, n * size // max(1, sum(c.nbytes for c in columns))))
    for k in range(0, n, step):
        yield tuple(c.slice(k, step) for c in columns)


def by_pieces(f, kind: str):
    """f (from lists of values to a list) as a column function. A batch of Spark's has up to 10,000 rows; only a piece of it is ever held as Python values, and each piece's results are sent on."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for batch in batches:
            for piece in pieces(batch if isinstance(batch, tuple) else (batch,)):
                yield pa.array(f(*(c.to_pylist() for c in piece)))

    return F.arrow_udf(run, kind)


def column(f, kind: str = "binary"):
    """A function of one row's values as a column function; where one is null the result is."""
    return by_pieces(lambda *columns: [None if None in row else f(*row) for row in zip(*columns)], kind)


def encode(layer: str, codec: str):
    return column(partial(containers.encode, layer=layer, codec=codec))


def decode():
    return column(containers.decode)


def streams(blob: str) -> Column:
    """stype, codec and ulen of the streams of a container."""
    found = lambda b: [{"stype": s.stype, "codec": s.codec, "ulen": s.ulen} for s in containers.unbundle(containers.unframe(b).payload)]
    return column(found, "array<struct<stype:int,codec:int,ulen:long>>")(blob)


def huffman_total(kind: str = "long"):
    return column(lambda counts: codecs.huffman_bits(counts) if counts else 0, kind)


def float_bytes(name: str) -> Column:
    """An array of floats as little-endian bytes."""
    return column(lambda x: np.asarray(x, "<f4").tobytes())(name)


def blake2(token: bytes) -> bytes:
    """The first eight bytes of BLAKE2b."""
    return hashlib.blake2b(token, digest_size=8).digest()


def concat_hashes(df: DataFrame, group: str, order: str, text: str) -> DataFrame:
    """group, concat_sha256, n_bytes: the hash of each group's texts in order. They stream through; none is gathered."""
    rows = df.select(group, order, text).repartition(group).sortWithinPartitions(group, order)

    def run(batches):
        now, h, n, out = None, None, 0, []
        for b in batches:
            for g, t in zip(b.column(group).to_pylist(), b.column(text).to_pylist()):
                if h is None or g != now:
                    if h:
                        out.append((now, h.hexdigest(), n))
                    now, h, n = g, hashlib.sha256(), 0
                data = (t or "").encode()
                h.update(data)
                n += len(data)
        if h:
            out.append((now, h.hexdigest(), n))
        if out:
            g, s, c = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(s), pa.array(c, pa.int64())], [group, "concat_sha256", "n_bytes"])

    return rows.mapInArrow(run, f"{group} string, concat_sha256 string, n_bytes long")


def restore_slices(df: DataFrame, group: str, key: str, text: str, block: int) -> DataFrame:
    """key, content: texts cut back out of their group's concatenation, which is held as blocks of bytes, so that it may be of any size."""
    from lamina.bundles import blocks, slices
    from lamina.operators.relations import bundle_offsets

    files = df.select(group, key, F.encode(text, "UTF-8").alias("content")).withColumn("length", F.length("content").cast("long"))
    placed = bundle_offsets(files, group, key, "length")
    return slices(placed.drop("content"), blocks(placed, group, block), group, key, block).select(key, "content")
