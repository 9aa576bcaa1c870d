"""Packing by concatenating and cutting.

All documents' ids form one stream; fixed windows of the stream are the sequences. A document is
cut wherever a window ends, so only the last sequence has padding. The global offset of each
document comes from two-pass prefix sums; a record for each piece says where it lies.

Nulls: a null text is empty and yields the end id alone; a null doc_id is kept. Repeated rows are
packed each on its own. Empty tables give no pieces. Other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import Scratch, own_columns, resident
from lamina.llm.prefix import with_base
from lamina.llm.wordbpe import encoder

SEQUENCE = 2048
#: Documents that are cut at once.
ROWS = 500


def encoded(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, before (ids of this part's earlier documents), doc_id, n, ids (binary, little-endian unsigned 32-bit)."""

    def encode(batches):
        part, before, encode = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for whole in batches:
            for batch, ids, ends in encode.batches(whole, end_id):
                starts = np.r_[0, ends[:-1]]
                binary = pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer((4 * np.r_[0, ends]).astype(np.int32)), pa.py_buffer(ids)])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ends), part, np.int32)), pa.array(before + starts), batch.column("doc_id").cast(pa.int64()), pa.array(ends - starts), binary], ["part", "before", "doc_id", "n", "ids"])
                before += int(ends[-1])

    return own_columns(docs, "doc_id", "text").mapInArrow(encode, "part int, before long, doc_id long, n long, ids binary")


def pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = SEQUENCE, keep_ids: bool = False) -> DataFrame:
    """One row for each piece of each document: the boundary records (and the ids, if asked for)."""
    scratch = Scratch(docs.sparkSession)
    placed = with_base(scratch.written(encoded(docs, tokenizer, end_id)), "n")

    def cut(batches):
        resident("cut", dict)  # this worker's word caches go: a run encodes once
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                n, first = np.asarray(batch.column("n")), np.asarray(batch.column("base")) + np.asarray(batch.column("before"))
                # a document has a piece in each sequence from its first id's to its last one's
                held = np.where(n > 0, (first + n - 1) // length - first // length + 1, 0)
                row = np.repeat(np.arange(len(n)), held)
                sequence = (first // length)[row] + np.arange(len(row)) - np.repeat(np.cumsum(held) - held, held)
                begin, end = np.maximum(first[row], sequence * length), np.minimum((first + n)[row], (sequence + 1) * length)
                start, take = begin - first[row], end - begin
                ids = batch.column("ids")
                offsets = np.frombuffer(ids.buffers()[1], np.int32, ids.offset + len(ids) + 1)[ids.offset :].astype(np.int64)
                a, data = offsets[row] + 4 * start, memoryview(ids.buffers()[2] or b"")
                spans = list(zip(a.tolist(), (a + 4 * take).tolist()))
                crc = [zlib.crc32(data[i:j]) for i, j in spans]
                for at in range(0, len(row), 20_000):
                    now = slice(at, at + 20_000)
                    columns = [batch.column("doc_id").take(pa.array(row[now])), *(pa.array(c[now], pa.int64()) for c in (start, take, crc, n[row], sequence, begin - sequence * length))]
                    yield pa.RecordBatch.from_arrays(columns + ([pa.array([bytes(data[i:j]) for i, j in spans[now]], pa.binary())] if keep_ids else []), names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    return scratch.keep(placed.mapInArrow(cut, ", ".join(f"{n} {'binary' if n == 'ids' else 'long'}" for n in names)))


def sequences(cut: DataFrame, pad_id: int = 0, length: int = SEQUENCE) -> DataFrame:
    """sequence_id, ids (exactly ``length``, padded at the end), doc_ids and starts of its pieces in order.

    Takes pieces(..., keep_ids=True). A group holds at most ``length`` ids, whatever the data.
    """

    def fill(group: pa.Table) -> pa.Table:
        group = group.sort_by("offset")
        ids = np.frombuffer(b"".join(group["ids"].to_pylist()), "<u4").astype(np.int64)
        ids = np.concatenate([ids, np.full(length - len(ids), pad_id, np.int64)])
        one = {"sequence_id": group["sequence_id"][:1].to_pylist(), "ids": [ids.tolist()], "doc_ids": [group["doc_id"].to_pylist()], "starts": [group["offset"].to_pylist()]}
        return pa.table(one, pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("doc_ids", pa.list_(pa.int64())), ("starts", pa.list_(pa.int64()))]))

    return cut.groupBy("sequence_id").applyInArrow(fill, "sequence_id long, ids array<int>, doc_ids array<long>, starts array<long>")


def waste(cut: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Sequences, ids and padding of a packing."""
    return cut.agg(F.max("sequence_id").alias("last"), F.sum("length").alias("ids")).select((F.coalesce("last", F.lit(-1)) + 1).alias("sequences"), F.coalesce("ids", F.lit(0)).alias("ids"), ((F.coalesce("last", F.lit(-1)) + 1) * length - F.coalesce("ids", F.lit(0))).alias("padding"))
