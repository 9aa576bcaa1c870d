"""Archives of blobs with an index: a Spark data source, and its writer.

A file is the blobs side by side, an index (zlib over JSON lines, the last of which is a trailer with the
hash of the others), and 16 bytes: magic, index length (8 bytes, little-endian), CRC-32 of the index.

Reading: one partition an archive; filters on rel prune entries before their blobs are read, and with
blobs=false none is. Files are opened through pyarrow's file systems, so any store it knows will do.
Writing: one task an archive; entries stream to a temporary file of the attempt's own, renamed when it is whole, so that
an attempt that fails or is run twice leaves no part of an archive under its name.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition, StringStartsWith

from lamina.errors import CorruptPayload, HashMismatch
from lamina.functions import columns as C

MAGIC, TRAILER, RESOURCE = b"GCA1", "gca.index_trailer.v1", "__res__/"
SCHEMA = "archive string, rel string, offset long, length long, kind string, res_name string, blob_sha256 string, blob_crc32 long, meta string, blob binary"


def index_bytes(entries: list[dict]) -> bytes:
    body = "".join(json.dumps(e, ensure_ascii=False, sort_keys=True) + "\n" for e in entries)
    last = {"kind": "trailer", "schema": TRAILER, "index_body_sha256": hashlib.sha256(body.encode()).hexdigest(), "entries": len(entries)}
    packed = zlib.compress((body + json.dumps(last, sort_keys=True) + "\n").encode(), 9)
    return packed + MAGIC + struct.pack("<QI", len(packed), zlib.crc32(packed))


def read_index(f, size: int) -> list[dict]:
    """The entries of an open archive of ``size`` bytes."""
    if size < 16:
        raise CorruptPayload("an archive is shorter than its trailer")
    f.seek(size - 16)
    magic, length, crc = struct.unpack("<4sQI", f.read(16))
    if magic != MAGIC or length > size - 16:
        raise CorruptPayload("not an archive")
    f.seek(size - 16 - length)
    packed = f.read(length)
    if zlib.crc32(packed) != crc:
        raise CorruptPayload("the archive's index has another checksum")
    lines = zlib.decompress(packed).decode().splitlines()
    entries = [json.loads(x) for x in lines]
    if entries and entries[-1].get("kind") == "trailer":
        body = "".join(x + "\n" for x in lines[:-1])
        if hashlib.sha256(body.encode()).hexdigest() != entries[-1]["index_body_sha256"]:
            raise HashMismatch("the index body has another hash")
        entries = entries[:-1]
    return entries


class ArchiveWriter:
    def __init__(self, f):
        self.f, self.at, self.entries = f, 0, []

    def append(self, rel: str, blob: bytes, **meta) -> dict:
        entry = {"rel": rel, "offset": self.at, "length": len(blob), "blob_sha256": hashlib.sha256(blob).hexdigest(), "blob_crc32": zlib.crc32(blob), **meta}
        self.f.write(blob)
        self.at += len(blob)
        self.entries.append(entry)
        return entry

    def append_resource(self, name: str, blob: bytes, **meta) -> dict:
        return self.append(RESOURCE + name, blob, kind="resource", res_name=name, **meta)

    def close(self) -> None:
        self.f.write(index_bytes(self.entries))


def _open(path: str):
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


@dataclass
class Archive(InputPartition):
    path: str


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.path, self.blobs, self.rel, self.prefix = options["path"], str(options.get("blobs", "true")).lower() == "true", None, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("rel",):
                self.rel = f.value
            elif isinstance(f, StringStartsWith) and f.attribute == ("rel",):
                self.prefix = f.value
            yield f  # Spark filters again; here filters only save reading

    def partitions(self):
        store, path = _open(self.path)
        info = store.get_file_info(path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        return [Archive(x.path) for x in found if x.is_file and x.path.endswith(".gca")]

    def read(self, partition):
        store, _ = _open(self.path)
        size = store.get_file_info(partition.path).size
        with store.open_input_file(partition.path) as f:
            for e in read_index(f, size):
                rel = e["rel"]
                if self.rel is not None and rel != self.rel or self.prefix is not None and not rel.startswith(self.prefix):
                    continue
                blob = None
                if self.blobs:
                    f.seek(e["offset"])
                    blob = f.read(e["length"])
                extra = {k: v for k, v in e.items() if k not in ("rel", "offset", "length", "kind", "res_name", "blob_sha256", "blob_crc32")}
                yield partition.path.rsplit("/", 1)[-1], rel, e["offset"], e["length"], e.get("kind"), e.get("res_name"), e.get("blob_sha256"), e.get("blob_crc32"), json.dumps(extra, sort_keys=True), blob


class ArchiveSource(DataSource):
    """spark.dataSource.register(ArchiveSource); spark.read.format("archive").option("path", folder)."""

    @classmethod
    def name(cls):
        return "archive"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return ArchiveReader(self.options)


def write_archives(files: DataFrame, folder: str) -> DataFrame:
    """files: archive, rel, blob, meta (JSON or null). One file an archive; returns archive, entries, bytes.

    Rows of an archive stream in order of rel through one task, as its bytes follow each other; what is
    held is one blob and the index. Resources (rel under __res__/) come first.
    """
    rows = files.select("archive", "rel", "blob", "meta").withColumn("_res", ~F.startswith("rel", F.lit(RESOURCE)))
    ordered = rows.repartition("archive").sortWithinPartitions("archive", "_res", "rel")

    def run(batches):
        store, root = _open(folder)
        store.create_dir(root)
        now, writer, f, done, part = None, None, None, [], ""

        def finish():
            writer.close()
            f.close()
            store.move(part, f"{root}/{now}.gca")
            done.append((now, len(writer.entries), writer.at))

        for b in batches:
            for archive, rel, blob, meta in zip(*(b.column(c).to_pylist() for c in ("archive", "rel", "blob", "meta"))):
                if archive != now:
                    if writer:
                        finish()
                    now = archive
                    part = f"{root}/.{now}.{uuid.uuid4().hex}.tmp"
                    f = store.open_output_stream(part)
                    writer = ArchiveWriter(f)
                more = json.loads(meta) if meta else {}
                if rel.startswith(RESOURCE):
                    writer.append_resource(rel[len(RESOURCE) :], blob, **more)
                else:
                    writer.append(rel, blob, **more)
        if writer:
            finish()
        if done:
            a, n, size = zip(*done)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["archive", "entries", "bytes"])

    return ordered.mapInArrow(run, "archive string, entries long, bytes long")


def write_loose(files: DataFrame, folder: str) -> DataFrame:
    """files: rel, blob. One file each, below folder, named by rel; returns rel, bytes."""

    def run(batches):
        store, root = _open(folder)
        for b in batches:
            done = []
            for rel, blob in zip(b.column("rel").to_pylist(), b.column("blob").to_pylist()):
                path = f"{root}/{rel}"
                store.create_dir(path.rsplit("/", 1)[0])
                part = f"{path}.{uuid.uuid4().hex}.tmp"
                with store.open_output_stream(part) as f:
                    f.write(blob)
                store.move(part, path)
                done.append((rel, len(blob)))
            if done:
                r, n = zip(*done)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array(n, pa.int64())], ["rel", "bytes"])

    return files.select("rel", "blob").mapInArrow(run, "rel string, bytes long")


def entry_violations(index: DataFrame) -> DataFrame:
    """archive, rel, violation of index entries that can't be right: no rel, negative places, overlaps, hashes that are none."""
    bad = (F.coalesce("rel", F.lit("")) == "") | (F.col("offset") < 0) | (F.col("length") < 0) | (F.col("blob_sha256").isNotNull() & ~C.is_sha256(F.col("blob_sha256")))
    wrong = index.filter(bad).select("archive", "rel")
    before = F.max(F.col("offset") + F.col("length")).over(Window.partitionBy("archive").orderBy("offset", "length", "rel").rowsBetween(Window.unboundedPreceding, -1))
    overlaps = index.filter(~bad & (F.col("length") > 0)).withColumn("_end", before).filter("offset < _end").select("archive", "rel")
    return wrong.unionByName(overlaps).select("archive", "rel", F.lit("corrupt_payload").alias("violation"))


def violations(archives: DataFrame) -> DataFrame:
    """archive, rel, violation of entries whose blobs don't have the index's hashes. Reads all blobs."""
    bad = F.when(F.sha2("blob", 256) != F.col("blob_sha256"), "hash_mismatch").when(F.crc32("blob") != F.col("blob_crc32"), "hash_mismatch").when(F.length("blob") != F.col("length"), "corrupt_payload")
    return archives.select("archive", "rel", bad.alias("violation")).filter("violation is not null")
