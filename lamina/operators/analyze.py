"""Fingerprints, byte statistics, buckets and their types."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.kernels import arrow
from lamina.operators.ordering import largest

TERM_CAP, TEXT_SHARE, ANALYZE_BYTES, METRIC_FILES, METRIC_BYTES = 20, 0.85, 262_144, 4, 65_536


def sampled(df: DataFrame, content: str, limit: int = ANALYZE_BYTES) -> DataFrame:
    """size, analyzed_bytes, sampled and the prefix of each file."""
    size = F.length(content).cast("long")
    return df.withColumns({"size": size, "analyzed_bytes": F.least(size, F.lit(limit)), "sampled": size > limit, "prefix": F.substring(content, 1, limit)})


def histogram(content):
    """256 counters of each binary value, as an array."""
    return arrow.column(lambda v: np.bincount(np.frombuffer(v, "u1"), minlength=256).tolist(), "array<long>")(content)


def bytes_of(df: DataFrame, key: str, content: str) -> DataFrame:
    """key, byte (0 to 255), cnt of the bytes that occur."""
    return df.select(key, F.posexplode(histogram(F.col(content))).alias("byte", "cnt")).filter("cnt > 0")


def entropy(histogram: DataFrame, key: str) -> DataFrame:
    """Bits a byte: log2(n) - sum(c log2 c) / n."""
    n = F.sum("cnt")
    return histogram.groupBy(key).agg(n.alias("n_bytes"), (F.log2(n) - F.sum(F.col("cnt") * F.log2("cnt")) / n).alias("entropy"))


def is_text(chars):
    return C.printable_ratio(chars) >= TEXT_SHARE


def features(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, token, weight: lower-case word features, each weighing its count, 20 at most."""
    found = df.select(key, F.explode(C.matches(F.lower(text), C.FEATURES, 0)).alias("token"))
    return found.groupBy(key, "token").agg(F.least(F.count("*"), F.lit(TERM_CAP)).alias("weight"))


#: Fixed values of the queries whose SQL has them: bytes by which a text is told, lines of a text without words, bytes of a binary. All others take whole files.
BOUNDS = 1_000_000, 5000, 200_000
#: Fixed value: what separates lines of text, beyond what separates those of bytes.
TEXT_LINES = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"


def marked(df: DataFrame, key: str, content: str, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """key, branch (empty, tokens, lines, bin4) and items (array<binary>): what the fingerprint of each file takes; of bin4 in one piece, which is cut up later.

    Texts give lower-case words of two characters or more, or else, without any, their lines that aren't blank; other files give
    their bytes four at a time. All of a file is taken, but for bounds (see BOUNDS); words are always those of the whole text.
    """
    head, most, binary = bounds or (None, None, None)
    first = lambda n: F.col(content) if n is None else F.substring(content, 1, n)
    text = F.lower(F.replace(F.make_valid_utf8(F.col(content).cast("string")), F.lit("\ufffd"), F.lit("")))
    taken = df.select(key, (F.length(content) == 0).alias("none"), is_text(C.latin1_of(first(head))).alias("is_text"), text.alias("text"), first(binary).alias("bytes"))
    words = C.matches(F.col("text"), C.FEATURES, 0)
    branch = F.when(F.col("none"), "empty").when(~F.col("is_text"), "bin4").when(F.col("text").rlike(C.FEATURES), "tokens").otherwise("lines")
    rows = taken.withColumn("branch", branch)
    of_lines = F.filter(F.split("text", TEXT_LINES, -1), lambda x: x.rlike(r"(?U)[^\s\x1f]"))
    of_lines = of_lines if most is None else F.slice(of_lines, 1, most)
    utf8 = lambda a: F.transform(a, lambda x: F.encode(x, "UTF-8"))
    items = F.when(F.col("branch") == "tokens", utf8(words)).when(F.col("branch") == "lines", utf8(of_lines)).when(F.col("branch") == "bin4", F.array("bytes")).otherwise(F.array().cast("array<binary>"))
    return rows.select(key, "branch", items.alias("items"))


def _md5(token: bytes) -> bytes:
    return hashlib.md5(token, usedforsecurity=False).digest()[:8]


#: Items are compared so many bytes at a time, and hashed so many at a time.
ITEM_BYTES, AT_ONCE = 1 << 20, 1 << 14


def _voted(keys: list, branches: list[str], items: pa.ListArray, digest) -> list[int | None]:
    """Each key's fingerprint (signed), beside each of its rows: equal keys are neighbours. An empty file's is 0; without features, or a key, all bits are set.

    A bit is set where the weight of the tokens whose hash has it is half of all or more. Equal items of a key and branch are one token.
    """
    new = np.array([True, *(a != b for a, b in zip(keys[1:], keys))])
    key_no = np.cumsum(new) - 1
    kinds = np.array([branch == "tokens" for branch in branches])
    groups, binary = 2 * key_no + kinds, np.array([branch == "bin4" for branch in branches])
    tokens = items.filter(pa.array(~binary)).flatten().dictionary_encode()
    rows = np.repeat(groups[~binary], [len(x) if x.is_valid else 0 for x in items.filter(pa.array(~binary))])
    fours = [np.frombuffer(data, "<u4", len(data) // 4) for (data,) in items.filter(pa.array(binary)).to_pylist()]
    four, of = np.unique(np.concatenate([np.zeros(0, "<u4"), *fours]), return_inverse=True)
    words, m = tokens.dictionary, len(tokens.dictionary)
    rows = np.concatenate([rows, np.repeat(groups[binary], [len(x) for x in fours])]).astype(np.int64)
    index = np.concatenate([tokens.indices.to_numpy(), of + m]).astype(np.int64)
    votes = [-1] * (int(key_no[-1]) + 1)
    if n := m + len(four):
        hashes = np.empty((n, 8), np.uint8)
        for k in range(0, n, AT_ONCE):  # only so many are ever values or bits at once
            data = four[max(0, k - m) : max(0, k + AT_ONCE - m)].tobytes()
            some = words[k : k + AT_ONCE].to_pylist() + [data[i : i + 4] for i in range(0, len(data), 4)]
            hashes[k : k + AT_ONCE] = np.frombuffer(b"".join(map(digest, some)), np.uint8).reshape(len(some), 8)
        found, weight = np.unique(rows * n + index, return_counts=True)
        group, token = found // n, found % n
        weight = np.where(group % 2 == 1, np.minimum(weight, TERM_CAP), weight)
        begins = np.flatnonzero(np.r_[True, group[1:] // 2 != group[:-1] // 2])
        for a, z in zip(begins.tolist(), [*begins[1:].tolist(), len(group)]):
            ones = np.zeros(64)
            for k in range(a, z, AT_ONCE):
                some = slice(k, min(z, k + AT_ONCE))
                ones += weight[some].astype(np.float64) @ np.unpackbits(hashes[token[some]], axis=1)
            votes[int(group[a]) // 2] = int.from_bytes(np.packbits(2 * ones >= weight[a:z].sum()).tobytes(), "big", signed=True)
    return [0 if branch == "empty" else -1 if key is None else votes[k] for key, branch, k in zip(keys, branches, key_no.tolist())]


def fingerprints(df: DataFrame, key: str, content: str, digest=_md5, bounds: tuple[int, int, int] | None = None) -> DataFrame:
    """key, branch, simhash64 (DECIMAL(20,0)) of each file (binary content). digest: eight bytes for a token. bounds: see marked().

    The rows of one key come side by side, and their tokens are counted there; no row a token is ever made.
    """
    rows = df.select(key, content).repartition(key).sortWithinPartitions(key)

    def run(batches):
        held: list[pa.RecordBatch] = []

        def out():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            keys, branches = whole.column(0), whole.column(1)
            return pa.RecordBatch.from_arrays([keys, branches, pa.array(_voted(keys.to_pylist(), branches.to_pylist(), whole.column(2), digest), pa.int64())], [key, "branch", "h"])

        for batch in batches:
            for columns in arrow.pieces(tuple(batch.columns), ITEM_BYTES):
                piece, keys = pa.RecordBatch.from_arrays(list(columns), batch.schema.names), columns[0].to_pylist()
                last = len(keys) - 1  # where the last key begins: it may go on
                while last and keys[last - 1] == keys[-1]:
                    last -= 1
                held.append(piece.slice(0, last))
                if last:
                    yield out()
                    held = []
                held.append(piece.slice(last))
        if held:
            yield out()

    marks = marked(rows, key, content, bounds)
    return marks.mapInArrow(run, f"`{key}` {dict(marks.dtypes)[key]}, branch string, h long").select(key, "branch", C.unsigned(F.col("h")).alias("simhash64"))


def bucket(simhash64, buckets: int):
    return F.pmod(simhash64, F.lit(buckets).cast("decimal(20,0)")).cast("int")


def bucket_metrics(df: DataFrame, group: str, key: str, content: str, files: int = METRIC_FILES, limit: int = METRIC_BYTES) -> DataFrame:
    """entropy, null_ratio, printable_ratio, digit_ratio, newline_density and utf8_ok of the first bytes of each group's largest files, side by side."""
    sized = df.select(group, key, content).withColumn("_size", F.length(content)).filter("_size > 0")
    sample = largest(sized, group, files, "_size", key).withColumn("chunk", F.substring(content, 1, limit))
    valid = sample.groupBy(group).agg(F.is_valid_utf8(F.expr("listagg(chunk) within group (order by rank)").cast("string")).alias("utf8_ok"))  # files * limit bytes at most
    hist = sample.select(group, F.posexplode(histogram(F.col("chunk"))).alias("byte", "cnt")).groupBy(group, "byte").agg(F.sum("cnt").alias("cnt")).filter("cnt > 0")
    n, byte = F.sum("cnt"), F.col("byte")
    share = lambda cond: F.sum(F.when(cond, F.col("cnt")).otherwise(0)) / n
    shares = hist.groupBy(group).agg(
        n.alias("n_bytes"),
        (F.log2(n) - F.sum(F.col("cnt") * F.log2("cnt")) / n).alias("entropy"),
        share(byte == 0).alias("null_ratio"),
        share(byte.between(32, 126) | byte.isin(9, 10, 13)).alias("printable_ratio"),
        share(byte.between(48, 57)).alias("digit_ratio"),
        share(byte == 10).alias("newline_density"),
    )
    return shares.join(valid, group)


def bucket_type():
    """Of bucket_metrics()' columns."""
    noise = (F.col("entropy") > 6.6) & (F.col("printable_ratio") < 0.65) & ~F.col("utf8_ok")
    return F.when(F.col("null_ratio") > 0.01, "binaryish").when(noise, "binaryish").when(F.col("digit_ratio") >= 0.10, "mixed_text_nums").otherwise("textish")
