import hashlib
import heapq
import re
import zlib
from collections import Counter

import pytest
from oracle import compare
from pyspark.sql import functions as F

from lamina.plans import catalogue

D = "/root/testdata/sf0.001"
SQL = catalogue.oracle_sql()


@pytest.mark.parametrize("name", list(catalogue.queries()))
def test_query(spark, name):
    f = catalogue.queries()[name]
    if name in SQL:
        compare(spark, name, f, SQL[name], D)
    else:
        assert f(spark, D).count() == 200


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_concatenation_takes_all_documents(spark):
    total = spark.read.parquet(f"{D}/documents.parquet").selectExpr("sum(octet_length(text)) AS n").first().n
    assert catalogue.queries()["concat_sha256"](spark, D).selectExpr("sum(n_bytes) AS n").first().n == total


def test_queries_without_sql(spark):
    """Checksums, Huffman sizes and BLAKE2b fingerprints, computed apart."""
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{D}/documents.parquet").collect()}
    assert {r.doc_id: r.crc for r in catalogue.queries()["crc32_blobs"](spark, D).collect()} == {i: zlib.crc32(t) for i, t in texts.items()}

    def bits(data):
        heap = list(Counter(data).values())
        if len(heap) == 1:
            return heap[0]
        heapq.heapify(heap)
        total = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            total += both
            heapq.heappush(heap, both)
        return total

    assert {r.doc_id: r.bits for r in catalogue.queries()["huffman_total_bits"](spark, D).collect()} == {i: bits(t) for i, t in texts.items()}
    got = {r.doc_id: int(r.simhash64) for r in catalogue.queries()["simhash64_blake2b"](spark, D).collect()}
    printable = {9, 10, 13, *range(32, 127)}
    for i, t in list(texts.items())[:60]:
        if sum(b in printable for b in t) < 0.85 * len(t):
            items = Counter(t[k : k + 4] for k in range(0, min(len(t), 200_000) - 3, 4))
        else:
            items = Counter({w: min(n, 20) for w, n in Counter(x.encode() for x in re.findall("[A-Za-z0-9_]{2,}", t.decode().lower())).items()})
        votes = [0] * 64
        for token, n in items.items():
            h = int.from_bytes(hashlib.blake2b(token, digest_size=8).digest(), "big")
            for k in range(64):
                votes[k] += n if h >> k & 1 else -n
        assert got[i] == sum(1 << k for k in range(64) if votes[k] >= 0), i


def _table(spark, folder, texts):
    """documents of these texts, as one file."""
    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_vc0_shuffles_nothing(spark, tmp_path):
    """Each document is taken apart and put together in its row; empty and null texts too."""
    d = _table(spark, tmp_path, ["Ab\u00e9 1\n", "", None, "x" * 1000])
    df = catalogue.queries()["layer_vc0_counts"](spark, d)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in df.collect()) == [(0, 7, 1, 2, True), (1, 0, 0, 0, True), (2, None, None, None, True), (3, 1000, 0, 1000, True)]


def test_columns_take_pieces(spark):
    """A column function never holds a whole batch of Spark's as Python values."""
    from lamina.kernels import arrow

    sizes = arrow.by_pieces(lambda c: [len(c)] * len(c), "int")
    rows = spark.range(3000, numPartitions=1).selectExpr("id", "cast(repeat('x', if(id < 1000, 10, 100000)) as binary) AS content")
    got = {(r.id < 1000): r.n for r in rows.select("id", sizes("content").alias("n")).groupBy((F.col("id") < 1000).alias("id")).agg(F.max("n").alias("n")).collect()}
    assert got[True] <= arrow.ROWS and got[False] <= arrow.ROWS and [r.n for r in spark.range(0).select(sizes(F.lit(b"x")).alias("n")).collect()] == []


def test_routing_of_long_numbers(spark, tmp_path):
    """Numbers of any length leave the text stream, and come back."""
    from lamina.kernels import containers

    texts = ["a +" + "1" * 19 + " b", "0" * 18 + "7", "x -" + "12345678901234567890" * 5 + "\n=5", "none", ""]
    d = _table(spark, tmp_path, [*texts, None])
    got = {r.stype: (r.n, r.ulen) for r in catalogue.queries()["stream_routing"](spark, d).collect()}
    assert got[containers.STREAMS["TEXT"]] == (6, len("a  b" + "x \n=" + "none"))
    for layer in ("split_text_nums", "tpl_lines_v0", "tpl_lines_shared_v0"):
        for t in texts:
            assert containers.decode(containers.encode(t.encode(), layer, "zlib")) == t.encode()


def test_fingerprints_make_no_row_a_token(spark, tmp_path):
    """As SQL has them, for rows of one doc_id side by side too: their tokens are counted together, up to 20 each."""
    texts = ["ab cd " * 12, "--\n++\n", "", "\u0416" * 50, "ab", "\u00e9" * 3]
    rows = [(k % 5, t, "en", "web", len(t)) for k, t in enumerate(texts)] + [(0, "ab ef " * 12, "en", "web", 72), (7, "x y", "en", "web", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    found = _sql_of(spark, tmp_path, "simhash64_md5")
    assert found[0] == found[1] and len(found[0]) == len(rows)
    for name in ("simhash64_md5", "simhash64_blake2b", "byte_shingles", "bucket_assign"):
        assert "Generate" not in catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()


def _long_texts():
    """Texts whose beginning says little: words after a million bytes, lines after 5,000, bytes after a million of text, and after 200,000."""
    return ["aa " * 333_400 + " ".join(f"w{k}" for k in range(300)), "--\n" * 5000 + "".join(f"{'+-' * (k % 7)}{'=' * k}\n" for k in range(300)), "aa " * 333_400 + "\u00e9" * 200_000 + "\u0416" * 100_000, "\u00e9" * 100_000 + "\u0416\u00e9\u0449" * 30_000]


def _whole_fingerprint(data):
    printable = {9, 10, 13, *range(32, 127)}
    if sum(b in printable for b in data) < 0.85 * len(data):
        items = Counter(data[k : k + 4] for k in range(0, len(data) - 3, 4))
    elif words := re.findall(b"[a-z0-9_]{2,}", data):
        items = {w: min(n, 20) for w, n in Counter(words).items()}
    else:
        items = Counter(x for x in data.split(b"\n") if x)
    votes = [0] * 64
    for token, n in items.items():
        h = int.from_bytes(hashlib.md5(token).digest()[:8], "big")
        for k in range(64):
            votes[k] += n if h >> k & 1 else -n
    return sum(1 << k for k in range(64) if votes[k] >= 0)


def test_buckets_take_whole_texts(spark, tmp_path):
    """bucket_assign by all words, lines and bytes; queries whose SQL is bounded keep to it, and is_text_flag's isn't."""
    texts = _long_texts()
    want = {k: _whole_fingerprint(t.encode()) for k, t in enumerate(texts)}
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, sql = _sql_of(spark, tmp_path, "bucket_assign")
    assert got == sql and {i: b for b, i in got} == {i: f % 16 for i, f in want.items()}
    blake = catalogue.queries()["simhash64_blake2b"](spark, str(tmp_path))
    assert blake.select("simhash64").distinct().count() == len(texts)
    for name in ("simhash64_md5", "line_features", "is_text_flag"):
        got, sql = _sql_of(spark, tmp_path, name)
        assert got == sql, name


def test_byte_shingles_take_whole_texts(spark, tmp_path):
    """All bytes, four at a time, of binaries beyond 200,000 and beyond a million."""
    texts = _long_texts()[:3]  # the last one turned over is text
    rows = [(k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got, sql = _sql_of(spark, tmp_path, "byte_shingles")
    turned = {k: bytes(255 - b for b in t.encode()) for k, t in enumerate(texts)}
    assert got == sql and {i: (branch, int(f)) for branch, i, f in got} == {i: ("bin4", _whole_fingerprint(t)) for i, t in turned.items()}


def _sql_of(spark, folder, name):
    """Sorted rows of a query and of its SQL over documents alone."""
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from read_parquet('{folder}/documents.parquet/*.parquet')")
    df = catalogue.queries()[name](spark, str(folder))
    names = sorted(df.columns)
    want = con.execute(f"select {', '.join(names)} from ({SQL[name]})").fetchall()
    return sorted(tuple(r) for r in df.select(*names).collect()), sorted(want)


def test_vocabularies_make_no_row_a_token(spark, tmp_path):
    """Repeated rows count together, as in SQL."""
    texts = ["a b, a c", "", "a b, a c", "Straße 12 ü"]
    rows = [(k % 2 * k, t, "en", "web", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame([*rows, (9, None, "en", "web", 0)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("layer_words_vocab", "layer_syllables_vocab", "layer_words_decode"):
        got, want = _sql_of(spark, tmp_path, name)
        assert got == want, name
        assert "Window" not in catalogue.queries()[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
