"""The catalogue of queries, each with SQL for DuckDB that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.operators import analyze, layers, numeric, ordering, relations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    from lamina.plans import roundtrips, rules  # noqa: F401

    return QUERIES | roundtrips.QUERIES


def oracle_sql() -> dict[str, str]:
    from lamina.plans import roundtrips, rules  # noqa: F401

    return SQL | roundtrips.SQL


def docs(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", *more)


def invoices(spark: SparkSession, d: str) -> DataFrame:
    """One text a customer: lines made from its orders' items. No aggregate of whole lines is needed but to make the text."""
    o, li = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    line = F.format_string("ITEM %d: part=%d qty=%d line %d\n", F.col("l_orderkey"), F.col("l_partkey"), F.col("l_quantity").cast("long"), F.col("l_linenumber"))
    rows = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", line.alias("line"))
    return rows.groupBy("o_custkey").agg(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "line"))), lambda x: x["line"])).alias("text"))


INVOICES = """SELECT o_custkey, string_agg('ITEM ' || l_orderkey || ': part=' || l_partkey || ' qty=' || l_quantity::BIGINT || ' line ' || l_linenumber || chr(10), '' ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS text
 FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""


def _tokens(pattern: str, source: str = "documents", key: str = "doc_id") -> str:
    return f"""t AS (SELECT {key}, unnest(l) AS tok, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT {key}, regexp_extract_all(text, '{pattern}') AS l FROM {source}))"""


WORD = "[A-Za-z]+|[^A-Za-z]+"
CONS = "b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"
SYLLABLE = f"[{CONS}]*[aeiouAEIOU]|[{CONS}]+|[^A-Za-z]+"
LINE = "[^\\r\\n]*(?:\\r\\n|\\r|\\n)|[^\\r\\n]+"
_IDS = """d AS (SELECT doc_id, tok, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS id, count(*) AS n FROM t GROUP BY doc_id, tok)"""
_HEX = "h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)"


# scans and sources


@query("SELECT doc_id, lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 10, '0') || '.txt' AS rel, octet_length(encode(text))::BIGINT AS size, row_number() OVER (ORDER BY lang || '/' || source || '/' || lpad(doc_id::VARCHAR, 10, '0') || '.txt') - 1 AS file_ord FROM documents")
def scan_sorted(spark, d):
    rel = F.concat_ws("/", "lang", "source", F.concat(F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(".txt")))
    return ordering.numbered(docs(spark, d, "lang", "source").select("doc_id", rel.alias("rel"), F.octet_length("text").cast("long").alias("size")), ["rel"])


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS size, least(octet_length(encode(text)), 2048)::BIGINT AS analyzed_bytes, octet_length(encode(text)) > 2048 AS sampled, sha256(unhex(left(hex(encode(text)), 4096))) AS prefix_sha FROM documents")
def sampled_prefix(spark, d):
    df = docs(spark, d).withColumn("content", F.encode("text", "UTF-8"))
    return analyze.sampled(df, "content", 2048).select("doc_id", "size", F.col("analyzed_bytes").cast("long").alias("analyzed_bytes"), "sampled", F.sha2("prefix", 256).alias("prefix_sha"))


@query("SELECT event_id, (props::JSON->>'$.page')::VARCHAR AS page, json_valid(props) AS ok FROM events WHERE json_valid(props)")
def jsonl_records(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    parsed = F.from_json("props", "page string, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    return e.select("event_id", parsed.alias("p")).filter("p is not null and p._bad is null").select("event_id", "p.page", F.lit(True).alias("ok"))


# layers


@query(f"WITH {_tokens(LINE)} SELECT doc_id, pos::INT AS line_no, sha256(tok) AS line_sha FROM t")
def lines_split(spark, d):
    return layers.lines(docs(spark, d), "doc_id", "text").select("doc_id", "line_no", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha"))


@query("SELECT doc_id, sha256(encode(text)) AS sha, octet_length(encode(text))::BIGINT AS n FROM documents")
def layer_bytes(spark, d):
    return docs(spark, d).select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"), F.octet_length("text").cast("long").alias("n"))


_VOWEL, _LETTER = "^([46]1|[46]5|[46]9|[46]F|[57]5)$", "^([46][1-9A-F]|[57][0-9A]|AA|B5|BA|[CE][0-9A-F]|D[0-689A-F]|F[0-689A-F])$"


@query(f"WITH {_HEX} SELECT doc_id, len(b)::BIGINT AS n, len(list_filter(b, lambda x: regexp_matches(x, '{_VOWEL}')))::BIGINT AS n_vowels, len(list_filter(b, lambda x: regexp_matches(x, '{_LETTER}') AND NOT regexp_matches(x, '{_VOWEL}')))::BIGINT AS n_cons, true AS restored FROM h")
def layer_vc0_counts(spark, d):
    df = docs(spark, d).withColumn("want", F.sha2(F.encode("text", "UTF-8"), 256))
    back = layers.unvc0(layers.vc0(df, "doc_id", "text", ("want",)), "doc_id", ("want", "mask"))
    count = lambda c: F.length(F.regexp_replace("mask", f"[^{c}]", "")).cast("long")
    return back.select("doc_id", F.length("mask").cast("long").alias("n"), count("V").alias("n_vowels"), count("C").alias("n_cons"), F.sha2("content", 256).eqNullSafe(F.col("want")).alias("restored"))


def _vocabulary(df, pattern):
    t = layers.coded(df, "doc_id", "text", pattern).filter("size(vocabulary) > 0")
    total = lambda a: F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)
    placed = F.transform("ids", lambda text: total(F.transform(text, lambda i, k: i * (k + 1))))
    return t.select("doc_id", total(F.transform("ids", lambda text: F.size(text).cast("long"))).alias("n_tokens"), F.size("vocabulary").cast("long").alias("vocab_size"), total(placed).alias("id_sum"))


_VOCAB = "SELECT doc_id, count(*) AS n_tokens, max(id) + 1 AS vocab_size, sum(id * (pos + 1))::BIGINT AS id_sum FROM t JOIN d USING (doc_id, tok) GROUP BY doc_id"


@query(f"WITH {_tokens(SYLLABLE)}, {_IDS} {_VOCAB}")
def layer_syllables_vocab(spark, d):
    return _vocabulary(docs(spark, d), C.SYLLABLES)


@query(f"WITH {_tokens(WORD)}, {_IDS} {_VOCAB}")
def layer_words_vocab(spark, d):
    return _vocabulary(docs(spark, d), C.WORDS)


@query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text <> ''")
def layer_words_decode(spark, d):
    texts = layers.coded(docs(spark, d), "doc_id", "text", C.WORDS).select("doc_id", "vocabulary", F.explode("ids").alias("ids")).filter("size(ids) > 0")
    return texts.select("doc_id", F.sha2(layers.looked_up("ids", "vocabulary").cast("binary"), 256).alias("sha"))


@query(f"WITH {_tokens(LINE)}, {_IDS} SELECT doc_id, id::BIGINT AS token_id, sha256(tok) AS line_sha, n FROM d")
def layer_lines_dict(spark, d):
    t = layers.lines(docs(spark, d), "doc_id", "text")
    return layers.dictionary(t, "doc_id", "line", "line_no").select("doc_id", "token_id", F.sha2(F.col("line").cast("binary"), 256).alias("line_sha"), "n")


@query(f"WITH {_tokens(LINE)}, {_IDS}, r AS (SELECT doc_id, pos, id, pos - row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS g FROM t JOIN d USING (doc_id, tok)), g AS (SELECT doc_id, id, g, min(pos) AS p, count(*) AS run FROM r GROUP BY ALL) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS run_no, id::BIGINT AS token_id, run FROM g")
def layer_lines_rle(spark, d):
    t = layers.encoded(layers.lines(docs(spark, d), "doc_id", "text"), "doc_id", "line", "line_no")
    return layers.runs(t, "doc_id", "line_no").select("doc_id", "run_no", "token_id", "run")


_SIGN = r"(^|[\t\n\r (\[{<=:,;])[+-]([0-9])"


@query(f"""SELECT doc_id, len(regexp_extract_all(text, '[0-9]+'))::BIGINT AS n_numbers, coalesce(list_sum(list_transform(regexp_extract_all(text, '[0-9]+'), lambda x: length(x))), 0)::BIGINT AS n_digits, len(regexp_extract_all(text, '{_SIGN}'))::BIGINT AS n_signed FROM documents""")
def layer_split_text_nums(spark, d):
    n = layers.numbers(docs(spark, d), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("n_numbers"), F.sum("digits_len").alias("n_digits"), F.count_if(F.col("sign") > 0).alias("n_signed"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return docs(spark, d).select("doc_id").join(n, "doc_id", "left").select("doc_id", zero("n_numbers"), zero("n_digits"), zero("n_signed"))


@query(rf"""SELECT doc_id, length(regexp_replace(regexp_replace(text, '{_SIGN}', '\1\2', 'g'), '[0-9]+', '', 'g'))::BIGINT AS text_chars, sha256(text) AS sha FROM documents""")
def layer_text_stream(spark, d):
    parts = layers.split_text_nums(docs(spark, d), "doc_id", "text")
    back = layers.joined_text(F.col("chunks"), F.col("raws"))
    return parts.select("doc_id", F.length(F.concat_ws("", "chunks")).cast("long").alias("text_chars"), F.sha2(back.cast("binary"), 256).alias("sha"))


_TPL = rf"""{_tokens(LINE, '(' + INVOICES + ')', 'o_custkey')}, k AS (SELECT o_custkey, pos, regexp_replace(regexp_replace(tok, '{_SIGN}', '\1\2', 'g'), '[0-9]+', '#', 'g') AS tpl, len(regexp_extract_all(tok, '[0-9]+')) AS nums FROM t)"""


def _invoice_templates(spark, d):
    t = layers.templates(invoices(spark, d), "o_custkey", "text")
    return t.withColumn("tpl", F.array_join("template", "#"))


@query(f"WITH {_TPL}, i AS (SELECT o_custkey, tpl, row_number() OVER (PARTITION BY o_custkey ORDER BY min(pos)) - 1 AS id FROM k GROUP BY 1, 2) SELECT o_custkey, count(*) AS n_lines, count(DISTINCT tpl) AS n_templates, sum(nums)::BIGINT AS n_nums, sum(id * (pos + 1))::BIGINT AS id_sum FROM k JOIN i USING (o_custkey, tpl) GROUP BY 1")
def layer_tpl_templates(spark, d):
    t = _invoice_templates(spark, d)
    return t.groupBy("o_custkey").agg(F.count("*").alias("n_lines"), (F.max("template_id") + 1).alias("n_templates"), F.sum(F.size("raws")).alias("n_nums"), F.sum(F.col("template_id") * (F.col("line_no") + 1)).alias("id_sum"))


_DOC_TPL = rf"""{_tokens(LINE)}, k AS (SELECT doc_id, pos, regexp_replace(regexp_replace(tok, '{_SIGN}', '\1\2', 'g'), '[0-9]+', '#', 'g') AS tpl FROM t)"""


@query(f"WITH {_DOC_TPL} SELECT tpl AS template, count(*) AS n_lines, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def tpl_dict_topk(spark, d):
    """The most used line templates. Grouped by the array of chunks, which no character of the text can blur."""
    split = layers.lines(docs(spark, d), "doc_id", "text").select("doc_id", F.split("line", C.NUMBERS, -1).alias("chunks"))
    per_doc = split.groupBy("chunks", "doc_id").agg(F.count("*").alias("n"))
    counted = per_doc.groupBy("chunks").agg(F.sum("n").alias("n_lines"), F.count("*").alias("n_docs"))
    return counted.select(F.array_join("chunks", "#").alias("template"), "n_lines", "n_docs").orderBy(F.desc("n_lines"), "template").limit(20)


@query(f"WITH {_DOC_TPL}, b AS (SELECT tpl, row_number() OVER (ORDER BY count(*) DESC, tpl) - 1 AS base_id FROM k GROUP BY 1 ORDER BY 2 LIMIT 16), m AS (SELECT k.*, base_id FROM k LEFT JOIN b USING (tpl)), x AS (SELECT doc_id, tpl, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) - 1 AS delta FROM m WHERE base_id IS NULL GROUP BY 1, 2) SELECT doc_id, count(*) AS n_lines, count(base_id) AS n_base, sum(coalesce(base_id, (SELECT count(*) FROM b) + delta) * (pos + 1))::BIGINT AS id_sum FROM m LEFT JOIN x USING (doc_id, tpl) GROUP BY 1")
def layer_tpl_shared_delta(spark, d):
    t = layers.templates(docs(spark, d), "doc_id", "text").withColumn("template", F.array_join("template", "#"))
    top = t.groupBy("template").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "template").limit(16)
    base = top.select("n", "template").groupBy().agg(F.collect_list(F.struct((-F.col("n")).alias("n"), "template")).alias("l")).select(F.posexplode(F.transform(F.sort_array("l"), lambda x: x["template"])).alias("base_id", "template"))
    shared = layers.against_base(t, base, "doc_id")
    return shared.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("base_id").alias("n_base"), F.sum(F.col("shared_id") * (F.col("line_no") + 1)).alias("id_sum"))


# numbers


@query("SELECT l_orderkey, l_linenumber, (CASE WHEN l_partkey % 2 = 0 THEN l_partkey ELSE -l_partkey END) AS v, (CASE WHEN l_partkey % 2 = 0 THEN 2 * l_partkey ELSE 2 * l_partkey - 1 END)::BIGINT AS zz, greatest(1, ceil(length(bin((CASE WHEN l_partkey % 2 = 0 THEN 2 * l_partkey ELSE 2 * l_partkey - 1 END)::BIGINT)) / 7.0))::INT AS n_bytes FROM lineitem")
def zigzag_varint_len(spark, d):
    v = F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).otherwise(-F.col("l_partkey"))
    li = spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", v.alias("v"))
    return li.select("l_orderkey", "l_linenumber", C.unzigzag(C.zigzag(F.col("v"))).alias("v"), C.zigzag(F.col("v")).alias("zz"), C.int_length(F.col("v")).alias("n_bytes"))


def _zz(x: str) -> str:
    return f"(CASE WHEN {x} >= 0 THEN 2 * ({x}) ELSE -2 * ({x}) - 1 END)"


def _vlen(x: str) -> str:
    return f"greatest(1, ceil(length(bin(({x})::BIGINT)) / 7.0))::BIGINT"


def _stream(spark, d):
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH s AS (SELECT l_suppkey, l_orderkey AS v, l_orderkey - coalesce(lag(l_orderkey) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber), 0) AS dv FROM lineitem), z AS (SELECT l_suppkey, count(*) AS n, sum({_vlen(_zz('v'))})::BIGINT AS raw_len, sum({_vlen(_zz('dv'))})::BIGINT AS delta_len FROM s GROUP BY 1) SELECT *, CASE WHEN n > 1 AND delta_len < raw_len THEN 'DELTA' ELSE 'RAW' END AS mode, 4 + CASE WHEN n > 1 AND delta_len < raw_len THEN delta_len ELSE raw_len END AS out_len FROM z")
def num_v0_mode(spark, d):
    return numeric.raw_or_delta(_stream(spark, d), "l_suppkey", ["l_orderkey", "l_linenumber"], "l_orderkey")


@query("SELECT l_suppkey, count(*) AS n, sum(l_orderkey)::BIGINT AS total, true AS ok FROM lineitem GROUP BY 1")
def delta_roundtrip(spark, d):
    pos = ["l_orderkey", "l_linenumber"]
    back = numeric.undelta(numeric.deltas(_stream(spark, d), "l_suppkey", pos, "l_orderkey"), "l_suppkey", pos)
    return back.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.bool_and(F.col("value") == F.col("l_orderkey")).alias("ok"))


@query("SELECT l_suppkey, l_partkey, count(*) AS cnt, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, abs(l_partkey), l_partkey)::INT AS rank FROM lineitem GROUP BY 1, 2")
def num_v1_dict_order(spark, d):
    return numeric.frequent(_stream(spark, d), "l_suppkey", "l_partkey")


_FREQ = f"f AS (SELECT l_suppkey, l_partkey AS v, count(*) AS cnt, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, abs(l_partkey), l_partkey) AS rank, {_vlen(_zz('l_partkey'))} AS len FROM lineitem GROUP BY 1, 2)"
_KS = ", ".join(f"sum(CASE WHEN rank <= {k} THEN len + cnt * {_vlen('rank')} ELSE cnt * (1 + len) END) + 4 + {_vlen(f'least({k}, count(*))')} AS k{k}" for k in numeric.SIZES)
_BEST = "least(raw_len + 4, " + ", ".join(f"k{k}" for k in numeric.SIZES) + ")"
_WHEN = " ".join(f"WHEN k{k} = best THEN least({k}, distinct_n)" for k in numeric.SIZES)


@query(f"WITH {_FREQ}, s AS (SELECT l_suppkey, sum(cnt)::BIGINT AS n, count(*) AS distinct_n, sum(cnt * len)::BIGINT AS raw_len, {_KS} FROM f GROUP BY 1), b AS (SELECT *, CASE WHEN n < 8 OR distinct_n < 4 THEN raw_len + 4 ELSE {_BEST} END AS best FROM s) SELECT l_suppkey, n, distinct_n, raw_len, CASE WHEN best = raw_len + 4 THEN 'RAW' ELSE 'DICT' END AS mode, (CASE WHEN best = raw_len + 4 THEN 0 {_WHEN} END)::BIGINT AS k, best::BIGINT AS out_len FROM b")
def num_v1_mode_k(spark, d):
    return numeric.dictionary_choice(_stream(spark, d), "l_suppkey", "l_partkey")


@query("WITH f AS (SELECT l_suppkey, l_partkey, count(*) AS cnt, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, abs(l_partkey), l_partkey) AS rank FROM lineitem GROUP BY 1, 2), t AS (SELECT *, count(*) OVER (PARTITION BY l_suppkey) AS n FROM f WHERE rank <= 64) SELECT l_suppkey, l_partkey, cnt, rank::INT AS rank FROM t WHERE n >= 4")
def num_dict_bucket(spark, d):
    return numeric.dictionary_topk(_stream(spark, d), "l_suppkey", "l_partkey", 64)


@query("WITH f AS (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY count(*) DESC, abs(l_partkey), l_partkey) AS rank FROM lineitem GROUP BY 1, 2) SELECT l_suppkey, count(*) AS n, count(*) FILTER (rank > 64) AS escaped, sum(CASE WHEN rank <= 64 THEN rank ELSE 0 END)::BIGINT AS code_sum FROM lineitem JOIN f USING (l_suppkey, l_partkey) GROUP BY 1")
def num_codes(spark, d):
    s = _stream(spark, d)
    coded = numeric.codes(s, numeric.dictionary_topk(s, "l_suppkey", "l_partkey", 64, 1), "l_suppkey", "l_partkey")
    return coded.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.count_if(F.col("code") == 0).alias("escaped"), F.sum("code").alias("code_sum"))


# analyzer


def _chars(spark, d, *more):
    return docs(spark, d, *more).withColumn("chars", C.latin1(F.col("text")))


def _content(spark, d, *more):
    return docs(spark, d, *more).withColumn("content", F.encode("text", "UTF-8"))


_BYTES = f"{_HEX}, c AS (SELECT doc_id, x, count(*) AS cnt FROM (SELECT doc_id, unnest(b) AS x FROM h) GROUP BY 1, 2)"


@query(f"WITH {_BYTES} SELECT doc_id, x AS byte, cnt FROM c")
def byte_histogram(spark, d):
    return analyze.bytes_of(_content(spark, d), "doc_id", "content").select("doc_id", F.format_string("%02X", "byte").alias("byte"), "cnt")


@query(f"WITH {_BYTES} SELECT doc_id, sum(cnt)::BIGINT AS n_bytes, round(log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt), 6) AS entropy FROM c GROUP BY 1")
def shannon_entropy(spark, d):
    return analyze.entropy(analyze.bytes_of(_content(spark, d), "doc_id", "content"), "doc_id").select("doc_id", "n_bytes", F.round("entropy", 6).alias("entropy"))


_METRICS = """s AS (SELECT source, hex(encode(text)) AS hx, row_number() OVER (PARTITION BY source ORDER BY octet_length(encode(text)) DESC, doc_id) AS r FROM documents WHERE text <> ''),
 b AS (SELECT source, unnest(regexp_extract_all(left(hx, 131072), '..')) AS x FROM s WHERE r <= 4), c AS (SELECT source, x, count(*) AS cnt FROM b GROUP BY 1, 2),
 m AS (SELECT source, sum(cnt)::BIGINT AS n_bytes, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) AS entropy, coalesce(sum(cnt) FILTER (x = '00'), 0) / sum(cnt) AS null_ratio, coalesce(sum(cnt) FILTER (x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E'), 0) / sum(cnt) AS printable_ratio, coalesce(sum(cnt) FILTER (x BETWEEN '30' AND '39'), 0) / sum(cnt) AS digit_ratio, coalesce(sum(cnt) FILTER (x = '0A'), 0) / sum(cnt) AS newline_density FROM c GROUP BY 1)"""
_FIVE = ("entropy", "null_ratio", "printable_ratio", "digit_ratio", "newline_density")


@query(f"WITH {_METRICS} SELECT source, n_bytes, {', '.join(f'round({c}, 6) AS {c}' for c in _FIVE)} FROM m")
def bucket_metrics(spark, d):
    return analyze.bucket_metrics(_content(spark, d, "source"), "source", "doc_id", "content").select("source", "n_bytes", *(F.round(c, 6).alias(c) for c in _FIVE))


@query(f"WITH {_METRICS} SELECT source, CASE WHEN null_ratio > 0.01 THEN 'binaryish' WHEN digit_ratio >= 0.10 THEN 'mixed_text_nums' ELSE 'textish' END AS bucket_type FROM m")
def bucket_type(spark, d):
    return analyze.bucket_metrics(_content(spark, d, "source"), "source", "doc_id", "content").select("source", analyze.bucket_type().alias("bucket_type"))


@query(f"WITH {_HEX} SELECT doc_id, CASE WHEN len(b) = 0 THEN true ELSE len(list_filter(b, lambda x: x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E')) / len(b) >= 0.85 END AS is_text FROM h")
def is_text_flag(spark, d):
    return _chars(spark, d).select("doc_id", analyze.is_text(F.col("chars")).alias("is_text"))


@query(f"WITH {_HEX} SELECT doc_id, CASE WHEN len(b) = 0 THEN 0 ELSE round(len(list_filter(b, lambda x: x BETWEEN '30' AND '39')) / len(b), 9) END AS digit_density FROM h")
def digit_density(spark, d):
    n = F.length("chars")
    return _chars(spark, d).select("doc_id", F.when(n == 0, 0.0).otherwise(F.round(F.length(C.without(F.col("chars"), "[^0-9]")) / n, 9)).alias("digit_density"))


_TF = "f AS (SELECT doc_id, tok, least(count(*), 20) AS w FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[A-Za-z0-9_]{2,}')) AS tok FROM documents) GROUP BY 1, 2)"


@query(f"WITH {_TF} SELECT doc_id, tok AS token, w::BIGINT AS weight FROM f")
def capped_tf(spark, d):
    return analyze.features(docs(spark, d), "doc_id", "text").select("doc_id", "token", F.col("weight").cast("long").alias("weight"))


_LINES = "regexp_split_to_array(t, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{85}\\x{2028}\\x{2029}]')"


def _fingerprints(source: str, whole: bool = False) -> str:
    """source: SQL of doc_id, t (text, or null for bytes that are none) and hx (the bytes in hex). whole: without analyze.BOUNDS."""
    binary, head, most = ("hx", "hx", "") if whole else ("left(hx, 400000)", "left(hx, 2000000)", "[1:5000]")
    return f"""src AS ({source}), p AS (SELECT doc_id, t, {binary} AS hx, regexp_extract_all({head}, '..') AS b FROM src),
 k AS (SELECT doc_id, t, hx, CASE WHEN len(b) = 0 THEN 'empty' WHEN len(list_filter(b, lambda x: x IN ('09', '0A', '0D') OR x BETWEEN '20' AND '7E')) / len(b) < 0.85 THEN 'bin4' WHEN regexp_matches(lower(t), '[A-Za-z0-9_]{{2,}}') THEN 'tokens' ELSE 'lines' END AS branch FROM p),
 i AS (SELECT doc_id, branch, unnest(list_transform(regexp_extract_all(lower(t), '[A-Za-z0-9_]{{2,}}'), lambda x: md5(x))) AS m FROM k WHERE branch = 'tokens'
  UNION ALL SELECT doc_id, branch, unnest(list_transform(list_filter({_LINES.replace("(t,", "(lower(t),")}, lambda x: regexp_matches(x, '[^\\s\\x0b\\x1f]')){most}, lambda x: md5(x))) FROM k WHERE branch = 'lines'
  UNION ALL SELECT doc_id, branch, unnest(list_transform(regexp_extract_all(hx, '.{{8}}'), lambda x: md5(unhex(x)))) FROM k WHERE branch = 'bin4'),
 n AS (SELECT doc_id, CASE WHEN branch = 'tokens' THEN least(count(*), 20) ELSE count(*) END AS w, ('0x' || left(m, 16))::UBIGINT AS h FROM i GROUP BY doc_id, branch, m),
 v AS (SELECT doc_id, bit, sum(CASE WHEN (h >> bit) & 1 = 1 THEN w ELSE -w END) AS v FROM n, (SELECT unnest(range(64))::UBIGINT AS bit) GROUP BY 1, 2),
 s AS (SELECT k.doc_id, branch, CASE WHEN branch = 'empty' THEN 0::HUGEINT ELSE coalesce(x, 18446744073709551615::HUGEINT) END AS sim FROM k LEFT JOIN (SELECT doc_id, sum(CASE WHEN v >= 0 THEN (1::UBIGINT << bit)::HUGEINT ELSE 0 END)::HUGEINT AS x FROM v GROUP BY 1) USING (doc_id))"""


_TEXTS = "SELECT doc_id, text AS t, hex(encode(text)) AS hx FROM documents"
_SIM = _fingerprints(_TEXTS)


@query(f"WITH {_SIM} SELECT doc_id, sim::VARCHAR AS simhash64 FROM s")
def simhash64_md5(spark, d):
    return analyze.fingerprints(_content(spark, d), "doc_id", "content", bounds=analyze.BOUNDS).select("doc_id", F.col("simhash64").cast("string").alias("simhash64"))


@query(f"WITH {_fingerprints(_TEXTS, whole=True)} SELECT doc_id, (sim % 16)::INT AS bucket FROM s")
def bucket_assign(spark, d):
    return analyze.fingerprints(_content(spark, d), "doc_id", "content").select("doc_id", analyze.bucket(F.col("simhash64"), 16).alias("bucket"))


@query("WITH " + _fingerprints("SELECT doc_id, x AS t, hex(encode(x)) AS hx FROM (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '' ELSE regexp_replace(text, '[^\\r\\n]', '-', 'g') || chr(10) || repeat('+', (doc_id % 7)::INT) END AS x FROM documents)") + " SELECT doc_id, branch, sim::VARCHAR AS simhash64 FROM s")
def line_features(spark, d):
    """Fingerprints of texts without words, which are by lines, and of empty ones."""
    bare = F.concat(F.regexp_replace("text", r"[^\r\n]", "-"), F.lit("\n"), F.expr("repeat('+', int(doc_id % 7))"))
    made = docs(spark, d).select("doc_id", F.encode(F.when(F.col("doc_id") % 10 == 0, "").otherwise(bare), "UTF-8").alias("content"))
    return analyze.fingerprints(made, "doc_id", "content", bounds=analyze.BOUNDS).withColumn("simhash64", F.col("simhash64").cast("string"))


@query("WITH " + _fingerprints("SELECT doc_id, NULL::VARCHAR AS t, translate(hex(encode(text)), '0123456789ABCDEF', 'FEDCBA9876543210') AS hx FROM documents", whole=True) + " SELECT doc_id, branch, sim::VARCHAR AS simhash64 FROM s")
def byte_shingles(spark, d):
    """Fingerprints of binaries, made of the documents by turning over all bits: four bytes at a time."""
    turned = F.unhex(F.translate(F.hex(F.encode("text", "UTF-8")), "0123456789ABCDEF", "FEDCBA9876543210"))
    return analyze.fingerprints(docs(spark, d).select("doc_id", turned.alias("content")), "doc_id", "content").withColumn("simhash64", F.col("simhash64").cast("string"))


# bundles and archives


@query("SELECT source, doc_id, octet_length(encode(text))::BIGINT AS length, coalesce(sum(octet_length(encode(text))) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM documents")
def bundle_offsets(spark, d):
    rows = docs(spark, d, "source").select("source", "doc_id", F.octet_length("text").cast("long").alias("length"))
    return relations.bundle_offsets(rows, "source", "doc_id", "length").select("source", "doc_id", "length", "offset")


@query("SELECT doc_id, 'text' AS kind, octet_length(encode(text))::BIGINT AS length FROM documents UNION ALL SELECT 1000000000 + vec_id, 'bin', (4 * len(embedding))::BIGINT FROM embeddings")
def mixed_partition(spark, d):
    from lamina.kernels.arrow import float_bytes

    text = docs(spark, d).select("doc_id", F.encode("text", "UTF-8").alias("content"))
    binary = spark.read.parquet(f"{d}/embeddings.parquet").select((F.col("vec_id") + 1_000_000_000).alias("doc_id"), float_bytes("embedding").alias("content"))
    is_text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.contains(F.col("content"), F.lit(b"\0"))
    return text.unionByName(binary).select("doc_id", F.when(is_text, "text").otherwise("bin").alias("kind"), F.length("content").cast("long").alias("length"))


@query("SELECT source, sha256(string_agg(text, '' ORDER BY doc_id)) AS concat_sha256, sum(octet_length(encode(text)))::BIGINT AS n_bytes FROM documents GROUP BY 1")
def concat_sha256(spark, d):
    from lamina.kernels.arrow import concat_hashes

    return concat_hashes(docs(spark, d, "source"), "source", "doc_id", "text")


@query(SQL["concat_sha256"])
def concat_sha256_all(spark, d):
    """The same under the name it had while concat_sha256 took a part of the documents."""
    return concat_sha256(spark, d)


@query("SELECT doc_id, sha256(text) AS sha FROM documents")
def slice_restore(spark, d):
    """Cut each document out of the 64 KiB blocks of its source's concatenation that it lies in."""
    from lamina.kernels.arrow import restore_slices

    return restore_slices(docs(spark, d, "source"), "source", "doc_id", "text", 65_536).select("doc_id", F.sha2("content", 256).alias("sha"))


_MANIFEST = """m AS (SELECT source AS archive, CASE WHEN doc_id % 3 = 1 THEN doc_id::VARCHAR WHEN doc_id % 3 = 2 THEN 'moved/' || doc_id ELSE 'a/' || doc_id END AS rel, doc_id * 10 AS "offset", n_chars AS length FROM documents),
 x AS (SELECT source AS archive, 'a/' || doc_id AS rel, doc_id * 10 AS "offset", n_chars AS length FROM documents WHERE doc_id % 7 <> 0)"""


@query(f"""WITH {_MANIFEST}, e1 AS (SELECT m.archive, m.rel, min(x.rel) AS e FROM m JOIN x ON m.archive = x.archive AND m.rel = x.rel GROUP BY 1, 2), e2 AS (SELECT m.archive, m.rel, min(x.rel) AS e FROM m JOIN x ON m.archive = x.archive AND x.rel = 'a/' || m.rel GROUP BY 1, 2 HAVING count(*) = 1), e3 AS (SELECT m.archive, m.rel, min(x.rel) AS e FROM m JOIN x ON m.archive = x.archive AND m."offset" = x."offset" AND m.length = x.length GROUP BY 1, 2)
 SELECT m.archive, m.rel, coalesce(e1.e, e2.e, e3.e, '') AS entry, CASE WHEN e1.e IS NOT NULL THEN 1 WHEN e2.e IS NOT NULL THEN 2 WHEN e3.e IS NOT NULL THEN 3 ELSE 0 END AS tier FROM m LEFT JOIN e1 USING (archive, rel) LEFT JOIN e2 USING (archive, rel) LEFT JOIN e3 USING (archive, rel)""")
def manifest_join(spark, d):
    s = docs(spark, d, "source", "n_chars")
    place = [(F.col("doc_id") * 10).alias("offset"), F.col("n_chars").alias("length")]
    i = F.col("doc_id").cast("string")
    rel = F.when(F.col("doc_id") % 3 == 1, i).when(F.col("doc_id") % 3 == 2, F.concat(F.lit("moved/"), i)).otherwise(F.concat(F.lit("a/"), i))
    manifest = s.select(F.col("source").alias("archive"), rel.alias("rel"), *place)
    index = s.filter("doc_id % 7 <> 0").select(F.col("source").alias("archive"), F.concat(F.lit("a/"), i).alias("rel"), *place)
    return relations.manifest_join(manifest, index).select("archive", "rel", F.coalesce("entry", F.lit("")).alias("entry"), F.coalesce("tier", F.lit(0)).alias("tier"))


@query("SELECT doc_id AS bucket, 'tpl' AS res_name, CASE WHEN doc_id % 5 = 0 THEN 'missing_resource' ELSE 'hash_mismatch' END AS violation FROM documents WHERE doc_id % 5 IN (0, 1)")
def resource_check(spark, d):
    s = docs(spark, d).select(F.col("doc_id").alias("bucket"), F.lit("tpl").alias("res_name"), F.sha2(F.col("text").cast("binary"), 256).alias("sha"))
    have = s.filter("bucket % 5 <> 0").withColumn("sha", F.when(F.col("bucket") % 5 == 1, "bad").otherwise(F.col("sha")))
    return relations.resource_check(s, have)


@query("SELECT doc_id::VARCHAR AS rel, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 11 = 1 THEN 'extra' ELSE 'changed' END AS status FROM documents WHERE doc_id % 11 IN (0, 1, 2)")
def tree_diff(spark, d):
    s = docs(spark, d).select("doc_id", F.col("doc_id").cast("string").alias("rel"), F.xxhash64("text").alias("sha"))
    left = s.filter("doc_id % 11 <> 1")
    right = s.filter("doc_id % 11 <> 0").withColumn("sha", F.when(F.col("doc_id") % 11 == 2, F.col("sha") + 1).otherwise(F.col("sha")))
    return relations.tree_diff(left, right)


@query("WITH h AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN upper(sha256(text)) WHEN 1 THEN ' ' || sha256(text) || '  ' WHEN 2 THEN left(sha256(text), 63) WHEN 3 THEN sha256(text) || 'a' WHEN 4 THEN 'g' || left(sha256(text), 63) ELSE sha256(text) END AS h FROM documents) SELECT doc_id, regexp_matches(lower(trim(h)), '^[0-9a-f]{64}$') AS ok FROM h")
def sha_wellformed(spark, d):
    """Hashes of which some are cut, too long, no hex, in capitals or with spaces around them."""
    sha, k = F.sha2(F.col("text").cast("binary"), 256), F.col("doc_id") % 6
    made = F.when(k == 0, F.upper(sha)).when(k == 1, F.concat(F.lit(" "), sha, F.lit("  "))).when(k == 2, F.left(sha, F.lit(63))).when(k == 3, F.concat(sha, F.lit("a"))).when(k == 4, F.concat(F.lit("g"), F.left(sha, F.lit(63)))).otherwise(sha)
    return docs(spark, d).select("doc_id", C.is_sha256(made).alias("ok"))


@query(None)
def crc32_blobs(spark, d):
    return docs(spark, d).select("doc_id", F.crc32(F.encode("text", "UTF-8")).alias("crc"))


# planner and reports


def _files(spark, d):
    """A literal size model of documents, so that both engines see the same numbers."""
    return docs(spark, d, "lang", "source", "n_chars").select("doc_id", "lang", "source", (F.col("doc_id") % 16).alias("bucket"), F.col("n_chars").alias("in_bytes"), F.floor(F.col("n_chars") * (3 + F.col("doc_id") % 5) / 10).alias("out_bytes"))


_FILES = "f AS (SELECT doc_id, lang, source, doc_id % 16 AS bucket, n_chars AS in_bytes, floor(n_chars * (3 + doc_id % 5) / 10)::BIGINT AS out_bytes FROM documents)"


@query(f"WITH {_FILES} SELECT grouping(f.lang, f.source, f.bucket)::BIGINT AS gid, coalesce(f.lang, '') AS lang, coalesce(f.source, '') AS source, coalesce(f.bucket, -1) AS bucket, count(*) AS files, sum(in_bytes)::BIGINT AS in_bytes, sum(out_bytes)::BIGINT AS out_bytes, round(CASE WHEN sum(in_bytes) = 0 THEN 0 ELSE sum(out_bytes) / sum(in_bytes) END, 6) AS ratio FROM f GROUP BY GROUPING SETS ((f.lang), (f.source), (f.bucket), (f.bucket, f.lang), ())")
def report_grouping_sets(spark, d):
    return relations.grouped_savings(_files(spark, d), [["lang"], ["source"], ["bucket"], ["bucket", "lang"], []], ["lang", "source", "bucket"]).withColumns({"lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit("")), "bucket": F.coalesce("bucket", F.lit(-1))})


@query(f"WITH {_FILES} SELECT source, sum(in_bytes)::BIGINT AS in_bytes, sum(out_bytes)::BIGINT AS out_bytes, (sum(in_bytes) - sum(out_bytes))::BIGINT AS saved FROM f GROUP BY 1 ORDER BY saved DESC, out_bytes, source LIMIT 10")
def report_top(spark, d):
    g = _files(spark, d).groupBy("source").agg(F.sum("in_bytes").alias("in_bytes"), F.sum("out_bytes").alias("out_bytes"))
    return relations.top_saved(g, "source", 10)


#: Candidate plans with their CPU penalties, and a size factor in hundredths for the literal trial table.
PLANS = [("bytes", "zlib", 0.0, 45), ("bytes", "zstd_tight", 0.005, 44), ("split_text_nums", "zlib", 0.025, 40), ("tpl_lines_v0", "zlib", 0.035, 38), ("vc0", "zlib", 0.01, 52)]
_PLANS = "p(layer, codec, penalty, pct, ord) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE, {e}, {k})" for k, (a, b, c, e) in enumerate(PLANS)) + ")"
_TRIALS = f"{_FILES}, {_PLANS}, t AS (SELECT bucket, layer || ':' || codec AS plan, layer, codec, in_bytes, in_bytes * (pct + (bucket * (ord + 1)) % 7) // 100 AS out_bytes, penalty FROM f, p), g AS (SELECT bucket, plan, layer, codec, sum(out_bytes) / sum(in_bytes) AS ratio, round(sum(out_bytes) / sum(in_bytes) + max(penalty), 9) AS score FROM t GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score, plan) AS pos FROM g)"


def _trials(spark, d):
    plans = spark.createDataFrame([(*p, k) for k, p in enumerate(PLANS)], "layer string, codec string, penalty double, pct int, ord int")
    t = _files(spark, d).select("bucket", "in_bytes").crossJoin(F.broadcast(plans))  # five plans, a fixed number
    out = F.expr("in_bytes * (pct + (bucket * (ord + 1)) % 7) div 100")
    return t.select("bucket", F.concat_ws(":", "layer", "codec").alias("plan"), "layer", "codec", "in_bytes", out.alias("out_bytes"), "penalty")


@query(f"WITH {_TRIALS} SELECT bucket, plan, layer, codec, round(ratio, 6) AS ratio, round(score, 6) AS score, pos::INT AS pos FROM r")
def plan_score_rank(spark, d):
    return relations.plan_scores(_trials(spark, d))


@query(f"WITH {_TRIALS}, w AS (SELECT bucket, plan AS winner, layer AS wl, codec AS wc FROM r WHERE pos = 1), x AS (SELECT bucket, winner, plan, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN layer <> wl THEN 3 WHEN codec <> wc THEN 1 ELSE 0 END DESC, pos) AS k FROM r JOIN w USING (bucket) WHERE pos > 1) SELECT bucket, winner, plan AS runner_up FROM x WHERE k = 1")
def plan_runner_up(spark, d):
    return relations.runner_up(relations.plan_scores(_trials(spark, d)))


@query(f"WITH {_TRIALS}, h AS (SELECT CASE WHEN bucket % 2 = 0 THEN 'textish' ELSE 'mixed_text_nums' END AS bucket_type, plan AS key, min(round(score, 6)) AS score, count(*) AS seen FROM r GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY bucket_type ORDER BY score, key)::INT AS rank FROM h) SELECT * FROM k WHERE rank <= 3")
def top_db_upsert(spark, d):
    scored = relations.plan_scores(_trials(spark, d))
    history = scored.select(F.when(F.col("bucket") % 2 == 0, "textish").otherwise("mixed_text_nums").alias("bucket_type"), F.col("plan").alias("key"), "score", F.lit(1).alias("seen"))
    return relations.top_db(history, 3)


@query("SELECT o_custkey, len(l)::BIGINT AS n, list_sum(list_transform(l, lambda x: x::HUGEINT))::VARCHAR AS total, array_to_string(l[1:200], ',') AS shown FROM (SELECT o_custkey, regexp_extract_all(text, '-?[0-9]+') AS l FROM (" + INVOICES + "))")
def extract_numbers(spark, d):
    nums = C.matches(F.col("text"), C.PLAIN_NUMBERS, 0)
    t = invoices(spark, d).select("o_custkey", nums.alias("l"))
    total = F.aggregate("l", F.lit(0).cast("decimal(38,0)"), lambda s, x: (s + x.try_cast("decimal(38,0)")).cast("decimal(38,0)"))
    return t.select("o_custkey", F.size("l").cast("long").alias("n"), total.cast("string").alias("total"), F.array_join(F.slice("l", 1, 200), ",").alias("shown"))


@query(f"WITH {_FILES} SELECT doc_id, CASE WHEN in_bytes = 0 THEN 0 ELSE round(out_bytes / in_bytes, 6) END AS ratio, CASE WHEN in_bytes = 0 THEN 0 ELSE round(8 * out_bytes / in_bytes, 6) END AS bits_per_symbol FROM f")
def size_stats(spark, d):
    ratio = F.when(F.col("in_bytes") == 0, 0.0).otherwise(F.col("out_bytes") / F.col("in_bytes"))
    return _files(spark, d).select("doc_id", F.round(ratio, 6).alias("ratio"), F.round(8 * ratio, 6).alias("bits_per_symbol"))
