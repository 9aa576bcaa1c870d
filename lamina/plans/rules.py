"""Queries for predicates, routing, validation and the fingerprint's other branches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.kernels import arrow, containers, legacy
from lamina.kernels.containers import CODECS, STREAMS
from lamina.operators import layers, relations
from lamina.plans.catalogue import LINE, _SIGN, _tokens, docs, query
from lamina.sources.archive import entry_violations

@query("WITH f AS (SELECT doc_id, n_chars, CASE doc_id % 4 WHEN 0 THEN 'a/' || doc_id || '.TXT' WHEN 1 THEN 'b.d/' || doc_id WHEN 2 THEN doc_id || '.tar.gz' ELSE 'x/.' || doc_id || '.md' END AS rel FROM documents) SELECT lower(regexp_extract(rel, '[^/](\\.[^./]+)$', 1)) AS ext, count(*) AS files, sum(n_chars)::BIGINT AS in_bytes FROM f GROUP BY 1")
def ext_stats(spark, d):
    i, k = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    rel = F.when(k == 0, F.concat(F.lit("a/"), i, F.lit(".TXT"))).when(k == 1, F.concat(F.lit("b.d/"), i)).when(k == 2, F.concat(i, F.lit(".tar.gz"))).otherwise(F.concat(F.lit("x/."), i, F.lit(".md")))
    return docs(spark, d, "n_chars").groupBy(C.extension(rel).alias("ext")).agg(F.count("*").alias("files"), F.sum("n_chars").alias("in_bytes"))


@query("WITH s AS (SELECT doc_id, lang || ':' || (doc_id % 3) AS sig FROM documents) SELECT sig, min(doc_id) AS first_pos FROM s GROUP BY 1")
def plan_dedup(spark, d):
    s = docs(spark, d, "lang").select("doc_id", F.concat_ws(":", "lang", (F.col("doc_id") % 3).cast("string")).alias("sig"))
    return relations.first_of_each(s, "sig", "doc_id").select("sig", F.col("doc_id").alias("first_pos"))


@query(rf"""WITH {_tokens(LINE, "(SELECT doc_id, lang, text FROM documents)")}, k AS (SELECT lang, regexp_replace(regexp_replace(tok, '{_SIGN}', '\1\2', 'g'), '[0-9]+', '#', 'g') AS tpl FROM t JOIN documents USING (doc_id)), r AS (SELECT lang, tpl, count(*) AS n, row_number() OVER (PARTITION BY lang ORDER BY count(*) DESC, tpl) AS rank FROM k GROUP BY 1, 2) SELECT lang, sha256(tpl) AS template_sha, n, rank::INT AS rank FROM r WHERE rank <= 8""")
def tpl_dict_bucket(spark, d):
    split = layers.tokens(docs(spark, d, "lang"), "lang", "text", C.LINES, ("line_no", "line"))
    counted = split.groupBy("lang", F.array_join(F.split("line", C.NUMBERS, -1), "#").alias("tpl")).agg(F.count("*").alias("n"))
    top = counted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "tpl"))).filter("rank <= 8")
    return top.select("lang", F.sha2(F.col("tpl").cast("binary"), 256).alias("template_sha"), "n", "rank")


@query(rf"""WITH r AS (SELECT octet_length(encode(regexp_replace(regexp_replace(text, '{_SIGN}', '\1\2', 'g'), '[0-9]+', '', 'g')))::BIGINT AS n FROM documents) SELECT {STREAMS["TEXT"]} AS stype, {CODECS["zlib"]} AS code, count(*) AS n, sum(n)::BIGINT AS ulen FROM r UNION ALL SELECT {STREAMS["NUMS"]}, {CODECS["num_v1"]}, count(*), 0 FROM r UNION ALL SELECT {STREAMS["META"]}, {CODECS["raw"]}, count(*), 2 * count(*) FROM r""")
def stream_routing(spark, d):
    """The streams of encoded documents with the codecs they went to. SQL has no sizes of number streams, which count as 0 here."""
    coded = docs(spark, d).select(arrow.encode("split_text_nums", "zlib")(F.encode(F.coalesce("text", F.lit("")), "UTF-8")).alias("blob"))
    found = coded.select(F.explode(arrow.streams("blob")).alias("s")).select("s.*")
    return found.groupBy("stype", F.col("codec").alias("code")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("stype") != STREAMS["NUMS"], F.col("ulen")).otherwise(0)).alias("ulen"))


@query("""WITH e AS (SELECT (doc_id // 100)::VARCHAR AS archive, doc_id, CASE WHEN doc_id % 7 = 4 THEN '' ELSE doc_id::VARCHAR END AS rel, CASE WHEN doc_id % 7 = 1 THEN -5 ELSE doc_id * 100 END AS o, CASE WHEN doc_id % 7 = 2 THEN 150 ELSE 50 END AS l, doc_id % 7 IN (1, 3, 4) AS bad FROM documents),
 p AS (SELECT *, max(o + l) OVER (PARTITION BY archive ORDER BY o, l, rel ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM e WHERE NOT bad) SELECT archive, rel, 'corrupt_payload' AS violation FROM e WHERE bad UNION ALL SELECT archive, rel, 'corrupt_payload' FROM p WHERE o < e""")
def index_validation(spark, d):
    """Archive entries of which some have no name, a negative place, a hash that is none, or reach into the next."""
    k = F.col("doc_id") % 7
    rows = docs(spark, d).select(
        F.expr("cast(doc_id div 100 as string)").alias("archive"),
        F.when(k == 4, "").otherwise(F.col("doc_id").cast("string")).alias("rel"),
        F.when(k == 1, -5).otherwise(F.col("doc_id") * 100).alias("offset"),
        F.when(k == 2, 150).otherwise(50).cast("long").alias("length"),
        F.when(k == 3, "none").otherwise(F.sha2(F.col("text").cast("binary"), 256)).alias("blob_sha256"),
    )
    return entry_violations(rows)


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'bundle' WHEN 1 THEN 'container' WHEN 2 THEN 'extract' ELSE 'other' END AS kind FROM documents")
def magic_kinds(spark, d):
    """What encoders have made, told apart by the first bytes."""
    k, content = F.col("doc_id") % 4, F.encode("text", "UTF-8")
    rows = docs(spark, d).select("doc_id", k.alias("k"), content.alias("c"), arrow.encode("bytes", "zlib")(content).alias("file"), arrow.column(containers.extract)(content).alias("extract"))
    payload = F.expr("substring(file, 8)")  # a container's head has seven bytes; then comes the bundle
    return rows.select("doc_id", C.file_kind(F.when(F.col("k") == 0, payload).when(F.col("k") == 1, F.col("file")).when(F.col("k") == 2, F.col("extract")).otherwise(F.col("c"))).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN true ELSE false END AS skipped FROM documents")
def empty_shortcut(spark, d):
    """Empty files are known by their size and hash, and need no decoder."""
    content = F.when(F.col("doc_id") % 9 == 0, F.lit(b"")).otherwise(F.encode("text", "UTF-8"))
    return docs(spark, d).select("doc_id", content.alias("c")).select("doc_id", ((F.length("c") == 0) & (F.sha2("c", 256) == F.sha2(F.lit(b""), 256))).alias("skipped"))


@query("SELECT doc_id, true AS least, true AS restored FROM documents")
def smallest_wins(spark, d):
    """The smallest of several encodings of each document: none of them, made apart, is smaller, and it decodes."""
    layers, kinds = ("bytes", "lines_dict"), ("raw", "zlib")
    content = F.encode("text", "UTF-8")
    sizes = arrow.column(lambda data: min(len(containers.encode(data, layer, codec)) for layer in layers for codec in kinds), "int")
    best = arrow.column(lambda data: legacy.smallest(data, layers, kinds)[2])("c")
    rows = docs(spark, d).select("doc_id", content.alias("c")).select("doc_id", "c", sizes("c").alias("size"), best.alias("blob"))
    return rows.select("doc_id", (F.length("blob") == F.col("size")).alias("least"), (arrow.decode()("blob") == F.col("c")).alias("restored"))
