"""Semantic layers over a table of texts: a key column, and a text column.

Each encoder gives relations with explicit positions; nothing depends on row order. Windows are
partitioned by the file's key, so their size is bounded by one file.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lamina.functions import columns as C
from lamina.kernels import arrow, containers


def tokens(df: DataFrame, key: str, text: str, pattern: str, names: tuple[str, str] = ("pos", "token")) -> DataFrame:
    return df.select(key, F.posexplode(C.matches(F.col(text), pattern)).alias(*names))


def coded(df: DataFrame, key: str, text: str, pattern: str) -> DataFrame:
    """key, vocabulary (tokens in the order in which they are first seen) and ids, an array for each text of the key. Keys without a text are left out.

    The texts of a key are numbered in one place, so no row a token is made. The pattern has one group, which is all it matches.
    """

    def numbered(texts):
        found = [re.findall(pattern, t) for t in texts]
        if len(found) == 1:
            number: dict[str, int] = {}
            return {"vocabulary": number, "ids": [[number.setdefault(t, len(number)) for t in found[0]]]}
        first: dict[str, int] = {}
        for tokens in found:
            for k, t in enumerate(tokens):
                first[t] = min(k, first.get(t, k))
        number = {t: k for k, t in enumerate(sorted(first, key=first.get))}
        return {"vocabulary": number, "ids": [[number[t] for t in tokens] for tokens in found]}

    def all_numbered(texts):
        return [{"vocabulary": list(x["vocabulary"]), "ids": x["ids"]} for x in map(numbered, texts)]

    rows = df.filter(F.col(text).isNotNull()).groupBy(key).agg(F.collect_list(text).alias("texts"))
    made = rows.select(key, arrow.by_pieces(all_numbered, "struct<vocabulary:array<string>,ids:array<array<long>>>")("texts").alias("x"))
    return made.select(key, "x.vocabulary", "x.ids")


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """line_no, line (terminator kept). An empty text has no line."""
    return tokens(df, key, text, C.LINES, ("line_no", "line"))


def dictionary(df: DataFrame, key: str | list[str], token: str, pos: str) -> DataFrame:
    """key, token, first_pos, token_id, n: ids in the order in which tokens are first seen, from 0."""
    keys = [key] if isinstance(key, str) else key
    seen = df.groupBy(*keys, token).agg(F.min(pos).alias("first_pos"), F.count("*").alias("n"))
    return seen.withColumn("token_id", (F.row_number().over(Window.partitionBy(*keys).orderBy("first_pos")) - 1).cast("long"))


def encoded(df: DataFrame, key: str, token: str, pos: str) -> DataFrame:
    """The rows of df with token_id. One shuffle: all of a file's rows are sorted where they are."""
    first = F.min(pos).over(Window.partitionBy(key, token))
    rows = df.repartition(key).withColumn("_first", first)
    return rows.withColumn("token_id", (F.dense_rank().over(Window.partitionBy(key).orderBy("_first")) - 1).cast("long")).drop("_first")


def looked_up(ids: str, vocabulary: str) -> Column:
    """The text of an array of ids."""
    return F.concat_ws("", F.transform(ids, lambda i: F.get(vocabulary, i.cast("int"))))


def runs(ids: DataFrame, key: str, pos: str, value: str = "token_id") -> DataFrame:
    """key, run_no, value, run: run lengths of equal neighbours."""
    by = Window.partitionBy(key).orderBy(pos)
    step = ids.withColumn("_new", F.coalesce((F.lag(value).over(by) != F.col(value)).cast("int"), F.lit(1)))
    island = step.withColumn("run_no", (F.sum("_new").over(by) - 1).cast("long"))
    return island.groupBy(key, "run_no").agg(F.first(value).alias(value), F.count("*").alias("run"))


def numbers(df: DataFrame, key: str, text: str, more: tuple[str, ...] = ()) -> DataFrame:
    """num_no, sign (0 none, 1 plus, 2 minus), digits_len, digits: the number tokens in order. Digits stay text, whatever their number."""
    found = df.select(key, *more, F.posexplode(C.matches(F.col(text), C.NUMBERS, 0)).alias("num_no", "raw"))
    sign = F.when(F.col("raw").startswith("+"), 1).when(F.col("raw").startswith("-"), 2).otherwise(0)
    digits = F.regexp_replace("raw", "^[+-]", "")
    return found.select(key, *more, "num_no", sign.alias("sign"), F.length(digits).alias("digits_len"), digits.alias("digits"))


def split_text_nums(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, chunks (texts around the numbers), raws (the numbers as written): put side by side they give the text again."""
    return df.select(key, F.split(F.col(text), C.NUMBERS, -1).alias("chunks"), C.matches(F.col(text), C.NUMBERS, 0).alias("raws"))


def joined_text(chunks: Column, raws: Column) -> Column:
    return F.concat_ws("", F.flatten(F.zip_with(chunks, raws, lambda c, r: F.array(c, F.coalesce(r, F.lit(""))))))


def templates(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line_no, template (array of chunks around the numbers), raws, template_id (first seen). An empty text has one empty line."""
    by_line = lines(df, key, text).unionByName(df.filter(F.length(text) == 0).select(key, F.lit(0).alias("line_no"), F.lit("").alias("line")))
    split = by_line.select(key, "line_no", F.split("line", C.NUMBERS, -1).alias("template"), C.matches(F.col("line"), C.NUMBERS, 0).alias("raws"))
    return encoded(split, key, "template", "line_no").withColumnRenamed("token_id", "template_id")


def against_base(encoded_lines: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Template ids with a shared dictionary: base (template, base_id) first, then templates it lacks, in first-seen order from base_n on."""
    base_n = base.agg(F.count("*").alias("base_n"))
    own = encoded_lines.join(base, "template", "left")
    delta = dictionary(own.filter("base_id is null"), key, "template", "line_no").select(key, "template", F.col("token_id").alias("delta_id"))
    with_delta = own.join(delta, [key, "template"], "left").crossJoin(F.broadcast(base_n))
    return with_delta.withColumn("shared_id", F.coalesce(F.col("base_id"), F.col("base_n") + F.col("delta_id")).cast("long"))


def vc0(df: DataFrame, key: str, text: str, more: tuple[str, ...] = ()) -> DataFrame:
    """key, mask, vowels, cons over the text's bytes (Latin-1). mask: V vowel, C other letter, O rest."""
    s = C.latin1(F.col(text))
    vowels = C.without(s, "[^aeiouAEIOU]")
    cons = C.without(s, "[aeiouAEIOU]")
    mask = F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"(?s)[^\p{L}]", "\u0001"), "[aeiouAEIOU]", "\u0002"), r"\p{L}", "C")
    return df.select(key, *more, F.translate(mask, "\u0001\u0002", "OV").alias("mask"), vowels.alias("vowels"), cons.alias("cons"))


def unvc0(df: DataFrame, key: str, more: tuple[str, ...] = ()) -> DataFrame:
    """key, content: the bytes that vc0() took apart, put together where each row is."""
    parts = [F.encode(c, "ISO-8859-1") for c in ("mask", "vowels", "cons")]
    return df.select(key, *more, arrow.column(containers.unmasked)(*parts).alias("content"))
