"""Column expressions: bytes as characters, number tokens, zigzag and LEB128 sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What the tokenizers match. A sign belongs to a number at the start or after these characters.
WORDS = r"([A-Za-z]+|[^A-Za-z]+)"
SYLLABLES = r"([b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]*[aeiouAEIOU]|[b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z]+|[^A-Za-z]+)"
LINES = r"([^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+)"
NUMBERS = r"(?:(?<=\A|[\t\n\r (\[{<=:,;])[+-])?[0-9]+"
PLAIN_NUMBERS = r"-?[0-9]+"
FEATURES = r"[A-Za-z0-9_]{2,}"


def latin1(text: Column) -> Column:
    """The UTF-8 bytes of a text as characters, one each."""
    return F.decode(F.encode(text, "UTF-8"), "ISO-8859-1")


def latin1_of(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def matches(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def without(text: Column, pattern: str) -> Column:
    return F.regexp_replace(text, F.lit(pattern), F.lit(""))


def zigzag(n: Column) -> Column:
    return F.when(n >= 0, F.shiftleft(n, 1)).otherwise(-F.shiftleft(n, 1) - 1)


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(F.lit(1).cast("long")))


def varint_length(u: Column) -> Column:
    """Bytes of the LEB128 form of a number from 0 on."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(u)) / 7)).cast("int")


def int_length(n: Column) -> Column:
    """Bytes of a signed number: zigzag, then LEB128."""
    return varint_length(zigzag(n))


def hash64(text: Column) -> Column:
    """The first eight bytes of MD5, as a signed long."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 16), 16, -10).cast("long")


def unsigned(x: Column) -> Column:
    """A signed long's bits as DECIMAL(20,0)."""
    d = x.cast("decimal(20,0)")
    return F.when(x < 0, d + F.lit("18446744073709551616").cast("decimal(20,0)")).otherwise(d).cast("decimal(20,0)")


def printable_ratio(chars: Column) -> Column:
    return F.when(F.length(chars) == 0, F.lit(1.0)).otherwise(F.length(without(chars, r"[^\x20-\x7E\t\n\r]")) / F.length(chars))


def extension(rel: Column) -> Column:
    """Lower-case, with its dot; empty where the last path part has none."""
    return F.lower(F.regexp_extract(rel, r"[^/](\.[^./]+)$", 1))


def human_bytes(n: Column) -> Column:
    unit = lambda size, name: F.concat(F.format_string("%.1f", n / size), F.lit(name))
    return F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1 << 20, unit(1 << 10, " KiB")).when(n < 1 << 30, unit(1 << 20, " MiB")).otherwise(unit(1 << 30, " GiB"))


def is_sha256(text: Column) -> Column:
    """Whether a text is a SHA-256 in hex, in either case, with or without white space around it."""
    return F.lower(F.trim(text)).rlike("^[0-9a-f]{64}$")


def file_kind(blob: Column) -> Column:
    """bundle, extract, container or other, by the first bytes alone; an extract is a container whose flags have the top bit."""
    framed = F.startswith(blob, F.lit(b"GCC\x06"))
    flags = F.conv(F.hex(F.substring(blob, 5, 1)), 16, 10).cast("int")
    return F.when(F.startswith(blob, F.lit(b"MBN")), "bundle").when(framed & (flags.bitwiseAND(128) > 0), "extract").when(framed, "container").otherwise("other")
