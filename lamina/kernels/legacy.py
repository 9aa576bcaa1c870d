"""Older file versions 1 to 5, and the bundles of version 5, read and written."""

from __future__ import annotations

import base64
import json
from dataclasses import dataclass

from lamina.errors import CorruptPayload, UnsupportedVersion, UsageError
from lamina.kernels import codecs as K
from lamina.kernels import containers as B

#: Fixed values of the formats.
HUFFMAN_1, HUFFMAN_2, ZSTD_1, ZSTD_2, ZSTD_RAW = b"HBN1", b"HBN2", b"ZBN1", b"ZBN2", b"ZRAW1"


class BigEndian(K.Reader):
    def number(self, size: int) -> int:
        return int.from_bytes(self.take(size), "big")


def _number(n: int, size: int) -> bytes:
    if n >= 1 << 8 * size:
        raise UsageError(f"{n} takes more than {size} bytes")
    return n.to_bytes(size, "big")


def _dense(freq: list[tuple[int, int]], size: int) -> bytes:
    counts = dict(freq)
    return b"".join(_number(counts.get(s, 0), 4) for s in range(size))


def _undense(r: BigEndian, size: int) -> list[tuple[int, int]]:
    counts = [r.number(4) for _ in range(size)]
    return [(s, n) for s, n in enumerate(counts) if n]


def _symbols(freq, last: int, bits: bytes) -> list[int]:
    """last: 0 stands for a full last byte in streams of ids."""
    return K.unhuffman(freq, last or 8, bits)


def _ids(layer: str, data: bytes) -> tuple[list[bytes], list[int]]:
    parts = B.split(layer, data)
    return K.unvocabulary(parts["META"]), K.unvarints(parts["MAIN"])


def write(version: int, data: bytes) -> bytes:
    head = B.FILE + bytes([version])
    if version == 1:
        freq, last, bits = K.huffman(data)
        return head + _number(len(data), 8) + _number(len(freq), 2) + b"".join(bytes([s]) + _number(n, 4) for s, n in freq) + bytes([last]) + bits
    if version == 2:
        parts = B.split("vc0", data)
        coded = [K.huffman(parts[n]) for n in ("MASK", "VOWELS", "CONS")]
        sizes = b"".join(_number(len(parts[n]), 8) for n in ("MASK", "VOWELS", "CONS"))
        return head + sizes + b"".join(_dense(f, 256) + bytes([last]) + _number(len(b), 8) for f, last, b in coded) + b"".join(b for _, _, b in coded)
    if version in (3, 4):
        vocabulary, ids = _ids("syllables_it" if version == 3 else "words_it", data)
        freq, last, bits = K.huffman(ids)
        return head + _number(len(ids), 8) + _number(len(vocabulary), 4) + b"".join(_number(len(t), 2) + t for t in vocabulary) + _dense(freq, len(vocabulary)) + bytes([last % 8]) + bits
    raise UsageError(f"no writer for version {version}")


def _read_12(r: BigEndian, version: int) -> bytes:
    n = r.number(8)
    if version == 1:
        freq = [(r.number(1), r.number(4)) for _ in range(r.number(2))]
        last = r.number(1)
        return bytes(_symbols(freq, last, r.data[r.at :]))
    r.take(16)
    heads = [(_undense(r, 256), r.number(1), r.number(8)) for _ in range(3)]
    mask, vowels, cons = (bytes(_symbols(f, last, r.take(size))) for f, last, size in heads)
    if len(mask) != n:
        raise CorruptPayload("the mask has another length")
    return B.join("vc0", {"MASK": mask, "VOWELS": vowels, "CONS": cons})


# bundles


@dataclass
class Part:
    """A named stream: bytes, or ids below ``alphabet``."""

    name: str
    alphabet: int
    data: bytes | list[int]

    @property
    def is_ids(self) -> bool:
        return isinstance(self.data, list)


def _named(p: Part) -> bytes:
    name = p.name.encode()
    return _number(len(name), 1) + name


def huffman_bundle(parts: list[Part], raw: frozenset[str] = frozenset({"__meta__"})) -> bytes:
    out = HUFFMAN_2 + _number(len(parts), 1)
    for p in parts:
        body = bytes([p.name not in raw, p.is_ids]) + _named(p) + _number(p.alphabet, 4) + _number(len(p.data), 4)
        if p.name in raw:
            body += K.varint(len(p.data)) + bytes(p.data)
        else:
            freq, last, bits = K.huffman(p.data)
            steps = zip([0, *(s for s, _ in freq)], freq)
            body += K.varint(len(freq)) + b"".join(K.varint(s - before) + K.varint(n) for before, (s, n) in steps) + bytes([last % 8 if p.is_ids else last]) + K.varint(len(bits)) + bits
        out += K.varint(len(body)) + body
    return out


def _huffman_part(body: bytes, old: bool) -> Part:
    r = BigEndian(body)
    number = (lambda: r.number(4)) if old else r.varint
    coded, is_ids = r.number(1), r.number(1)
    name = r.take(r.number(1)).decode()
    alphabet, n = r.number(4), r.number(4)
    if not coded:
        return Part(name, alphabet, r.take(number()))
    freq, at = [], 0
    for _ in range(number()):
        symbol = number()
        at = symbol if old else at + symbol
        freq.append((at, number()))
    last = r.number(1)
    data = _symbols(freq, last, r.take(number()))
    if len(data) != n:
        raise CorruptPayload("a stream has another length")
    return Part(name, alphabet, data if is_ids else bytes(data))


def un_huffman_bundle(blob: bytes) -> list[Part]:
    old = blob[:4] == HUFFMAN_1
    if not old and blob[:4] != HUFFMAN_2:
        raise CorruptPayload("not a Huffman bundle")
    r = BigEndian(blob, 4)
    return [_huffman_part(r.take(r.number(4) if old else r.varint()), old) for _ in range(r.number(1))]


def _raw_of(p: Part) -> bytes:
    return K.varints(p.data) if p.is_ids else p.data


def zstd_bundle(parts: list[Part], codec: str = "zstd") -> bytes:
    """One frame for all streams."""
    inner = K.varint(len(parts)) + b"".join(_named(p) + bytes([p.is_ids]) + _number(p.alphabet, 4) + _number(len(p.data), 4) + K.varint(len(raw := _raw_of(p))) + raw for p in parts)
    return ZSTD_2 + K.varint(len(inner)) + K.compress(codec, inner)


def zstd_frames(parts: list[Part], codec: str = "zstd") -> bytes:
    """A frame for each stream."""
    return ZSTD_1 + K.varint(len(parts)) + b"".join(_named(p) + bytes([p.is_ids]) + _number(p.alphabet, 4) + _number(len(p.data), 4) + K.varint(len(c := K.compress(codec, _raw_of(p)))) + c for p in parts)


def un_zstd_bundle(blob: bytes) -> list[Part]:
    r = BigEndian(blob, 4)
    if blob[:4] == ZSTD_2:
        size = r.varint()
        r = BigEndian(K.decompress("zstd", blob[r.at :], size))
    elif blob[:4] != ZSTD_1:
        raise CorruptPayload("not a zstd bundle")
    out = []
    for _ in range(r.varint()):
        name, is_ids = r.take(r.number(1)).decode(), r.number(1)
        alphabet, n = r.number(4), r.number(4)
        raw = r.take(r.varint())
        if blob[:4] == ZSTD_1:
            raw = K.decompress("zstd", raw)
        if is_ids:
            raw = K.unvarints(raw)
        if len(raw) != n:
            raise CorruptPayload("a stream has another length")
        out.append(Part(name, alphabet, raw))
    return out


# version 5


def pack_meta(meta) -> bytes:
    def plain(x):
        if isinstance(x, bytes):
            return {"__t": "bytes", "b64": base64.b64encode(x).decode()}
        if isinstance(x, tuple):
            return {"__t": "tuple", "items": [plain(y) for y in x]}
        if isinstance(x, list):
            return [plain(y) for y in x]
        if isinstance(x, dict):
            return {str(k): plain(v) for k, v in x.items()}
        return x

    return json.dumps(plain(meta), ensure_ascii=False, separators=(",", ":")).encode()


def unpack_meta(data: bytes):
    def real(x):
        if isinstance(x, list):
            return [real(y) for y in x]
        if isinstance(x, dict):
            kind = x.get("__t")
            return base64.b64decode(x["b64"]) if kind == "bytes" else tuple(real(y) for y in x["items"]) if kind == "tuple" else {k: real(v) for k, v in x.items()}
        return x

    return real(json.loads(data)) if data else {}


def _parts(layer: str, data: bytes) -> list[Part]:
    if layer == "bytes":
        return [Part("main", 256, data)]
    if layer == "vc0":
        s = B.split("vc0", data)
        return [Part(n.lower(), 256, s[n]) for n in ("MASK", "VOWELS", "CONS")]
    if layer not in ("words_it", "syllables_it", "lines_dict"):
        raise UsageError(f"version 5 has no bundle for layer {layer!r}")
    vocabulary, ids = _ids(layer, data)
    return [Part("main", len(vocabulary), ids), Part("__meta__", 256, K.vocabulary(vocabulary))]


def write_5(data: bytes, layer: str = "bytes", codec: str = "huffman") -> bytes:
    parts = _parts(layer, data)
    if codec == "huffman":
        payload = huffman_bundle(parts)
    elif K.resolve(codec) != codec or codec not in ("zstd", "zstd_tight"):
        raise UsageError(f"version 5 has no codec {codec!r} here")
    elif len(parts) == 1:
        payload = ZSTD_RAW + K.varint(len(data)) + K.compress(codec, data)
    else:
        payload = zstd_bundle(parts, codec)
    meta = pack_meta({})
    return B.FILE + bytes([5]) + _number(len(layer), 1) + layer.encode() + _number(len(codec), 1) + codec.encode() + _number(len(meta), 4) + meta + _number(len(payload), 4) + payload


def payload_bytes(layer: str, payload: bytes, meta: dict) -> bytes:
    """A payload of version 5 by its magic."""
    if payload[:5] == ZSTD_RAW:
        r = K.Reader(payload, 5)
        size = r.varint()
        return B.join(layer, {"MAIN": K.decompress("zstd", payload[r.at :], size)})
    parts = un_huffman_bundle(payload) if payload[:3] == b"HBN" else un_zstd_bundle(payload)
    by_name = {p.name: p for p in parts}
    if layer == "vc0":
        return B.join(layer, {n: by_name[n.lower()].data for n in ("MASK", "VOWELS", "CONS")})
    main = next((p for p in parts if p.is_ids), None) or by_name["main"]
    if not main.is_ids:
        return B.join(layer, {"MAIN": main.data})
    blob = by_name["__meta__"].data if "__meta__" in by_name else K.vocabulary(meta["vocab_list"])
    return B.join(layer, {"MAIN": _raw_of(main), "META": blob})


def read(blob: bytes, shared: B.Shared | None = None) -> bytes:
    """Any version, by its number."""
    if blob[:3] != B.FILE or len(blob) < 4:
        raise CorruptPayload("not a container")
    version, r = blob[3], BigEndian(blob, 4)
    if version == B.VERSION:
        f = B.unframe(blob)
        if f.codec == "mbn" or f.extract:
            return B.decode(blob, shared)
        return payload_bytes(f.layer, f.payload, {})
    if version == 5:
        layer = r.take(r.number(1)).decode()
        r.take(r.number(1))
        meta = unpack_meta(r.take(r.number(4)))
        return payload_bytes(layer, r.take(r.number(4)), meta)
    if version in (1, 2):
        return _read_12(r, version)
    if version in (3, 4):
        n, size = r.number(8), r.number(4)
        vocabulary = [r.take(r.number(2)) for _ in range(size)]
        freq = _undense(r, size)
        last = r.number(1)
        ids = _symbols(freq, last, r.data[r.at :])
        if len(ids) != n:
            raise CorruptPayload("the number of tokens differs")
        return b"".join(vocabulary[i] for i in ids)
    raise UnsupportedVersion(f"container version {version}")


def smallest(data: bytes, layers: tuple[str, ...], codecs: tuple[str, ...]) -> tuple[str, str, bytes]:
    """layer, codec and blob of the smallest container; the first wins ties."""
    tried = [(layer, codec, B.encode(data, layer, codec)) for layer in layers for codec in codecs]
    return min(tried, key=lambda t: len(t[2]))
