"""Byte kernels: LEB128 integers, numeric codecs, Huffman, zlib and zstd, dictionaries as bytes."""

from __future__ import annotations

import hashlib
import heapq
import zlib
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from lamina.errors import CorruptPayload, UsageError

try:
    import zstandard
except ImportError:  # an optional library; zlib stands in
    zstandard = None

#: Fixed values of the formats.
VOCABULARY, NUM_V0, NUM_V1, TEMPLATES = b"VB2\0", b"NV0", b"NV1", b"TPLD"
RAW, DELTA = 0, 1
DICT, SHARED = 1, 2
CANDIDATES = (8, 16, 32, 64, 128)


def varint(n: int) -> bytes:
    if n < 0:
        raise UsageError("a varint is not negative")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


#: The varints that are asked for most.
_SHORT = [varint(n) for n in range(1 << 14)]


def varints(numbers: Iterable[int]) -> bytes:
    most = len(_SHORT)
    return b"".join([_SHORT[n] if 0 <= n < most else varint(n) for n in numbers])


def unvarints(data: bytes) -> list[int]:
    """All varints of a buffer, side by side."""
    if not data:
        return []
    a = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(a < 128)
    if a[-1] > 127:
        raise CorruptPayload("a varint has no end")
    starts = np.r_[0, ends[:-1] + 1]
    size = ends - starts + 1
    if size.max() > 8:  # beyond what a signed 64-bit number holds for sure: one by one
        r, out = Reader(data), []
        while not r.ended:
            out.append(r.varint())
        return out
    values = np.zeros(len(ends), np.int64)
    for k in range(int(size.max())):
        some = np.flatnonzero(size > k)
        values[some] |= (a[starts[some] + k].astype(np.int64) & 127) << (7 * k)
    return values.tolist()


class Reader:
    """Takes bytes and varints from a buffer; what reaches past its end is corrupt."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CorruptPayload("the payload ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def varint(self) -> int:
        value = 0
        for shift in range(0, 70, 7):
            b = self.take(1)[0]
            value |= (b & 127) << shift
            if b < 128:
                return value
        raise CorruptPayload("a varint has no end")

    @property
    def ended(self) -> bool:
        return self.at == len(self.data)

    def end(self) -> None:
        if not self.ended:
            raise CorruptPayload("bytes follow the payload")


def zigzag(n: int) -> int:
    return 2 * n if n >= 0 else -2 * n - 1


def unzigzag(u: int) -> int:
    return u >> 1 ^ -(u & 1)


def ints_to_bytes(ints: Iterable[int]) -> bytes:
    return varints([2 * n if n >= 0 else -2 * n - 1 for n in ints])


def bytes_to_ints(data: bytes) -> list[int]:
    return [u >> 1 ^ -(u & 1) for u in unvarints(data)]


def num_v0(data: bytes) -> bytes:
    ints = bytes_to_ints(data)
    delta = ints_to_bytes(b - a for a, b in zip([0, *ints], ints))
    if len(ints) > 1 and len(delta) < len(data):
        return NUM_V0 + bytes([DELTA]) + delta
    return NUM_V0 + bytes([RAW]) + data


def un_num_v0(blob: bytes) -> bytes:
    if blob[:3] != NUM_V0 or len(blob) < 4 or blob[3] > DELTA:
        raise CorruptPayload("not a num_v0 stream")
    if blob[3] == RAW:
        return blob[4:]
    out, total = [], 0
    for d in bytes_to_ints(blob[4:]):
        total += d
        out.append(total)
    return ints_to_bytes(out)


def dictionary_tag(values: list[int]) -> bytes:
    return hashlib.sha256(ints_to_bytes(values)).digest()[:8]


def by_frequency(ints: Iterable[int]) -> list[int]:
    return [v for v, _ in sorted(Counter(ints).items(), key=lambda x: (-x[1], abs(x[0]), x[0]))]


def _coded(ints: list[int], values: list[int]) -> bytes:
    code = {v: varint(k) for k, v in enumerate(values, 1)}
    return b"".join(code[n] if n in code else b"\0" + varint(zigzag(n)) for n in ints)


def num_v1(data: bytes, shared: list[int] | None = None) -> bytes:
    """The first strictly shortest of raw, shared dictionary, and own dictionaries of CANDIDATES values."""
    ints = bytes_to_ints(data)
    options = [NUM_V1 + bytes([RAW]) + data]
    if len(ints) >= 8:
        if shared:
            options.append(NUM_V1 + bytes([SHARED]) + dictionary_tag(shared) + _coded(ints, shared))
        ordered = by_frequency(ints)
        if len(ordered) >= 4:
            for k in CANDIDATES:
                top = ordered[:k]
                options.append(NUM_V1 + bytes([DICT]) + varint(len(top)) + ints_to_bytes(top) + _coded(ints, top))
    return min(options, key=len)


def un_num_v1(blob: bytes, shared: list[int] | None = None) -> bytes:
    if blob[:3] != NUM_V1 or len(blob) < 4:
        raise CorruptPayload("not a num_v1 stream")
    r, mode = Reader(blob, 4), blob[3]
    if mode == RAW:
        return blob[4:]
    if mode == DICT:
        values = [unzigzag(r.varint()) for _ in range(r.varint())]
    elif mode == SHARED:
        if not shared or r.take(8) != dictionary_tag(shared):
            raise CorruptPayload("the shared dictionary is missing or another one")
        values = shared
    else:
        raise CorruptPayload(f"num_v1 has no mode {mode}")
    out = []
    while not r.ended:
        code = r.varint()
        if code > len(values):
            raise CorruptPayload("a code lies outside the dictionary")
        out.append(values[code - 1] if code else unzigzag(r.varint()))
    return ints_to_bytes(out)


# Huffman


def code_lengths_tree(freq: dict[int, int]):
    """The root of the tree: leaves are ints, inner nodes pairs. Ties go to what was made first; symbols ascend."""
    heap = [(n, k, s) for k, (s, n) in enumerate(sorted(freq.items()))]
    if len(heap) == 1:  # a lone symbol needs a code of one bit, so it gets a neighbour that never occurs
        heap.append((0, 1, -1))
    heapq.heapify(heap)
    made = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, (a[0] + b[0], made, (a[2], b[2])))
        made += 1
    return heap[0][2]


def codes_of(root) -> dict[int, str]:
    out, todo = {}, [(root, "")]
    while todo:
        node, code = todo.pop()
        if isinstance(node, tuple):
            todo += [(node[0], code + "0"), (node[1], code + "1")]
        else:
            out[node] = code
    return out


def huffman(symbols: Iterable[int]) -> tuple[list[tuple[int, int]], int, bytes]:
    """(symbol, count) pairs, number of bits in the last byte (0 for no bits), the bits."""
    symbols = list(symbols)
    if not symbols:
        return [], 0, b""
    freq = Counter(symbols)
    code = codes_of(code_lengths_tree(freq))
    bits = "".join(map(code.__getitem__, symbols))
    n = -(-len(bits) // 8)
    return sorted(freq.items()), (len(bits) - 1) % 8 + 1, int(bits.ljust(8 * n, "0"), 2).to_bytes(n, "big")


def unhuffman(freq: list[tuple[int, int]], last: int, data: bytes) -> list[int]:
    if not freq:
        return []
    root = code_lengths_tree(dict(freq))
    bits = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}"[: 8 * len(data) - (8 - last)]
    out, node = [], root
    for b in bits:
        node = node[b == "1"]
        if not isinstance(node, tuple):
            out.append(node)
            node = root
    if len(out) != sum(n for _, n in freq) or node is not root:
        raise CorruptPayload("the Huffman bits don't fit their table")
    return out


def huffman_bits(counts: Iterable[int]) -> int:
    """Total bits: the sum of the inner nodes' weights, however ties are broken."""
    heap = sorted(counts)
    if len(heap) == 1:
        return heap[0]
    total = 0
    heapq.heapify(heap)
    while len(heap) > 1:
        n = heapq.heappop(heap) + heapq.heappop(heap)
        total += n
        heapq.heappush(heap, n)
    return total


def huffman_blob(data: bytes) -> bytes:
    freq, last, bits = huffman(data)
    return varint(len(freq)) + b"".join(bytes([s]) + varint(n) for s, n in freq) + bytes([last]) + bits


def unhuffman_blob(blob: bytes) -> bytes:
    r = Reader(blob)
    freq = [(r.take(1)[0], r.varint()) for _ in range(r.varint())]
    last = r.take(1)[0]
    return bytes(unhuffman(freq, last, r.data[r.at :]))


# general codecs


def have_zstd() -> bool:
    return zstandard is not None


def resolve(codec: str) -> str:
    """zlib stands in for zstd where the library is missing."""
    return "zlib" if codec in ("zstd", "zstd_tight") and not have_zstd() else codec


@lru_cache(maxsize=2)
def _press(sized: bool):
    """A compressor of level 19, kept, as its tables take longer to set up than a short text to compress."""
    return zstandard.ZstdCompressor(level=19, write_content_size=sized, write_checksum=False)


def compress(codec: str, data: bytes, shared: list[int] | None = None) -> bytes:
    match resolve(codec):
        case "raw":
            return data
        case "zlib":
            return zlib.compress(data, 9)
        case "zstd":
            return _press(True).compress(data)
        case "zstd_tight":
            return _press(False).compress(data)
        case "huffman":
            return huffman_blob(data)
        case "num_v0":
            return num_v0(data)
        case "num_v1":
            return num_v1(data, shared)
    raise UsageError(f"no codec {codec!r}")


def decompress(codec: str, blob: bytes, size: int | None = None, shared: list[int] | None = None) -> bytes:
    """size: what must come out; other sizes are corrupt. Frames without a size of their own need it, and empty ones are known from it."""
    try:
        match resolve(codec):
            case "raw":
                out = blob
            case "zlib":
                out = zlib.decompress(blob)
            case "zstd" | "zstd_tight":
                out = b"" if size == 0 else zstandard.ZstdDecompressor().decompress(blob, max_output_size=size or 1 << 31)
            case "huffman":
                out = unhuffman_blob(blob)
            case "num_v0":
                out = un_num_v0(blob)
            case "num_v1":
                out = un_num_v1(blob, shared)
            case _:
                raise UsageError(f"no codec {codec!r}")
    except (zlib.error, ValueError, *((zstandard.ZstdError,) if zstandard else ())) as e:
        raise CorruptPayload(f"{codec}: {e}") from e
    if size is not None and len(out) != size:
        raise CorruptPayload(f"{codec}: {len(out)} bytes instead of {size}")
    return out


# dictionaries


def vocabulary(tokens: list[bytes]) -> bytes:
    return VOCABULARY + varint(len(tokens)) + b"".join(varint(len(t)) + t for t in tokens)


def unvocabulary(blob: bytes) -> list[bytes]:
    if blob[:4] == VOCABULARY:
        r = Reader(blob, 4)
        out = [r.take(r.varint()) for _ in range(r.varint())]
    else:  # the older form: four-byte big-endian numbers
        r = Reader(blob)
        number = lambda: int.from_bytes(r.take(4), "big")
        out = [r.take(number()) for _ in range(number())]
    r.end()
    return out


def template_list(templates: list[list[bytes]]) -> bytes:
    return varint(len(templates)) + b"".join(varint(len(t)) + b"".join(varint(len(c)) + c for c in t) for t in templates)


def untemplate_list(blob: bytes) -> list[list[bytes]]:
    r = Reader(blob)
    out = [[r.take(r.varint()) for _ in range(r.varint())] for _ in range(r.varint())]
    r.end()
    return out


def template_resource(templates: list[list[bytes]]) -> tuple[bytes, bytes]:
    """The shared dictionary as a resource, and its tag."""
    blob = TEMPLATES + bytes([1, 1, 1, 0]) + template_list(templates)
    return blob, hashlib.sha256(blob).digest()[:8]


def untemplate_resource(blob: bytes) -> list[list[bytes]]:
    if blob[:4] != TEMPLATES or len(blob) < 8 or blob[4] != 1:
        raise CorruptPayload("not a template dictionary")
    return untemplate_list(blob[8:])
