"""Streams of one file, bundled and framed."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import numpy as np

from lamina.errors import CorruptPayload, UnsupportedVersion, UsageError
from lamina.kernels import codecs as K

#: Fixed values of the formats.
LAYERS = {"bytes": 0, "syllables_it": 1, "words_it": 2, "vc0": 3, "lines_dict": 4, "lines_rle": 5, "split_text_nums": 6, "tpl_lines_v0": 7, "tpl_lines_shared_v0": 8}
CODECS = {"huffman": 0, "zstd": 1, "zstd_tight": 2, "raw": 3, "mbn": 4, "num_v0": 5, "zlib": 6, "num_v1": 7}
STREAMS = {"MAIN": 0, "MASK": 1, "VOWELS": 2, "CONS": 3, "TEXT": 10, "NUMS": 11, "TPL": 20, "IDS": 21, "META": 250}
FILE, BUNDLE, VERSION = b"GCC", b"MBN", 6
HAS_META, HAS_LENGTH, EXTRACT = 1, 2, 128
MOST_STREAMS = 10_000
_LAYER, _CODEC = {v: k for k, v in LAYERS.items()}, {v: k for k, v in CODECS.items()}


@dataclass
class Stream:
    stype: int
    codec: int
    ulen: int
    comp: bytes
    meta: bytes = b""


def bundle(streams: list[Stream]) -> bytes:
    if len({s.stype for s in streams}) < len(streams):
        raise UsageError("two streams of one type")
    if not 0 < len(streams) <= MOST_STREAMS or any(not 0 <= x <= 255 for s in streams for x in (s.stype, s.codec)):
        raise UsageError("too few or many streams, or a code beyond a byte")
    return BUNDLE + K.varint(len(streams)) + b"".join(bytes([s.stype, s.codec]) + K.varint(s.ulen) + K.varint(len(s.comp)) + K.varint(len(s.meta)) + s.meta + s.comp for s in streams)


def unbundle(payload: bytes) -> list[Stream]:
    """Of streams of one type the last counts; that is for the reader of the list."""
    if payload[:3] != BUNDLE:
        raise CorruptPayload("not a stream bundle")
    r = K.Reader(payload, 3)
    n = r.varint()
    if n > MOST_STREAMS:
        raise CorruptPayload("too many streams")
    out = []
    for _ in range(n):
        stype, codec = r.take(2)
        ulen, clen, mlen = r.varint(), r.varint(), r.varint()
        meta = r.take(mlen)
        out.append(Stream(stype, codec, ulen, r.take(clen), meta))
    r.end()
    return out


def frame(payload: bytes, layer: str, codec: str, meta: bytes = b"", extract: bool = False) -> bytes:
    if layer not in LAYERS or codec not in CODECS:
        raise UsageError(f"no layer {layer!r} or codec {codec!r}")
    flags = (EXTRACT if extract else 0) | (HAS_META if meta else 0)
    return FILE + bytes([VERSION, flags, LAYERS[layer], CODECS[codec]]) + (K.varint(len(meta)) + meta if meta else b"") + payload


@dataclass
class Frame:
    layer: str
    codec: str
    meta: bytes
    payload: bytes
    extract: bool


def unframe(blob: bytes) -> Frame:
    if blob[:3] != FILE or len(blob) < 4:
        raise CorruptPayload("not a container")
    if blob[3] != VERSION:
        raise UnsupportedVersion(f"container version {blob[3]}")
    r = K.Reader(blob, 4)
    flags, layer, codec = r.take(3)
    if layer not in _LAYER or codec not in _CODEC:
        raise CorruptPayload("a layer or codec without a name")
    meta = r.take(r.varint()) if flags & HAS_META else b""
    payload = r.take(r.varint()) if flags & HAS_LENGTH else blob[r.at :]
    return Frame(_LAYER[layer], _CODEC[codec], meta, payload, bool(flags & EXTRACT))


# layers over bytes, as Latin-1 text

NUMBER = re.compile(r"(?:(?:(?<=^)|(?<=[\t\n\r (\[{<=:,;]))[+-])?[0-9]+")
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+")
_WORD = re.compile(r"[A-Za-z]+|[^A-Za-z]+")
_CONS = "b-df-hj-np-tv-zB-DF-HJ-NP-TV-Z"
_SYLLABLE = re.compile(rf"[{_CONS}]*[aeiouAEIOU]|[{_CONS}]+|[^A-Za-z]+")
MOST_DIGITS = 18  # of one number; longer digit runs are several, side by side


def _parts(s: str) -> tuple[list[str], list[int]]:
    """Chunks around the numbers, and (sign, digits, magnitude) of each."""
    chunks, nums, at = [], [], 0
    for m in NUMBER.finditer(s):
        raw = m[0]
        digits = raw.lstrip("+-")
        chunks.append(s[at : m.start()])
        nums += [{"+": 1, "-": 2}.get(raw[0], 0), len(digits[:MOST_DIGITS]), int(digits[:MOST_DIGITS])]
        for k in range(MOST_DIGITS, len(digits), MOST_DIGITS):
            chunks.append("")
            nums += [0, len(digits[k : k + MOST_DIGITS]), int(digits[k : k + MOST_DIGITS])]
        at = m.end()
    return [*chunks, s[at:]], nums


def _number(sign: int, digits: int, magnitude: int) -> str:
    return ("", "+", "-")[sign] + str(magnitude).zfill(digits)


def _l1(chunks: list[str]) -> list[bytes]:
    return [c.encode("latin-1") for c in chunks]


@dataclass
class Shared:
    """What a bucket's files share."""

    numbers: list[int] | None = None
    templates: list[list[bytes]] = field(default_factory=list)


def split(layer: str, data: bytes, shared: Shared | None = None) -> dict[str, bytes]:
    """The layer's streams, with META where the decoder needs it."""
    s = data.decode("latin-1")
    if layer == "bytes":
        return {"MAIN": data}
    if layer in ("words_it", "syllables_it", "lines_dict", "lines_rle"):
        tokens = {"words_it": _WORD, "syllables_it": _SYLLABLE}.get(layer, _LINE).findall(s)
        number: dict[str, int] = {}
        ids = [number.setdefault(t, len(number)) for t in tokens]
        if layer == "lines_rle":
            runs: list[list[int]] = []
            for i in ids:
                if runs and runs[-1][0] == i:
                    runs[-1][1] += 1
                else:
                    runs.append([i, 1])
            main = K.varints([x for run in runs for x in run])
        else:
            main = K.varints(ids)
        return {"MAIN": main, "META": K.vocabulary(_l1(list(number)))}
    if layer == "vc0":
        vowels = [c in "aeiouAEIOU" for c in s]
        mask = "".join("V" if v else "C" if c.isalpha() else "O" for c, v in zip(s, vowels))
        return {"MASK": mask.encode(), "VOWELS": "".join(c for c, v in zip(s, vowels) if v).encode("latin-1"), "CONS": "".join(c for c, v in zip(s, vowels) if not v).encode("latin-1")}
    if layer == "split_text_nums":
        chunks, nums = _parts(s)
        return {"TEXT": "".join(chunks).encode("latin-1"), "NUMS": K.ints_to_bytes([len(nums) // 3, *map(len, chunks), *nums]), "META": bytes([1, 1])}
    if layer in ("tpl_lines_v0", "tpl_lines_shared_v0"):
        lines = _LINE.findall(s) or [""]
        base = [tuple(t) for t in (shared.templates if shared and layer == "tpl_lines_shared_v0" else [])]
        number = {t: k for k, t in enumerate(base)}
        ids, nums = [], [len(lines)]
        for line in lines:
            chunks, own = _parts(line)
            ids.append(number.setdefault(tuple(_l1(chunks)), len(number)))
            nums += [len(own) // 3, *own]
        new = [list(t) for t in list(number)[len(base) :]]
        meta = bytes([1, 1])
        if layer == "tpl_lines_shared_v0":
            meta += bytes([0]) + K.varint(len(base)) + (K.template_resource(shared.templates)[1] if base else b"")
        return {"TPL": K.template_list(new), "IDS": K.ints_to_bytes(ids), "NUMS": K.ints_to_bytes(nums), "META": meta}
    raise UsageError(f"no layer {layer!r}")


def unmasked(mask: bytes, vowels: bytes, cons: bytes) -> bytes:
    """The bytes whose vowels (V in the mask) and others lie apart."""
    of = np.frombuffer(mask, np.uint8) == ord("V")
    n = int(of.sum())
    if len(vowels) < n or len(cons) < len(mask) - n:
        raise CorruptPayload("the mask asks for more than there is")
    out = np.empty(len(mask), np.uint8)
    out[of], out[~of] = np.frombuffer(vowels, np.uint8)[:n], np.frombuffer(cons, np.uint8)[: len(mask) - n]
    return out.tobytes()


def join(layer: str, streams: dict[str, bytes], shared: Shared | None = None) -> bytes:
    try:
        return _join(layer, streams, shared)
    except (KeyError, IndexError) as e:
        raise CorruptPayload(f"{layer}: a stream is missing or short ({e})") from e


def _join(layer: str, streams: dict[str, bytes], shared: Shared | None) -> bytes:
    if layer == "bytes":
        return streams["MAIN"]
    if layer in ("words_it", "syllables_it", "lines_dict", "lines_rle"):
        vocabulary, ids = K.unvocabulary(streams["META"]), K.unvarints(streams["MAIN"])
        if layer == "lines_rle":
            if len(ids) % 2:
                raise CorruptPayload("a run without a length")
            return b"".join([vocabulary[i] * n for i, n in zip(ids[::2], ids[1::2])])
        return b"".join([vocabulary[i] for i in ids])
    if layer == "vc0":
        return unmasked(streams["MASK"], streams["VOWELS"], streams["CONS"])
    if layer == "split_text_nums":
        ints, text = K.bytes_to_ints(streams["NUMS"]), streams["TEXT"]
        n, at, out = ints[0], 0, []
        for k in range(n + 1):
            out.append(text[at : at + ints[1 + k]])
            at += ints[1 + k]
            if k < n:
                out.append(_number(*ints[n + 2 + 3 * k : n + 5 + 3 * k]).encode())
        return b"".join(out)
    templates = [*(shared.templates if shared and layer == "tpl_lines_shared_v0" else []), *K.untemplate_list(streams["TPL"])]
    nums = iter(K.bytes_to_ints(streams["NUMS"]))
    ids = K.bytes_to_ints(streams["IDS"])
    if next(nums) != len(ids):
        raise CorruptPayload("line counts differ")
    out = []
    for i in ids:
        chunks = templates[i]
        if next(nums) != len(chunks) - 1:
            raise CorruptPayload("a line's numbers don't fit its template")
        out.append(chunks[0])
        for c in chunks[1:]:
            out += [_number(next(nums), next(nums), next(nums)).encode(), c]
    return b"".join(out)


def routed(layer: str, codec: str, streams: dict[str, str] | None = None) -> dict[str, str]:
    """The codec of each stream: numbers and ids to num_v1, META raw, others ``codec``, unless ``streams`` says otherwise."""
    out = dict.fromkeys(STREAMS, codec) | {"NUMS": "num_v1", "META": "raw"}
    if layer.startswith("tpl_lines"):
        out["IDS"] = "num_v1"
    return out | (streams or {})


def encode(data: bytes, layer: str, codec: str, streams: dict[str, str] | None = None, shared: Shared | None = None) -> bytes:
    """A file as a container with a stream bundle. META comes last."""
    codec_of = routed(layer, codec, streams)
    parts = split(layer, data, shared)
    packed = [Stream(STREAMS[n], CODECS[K.resolve(codec_of[n])], len(raw), K.compress(codec_of[n], raw, shared.numbers if shared else None)) for n, raw in sorted(parts.items(), key=lambda x: STREAMS[x[0]])]
    return frame(bundle(packed), layer, "mbn")


def decode(blob: bytes, shared: Shared | None = None) -> bytes:
    f = unframe(blob)
    if f.extract:
        raise UsageError("an extract has lost its text; it can only be shown")
    if f.codec != "mbn":
        raise CorruptPayload(f"a container of codec {f.codec} without a bundle")
    name = {v: k for k, v in STREAMS.items()}
    streams = {}
    for s in unbundle(f.payload):
        if s.codec not in _CODEC:
            raise CorruptPayload("a codec without a name")
        if s.stype in name:
            streams[name[s.stype]] = K.decompress(_CODEC[s.codec], s.comp, s.ulen, shared.numbers if shared else None)
    return join(f.layer, streams, shared)


def extract(data: bytes) -> bytes:
    """The numbers of a text, lossy: a bundle of the numbers and what they were taken from."""
    text = data.decode("utf-8", "ignore")
    nums = [int(m) for m in re.findall(r"-?\d+", text)]
    if all(abs(n) < 1 << 62 for n in nums):
        raw, kind, codec = K.ints_to_bytes(nums), "NUMS", "num_v1"
    else:  # the numbers' coding would not bring all of them back
        raw, kind, codec = "\n".join(map(str, nums)).encode(), "TEXT", "zlib"
    about = json.dumps({"extractor": "numbers_only", "count": len(nums), "src_bytes": len(data)}, separators=(",", ":")).encode()
    streams = [Stream(STREAMS[kind], CODECS[codec], len(raw), K.compress(codec, raw)), Stream(STREAMS["META"], CODECS["raw"], len(about), about)]
    return frame(bundle(streams), "bytes", "mbn", extract=True)


def extracted(blob: bytes) -> list[int]:
    f = unframe(blob)
    if not f.extract:
        raise UsageError("not an extract")
    if f.codec == "num_v1":
        return K.bytes_to_ints(K.un_num_v1(f.payload))
    for s in unbundle(f.payload):
        if s.stype == STREAMS["NUMS"]:
            return K.bytes_to_ints(K.decompress(_CODEC[s.codec], s.comp, s.ulen))
        if s.stype == STREAMS["TEXT"]:
            return [int(n) for n in K.decompress(_CODEC[s.codec], s.comp, s.ulen).split()]
    raise CorruptPayload("an extract without numbers")
