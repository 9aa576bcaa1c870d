"""Golden vectors, round trips, and what corrupt bytes raise."""

import random

import pytest

from lamina.errors import CorruptPayload, UnsupportedVersion, UsageError
from lamina.kernels import codecs as K
from lamina.kernels import containers as B
from lamina.kernels import legacy as L

INVOICE = "".join(f"POS {k}: bolt size 3 count={k} each=1.{k % 90:02d} -5 (+07) 2024-01-02\r\n" for k in range(60)).encode()
TEXTS = [b"", b"abc", b"\n\n", b"a\rb\r\nc", b"-1 2024-01-02 x=+07 (-3) 10-12 a-5\n-9", bytes(range(256)) * 3, "è già l'ora — 100%".encode(), b"9" * 50 + b" 007", b"same\nsame\nsame\nother\nsame", INVOICE]


@pytest.mark.parametrize("layer", B.LAYERS)
@pytest.mark.parametrize("codec", ["raw", "zlib", "zstd", "zstd_tight", "huffman"])
def test_round_trip(layer, codec):
    shared = B.Shared(list(range(20)), [[b"same\n"], [b"POS ", b": bolt size "]])
    for data in TEXTS:
        assert B.decode(B.encode(data, layer, codec)) == data
        assert B.decode(B.encode(data, layer, codec, shared=shared), shared) == data


def test_number_vectors():
    assert K.num_v1(b"").hex() == "4e563100"
    assert K.num_v1(K.ints_to_bytes([0, 1, -1, 2, -2, 127, -128])).hex() == "4e56310000020104 03fe01ff01".replace(" ", "")
    ints = [100000, 100001, 100002, 100003] * 50
    raw = K.ints_to_bytes(ints)
    assert K.num_v1(raw).hex() == "4e56310104c09a0cc29a0cc49a0cc69a0c" + "01020304" * 50
    blob = K.num_v1(raw, [100000, 100001, 100002, 100003])
    assert blob[:12].hex() == "4e5631024d3c6bf064ce99a5" and K.un_num_v1(blob, [100000, 100001, 100002, 100003]) == raw
    with pytest.raises(CorruptPayload):
        K.un_num_v1(blob, [1, 2, 3, 4])


def test_numbers_come_back():
    rng = random.Random(1)
    for n in (0, 1, 7, 8, 500):
        for top in (3, 10**4, 10**17):
            raw = K.ints_to_bytes(rng.randrange(-top, top) for _ in range(n))
            assert K.un_num_v0(K.num_v0(raw)) == raw and K.un_num_v1(K.num_v1(raw)) == raw


def test_bundle_vectors():
    assert B.bundle([B.Stream(10, 6, 5, b"abc")]).hex() == "4d424e010a06050300616263"
    assert B.bundle([B.Stream(0, 3, 0, b""), B.Stream(11, 7, 4, b"\x01\x02", b"\xff")]).hex() == "4d424e0200030000000b07040201ff0102"
    for bad in (b"XXX\x01", b"MB", b"MBN\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff\xff", bytes.fromhex("4d424e010a0605030061"), b"MBN" + K.varint(10_001)):
        with pytest.raises(CorruptPayload):
            B.unbundle(bad)
    with pytest.raises(UsageError):
        B.bundle([B.Stream(1, 3, 0, b""), B.Stream(1, 3, 0, b"")])


def test_huffman():
    for data in TEXTS:
        freq, last, bits = K.huffman(data)
        assert bytes(K.unhuffman(freq, last, bits)) == data
        if data:
            assert K.huffman_bits([n for _, n in freq]) == 8 * len(bits) - 8 + last


def test_corrupt():
    blob = B.encode(INVOICE, "split_text_nums", "zlib")
    with pytest.raises(CorruptPayload):
        B.decode(blob[:-3])
    with pytest.raises(UnsupportedVersion):
        B.decode(b"GCC\x09" + blob[4:])
    with pytest.raises(CorruptPayload):
        B.decode(b"nothing")
    with pytest.raises(UsageError):
        B.decode(B.extract(b"a 1 2-3"))
    assert B.extracted(B.extract(b"a 1 2-3 x10-12")) == [1, 2, -3, 10, -12]
    assert K.unvocabulary(bytes.fromhex("00000001" "00000002" "6162")) == [b"ab"]
    assert K.untemplate_resource(K.template_resource([[b"a", b""]])[0]) == [[b"a", b""]]


@pytest.mark.parametrize("version", [1, 2, 3, 4])
def test_older_versions(version):
    for data in TEXTS:
        if version < 3 or max((len(x) for x in data.split(b" ")), default=0) < 1 << 16:
            assert L.read(L.write(version, data)) == data
    assert L.write(1, b"").hex() == "47434301" + "00" * 11


@pytest.mark.parametrize("layer", ["bytes", "vc0", "syllables_it", "words_it", "lines_dict"])
@pytest.mark.parametrize("codec", ["huffman", "zstd", "zstd_tight"])
def test_version_5(layer, codec):
    for data in TEXTS:
        blob = L.write_5(data, layer, codec)
        assert L.read(blob) == data
        framed = B.frame(blob[4 + 1 + len(layer) + 1 + len(codec) + 4 + 2 + 4 :], layer, codec)
        assert L.read(framed) == data
    parts = [L.Part("main", 3, [0, 1, 2, 1]), L.Part("__meta__", 256, b"abc")]
    assert L.un_zstd_bundle(L.zstd_frames(parts)) == parts == L.un_zstd_bundle(L.zstd_bundle(parts)) == L.un_huffman_bundle(L.huffman_bundle(parts))
    assert L.unpack_meta(L.pack_meta({"a": (b"x", [1, None])})) == {"a": (b"x", [1, None])}


def test_universal_reader_and_choice():
    assert L.read(B.encode(INVOICE, "tpl_lines_v0", "zlib")) == INVOICE
    layer, codec, blob = L.smallest(INVOICE, ("bytes", "split_text_nums", "tpl_lines_v0"), ("raw", "zlib"))
    assert L.read(blob) == INVOICE and codec == "zlib" and len(blob) <= len(B.encode(INVOICE, "bytes", "zlib"))
    with pytest.raises(UnsupportedVersion):
        L.read(b"GCC\x09")
    with pytest.raises(CorruptPayload):
        L.read(L.write(4, INVOICE)[:-2])
