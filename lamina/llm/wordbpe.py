"""Whole-text encoding with a tokenizers file whose words never cross white space.

Each text is cut at its spaces and newlines, the library encodes each distinct piece once per
cache, and the pieces' ids are put together again. That equals encoding the whole text when the
tokenizer drops white space and its normalizer never joins characters across it, which holds for
``word_bpe_49k.json``; ``tests/llm`` compares it with the library's own encoding of whole texts.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa

from lamina.llm.bpe import byte_letters
from lamina.llm.common import Memo, resident


#: ASCII marks, which make up one token run after letters; the apostrophe may begin a contraction.
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c != "'")
_IS_MARK, _IS_ASCII_LETTER = (np.isin(np.arange(256), [b for b in range(128) if test(chr(b))]) for test in (lambda c: c in MARKS, str.isalpha))
#: Bytes of text, and texts, that are encoded at once.
BYTES, TEXTS = 2 << 20, 1000


def _sums(flags: np.ndarray) -> np.ndarray:
    out = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=out[1:])
    return out


def _strings(sizes: np.ndarray, data: np.ndarray) -> pa.DictionaryArray:
    """The distinct ones among strings that lie side by side, and which is where."""
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(_sums(sizes).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))).dictionary_encode()


def _listed(strings: pa.Array) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()


class _Items:
    """Runs of ids that lie side by side, taken by number."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.begins = flat, sizes, np.cumsum(sizes) - sizes

    @classmethod
    def of(cls, parts: list[bytes]) -> _Items:
        return cls(np.frombuffer(b"".join(parts), "<u4"), np.fromiter(map(len, parts), np.int64, len(parts)) >> 2)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these items one after another, and where each ends."""
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        at = np.repeat(self.begins[which] - (ends - sizes), sizes)
        at += np.arange(len(at))
        return self.flat[at], ends


class PieceEncoder:
    """Texts -> little-endian unsigned 32-bit ids.

    Each distinct piece of some texts is looked at once: letters with marks after them, which most are, are taken apart as
    arrays of bytes, so only distinct lower-case words become Python strings. Words and other pieces of up to 64 characters
    that were used lately are remembered.
    """

    def __init__(self, path: str, limit: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.letters = {b: c for c, b in byte_letters().items()}
        self.stems, self.others = Memo(self._word, limit), Memo(self._any, 20_000)

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, ends = self.encoded(pa.array(texts, pa.string()))
        return [ids[a:z].tobytes() for a, z in zip([0, *ends.tolist()], ends.tolist())]

    def batches(self, batch: pa.RecordBatch, end_id: int, column: str = "text"):
        """Slices of a batch with their texts' ids, each with the end id behind it, and where each ends: BYTES of text at once, or one text that has more."""
        texts = batch.column(column)
        sizes = np.diff(np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1 + texts.offset)[texts.offset :].astype(np.int64)) if len(texts) else []
        upto, a = np.cumsum(sizes), 0
        while a < len(texts):
            z = min(a + TEXTS, max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + BYTES, "right"))), len(texts))
            yield batch.slice(a, z - a), *self.encoded(texts.slice(a, z - a), end_id)
            a = z

    def encoded(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids one after another, and where each text ends."""
        for memo in (self.stems, self.others):
            memo.renew()
        texts, n = texts.fill_null("") if texts.null_count else texts, len(texts)
        if not n:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        ends = np.frombuffer(texts.buffers()[1], np.int32, texts.offset + n + 1)[texts.offset :].astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
        ends -= ends[0]
        # a piece ends at each space and newline, and with its text
        cut = (data == 32) | (data == 10)
        cuts = np.flatnonzero(cut)
        before = np.searchsorted(cuts, ends)
        last = before[1:] + np.arange(n)
        inner = np.ones(len(cuts) + n, bool)
        inner[last] = False
        upto = np.empty(len(inner), np.int64)
        upto[inner], upto[last] = cuts - np.arange(len(cuts)), ends[1:] - before[1:]
        pieces = _strings(np.diff(upto, prepend=0), data[~cut])
        items = self._items(pieces.dictionary, end_id)
        if end_id is None:
            ids, ends = items.take(pieces.indices.to_numpy())
            return ids, ends[last]
        last += 1 + np.arange(n)
        which = np.full(len(inner) + n, len(pieces.dictionary))
        inner = np.ones(len(which), bool)
        inner[last] = False
        which[inner] = pieces.indices.to_numpy()
        ids, ends = items.take(which)
        return ids, ends[last]

    def _items(self, pieces: pa.StringArray, end_id: int | None) -> _Items:
        """The ids of distinct pieces, and as one more item the end id.

        Words of Latin letters go straight to the library's model, as its earlier steps only lower-case them.
        """
        offsets = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)
        data = np.frombuffer(pieces.buffers()[2] or b"", np.uint8)[: offsets[-1]]
        begins, sizes = offsets[:-1].astype(np.int64), np.diff(offsets)
        # U+00C0 to U+00FF, but for the signs of multiplication and division
        lead = np.flatnonzero(data[:-1] == 0xC3)
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        letter, mark = _IS_ASCII_LETTER[data], _IS_MARK[data]
        letter[lead] = letter[lead + 1] = True
        letters, marks = _sums(letter), _sums(mark)
        n = letters[offsets[1:]] - letters[begins]
        plain = (n > 0) & (letters[begins + n] - letters[begins] == n) & (marks[offsets[1:]] - marks[begins] == sizes - n)
        there = np.repeat(plain, sizes)
        low = data.copy()
        low[(data >= 65) & (data <= 90)] += 32
        low[lead[data[lead + 1] <= 0x9E] + 1] += 32
        stems, tails = _strings(n[plain], low[letter & there]), _strings((sizes - n)[plain], data[mark & there])
        others = _listed(pieces.filter(pa.array(~plain)))
        parts = [*map(self.stems.__getitem__, _listed(stems.dictionary)), *map(self.others.__getitem__, _listed(tails.dictionary)), *map(self.others.__getitem__, others), b""]
        first, second = np.empty(len(pieces), np.int64), np.full(len(pieces), len(parts) - 1)
        first[plain], second[plain] = stems.indices.to_numpy(), tails.indices.to_numpy() + len(stems.dictionary)
        first[~plain] = np.arange(len(others)) + len(stems.dictionary) + len(tails.dictionary)
        ids, ends = _Items.of(parts).take(np.stack([first, second], 1).ravel())
        sizes = np.diff(ends[1::2], prepend=0)
        return _Items(ids, sizes) if end_id is None else _Items(np.r_[ids, np.array([end_id], "<u4")], np.r_[sizes, 1])

    def _any(self, piece: str) -> bytes:
        return array("I", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()

    def _word(self, low: str) -> bytes:
        letters = low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()


def encoder(path: str) -> PieceEncoder:
    return resident(path, lambda: PieceEncoder(path))
