"""Byte-level BPE, encoded with a priority queue and decoded by concatenation.

A word's bytes form a doubly linked list of symbols. The queue holds each adjacent pair that can be
merged, lowest merge rank first and leftmost among equals; an entry is stale, and skipped, when one
of its symbols has changed since. Decoding puts the ids' byte strings side by side.

Special tokens of the vocabulary file that stand in a text become their ids, as in the library.
Nulls: a null text is empty: no ids, the hashes of the empty string. A null doc_id is kept.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from lamina.llm.common import Memo, own_columns, resident, texts_of

#: The white space of Unicode, and the pattern of byte-level BPE's words with it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in vocabulary files: itself if printable Latin-1, else from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = (b for b in range(256) if b not in set(plain))
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class BytePairCodec:
    """limit: so many chunks (a word with the white space before it and marks after it) and so many words, of up to 64 characters each, are remembered."""

    def __init__(self, path: str, limit: int = 200_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        vocab = spec["model"]["vocab"]
        self.ids = {raw(token): i for token, i in vocab.items()}
        self.strings = {i: b for b, i in self.ids.items()}
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault((vocab[left], vocab[right]), (rank, vocab[left + right]))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings |= {i: content.encode() for content, i in self.special.items()}
        self.single = [self.ids[bytes([b])] for b in range(256)]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.word = regex.compile(WORD)
        self.odd_space = re.compile(r"[^\S \n]")  # white space other than space and newline
        self.chunk = re.compile(r"[ \n]*[^ \n]+|[ \n]+")  # a token never goes on from other characters into white space
        self.known, self.words = Memo(self._chunk, limit), Memo(self._word, limit)

    def merge(self, word: bytes) -> list[int]:
        symbol = [self.single[b] for b in word]
        n, merges = len(symbol), self.merges
        if n < 2:
            return symbol
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(*found, k) for k in range(n - 1) if (found := merges.get((symbol[k], symbol[k + 1])))]
        heapq.heapify(queue)
        while queue:
            rank, whole, k = heapq.heappop(queue)
            right = after[k]
            if symbol[k] < 0 or right < 0 or merges.get((symbol[k], symbol[right])) != (rank, whole):
                continue  # stale
            symbol[k], symbol[right] = whole, -1
            after[k] = beyond = after[right]
            if beyond >= 0:
                before[beyond] = k
                if found := merges.get((whole, symbol[beyond])):
                    heapq.heappush(queue, (*found, k))
            if (left := before[k]) >= 0 and (found := merges.get((symbol[left], whole))):
                heapq.heappush(queue, (*found, left))
        return [s for s in symbol if s >= 0]

    def _chunk(self, chunk: str) -> bytes:
        if (chunk[1:] if chunk[0] == " " else chunk).isalpha():
            return self.words[chunk]  # one word by the pattern, which needn't be asked
        return b"".join(map(self.words.__getitem__, self.word.findall(chunk)))

    def _word(self, word: str) -> bytes:
        ids = self.merge(word.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def _plain(self, text: str) -> bytes:
        self.known.renew()
        self.words.renew()
        return b"".join(map(self.known.__getitem__, (self.word if self.odd_space.search(text) else self.chunk).findall(text)))

    def encode(self, text: str) -> np.ndarray:
        if self.at_special is None or not self.at_special.search(text):
            return np.frombuffer(self._plain(text), "<u4")
        parts = self.at_special.split(text)
        return np.frombuffer(b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts)), "<u4")

    def decode(self, ids) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def codec_of(path: str) -> BytePairCodec:
    return resident(path, lambda: BytePairCodec(path))


def encode(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>) of every whole text."""

    def run(batches):
        from lamina.llm.common import list_array

        codec = codec_of(vocabulary)
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), list_array([codec.encode(t).astype(np.int32) for t in texts_of(batch)], pa.int32())], ["doc_id", "ids"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of encode()'s rows. Null ids give an empty text."""

    def run(batches):
        codec = codec_of(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([codec.decode(ids or []) for ids in batch.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return own_columns(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, then decode from the ids alone."""

    def run(batches):
        codec = codec_of(vocabulary)
        decimal = {i: str(i) for i in codec.strings}
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                ids = codec.encode(text).tolist()
                rows.append((len(ids), hashlib.sha256(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()))
            n, of_ids, of_text = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
