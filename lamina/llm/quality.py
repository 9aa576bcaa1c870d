"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Viterbi decoding finds the best label sequence of a document's lines; the share of words in content
lines decides whether the document stays. The field is trained here, on at most ``SAMPLE`` labelled
documents, of which at most ``SAMPLE_LINES`` lines each are used: the lines of documents of quality 1
count as content, those of quality 0 as boilerplate. Which documents are in the sample depends on
the hash of their ids alone. Scoring always uses all lines of whole texts.

Nulls: a null text has no words and fails the base rules. A label that is null, or that several
labels of one doc_id disagree on, takes no part. Without labels of both kinds the field has weights
of zero, for which ties count as content, so only the base rules reject. Empty tables give no rows.
Repeated rows are judged alike.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import by_place, own_columns, texts_of

SAMPLE, SAMPLE_LINES, SEED = 2000, 60, 7
#: Fixed values of the base rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, REPEAT_PERCENT, WINDOW = 50, 50, 3
KEEP_SHARE = 0.5

_UPPER, _DIGITS, _LOWER, _MARKS = bytes(range(65, 91)), bytes(range(48, 58)), bytes(range(97, 123)), bytes(c for c in range(33, 127) if not chr(c).isalnum())
_LINK = re.compile(rb"https?://|www\.|@|\.com\b")
N_FEATURES = 10


def line_features(line: bytes, words: list[bytes], repeated: bool) -> list[float]:
    """Shares between 0 and 1."""
    n, size = len(words), len(line)
    left = lambda out: size - len(line.translate(None, out))
    upper, lower = left(_UPPER), left(_LOWER)
    return [
        1.0,
        min(1.0, left(SYMBOLS) / n),
        upper / max(1, upper + lower),
        left(_DIGITS) / size,
        min(1.0, left(_MARKS) / (2 * n)),
        1 - len(set(words)) / n if n > 5 else 0.0,
        float(n < 4),
        float(repeated),
        float(bool(_LINK.search(line))),
        float(line.rstrip()[-1:] in b".!?"),
    ]


def lines_of(text: bytes) -> list[tuple[bytes, list[bytes]]]:
    return [(line, words) for line in text.split(b"\n") if (words := line.split())]


def features(text: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Each line's features and number of words, and how many lines equal an earlier one."""
    lines, seen, rows, doubled = lines_of(text), set(), [], 0
    for line, words in lines:
        again = line in seen
        doubled += again
        seen.add(line)
        rows.append(line_features(line, words, again))
    return np.array(rows, np.float64).reshape(-1, N_FEATURES), np.array([len(w) for _, w in lines], np.int64), doubled


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in some window of so many words that occurs twice or more."""
    m = len(words) - window + 1
    if m < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    code = ids[:m]
    for k in range(1, window):
        _, code = np.unique(code * len(number) + ids[k : k + m], return_inverse=True)
    twice = np.bincount(code)[code] > 1
    covered = np.zeros(len(words), bool)
    for k in range(window):
        covered[k : k + m] |= twice
    return int(covered.sum())


class LineField:
    """Two labels: 0 content, 1 boilerplate. Scores: line features times ``emit``, plus ``move`` between neighbours."""

    def __init__(self, emit: np.ndarray | None = None, move: np.ndarray | None = None):
        self.emit = np.zeros((N_FEATURES, 2)) if emit is None else emit
        self.move = np.zeros((2, 2)) if move is None else move

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.zeros(0, np.int64)
        (m00, m01), (m10, m11) = self.move.tolist()
        scores = (x @ self.emit).tolist()
        a, b = scores[0]
        back = []
        for s0, s1 in scores[1:]:
            to0, to1 = b + m10 > a + m00, b + m11 > a + m01  # ties: content
            back.append((to0, to1))
            a, b = (b + m10 if to0 else a + m00) + s0, (b + m11 if to1 else a + m01) + s1
        label = int(b > a)
        out = [label]
        for step in reversed(back):
            label = int(step[label])
            out.append(label)
        return np.array(out[::-1], np.int64)

    @classmethod
    def trained(cls, lines: list[np.ndarray], labels: list[int], rounds: int = 150, rate: float = 0.2, decay: float = 1e-3) -> LineField:
        """Gradient ascent (Adam) on the conditional log likelihood, by forward-backward over all documents at once."""
        if len(set(labels)) < 2:
            return cls()
        most = max(map(len, lines))
        x = np.zeros((len(lines), most, N_FEATURES))
        there = np.zeros((len(lines), most), bool)
        for k, rows in enumerate(lines):
            x[k, : len(rows)], there[k, : len(rows)] = rows, True
        y = np.eye(2)[np.array(labels)][:, None, :] * there[:, :, None]
        pairs = there[:, 1:]
        weight = np.where(np.array(labels) == 1, 0.5 / max(1, sum(labels)), 0.5 / (len(labels) - sum(labels)))[:, None] / np.maximum(1, there.sum(1))[:, None]
        field, first, second = cls(), [0.0, 0.0], [0.0, 0.0]
        seen_moves = np.einsum("nta,ntb,nt->ab", y[:, :-1], y[:, 1:], pairs * weight)
        for t in range(1, rounds + 1):
            s = x @ field.emit
            ahead, behind = np.zeros_like(s), np.zeros_like(s)
            ahead[:, 0] = s[:, 0]
            for k in range(1, most):
                step = np.logaddexp.reduce(ahead[:, k - 1, :, None] + field.move[None], axis=1) + s[:, k]
                ahead[:, k] = np.where(there[:, k, None], step, ahead[:, k - 1])
            for k in range(most - 2, -1, -1):
                step = np.logaddexp.reduce(field.move[None] + (s[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
                behind[:, k] = np.where(there[:, k + 1, None], step, 0)
            total = np.logaddexp.reduce(ahead[:, -1], axis=1)
            p = np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
            q = np.exp(ahead[:, :-1, :, None] + field.move[None, None] + (s[:, 1:] + behind[:, 1:])[:, :, None, :] - total[:, None, None, None]) * pairs[:, :, None, None]
            grads = [np.einsum("ntf,nta,nt->fa", x, y - p, weight * there) - decay * field.emit, seen_moves - np.einsum("ntab,nt->ab", q, weight * np.ones_like(pairs)) - decay * field.move]
            for k, (g, name) in enumerate(zip(grads, ("emit", "move"))):
                first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g * g
                setattr(field, name, getattr(field, name) + rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.99**t)) + 1e-8))
        return field


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> LineField:
    """At most ``sample`` documents' line features come to the driver: lines * sample * 10 doubles, under 10 MB."""
    agreed = own_columns(labels, "doc_id", "quality").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("most")).filter("quality = most and quality in (0, 1)")
    # as many of either kind; ordered by hash, so that the choice doesn't depend on the table's order
    halves = [agreed.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(sample // 2) for q in (0, 1)]
    chosen = halves[0].unionByName(halves[1]).select("doc_id", F.col("quality").cast("int").alias("quality"))

    def run(batches):
        for batch in batches:
            found = [(q, features(t.encode())[0][:lines]) for q, t in zip(batch.column("quality").to_pylist(), texts_of(batch))]
            yield pa.RecordBatch.from_arrays([pa.array([q for q, _ in found], pa.int32()), pa.array([f.ravel().tolist() for _, f in found], pa.list_(pa.float64()))], ["quality", "x"])

    rows = own_columns(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text").mapInArrow(run, "quality int, x array<double>").filter("size(x) > 0")
    # repeated rows of one doc_id may make more than ``sample``; a limit keeps the bound
    rows = sorted(((r.quality, r.x) for r in rows.limit(2 * sample).collect()))
    return LineField.trained([np.array(x).reshape(-1, N_FEATURES) for _, x in rows], [1 - q for q, _ in rows])


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "content_share": "double"}


def judge(text: str, field: LineField) -> tuple:
    data = text.encode()
    words = data.split()
    x, n, doubled = features(data)
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > REPEAT_PERCENT * len(words)
    share = float(n[field.viterbi(x) == 0].sum() / n.sum()) if len(n) else 0.0
    chars = len(text) - (len(data) - len(data.translate(None, b" \t\n\r\x0b\x0c")))
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), doubled, repeat, failed, not failed and share >= KEEP_SHARE, share


def judged(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id, then COLUMNS, of every document."""
    emit, move = field.emit, field.move

    def run(batches):
        own = LineField(emit, move)
        for batch in batches:
            out = list(zip(*(judge(t, own) for t in texts_of(batch)))) or [()] * len(COLUMNS)
            kinds = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, kinds[k]) for v, k in zip(out, COLUMNS.values()))], ["doc_id", *COLUMNS])

    return own_columns(docs, "doc_id", "text").mapInArrow(run, ", ".join(["doc_id long", *(f"{n} {k}" for n, k in COLUMNS.items())]))


def kept(docs: DataFrame, field: LineField) -> DataFrame:
    """The documents that the rules and the field keep, with all their columns, whatever those are called.

    A null text fails the base rules and goes; a null doc_id is judged by its text alone; repeated rows stay or go together.
    """
    emit, move, names = field.emit, field.move, docs.columns
    text = f"c{names.index('text')}"

    def run(batches):
        own = LineField(emit, move)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array([judge(t, own)[6] for t in texts_of(batch, text)], pa.bool_()))

    return by_place(docs).mapInArrow(run, ", ".join(f"`{n}` {k}" for n, k in docs.dtypes))
