"""Secret scans: fixed patterns, and guess costs of values in credential contexts.

The guess cost of a value is that of its cheapest segmentation into words, dates, repeats, keyboard
walks and brute-force spans, found by dynamic programming over end positions; costs are bits and add
up. Words are those that people put into passwords and the whole words of a tokenizer's vocabulary. A value
after a credential word that costs ``BITS`` or more is a secret, also where it is too short
or has characters beyond what the fixed patterns take. The patterns' spans always stay; the method's
are added where they reach beyond each of them.

Nulls: a null text is empty and has no spans. A null doc_id is kept; repeated rows are scanned each.
Empty tables give no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from lamina.llm.common import own_columns, texts_of

#: The base patterns with the least length of what counts.
ASSIGN = re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
KINDS = ("assign", "access", "hex", "guess")

CONTEXT = re.compile(r"(?i)(?<![a-z])(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|credentials?|auth(?:orization)?)[\"']?\x20*[:=]\x20*[\"']?([^\s\"'<>,;]{8,})", re.A)
BITS = 36.0
#: Words that people put into passwords, commonest first, and keyboard rows.
WORDS = "password admin welcome login qwerty letmein dragon monkey master hello freedom secret shadow summer winter spring autumn sunshine princess football baseball superman batman iloveyou test guest root user default changeme access trust ninja flower star love angel money cookie orange purple silver golden tiger lion eagle panda rabbit soccer hockey hunter ranger jordan michael charlie thomas robert daniel andrew joshua jessica jennifer ashley nicole pepper ginger cheese banana computer internet server system network database example sample demo temp private public none null true false value string your here token key".split()
ROWS = ("qwertyuiop", "asdfghjkl", "zxcvbnm", "1234567890", "qazwsxedcrfvtgbyhnujmik", "abcdefghijklmnopqrstuvwxyz")
_YEAR, _MONTH, _DAY, _MARK = "(?:19|20)\\d\\d", "(?:0[1-9]|1[0-2])", "(?:0[1-9]|[12]\\d|3[01])", "[-/.]?"
#: Dates with their bits: days of two centuries, or years.
DATES = [(re.compile(_YEAR + _MARK + _MONTH + _MARK + _DAY), 15.2), (re.compile(_DAY + _MARK + _MONTH + _MARK + _YEAR), 15.2), (re.compile(_YEAR), 6.7)]
_LONGEST = 20
_NEXT = {row[k : k + 2] for r in ROWS for row in (r, r[::-1]) for k in range(len(r) - 1)}
_LEET = str.maketrans("013457@$!", "oleastasi")


@lru_cache(maxsize=1)
def _ranks() -> dict[str, int]:
    """Word -> rank: WORDS, then the whole words of three letters or more in the vocabulary of the word tokenizer, commonest first. Plain words are priced by it."""
    import public_tokenizers

    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    found = {w: k + 1 for k, w in enumerate(WORDS)}
    for piece in sorted(vocabulary, key=vocabulary.get):
        word = piece.removesuffix("</w>")
        if word != piece and 3 <= len(word) <= _LONGEST and word.isascii() and word.isalpha():
            found.setdefault(word, len(found) + 1)
    return found


def _brute(c: str) -> float:
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


class _Run:
    """A stretch of repeats of ``step`` characters, or a walk (step 1): any part of it of ``least`` steps or more is a segment.

    A part of n steps costs ``bits`` and the length of n in binary. For each place the cheapest start with 2^b to 2^(b+1) - 1
    steps is a minimum over 2^b starts, kept as minima over powers of two that are extended place by place.
    """

    def __init__(self, start: int, end: int, step: int, least: int, bits: float):
        self.start, self.end, self.step, self.least, self.bits = start, end, step, least, bits
        self.minima = [[[] for _ in range(((end - start) // step).bit_length() + 1)] for _ in range(step)]

    def cheapest(self, place: int) -> float:
        n, rest = divmod(place - self.start, self.step)
        minima, out = self.minima[rest], math.inf
        for b in range(1, n.bit_length()):
            if b > 1 or self.least == 2:
                out = min(out, minima[b][n - (1 << b)] + b + 1)
            elif n >= 3:
                out = min(out, minima[0][n - 3] + b + 1)
        return out + self.bits

    def add(self, place: int, cost: float) -> None:
        n, rest = divmod(place - self.start, self.step)
        minima = self.minima[rest]
        minima[0].append(cost)
        for b in range(1, len(minima)):
            k = n - (1 << (b - 1))
            minima[b].append(min(minima[b - 1][n], minima[b - 1][k]) if k >= 0 else minima[b - 1][n])


def _runs(low: str) -> list[_Run]:
    """All repeats and walks, as long as they go."""
    out = []
    walk = math.log2(2 * sum(map(len, ROWS)))
    kinds = [(1, walk, lambda i: low[i : i + 2] in _NEXT), *((k, None, lambda i, k=k: low[i] == low[i + k]) for k in (1, 2, 3, 4))]
    for step, bits, goes_on in kinds:
        i = 0
        while i + step < len(low):
            if not goes_on(i):
                i += 1
                continue
            begin = i
            while i + step < len(low) and goes_on(i):
                i += 1
            least = 3 if step == 1 else 2
            if i + step - begin >= least * step:
                out.append(_Run(begin, i + step, step, least, 1 + (sum(map(_brute, low[begin : begin + step])) if bits is None else bits)))
    return out


def guess_bits(value: str, enough: float = math.inf) -> float:
    """log2 of the guesses that the cheapest segmentation takes, or infinity once none can be cheaper than ``enough``.

    Brute force costs a character's alphabet, and half a bit a letter where upper and lower case are mixed. Each other segment costs one
    bit for its kind; a word the log of its rank, two bits more with digits or signs for letters and one more with capitals; a date its
    bits; repeats and walks see _Run. Takes n log n steps.
    """
    n, ranks = len(value), _ranks()
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain = low.translate(_LEET)
    one_case = value.isupper() or value.islower()
    runs = sorted(_runs(low), key=lambda r: -r.start)
    best, live = [0.0] + [math.inf] * n, []
    for i in range(n + 1):
        while runs and runs[-1].start == i:
            live.append(runs.pop())
        live = [r for r in live if r.end >= i]
        for r in live:
            best[i] = min(best[i], r.cheapest(i))
        for r in live:
            r.add(i, best[i])
        if i == n:
            break
        # a segment that goes across this place begins within a word's length before it, or is part of a run
        if i % 32 == 31 and best[i] >= enough and min(best[max(0, i - _LONGEST) : i + 1]) >= enough and not any(r.start < i - _LONGEST for r in live):
            return math.inf
        best[i + 1] = min(best[i + 1], best[i] + _brute(value[i]) + (0.5 if value[i].isalpha() and not one_case else 0))
        here = best[i] + 1
        for j in range(i + 3, min(n, i + _LONGEST) + 1):
            capital = 1.0 if value[i:j] != low[i:j] else 0.0
            if low[i:j] in ranks:
                best[j] = min(best[j], here + math.log2(ranks[low[i:j]]) + capital)
            elif plain[i:j] in ranks:
                best[j] = min(best[j], here + math.log2(ranks[plain[i:j]]) + 2 + capital)
        for pattern, bits in DATES:
            if found := pattern.match(value, i):
                best[found.end()] = min(best[found.end()], here + bits)
    return best[n]


_HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth")


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted. Code points, end exclusive."""
    out = []
    low = text.lower()
    hinted = any(h in low for h in _HINTS)
    if hinted:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if hinted:
        base = sorted(out)
        for m in CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?)]}")
            a, b = m.start(1), m.start(1) + len(value)
            if len(value) >= 8 and not any(s <= a and b <= e for s, _, e in base) and guess_bits(value, BITS) >= BITS:
                out.append((a, 3, b))
    return sorted(out)


def joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)


def masked(text: str, mask: str = "[SECRET]") -> str:
    """The text with each stretch of spans that touch replaced by the mask."""
    out, at, end = [], 0, -1
    for a, _, b in spans(text):
        if a > end:
            if end >= 0:
                at = end
            out += [text[max(at, 0) : a], mask]
        end = max(end, b)
    return "".join(out) + text[max(end, 0) :]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_guess for every document."""

    def run(batches):
        for batch in batches:
            rows = []
            for text in texts_of(batch):
                found = spans(text)
                base = [s for s in found if s[1] < 3]
                n = [sum(k == s[1] for s in found) for k in range(4)]
                rows.append((*n[:3], hashlib.sha256(joined(base).encode()).hexdigest(), joined(found), n[3]))
            c = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *(pa.array(v, pa.string() if k in (3, 4) else pa.int64()) for k, v in enumerate(c))], names)

    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess"]
    return own_columns(docs, "doc_id", "text").mapInArrow(run, ", ".join(f"{n} {'string' if n in ('base_sha256', 'spans') else 'long'}" for n in names))
