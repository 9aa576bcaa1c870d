"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a
conversation are rendered; where the next output begins with the one before, the rest is the new
turn's span. A template whose next output does not is one that rewrites history, and is reported.
By default all prefixes are whole, so that templates may depend on anything before a turn; a
conversation of n turns then costs n renderings and is held in its task.

A template may instead be declared local: a turn's span depends on the turn and on at most ``looks_back``
turns before it. Then prefixes begin so many turns earlier, and memory and time a turn are bounded
whatever the conversation's length. The declaration is checked before anything is formatted: a probe
conversation of ``PROBE`` turns is rendered by all its whole prefixes and must give the same spans.

Nulls: null texts and roles are empty; turns are ordered by (turn, role, text), null turns first, so
repeated rows and ties have one order. conv_id may be null. Empty tables give no rows. Other columns
are ignored. Roles and texts of any length are escaped and restored exactly.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lamina.llm.common import own_columns

Turn = tuple[str, str]

#: The template's control strings.
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
ASSISTANT = "assistant"


def escape(text: str) -> str:
    """Double each backslash, and put one after the first character of each control string, which so is none any more."""
    return _CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def template(turns: list[Turn]) -> str:
    return "".join(f"<s>[INST]{escape(role)}[/INST]{escape(text)}</s>" for role, text in turns)


def parse(formatted: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn of the template's output; the span is that of the escaped text."""
    return [(unescape(m[1]), unescape(m[2]), m.start(2), m.end(2)) for m in _TURN.finditer(formatted)]


def loss_mask(role: str, output: str) -> tuple[int, int] | None:
    """The place of the escaped text in what an assistant's turn adds to this template's output."""
    return parse(output)[0][2:] if role == ASSISTANT else None


class RewritesHistory(ValueError):
    """The rendering of a longer prefix does not begin with that of the shorter one."""


class NotLocal(ValueError):
    """A template declared local depends on more than the turns it may look back to."""


def deltas(turns: Iterable[Turn], render: Callable[[list[Turn]], str] = template, looks_back: int | None = None) -> Iterator[str]:
    """What each turn adds to the output. looks_back: None for a black box, whose prefixes are rendered whole."""
    context: list[Turn] = []
    rendered = render([])
    for k, turn in enumerate(turns):
        if looks_back is not None and len(context) > looks_back:
            context = context[len(context) - looks_back :]
            rendered = render(context)
        context.append(turn)
        longer = render(context)
        if not longer.startswith(rendered):
            raise RewritesHistory(f"turn {k} changes what was rendered before")
        yield longer[len(rendered) :]
        rendered = longer


def rewrites_history(render: Callable[[list[Turn]], str], turns: list[Turn]) -> bool:
    try:
        for _ in deltas(turns, render):
            pass
    except RewritesHistory:
        return True
    return False


PROBE = 300


def check_local(render: Callable[[list[Turn]], str], looks_back: int) -> None:
    """Raise NotLocal unless windows give the spans of whole prefixes on a conversation of PROBE turns of several roles."""
    roles = ("system", "user", ASSISTANT, "tool", "user", ASSISTANT, ASSISTANT, "")
    turns = [(roles[k % len(roles)] if k else "system", f"turn {k}" if k % 11 else "") for k in range(PROBE)]
    if list(deltas(turns, render)) != list(deltas(turns, render, looks_back)):
        raise NotLocal(f"the template looks back further than {looks_back} turns")


def _ordered(conversations: DataFrame) -> DataFrame:
    """Conversations side by side with their turns in order, streamed: no group is ever gathered."""
    rows = own_columns(conversations, "conv_id", "turn", "role", "text")
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text")]
    return rows.repartition("conv_id").sortWithinPartitions(*keys)


def formatted(conversations: DataFrame, render: Callable[[list[Turn]], str] = template, looks_back: int | None = None, mask: Callable[[str, str], tuple[int, int] | None] = loss_mask) -> DataFrame:
    """One row a turn: conv_id, ordinal, role, output (what the turn adds), start (in the conversation's output), loss_start and loss_end (the loss mask within ``output``; null where there is none).

    mask: from a turn's role and output to the part that counts as loss. A template that rewrites history fails the job.
    """
    if looks_back is not None:
        check_local(render, looks_back)

    def run(batches):
        def rows():
            for b in batches:
                yield from zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text")))

        stream, ahead = rows(), []
        first = next(stream, None)
        pending = [first] if first else []
        out: list[tuple] = []
        while pending:
            conv = pending[0][0]

            def turns(conv=conv):
                yield (pending[0][1] or "", pending.pop()[2] or "")
                for c, role, text in stream:
                    if c != conv:
                        ahead.append((c, role, text))
                        return
                    latest[0] = role or ""
                    yield role or "", text or ""

            latest, at = [pending[0][1] or ""], 0
            for k, added in enumerate(deltas(turns(), render, looks_back)):
                role = latest[0]
                out.append((conv, k, role, added, at, *(mask(role, added) or (None, None))))
                at += len(added)
                if len(out) >= 2000:
                    yield _batch(out)
                    out = []
            pending, ahead = ahead, []
        if out:
            yield _batch(out)

    return _ordered(conversations).mapInArrow(run, "conv_id long, ordinal long, role string, output string, start long, loss_start int, loss_end int")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    c = list(zip(*rows))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, kinds)], ["conv_id", "ordinal", "role", "output", "start", "loss_start", "loss_end"])


def read_back(rows: DataFrame) -> DataFrame:
    """One row a conversation, from formatted()'s output and masks alone, streamed in the order they were written."""
    ordered = rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "ordinal")

    def run(batches):
        now, out, state = None, [], None
        for b in batches:
            for conv, _, _, output, _, a, z in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                if state is None or conv != now:
                    if state:
                        out.append(finish(now, state))
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse(output):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    text = unescape(output[a:z])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(output)
            if len(out) > 2000:
                yield batch(out)
                out = []
        if state:
            out.append(finish(now, state))
        if out:
            yield batch(out)

    def finish(conv, s):
        return conv, s[0], s[1].hexdigest(), s[2], s[3].hexdigest(), s[4]

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, pa.string() if "sha" in n else pa.int64()) for n, x in zip(names, zip(*rows))], names)

    return ordered.mapInArrow(run, ", ".join(f"{n} {'string' if 'sha' in n else 'long'}" for n in names))
