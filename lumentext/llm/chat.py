"""Chat formatting with a grammar round trip.

conversation := turn*; turn := <|im_start|> role newline text <|im_end|> newline. A deterministic parser reads each rendered
turn again; where what it recovers differs from the source, or a start or end stands inside a role or text, the conflicting
part is escaped (a backslash more inside each control string) and read again, until both are identical. The loss mask covers the text of the assistant's turns.

Defined results: null role and null text are empty; turns with equal numbers come in the order of role and text; rows
repeat if they repeat in the input; a null conv_id is a conversation of its own; an empty table gives an empty result;
other columns are not read. A conversation is read as a stream in the order of its turns: its length doesn't matter.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END, BREAK = "<|im_start|>", "<|im_end|>", "<|im_nl|>"
_CONTROL = re.compile(r"<(\\*)\|im_(start|end|nl)\|>")
_ESCAPED = re.compile(r"<\\(\\*)\|im_(start|end|nl)\|>")
_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.DOTALL)


def escape(text: str) -> str:
    return _CONTROL.sub(r"<\1\\|im_\2|>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|im_\2|>", text)


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start, end) of each turn, the text's place in the rendered form; ValueError if the grammar doesn't hold."""
    out, at = [], 0
    while at < len(text):
        m = _TURN.match(text, at)
        if not m or any(x in part for x in (START, END) for part in m.groups()):
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1].replace(BREAK, "\n")), unescape(m[2]), *m.span(2)))
        at = m.end()
    return out


def loss_mask(turns: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """The parts of a rendered form that a model learns from: the texts of the assistant's turns. turns: role and place of each text."""
    return [(start, end) for role, start, end in turns if role == "assistant"]


def _holds(shown: str, role: str, text: str) -> bool:
    try:
        return [x[:2] for x in parse(shown)] == [(role, text)]
    except ValueError:
        return False


def render(role: str, text: str) -> str:
    """One turn; its parts are escaped only where the parser would not give them back."""
    for a, b in ((role, text), (role, escape(text)), (escape(role).replace("\n", BREAK), escape(text))):
        if _holds(shown := f"{START}{a}\n{b}{END}\n", role, text):
            return shown
    raise AssertionError("the escaped form can always be read back")


def rendered(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, formatted: each turn rendered where it lies, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shown = [render(r, t) for r, t in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shown, pa.string())], names=["conv_id", "turn", "role", "text", "formatted"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), empty("role"), empty("text"))
    return rows.mapInArrow(run, "conv_id long, turn long, role string, text string, formatted string")


def read_back(turns: DataFrame) -> DataFrame:
    """Digests of each conversation from its rendered turns alone, parsed in order as a stream."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, some = None, None, False
        row = lambda: [key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]
        for b in batches:
            out = []
            for conv, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not some or conv != key:
                    if some:
                        out.append(row())
                    key, state, some = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0], True
                for role, said, start, end in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                    for a, z in loss_mask([(role, start, end)]):
                        masked = unescape(text[a:z])
                        state[2] += len(masked)
                        state[3].update(masked.encode())
                state[4] += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=names)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row(), types, strict=True)], names=names)

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "formatted")
    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
