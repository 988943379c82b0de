"""Chat formatting with a grammar round trip.

Grammar of a formatted conversation: a sequence of turns ``OPEN SP content SP CLOSE``, with the marks of the role
(other roles than the three known ones: ``<|role: NAME|>`` and ``<|end|>``). In content, a backslash before a mark or a
backslash makes it plain text. Each turn is first rendered as it is, reparsed with the parser, and compared with its
source; if they differ, its content is escaped and the turn is rendered again, until both are identical.

A conversation's text is that of its rows in order of turn (ties: role, text; null turns first). Turns are formatted
where they are read; only then are they brought together, sorted, and read as a stream, so a conversation of any
length takes no more memory than a batch. Null texts and roles count as empty; a null conversation id is one
conversation. The loss mask is kept as spans of the formatted text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the roles' turns, fixed by the format.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
_PLAIN = "|".join(re.escape(m) for pair in MARKS.values() for m in pair)
_MARK = rf"{_PLAIN}|<\|role: |\|>|<\|end\|>"
_TOKEN = re.compile(rf"\\(?:{_MARK}|\\)|{_MARK}")
_CONFLICT = re.compile(rf"\\|{_MARK}")
_ESCAPED = re.compile(rf"\\({_MARK}|\\)")
_OPENS = {o: (role, c) for role, (o, c) in MARKS.items()}


def escape(text: str) -> str:
    return _CONFLICT.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str, escaped: bool) -> tuple[str, int, int]:
    """The turn's text, and where its content starts and ends there."""
    if role in MARKS:
        opening, closing = MARKS[role]
    else:
        opening, closing = f"<|role: {escape(role)}|>", "<|end|>"
    content = escape(text) if escaped else text
    return f"{opening} {content} {closing}", len(opening) + 1, len(opening) + 1 + len(content)


def parse(formatted: str) -> list[tuple[str, str]] | None:
    """(role, text) of each turn, or None if the text is not in the grammar."""
    turns, at = [], 0
    tokens = ((m.group(), m.start(), m.end()) for m in _TOKEN.finditer(formatted) if m.group()[0] != "\\")
    for mark, start, end in tokens:
        if start != at:
            return None
        if mark in _OPENS:
            role, closing = _OPENS[mark]
        elif mark == "<|role: ":
            bar = next(tokens, None)
            if bar is None or bar[0] != "|>":
                return None
            role, closing, end = unescape(formatted[end : bar[1]]), "<|end|>", bar[2]
        else:
            return None
        stop = next(tokens, None)
        if stop is None or stop[0] != closing or stop[1] - end < 2 or formatted[end] != " " or formatted[stop[1] - 1] != " ":
            return None
        turns.append((role, unescape(formatted[end + 1 : stop[1] - 1])))
        at = stop[2]
    return turns if at == len(formatted) else None


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    for escaped in (False, True):
        out = render(role, text, escaped)
        if parse(out[0]) == [(role, text)]:
            return out
    raise ValueError(f"a turn of role {role!r} does not survive the round trip")


def format_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a turn: conversation, turn, ``role``, ``text`` as read, ``formatted``, ``loss_start``, ``loss_end``.

    The loss span is that of an assistant's content in ``formatted``, null for other roles.
    """
    kinds = [turns.schema[c].dataType.simpleString() for c in (conv_col, turn_col)]
    names = [conv_col, turn_col, "role", "text", "formatted", "loss_start", "loss_end"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = [r or "" for r in batch.column(2).to_pylist()]
            texts = [t or "" for t in batch.column(3).to_pylist()]
            out = [format_turn(r, t) for r, t in zip(roles, texts, strict=True)]
            spans = [(a, b) if r == "assistant" else (None, None) for r, (_, a, b) in zip(roles, out, strict=True)]
            columns = [pa.array(roles, pa.string()), pa.array(texts, pa.string()), pa.array([o[0] for o in out], pa.string()), pa.array([a for a, _ in spans], pa.int64()), pa.array([b for _, b in spans], pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], names=names)

    return turns.select(conv_col, turn_col, role_col, text_col).mapInArrow(run, f"`{conv_col}` {kinds[0]}, `{turn_col}` {kinds[1]}, role string, text string, formatted string, loss_start long, loss_end long")


def read_back(formatted: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation, parsed from ``formatted`` alone: ``n_turns``, digests of turns and loss text, sizes."""
    kind = formatted.schema[conv_col].dataType.simpleString()
    ordered = formatted.select(conv_col, turn_col, "role", "text", "formatted", "loss_start", "loss_end").repartition(F.col(conv_col)).sortWithinPartitions(conv_col, turn_col, "role", "text")
    ordered = ordered.select(conv_col, "formatted", "loss_start", "loss_end")
    names = [conv_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, done = None, None, []

        def close() -> None:
            if state is not None:
                done.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def give() -> pa.RecordBatch:
            own = list(zip(*done, strict=True)) if done else [[]] * 6
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(own, types, strict=True)], names=names)
            done.clear()
            return out

        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for conv, text, start, end in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if state is None or conv != now:
                    close()
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, content in parse(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{content}\n".encode())
                if start is not None:
                    loss = unescape(text[start:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(text)
            if done:
                yield give()
        close()
        if done:
            yield give()

    return ordered.mapInArrow(run, f"`{conv_col}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
