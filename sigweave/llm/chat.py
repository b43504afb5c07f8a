r"""Chat formatting from event logs.

A log row is an event of one conversation: `message` (a whole turn), `delta` (text added to
the last turn, or to the turn it names), `edit` (a new text for the turn it names),
`regenerate` (drops the turn it names and all after it; its own text, if any, is the new
turn) and `delete`. Logs are partitioned by conversation and sorted by sequence within the
partition; a task then folds one conversation after another from the stream of its rows.

Template: `<s>`, then `[SYS] text [/SYS]` for a system turn, `[INST] text [/INST]` for a user
turn, `text</s>` for an assistant turn, and `[TURN role] text [/TURN]` for any other role.
The loss mask holds the assistant texts. A control string inside a text gets a backslash
after its first letter, one that has backslashes there gets one more; reading takes one away.

Null texts are empty, null roles are the empty role, events of no known kind are messages.
Rows without a conversation id form one conversation. Rows that tie in sequence are taken
in the order of role and text; rows that repeat are turns of their own. Events that name
no turn of the conversation change nothing. A conversation without turns gives `<s>`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import storage

#: Control strings of the template, without their first letter.
_CONTROL = r"/?s>|/?SYS\]|/?INST\]|/?TURN[ \]]"
_ESCAPE = re.compile(rf"([<\[])(\\*)({_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)({_CONTROL})")
OPEN = {"system": ("[SYS] ", " [/SYS]"), "user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")}


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\\3", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def _quoted(role: str) -> str:
    """A role as one word without `]`."""
    return "".join(c if c.isalnum() or c in "_-" else f"%{ord(c):x};" for c in role)


def _unquoted(word: str) -> str:
    return re.sub(r"%([0-9a-f]+);", lambda m: chr(int(m[1], 16)), word)


def render(turns: Iterable[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and the spans (code points) of the loss mask."""
    out, size, spans = ["<s>"], 3, []
    for role, text in turns:
        before, after = OPEN.get(role) or (f"[TURN {_quoted(role)}] ", " [/TURN]")
        text = escape(text)
        if role == "assistant":
            spans.append((size, size + len(text)))
        out += [before, text, after]
        size += len(before) + len(text) + len(after)
    return "".join(out), spans


_START = re.compile(r"\[(SYS|INST)\] |\[TURN ([^\]]*)\] ")


def read(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    at, turns = 3, []
    if not formatted.startswith("<s>"):
        raise ValueError("no beginning")
    while at < len(formatted):
        m = _START.match(formatted, at)
        if m:
            role = {"SYS": "system", "INST": "user"}.get(m[1]) or _unquoted(m[2])
            close = f" [/{m[1] or 'TURN'}]"
            at = m.end()
        else:
            role, close = "assistant", "</s>"
        end = formatted.index(close, at)
        turns.append((role, unescape(formatted[at:end])))
        at = end + len(close)
    return turns


def fold(events: Iterable[tuple[str | None, int | None, str | None, str | None]]) -> Iterator[tuple[str, str]]:
    """Final (role, text) turns from (kind, turn, role, text) events in order; a message's turn number names it."""
    turns: list[list] = []  # [name, role, parts of text]
    place: dict = {}

    def add(name, role, text):
        turns.append([name, role or "", [text or ""]])
        if name is not None:
            place[name] = len(turns) - 1

    for kind, name, role, text in events:
        at = place.get(name) if name is not None else len(turns) - 1 if turns else None
        if at is not None and turns[at] is None:
            at = None
        if kind == "delta":
            if at is not None:
                turns[at][2].append(text or "")
            elif name is not None and name not in place:
                add(name, role, text)
        elif kind == "edit":
            if at is not None:
                turns[at][2] = [text or ""]
        elif kind == "regenerate":
            if at is not None:
                old = turns[at][1]
                for t in turns[at:]:
                    if t is not None:
                        place.pop(t[0], None)
                del turns[at:]
                add(name, role or old, text)
        elif kind == "delete":
            if at is not None:
                turns[at] = None
        else:
            add(name, role, text)
    return ((t[1], "".join(t[2])) for t in turns if t is not None)


def format_logs(events: DataFrame, *, conv_col: str = "conv_id", seq_col: str = "turn", role_col: str = "role", text_col: str = "text", kind_col: str | None = None, target_col: str | None = None) -> DataFrame:
    """(conv_col, formatted, loss_spans), one row a conversation.

    kind_col: the kind of event (absent: all are messages); target_col: the turn an event names.
    """
    conv = events.schema[conv_col].dataType
    rows = events.select(
        F.col(conv_col).alias("_conv"), F.col(seq_col).alias("_seq"), F.col(role_col).alias("_role"), F.col(text_col).alias("_text"),
        (F.col(kind_col) if kind_col else F.lit(None).cast("string")).alias("_kind"), (F.col(target_col).cast("long") if target_col else F.lit(None).cast("long")).alias("_target"),
    )
    rows = rows.repartition(max(storage.n_partitions(events.sparkSession), 1), "_conv").sortWithinPartitions("_conv", "_seq", "_role", "_text")
    out = T.StructType([T.StructField(conv_col, conv), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])
    schema, kind = storage.arrow_type(out), storage.arrow_type(conv)

    def run(batches):
        done, now, log = [], None, []

        def finish():
            text, spans = render(fold(log))
            done.append({conv_col: now, "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})

        for b in batches:
            for i, role, text, k, target in zip(b.column(0).cast(kind).to_pylist(), *(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True):
                if log and i != now:
                    finish()
                    log = []
                    if len(done) >= 2000 or sum(len(x["formatted"]) for x in done[-50:]) > 1 << 22:
                        yield pa.RecordBatch.from_struct_array(pa.array(done, schema))
                        done.clear()
                now = i
                log.append((k, target, role, text))
        if log:
            finish()
        if done:
            yield pa.RecordBatch.from_struct_array(pa.array(done, schema))

    return rows.mapInArrow(run, out)


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts say when they are read back: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    places = [formatted.columns.index(c) for c in ("formatted", "loss_spans")]

    def start():
        def run(b: pa.RecordBatch) -> list:
            cols: list[list] = [[], [], [], [], []]
            for text, spans in zip(*(b.column(p).to_pylist() for p in places), strict=True):
                turns = read(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                for c, x in zip(cols, (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)), strict=True):
                    c.append(x)
            return cols

        return run

    return storage.map_columns(formatted, [("n_turns", T.LongType()), ("turns_sha256", T.StringType()), ("loss_chars", T.LongType()), ("loss_sha256", T.StringType()), ("formatted_chars", T.LongType())], start, keep=[c for c in formatted.columns if c not in ("formatted", "loss_spans")])
