"""Chat formatting from an event log.

A conversation is a log of events, ordered by sequence number and folded into
final messages:

``message``    opens a message with a role and a text
``delta``      appends a streamed piece of text to the last message, or to ``target``
``edit``       replaces the text of message ``target`` (the last by default)
``regenerate`` replaces the last message of the role and drops what follows it
``delete``     removes message ``target`` (the last by default)

The messages are then rendered. Control strings inside texts get a backslash
after their first character and backslashes are doubled, which
:func:`unescape` undoes, so a text can never open or close a turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
#: Strings that chat templates in common use give a meaning.
CONTROL = (OPEN, CLOSE, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + "\n", re.S)


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def _role(role: str) -> str:
    """A role on one line; a line break becomes the escape ``\\n``, and is read back by :func:`_unrole`."""
    return escape(role).replace("\n", "\\n")


def _unrole(role: str) -> str:
    return re.sub(r"\\(\\|n)?", lambda m: {"n": "\n", "\\": "\\"}.get(m[1], ""), role)


def _last(messages: list, role: str | None = None) -> int | None:
    """The place of the last message there is, of a role if one is given."""
    return next((i for i in range(len(messages) - 1, -1, -1) if messages[i] is not None and role in (None, messages[i][0])), None)


def fold(events) -> list[tuple[str, str]]:
    """Final (role, text) messages of events (op, target, role, text) in order. Unknown ops and targets change nothing."""
    out: list[list | None] = []
    for op, target, role, text in events:
        role, text = role or "", text or ""
        if op == "message":
            out.append([role, [text]])
            continue
        at = target if target is not None else _last(out, role if op == "regenerate" else None)
        known = at is not None and 0 <= at < len(out) and out[at] is not None
        if op == "regenerate":
            if known:
                del out[at:]
            out.append([role, [text]])
        elif op == "delta" and known:
            out[at][1].append(text)
        elif op == "edit" and known:
            out[at][1] = [text]
        elif op == "delete" and known:
            out[at] = None
    return [(m[0], "".join(m[1])) for m in out if m is not None]


def render(messages, learn: str = "assistant") -> tuple[str, list[tuple[int, int]]]:
    """The formatted text and the (start, end) spans of it that a loss is taken on."""
    parts, spans, n = [], [], 0
    for role, text in messages:
        head, body = f"{OPEN}{_role(role)}\n", escape(text)
        if role == learn:
            spans.append((n + len(head), n + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        n += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(_unrole(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def format_events(events: DataFrame, conv: str = "conv_id", learn: str = "assistant") -> DataFrame:
    """One row per conversation: conv, formatted, loss_starts, loss_ends, n_turns.

    ``events`` has ``conv``, seq, op, target (index of a message, or null), role
    and text. Events of one sequence number are ordered by op, target, role and
    text, so repeated rows and ties have one outcome. Null roles and texts are
    empty; a null conversation id is a conversation of its own. A conversation
    is one row of the result, so its log is gathered in one task, as long as the
    result itself; no other grouping happens.
    """
    log = events.select(F.col(conv), F.struct(*[F.col(c) for c in ("seq", "op", "target", "role", "text")]).alias("__e")).groupBy(conv).agg(F.sort_array(F.collect_list("__e")).alias("__log"))
    kind = events.schema[conv].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for who, es in zip(b[conv], b["__log"], strict=True):
                messages = fold((e["op"], None if pd.isna(e["target"]) else int(e["target"]), e["role"], e["text"]) for e in es)
                text, spans = render(messages, learn)
                rows.append((None if pd.isna(who) else who, text, [s for s, _ in spans], [e for _, e in spans], len(messages)))
            out = pd.DataFrame(rows, columns=[conv, "formatted", "loss_starts", "loss_ends", "n_turns"])
            out[conv] = pd.array(out[conv].tolist(), dtype="Int64") if kind in ("bigint", "int") else out[conv]
            yield out

    return log.mapInPandas(run, f"`{conv}` {kind}, formatted string, loss_starts array<int>, loss_ends array<int>, n_turns long")


#: What is streamed first where a message is then edited or regenerated.
DRAFT = "one moment ..."


def as_events(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", learn: str = "assistant") -> DataFrame:
    """The log (conv, seq, op, target, role, text) of a streamed session that ends in the messages of ``rows`` (conv, turn, role, text).

    A message of the role ``learn`` opens with a draft, is regenerated, and comes
    in two deltas; others open with a draft, are edited to the first half of
    their text, and get the other half as a delta. Rows of one turn are ordered
    by role and text. Null texts are empty.
    """
    text, role = F.coalesce(F.col("text"), F.lit("")), F.coalesce(F.col("role"), F.lit(""))
    half = F.floor(F.length("__x") / 2).cast("int")
    first, rest = F.col("__x").substr(F.lit(1), half), F.col("__x").substr(half + 1, F.length("__x"))
    event = lambda step, op, role, text: F.struct(F.lit(step).alias("step"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))
    none, draft, own = F.lit(None).cast("string"), F.lit(DRAFT), F.col("__r")
    streamed = F.array(event(0, "message", own, draft), event(1, "regenerate", own, F.lit("")), event(2, "delta", none, first), event(3, "delta", none, rest))
    edited = F.array(event(0, "message", own, draft), event(1, "edit", none, first), event(2, "delta", none, rest))
    place = F.row_number().over(Window.partitionBy(conv).orderBy(turn, "__r", "__x"))
    placed = rows.select(conv, turn, role.alias("__r"), text.alias("__x")).withColumn("__n", place.cast("long"))
    logs = placed.select(conv, "__n", F.explode(F.when(own == learn, streamed).otherwise(edited)).alias("e"))
    return logs.select(conv, (F.col("__n") * 4 + F.col("e.step")).alias("seq"), "e.op", F.lit(None).cast("int").alias("target"), "e.role", "e.text")


def digest(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Read the formatted texts back: conv, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, starts, ends in zip(b.formatted, b.loss_starts, b.loss_ends, strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s:e]) for s, e in zip(starts, ends, strict=True))
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text)))
            yield pd.concat([b[[conv]].reset_index(drop=True), pd.DataFrame(rows, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])], axis=1)

    kind = formatted.schema[conv].dataType.simpleString()
    return formatted.select(conv, "formatted", "loss_starts", "loss_ends").mapInPandas(run, f"`{conv}` {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
