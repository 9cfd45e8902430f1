"""Chat formatting with turn spans found by rendering prefixes."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Turn = tuple[str, str]
Template = Callable[[list[Turn]], str]

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: str) -> str:
    """Backslashes are doubled and ``<|`` becomes ``<\\|``, so no text holds a control string."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def marked_turns(turns: list[Turn]) -> str:
    """Each turn between control strings, its role on the first line."""
    return "".join(f"{START}{escape(role).replace(chr(10), chr(92) + 'n')}\n{escape(text)}{END}\n" for role, text in turns)


@dataclass
class Rendered:
    """spans: of each turn in ``text``; content: of its (escaped) content; rewrites: turns at which earlier output changed."""

    text: str
    spans: list[tuple[int, int]]
    content: list[tuple[int, int]]
    rewrites: list[int]


def _shared(a: str, b: str) -> int:
    """How many characters two texts have in common at their beginning, by halving: slices are compared, not characters."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def render_incrementally(turns: list[Turn], template: Template = marked_turns) -> Rendered:
    """Spans of a template that is only called, never read.

    The prefixes of the conversation are rendered one after another. What a prefix adds
    to the one before is its last turn's span; where it doesn't begin with the one before,
    the template rewrites history at that turn and its span begins where they part.
    The content's place comes from two more renderings of the prefix whose last texts
    share no character with each other: what all have in common stands around the content.
    """
    before, spans, content, rewrites = template([]), [], [], []
    for k, (role, text) in enumerate(turns):
        prefix = turns[:k]
        now = template([*prefix, (role, text)])
        at = len(before)
        if not now.startswith(before):
            rewrites.append(k)
            at = _shared(now, before)
        a, b = template([*prefix, (role, "x")]), template([*prefix, (role, "y")])
        head = _shared(a, b)
        tail = _shared(a[::-1], b[::-1])
        spans.append((at, len(now)))
        content.append((head, max(head, len(now) - tail)))
        before = now
    return Rendered(before, spans, content, rewrites)


def _conversations(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(id, turns) of each conversation in sorted batches."""
    key, turns = None, None
    for b in batches:
        for k, role, text in zip(b["k"], b["role"], b["text"]):
            if turns is None or k != key:
                if turns is not None:
                    yield key, turns
                key, turns = k, []
            turns.append((role, text))
    if turns is not None:
        yield key, turns


def format_conversations(
    rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    template: Template = marked_turns,
) -> DataFrame:
    """(id, formatted, spans, loss_spans, rewrites): one row for each conversation.

    Rows stand by turn, then role and text; nulls come first, and null roles and texts are
    empty. Rows without an id are one conversation. loss_spans holds the contents of
    assistant turns. Offsets are code points. A task streams over sorted rows and holds
    one conversation at a time. Rendering every prefix takes time with the square of a
    conversation's turns, as the method does with any black-box template.
    """

    def run(batches):
        out = []
        for key, turns in _conversations(batches):
            r = render_incrementally(turns, template)
            loss = [c for (role, _), c in zip(turns, r.content) if role == "assistant"]
            out.append((key, r.text, [list(x) for x in r.spans], [list(x) for x in loss], r.rewrites))
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=columns)
                out = []
        yield pd.DataFrame(out, columns=columns)

    columns = ["k", "formatted", "spans", "loss_spans", "rewrites"]
    src = rows.select(
        F.col(id_col).cast("string").alias("k"), F.col(turn_col).alias("turn"),
        *(F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((role_col, "role"), (text_col, "text"))),
    )
    out = src.repartition("k").sortWithinPartitions("k", "turn", "role", "text").mapInPandas(
        run, "k string, formatted string, spans array<array<int>>, loss_spans array<array<int>>, rewrites array<int>"
    )
    return out.select(F.col("k").cast(rows.schema[id_col].dataType).alias(id_col), *columns[1:])


def read_turn(span: str) -> Turn:
    """Role and text of one turn of ``marked_turns``."""
    role, text = span.removeprefix(START).removesuffix(END + "\n").split("\n", 1)
    return unescape(role), unescape(text)


def chat_digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """Turns and loss text read back from the formatted strings by their spans."""
    columns = ["k", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        for b in batches:
            rows = []
            for k, text, spans, loss in zip(b["k"], b["formatted"], b["spans"], b["loss_spans"]):
                turns = [read_turn(text[a:z]) for a, z in spans]
                said = "".join(unescape(text[a:z]) for a, z in loss)
                sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
                rows.append((k, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(said), sha(said), len(text)))
            yield pd.DataFrame(rows, columns=columns)

    out = formatted.select(F.col(id_col).cast("string").alias("k"), "formatted", "spans", "loss_spans").mapInPandas(
        run, "k string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
    return out.select(F.col("k").cast(formatted.schema[id_col].dataType).alias(id_col), *columns[1:])
