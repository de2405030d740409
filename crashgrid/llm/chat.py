"""Chat formatting by incremental black-box rendering.

A template is any function from messages to a string. The turns so far are rendered again with each
turn; what the longer output adds is the span of the new turn, and what a generation prompt adds is the
part of that span in front of its text. A template whose longer output does not begin with the
shorter one rewrites history; its conversations are reported instead of being given wrong spans.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]

ASSISTANT = "assistant"
ROWS = 2_000  # of a batch


@dataclass(frozen=True)
class Template:
    """``render(messages, prompt)`` gives a string, with the head of an assistant's turn at its end if ``prompt``.

    ``escape`` is what it does to a text. ``reach``: how many turns before a turn, besides the
    conversation's first one, the template may look at; None for all of them, at a cost that grows
    with the square of a conversation.
    """

    render: Callable[[Messages, bool], str]
    escape: Callable[[str], str]
    reach: int | None = None


# The control strings of the built-in template. Inside a text each gets a backslash after its first character; one
# that has backslashes there already gets one more, so that the change can be taken back.
_CONTROL = r"/?INST\]|/?TURN|/?s>"
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\2\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def render_instructions(messages: Messages, prompt: bool = False) -> str:
    """``<s>``, then ``[INST] .. [/INST]`` for users, ``..</s>`` for assistants, ``[TURN role] .. [/TURN]`` for others."""
    out = ["<s>"]
    for role, text in messages:
        body = escape(text)
        if role == "user":
            out.append(f"[INST] {body} [/INST]")
        elif role == ASSISTANT:
            out.append(f"{body}</s>")
        else:
            out.append(f"[TURN {quote(role, safe='')}] {body} [/TURN]")
    return "".join(out)


INSTRUCTIONS = Template(render_instructions, escape)


def parse_instructions(formatted: str) -> Messages:
    """The messages of an output of ``render_instructions`` or of the spans of some of its turns."""
    at, found = 3 * formatted.startswith("<s>"), []
    while at < len(formatted):
        if formatted.startswith("[INST] ", at):
            role, start, end, mark = "user", at + 7, formatted.index(" [/INST]", at + 6), " [/INST]"
        elif formatted.startswith("[TURN ", at):
            head = formatted.index("] ", at)
            role, start, mark = unquote(formatted[at + 6 : head]), head + 2, " [/TURN]"
            end = formatted.index(mark, head + 1)
        else:
            role, start, end, mark = ASSISTANT, at, formatted.index("</s>", at), "</s>"
        found.append((role, unescape(formatted[start:end])))
        at = end + len(mark)
    return found


class Renderer:
    """Spans of the turns of one conversation, given one after the other."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.seen: Messages = []
        self.output: str | None = ""  # of the turns seen, None where it has to be rendered again
        self.rewritten = False

    def add(self, role: str, text: str) -> tuple[str, int, int]:
        """What the turn adds to the output, and the bounds of an assistant's text in it (else 0, 0)."""
        render, reach = self.template.render, self.template.reach
        before = render(self.seen, False) if self.output is None else self.output
        now = render([*self.seen, (role, text)], False)
        span, low, high = now[len(before) :], 0, 0
        if not now.startswith(before):
            self.rewritten = True
        elif role == ASSISTANT:
            head, body = render(self.seen, True), self.template.escape(text)
            if now.startswith(head) and len(head) >= len(before) and now.startswith(body, len(head)):
                low, high = len(head) - len(before), len(head) - len(before) + len(body)
            else:
                self.rewritten = True
        self.seen.append((role, text))
        self.output = now
        if reach is not None and len(self.seen) > reach + 1:
            del self.seen[1 : len(self.seen) - reach]
            self.output = None
        return span, low, high


_SPANS = "conv_id long, position long, span string, loss_low long, loss_high long, rewrites boolean"
_NAMES = [c.split()[0] for c in _SPANS.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _in_order(docs: DataFrame, *order: str) -> DataFrame:
    """Conversations one after the other, each in one task that reads it as a stream."""
    return docs.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def format_chats(
    conversations: DataFrame, template: Template = INSTRUCTIONS, conv_id: str = "conv_id", turn: str = "turn",
    role: str = "role", text: str = "text",
) -> DataFrame:
    """Formatted conversations, a row per turn: ``conv_id, position, span, loss_low, loss_high, rewrites``.

    The spans of a conversation, by ``position`` (from 0), joined are its output; an assistant's
    text lies at ``loss_low .. loss_high`` of its span (code points). ``rewrites`` is true from the
    turn on at which the template changed what it had said before, or did not show an assistant's
    text as one piece; spans from there on are not to be trusted and have no loss.

    Rows go by ``turn``, null first; turns of one number by role, then text. Null texts and roles
    are empty; rows without ``conv_id`` are one conversation; repeated rows are turns of their own;
    an empty table gives no rows. Every prefix of a conversation is rendered whole and compared with the
    one before, so a task holds one conversation and its output, at a cost that grows with the square of
    its length. A template that states its ``reach`` is shown only the turns it looks at.
    """
    rows = conversations.select(
        F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, renderer, position = object(), Renderer(template), 0
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                out = []
                columns = [batch.column(c).slice(low, ROWS).to_pylist() for c in ("conv_id", "role", "text")]
                for conv, who, said in zip(*columns, strict=True):
                    if conv != current:
                        current, renderer, position = conv, Renderer(template), 0
                    span, a, b = renderer.add(who, said)
                    if renderer.rewritten:
                        a = b = 0
                    out.append((conv, position, span, a, b, renderer.rewritten))
                    position += 1
                yield _batch(out, _NAMES, _KINDS)

    return _in_order(rows, "turn", "role", "text").mapInArrow(formatted, _SPANS)


_READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
_READ_NAMES = [c.split()[0] for c in _READ.split(", ")]
_READ_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]


class _Digest:
    """Turns and loss of one conversation, read from its output span by span."""

    def __init__(self) -> None:
        self.turns = self.loss = self.chars = 0
        self.all, self.learnt, self.rewrites = hashlib.sha256(), hashlib.sha256(), False

    def add(self, span: str, low: int, high: int, rewrites: bool, parse: Callable[[str], Messages], plain: Callable[[str], str]) -> None:
        for role, text in parse(span):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode())
        learnt = plain(span[low:high])
        self.learnt.update(learnt.encode())
        self.loss += len(learnt)
        self.chars += len(span)
        self.rewrites |= rewrites

    def row(self, conv: int | None) -> tuple:
        return conv, self.turns, self.all.hexdigest(), self.loss, self.learnt.hexdigest(), self.chars, self.rewrites


def read_chats(
    formatted: DataFrame, parse: Callable[[str], Messages] = parse_instructions, plain: Callable[[str], str] = unescape
) -> DataFrame:
    """What formatted conversations say, read back from their spans, a row per conversation.

    ``conv_id, n_turns, turns_sha256`` (role, line end, text, line end per turn), ``loss_chars,
    loss_sha256`` (the text under the loss, without escapes), ``formatted_chars, rewrites``. Digests
    run over a conversation in order, so each is read by one task, as a stream.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, out = None, None, []
        for batch in batches:
            for low in range(0, batch.num_rows, ROWS):
                columns = [batch.column(c).slice(low, ROWS).to_pylist() for c in ("conv_id", "span", "loss_low", "loss_high", "rewrites")]
                for conv, span, a, b, rewrites in zip(*columns, strict=True):
                    if digest is None or conv != current:
                        if digest:
                            out.append(digest.row(current))
                        current, digest = conv, _Digest()
                    digest.add(span, a, b, rewrites, parse, plain)
                if len(out) >= ROWS:
                    yield _batch(out, _READ_NAMES, _READ_KINDS)
                    out = []
        if digest:
            out.append(digest.row(current))
        yield _batch(out, _READ_NAMES, _READ_KINDS)

    return _in_order(formatted, "position").mapInArrow(read, _READ)
