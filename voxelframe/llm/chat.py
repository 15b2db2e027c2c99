"""Formatting conversations for training, and reading them back.

Turns are set out by a template (see ``template``) with the control strings
``<s>``, ``[:]`` and ``</s>``; text generated by the model is marked for the
loss.  Any ``<`` or ``[`` of a text gets a backslash after it and a backslash
is doubled, so that no control string can come from a text, and unescaping
gives the text back.

Defined results: null roles and texts count as empty; turns go by ``turn``
(null first), then role and text, so ties and repeated rows have an order;
rows with a null conv_id are one conversation.  Extra columns are not read.

A conversation is streamed through one task turn by turn, because a SHA-256 of
all its turns is a chain; memory is bounded by one turn and one Arrow batch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .template import Template, conversation

TEMPLATE = (
    "{% for turn in messages -%} <s>{{ turn.role | escape }}[:]"
    "{%- if turn.role == 'assistant' -%} {% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{%- else -%} {{ turn.text | escape }} {%- endif -%} </s> {%- endfor %}"
)
BEGIN, COLON, STOP = "<s>", "[:]", "</s>"


def escape(text: str) -> str:
    return re.sub(r"[<\[\\]", lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return re.sub(r"([<\[\\])\\", r"\1", text)


def compile_template(source: str = TEMPLATE) -> Template:
    return Template(source, {"escape": lambda x: escape("" if x is None else str(x))})


class Reader:
    """Reads turns and the text under the loss mask back from formatted pieces.

    Keeps no more than the turn it is in.
    """

    def __init__(self):
        self.turns, self.chars, self.loss_chars = 0, 0, 0
        self.all_turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.rest, self.marked = "", ""

    def feed(self, text: str, generated: bool) -> None:
        self.chars += len(text)
        self.rest += text
        if generated:
            self.marked += text
        else:
            self.close_loss()
        while (end := self.rest.find(STOP)) >= 0:
            turn, self.rest = self.rest[:end], self.rest[end + len(STOP) :]
            role, colon, body = turn.partition(COLON)
            if not (role.startswith(BEGIN) and colon):
                raise ValueError("a turn is not set out as the template does")
            self.all_turns.update(f"{unescape(role[len(BEGIN) :])}\n{unescape(body)}\n".encode())
            self.turns += 1

    def close_loss(self) -> None:
        if self.marked:
            text = unescape(self.marked)
            self.loss_chars += len(text)
            self.loss.update(text.encode())
            self.marked = ""

    def end(self) -> tuple[int, str, int, str, int]:
        self.close_loss()
        if self.rest:
            raise ValueError("text after the last turn")
        return self.turns, self.all_turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def digest(template: Template, rows: Iterable[tuple[str | None, str | None]]) -> tuple[int, str, int, str, int]:
    reader = Reader()
    for text, generated in template.pieces(messages=conversation(rows)):
        reader.feed(text, generated)
    return reader.end()


def in_turn_order(conversations: DataFrame) -> DataFrame:
    rows = conversations.select("conv_id", "turn", "role", "text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)


def format_digests(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    compile_template(source)  # errors show here, not in a task
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kind = conversations.schema["conv_id"].dataType
    types = [to_arrow_type(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template, held = compile_template(source), []
        for conv, rows in groupby(_stream(batches), key=lambda r: r[0]):
            held.append((conv, *digest(template, ((role, text) for _, role, text in rows))))
            if len(held) >= 1000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names)

    rows = in_turn_order(conversations).select("conv_id", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def formatted(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """conv_id, part, text and loss spans: conversations in parts of about a million characters.

    The parts of a conversation, joined in order, are its formatted text.
    """
    compile_template(source)
    kind = conversations.schema["conv_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        template = compile_template(source)

        def send(conv, part: int, out: list[str], spans: list[list[int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], id_type), pa.array([part], pa.int64()), pa.array(["".join(out)]), pa.array([spans], pa.list_(pa.list_(pa.int64())))], ["conv_id", "part", "text", "loss"])

        for conv, rows in groupby(_stream(batches), key=lambda r: r[0]):
            out, spans, at, part = [], [], 0, 0
            for text, generated in template.pieces(messages=conversation((role, text) for _, role, text in rows)):
                if generated and text:
                    spans.append([at, at + len(text)])
                out.append(text)
                at += len(text)
                if at > 1_000_000:
                    yield send(conv, part, out, spans)
                    out, spans, at, part = [], [], 0, part + 1
            if out:
                yield send(conv, part, out, spans)

    rows = in_turn_order(conversations).select("conv_id", "role", "text")
    return rows.mapInArrow(run, f"conv_id {kind.simpleString()}, part long, text string, loss array<array<long>>")
