"""Chat formatting with typed content parts.

A conversation is rendered into one string. Each turn's content is a list of typed parts (text, image, audio,
document); a visitor flattens them in order: texts are escaped, every other part becomes a placeholder, its
reference goes to the attachment list together with the number of tokens it expands to. The template's own
strings never occur inside a text: a backslash breaks them, and is itself doubled, so parsing is exact.

Defined cases: null text, reference, role and part kind are empty; an unknown kind is an error; turns of equal
number are ordered by role, then by their parts; rows without a conversation id form one conversation; an empty
table gives no rows; a conversation's unused columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Strings of the template. The bracketed ones are those of a public chat template.
CONTROL = ("[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<s>", "</s>", "<|turn|>", "<|text|>", "<|end|>",
           "<|image|>", "<|audio|>", "<|document|>")
TURN, BODY, END = "<|turn|>", "<|text|>", "<|end|>"
_BREAK = re.compile("|".join(re.escape(c) for c in sorted(CONTROL, key=len, reverse=True)))
_KEPT = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(TURN) + "(.*?)" + re.escape(BODY) + "(.*?)" + re.escape(END), re.S)
_PART = re.compile(r"<\|(image|audio|document)\|>")

#: Tokens that one part of a kind stands for, from its size.
EXPANSION: dict[str, Callable[[int], int]] = {
    "image": lambda pixels: max(1, -(-pixels // (28 * 28))),
    "audio": lambda milliseconds: max(1, -(-milliseconds // 40)),
    "document": lambda characters: max(1, -(-characters // 4)),
}

PARTS = "array<struct<kind:string, text:string, ref:string, size:bigint>>"
FORMATTED = ("conv_id {key}, n_turns long, formatted string, loss_spans array<struct<start:bigint, stop:bigint>>, "
             "attachments array<struct<position:bigint, kind:string, ref:string, tokens:bigint>>, "
             "expanded_tokens long")


def escape(text: str) -> str:
    """The text without any control string; reversible by ``unescape``."""
    return _BREAK.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _KEPT.sub(lambda m: m[1], text)


@dataclass
class Rendering:
    """Visitor: collects the string, the spans under the loss mask and the attachments in order."""

    pieces: list[str] = field(default_factory=list)
    length: int = 0
    spans: list[dict] = field(default_factory=list)
    attachments: list[dict] = field(default_factory=list)

    def put(self, text: str) -> None:
        self.pieces.append(text)
        self.length += len(text)

    def visit_text(self, part: dict) -> None:
        self.put(escape(part["text"] or ""))

    def visit_attachment(self, part: dict) -> None:
        kind = part["kind"]
        self.attachments.append({"position": self.length, "kind": kind, "ref": part["ref"] or "",
                                 "tokens": EXPANSION[kind](max(part["size"] or 0, 0))})
        self.put(f"<|{kind}|>")

    def visit_turn(self, role: str, parts: list[dict], masked: bool) -> None:
        self.put(TURN + escape(role) + BODY)
        start = self.length
        for part in parts:
            kind = part["kind"] or "text"
            if kind == "text":
                self.visit_text(part)
            elif kind in EXPANSION:
                self.visit_attachment(part)
            else:
                raise ValueError(f"unknown kind of part: {kind}")
        if masked:
            self.spans.append({"start": start, "stop": self.length})
        self.put(END)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, content) of each turn read back from a formatted string; placeholders stay in the content."""
    for m in _TURN.finditer(formatted):
        yield unescape(m[1]), unescape(m[2])


def split_parts(content: str) -> list[tuple[str, str]]:
    """(kind, text) of the parts inside an escaped content, placeholders with empty text."""
    out, at = [], 0
    for m in _PART.finditer(content):
        if m.start() > at:
            out.append(("text", unescape(content[at:m.start()])))
        out.append((m[1], ""))
        at = m.end()
    if at < len(content):
        out.append(("text", unescape(content[at:])))
    return out


def text_parts(df: DataFrame, text: str = "text") -> DataFrame:
    """Replace a plain text column by a list of one text part."""
    part = F.array(F.struct(F.lit("text").alias("kind"), F.col(text).alias("text"),
                            F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("size")))
    return df.withColumn("parts", part.cast(PARTS))


def format_conversations(df: DataFrame, trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation of turns (conv_id, turn, role, parts): the string, loss spans, attachments.

    A conversation is one value of the result, so its turns meet in one task; nothing else is gathered.
    """
    turns = (df.groupBy("conv_id")
             .agg(F.sort_array(F.collect_list(F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), "parts")))
                  .alias("turns")))
    key = df.schema["conv_id"].dataType

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, turns in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                out = Rendering()
                for turn in turns:
                    out.visit_turn(turn["role"], turn["parts"] or [], turn["role"] == trained_role)
                rows.append((conv_id.as_py(), len(turns), "".join(out.pieces), out.spans, out.attachments,
                             sum(a["tokens"] for a in out.attachments)))
            yield pa.RecordBatch.from_arrays([
                pa.array([r[0] for r in rows], batch.schema.field(0).type),
                pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string()),
                pa.array([r[3] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))),
                pa.array([r[4] for r in rows], pa.list_(pa.struct([
                    ("position", pa.int64()), ("kind", pa.string()), ("ref", pa.string()),
                    ("tokens", pa.int64())]))),
                pa.array([r[5] for r in rows], pa.int64())],
                names=["conv_id", "n_turns", "formatted", "loss_spans", "attachments", "expanded_tokens"])

    return turns.mapInArrow(render, FORMATTED.format(key=key.simpleString()))


def digest(formatted: DataFrame) -> DataFrame:
    """Digests read back from the formatted strings: turns, text under the loss mask, length."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("loss_spans").to_pylist(),
                                   strict=True):
                turns, trained = hashlib.sha256(), hashlib.sha256()
                count = chars = 0
                for role, content in parse(text):
                    turns.update(f"{role}\n{content}\n".encode())
                    count += 1
                for span in spans:
                    part = unescape(text[span["start"]:span["stop"]])
                    trained.update(part.encode())
                    chars += len(part)
                made.append((count, turns.hexdigest(), chars, trained.hexdigest(), len(text)))
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), *(pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds))],
                names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    key = formatted.schema["conv_id"].dataType.simpleString()
    return (formatted.select("conv_id", "formatted", "loss_spans")
            .mapInArrow(read, f"conv_id {key}, n_turns long, turns_sha256 string, loss_chars long, "
                              "loss_sha256 string, formatted_chars long"))
