"""Chat formatting with typed content parts.

A turn is a list of parts: text, image, audio or document. A visitor flattens them in order. Text
is written escaped; each other part becomes one placeholder, and an attachment record with its
reference and the tokens that the placeholder expands to. The template marks turns with control
strings. Where a text contains a control string of this or another common template, a backslash is
put behind its first character (before those that stand there already), so unescaping is exact and
no text can open or close a turn.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm import shared

OPEN, SEP, CLOSE = "<|im_start|>", "\n", "<|im_end|>\n"
#: Control strings of common chat templates, and this one's placeholders.
CONTROLS = (
    "<|im_start|>", "<|im_end|>", "<|image|>", "<|audio|>", "<|document|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>",
    "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>",
    "<s>", "</s>", "<unk>", "<pad>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>",
)
_RESTS = "|".join(re.escape(c[1:]) for c in sorted(CONTROLS, key=len, reverse=True))
_ESCAPE = re.compile(rf"([<\[])(\\*)(?={_RESTS})")
_UNESCAPE = re.compile(rf"([<\[])\\(\\*)(?={_RESTS})")
_ROLE = re.compile(r"[\\\n<\[]")
_UNROLE = re.compile(r"\\(.)")
_ROLE_CODES = {"\\": "\\\\", "\n": "\\n", "<": "\\l", "[": "\\b"}
_ROLE_CHARS = {"\\": "\\", "n": "\n", "l": "<", "b": "["}

PART = "struct<kind:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>"
#: Characters of formatted text after which a long conversation goes on in its next piece.
PIECE_CHARS = 4_000_000


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def escape_role(role: str) -> str:
    return _ROLE.sub(lambda m: _ROLE_CODES[m[0]], role)


def unescape_role(role: str) -> str:
    return _UNROLE.sub(lambda m: _ROLE_CHARS[m[1]], role)


class PartVisitor:
    """Flattens the parts of turns; ``attachments`` gathers (place, kind, ref, tokens)."""

    def __init__(self, patch: int = 14, merge: int = 2, audio_rate: float = 25.0, page_tokens: int = 256):
        self.side, self.audio_rate, self.page_tokens = patch * merge, audio_rate, page_tokens
        self.attachments: list[dict] = []

    def visit(self, part: dict) -> str:
        """The formatted part; a kind that is unknown or null is text, null text is empty."""
        own: Callable[[dict], str] = getattr(self, f"visit_{part.get('kind') or 'text'}", self.visit_text)
        return own(part)

    def visit_text(self, part: dict) -> str:
        return escape(part.get("text") or "")

    def visit_image(self, part: dict) -> str:
        tiles = [max(1, math.ceil((part.get(x) or 0) / self.side)) for x in ("width", "height")]
        return self._attach("image", part, tiles[0] * tiles[1])

    def visit_audio(self, part: dict) -> str:
        return self._attach("audio", part, max(1, math.ceil((part.get("seconds") or 0) * self.audio_rate)))

    def visit_document(self, part: dict) -> str:
        return self._attach("document", part, max(1, part.get("pages") or 0) * self.page_tokens)

    def _attach(self, kind: str, part: dict, tokens: int) -> str:
        self.attachments.append({"place": len(self.attachments), "kind": kind, "ref": part.get("ref"), "tokens": tokens})
        return f"<|{kind}|>"


def format_conversations(turns: DataFrame, visitor: type[PartVisitor] = PartVisitor) -> DataFrame:
    """Format ``turns(conv_id, turn, role, text | parts)``, one row per conversation (and piece).

    Rows of a conversation go by turn, then role and text; null turns first, null roles are empty,
    null text is empty, null conv_id is a conversation of its own. ``parts`` is an array of
    ``PART``; without that column each turn is its text. Returns conv_id, piece, formatted,
    loss_spans (start, end in ``formatted`` of each assistant turn's content), attachments and
    expanded_tokens. Conversations of over ``PIECE_CHARS`` go on in further pieces, so a task holds
    one piece at a time. Other columns are ignored.
    """
    part = f"named_struct('kind', 'text', 'text', coalesce(text, ''), 'ref', cast(null as string), 'width', cast(null as int), 'height', cast(null as int), 'seconds', cast(null as double), 'pages', cast(null as int))"
    has_parts = "parts" in turns.columns
    content = F.expr(f"coalesce(cast(parts as array<{PART}>), array({part}))" if has_parts and "text" in turns.columns else f"cast(parts as array<{PART}>)" if has_parts else f"array({part})")
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), content.alias("parts"))
    rows = rows.withColumn("_order", F.to_json("parts")).repartition(shared.partitions(turns.sparkSession), "conv_id")
    rows = rows.sortWithinPartitions("conv_id", "turn", "role", "_order").select("conv_id", "role", "parts")
    attachments = pa.list_(pa.struct([("place", pa.int32()), ("kind", pa.string()), ("ref", pa.string()), ("tokens", pa.int64())]))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    names = ["conv_id", "piece", "formatted", "loss_spans", "attachments", "expanded_tokens"]
    kinds = [pa.int64(), pa.int32(), pa.string(), spans, attachments, pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv: object = run  # no conversation yet
        piece, size, texts, loss, visit = 0, 0, [], [], visitor()

        def close() -> None:
            nonlocal piece, size, texts, loss, visit
            done.append((conv, piece, "".join(texts), loss, visit.attachments, sum(a["tokens"] for a in visit.attachments)))
            piece, size, texts, loss, visit = piece + 1, 0, [], [], visitor()

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*done, strict=True), kinds, strict=True)], names)
            done.clear()
            return out

        for batch in batches:
            for conv_id, role, parts in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                conv_id, role = conv_id.as_py(), role.as_py()
                if texts and (conv_id != conv or size > PIECE_CHARS):
                    close()
                if conv_id != conv:
                    conv, piece = conv_id, 0
                head = OPEN + escape_role(role) + SEP
                body = "".join(visit.visit(p or {}) for p in parts.as_py() or ())
                if role == "assistant":
                    loss.append({"start": size + len(head), "end": size + len(head) + len(body)})
                texts += [head, body, CLOSE]
                size += len(head) + len(body) + len(CLOSE)
            if done:
                yield hand_on()
        if texts:
            close()
        if done:
            yield hand_on()

    schema = "conv_id long, piece int, formatted string, loss_spans array<struct<start:long,end:long>>, attachments array<struct<place:int,kind:string,ref:string,tokens:long>>, expanded_tokens long"
    return rows.mapInArrow(run, schema)


def parse_formatted(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn of a formatted piece, unescaped; placeholders stay in the text."""
    for turn in formatted.split(OPEN)[1:]:
        if not turn.endswith(CLOSE):
            raise ValueError("a turn isn't closed")
        role, _, body = turn[: -len(CLOSE)].partition(SEP)
        yield unescape_role(role), unescape(body)


def formatted_digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from ``format_conversations``' output: conv_id, n_turns,
    turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    rows = formatted.select("conv_id", "piece", "formatted", "loss_spans").repartition(shared.partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        conv: object = run
        n = loss_chars = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()

        def close() -> None:
            nonlocal n, loss_chars, chars, turns, loss
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
            n = loss_chars = chars = 0
            turns, loss = hashlib.sha256(), hashlib.sha256()

        for batch in batches:
            for row in batch.to_pylist():
                if row["conv_id"] != conv:
                    if chars:
                        close()
                    conv = row["conv_id"]
                text = row["formatted"]
                chars += len(text)
                for role, content in parse_formatted(text):
                    n += 1
                    turns.update(f"{role}\n{content}\n".encode())
                for span in row["loss_spans"]:
                    content = unescape(text[span["start"] : span["end"]])
                    loss_chars += len(content)
                    loss.update(content.encode())
            # the last conversation of a batch may go on in the next
            if done:
                yield _digest_batch(done)
                done.clear()
        if chars:
            close()
            yield _digest_batch(done)

    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digest_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_and_read_back(turns: DataFrame) -> DataFrame:
    formatted, _ = shared.staged(format_conversations(turns), "chat")
    return formatted_digests(formatted)
