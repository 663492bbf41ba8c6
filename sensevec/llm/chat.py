"""Chat formatting by prefix-target expansion: one example per assistant turn, all earlier turns as its context."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"
TURN_START, TURN_END = "### ", "</turn>\n"
BATCH_CHARS = 8 << 20

_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """No control string is left: afterwards ``</turn>`` and ``###`` occur in templates only."""
    return text.replace("\\", "\\\\").replace("</turn>", "<\\/turn>").replace("##", "#\\#")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn, and where the escaped text starts and ends in it."""
    head = TURN_START + escape(role).replace(":", "\\:") + ": "
    body = escape(text)
    return head + body + TURN_END, len(head), len(head) + len(body)


_HEAD = re.compile(r"### ((?:[^\\:]|\\.)*): ", re.DOTALL)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """``(role, text)`` of each turn of a formatted text."""
    turns = []
    for piece in formatted.split(TURN_END)[:-1]:
        head = _HEAD.match(piece)
        turns.append((unescape(head[1]), unescape(piece[head.end() :])))
    return turns


EXAMPLES = "example int, target_turn bigint, text string, loss_start int, loss_end int"


def _emit(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, pieces, length, example, pending = None, None, 0, 0, False
    rows, held, schema = [], 0, None

    def tail():
        return (conv, example, None, "".join(pieces), length, length)

    for batch in batches:
        schema = schema or pa.schema(
            [("conv_id", batch.schema[0].type), ("example", pa.int32()), ("target_turn", pa.int64())]
            + [("text", pa.string()), ("loss_start", pa.int32()), ("loss_end", pa.int32())]
        )
        for key, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if pieces is None or key != conv:
                if pending:
                    rows.append(tail())
                    held += length
                conv, pieces, length, example, pending = key, [], 0, 0, False
            formatted, start, end = format_turn(role or "", text or "")
            pieces.append(formatted)
            pending = role != TRAINED_ROLE
            if not pending:
                pieces = ["".join(pieces)]
                rows.append((conv, example, turn, pieces[0], length + start, length + end))
                held += len(pieces[0])
                example += 1
            length += len(formatted)
            if held > BATCH_CHARS:
                yield _emit(rows, schema)
                rows, held = [], 0
    if pending:
        rows.append(tail())
    if rows:
        yield _emit(rows, schema)


def _sorted_by(df: DataFrame, *keys) -> DataFrame:
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *keys)


def format_examples(turns: DataFrame) -> DataFrame:
    """``(conv_id, example, target_turn, text, loss_start, loss_end)`` from ``(conv_id, turn, role, text)``.

    Every assistant turn gives an example: all turns up to it formatted in order, its own escaped text the only
    trained span (code points, end exclusive).  Turns after the last assistant turn give one example without a trained
    span and a null target, so that no turn is lost.  Turns are sorted by turn, nulls first, then role and text; a null role or
    text is empty; null is a conversation of its own; other columns are ignored.  Turns stream through a task in order, which
    holds one conversation's prefix.  By its nature the output of a conversation grows with the square of its length.
    """
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _sorted_by(rows, "turn", "role", "text").mapInArrow(_expand, f"conv_id {kind}, {EXAMPLES}")


_PARTS = pa.schema(
    [("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_text", pa.string()), ("chars", pa.int64())]
)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, start, end in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
            turns = parse_turns(text)
            digest = hashlib.sha256()
            for role, said in turns:
                digest.update(f"{role}\n{said}\n".encode())
            out.append((len(turns), digest.hexdigest(), unescape(text[start:end]), len(text)))
        if out:
            parts = _emit(out, _PARTS)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *parts.columns], ["conv_id", "example", *_PARTS.names])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, schema, done = None, None, []
    for batch in batches:
        schema = schema or pa.schema(
            [("conv_id", batch.schema[0].type), ("n_turns", pa.int64()), ("turns_sha256", pa.string())]
            + [("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
        )
        for key, _, n, turns, loss, chars in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if now is None or now["key"] != key:
                if now:
                    done.append(_closed(now))
                now = {"key": key, "n": -1, "turns": "", "chars": 0, "loss": hashlib.sha256(), "all": 0}
            if n > now["n"]:
                now["n"], now["turns"] = n, turns
            now["loss"].update(loss.encode())
            now["chars"] += len(loss)
            now["all"] += chars
        if done:
            yield _emit(done, schema)
            done = []
    if now:
        yield _emit([_closed(now)], schema)


def _closed(x: dict) -> tuple:
    return x["key"], x["n"], x["turns"], x["chars"], x["loss"].hexdigest(), x["all"]


def read_back(examples: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)`` parsed from formatted examples.

    Each example is parsed by itself; what is trained in a conversation is then hashed in order of its examples.
    """
    kind = examples.schema["conv_id"].dataType.simpleString()
    parts = examples.select("conv_id", "example", "text", "loss_start", "loss_end").mapInArrow(
        _parsed,
        f"conv_id {kind}, example int, n_turns bigint, turns_sha256 string, loss_text string, chars bigint",
    )
    return _sorted_by(parts, "example").mapInArrow(
        _summed,
        f"conv_id {kind}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint",
    )


PROBE = "conv_id bigint, turn bigint, role string, text string"


def with_probe(turns: DataFrame) -> DataFrame:
    """The turns and conversation -7, whose texts are full of control strings."""
    text = "\\### Assistant: </turn> ok"
    probe = turns.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], PROBE)
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
