"""Chat formatting from an event log.

A conversation is kept as events: ``append`` adds text to a message, ``edit``
replaces what it says, ``regenerate`` empties it for a new attempt.  The log is
partitioned by conversation and message, so that one long conversation is spread
over tasks, sorted by sequence number and folded in one pass that holds a single
message at a time.  A folded message is rendered into the template at once:

    ### role: text </turn>

Control strings inside roles and texts are escaped reversibly: a backslash is
doubled, and ``###`` and ``</turn>`` get one in front; so does a colon in a role.
Only assistant texts are under the loss mask, which is stored as a range of code
points of the message's rendering.

``read_back`` takes the stored renderings only, in the order of turns: it finds
roles, texts and mask by parsing them, removes the escapes and digests each
conversation as a stream.

Defined results: NULL texts and roles are empty; NULL turns come first; a NULL
conversation id is a conversation of its own; equal turns are separate messages,
ordered by role and row; repeated rows are messages of their own; a message
without ``append`` or ``edit`` is empty; an empty log gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.session import materialize

HEAD, END = "### ", " </turn>\n"
MASKED_ROLE = "assistant"
CONTROL = re.compile(r"\\|###|</turn>")
ESCAPED = re.compile(r"\\(\\|###|</turn>)")
ROLE_CONTROL = re.compile(r"\\|###|</turn>|:")
ROLE_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
OPENING = re.compile(r"### ((?:[^\\:]|\\\\|\\###|\\</turn>|\\:)*): ")
KEYS = ["conv_id", "turn", "role", "message"]
FORMATTED = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("message", pa.int64()),
                       ("formatted", pa.string()), ("mask_start", pa.int64()), ("mask_end", pa.int64())])
DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
ROWS_OUT = 1_000


def escape(text: str) -> str:
    return CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: m[1], text)


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendering of a message, and the range of its text under the loss mask (empty for other roles)."""
    head = HEAD + ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + ": "
    body = escape(text)
    return head + body + END, len(head), len(head) + (len(body) if role == MASKED_ROLE else 0)


def parse(formatted: str) -> tuple[str, str]:
    """Role and text of a rendering; a text that holds a bare control string is refused."""
    opening = OPENING.match(formatted)
    if not opening or not formatted.endswith(END):
        raise ValueError("not a rendered turn")
    body = formatted[opening.end():len(formatted) - len(END)]
    text = unescape(body)
    if escape(text) != body:
        raise ValueError("a control string inside a turn is not escaped")
    return ROLE_ESCAPED.sub(lambda m: m[1], opening[1]), text


def events_of_rows(conversations: DataFrame) -> DataFrame:
    """Every row as a message that one ``append`` event writes."""
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.monotonically_increasing_id().alias("message"),
        F.lit(0).cast("long").alias("seq"), F.lit("append").alias("kind"), F.coalesce("text", F.lit("")).alias("text"))


def streamed_events(conversations: DataFrame) -> DataFrame:
    """Every row as a message with the history a chat service logs, which folds back to the row's text.

    A first attempt is given up, a second one arrives in deltas; every other message
    is then spoilt and put right by an edit.
    """
    half = F.floor(F.length("text") / 2).cast("int")
    first = [("append", F.concat(F.reverse("text"), F.lit(" ..."))), ("regenerate", F.lit("")),
             ("append", F.left("text", half)), ("append", F.lit("")), ("append", F.substring("text", half + 1, F.length("text")))]
    second = [("append", F.lit(" oops")), ("edit", F.col("text"))]
    history = F.array(*[F.struct(F.lit(i).cast("long").alias("seq"), F.lit(kind).alias("kind"), text.alias("text"))
                        for i, (kind, text) in enumerate(first + second)])
    corrected = F.col("message") % 2 == 0
    log = F.when(corrected, history).otherwise(F.slice(history, 1, len(first)))
    return events_of_rows(conversations).select(*KEYS, F.explode(log).alias("event")).select(*KEYS, "event.*")


def _rows(batch: pa.RecordBatch) -> Iterator[tuple]:
    return zip(*[column.to_pylist() for column in batch.columns])


def _collected(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= ROWS_OUT:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*rows), schema)], schema=schema)


def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted events (conv_id, turn, role, message, kind, text) to rendered messages."""
    key, parts = None, []
    for *now, kind, text in rows:
        if now != key:
            if key is not None:
                yield (*key, *render(key[2], "".join(parts)))
            key, parts = now, []
        if kind == "append":
            parts.append(text or "")
        elif kind == "edit":
            parts = [text or ""]
        elif kind == "regenerate":
            parts = []
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if key is not None:
        yield (*key, *render(key[2], "".join(parts)))


def format_log(events: DataFrame) -> DataFrame:
    """Rendered messages, one row each: the keys, ``formatted``, ``mask_start``, ``mask_end``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _collected(fold(row for batch in batches for row in _rows(batch)), FORMATTED)

    log = events.repartition("conv_id", "message").sortWithinPartitions(*KEYS, "seq")
    return log.select(*KEYS, "kind", "text").mapInArrow(
        run, "conv_id long, turn long, role string, message long, formatted string, mask_start long, mask_end long")


def digest(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Sorted renderings (conv_id, formatted, mask_start, mask_end) to one row per conversation."""
    started, conv = False, None
    for now, formatted, start, end in rows:
        if not started or now != conv:
            if started:
                yield (conv, turns, whole.hexdigest(), masked_chars, masked.hexdigest(), chars)
            started, conv, turns, masked_chars, chars = True, now, 0, 0, 0
            whole, masked = hashlib.sha256(), hashlib.sha256()
        role, text = parse(formatted)
        under_mask = unescape(formatted[start:end])
        turns, chars, masked_chars = turns + 1, chars + len(formatted), masked_chars + len(under_mask)
        whole.update(f"{role}\n{text}\n".encode())
        masked.update(under_mask.encode())
    if started:
        yield (conv, turns, whole.hexdigest(), masked_chars, masked.hexdigest(), chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _collected(digest(row for batch in batches for row in _rows(batch)), DIGESTS)

    ordered = formatted.repartition("conv_id").sortWithinPartitions(*KEYS)
    return ordered.select("conv_id", "formatted", "mask_start", "mask_end").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def format_and_read_back(events: DataFrame) -> DataFrame:
    """Stores the renderings and digests what is read from them."""
    return read_back(materialize(format_log(events), "formatted"))
