"""Chat formatting from an event log: messages are folded from streamed deltas, edits and regenerations, then rendered.

A log row is (conv_id, turn, msg, seq, kind, role, text). A message is one (conv_id, turn, msg); its events count in order of seq:

- ``message`` starts it with a role and a text, ``delta`` adds to the text, ``edit`` replaces the text,
- ``regenerate`` throws the text away (deltas follow), ``delete`` removes the message until the next ``message``.

The log is range-partitioned by message and sorted by (message, seq), so a task folds one message after the other, holding one
text at a time, and a long conversation spreads over as many tasks as it needs. Only the first and the last conversation
of a partition can go on in another one.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from dialoom.llm.common import small_batches, stored

# fixed values of the template: names of roles, the other control strings, and the texts that must not stand unescaped
NAMES = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
OTHER, END = "### Other", "</turn>"
ROLES = {v: k for k, v in NAMES.items()}
# a control string is hidden by a backslash after its first character; one that already has backslashes there gets one more
_FIRST, _REST = "[#<]", rf"(?:## (?:{'|'.join(ROLES)}):|## Other|/turn>)"
_HIDE = regex.compile(rf"(?:(?<=#)(?=\\*## (?:(?:{'|'.join(ROLES)}):|Other))|(?<=<)(?=\\*/turn>))")
_SHOW = regex.compile(rf"(?:(?<=#)\\(?=\\*## (?:(?:{'|'.join(ROLES)}):|Other))|(?<=<)\\(?=\\*/turn>))")


def escaped(text: str) -> str:
    """``text`` without any control string of the template; all other texts, backslashes included, stay as they are."""
    return _HIDE.sub(r"\\", text)


def unescaped(text: str) -> str:
    return _SHOW.sub("", text)


def rendered(role: str | None, text: str) -> tuple[str, int, int]:
    """(piece, start and end of the escaped text in it): a header line, the text, the end mark."""
    name = NAMES[role] if role in NAMES else escaped(f"Other {json.dumps(role)}")
    head = f"### {name}:\n"
    body = escaped(text)
    return f"{head}{body}\n{END}\n", len(head), len(head) + len(body)


def read_back(piece: str) -> tuple[str | None, str]:
    """The role and the text of a rendered message."""
    head, _, rest = piece.partition("\n")
    name = head[4:-1]
    role = ROLES[name] if name in ROLES else json.loads(unescaped(name)[6:])
    return role, unescaped(rest[:-len(END) - 2])


def folded(events: Iterable[tuple]) -> Iterator[tuple]:
    """Events (conv_id, turn, msg, seq, kind, role, text), sorted, become messages (conv_id, turn, msg, role, text).

    A message that no ``message`` event has started begins with its first other event, with that event's role. A later event
    with a role changes the role. Null texts are empty, unknown kinds are skipped.
    """
    key = role = None
    text: list[str] = []
    alive = ended = False
    for *place, _, kind, who, what in events:
        if place != key:
            if alive:
                yield *key, role, "".join(text)
            key, role, text, alive, ended = place, None, [], False, False
        if kind == "delete":
            text, alive, ended = [], False, True
        elif kind == "message":
            role, text, alive, ended = who, [what or ""], True, False
        elif kind in ("delta", "edit", "regenerate") and not ended:
            role = who if who is not None else role
            if kind != "delta":
                text = []
            text.append(what or "")
            alive = True
    if alive:
        yield *key, role, "".join(text)


def _batches(rows: Iterator[tuple], schema: pa.Schema, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in batches of about ``most`` characters of text (strings count with their length)."""
    out: list[tuple] = []
    size = 0
    for row in rows:
        out.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, str))
        if size >= most:
            yield _batch(out, schema)
            out, size = [], 0
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _rows(batches, kinds: list) -> Iterator[tuple]:
    """The rows of all batches, a slice at a time; the types go into ``kinds``."""
    for batch in batches:
        kinds[:] = list(batch.schema)
        for at in range(0, batch.num_rows, 256):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns))


def _over(step: Callable, names: str, types: dict):
    """A task that sends its sorted rows through ``step``; columns without an entry in ``types`` keep the type of their input column."""
    def run(batches):
        kinds: list = []
        rows = step(_rows(batches, kinds))
        first = next(rows, None)
        if first is None:
            return
        had = {f.name: f.type for f in kinds}
        schema = pa.schema([(n, types.get(n, had.get(n))) for n in names.split()])

        def all_():
            yield first
            yield from rows

        yield from _batches(all_(), schema)
    return run


def _kinds(log: DataFrame, *columns: str) -> str:
    return ", ".join(f"{c} {log.schema[c].dataType.simpleString()}" for c in columns)


def messages(log: DataFrame) -> DataFrame:
    """(conv_id, turn, msg, role, text) of every message that is left, sorted by (conv_id, turn, msg) within ranges of them.

    The order of events with equal seq is that of (kind, role, text). Nulls in conv_id, turn or msg are values like others and come first. Other
    columns are not looked at. A text must fit into one row; neither a conversation nor the events of a message must fit into a task.
    An empty log gives an empty table.
    """
    small_batches(log.sparkSession)
    plain = log.select("conv_id", "turn", "msg", "seq", F.col("kind").cast("string").alias("kind"), F.col("role").cast("string").alias("role"),
                       F.col("text").cast("string").alias("text"))
    ordered = plain.repartitionByRange("conv_id", "turn", "msg").sortWithinPartitions("conv_id", "turn", "msg", "seq", "kind", "role", "text")
    return ordered.mapInArrow(_over(folded, "conv_id turn msg role text", {}), f"{_kinds(log, 'conv_id', 'turn', 'msg')}, role string, text string")


def formatted(log: DataFrame, learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, msg, piece, loss_from, loss_to) of every message, sorted within ranges as by ``messages``.

    A conversation's text is its pieces one after the other. The loss mask covers the code points from ``loss_from`` to ``loss_to`` of a piece, which are the
    escaped text of a message whose role is in ``learned``; both are null for other messages.
    """
    def step(rows):
        for conv, turn, msg, role, text in rows:
            piece, start, end = rendered(role, text)
            yield (conv, turn, msg, piece, start, end) if role in learned else (conv, turn, msg, piece, None, None)

    types = {"piece": pa.string(), "loss_from": pa.int32(), "loss_to": pa.int32()}
    return messages(log).mapInArrow(_over(step, "conv_id turn msg piece loss_from loss_to", types),
                                    f"{_kinds(log, 'conv_id', 'turn', 'msg')}, piece string, loss_from int, loss_to int")


class _Digest:
    """What one conversation reads back to, piece by piece."""

    def __init__(self):
        self.turns = self.loss_chars = self.chars = 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int | None, end: int | None) -> None:
        role, text = read_back(piece)
        self.all.update(f"{role or ''}\n{text}\n".encode("utf-8", "replace"))
        self.turns += 1
        self.chars += len(piece)
        if start is not None:
            under = unescaped(piece[start:end])
            self.loss.update(under.encode("utf-8", "replace"))
            self.loss_chars += len(under)

    def row(self) -> tuple:
        return self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _digested(whole: bool, most: int = 1 << 22):
    """Sorted pieces become one row per conversation. Unless ``whole``, the first and the last one of a partition, and those
    of over ``most`` characters, come out piece by piece, so no more than these are held.
    """
    def step(rows):
        digest, conv, open_, held, size = None, None, not whole, [], 0
        for row in rows:
            if digest is None or row[0] != conv:
                if digest:
                    if not open_:
                        yield conv, None, None, None, None, None, *digest.row()
                    open_ = False
                conv, digest, held, size = row[0], _Digest(), [], 0
            if not open_:
                digest.add(*row[3:])
                if not whole:
                    held.append(row)
                    size += len(row[3])
                    if size > most:
                        yield from ((*r, None, None, None, None, None) for r in held)
                        open_, held = True, []
            else:
                yield *row, None, None, None, None, None
        if digest and whole:
            yield conv, None, None, None, None, None, *digest.row()
        else:
            yield from ((*r, None, None, None, None, None) for r in held)
    return step


_DIGESTS = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]


def digests(pieces: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of every conversation, read back from the sorted pieces of ``formatted``.

    turns_sha256 is over role (null: empty), \\n, text, \\n of every message, loss_sha256 over the text under the loss mask. Conversations that lie within one
    partition are done where they are; the pieces of the others (two in a partition at most) are brought together by conversation and
    streamed, as a digest is sequential by its nature: one hot conversation takes one task's time, not its memory.
    """
    names = "conv_id turn msg piece loss_from loss_to " + " ".join(_DIGESTS)
    types = {"n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    schema = f"{_kinds(pieces, *pieces.columns)}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    rows = stored(pieces.mapInArrow(_over(_digested(False), names, types), schema), "chat-digests")
    left = rows.filter("n_turns IS NULL").select(pieces.columns).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "msg")
    left = left.mapInArrow(_over(_digested(True), names, types), schema)
    return rows.filter("n_turns IS NOT NULL").union(left).select("conv_id", *_DIGESTS)


def event_log(turns: DataFrame, chunk: int = 256, draft: int = 16) -> DataFrame:
    """The log that leads to the rows (conv_id, turn, role, text) of ``turns``: every row becomes a message, also repeated ones.

    Assistant texts come as deltas of ``chunk`` code points (long texts as 64 longer ones), in odd turns after a first attempt of ``draft`` code points that is regenerated; other texts are
    begun with ``draft`` code points and then edited to the whole text. Rows of one turn are ordered by a hash of role and text.
    """
    tie = F.shiftright(F.xxhash64("role", "text"), 24)       # the row number below tells equal rows apart; it changes no text
    rows = turns.select("conv_id", "turn", F.struct(tie.alias("tie"), F.monotonically_increasing_id().alias("row")).alias("msg"),
                        F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    event = lambda kind, role, text: F.struct(F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))
    none, first = F.lit(None).cast("string"), F.substring("text", 1, draft)
    size = F.greatest(F.lit(chunk), F.ceil(F.length("text") / 64).cast("int"))
    deltas = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))),
                         lambda i: event("delta", none, F.substring(F.col("text"), i * size + 1, size)))
    answer = F.concat(F.array(event("message", F.col("role"), F.lit(""))),
                      F.when(F.col("turn") % 2 == 1, F.array(event("delta", none, first), event("regenerate", none, F.lit("")))).otherwise(
                          F.array(event("delta", none, F.lit("")))), deltas)
    typed = F.array(event("message", F.col("role"), first), event("edit", none, F.col("text")))
    return rows.select("conv_id", "turn", "msg", F.posexplode(F.when(F.col("role") == "assistant", answer).otherwise(typed)).alias("seq", "e")).select(
        "conv_id", "turn", "msg", "seq", "e.kind", "e.role", "e.text")
