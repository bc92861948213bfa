"""Chat formatting: a finite-state machine over roles checks the order of turns; segments with loss flags follow a declarative template."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import read


@dataclass(frozen=True)
class Template:
    """How conversations are written, without code.

    turns: for each role the strings before and after its texts, and whether its texts are under the loss; any other role is written as
    other[0], its name, other[1], text, other[2], without loss. moves: the role that may follow a state; the state is the last role, `start`
    before the first turn. A conversation is complete if it ends in a state of `final`.

    Every control string must begin with a character that no control string has later on, and none may hold a backslash: so a control string
    never arises across the border of a text, and escaping (one backslash more after the first character) is undone without loss.
    """

    begin: str = "<s>"
    turns: dict[str, tuple[str, str, bool]] = field(default_factory=lambda: {"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("[OUT] ", " </s>", True)})
    other: tuple[str, str, str] = ("[ROLE] ", " [:] ", " [/ROLE]")
    moves: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})
    final: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        """The control strings, without the spaces that set them off."""
        return list(dict.fromkeys(c.strip(" ") for c in (self.begin, *(c for a, b, _ in self.turns.values() for c in (a, b)), *self.other)))

    def __post_init__(self):
        controls = self.controls()
        heads = {c[:1] for c in controls}
        if any(not c or "\\" in c or heads & set(c[1:]) for c in controls):
            raise ValueError("a control string is empty, holds a backslash, or the first character of one within")
        if len({a for a, _, _ in self.turns.values()} | {self.other[0]}) <= len(self.turns):
            raise ValueError("two roles open alike")


class Codec:
    """Escapes, writes and reads back by a template."""

    def __init__(self, template: Template):
        self.template = template
        parts = [rf"{re.escape(c[0])}\\*{re.escape(c[1:])}" for c in template.controls()]
        self.found = re.compile("|".join(parts))
        self.opened = {a: (role, b) for role, (a, b, _) in template.turns.items()}
        self.opener = re.compile("|".join(re.escape(a) for a in (*self.opened, template.other[0])))

    def escape(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][0] + "\\" + m[0][1:], text)

    def unescape(self, text: str) -> str:
        return self.found.sub(lambda m: m[0][0] + m[0][2:] if m[0][1:2] == "\\" else m[0], text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The segments of a turn, (text, loss)."""
        if role in self.template.turns:
            before, after, loss = self.template.turns[role]
            return [(before, False), (self.escape(text), loss), (after, False)]
        before, name, after = self.template.other
        return [(before + self.escape(role) + name, False), (self.escape(text), False), (after, False)]

    def turn(self, written: str, at: int) -> tuple[str, str, int] | None:
        """Role, text and end of the turn that is written from `at` on; None if its end is not there yet."""
        opening = self.opener.match(written, at)
        if opening is None:
            if len(written) - at >= max(map(len, (*self.opened, self.template.other[0]))):
                raise ValueError("no turn begins here")
            return None
        at = opening.end()
        role = None
        if opening[0] in self.opened:
            role, after = self.opened[opening[0]]
        else:
            _, name, after = self.template.other
            end = written.find(name, at)
            if end < 0:
                return None
            role, at = self.unescape(written[at:end]), end + len(name)
        end = written.find(after, at)
        return None if end < 0 else (role, self.unescape(written[at:end]), end + len(after))


def _ordered(conversations: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role, text)
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _arrow(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(fields), fields)], schema=fields)


def format_conversations(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per segment, in order within its partition: conv_id, turn_no (from 0; the begin mark has that of the first turn), segment (from 0
    in its conversation), text, loss, in_order (the machine let this turn follow), state (role that the machine is in afterwards).

    Written one after another, the texts of a conversation's segments are the formatted conversation. Turns are ordered by turn, null first; ties by
    role, then text. Turns out of order are written all the same, with in_order false, and the machine goes on from their role. One
    shuffle by conv_id brings turns together; a task reads them as a sorted stream and holds one turn at a time, so that
    a conversation of any length passes in bounded memory (its order makes it one stream). Null roles and texts count as empty; repeated rows
    are turns of their own; rows with a null conv_id are one conversation; an empty table gives an empty result; other columns are ignored.
    """
    fields = pa.schema([("conv_id", pa.int64()), ("turn_no", pa.int64()), ("segment", pa.int64()), ("text", pa.string()), ("loss", pa.bool_()), ("in_order", pa.bool_()), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(template)
        conv, turn, segment, state = (), 0, 0, "start"
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                out = []
                for this, role, text in zip(*(c.to_pylist() for c in part.columns)):
                    pieces = codec.segments(role, text)
                    if conv == () or this != conv:
                        conv, turn, segment, state = this, 0, 0, "start"
                        pieces.insert(0, (template.begin, False))
                    fits, state = role in template.moves.get(state, ()), role
                    for piece, loss in pieces:
                        out.append((conv, turn, segment, piece, loss, fits, state))
                        segment += 1
                    turn += 1
                yield _arrow(out, fields)

    return _ordered(conversations).mapInArrow(run, "conv_id long, turn_no long, segment long, text string, loss boolean, in_order boolean, state string")


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """What formatted conversations say: conv_id, n_turns, turns_sha256 (of role, newline, text, newline of each turn), loss_chars and
    loss_sha256 (of all text under the loss mask, unescaped), formatted_chars, valid (every turn in order, and the last state final).

    Takes the segments of format_conversations as they come, in order within partitions, so nothing is shuffled. Turns are parsed from
    the control strings of the written text alone, the loss from the mask; a text that doesn't parse fails the query.
    """
    fields = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    class Reader:
        def __init__(self, conv, codec):
            self.conv, self.codec, self.rest = conv, codec, ""
            self.n_turns = self.loss_chars = self.chars = 0
            self.turns, self.loss, self.begun, self.fits, self.state = hashlib.sha256(), hashlib.sha256(), False, True, "start"

        def add(self, text, loss, in_order, state):
            self.chars += len(text)
            self.fits, self.state = self.fits and in_order, state
            if loss:
                plain = self.codec.unescape(text)
                self.loss_chars += len(plain)
                self.loss.update(plain.encode())
            self.rest += text
            if not self.begun and self.rest.startswith(template.begin):
                self.rest, self.begun = self.rest[len(template.begin) :], True
            at = 0
            while self.begun and at < len(self.rest) and (found := self.codec.turn(self.rest, at)):
                role, plain, at = found
                self.n_turns += 1
                self.turns.update(f"{role}\n{plain}\n".encode())
            self.rest = self.rest[at:]

        def row(self):
            if self.rest or not self.begun:
                raise ValueError(f"conversation {self.conv} does not read back")
            return self.conv, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars, self.fits and self.state in template.final

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, reader = Codec(template), None
        for batch in batches:
            out = []
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                for conv, *said in zip(*(c.to_pylist() for c in part.columns)):
                    if reader is None or conv != reader.conv:
                        out += [reader.row()] if reader else []
                        reader = Reader(conv, codec)
                    reader.add(*said)
            yield _arrow(out, fields)
        yield _arrow([reader.row()] if reader else [], fields)

    return segments.select("conv_id", "text", "loss", "in_order", "state").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    given = read(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_conversations(given.unionByName(more)))


SQL = {
    "op13_chat_format": r"""
        WITH given AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -1, n, r, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(n, r)),
             placed AS (SELECT *, row_number() OVER w AS p, coalesce(lag(role) OVER w, 'start') AS before, lead(role) OVER w IS NULL AS ends FROM given
                        WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
             marked AS (SELECT *, CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
                                            ELSE 21 + length(role) + len(regexp_extract_all(role, '<\\*s>|<\\*/s>|\[\\*(/?SYS|/?INST|OUT|/?ROLE|:)\]')) END
                        + length(text) + len(regexp_extract_all(text, '<\\*s>|<\\*/s>|\[\\*(/?SYS|/?INST|OUT|/?ROLE|:)\]')) AS chars FROM placed)
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY p)) AS turns_sha256,
               coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY p) FILTER (role = 'assistant'), '')) AS loss_sha256,
               (3 + sum(chars))::bigint AS formatted_chars,
               bool_and((before || '>' || role) IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AND (NOT ends OR role = 'assistant')) AS valid
        FROM marked GROUP BY conv_id""",
}
QUERIES = {"op13_chat_format": op13_chat_format}
