"""Conversations as training text: columnar assembly of turns, control strings escaped, and a mask of the text to learn from.

A turn is ``opens + role + says + text + ends``. In roles and texts a backslash comes before every backslash and after the first
character of every control string, so that no marker can be found inside a text and reading is exact: of each run of
backslashes every second one stays.

A batch is assembled by columns: the escaped lengths of all segments give offsets by a running sum, each byte's place in the
output follows from its segment and the backslashes put in before it, and headers and contents are copied into one
preallocated buffer, which becomes an Arrow column. The loss mask is a list of spans in code points, one for each text of a
learned role.

Scale: rows are range-partitioned by conversation and turn, so that a conversation of any length is spread over as many tasks
as its share of the rows asks for. The result has a row a piece: most conversations are one piece, but one is cut, between
turns, where it exceeds ``PIECE`` bytes or where a partition ends. ``piece`` orders the pieces; ``whole`` tells that
there is only this one. Only conversations that may be cut go through a shuffle when digests are taken: SHA-256 needs a
conversation's bytes in order, so one task streams them and holds one batch at a time.

Defined cases: null texts and roles count as empty; a null conversation id is a conversation of its own, a null turn comes
first; turns alike are ordered by role and text, and rows alike in all are said as often as they stand; an empty table gives
no rows; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, materialize

#: Bytes of a piece before escaping, at most, but for a single longer turn; bytes whose places are computed at a time.
PIECE, STEP = 4 << 20, 1 << 20
SLASH = ord("\\")
FORMATTED = "conv_id long, piece long, whole boolean, n_turns long, formatted string, loss array<struct<start:long,end:long>>"
PROBE = "\\### Assistant: </turn> ok"


@dataclass(frozen=True)
class Template:
    """Markers of a turn. A marker's first character may stand only there in any marker, and no marker has a backslash."""

    opens: str = "<turn>"
    says: str = "<text>"
    ends: str = "</turn>"
    learned: tuple = ("assistant",)

    def __post_init__(self) -> None:
        firsts = {m[:1] for m in self.markers}
        if any(not m or "\\" in m or len(m) < 2 or firsts & set(m[1:]) for m in self.markers):
            raise ValueError("markers need two characters, no backslash, and their first characters only in front")

    @property
    def markers(self) -> tuple:
        return self.opens, self.says, self.ends

    def unescape(self, text: str) -> str:
        return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """The (role, text) of every turn."""
        turns = []
        *whole, rest = formatted.split(self.ends)
        if rest:
            raise ValueError("text after the last turn")
        for turn in whole:
            role, found, text = turn.removeprefix(self.opens).partition(self.says)
            if not found or not turn.startswith(self.opens):
                raise ValueError("a turn without its markers")
            turns.append((self.unescape(role), self.unescape(text)))
        return turns


def slashes(raw: np.ndarray, edges: np.ndarray, markers: tuple) -> np.ndarray:
    """Positions of ``raw`` before which a backslash comes, in order. ``edges``: where segments begin; a marker across one is none."""
    found = [np.flatnonzero(raw == SLASH)]
    for marker in markers:
        code = np.frombuffer(marker.encode(), np.uint8)
        at = np.flatnonzero(raw[: len(raw) - len(code) + 1] == code[0]) if len(raw) >= len(code) else np.zeros(0, np.int64)
        for k, c in enumerate(code[1:], 1):
            at = at[raw[at + k] == c]
        at = at[np.searchsorted(edges, at, "right") == np.searchsorted(edges, at + len(code) - 1, "right")]
        width = 1 if code[0] < 0x80 else len(marker[0].encode())
        found.append(at + width)
    return np.unique(np.concatenate(found))


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and len(data) else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def points(raw: np.ndarray) -> np.ndarray:
    """Marks of the bytes that begin a code point."""
    return (raw & 0xC0) != 0x80


def scatter(out: np.ndarray, raw: np.ndarray, starts: np.ndarray, shift: np.ndarray) -> None:
    """Copy ``raw`` to ``out``: the bytes from starts[i] on move by shift[i]."""
    for at in range(0, len(raw), STEP):
        to = min(at + STEP, len(raw))
        i, j = np.searchsorted(starts, at, "right") - 1, np.searchsorted(starts, to, "left")
        lengths = np.diff(np.append(np.maximum(starts[i:j], at), to))
        out[np.arange(at, to) + np.repeat(shift[i:j], lengths)] = raw[at:to]


def assemble(roles: pa.Array, texts: pa.Array, template: Template) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns in order; the byte offset and the code point offset of each turn and the code points of its text, (start, end)."""
    columns, n = [string_bytes(roles), string_bytes(texts)], len(roles)
    heads = [np.frombuffer(m.encode(), np.uint8) for m in template.markers]
    more = [slashes(raw, offsets, template.markers) for raw, offsets in columns]
    before = [np.searchsorted(s, offsets, "left") for s, (_, offsets) in zip(more, columns, strict=True)]
    # A turn's five segments: marker, role, marker, text, marker.
    size = np.zeros((n, 5), np.int64)
    size[:, 0::2] = [len(h) for h in heads]
    for k, ((_, offsets), b) in enumerate(zip(columns, before, strict=True)):
        size[:, 1 + 2 * k] = np.diff(offsets) + np.diff(b)
    place = np.concatenate(([0], np.cumsum(size)))
    out = np.full(int(place[-1]), SLASH, np.uint8)
    for k, head in enumerate(heads):
        out[place[2 * k : -1 : 5][:, None] + np.arange(len(head))] = head
    for k, ((raw, offsets), s, b) in enumerate(zip(columns, more, before, strict=True)):
        # Bytes move by their segment's place and by the backslashes before them in the segment.
        starts = np.concatenate([offsets[:-1], s])
        of = np.searchsorted(offsets, s, "right") - 1
        shift = np.concatenate([place[1 + 2 * k : -1 : 5] - offsets[:-1], place[1 + 2 * k : -1 : 5][of] - offsets[of] + np.arange(1, len(s) + 1) - b[of]])
        order = np.argsort(starts, kind="stable")
        scatter(out, raw, starts[order], shift[order])
    counted = np.concatenate(([0], np.cumsum(points(out))))
    return out, place[::5], counted[place[::5]], np.stack([counted[place[3:-1:5]], counted[place[4:-1:5]]], axis=1)


def format_conversations(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows of ``turns`` (conv_id, turn, role, text) as pieces: conv_id, piece, whole, n_turns, formatted, loss (spans in code points of ``formatted``)."""
    bounded_batches(turns.sparkSession)
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")

    def write(batches):
        base, number = TaskContext.get().partitionId() << 32, 0
        held: list[pa.RecordBatch] = []  # the turns of the last conversation, which may go on
        size, first, cut = 0, None, False  # first: a conversation that may have begun before

        def pieces(table: pa.Table, ends: bool):
            """Assemble ``table``; its last conversation may go on unless ``ends``."""
            nonlocal number, first, cut
            role, text = (table.column(c).combine_chunks() for c in ("role", "text"))
            raw, at, chars, spans = assemble(role, text, template)
            ids = table.column("conv_id").to_pylist()
            begins = [i for i in range(len(ids)) if not i or ids[i] != ids[i - 1]]
            cuts = np.array([*begins, len(ids)])
            offsets = at[cuts]
            formatted = pa.LargeStringArray.from_buffers(len(begins), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(raw))
            learned = np.array([r in template.learned for r in role.to_pylist()])
            of = np.searchsorted(cuts, np.flatnonzero(learned), "right") - 1
            spans = spans[learned] - chars[cuts[of]][:, None]
            loss = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(len(begins) + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"]))
            whole = np.ones(len(begins), bool)
            for k in range(len(begins)):
                name = ids[begins[k]]
                if first is None:
                    first = (name,)
                if (name,) == first or k == 0 and cut:
                    whole[k] = False
            whole[-1] &= ends
            cut = not ends
            order = base + number + np.arange(len(begins))
            number += len(begins)
            return pa.RecordBatch.from_arrays([pa.array([ids[b] for b in begins], pa.int64()), pa.array(order), pa.array(whole), pa.array(np.diff(cuts)), formatted.cast(pa.string()), loss], ["conv_id", "piece", "whole", "n_turns", "formatted", "loss"])

        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column(0).to_pylist()
            begins = [i for i in range(1, len(ids)) if ids[i] != ids[i - 1]]
            if held and held[-1].column(0)[-1].as_py() != ids[0]:
                yield pieces(pa.Table.from_batches(held), True)
                held, size = [], 0
            if len(begins):
                yield pieces(pa.Table.from_batches([*held, batch.slice(0, begins[-1])]), True)
                held, size, batch = [], 0, batch.slice(begins[-1])
            held.append(batch)
            size += batch.nbytes
            if size > PIECE:
                yield pieces(pa.Table.from_batches(held), False)
                held, size = [], 0
        if held:
            yield pieces(pa.Table.from_batches(held), False)

    return rows.mapInArrow(write, FORMATTED)


def turn_digests(pieces: DataFrame, template: Template = Template()) -> DataFrame:
    """Read ``pieces`` back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, a row a conversation.

    turns_sha256 is taken of role, line feed, text, line feed, turn by turn; loss_sha256 of the text under the mask, unescaped.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    types = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (f.split() for f in schema.split(", "))])

    def digest(batches):
        running = None  # conversation, turns, their hash, characters and hash under the mask, characters

        def result() -> dict:
            name, n, said, chars, loss, every = running
            return dict(zip(types.names, (name, n, said.hexdigest(), chars, loss.hexdigest(), every), strict=True))

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if running is None or running[0] != row["conv_id"]:
                    if running is not None:
                        out.append(result())
                    running = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                turns, formatted = template.parse(row["formatted"]), row["formatted"]
                if len(turns) != row["n_turns"]:
                    raise ValueError(f"conversation {row['conv_id']} has lost turns")
                learned = "".join(template.unescape(formatted[s["start"] : s["end"]]) for s in row["loss"])
                running[1] += len(turns)
                running[2].update("".join(f"{role}\n{text}\n" for role, text in turns).encode())
                running[3] += len(learned)
                running[4].update(learned.encode())
                running[5] += len(formatted)
            yield pa.RecordBatch.from_pylist(out, types)
        if running is not None:
            yield pa.RecordBatch.from_pylist([result()], types)

    bounded_batches(pieces.sparkSession)
    columns = ("conv_id", "formatted", "loss", "n_turns")
    alone = pieces.filter("whole").select(*columns).mapInArrow(digest, schema)
    parts = pieces.filter("NOT whole").repartition("conv_id").sortWithinPartitions("conv_id", "piece").select(*columns)
    return alone.unionAll(parts.mapInArrow(digest, schema))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], "conv_id long, turn long, role string, text string")
    return turn_digests(materialize(format_conversations(turns.unionByName(probe)), "chat"))


_T = Template()
_ESCAPES = " + ".join(f"(length({c}) - length(replace({c}, {m}, ''))) // {n}" for c in ("role", "x") for m, n in (("chr(92)", 1), *((f"'{k}'", len(k)) for k in _T.markers)))
OP13_SQL = f"""
WITH t AS (SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce("text", '') AS x FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{PROBE}'),
s AS (SELECT *, length(role) + length(x) + {sum(map(len, _T.markers))} + {_ESCAPES} AS chars FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || x || chr(10), '' ORDER BY turn NULLS FIRST, role, x)) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(x, '' ORDER BY turn NULLS FIRST, role, x) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""
