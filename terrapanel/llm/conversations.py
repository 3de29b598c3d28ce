"""Conversation repair: faults of each row, and the cheapest edits that make turns alternate (survivors.py).

Rows of a conversation are taken by turn (nulls first), then role, then text; equal rows are copies of each other. A row's first fault counts: blank
(nothing but white space), duplicate (role and text seen earlier in the conversation), truncated (last character that is no white space is
none of `.!?`). Blank and duplicate rows are deleted.

How it is spread: copies of a row are counted before they are exchanged, and the first turn of each role and text of a conversation comes from
an aggregate over their hashes. Rows are then sorted over ranges of (conversation, turn, role, beginning of the text), so a
conversation of any size is sorted by many tasks. A conversation that begins and ends inside a range is searched there. Those
that reach a range's border, two for each range beside the inner ranges of a very long one, are packed into records of many rows, brought together in order and
searched as a stream, holding the undecided edits only. The hash over a whole repaired conversation has to be one such stream.

Null ids are a conversation of their own; null roles and texts are one space, turns that are no numbers are null. A conversation without rows
has no edits. Clashing column names don't matter, as other columns are not carried.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from terrapanel.llm.survivors import Search
from terrapanel.session import staged

RECORD_ROWS, RECORD_CHARS = 500, 500_000  # of a record of packed rows
EDGE_CHARS = 32  # of a text that ranges are told apart by
OUT_ROWS = 2_000

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = StructType(
    [StructField(n, LongType()) for n in COUNTS] + [StructField(n, StringType()) for n in ("audit", "repaired_sha256")]
)
EDIT = StructType(
    [
        StructField("place", LongType()),
        StructField("edit", StringType()),
        StructField("role", StringType()),
        StructField("text", StringType()),
    ]
)
ROW = StructType(
    [
        StructField("turn", LongType()),
        StructField("role", StringType()),
        StructField("text", StringType()),
        StructField("seen", BooleanType()),
        StructField("copies", LongType()),
    ]
)

_VISIBLE = re.compile(r"[^\x20\x09-\x0D]")
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): rows dropped (no copies), emptied, robbed of their stops, repeated or given to the user, as the
    checksum of conv_id and turn says."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(said[0], F.lit(":"), said[1])) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said[3], "[.!?]", "")).otherwise(said[3])
    return rows.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(said[2]).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _ordered(rows: DataFrame) -> DataFrame:
    """Distinct rows with their copies and whether their role and text were seen before, sorted within ranges."""
    copies = F.col("copies").cast("long") if "copies" in rows.columns else F.lit(1).cast("long")
    there = copies > 0
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    plain = rows.select(
        "conv_id",
        F.when(there, F.col("turn").cast("string").try_cast("long")).alias("turn"),
        F.when(there, role).alias("role"),
        F.when(there, text).alias("text"),
        copies.alias("copies"),
    )
    content = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    counted = staged(
        plain.withColumn("content", F.unhex(content))
        .groupBy("conv_id", "turn", "content")
        .agg(F.max(F.struct("role", "text")).alias("said"), F.sum("copies").alias("copies"))
        .select("conv_id", "turn", "content", "said.role", "said.text", "copies"),
        "counted_turns",
    )
    first = (
        counted.where("content IS NOT NULL")
        .groupBy(F.col("conv_id").alias("_conv"), F.col("content").alias("_content"))
        .agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("turns"))
        .where("turns > 1")  # few, so that most rows find no partner
    )
    joined = counted.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("content") == F.col("_content")), "left")
    seen = F.col("first").isNotNull() & ~F.col("first.turn").eqNullSafe(F.col("turn"))
    return (
        joined.select("conv_id", "turn", "role", "text", seen.alias("seen"), "copies")
        .repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, EDGE_CHARS))
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )


class Conversation:
    """Takes the rows of one conversation in order; keeps counts, edits or the hash of the repaired turns."""

    def __init__(self, edits: bool):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.places = 0
        self.low = self.high = self.initial = None
        self.letters: list[str] = []
        self.edits: list[tuple] | None = [] if edits else None
        self.hash, self.any = hashlib.sha256(), False
        self.search = Search(self._emit)

    def _emit(self, letters: str, role: str | None, text: str | None) -> None:
        if self.edits is not None:
            for letter in letters:
                self.edits.append((self.places, letter, role, text))
                self.places += 1
            return
        self.letters.append(letters)
        if role is not None:
            self.hash.update((("\n" if self.any else "") + role + ":" + text).encode())
            self.any = True

    def add(self, turn: int | None, role: str | None, text: str | None, seen: bool, copies: int) -> None:
        if copies <= 0:
            return
        if turn is not None and turn != self.high:
            self.low, self.high = turn if self.low is None else self.low, turn
            self.turns += 1
        initial = role[:1]
        if self.initial is not None:
            self.illegal += self.initial + initial not in ("su", "ua", "au")
        self.illegal += copies - 1  # no initial may follow itself
        self.initial = initial
        if not _VISIBLE.search(text):
            self.blank += copies
            self.search.delete(copies)
            return
        repeats = copies if seen else copies - 1
        self.duplicate += repeats
        if not seen:
            cut = text.rstrip(_SPACE)[-1] not in ".!?"
            self.truncated += cut
            self.search.row(role, text, cut)
        self.search.delete(repeats)

    def taken(self) -> list[tuple]:
        """The edits decided since the last call."""
        done, self.edits = self.edits, []
        return done

    def summary(self) -> tuple:
        cost = self.search.finish()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        audit = "".join(self.letters)
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit, self.hash.hexdigest()


class _Output:
    """Collects rows (id, values…) into record batches of a bounded size."""

    def __init__(self, names: list[str], types: list[pa.DataType]):
        self.names, self.types = names, types
        self.rows: list[tuple] = []
        self.size = 0

    def add(self, row: tuple, size: int = 0) -> None:
        self.rows.append(row)
        self.size += size

    def full(self) -> bool:
        return len(self.rows) >= OUT_ROWS or self.size >= 4 * RECORD_CHARS

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) if self.rows else [()] * len(self.names)
        self.rows, self.size = [], 0
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, self.types)], self.names)


def _results(conv, work: Conversation, edits: bool, last: bool) -> Iterator[tuple]:
    if edits:
        if last:
            work.search.finish()
        for edit in work.taken():
            yield (conv, *edit)
    elif last:
        yield (conv, *work.summary())


def _searched_in_ranges(batches: Iterator[pa.RecordBatch], edits: bool, names: list[str], types: list[pa.DataType]):
    """Results of the conversations inside a range, and packed rows of the first and the last one."""
    task, out = TaskContext.get().partitionId(), _Output(names, types)
    blank = (None,) * (len(names) - 4)
    records = 0

    def packed(conv, rows: list[tuple]) -> tuple:
        nonlocal records
        records += 1
        return (conv, *blank, task, records, [dict(zip(ROW.names, r)) for r in rows])

    conv, work, rows, size, first = None, None, [], 0, True
    started = False
    for batch in batches:
        ids = batch["conv_id"].to_pylist()
        columns = [batch[n].to_pylist() for n in ROW.names]
        for new, *row in zip(ids, *columns):
            if not started or new != conv:
                if started:
                    if first:  # may have begun in the range before
                        out.add(packed(conv, rows), size)
                    else:
                        for held in rows:
                            work.add(*held)
                        for result in _results(conv, work, edits, True):
                            out.add((*result, None, None, None), size)
                    first = False
                conv, started, rows, size = new, True, [], 0
                work = Conversation(edits)
            elif len(rows) >= RECORD_ROWS or size >= RECORD_CHARS:
                # a long conversation is packed as well, as it may go on in the next range
                out.add(packed(conv, rows), size)
                rows, size, first = [], 0, True
            rows.append(tuple(row))
            size += len(row[2] or "")
            if out.full():
                yield out.batch()
    if started:
        out.add(packed(conv, rows))
    yield out.batch()


def _searched_in_order(batches: Iterator[pa.RecordBatch], edits: bool, names: list[str], types: list[pa.DataType]):
    """Results of conversations whose records come in order."""
    out = _Output(names, types)
    conv, work = None, None
    for batch in batches:
        for new, rows in zip(batch["conv_id"].to_pylist(), batch["rows"]):
            if work is None or new != conv:
                if work is not None:
                    for result in _results(conv, work, edits, True):
                        out.add(result)
                conv, work = new, Conversation(edits)
            for row in rows.as_py():
                work.add(*[row[n] for n in ROW.names])
            for result in _results(conv, work, edits, False):
                out.add(result)
            if out.full():
                yield out.batch()
    if work is not None:
        for result in _results(conv, work, edits, True):
            out.add(result)
    yield out.batch()


def _searched(rows: DataFrame, edits: bool) -> DataFrame:
    ordered = _ordered(rows)
    result = EDIT if edits else SUMMARY
    done = StructType([ordered.schema["conv_id"], *result.fields])
    more = [StructField("task", IntegerType()), StructField("record", IntegerType()), StructField("rows", ArrayType(ROW))]
    both = StructType([*done.fields, *more])

    def types(schema: StructType) -> list[pa.DataType]:
        return [to_arrow_type(f.dataType) for f in schema.fields]

    ranges = staged(
        ordered.mapInArrow(lambda b: _searched_in_ranges(b, edits, both.names, types(both)), both), "searched_ranges"
    )
    parts = (
        ranges.where("rows IS NOT NULL")
        .select("conv_id", "task", "record", "rows")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "task", "record")
    )
    rest = parts.mapInArrow(lambda b: _searched_in_order(b, edits, done.names, types(done)), done)
    return ranges.where("rows IS NULL").select(*done.names).unionByName(rest)


def repaired(rows: DataFrame) -> DataFrame:
    """One row per conversation: (conv_id, COUNTS, audit, repaired_sha256). `rows` has conv_id, turn, role, text and maybe copies; rows with no
    copies only name their conversation."""
    return _searched(rows, edits=False)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The edits themselves: (conv_id, place, edit, role, text), with role and text of what stays or comes in."""
    return _searched(rows, edits=True)


def digest(found: DataFrame) -> DataFrame:
    return found.select("conv_id", *COUNTS, "audit", "repaired_sha256")
