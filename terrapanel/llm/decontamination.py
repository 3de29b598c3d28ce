"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

Patterns are the windows of WINDOW consecutive words of an item; an item with fewer words, but not none, is one
window. For patterns of m words, blocks of two words (one, if m is 1) give shifts: a block that
ends j words before the end of some pattern allows a shift of the least such j, any other one a shift
past the whole block. Where the shift is 0, the bucket of that suffix block lists the patterns to
compare with the text. Patterns of different lengths have tables of their own, so that a
short item doesn't shorten the shifts of the others.

The items go to the tasks in blocks of a bounded size; the documents pass through one narrow step per block and
are never shuffled. Null or empty texts have no words; items without words and null item_ids match nothing.
Equal item_ids count once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrapanel.llm.words import alnum_words, texts
from terrapanel.llm.workers import tool

WINDOW = 10
BLOCK_BYTES = 4_000_000  # of item texts handed to the tasks at once

Pattern = tuple[bytes, ...]


class Matcher:
    """Patterns of one length."""

    def __init__(self, length: int, patterns: dict[Pattern, set[str]]):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.patterns = patterns
        self.shifts: dict[Pattern, int] = {}
        self.buckets: dict[Pattern, set[Pattern]] = defaultdict(set)
        for pattern in patterns:
            for end in range(self.block, length + 1):
                block = pattern[end - self.block : end]
                self.shifts[block] = min(self.shifts.get(block, self.far), length - end)
            self.buckets[pattern[-self.block :]].add(pattern)

    def ends(self, words: list[bytes]) -> Iterator[tuple[int, Pattern]]:
        """End of each occurrence, exclusive, with its pattern."""
        at, size, far, wide = self.length, len(words), self.far, self.block == 2
        shift = self.shifts.get
        while at <= size:
            block = (words[at - 2], words[at - 1]) if wide else (words[at - 1],)
            step = shift(block, far)
            if step:
                at += step
                continue
            window = tuple(words[at - self.length : at])
            if window in self.buckets[block]:
                yield at, window
            at += 1


def matchers(items: list[tuple[str, bytes]], window: int) -> list[Matcher]:
    by_length: dict[int, dict[Pattern, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item_id, text in items:
        words = alnum_words(text)
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            by_length[length][tuple(words[start : start + length])].add(item_id)
    return [Matcher(length, dict(patterns)) for length, patterns in sorted(by_length.items())]


def occurrences(words: list[bytes], tables: list[Matcher], spans: list, items: set[str]) -> list[list[int]]:
    """Merged word ranges that some window covers, together with earlier ranges; adds the items to `items`."""
    spans = [list(s) for s in spans]
    for table in tables:
        for end, pattern in table.ends(words):
            items |= table.patterns[pattern]
            start = end - table.length
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1][1] = max(end, spans[-1][1])
            else:
                spans.append([start, end])
    spans.sort()
    merged: list[list[int]] = []
    for start, end in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def _tables(shared: Broadcast, window: int) -> list[Matcher]:
    """Built once in each Python worker; one block at a time is kept."""
    name, items = shared.value
    return tool(("matchers", name, window), lambda: matchers(items, window))


FOUND = pa.schema(
    [
        ("n_words", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))),
        ("items", pa.list_(pa.string())),
    ]
)


def _scanner(shared: Broadcast, window: int, first: bool, last: bool) -> Callable:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = _tables(shared, window)
        for batch in batches:
            earlier = [None] * len(batch) if first else zip(batch["spans"].to_pylist(), batch["items"].to_pylist())
            counts, spans, items = [], [], []
            for text, before in zip(texts(batch), earlier):
                words = alnum_words(text)
                named = set(before[1]) if before else set()
                ranges = occurrences(words, tables, [(s["start"], s["stop"]) for s in before[0]] if before else [], named)
                counts.append(len(words))
                spans.append([{"start": a, "stop": b} for a, b in ranges])
                items.append(sorted(named))
            found = [pa.array(v, f.type) for v, f in zip((counts, spans, items), FOUND)]
            kept = ["doc_id"] if last else ["doc_id", "text"]
            yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + found, kept + FOUND.names)

    return scan


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(doc_id, n_words, spans, items) per document: merged word ranges inside a window's occurrence, and the sorted
    ids of the items with one. Other columns are not carried. Collects the items block by block."""
    session = docs.sparkSession
    items = benchmark.select(
        F.col(item_id_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")
    ).where("item IS NOT NULL AND text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    frame = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = StructType.fromDDL("n_words long, spans array<struct<start:int,stop:int>>, items array<string>").fields
    for k in range(blocks):
        rows = [(r.item, r.text.encode()) for r in dealt.where(F.col("block") == k).collect()]
        shared = session.sparkContext.broadcast((f"{id(dealt)}-{k}-{len(rows)}-{hash(tuple(rows))}", rows))
        last = k == blocks - 1
        kept = [frame.schema[c] for c in (("doc_id",) if last else ("doc_id", "text"))]
        frame = frame.mapInArrow(_scanner(shared, window, k == 0, last), StructType(kept + found))
    return frame


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows without any occurrence of a window, all columns kept."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).alias("text"))
    return contamination(rows, benchmark, id_col="row").where(F.size("spans") == 0).select("doc_id.*")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )
