"""Quality rules: compression bands. A document is rejected if zstandard makes it, or too much of it in fixed chunks,
smaller or larger than texts of that length usually get.

The ratio is compressed bytes to bytes, at level LEVEL without a dictionary. It falls with length, so the limits do as well:
BANDS lists them by length. Under the lower limit a text is repetitive, over the upper one it is incompressible (keys, encoded data,
noise). Chunks of CHUNK bytes are held to the band of their own length; the rest after the last whole chunk counts if
it has a quarter of a chunk. A document is rejected once more than CHUNK_SHARE of its chunks' bytes lie
outside, in either direction, as a long text can hide either in a usual ratio.

Beside the verdict, plain counts of words, characters, symbols, repeated lines and repeated word windows, and a base rule on them. Words are
runs of anything but ASCII white space, lines are split at \\n. Null and empty texts have no words and no ratio; they
fail the base rule. Rows are handled alone: repeated rows repeat their result. Texts are measured whole.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

LEVEL = 3
CHUNK = 4096
CHUNK_SHARE = 0.25
LEAST_WORDS, MOST_REPEATED = 20, 30  # the base rule: words, and percent of words in repeated windows
WINDOW = 8


@dataclass(frozen=True)
class Band:
    """Limits of the ratio for texts of less than `below` bytes."""

    below: float
    least: float
    most: float


# Fixed values. Prose of several languages lies at 0.57 to 0.88 under 200 bytes, 0.48 to 0.71 under 1,600, 0.43 to 0.55 under
# 6,400 and 0.33 to 0.46 above; random base64 at 0.76 and more at any length.
BANDS = (
    Band(100, 0.45, float("inf")),  # the format's own bytes weigh too much
    Band(200, 0.45, 1.05),
    Band(400, 0.42, 0.92),
    Band(800, 0.38, 0.80),
    Band(1_600, 0.34, 0.74),
    Band(6_400, 0.30, 0.68),
    Band(51_200, 0.27, 0.64),
    Band(float("inf"), 0.22, 0.64),
)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def band(size: int) -> Band:
    return next(b for b in BANDS if size < b.below)


def verdict(size: int, ratio: float) -> str:
    """'repetitive', 'incompressible' or '' for bytes of that size and ratio."""
    limits = band(size)
    return "repetitive" if ratio < limits.least else "incompressible" if ratio > limits.most else ""


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words within windows that occur twice or more, the first occurrence included."""
    if len(words) <= window:
        return 0
    hashes = np.fromiter(map(hash, words), np.int64, len(words)).astype(np.uint64)
    count = len(words) - window + 1
    mixed = np.zeros(count, np.uint64)
    for k in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + hashes[k : k + count]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    alike = np.zeros(count, bool)
    alike[order[1:][same]] = alike[order[:-1][same]] = True
    # equal hashes are confirmed by the words
    held = {i: tuple(words[i : i + window]) for i in np.flatnonzero(alike).tolist()}
    often = Counter(held.values())
    edges = np.zeros(len(words) + 1, np.int64)
    for i, key in held.items():
        if often[key] > 1:
            edges[i] += 1
            edges[i + window] -= 1
    return int(np.count_nonzero(np.cumsum(edges)[:-1]))


def counts(text: bytes) -> tuple[int, int, int, int, int]:
    """Words, their code points, symbols, lines equal to an earlier line, words in repeated windows."""
    data = np.frombuffer(text, np.uint8)
    space = _SPACE[data]
    chars = int(np.count_nonzero(~space & ((data & 0xC0) != 0x80)))
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    return len(words), chars, int(np.count_nonzero(_SYMBOL[data])), len(lines) - len(set(lines)), repeated_words(words)


class Compressor:
    """Ratios of whole texts and their chunks."""

    def __init__(self, chunk: int = CHUNK):
        self.chunk, self.zstd = chunk, zstandard.ZstdCompressor(level=LEVEL)

    def ratio(self, data: bytes) -> float:
        return len(self.zstd.compress(data)) / len(data)

    def judged(self, text: bytes) -> tuple[float | None, float, str]:
        """Ratio of the whole text, share of chunk bytes outside their band, and the reason of a rejection or ''."""
        if not text:
            return None, 0.0, ""
        ratio = self.ratio(text)
        outside: Counter[str] = Counter()
        total = 0
        if len(text) > self.chunk:
            for start in range(0, len(text), self.chunk):
                piece = text[start : start + self.chunk]
                if 4 * len(piece) >= self.chunk:
                    total += len(piece)
                    outside[verdict(len(piece), self.ratio(piece))] += len(piece)
        del outside[""]
        share = sum(outside.values()) / total if total else 0.0
        reason = verdict(len(text), ratio)
        if not reason and share > CHUNK_SHARE:
            reason = max(sorted(outside), key=outside.__getitem__) + " in parts"
        return ratio, share, reason


MEASURES = (
    ("n_words", LongType()),
    ("word_chars", LongType()),
    ("n_symbols", LongType()),
    ("n_dup_lines", LongType()),
    ("n_repeat_words", LongType()),
    ("ratio", DoubleType()),
    ("outside_share", DoubleType()),
    ("reason", StringType()),
    ("base_failed", BooleanType()),
    ("kept", BooleanType()),
)


def measured(text: bytes, compressor: Compressor) -> tuple:
    """MEASURES of one text."""
    found = counts(text)
    ratio, share, reason = compressor.judged(text)
    failed = found[0] < LEAST_WORDS or 100 * found[4] > MOST_REPEATED * found[0]
    return (*found, ratio, share, reason, failed, not failed and not reason)


def _measured(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    compressor = Compressor(chunk)
    types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.string()] + [pa.bool_()] * 2
    for batch in batches:
        rows = [measured(t.as_py() or b"", compressor) for t in batch["text"].cast(pa.binary())]
        columns = list(zip(*rows)) if rows else [()] * len(MEASURES)
        arrays = [pa.array(c, t) for c, t in zip(columns, types)]
        kept = [n for n in batch.schema.names if n != "text"]
        yield pa.RecordBatch.from_arrays([*[batch[n] for n in kept], *arrays], [*kept, *[n for n, _ in MEASURES]])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """(doc_id, MEASURES) of every row. Other columns are not carried, so their names cannot clash."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([plain.schema["doc_id"], *[StructField(n, t) for n, t in MEASURES]])
    return plain.mapInArrow(lambda batches: _measured(batches, chunk), schema)


def clean(docs: DataFrame, text_col: str = "text", chunk: int = CHUNK) -> DataFrame:
    """The rows that are kept, all columns as they were."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text_col).cast("string").alias("text"))
    schema = StructType([rows.schema["row"], *[StructField(n, t) for n, t in MEASURES]])
    return rows.mapInArrow(lambda batches: _measured(batches, chunk), schema).where("kept").select("row.*")
