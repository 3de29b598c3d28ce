"""Periodic runs of words: every stretch that repeats itself at least `EXPONENT` times, found over whole texts.

A run is a stretch of consecutive words with smallest period q (words q apart are equal) that no neighbouring word extends keeping the period, of at
least max(LEAST, EXPONENT * q) words. In it, the positions i with word i = word i + q make a stretch of 3 q and more, so one of them is a
multiple of 3 q: for every q these grid points are the candidates, n ln n of them over a text (a harmonic sum). Those
with equal words are extended both ways by a grammar that recompression builds (recompression.py), exactly. Equal stretches found
with several periods are one run, whose smallest period is kept.

The texts of an Arrow batch are handled together, set apart by symbols that occur once, at most GROUP words at a time unless a single text is
longer. Words are runs of anything but ASCII white space, compared as they are. Null and empty texts have no words and no runs.
Rows are handled alone, so repeated rows repeat their result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from terrapanel.llm.recompression import Grammar
from terrapanel.llm.secrets import bound

EXPONENT, LEAST = 4, 6
GRID = EXPONENT - 1
GROUP = 300_000
CANDIDATES = 1_000_000  # looked at in one go
RUN = StructType([StructField(n, LongType()) for n in ("start", "length", "period")])


def _joined(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of word numbers with a number of its own before, between and behind the texts; where each text begins."""
    known: dict[bytes, int] = {}
    parts, begins, at = [], [], 1
    for words in texts:
        begins.append(at)
        parts.append([known.setdefault(w, len(known)) for w in words])
        at += len(words) + 1
    sequence = np.empty(at, np.int64)
    sequence[0] = len(known)
    for k, (begin, part) in enumerate(zip(begins, parts), 1):
        sequence[begin : begin + len(part)] = part
        sequence[begin + len(part)] = len(known) + k
    return sequence, np.array(begins, np.int64)


def _candidates(sequence: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Grid points (position, period) whose word occurs again a period later, in portions."""
    most = np.where(sizes >= LEAST, sizes // EXPONENT, 0)
    text = np.repeat(np.arange(len(sizes)), most)
    q = np.arange(len(text)) - np.repeat(np.cumsum(most) - most, most) + 1
    count = -(-(sizes[text] - q) // (GRID * q))
    done = np.cumsum(count)
    start = 0
    while start < len(q):
        before = done[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(done, before + CANDIDATES, "right")))
        c = count[start:stop]
        which = np.repeat(np.arange(start, stop), c)
        k = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        i = begins[text[which]] + GRID * q[which] * k
        same = sequence[i] == sequence[i + q[which]]
        yield i[same], q[which[same]]
        start = stop


def runs(texts: list[list[bytes]]) -> list[np.ndarray]:
    """For each text, its runs as rows (start, length, period), by start, then period."""
    sequence, begins = _joined(texts)
    sizes = np.array([len(w) for w in texts], np.int64)
    grammar, found = Grammar(sequence), [np.zeros((0, 3), np.int64)]
    for i, q in _candidates(sequence, begins, sizes):
        ahead, behind = grammar.extend(i, i + q), grammar.extend(i, i + q, ahead=False)
        enough = ahead + behind >= np.maximum(GRID * q, LEAST - q)
        found.append(np.stack([i - behind, behind + ahead + q, q], axis=1)[enough])
    return _per_text(np.concatenate(found), begins, len(texts))


def _per_text(found: np.ndarray, begins: np.ndarray, count: int) -> list[np.ndarray]:
    """Distinct stretches with their smallest period, by text."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    text = np.searchsorted(begins, found[:, 0], "right") - 1
    found[:, 0] -= begins[text]
    return np.split(found, np.searchsorted(text, np.arange(1, count))) if count else []


def collapsed(words: list[bytes], found: np.ndarray) -> bytes:
    """The words joined by one space, without those that a run holds after its first period."""
    if not len(found):
        return b" ".join(words)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, found[:, 0] + found[:, 2], 1)
    np.add.at(edges, found[:, 0] + found[:, 1], -1)
    return b" ".join([words[k] for k in np.flatnonzero(np.cumsum(edges)[:-1] == 0).tolist()])


def _grouped(texts: Iterator[bytes]) -> Iterator[list[list[bytes]]]:
    group, size = [], 0
    for text in texts:
        words = text.split()
        if group and size + len(words) > GROUP:
            yield group
            group, size = [], 0
        group.append(words)
        size += len(words)
    if group:
        yield group


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.struct([(n, pa.int64()) for n in RUN.names])
    for batch in batches:
        at = 0
        for group in _grouped(t.as_py() or b"" for t in batch["text"].cast(pa.binary())):
            found = runs(group)
            rows = np.concatenate(found)
            values = pa.StructArray.from_arrays([pa.array(rows[:, k]) for k in range(3)], fields=list(kind))
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])])
            texts = pa.array([collapsed(w, f) for w, f in zip(group, found)], pa.binary()).cast(pa.string())
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
            sizes = pa.array([len(w) for w in group], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"].slice(at, len(group)), sizes, lists, texts], ["doc_id", "n_words", "runs", "collapsed"]
            )
            at += len(group)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: its runs by start, then period, and the text without their repetitions.
    Other columns are not carried, so their names cannot clash."""
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fields = [StructField("n_words", LongType()), StructField("runs", ArrayType(RUN)), StructField("collapsed", StringType())]
    return plain.mapInArrow(_found, StructType([plain.schema["doc_id"], *fields]))


def with_planted_periods(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text), where a tenth of the texts, chosen by the checksum of their ids, repeats a stretch to its end. A null id
    counts as its empty text; null texts and texts without words stay."""
    text = F.col(text_col).cast("string")
    h = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    g = F.floor(h / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        first = (g % n).cast("int")
        period = (1 + F.floor((n - first) / (3 + g % 8))).cast("int")
        origin = lambda i: F.when(i < first, i).otherwise(first + (i - first) % period)
        places = F.sequence(F.lit(0), n - 1)
        return F.when(n == 0, text).otherwise(F.array_join(F.transform(places, lambda i: F.get(words, origin(i))), " "))

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.when((h % 10 == 0) & text.isNotNull(), bound(words, planted)).otherwise(text).alias("text"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    best = F.array_max(
        F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")))
    )
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[n].cast("string") for n in RUN.names]), F.lit("\n")))
    rows = found.select("doc_id", "runs", "collapsed", best.alias("best"))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
