"""Language-model scoring of whole texts: context-tree weighting, beside smoothed word counts.

Learns from all texts but the held-out ones; A-Z are lower-cased. Spark counts every gram (context and next byte)
of all texts, and how many of them are in training texts; the subtree of each context of NEAR bytes is built from its grams in one
group, which answers for all its grams at once, the held-out texts' ones too. The trunk above is built from at most 256 * 255 sums and
completes these answers. So the tree is searched once for each distinct gram, not for each text.

A text's score is the sum over its grams. The answers of the most frequent grams (a bounded number) are broadcast and summed inside the
tasks, in one pass over the texts; all others are joined by gram. More contexts mean more joined grams, not a larger broadcast
or another pass.

Word counts are joined by word. The most frequent words (a bounded number of bounded length) are
broadcast and summed inside the tasks, so that no hot word is shuffled with its occurrences; all others are
joined. Null counts as empty text: it has the end token, and the closing byte. Rows with equal texts share their sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm import context_tree as tree
from terrapanel.llm.words import LOWER, space_words, texts
from terrapanel.session import staged

BLOCK_NODES = 1_000_000  # grams whose answers are broadcast: 16 MB in a Python worker, and for a moment on the driver
CLASSES = 8  # of gram frequencies for each doubling
FREQUENT = 100_000
FREQUENT_BYTES = 64
KEPT = 1_000_000  # counts that a task holds before it hands them on


def held_out(doc_id: Column) -> Column:
    """A null id counts as its empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7 == 2


# -- counting --------------------------------------------------------------------------------


def _chunks(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(grams, row of each gram) of texts, in pieces of bounded size."""
    parts, owners, size = [], [], 0
    for row, text in rows:
        for part in tree.segments(text.translate(LOWER)):
            parts.append(part)
            owners.append(row)
            size += len(part)
            if size >= tree.CHUNK:
                yield tree.grams(parts), np.repeat(owners, [len(p) - tree.DEPTH for p in parts])
                parts, owners, size = [], [], 0
    if parts:
        yield tree.grams(parts), np.repeat(owners, [len(p) - tree.DEPTH for p in parts])


def _merged(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums by gram, of (ascending grams, counts)."""
    codes, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(codes, kind="stable")  # quick for runs
    codes, counts = codes[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.add.reduceat(counts, first)


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram, n, seen): how often in training texts, and in all. A gram may come in several rows."""
    held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {True: [], False: []}

    def emitted(learnt: bool) -> pa.RecordBatch:
        codes, counts = _merged(held[learnt])
        held[learnt].clear()
        n = counts if learnt else np.zeros_like(counts)
        return pa.RecordBatch.from_arrays([pa.array(codes.view(np.int64)), pa.array(n), pa.array(counts)], ["gram", "n", "seen"])

    for batch in batches:
        learns = batch["learnt"].to_pylist()
        for learnt, parts in held.items():
            for codes, _ in _chunks((0, text) for text, x in zip(texts(batch), learns) if x == learnt):
                parts.append(np.unique(codes, return_counts=True))
                if len(parts) > 8:
                    parts[:] = [_merged(parts)]
                    if len(parts[0][0]) > KEPT:
                        yield emitted(learnt)
    for learnt, parts in held.items():
        if parts:
            yield emitted(learnt)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def emitted() -> pa.RecordBatch:
        columns = [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())]
        counts.clear()
        return pa.RecordBatch.from_arrays(columns, ["word", "n"])

    for batch in batches:
        for text in texts(batch):
            counts.update(space_words(text))
            if len(counts) > KEPT // 4:
                yield emitted()
    if counts:
        yield emitted()


def word_counts(training: DataFrame) -> DataFrame:
    """(word, n) over all texts; words as UTF-8."""
    return (
        training.select("text").mapInArrow(_word_counts, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    )


# -- the context tree ------------------------------------------------------------------------

ODDS = [f"odds{k}" for k in range(8)]
# rows of two kinds: a gram with the log odds of its eight decisions, or (top) a node at NEAR
ANSWERS = f"gram long, seen long, {', '.join(f'{c} double' for c in ODDS)}, top boolean, a double, b double, log_total double"


def _answered(group: pa.Table) -> pa.Table:
    """The answers of a near context's subtree for all its grams, and the sums of its first nodes."""
    codes = group["gram"].to_numpy().view(np.uint64)
    order = np.argsort(codes)
    codes, counts, seen = codes[order], group["n"].to_numpy()[order].astype(np.float64), group["seen"].to_numpy()[order]
    learnt = counts > 0
    found, keys, sums = [], np.zeros(0, np.uint64), [np.zeros(0)] * 3
    if learnt.any():
        levels, (keys, *sums) = tree.subtree(codes[learnt], counts[learnt])
        above = np.unique(tree.parent(keys, tree.NEAR))
        odds, _ = tree.answers(levels, tree.NEAR, tree.Path(above, np.zeros(len(above)), np.ones(len(above))))
        found = [(np.zeros(0, np.uint64), np.zeros(0))] * tree.NEAR + [(x.keys, o) for x, o in zip(levels, odds)]
    below = list(tree.odds_of(codes, found))
    many, top = len(codes), len(keys)
    nothing = np.zeros(top)
    columns = [np.concatenate([codes, keys]).view(np.int64), np.concatenate([seen, nothing.astype(np.int64)])]
    columns += [np.concatenate([o, nothing]) for o in below]
    columns += [np.arange(many + top) >= many, *(np.concatenate([np.zeros(many), x]) for x in sums)]
    return pa.table([pa.array(c) for c in columns], names=[c.split()[0] for c in ANSWERS.split(", ")])


def _completed(batches: Iterator[pa.RecordBatch], path: tree.Path, trunk: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        codes = batch["gram"].to_numpy().view(np.uint64)
        logs = tree.log10_below(codes, [batch[c].to_numpy() for c in ODDS], path, trunk)
        yield pa.RecordBatch.from_arrays([batch["gram"], batch["seen"], pa.array(logs)], ["gram", "seen", "log"])


def gram_logs(rows: DataFrame) -> DataFrame:
    """(gram, seen, log): of every gram of the texts in `rows` (text, learnt), how often it is seen, and the log10 probability of its last
    byte after the others, learnt from the rows marked so."""
    # the near context is the third and second lowest byte of a gram
    near = F.shiftright("gram", 8).bitwiseAND(F.lit(256**tree.NEAR - 1)).cast("int")
    grams = rows.select("text", "learnt").mapInArrow(_gram_counts, "gram long, n long, seen long")
    summed = grams.groupBy("gram").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).withColumn("near", near)
    answers = staged(summed.groupBy("near").applyInArrow(_answered, ANSWERS), "context_answers")
    above = F.col("gram").bitwiseAND(F.lit(256**tree.NEAR - 1))
    sums = (
        answers.where("top")
        .groupBy(above.alias("key"))
        .agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("log_total").alias("children"))
        .toPandas()
    )
    levels = tree.trunk(
        sums["key"].to_numpy(np.int64).view(np.uint64), *(sums[c].to_numpy(np.float64) for c in ("a", "b", "children"))
    )
    odds, path = tree.answers(levels)
    trunk = [(level.keys, found) for level, found in zip(levels, odds)]
    completed = answers.where("NOT top").select("gram", "seen", *ODDS)
    return staged(
        completed.mapInArrow(lambda batches: _completed(batches, path, trunk), "gram long, seen long, log double"), "gram_logs"
    )


def _frequency() -> Column:
    return F.floor(F.log2("seen") * CLASSES)


def _least_frequency(logs: DataFrame, most: int) -> int:
    """The frequency class from which on there are at most so many grams."""
    sizes = logs.groupBy(_frequency().alias("class")).agg(F.count("*").alias("n")).collect()  # CLASSES for each doubling
    least, held = 64 * CLASSES, 0
    for row in sorted(sizes, key=lambda r: -r["class"]):
        held += row.n
        if held > most:
            break
        least = row["class"]
    return least


def _shared_grams(logs: DataFrame, least: int) -> Broadcast:
    """(grams, log10 probabilities) of the frequent grams, ascending."""
    found = logs.where(_frequency() >= least).select("gram", "log").toArrow()
    keys = found["gram"].to_numpy().view(np.uint64)
    order = np.argsort(keys)
    return logs.sparkSession.sparkContext.broadcast((keys[order], found["log"].to_numpy()[order]))


def _name(text: bytes) -> bytes:
    """16 bytes that name a text; all sums depend on it alone."""
    return xxhash.xxh3_128_digest(text.translate(LOWER))


def _gram_sums(batch: pa.RecordBatch, known: tuple[np.ndarray, np.ndarray]) -> tuple[pa.Array, pa.Array]:
    """Of each text: the sum over its frequent grams (the closing byte's too), and a list of the other grams, each as often as it comes."""
    keys, logs = known
    total, rare, sizes = np.zeros(len(batch)), [np.zeros(0, np.int64)], np.zeros(len(batch), np.int64)
    for codes, owners in _chunks(enumerate(texts(batch))):
        place, distinct = pd.factorize(codes, sort=True)
        found, values = np.zeros(len(distinct), bool), np.zeros(len(distinct))
        if len(keys):
            at = np.minimum(np.searchsorted(keys, distinct), len(keys) - 1)
            found = keys[at] == distinct
            values = np.where(found, logs[at], 0.0)
        total += np.bincount(owners, weights=values[place], minlength=len(total))
        if not found.all():
            others = ~found[place]
            rare.append(codes[others].view(np.int64))
            sizes += np.bincount(owners[others], minlength=len(sizes))
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.array(total), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rare)))


# -- word counts -----------------------------------------------------------------------------


def _frequent_sums(batches: Iterator[pa.RecordBatch], shared: Broadcast, grams: Broadcast) -> Iterator[pa.RecordBatch]:
    """Of each text: its name, tokens, the sum over its frequent words of log10(c + 1), and see _gram_sums."""
    known = shared.value
    for batch in batches:
        names, n_tokens, n_known, sums = [], [], [], []
        for text in texts(batch):
            words = space_words(text)
            logs = [x for x in map(known.get, words) if x is not None]
            names.append(_name(text))
            n_tokens.append(len(words) + 1)
            n_known.append(len(logs))
            sums.append(math.fsum(logs))
        made = [pa.array(names, pa.binary()), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(sums)]
        made += _gram_sums(batch, grams.value)
        kept = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([batch[c] for c in kept] + made, [*kept, "name", "n_tokens", "n_known", "log_sum", "part", "grams"])


def _rare_words(batches: Iterator[pa.RecordBatch], shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(name, word, n) of the words that aren't frequent."""
    known = shared.value
    for batch in batches:
        names, words, counts = [], [], []

        def emitted(names=names, words=words, counts=counts) -> pa.RecordBatch:
            columns = [pa.array(names, pa.binary()), pa.array(words, pa.binary()), pa.array(counts, pa.int64())]
            for column in (names, words, counts):
                column.clear()
            return pa.RecordBatch.from_arrays(columns, ["name", "word", "n"])

        for text in texts(batch):
            rare = Counter(w for w in space_words(text) if w not in known)
            if rare:
                names += [_name(text)] * len(rare)
                words += rare
                counts += rare.values()
            if len(words) > 100_000:
                yield emitted()
        if words:
            yield emitted()


def _shared_frequent(counts: DataFrame, most: int) -> Broadcast:
    rows = counts.where(F.length("word") <= FREQUENT_BYTES).orderBy(F.desc("n"), "word").limit(most).collect()
    known = {bytes(r.word): math.log10(r.n + 1) for r in rows}
    return counts.sparkSession.sparkContext.broadcast(known)


def language_scores(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, block_nodes: int = BLOCK_NODES
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row. Other columns are not carried. Up to
    `block_nodes` grams' answers are broadcast.

    Writes the word counts, the grams' answers and the sums over frequent words and grams to the shared folder.
    """
    plain = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    training = plain.where(~held_out(F.col("doc_id")))
    counts = staged(word_counts(training), "word_counts")
    ends = training.count()
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    total, vocabulary = words + ends, distinct + (ends > 0)
    shared = _shared_frequent(counts, frequent)
    logs = gram_logs(plain.select("text", (~held_out(F.col("doc_id"))).alias("learnt")))
    least = _least_frequency(logs, block_nodes)
    grams = _shared_grams(logs, least)
    counted = staged(
        plain.mapInArrow(
            lambda batches: _frequent_sums(batches, shared, grams),
            f"doc_id {kind}, name binary, n_tokens long, n_known long, log_sum double, part double, grams array<long>",
        ),
        "frequent_sums",
    )
    grams.destroy()
    rare = (
        plain.select("text")
        .mapInArrow(lambda batches: _rare_words(batches, shared), "name binary, word binary, n long")
        .join(counts.select("word", F.col("n").alias("c")), "word")
        .groupBy("name")
        .agg(F.sum("n").alias("rare_known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("rare_sum"))
    )
    rare_grams = (
        counted.select("name", F.explode("grams").alias("gram"))
        .join(logs.where(_frequency() < least).select("gram", "log"), "gram")
        .groupBy("name")
        .agg(F.sum("log").alias("rare_part"))
    )
    copies = counted.groupBy("name").agg(F.count("*").alias("copies"), F.sum("part").alias("part"))
    sums = copies.join(rare_grams, "name", "left").join(rare, "name", "left").select(
        F.col("name").alias("of"),
        ((F.col("part") + F.coalesce("rare_part", F.lit(0.0))) / F.col("copies")).alias("score"),
        (F.col("rare_known") / F.col("copies")).cast("long").alias("rare_known"),
        (F.col("rare_sum") / F.col("copies")).alias("rare_sum"),
    )
    known = F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))
    log_sum = F.col("log_sum") + F.coalesce("rare_sum", F.lit(0.0)) + F.lit(math.log10(ends + 1))
    return counted.drop("grams").join(sums, F.col("name") == F.col("of")).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "n_tokens",
        known.cast("long").alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (log_sum - F.col("n_tokens") * math.log10(total + vocabulary + 1)).alias("base_score"),
        "score",
    )
