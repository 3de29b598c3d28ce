"""Winnowing fingerprints of texts, as DataFrame expressions only.

Tokens are lower-cased words; a character of a script that is written without spaces is a token of its own (ideographs, kana, hangul,
Thai, Lao, Khmer, Burmese, Tibetan), and so is each character of a run of more than LONG without white space (encoded data, minified
code). So the guarantee below counts words where there are words, and characters elsewhere. Every K consecutive tokens are one gram; gram hashes roll by doubling (a hash of 2n tokens from two of n). Of every W
consecutive grams the smallest hash is kept, the rightmost of equal ones, with its position. Two
texts that share K + W - 1 consecutive tokens share a fingerprint hash, and none shorter than K
tokens matches. In shorter texts, grams and windows are of the largest power of two that fits.

Null counts as empty text, which has an empty fingerprint; two empty fingerprints are alike (1.0).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.session import staged

K = 4
W = 8
POSITIONS = 31  # bits; the 32 bits above hold the hash
CELLS = 256
ROWS = 16384
LONG = 32
_SCRIPTS = "".join(
    rf"\p{{Is{script}}}" for script in "Ideographic Hiragana Katakana Hangul Thai Lao Khmer Myanmar Tibetan".split()
)
# All of them begin at U+0E00 or later, which is far quicker to ask first.
UNSPACED = rf"[\x{{0E00}}-\x{{10FFFF}}&&[{_SCRIPTS}]]"
TOKEN = rf"{UNSPACED}|[^\s{UNSPACED}]+"
RUN = rf"(?<!\S)\S{{{LONG + 1}}}"


def _doubled(values: Column, by: int, combine) -> Column:
    """Combine each value with the one `by` places on; the last ones go. Too few values stay as they are."""
    kept = F.greatest(F.size(values) - by, F.lit(1))
    return F.when(F.size(values) <= by, values).otherwise(
        F.zip_with(F.slice(values, 1, kept), F.slice(values, by + 1, kept), combine)
    )


def _stages(width: int) -> list[int]:
    """Steps that grow a window of 1 to `width`: each adds at most as much as there is."""
    steps, have = [], 1
    while have < width:
        steps.append(min(have, width - have))
        have += steps[-1]
    return steps


def with_fingerprint(frame: DataFrame, text: str, name: str) -> DataFrame:
    """Add `name`: ascending array of (position, hash) of the text's chosen grams."""
    column = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(F.lower(column), r"\s+"), lambda w: w != "")
    runs = F.regexp_extract_all(F.lower(column), F.lit(TOKEN), F.lit(0))

    def cut(tokens: Column) -> Column:
        return F.flatten(F.transform(tokens, lambda w: F.when(F.length(w) > LONG, F.split(w, "")).otherwise(F.array(w))))

    spaced = ~column.rlike(UNSPACED)
    tokens = F.when(spaced & ~column.rlike(RUN), words).when(spaced, cut(words)).otherwise(cut(runs))
    at = f"{name}__work"
    frame = frame.withColumn(at, F.transform(tokens, lambda w: F.xxhash64(w)))
    for by in _stages(K):
        frame = frame.withColumn(at, _doubled(F.col(at), by, lambda a, b: F.xxhash64(a, b)))
    low = F.lit(2**POSITIONS - 1)
    # one number orders by hash, then rightmost: hash above, the position counted from the far end below
    frame = frame.withColumn(
        at,
        F.transform(
            F.col(at),
            lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), POSITIONS).bitwiseOR(low - i.cast("long")),
        ),
    )
    for by in _stages(W):
        frame = frame.withColumn(at, _doubled(F.col(at), by, lambda a, b: F.least(a, b)))
    chosen = F.transform(
        F.array_distinct(F.col(at)),
        lambda key: F.struct(
            (low - key.bitwiseAND(low)).alias("position"), F.shiftright(key, POSITIONS).alias("hash")
        ),
    )
    return frame.withColumn(name, chosen).drop(at)


def written(fingerprint: Column) -> Column:
    """position:hash (hex) of each chosen gram, space-joined."""
    return F.array_join(
        F.transform(fingerprint, lambda p: F.concat(p["position"].cast("string"), F.lit(":"), F.hex(p["hash"]))), " "
    )


def hashes(fingerprint: Column) -> Column:
    return F.array_distinct(F.transform(fingerprint, lambda p: p["hash"]))


def likeness(one: Column, other: Column) -> Column:
    """Shared of all hashes, from two arrays of distinct ones."""
    shared = F.size(F.array_intersect(one, other))
    either = F.size(one) + F.size(other) - shared
    return F.when(either == 0, F.lit(1.0)).otherwise(shared / either)


def dealt_by_range(docs: DataFrame) -> DataFrame:
    """(doc_id, text, cell, part, guest): rows by range of doc_id, so that one exchange brings each to its next.

    A fixed number of cells at the quantiles of doc_id (nulls before them), cells of many rows cut into equal widths.
    A range's first rows also go, as guests, to the last range before it that has rows; the first range's to
    the last. The driver receives the quantiles and one row per cell.
    """
    total, quantiles = docs.agg(
        F.count("*"), F.percentile_approx("doc_id", [i / CELLS for i in range(CELLS + 1)])
    ).first()
    edges = sorted(set(quantiles or []))
    parts = max(1, math.ceil(total / CELLS / ROWS))
    ordered = docs.withColumn("cell", _cell(F.col("doc_id"), edges)).withColumn("part", _part(edges, parts))
    firsts = ordered.groupBy("cell", "part").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    # previous range: in its cell, or else the last of the previous cell that has rows
    in_cell = Window.partitionBy("cell").orderBy("part")
    ends = [tuple(r) for r in firsts.groupBy("cell").agg(F.max("part").alias("part")).orderBy("cell").collect()]
    back = {cell: ends[i - 1] for i, (cell, _) in enumerate(ends)}
    cells = docs.sparkSession.createDataFrame(
        [(cell, to_cell, to_part) for cell, (to_cell, to_part) in back.items()],
        "cell int, last_cell int, last_part bigint",
    )
    guests = (
        firsts.withColumn("earlier", F.lag("part").over(in_cell))
        .join(cells, "cell")
        .select(
            F.col("cell").alias("own_cell"),
            F.col("part").alias("own_part"),
            "first",
            F.when(F.col("earlier").isNull(), F.col("last_cell")).otherwise(F.col("cell")).alias("to_cell"),
            F.coalesce("earlier", "last_part").alias("to_part"),
        )
    )
    # stored, so that the join knows its size and mostly needs no exchange of the texts
    placed = ordered.join(
        staged(guests, "range_starts"),
        (F.col("cell") == F.col("own_cell"))
        & (F.col("part") == F.col("own_part"))
        & F.col("doc_id").eqNullSafe(F.col("first")),
        "left",
    )
    own = F.struct(F.col("cell"), F.col("part"), F.lit(0).alias("guest"))
    guest = F.struct(F.col("to_cell").alias("cell"), F.col("to_part").alias("part"), F.lit(1).alias("guest"))
    return placed.select(
        "doc_id",
        "text",
        F.explode(F.when(F.col("to_cell").isNull(), F.array(own)).otherwise(F.array(own, guest))).alias("place"),
    ).select("doc_id", "text", "place.cell", "place.part", "place.guest")


def _cell(doc_id: Column, edges: list) -> Column:
    """Which of the quantile cells an id is in; nulls are before the first."""
    if not edges:
        return F.lit(-1)
    inner = F.array(*[F.lit(e) for e in edges])
    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(F.size(F.filter(inner, lambda e: e <= doc_id)))


def _part(edges: list, parts: int) -> Column:
    """An equal width of the cell."""
    if parts == 1 or not edges:
        return F.lit(0).cast("long")
    bounds = F.array(*[F.lit(float(e)) for e in [edges[0], *edges, edges[-1]]])
    low, high = F.get(bounds, F.col("cell")), F.get(bounds, F.col("cell") + 1)
    share = (F.col("doc_id") - low) / F.greatest(high - low, F.lit(1.0))
    return F.when(F.col("cell") < 0, F.lit(0)).otherwise(
        F.floor(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)) * (parts - 1))
    ).cast("long")


def fingerprint_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness. Other columns are not carried.

    Next is in ascending doc_id, nulls first, equal ids by text; the last is followed by the first.
    Edited: the last floor(n / 4) code points replaced by as many first ones (or all) of the next document's.
    """
    plain = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    own = with_fingerprint(dealt_by_range(plain).repartition("cell", "part"), "text", "fingerprint")
    own = own.withColumn("own_hashes", hashes(F.col("fingerprint")))
    order = Window.partitionBy("cell", "part").orderBy("guest", "doc_id", "text")
    followed = (
        own.withColumn("next_text", F.lead("text").over(order))
        .withColumn("next_hashes", F.lead("own_hashes").over(order))
        .where(F.col("guest") == 0)
        .withColumn("n_chars", F.length("text").cast("long"))
        .withColumn("cut", F.floor(F.col("n_chars") / 4).cast("int"))
    )
    edited = followed.withColumn(
        "edited",
        F.concat(
            F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")),
            F.substring(F.col("next_text"), F.lit(1), F.col("cut")),
        ),
    )
    return with_fingerprint(edited, "edited", "edited_fingerprint").select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("own_hashes"), hashes(F.col("edited_fingerprint"))).alias("near_edited"),
        likeness(F.col("own_hashes"), F.col("next_hashes")).alias("near_next"),
    )


def digest(found: DataFrame) -> DataFrame:
    return found.withColumns(
        {name: written(F.col(name)) for name in ("fingerprint", "edited_fingerprint")}
    )
