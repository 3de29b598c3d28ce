"""Uniform shuffle into shards of exact sizes by a hypergeometric communication matrix, in DataFrame operations only.

Rows fall into blocks by a hash. How many rows of each block go to each shard is drawn from the
multivariate hypergeometric distribution: a tree with a fixed fan-out splits the shard sizes
over ever smaller groups of blocks, level by level, so that no task holds more than one node's
children. Each block is permuted by a random key and dealt out by its row of the matrix; the
shards are permuted again by a second key, split into ranges of that key so that no task holds a
whole shard. Blocks and ranges are about the square root of the row count, in number and in size.

All draws are hashes of a seed, so a lost task repeats them. Ties of the random keys are broken
by the row's values; rows equal in all of them are interchangeable.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrapanel.session import staged

FAN_OUT = 32
DEVIATIONS = 10  # a draw further from its mean than so many standard deviations has no chance that a double can hold
SMALL = 32  # up to here factorials come from a table, beyond from Stirling's series


def _unit(*parts: Column) -> Column:
    """A number from 0 to 1, 53 random bits of the hash of its parts."""
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(2**53))


def _log_factorial(n: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(k + 1)) for k in range(SMALL)])
    x = F.greatest(n, F.lit(1)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)
    return F.when(n < SMALL, F.get(table, n.cast("int"))).otherwise(series)


def hypergeometric(marked: Column, drawn: Column, pool: Column, unit: Column) -> Column:
    """How many of the drawn are marked, by inverting the distribution at the given uniform number."""
    low = F.greatest(F.lit(0).cast("long"), drawn + marked - pool)
    high = F.least(drawn, marked)
    share = marked.cast("double") / F.greatest(pool, F.lit(1))
    mean = drawn * share
    spread = DEVIATIONS * (F.sqrt(mean * (1 - share)) + 1)
    first = F.greatest(low, F.floor(mean - spread).cast("long"))
    last = F.greatest(first, F.least(high, F.ceil(mean + spread).cast("long")))

    def log_choose(n: Column, k: Column) -> Column:
        return _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)

    at_first = F.exp(log_choose(marked, first) + log_choose(pool - marked, drawn - first) - log_choose(pool, drawn))
    start = F.struct(at_first.alias("p"), F.lit(0.0).alias("below"), first.alias("found"))

    def step(s: Column, k: Column) -> Column:
        ratio = (marked - k).cast("double") * (drawn - k) / ((k + 1).cast("double") * (pool - marked - drawn + k + 1))
        passed = s["below"] + s["p"]
        return F.struct(
            F.when(k < high, s["p"] * ratio).otherwise(F.lit(0.0)).alias("p"),
            passed.alias("below"),
            F.when(passed <= unit, F.least(k + 1, last)).otherwise(s["found"]).alias("found"),
        )

    draw = F.aggregate(F.sequence(first, last), start, step, lambda s: s["found"])
    return F.when(low >= high, low).otherwise(draw)


def _row_of_matrix(sizes: Column, pool: Column, drawn: Column, seed: list[Column]) -> Column:
    """How many of the drawn go to each shard when the pool holds `sizes` places of each."""
    start = F.struct(
        drawn.cast("long").alias("left"), pool.cast("long").alias("pool"), F.array().cast("array<bigint>").alias("row")
    )

    def step(s: Column, size: Column) -> Column:
        k = hypergeometric(size, s["left"], s["pool"], _unit(*seed, F.size(s["row"])))
        return F.struct(
            (s["left"] - k).alias("left"), (s["pool"] - size).alias("pool"), F.concat(s["row"], F.array(k)).alias("row")
        )

    return F.aggregate(sizes, start, step, lambda s: s["row"])


def _split(sizes: Column, children: Column, seed: list[Column]) -> Column:
    """Deal a node's shard sizes over its children: array of (child, row)."""
    total = F.aggregate(sizes, F.lit(0).cast("long"), lambda a, b: a + b)
    start = F.struct(
        sizes.alias("left"),
        total.alias("pool"),
        F.array().cast("array<struct<child:bigint,row:array<bigint>>>").alias("dealt"),
    )

    def step(s: Column, c: Column) -> Column:
        row = _row_of_matrix(s["left"], s["pool"], c["n"], [*seed, c["child"]])
        drawn = F.struct(row.alias("row"), c["child"].alias("child"))
        # bound once: the row is drawn, then taken off what is left
        return F.element_at(
            F.transform(
                F.array(drawn),
                lambda d: F.struct(
                    F.zip_with(s["left"], d["row"], lambda a, b: a - b).alias("left"),
                    (s["pool"] - c["n"]).alias("pool"),
                    F.concat(
                        s["dealt"], F.array(F.struct(d["child"].alias("child"), d["row"].alias("row")))
                    ).alias("dealt"),
                ),
            ),
            1,
        )

    return F.aggregate(children, start, step, lambda s: s["dealt"])


def communication_matrix(block_sizes: DataFrame, depth: int, shard_sizes: list[int], seed: int) -> DataFrame:
    """(block, row): how many rows each block sends to each shard. block_sizes: (block, n), blocks below FAN_OUT**depth."""
    spark = block_sizes.sparkSession
    sizes = [F.lit(n).cast("long") for n in shard_sizes]
    nodes = spark.range(1).select(F.col("id").alias("node"), F.array(*sizes).alias("row"))
    for level in range(depth):
        below = FAN_OUT ** (depth - level - 1)
        child = F.floor(F.col("block") / below).cast("long")
        children = (
            block_sizes.groupBy(child.alias("child"))
            .agg(F.sum("n").alias("n"))
            .groupBy(F.floor(F.col("child") / FAN_OUT).cast("long").alias("node"))
            .agg(F.sort_array(F.collect_list(F.struct("child", "n"))).alias("children"))
        )
        dealt = _split(F.col("row"), F.col("children"), [F.lit(seed), F.lit(level), F.col("node")])
        nodes = (
            children.join(nodes, "node")
            .select(F.explode(dealt).alias("d"))
            .select(F.col("d.child").alias("node"), F.col("d.row").alias("row"))
        )
    return nodes.withColumnRenamed("node", "block")


def shard_rows(rows: DataFrame, order: list[str], shards: int, seed: int = 20) -> DataFrame:
    """The rows with `shard` (sizes at most one apart) and `slot` (gapless from 0 in each shard), uniformly shuffled.

    `order` names the columns that tell rows apart: they seed the random keys and break their ties.
    The result's own columns replace input columns of the same names. An empty input gives no rows.
    Runs a count and writes the dealt rows once to the shared folder.
    """
    total = rows.count()
    depth = max(1, math.ceil(math.log(max(2.0, math.sqrt(total)), FAN_OUT) - 1e-9))
    blocks = FAN_OUT**depth
    sizes = [total // shards + (shard < total % shards) for shard in range(shards)]
    names = [c for c in rows.columns if c not in ("shard", "slot")]
    keyed = rows.select(
        F.struct(*names).alias("kept"),
        F.struct(*[F.col(c) for c in order]).alias("tie"),
        F.xxhash64(F.lit(seed), F.lit(1), *order).alias("first_key"),
        F.xxhash64(F.lit(seed), F.lit(2), *order).alias("second_key"),
    ).withColumn("block", F.pmod(F.xxhash64(F.lit(seed), F.lit(0), F.col("first_key")), F.lit(blocks)))
    matrix = communication_matrix(keyed.groupBy("block").agg(F.count("*").alias("n")), depth, sizes, seed)
    last_places = F.transform(
        F.sequence(F.lit(1), F.size("row")),
        lambda j: F.aggregate(F.slice("row", 1, j), F.lit(0).cast("long"), lambda a, b: a + b),
    )
    local = Window.partitionBy("block").orderBy("first_key", "tie")
    dealt = (
        keyed.withColumn("place", F.row_number().over(local))
        .join(matrix.select("block", last_places.alias("last_places")), "block")
        .select(
            "kept",
            "tie",
            "second_key",
            F.size(F.filter("last_places", lambda last: last < F.col("place"))).alias("shard"),
        )
    )
    bits = max(3, math.ceil(math.log2(math.sqrt(total / shards + 1))))
    ranged = staged(
        dealt.withColumn("range", F.shiftrightunsigned(F.col("second_key"), 64 - bits).cast("int")), "sharding"
    )
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("shard", "range")
        .agg(F.count("*").alias("n"))
        .select("shard", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    # the hash of the second key is taken as signed, so a range's rows are in the order of the unsigned key
    within = Window.partitionBy("shard", "range").orderBy("second_key", "tie")
    return (
        ranged.withColumn("at", F.row_number().over(within))
        .join(offsets, ["shard", "range"])
        .select("kept.*", "shard", (F.col("offset") + F.col("at") - 1).cast("long").alias("slot"))
    )


def shard_documents(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of every row; size is the text's UTF-8 bytes (null: none) plus 16."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(16)).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    return shard_rows(rows, ["doc_id", "size", "text_crc32"], shards)
