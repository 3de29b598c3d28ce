"""Near-duplicates: b-bit MinHash signatures joined by a multi-index on their Hamming distance, links confirmed on full sets.

A document's set holds its distinct shingles of SHINGLE words; with fewer words, the whole sequence as one. Its
signature has CHUNKS * WIDTH symbols of BITS bits, each cut from one minimum hash. Two signatures
that differ in at most DISTANCE = CHUNKS * (ERRORS + 1) - 1 symbols have, by pigeonhole, a chunk with at most ERRORS
differing ones; every chunk is entered once for each choice of ERRORS symbols to leave out, so such a pair shares
an index key; most pairs up to FAR differing symbols do too. A pair at the similarity threshold of 0.8 misses all keys
with a probability of 6e-6.

Equal sets are one node from the start. Groups of nodes with a common key are not paired off: in
each round a few members lead (one in the first round, FAN times as many in each next), the others are compared with
them, and members that confirmed links have already joined are not compared again. A leader retires after
its round; a group is done when the rest of it is one component. So every pair that shares a key is compared or known
to be connected, while a group of copies costs about one comparison for each member.

Large groups that stay open after the first round hold texts that share much but are not copies, a common passage for one.
Their nodes are grouped anew by prefix filtering, which is exact: with the shingles of these nodes put in one order, rare
ones first, two sets within the threshold share one of the first n - ceil(0.8 n) + 1 of each, and it is among the first
n - ceil(1.6 n / 1.8) + 1 of the smaller one. Only these lead there; a group without any has no pair to compare. A common passage
comes last in that order, so that texts which share it and nothing else part as soon as it alone doesn't link them. Two
sets whose first common shingle is the group's share no more than what each has from there on; only if that is enough, and
their signatures are near, are they compared. Small groups bound the shared part by the smaller size alone.

Null, empty and blank texts have no set and no links. A document of repeated id is one node for each of its sets.
Documents without an id link others, but never name a component.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrapanel.llm.components import components
from terrapanel.llm.words import WordHashes, mixed, space_words, texts
from terrapanel.llm.workers import forget
from terrapanel.session import discard, fresh_path, staged

SHINGLE = 2
CHUNKS, WIDTH, ERRORS, BITS = 9, 5, 1, 15
DISTANCE = CHUNKS * (ERRORS + 1) - 1
FAR = 24  # symbols; pairs that share a key but differ in more aren't compared: one in ten million at the threshold
SYMBOLS = CHUNKS * WIDTH
LANE, LANES = BITS + 1, 3  # a 64-bit number holds so many symbols, each with a free bit above
FAN = 16
ROW = ["key", "node", "rest", "leads"]  # of a group: rest is how much of its set a node has from the key on
BATCH_BYTES = 8_000_000  # of sets handed on at once
MOST_BUCKETS = 100_000  # Spark's own limit
MOST_BITS = 2**27  # of the bitmap of wanted texts; with too few more sets are made, and dropped
OWN_ID = 2**61  # from here on, ids that deduplicated() gives to rows without one
NO_ID = 2**62  # nodes from here on stand for sets whose documents all lack an id

_random = np.random.default_rng(6)
_FACTORS = _random.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_OFFSETS = _random.integers(0, 2**64, SYMBOLS, dtype=np.uint64)
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64))


def shingles(words: list[bytes], hashes: WordHashes, size: int) -> np.ndarray:
    """Distinct 64-bit shingle hashes, sorted."""
    if not words:
        return np.zeros(0, np.uint64)
    each = hashes.of(words)
    if len(words) < size:
        # of another length than a full shingle, so never equal to one
        value = _PLACES[len(words) : len(words) + 1]
        for word in each:
            value = mixed(value ^ word)
        return value
    count = len(words) - size + 1
    total = each[:count] * (_PLACES[0] | np.uint64(1))
    for k in range(1, size):
        total = mixed(total) + each[k : k + count] * (_PLACES[k] | np.uint64(1))
    return np.unique(mixed(total))


def signature(values: np.ndarray, step: int = 4096) -> np.ndarray:
    """SYMBOLS symbols in 64-bit numbers, LANES in each: of each hash function's minimum, the low bits after mixing."""
    least = np.full(SYMBOLS, ~np.uint64(0))
    for start in range(0, len(values), step):
        part = (values[None, start : start + step] * _FACTORS[:, None] + _OFFSETS[:, None]) >> np.uint64(16)
        least = np.minimum(least, part.min(axis=1))
    return packed(mixed(least) & np.uint64(2**BITS - 1))


def packed(symbols: np.ndarray) -> np.ndarray:
    lanes = symbols.astype(np.uint64).reshape(-1, LANES) << np.arange(0, LANE * LANES, LANE, dtype=np.uint64)
    return lanes.sum(axis=1, dtype=np.uint64).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    forget()
    hashes = WordHashes()
    for batch in batches:
        counts, names, signatures, ids = [], [], [], []
        for text in texts(batch):
            ids.append(text_id(text))
            values = shingles(space_words(text), hashes, size)
            counts.append(len(values))
            if len(values):
                names.append(_set_name(values))
                signatures.append(signature(values))
            else:
                names.append(None)
                signatures.append(None)
        yield pa.RecordBatch.from_arrays(
            [
                batch["doc_id"],
                pa.array(counts, pa.int64()),
                pa.array(names, pa.binary()),
                pa.array(signatures, pa.list_(pa.int64())),
                pa.array(ids, pa.int64()),
            ],
            ["doc_id", "n_shingles", "set_id", "signature", "text_id"],
        )


def text_id(text: bytes) -> int:
    """64 bits that tell texts apart, but for a few."""
    return xxhash.xxh3_64_intdigest(text) - 2**63


def _set_name(values: np.ndarray) -> bytes:
    """16 bytes that name a set: two sums over its mixed members."""
    sums = (np.sum(mixed(values), dtype=np.uint64), np.sum(mixed(values ^ _PLACES[7]), dtype=np.uint64))
    return b"".join(int(x).to_bytes(8, "little") for x in sums)


def _marked(wanted: DataFrame) -> np.ndarray:
    """A bitmap with the low bits of the wanted texts' text_id set: of 16 bits for each text, up to MOST_BITS."""
    bits = 2**16
    while bits < min(16 * wanted.count(), MOST_BITS):
        bits *= 2
    place = F.col("text_id").bitwiseAND(F.lit(bits - 1))
    found = (
        wanted.select(F.shiftright(place, 6).alias("word"), place.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
        .groupBy("word")
        .agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
        .toArrow()
    )
    words = np.zeros(bits // 64, np.uint64)
    words[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def _sets(batches: Iterator[pa.RecordBatch], size: int, shared: Broadcast) -> Iterator[pa.RecordBatch]:
    """(set_id, members) of the marked texts, and of few others."""
    forget()
    hashes, marked = WordHashes(), shared.value
    most = len(marked) * 64 - 1

    def wanted(text: bytes) -> bool:
        place = text_id(text) & most
        return bool(int(marked[place >> 6]) >> (place & 63) & 1)

    def made(sets: list[np.ndarray]) -> pa.RecordBatch:
        names = pa.array([_set_name(s) for s in sets], pa.binary())
        members = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([names, members], ["set_id", "members"])

    for batch in batches:
        sets, total = [], 0
        for values in (shingles(space_words(t), hashes, size) for t in texts(batch) if wanted(t)):
            if len(values):
                sets.append(values)
                total += values.nbytes
            if total >= BATCH_BYTES:  # a set takes several times its text's bytes
                yield made(sets)
                sets, total = [], 0
        yield made(sets)


@contextmanager
def _wanted_sets(plain: DataFrame, wanted: DataFrame, size: int) -> Iterator[DataFrame]:
    """A table (set_id, node, members) of the wanted (set_id, node, text_id), in buckets by set_id: each round joins some pairs to it, which
    then move alone. Sets are made again where their texts are, from one text of each; copies of it meet in their task before they move.
    A bounded bitmap tells which texts, but for a few that the join then drops. The table goes in the end."""
    spark = plain.sparkSession
    shared = spark.sparkContext.broadcast(_marked(wanted))
    made = plain.select("text").mapInArrow(lambda batches: _sets(batches, size, shared), "set_id binary, members array<long>")
    each = made.groupBy("set_id").agg(F.any_value("members").alias("members")).join(wanted, "set_id")
    name, path = f"sets_{uuid.uuid4().hex}", fresh_path(spark, "sets")
    # as many as the joins have partitions, else Spark would deal the table out anew
    buckets = min(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), MOST_BUCKETS)
    writer = each.select("set_id", "node", "members").write.format("parquet").bucketBy(buckets, "set_id").sortBy("set_id")
    writer.option("path", path).saveAsTable(name)
    shared.destroy()
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")
        discard(spark, path)


def _symbol(signature: Column, k: int) -> Column:
    word = F.get(signature, F.lit(k // LANES))
    return F.shiftright(word, LANE * (k % LANES)).bitwiseAND(F.lit(2**BITS - 1))


def index_keys(signature: Column) -> list[Column]:
    """The chunks' variants: each chunk once without each of its symbols."""
    keys = []
    for chunk in range(CHUNKS):
        symbols = [_symbol(signature, chunk * WIDTH + k) for k in range(WIDTH)]
        for left_out in range(WIDTH):
            rest = [s for k, s in enumerate(symbols) if k != left_out]
            keys.append(F.xxhash64(F.lit(chunk * WIDTH + left_out), *rest))
    return keys


def distance(one: Column, other: Column) -> Column:
    """Differing symbols of two signatures: a lane of the exclusive or that isn't 0 carries into its free bit."""
    full = sum((2**BITS - 1) << (LANE * lane) for lane in range(LANES))
    free = sum(1 << (LANE * lane + BITS) for lane in range(LANES))
    total = F.lit(0)
    for k in range(SYMBOLS // LANES):
        differ = F.get(one, F.lit(k)).bitwiseXOR(F.get(other, F.lit(k)))
        total = total + F.bit_count((differ + F.lit(full)).bitwiseAND(F.lit(free)))
    return total


def _met(keyed: DataFrame) -> DataFrame:
    """The rows whose key several have. Most index keys are of one node: these only move as a key and a count."""
    several = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    return staged(keyed.join(several, "key", "left_semi").select(*ROW), "met")


def _shared(keyed: DataFrame) -> DataFrame:
    """The rows (key, node, rest, leads) whose key several nodes have, one at least that leads; of keys with the same nodes, only one.

    Texts that are alike share many keys, a passage's words as many tokens: their groups would be compared again and again. The nodes
    of a key are told by their number, their ends and 128 bits over their hashes, so no group is collected. Of tokens with the
    same nodes the first in the order stays, from which on each node has most: where two sets meet first, they still meet.
    """
    mixed = [F.bit_xor(F.xxhash64("node", F.lit(salt))).alias(f"mix{salt}") for salt in (1, 2)]
    told = ["low", "high", "n", "mix1", "mix2"]
    groups = keyed.groupBy("key").agg(
        F.min("node").alias("low"),
        F.max("node").alias("high"),
        F.count("*").alias("n"),
        F.sum("rest").alias("rests"),
        F.max("leads").alias("led"),
        *mixed,
    )
    once = groups.where("low < high AND led").groupBy(*told).agg(F.max(F.struct("rests", "key")).alias("first"))
    return keyed.join(once.select(F.col("first.key").alias("key")), "key").select(*ROW)


def _split(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """New groups of the groups' nodes, by the rare shingles that linked nodes must share. Of two linked nodes the smaller one has
    such a shingle among fewer first ones: there it leads, elsewhere it is only met."""
    size = F.size("members")
    tokens = sets.join(groups.select("node").distinct(), "node", "left_semi").select(
        "node", size.alias("n"), F.explode("members").alias("token")
    )
    often = tokens.groupBy("token").agg(F.count("*").alias("often")).where("often > 1")
    ranked = (
        tokens.join(often, "token")
        .groupBy("node", "n")
        .agg(F.sort_array(F.collect_list(F.struct("often", "token"))).alias("ranked"))
    )
    # tokens of one node alone come first in the order; they take places of the n - needed + 1, but match nothing
    needed = F.floor((F.col("n") * percent + 99) / 100)
    # with a set of at least its own size, a set shares 2 * percent / (100 + percent) of it
    of_larger = F.floor((F.col("n") * 2 * percent + 99 + percent) / (100 + percent))
    first = F.slice("ranked", 1, F.greatest(F.size("ranked") - needed + 1, F.lit(0)).cast("int"))
    prefixes = ranked.select("node", F.size("ranked").alias("all"), of_larger.alias("needed"), F.posexplode(first).alias("place", "t"))
    rest = F.col("all") - F.col("place")
    key = F.xxhash64(F.lit("prefix"), "t.token").alias("key")
    keyed = prefixes.select(key, "node", rest.cast("long").alias("rest"), (rest >= F.col("needed")).alias("leads"))
    return _shared(staged(keyed, "prefixes"))


def _split_large(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Groups of up to FAN members as they are, for the next round has as many leaders; the nodes of larger ones anew."""
    counts = groups.groupBy("key").agg(F.count("*").alias("n"))
    counted = staged(groups.join(counts, "key"), "counted")
    small, large = (counted.where(which).select(*ROW) for which in (F.col("n") <= FAN, F.col("n") > FAN))
    return small.unionByName(_split(large, sets, percent))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (one, other: node and set_id) whose full sets are similar enough."""
    left = sets.select("set_id", F.col("members").alias("left"))
    right = sets.select("set_id", F.col("members").alias("right"))
    shared = F.size(F.array_intersect("left", "right"))
    # 100 * shared >= percent * (|left| + |right| - shared)
    enough = shared * (100 + percent) >= percent * (F.size("left") + F.size("right"))
    named = pairs.select(
        F.col("one.node").alias("a"),
        F.col("one.set_id").alias("set_id"),
        F.col("other.node").alias("b"),
        F.col("other.set_id").alias("other_id"),
    )
    first = named.join(left, "set_id").select("a", "b", "left", F.col("other_id").alias("set_id"))
    return first.join(right, "set_id").where(enough).select("a", "b")


def _open(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(key, node, rest, leads, label) of the groups that hold several components and a node that leads."""
    labelled = groups.withColumn("label", F.col("node"))
    if labels is not None:
        known = labels.select("node", F.col("label").alias("known"))
        labelled = groups.join(known, "node", "left").select(
            *ROW, F.coalesce("known", "node").alias("label")
        )
    ends = labelled.groupBy("key").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.max("leads").alias("led")
    )
    return labelled.join(ends.where("low < high AND led").select("key"), "key")


def _links(nodes: DataFrame, groups: DataFrame, sets: DataFrame, percent: int, far: int = FAR) -> DataFrame | None:
    """(node, label) of all linked nodes, from comparing the members of groups round by round; None without links."""
    links, labels, leaders_per_group = None, None, 1
    signatures = nodes.select("node", "signature", "n_shingles", "set_id")
    waiting = groups
    while True:
        labelled = staged(_open(waiting, labels), "open")
        if labelled.isEmpty():
            return labels
        seat = F.pmod(F.xxhash64("node"), F.lit(leaders_per_group))
        leading = labelled.where("leads")
        leaders = leading.groupBy("key", seat.alias("seat")).agg(F.min(F.struct("node", "label", "rest")).alias("lead"))
        leaders = leaders.select(
            F.col("key").alias("at"),
            F.col("lead.node").alias("leader"),
            F.col("lead.label").alias("led"),
            F.col("lead.rest").alias("lead_rest"),
        )
        lead_signatures = signatures.select(
            F.col("node").alias("leader"),
            F.col("signature").alias("lead_signature"),
            F.col("n_shingles").alias("lead_n"),
            F.col("set_id").alias("lead_set_id"),
        )
        members = labelled.join(signatures, "node")
        # as in _confirmed, were all that is left shared
        enough = F.least("rest", "lead_rest") * (100 + percent) >= (F.col("n_shingles") + F.col("lead_n")) * percent
        near = (F.col("label") != F.col("led")) & enough & (distance(F.col("signature"), F.col("lead_signature")) <= far)
        one, other = F.struct("node", "set_id"), F.struct(F.col("leader").alias("node"), F.col("lead_set_id").alias("set_id"))
        pairs = (
            members.join(leaders.join(lead_signatures, "leader"), (F.col("key") == F.col("at")) & near)
            .select(F.greatest(one, other).alias("one"), F.least(one, other).alias("other"))
            .distinct()
        )
        found = staged(_confirmed(pairs, sets, percent), "links")
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            labels = components(links)
        retired = leaders.select(F.col("at").alias("key"), F.col("leader").alias("node"))
        waiting = labelled.select(*ROW).join(retired, ["key", "node"], "left_anti")
        if leaders_per_group == 1:
            waiting = _split_large(staged(_open(waiting, labels), "left").select(*ROW), sets, percent)
        leaders_per_group *= FAN


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = 80, far: int = FAR
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row. Other columns are not carried. With far=SYMBOLS, every pair that shares a
    key is compared.

    Writes signatures, shared index keys, sets and links to the shared folder; loops until no group is left.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = staged(
        plain.mapInArrow(
            lambda batches: _signed(batches, size),
            "doc_id long, n_shingles long, set_id binary, signature array<long>, text_id long",
        ),
        "signatures",
    )
    lone = F.shiftrightunsigned(F.xxhash64("set_id"), 3) + F.lit(NO_ID)
    nodes = staged(
        signed.where("n_shingles > 0")
        .groupBy("set_id", "signature")
        .agg(F.min("doc_id").alias("first"), F.max("n_shingles").alias("n_shingles"), F.min("text_id").alias("text_id"))
        .select("set_id", "signature", "n_shingles", "text_id", F.coalesce("first", lone).alias("node")),
        "nodes",
    )
    keys = F.array(*index_keys(F.col("signature")))
    keyed = nodes.select("node", F.col("n_shingles").alias("rest"), F.lit(True).alias("leads"), F.explode(keys).alias("key"))
    groups = staged(_shared(_met(keyed)), "groups")
    wanted = staged(nodes.select("node", "set_id", "text_id").join(groups.select("node"), "node", "left_semi"), "wanted")
    with _wanted_sets(plain, wanted, size) as sets:
        labels = _links(nodes, groups, sets, percent, far)
    named = nodes.select("set_id", "node")
    if labels is not None:
        named = named.join(labels, "node", "left").select("set_id", F.coalesce("label", "node").alias("node"))
    component = F.when(F.col("node") < NO_ID, F.col("node"))
    return (
        signed.join(named, "set_id", "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(component).alias("component_id"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """One document of each group, the one with the smallest id; all columns kept. Shingles have `size` words.

    Rows that repeat an id are one document, of which the row with the smallest text stays; so are rows without id
    and with equal texts, which only stay if no document with an id is in their group.
    """
    text = F.col(text_col).cast("string")
    stand_in = F.shiftrightunsigned(F.xxhash64(F.coalesce(text, F.lit(""))), 4) + F.lit(OWN_ID)
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), stand_in).alias("id"), text.alias("text"), F.struct(*docs.columns).alias("row")
    )
    kept = near_duplicates(rows, "id", "text", size).where("kept").select(F.col("doc_id").alias("id")).distinct()
    first = F.min(F.struct(F.col("row").getField(text_col).alias("text"), "row")).alias("first")
    # the texts move once, inside the rows
    return rows.select("id", "row").join(kept, "id", "left_semi").groupBy("id").agg(first).select("first.row.*")
