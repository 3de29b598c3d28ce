"""Decontamination, near-duplicates and tokenization against brute force and the public library."""

import hashlib
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from edge import edge_documents, no_documents
from terrapanel.llm import components, decontamination, near_duplicates, tokenization
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def same(found, want):
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted((tuple(r) for r in found), key=key) == sorted(want, key=key)


# -- decontamination -------------------------------------------------------------------------

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def ascii_lower(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


def plain_contamination(docs, items, window=10):
    windows = {}
    for item_id, text in items:
        words = WORD.findall(ascii_lower(text))
        n = min(window, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(str(item_id))
    lengths = {len(w) for w in windows}
    rows = []
    for doc_id, text in docs:
        words = WORD.findall(ascii_lower(text))
        hit, named = set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                ids = windows.get(tuple(words[i : i + n]))
                if ids:
                    named |= ids
                    hit.update(range(i, i + n))
        digest = hashlib.sha256(",".join(sorted(named)).encode()).hexdigest()
        rows.append((doc_id, len(words), len(hit), len(named), digest, bool(hit)))
    return rows


@pytest.mark.parametrize("block_bytes", [10_000, 40])
def test_decontamination_edges(spark, block_bytes):
    items = [
        (1, "same words here"),
        (2, "again AND again"),
        (3, "again"),
        (10, None),
        (11, ""),
        (12, "!!"),
        (13, "word1 und token1 word2 und token2 word3 und token3 word4 und token4 word5"),
        (13, "one two"),
        (14, "one two"),
        (None, "a"),
        (15, "漢字かな交じり文"),
    ]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = decontamination.contamination(docs, benchmark, block_bytes=block_bytes)
    known = [(i, t) for i, t in items if i is not None]
    same(decontamination.digest(found).collect(), plain_contamination(rows, known))
    assert decontamination.contamination(no_documents(spark), benchmark).count() == 0
    none = decontamination.contamination(docs, benchmark.limit(0))
    assert none.where(F.size("spans") > 0).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text("ab ", max_size=60), st.lists(st.text("ab ", max_size=12), max_size=5))
def test_search_finds_every_occurrence(text, items):
    items = list(enumerate(items))
    tables = decontamination.matchers([(str(i), t.encode()) for i, t in items], 3)
    named = set()
    spans = decontamination.occurrences(decontamination.alnum_words(text.encode()), tables, [], named)
    (want,) = plain_contamination([(0, text)], items, 3)
    assert (sum(b - a for a, b in spans), len(named)) == want[2:4]


# -- near-duplicates -------------------------------------------------------------------------


def shingle_set(text, size=2):
    words = re.findall("[^\x20\x09-\x0d]+", ascii_lower(text))
    if len(words) < size:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}


def plain_components(rows, size=2):
    sets = [shingle_set(t, size) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(doc_id, least.get(root(i), doc_id))
    return [
        (doc_id, len(sets[i]), least.get(root(i)), doc_id == least.get(root(i))) for i, (doc_id, _) in enumerate(rows)
    ]


def test_near_duplicates_edges(spark):
    docs = edge_documents(spark)
    same(near_duplicates.near_duplicates(docs).collect(), plain_components([(r.doc_id, r.text) for r in docs.collect()]))
    assert near_duplicates.near_duplicates(no_documents(spark)).count() == 0


@pytest.mark.parametrize("fan", [8])
def test_large_groups_with_common_words(spark, monkeypatch, fan):
    """Chains of edits, groups around a text, and texts that mostly share a passage but aren't linked."""
    monkeypatch.setattr(near_duplicates, "FAN", fan)
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):  # around one text
        words = list(base)
        words[int(rng.integers(60))] = f"x{i}"
        rows.append(" ".join(words))
    words = [f"c{i}" for i in range(80)]
    for i in range(40):  # a chain: neighbours alike, ends not
        words[(2 * i) % 80] = f"y{i}"
        rows.append(" ".join(words))
    passage = [f"p{i}" for i in range(60)]
    for i in range(60):  # below the threshold, but with many common keys
        rows.append(" ".join(passage + [f"q{i}_{j}" for j in range(18)]))
    rows = [(int(i), t) for i, t in zip(rng.permutation(len(rows)) + 5, rows)]
    rows += [(None, rows[0][1] + " more"), (None, "only without an id here"), (None, "only without an id here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain_components(rows)
    want = [(d, n, c, d == c) for d, n, c, _ in want]
    same(near_duplicates.near_duplicates(frame).collect(), want)


def test_a_common_passage_meets_few_pairs(spark, monkeypatch):
    """Texts of one passage and a few words of their own, below the threshold, and some above it: pairs don't grow with the square."""
    rng = np.random.default_rng(5)
    passage = [f"p{k}" for k in range(100)]
    rows = [(k, " ".join([*passage, *(f"own{k}x{j}" for j in range(rng.integers(16, 22)))])) for k in range(200)]
    rows += [(1000 + k, " ".join([*passage[: 88 + k % 8], f"near{k}", *passage[88 + k % 8 :]])) for k in range(12)]
    compared, confirmed = [], near_duplicates._confirmed

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(near_duplicates, "_confirmed", counted)
    same(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_components(rows))
    assert sum(compared) < 20 * len(rows)  # 19,900 pairs of the first two hundred


@pytest.mark.parametrize("bits", [2**6, near_duplicates.MOST_BITS])
def test_rounds_move_pairs_but_not_all_sets(spark, monkeypatch, bits):
    """Each round moves its pairs, with their sets; the table of all wanted sets stays where it is."""
    rows = [(k, " ".join(f"t{k // 4}x{j}" for j in range(40 + k % 4))) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(10)] + [(None, rows[3][1]), (200, None), (201, "lone words")]
    moved, confirmed = [], near_duplicates._confirmed

    def seen(pairs, *rest):
        found = confirmed(near_duplicates.staged(pairs, "pairs"), *rest)
        moved.append(found._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning"))
        return found

    monkeypatch.setattr(near_duplicates, "_confirmed", seen)
    monkeypatch.setattr(near_duplicates, "MOST_BITS", bits)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        same(near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect(), plain_components(rows))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert moved and max(moved) == 2  # the pairs, to one set and to the other; four with the sets
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("sets_")]


def test_components_of_a_long_path(spark):
    links = spark.range(200).select((F.col("id") * 7919 % 201).alias("a"), ((F.col("id") + 1) * 7919 % 201).alias("b"))
    labels = components.components(links).collect()
    assert len(labels) == 201 and {r.label for r in labels} == {0}


def test_pairs_within_the_distance_share_a_key(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(300):
        one = rng.integers(0, 2**near_duplicates.BITS, near_duplicates.SYMBOLS)
        other = one.copy()
        places = rng.permutation(near_duplicates.SYMBOLS)[: near_duplicates.DISTANCE]
        other[places] ^= rng.integers(1, 2**near_duplicates.BITS, len(places))
        rows.append([near_duplicates.packed(x).tolist() for x in (one, other)])
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>")
    keys = [F.array(*near_duplicates.index_keys(F.col(c))) for c in ("a", "b")]
    both = frame.select(
        F.arrays_overlap(*keys).alias("met"), near_duplicates.distance(F.col("a"), F.col("b")).alias("far")
    )
    assert both.where("met").count() == 300
    assert {r.far for r in both.select("far").distinct().collect()} == {near_duplicates.DISTANCE}


# -- tokenization ----------------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=tokenization.default_model())


def library_rows(rows, library):
    want = []
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        decoded = library.decode(ids)
        want.append(
            (doc_id, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        )
    return want


def test_tokens_whole_table(spark, library):
    same(QUERIES["op8_sentencepiece"](spark, SF).collect(), library_rows(documents(spark), library))


def test_tokens_edges(spark, library):
    docs = edge_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(tokenization.digest(tokenization.round_trip(docs)).collect(), library_rows(rows, library))
    assert tokenization.round_trip(no_documents(spark)).count() == 0
    back = tokenization.decode(tokenization.encode(docs.withColumn("ids", F.lit("clash"))))
    assert back.where("coalesce(text, '') <> decoded").count() == 0
    assert back.columns == [*docs.columns, "ids", "decoded"]


@pytest.fixture(scope="module")
def tools():
    with open(tokenization.default_model(), "rb") as file:
        model = tokenization.Model(file.read())
    return tokenization.Encoder(model), tokenization.Decoder(model)


def test_tokens_of_any_text(library, tools):
    pieces = [t for t in tools[0].model.texts if len(t) < 9]

    @settings(max_examples=2000, deadline=None)
    @given(
        st.one_of(
            st.text(max_size=40),
            st.text("abcdeéñ▁ \n<>0xAthingoer漢", max_size=60),
            st.lists(st.sampled_from(pieces), max_size=12).map("".join),
        )
    )
    def check(text):
        ids = np.frombuffer(tools[0].encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True)
        assert tools[1].decode(ids) == library.decode(ids)

    check()


def test_any_ids_decode_as_in_the_library(library, tools):
    @settings(max_examples=2000, deadline=None)
    @given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=8))
    def check(ids):
        assert tools[1].decode(ids) == library.decode(ids)

    check()
