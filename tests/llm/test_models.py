"""Language-model scores and the toxicity classifier."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from edge import edge_documents, no_documents
from terrapanel.llm import context_tree, scoring, toxicity
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def lowered(text):
    return re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")


class PlainTree:
    """Context-tree weighting by recursion over dictionaries."""

    def __init__(self, texts, depth):
        self.depth, self.counts, self.children = depth, defaultdict(lambda: [0, 0]), defaultdict(set)
        for text in texts:
            for node, context, bit in self.bits(text):
                for d in range(depth + 1):
                    self.counts[node, context[depth - d :]][bit] += 1
                    if d:
                        self.children[node, context[depth - d + 1 :]].add(context[depth - d :])
        self.memo = {}

    def bits(self, text):
        data = b"\xff" * self.depth + lowered(text).encode() + b"\xff"
        for i in range(self.depth, len(data)):
            node = 1
            for k in range(7, -1, -1):
                bit = data[i] >> k & 1
                yield node, data[i - self.depth : i], bit
                node = node * 2 + bit

    def estimated(self, key):
        a, b = self.counts[key]
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(self, node, context):
        if (node, context) not in self.memo:
            own = self.estimated((node, context))
            if len(context) < self.depth:
                below = sum(self.weighted(node, c) for c in self.children[node, context])
                high = max(own, below)
                total = high + math.log(math.exp(own - high) + math.exp(below - high)) - math.log(2)
            else:
                total = own
            self.memo[node, context] = total
        return self.memo[node, context]

    def one(self, node, context, d=0):
        key = (node, context[self.depth - d :])
        a, b = self.counts.get(key, (0, 0))
        if not a + b:
            return None
        own = (b + 0.5) / (a + b + 1)
        below = self.one(node, context, d + 1) if d < self.depth else None
        if below is None:
            return own
        weight = math.exp(self.estimated(key) - math.log(2) - self.weighted(*key))
        return weight * own + (1 - weight) * below

    def log10(self, text):
        total = 0.0
        for node, context, bit in self.bits(text):
            p = self.one(node, context)
            p = 0.5 if p is None else p
            total += math.log10(p if bit else 1 - p)
        return total


def plain_scores(rows):
    train = [t for i, t in rows if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    counts, ends = Counter(), len(train)
    for t in train:
        counts.update(re.findall("[^\x20\x09-\x0d]+", lowered(t)))
    total, vocabulary = sum(counts.values()) + ends, len(counts) + (ends > 0)
    tree = PlainTree(train, context_tree.DEPTH)
    want = []
    for i, t in rows:
        c = [counts[w] for w in re.findall("[^\x20\x09-\x0d]+", lowered(t))] + [ends]
        base = sum(math.log10((x + 1) / (total + vocabulary + 1)) for x in c)
        held = zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
        want.append((i, held, len(c), sum(x > 0 for x in c), total, base, tree.log10(t)))
    return want


def agree(found, want):
    key = lambda r: (r[0] is not None, r[0] or 0, r[2], r[5])
    found = sorted((tuple(r) for r in found), key=key)
    want = sorted(want, key=key)
    assert [r[:5] for r in found] == [r[:5] for r in want]
    for a, b in zip(found, want):
        assert a[5] == pytest.approx(b[5], rel=1e-9) and a[6] == pytest.approx(b[6], rel=1e-6)


def small_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 900").limit(60)
    return docs.select("doc_id", "text")


@pytest.mark.parametrize("chunk, blocks, frequent", [(2_000_000, 4_000_000, 100_000), (500, 30_000, 5)])
def test_scores_match_the_recursion(spark, monkeypatch, chunk, blocks, frequent):
    monkeypatch.setattr(context_tree, "CHUNK", chunk)
    docs = small_documents(spark).unionByName(
        edge_documents(spark).where("length(text) < 1000 or text is null").select("doc_id", "text")
    )
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    agree(scoring.language_scores(docs, frequent=frequent, block_nodes=blocks).collect(), plain_scores(rows))


@pytest.mark.parametrize("most", [0, 200, 100_000])
def test_texts_are_passed_over_once_whatever_the_nodes(spark, monkeypatch, most):
    """A bounded broadcast of grams, all others joined: no pass over the texts for each block of nodes."""
    docs = small_documents(spark).limit(25)
    rows = [(r.doc_id, r.text) for r in docs.collect()] + [(70, None), (71, "held \u00e9\u00e9 zq zq"), (72, "held \u00e9\u00e9 zq zq")]
    labels, staged = [], scoring.staged
    monkeypatch.setattr(scoring, "staged", lambda frame, label: labels.append(label) or staged(frame, label))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    agree(scoring.language_scores(docs, block_nodes=most).collect(), plain_scores(rows))
    assert len(labels) == len(set(labels)) <= 4


def test_scores_edges(spark):
    assert scoring.language_scores(no_documents(spark)).count() == 0
    found = scoring.language_scores(edge_documents(spark)).collect()
    assert len(found) == len(edge_documents(spark).collect())
    assert all(math.isfinite(r.score) and r.score <= 0 for r in found)
    # nothing to learn from: every decision is even
    only_held_out = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = scoring.language_scores(spark.createDataFrame([(only_held_out, "abc")], "doc_id long, text string")).collect()
    assert row.score == pytest.approx(4 * 8 * math.log10(0.5)) and row.n_known == 0 and row.train_tokens == 0


def test_scores_whole_table(spark):
    found = QUERIES["op5_context_tree_scores"](spark, "/root/testdata/sf0.1")
    totals = found.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.count("*")).first()
    assert totals[2] > 1000 and totals[0] > totals[1]


def test_probabilities_of_all_next_bytes_sum_to_one():
    rng = np.random.default_rng(2)
    text = rng.choice(list(b"abcab  \xc3\xa9"), 3000).astype(np.uint8).tobytes()
    codes, counts = np.unique(context_tree.grams(list(context_tree.segments(text))), return_counts=True)
    near = context_tree.near_of(codes)
    parts = [context_tree.subtree(codes[near == n], counts[near == n]) for n in np.unique(near)]
    levels = [
        context_tree.Level(*(np.concatenate(x) for x in zip(*((v[0][d].keys, v[0][d].estimate, v[0][d].weight) for v in parts))))
        for d in range(context_tree.DEPTH - context_tree.NEAR + 1)
    ]
    for level in levels:
        order = np.argsort(level.keys)
        level.keys, level.estimate, level.weight = level.keys[order], level.estimate[order], level.weight[order]
    keys, a, b, logs = (np.concatenate(x) for x in zip(*(v[1] for v in parts)))
    above, a, b, logs = context_tree._summed(context_tree.parent(keys, 2), a, b, logs)
    levels = context_tree.trunk(above, a, b, logs) + levels
    odds, _ = context_tree.answers(levels)
    found = [(level.keys, x) for level, x in zip(levels, odds)]
    for context in (b"babca", b"zzzzz", b"cab  ", b"zzz\xc3\xa9"):
        codes = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.sum(10 ** context_tree.log10_of(codes, found)) == pytest.approx(1, abs=1e-5)


# -- toxicity --------------------------------------------------------------------------------


def test_toxicity_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    found = QUERIES["op7_toxicity"](spark, sf)
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    assert found.count() == documents.count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = [r for r in found.collect() if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    hits = sum(r.predicted and labels[r.doc_id] for r in rows)
    assert hits / sum(r.predicted for r in rows) > 0.85
    assert hits / sum(labels[r.doc_id] for r in rows) > 0.85


def toy_documents(spark, n=240):
    rows, labels = [], []
    for i in range(n):
        toxic = i % 3 == 0
        words = [f"w{(i * 7 + k * 13) % 50}" for k in range(12)]
        if toxic:
            words[i % 12] = "nasty" if i % 2 else "vile"
        rows.append((i, " ".join(words), "en" if i % 2 else "fr", "s", None, "clash", None, None))
        labels.append((i, None, int(toxic)))
    labels += [(None, 1, 1), (5, 1, None), (9999, 0, 1), (3, 0, 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, label int, words string"
    return spark.createDataFrame(rows, schema), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxicity_learns_words_and_keeps_columns(spark):
    docs, labels = toy_documents(spark)
    model = toxicity.train(docs, labels)
    found = {r.doc_id: r for r in toxicity.scores(docs, model).collect()}
    wrong = sum((found[i].score >= 0.7) != (i % 3 == 0) for i in range(240))
    assert wrong <= 5
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns
    assert {r.doc_id for r in left.collect()} == {i for i, r in found.items() if not r.rejected}
    again = toxicity.train(docs.repartition(5), labels.repartition(3))
    assert np.array_equal(again.embedding, model.embedding) and again.thresholds == model.thresholds


def test_long_texts_are_scored_whole(spark, monkeypatch):
    docs, labels = toy_documents(spark)
    model = toxicity.train(docs, labels)
    text = " ".join(f"w{k % 50}" for k in range(500))
    whole = toxicity.Scorer(model).score(text + " vile " + text)
    assert whole > toxicity.Scorer(model).score(text + " " + text)
    monkeypatch.setattr(toxicity, "CHUNK", 7)
    assert toxicity.Scorer(model, most=60).score(text + " vile " + text) == pytest.approx(whole, abs=1e-6)


def test_toxicity_edges(spark):
    docs, labels = toy_documents(spark)
    model = toxicity.train(docs, labels)
    edges = edge_documents(spark)
    found = toxicity.digest(toxicity.scores(edges, model)).collect()
    assert len(found) == edges.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.scores(no_documents(spark), model).count() == 0
    for some, share in ((labels.limit(0), 0.0), (labels.where("toxic = 1 and doc_id < 200"), 1.0)):
        constant = toxicity.train(docs, some)
        assert {r.score for r in toxicity.scores(docs, constant).collect()} == {share}
    assert toxicity.train(no_documents(spark), labels).constant == 0.0


def test_gradients():
    rng = np.random.default_rng(4)
    model = toxicity.fit(["a b c d", "e f g h"], [0, 1], ["x", "y"])
    model.embedding = rng.standard_normal(model.embedding.shape)
    for name in ("filters", "offsets", "weights"):
        setattr(model, name, rng.standard_normal(getattr(model, name).shape))
    buckets = rng.integers(0, 50, (9, toxicity.PIECES)).astype(np.int32)

    def loss():
        pooled = np.zeros((len(toxicity.WIDTHS), toxicity.FILTERS))
        embedded, at = model.embedding[buckets].sum(axis=1), 0
        for k, width in enumerate(toxicity.WIDTHS):
            values = sum(embedded[p : 9 - width + 1 + p] @ model.filters[at + p] for p in range(width))
            pooled[k] = np.maximum(values.max(axis=0) + model.offsets[k], 0)
            at += width
        return math.log1p(math.exp(-(pooled.ravel() @ model.weights)))

    arrays = (model.embedding, model.filters, model.offsets, model.weights)
    gradients = [np.zeros_like(a) for a in arrays] + [np.zeros(1)]
    toxicity._backward(model, buckets, 1.0, 0.0, gradients)
    for array, gradient in zip(arrays, gradients):
        flat = np.flatnonzero(gradient)[:20]
        for i in flat:
            old = array.flat[i]
            array.flat[i] = old + 1e-6
            high = loss()
            array.flat[i] = old - 1e-6
            low = loss()
            array.flat[i] = old
            assert (high - low) / 2e-6 == pytest.approx(gradient.flat[i], abs=1e-3)


def plain_score(model, text):
    """The network word by word: summed embeddings, each filter at each place, largest value, logistic unit."""
    words = [re.sub(rb"[^0-9a-z\x80-\xff]+", b" ", (text or "").lower().encode()).split()][0]
    vectors = [sum(model.embedding[b].astype(float) for b in toxicity.piece_buckets(w)) for w in words]
    total, at, unit = model.bias, 0, 0
    for k, width in enumerate(toxicity.WIDTHS):
        for f in range(toxicity.FILTERS):
            values = [
                sum(vectors[i + p] @ model.filters[at + p][:, f] for p in range(width)) + model.offsets[k, f]
                for i in range(len(vectors) - width + 1)
            ]
            total += model.weights[unit] * max([0.0, *values])
            unit += 1
        at += width
    return 1 / (1 + math.exp(-(model.slope * (total - model.border) + math.log(0.7 / 0.3))))


def test_toxicity_query_matches_a_plain_forward_pass(spark):
    documents, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(documents, labels)
    found = {r.doc_id: r for r in QUERIES["op7_toxicity"](spark, SF).collect()}
    rows = documents.collect()
    assert len(found) == len(rows)
    for row in rows:
        got, want = found[row.doc_id], plain_score(model, row.text)
        assert got.score == pytest.approx(want, abs=1e-4), row.doc_id
        assert got.threshold == model.thresholds.get(row.lang, toxicity.THRESHOLD)
        assert got.rejected == (got.score >= got.threshold) and got.predicted == (got.score >= 0.7)
