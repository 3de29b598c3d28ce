"""Periodic runs against brute force, and the grammar's extensions against plain comparison."""

import hashlib
import random
import re
import zlib

import numpy as np

from edge import edge_documents, no_documents
from terrapanel.llm import periodicity
from terrapanel.llm.queries import QUERIES
from terrapanel.llm.recompression import Grammar

SF = "/root/testdata/sf0.001"


def plain_runs(words):
    """Every period in turn, ascending, so that a stretch first shows with its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted((s, length, q) for (s, length), q in found.items())


def plain(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = sorted(plain_runs(words), key=lambda r: (r[0], r[2]))
    dropped = {k for s, length, q in runs for k in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    kept = " ".join(w for k, w in enumerate(words) if k not in dropped)
    return (doc_id, len(runs), *head, sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(kept))


def test_whole_table_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect())
    assert found == sorted(plain(*r) for r in rows)
    assert sum(r[1] > 0 for r in found) >= 5


def test_edges(spark, monkeypatch):
    docs = edge_documents(spark)
    want = sorted((plain(r.doc_id, r.text) for r in docs.collect() if len(r.text or "") < 10**5), key=str)
    for group in (periodicity.GROUP, 3):
        monkeypatch.setattr(periodicity, "GROUP", group)
        short = docs.where("text is null or length(text) < 100000")
        found = periodicity.digest(periodicity.periodic_runs(periodicity.with_planted_periods(short)))
        assert sorted((tuple(r) for r in found.collect()), key=str) == want
    assert periodicity.digest(periodicity.periodic_runs(docs)).count() == docs.count()
    assert periodicity.periodic_runs(no_documents(spark)).count() == 0
    nothing = spark.createDataFrame([(None, None)], "doc_id long, text string")
    (row,) = periodicity.digest(periodicity.periodic_runs(periodicity.with_planted_periods(nothing))).collect()
    assert tuple(row) == plain(None, None)


def test_random_texts_match_brute_force(monkeypatch):
    rng = random.Random(4)
    for portion in (1_000_000, 5):
        monkeypatch.setattr(periodicity, "CANDIDATES", portion)
        for _ in range(300):
            texts = []
            for _ in range(rng.randint(1, 5)):
                n, k = rng.choice([0, 1, 5, 7, 30, 120]), rng.choice([1, 2, 3, 30])
                words = [bytes([97 + rng.randrange(k)]) for _ in range(n)]
                if n and rng.random() < 0.6:
                    a = rng.randrange(n)
                    p = 1 + rng.randrange(max(1, (n - a) // 4))
                    words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
                texts.append(words)
            for words, found in zip(texts, periodicity.runs(texts)):
                assert [tuple(r) for r in found.tolist()] == sorted(plain_runs(words), key=lambda r: (r[0], r[2]))


def test_extensions_match_plain_comparison():
    rng = np.random.default_rng(5)
    for symbols in (1, 2, 5, 50):
        middle = rng.integers(0, symbols, 3000)
        middle[1500:2400] = middle[200:1100]
        middle[700:760] = 0
        sequence = np.concatenate([[symbols], middle, [symbols + 1]])
        grammar = Grammar(sequence, least=4)
        i = rng.integers(1, 2999, 2000)
        j = np.minimum(i + rng.integers(1, 1500, 2000), 3000)
        i[:900], j[:900] = np.arange(200, 1100), np.arange(1500, 2400)
        ahead, behind = grammar.extend(i, j), grammar.extend(i, j, ahead=False)
        for a, b, f, r in zip(i.tolist(), j.tolist(), ahead.tolist(), behind.tolist()):
            k = 0
            while sequence[a + k] == sequence[b + k] and b + k < 3001:
                k += 1
            m = 0
            while a - m >= 1 and sequence[a - m - 1] == sequence[b - m - 1]:
                m += 1
            assert (f, r) == (k, m)


def test_a_grammar_shrinks():
    """Rounds grow with the logarithm of the length; a repeated stretch costs next to nothing."""
    rng = np.random.default_rng(6)
    grammar = Grammar(rng.integers(0, 1000, 100_000))
    assert sum(map(len, grammar.symbols)) < 12 * 100_000 and len(grammar.symbols) < 120
    run = Grammar(np.concatenate([[1], np.zeros(100_000, np.int64), [2]]))
    assert len(run.symbols[1]) == 3
