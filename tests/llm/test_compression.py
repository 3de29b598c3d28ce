"""Compression bands and the plain counts beside them."""

import random
import re
import string
from collections import Counter

import pytest
import zstandard

from edge import edge_documents, no_documents
from terrapanel.llm import compression
from terrapanel.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = r"[^\x20\x09-\x0D]+"


def plain(text):
    text = text or ""
    words = re.findall(WORD, text)
    lines = [line for line in text.split("\n") if re.search(WORD, line)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {k for i, w in enumerate(windows) if often[w] > 1 for k in range(i, i + 8)}
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    n = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)
    return (*n, failed, not failed and plain_reason(text.encode()) == "")


def plain_reason(data):
    """Bands by hand: whole text first, then the chunks' bytes outside."""

    def outside(piece):
        ratio = len(zstandard.ZstdCompressor(level=3).compress(piece)) / len(piece)
        least, most = next((b.least, b.most) for b in compression.BANDS if len(piece) < b.below)
        return "repetitive" if ratio < least else "incompressible" if ratio > most else ""

    if not data or outside(data):
        return outside(data) if data else ""
    pieces = [data[i : i + 4096] for i in range(0, len(data), 4096)]
    pieces = [p for p in pieces if len(p) >= 1024] if len(data) > 4096 else []
    bad = sum(len(p) for p in pieces if outside(p))
    return "parts" if bad > 0.25 * sum(map(len, pieces)) else ""


def check(rows, found):
    columns = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    want = sorted(((i, *plain(t)) for i, t in rows), key=str)
    assert sorted(((r.doc_id, *(r[c] for c in columns)) for r in found.collect()), key=str) == want


def test_whole_table_matches_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check(rows, QUERIES["op12_compression_bands"](spark, SF))


def test_edges(spark):
    docs = edge_documents(spark)
    check([(r.doc_id, r.text) for r in docs.collect()], compression.quality(docs))
    assert compression.quality(no_documents(spark)).count() == 0
    left = compression.clean(docs.withColumnsRenamed({"spans": "kept", "shard": "ratio"}))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept", "ratio", "words"]
    assert all(plain(r.text)[-1] for r in left.collect())


def prose(rng, n):
    return " ".join("".join(rng.choices("etaoinshrdlu", weights=range(12, 0, -1), k=rng.randint(2, 9))) for _ in range(n))


def noise(rng, n):
    return "".join(rng.choices(string.ascii_letters + string.digits + "+/", k=n))


@pytest.mark.parametrize("words", [40, 300, 3000, 20000])
def test_bands_by_length(words):
    rng = random.Random(words)
    judge = compression.Compressor()
    text = prose(rng, words)
    phrase = prose(rng, 9) + " "
    assert judge.judged(text.encode())[2] == ""
    assert judge.judged((phrase * (len(text) // len(phrase) + 1)).encode())[2] == "repetitive"
    if words >= 300:
        lines = " ".join(noise(rng, 60) for _ in range(len(text) // 61))
        assert judge.judged(lines.encode())[2] == "incompressible"


def test_chunks_see_what_the_whole_hides():
    rng = random.Random(3)
    judge = compression.Compressor()
    text = prose(rng, 2000) + noise(rng, 6000) + " same words here" * 400
    ratio, share, reason = judge.judged(text.encode())
    assert compression.verdict(len(text), ratio) == "" and share > 0.25 and reason.endswith("in parts")


def test_quality_labels(spark):
    """Every document that the base rule passes and the labels call good stays, and most junk that it passes by repetition goes."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality is not null").collect()}
    rows = QUERIES["op12_compression_bands"](spark, sf).collect()
    good = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    assert len(good) > 100 and all(r.kept for r in good)
