"""What the Python workers hold from stage to stage."""

import gc
import weakref
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terrapanel.llm import decontamination, near_duplicates, tokenization, toxicity, words
from terrapanel.llm.workers import forget, rows_with_text

TEXTS = pa.record_batch({"doc_id": pa.array([1, 2]), "text": pa.array(["one two three", None])})


def scored():
    list(toxicity._scored([TEXTS], SimpleNamespace(value=("model", toxicity.Model()))))


def scanned():
    list(decontamination._scanner(SimpleNamespace(value=("items", [("a", b"one two")])), 10, True, True)([TEXTS]))


def encoded():
    with open(tokenization.default_model(), "rb") as file:
        list(tokenization._encoded([TEXTS], SimpleNamespace(value=file.read()), True))


def signed():
    list(near_duplicates._signed([TEXTS], 5))


def made():
    list(near_duplicates._sets([TEXTS], 5, SimpleNamespace(value=np.zeros(1024, np.uint64))))


@pytest.mark.parametrize("after", [scored, scanned, encoded, signed, made])
def test_a_worker_lets_go_of_earlier_stages_tools(monkeypatch, after):
    """Of all stages that one worker runs, only the last one's tools stay: a scorer, matchers and an encoder add up to hundreds of MB."""
    seen = []
    forget()

    def watched(kind):
        made = kind.__init__

        def init(self, *args, **kwargs):
            made(self, *args, **kwargs)
            seen.append((kind, weakref.ref(self)))

        monkeypatch.setattr(kind, "__init__", init)

    own = {"scored": toxicity.Scorer, "scanned": decontamination.Matcher, "encoded": tokenization.Encoder}
    for kind in own.values():
        watched(kind)
    for step in (scored, scanned, encoded, after):
        step()
    gc.collect()
    assert {kind for kind, _ in seen} == set(own.values())
    assert {kind for kind, ref in seen if ref() is not None} <= {own.get(after.__name__)}


def test_a_tool_is_built_once_for_a_stage(monkeypatch):
    built, kind = [], toxicity.Scorer
    monkeypatch.setattr(toxicity, "Scorer", lambda model: built.append(model) or kind(model))
    forget()
    scored()
    scored()
    assert len(built) == 1


def test_texts_are_handed_over_once(spark):
    """A row that has the text as a string isn't sent with a second copy; any other text is."""
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    assert rows_with_text(docs, docs.columns, "text").columns == ["row"]
    assert rows_with_text(docs, ["doc_id"], "text").columns == ["row", "text"]
    numbers = docs.withColumn("text", F.col("doc_id") * 10).withColumn("lang", F.lit("en"))
    assert rows_with_text(numbers, numbers.columns, "text").columns == ["row", "text"]
    model = toxicity.Model(bias=-1.0)
    for frame in (docs.withColumn("lang", F.lit("en")), numbers, numbers.withColumnRenamed("text", "Text")):
        left = toxicity.clean(frame, model)
        assert left.schema == frame.schema and sorted(left.collect(), key=str) == sorted(frame.collect(), key=str)
    tokens = {r.doc_id: r.ids for r in tokenization.encode(docs).collect()}
    spelled = {r.doc_id: r.ids for r in tokenization.encode(docs.withColumnRenamed("text", "Text")).collect()}
    assert tokens == spelled and len(tokens[1]) > len(tokens[2]) == 2


def test_sets_are_handed_on_in_bounded_batches(monkeypatch):
    monkeypatch.setattr(near_duplicates, "BATCH_BYTES", 4_000)
    texts = [" ".join(f"w{i}x{k}" for k in range(100 + i)) for i in range(40)] + [None, "one two"]
    wanted = SimpleNamespace(value=np.full(1024, ~np.uint64(0)))
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    done = list(near_duplicates._sets([batch], 2, wanted))
    assert len(done) > 5 and max(len(b["members"].flatten()) for b in done) * 8 < 4_000 + 140 * 8
    hashes = words.WordHashes()
    sets = [near_duplicates.shingles(words.space_words((t or "").encode()), hashes, 2) for t in texts]
    assert [m for b in done for m in b["members"].to_pylist()] == [s.view(np.int64).tolist() for s in sets if len(s)]
