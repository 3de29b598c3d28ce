"""The pipeline against its stages in plain Python."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from edge import edge_documents
from terrapanel.llm import near_duplicates, secrets, tokenization, toxicity
from test_matching import plain_components, plain_contamination, shingle_set
from test_native import plain_added, plain_base

SF = "/root/testdata/sf0.001"


def hidden(text):
    base = plain_base(text)
    chars = list(text)
    for a, _, b, _ in base + plain_added(text, base):
        chars[a:b] = ["\0"] * (b - a)
    out, last = [], None
    for c in chars:
        if c != "\0" or last != "\0":
            out.append("[SECRET]" if c == "\0" else c)
        last = c
    return "".join(out)


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    model = toxicity.train(docs, labels)
    scorer = toxicity.Scorer(model)
    rows = [
        r
        for r in docs.orderBy("doc_id").collect()
        if scorer.score(r.text) < model.thresholds.get(r.lang, toxicity.THRESHOLD)
    ]
    kept = {i for i, _, _, k in plain_components([(r.doc_id, r.text) for r in rows], corpus_pipeline.SHINGLE) if k}
    rows = [r for r in rows if r.doc_id in kept]
    benchmark = [(r.item_id, r.text) for r in items.collect()]
    leaks = {r[0] for r in plain_contamination([(r.doc_id, r.text) for r in rows], benchmark) if r[5]}
    want = {r.doc_id: (hidden(r.text), r.lang, r.source) for r in rows if r.doc_id not in leaks}
    assert 0 < len(want) < docs.count() and leaks
    found = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.text, r.lang, r.source) for r in found} == want and len(found) == len(want)
    assert all(r.n_chars == len(r.text) for r in found)
    with open(tokenization.default_model(), "rb") as file:
        encoder = tokenization.Encoder(tokenization.Model(file.read()))
    assert all(r.ids == np.frombuffer(encoder.encode(r.text), "<u4").tolist() for r in found)


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_any_table(spark, name, stage):
    docs = edge_documents(spark).withColumnsRenamed({"spans": "odd name", "shard": "ids"})
    extra = [] if name != "encoding" else ["ids"]
    done = stage(spark, docs, SF)
    assert sorted(done.columns) == sorted({*docs.columns, *extra})
    done.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    nothing = docs.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema])
    stage(spark, nothing, SF).collect()


def test_one_document_of_each_group_stays(spark):
    rows = [(3, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "other words here"), (None, "other words here")]
    rows += [(7, "seven seven seven"), (7, "seven seven seven"), (8, ""), (9, ""), (9, None)]
    docs = spark.createDataFrame([(i, t, t) for i, t in rows], "doc_id long, text string, row string")
    left = sorted(((r.doc_id, r.text) for r in near_duplicates.deduplicated(docs).collect()), key=str)
    assert left == sorted([(1, "a b c d e f"), (None, "other words here"), (7, "seven seven seven"), (8, ""), (9, None)], key=str)


def test_cleaned_keeps_rows(spark):
    docs = edge_documents(spark)
    done = secrets.cleaned(docs)
    assert done.columns == docs.columns and done.count() == docs.count()
    assert done.where("text like '%[SECRET]%' and n_chars <> length(text)").count() == 0
    assert done.where("text is null").count() == docs.where("text is null").count()


def test_near_duplicate_stage_takes_five_words(spark):
    """Every twentieth word changed: 0.82 alike on two words, 0.6 on five. One word changed: alike on both."""
    words = [f"w{i}" for i in range(200)]
    loose = [f"x{i}" if i % 20 == 10 else w for i, w in enumerate(words)]
    close = ["other" if i == 77 else w for i, w in enumerate(words)]
    rows = [(i, " ".join(w)) for i, w in enumerate((words, loose, close), 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()) == [1, 2]
    assert [r.doc_id for r in near_duplicates.deduplicated(docs).collect()] == [1]


def test_near_duplicate_stage_matches_brute_force_on_five_words(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted((r.doc_id, shingle_set(r.text, 5)) for r in docs.collect())
    least = {i: i for i, _ in rows}
    changed = True
    while changed:
        changed = False
        for (a, one), (b, other) in combinations(rows, 2):
            if least[a] != least[b] and one and other and 100 * len(one & other) >= 80 * len(one | other):
                least[a] = least[b] = min(least[a], least[b])
                changed = True
    found = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    assert found == {i for i, low in least.items() if i == low} and len(found) < len(rows)
