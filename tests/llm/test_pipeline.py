"""Each stage of the pipeline against brute force on what its predecessor kept."""

import hashlib

import numpy as np
import pytest
from test_jaccard import brute as brute_groups
from test_suffix_dedup import brute as brute_repeats
from test_tokens import reference

import corpus_pipeline
from tessella.llm import registry


@pytest.fixture(scope="module")
def stages(spark, sf):
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES:
        rows = stage(spark, docs, sf).collect()
        out.append(rows)
        docs = spark.createDataFrame(rows, docs.schema) if len(out) < len(corpus_pipeline.STAGES) else None
    return out


def test_stages(spark, sf, stages):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    scores = registry.QUERIES["op1_line_field_quality"](spark, sf).where("predicted = 1").collect()
    good, single, clean, pieces = stages
    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in scores)
    assert all(list(r.asDict()) == documents.columns for r in good + single + clean)

    groups = brute_groups([(r.doc_id, r.text) for r in good])
    assert sorted(r.doc_id for r in single) == sorted({g for _, _, g in groups})

    want = {i: found for i, *found in brute_repeats([(r.doc_id, r.text) for r in single], 200)}
    before = {r.doc_id: r.text or "" for r in single}
    assert {r.doc_id for r in clean} == set(want)
    for r in clean:
        _, removed, spans, kept = want[r.doc_id]
        # The kept bytes themselves; only of a character that a cut has split, at an end of a span, the rest goes too.
        lost = len(before[r.doc_id].encode()) - len(r.text.encode()) - removed
        assert r.n_chars == len(r.text) and (hashlib.sha256(r.text.encode()).hexdigest() == kept if not lost else lost <= 6 * spans)

    tokens = {r.doc_id: len(reference("word_bpe_49k.json", r.text)) for r in clean}
    assert {r.doc_id: r.doc_tokens for r in pieces} == tokens
    assert sum(r.length for r in pieces) == sum(tokens.values())


def test_run(spark, sf, stages):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert len({r.doc_id for r in rows}) == len({r.doc_id for r in stages[-1]}) and sum(r.length for r in rows) == sum(r.length for r in stages[-1])
    assert np.isfinite([r.sequence_id for r in rows]).all()


def test_odd_tables(spark):
    """Empty tables, null ids and texts, repeated rows, one id with several texts, and columns that clash with the operators' own."""
    shape = "doc_id long, text string, lang string, source string, n_chars long, id long, key string, component long"
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, words, "a"), (2, words + " x", "b"), (2, "a text of its own under the id of a copy", "c"), (3, words, "d"), (None, words, "e"), (None, None, "f"), (5, None, "g"), (5, "", "h"), (7, "repeated row of one document here", "i"), (7, "repeated row of one document here", "j")]
    docs = spark.createDataFrame([(i, t, x, x, 0, 1, "k", 2) for i, t, x in rows], shape)
    single = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert single.columns == docs.columns
    assert sorted(r.lang for r in single.collect()) == list("acefghij")
    assert sum(r.length for r in corpus_pipeline.pack(spark, docs, "").collect()) >= len(rows)
    for stage in (corpus_pipeline.drop_near_duplicates, corpus_pipeline.drop_repeated_passages, corpus_pipeline.pack):
        assert stage(spark, docs.limit(0), "").count() == 0
