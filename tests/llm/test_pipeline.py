"""The pipeline's stages against brute force, and what they return on odd tables."""

import hashlib

import pytest
from test_dedup import norm
from test_near_copies import survivors
from test_scans import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lumbre.llm import _shared, ordinal, trie_bpe


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontaminate", "bpe"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_run_equals_brute_force(spark, sf):
    """The classifier's scores are taken from the operator; all that follows is done by hand."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    selected = {r.doc_id for r in ordinal.quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).filter("selected").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in selected)
    seen: dict[str, int] = {}
    rows = [r for r in rows if seen.setdefault(norm(r[1]), r[0]) == r[0]]
    stay, _ = survivors(rows)
    rows = [r for r in rows if r[0] in stay]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    dirty = {r[0] for r in brute(rows, items) if r[5]}
    tokenizer = Tokenizer.from_file(trie_bpe.default_path())
    want = []
    for i, t in rows:
        if i not in dirty:
            ids = tokenizer.encode(t, add_special_tokens=False).ids
            want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()))
    got = corpus_pipeline.run(spark, sf).select("doc_id", "n_tokens", "ids_sha256").collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert 0 < len(want) < len(selected) < docs.count()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES, ids=lambda s: s[0])
def test_stage_on_odd_and_empty_tables(spark, sf, odd, empty, stage):
    name, f = stage
    for docs in (odd, empty):
        out = f(spark, docs, sf)
        assert name == "bpe" or out.columns == docs.columns
        assert out.count() <= docs.count()


def test_stages_beyond_the_broadcast_bound(spark, sf, odd, monkeypatch):
    """Lists that are shuffled take the same rows away."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = lambda df: sorted((repr(r.doc_id), r.text or "") for r in df.collect())
    stages = corpus_pipeline.STAGES[1:4]
    want = [[rows(f(spark, t, sf)) for t in (docs, odd)] for _, f in stages]
    monkeypatch.setattr(_shared, "MAX_BROADCAST_ROWS", -1)
    for (_, f), w in zip(stages, want):
        assert [rows(f(spark, t, sf)) for t in (docs, odd)] == w
