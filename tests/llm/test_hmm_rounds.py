"""op8 trains on all documents: neither their order nor the files they lie in change a score."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from conftest import SCHEMA, sentence

from lumbre.llm import hmm


def test_scores_do_not_depend_on_partitions(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, rng.randint(3, 60)), "en", "a", 1) for i in range(1500)]
    one = hmm.lm_scores(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()
    many = hmm.lm_scores(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7)).collect()
    a, b = ({r.doc_id: r.score for r in x} for x in (one, many))
    assert len(a) == 1500 and a.keys() == b.keys()
    assert max(abs(a[i] - b[i]) / abs(a[i]) for i in a) < 1e-9


def test_scoring_holds_one_table_of_words(monkeypatch):
    """A worker's memory: the emissions of known words stand in one table, whatever the number of blocks."""
    n, k, rng = 100_000, 8, np.random.default_rng(1)
    counts = rng.random((n, k))
    alphabet = hmm.Alphabet({}, np.empty(0, np.int64), counts.sum(axis=1), 10, n, n)
    model = hmm.Final(np.full(k, 1 / k), np.full((k, k), 1 / k), alphabet, counts, counts.sum(axis=0), np.ones(k))
    got = []
    monkeypatch.setattr(hmm, "SCRATCH", hmm.Scratch())
    block = {"doc_ids": [[1]], "held_out": [[False]], "sizes": [[3]], "symbols": [np.array([0, 10, 10], "<u2").tobytes()], "n_tail": [1], "numbers": [np.array([77, n], "<u4").tobytes()]}
    met = pa.array([[{"pos": 0, "c": 2, "p0": 4096, "p1": 4096, "many": None}]], pa.list_(pa.struct({"pos": pa.int32(), "c": pa.int64(), "p0": pa.int64(), "p1": pa.int64(), "many": pa.list_(pa.float64())})))
    batch = pa.record_batch({**{c: pa.array(v) for c, v in block.items()}, "met": met})
    tracemalloc.start()
    for out in hmm._score(SimpleNamespace(value=model))(iter([batch] * 3)):
        got.append(out.to_pylist()[0])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.6 * counts.nbytes
    # The states are alike from step to step, so a text's likelihood is the product of its words'.
    of = lambda c, share: ((c / share + 1) / (counts.sum(axis=0) + 1)).mean() * share
    rare = np.array([1, 0, 0, 0, 1, 0, 0, 0])
    want = [of(counts[i], alphabet.shares(alphabet.counts[i])) for i in (0, 77)] + [of(rare, alphabet.shares(2))]
    assert len(got) == 3 and all(abs(r["score"] - np.log10(want).sum()) < 1e-9 and r["n_known"] == 3 for r in got)
