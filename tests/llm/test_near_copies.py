"""The pipeline's near_dedup stage against all pairs of five-word shingle sets."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import SCHEMA, sentence

import corpus_pipeline
from lumbre.llm import _shared, near_copies, ordinal, simhash


def shingles(text):
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    return {b" ".join(words)} if len(words) <= 5 else {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)}


def survivors(rows):
    """Ids that stay, and the number of pairs, by counting what any two sets share."""
    rows = sorted(rows)
    sets, at, shared, root = [shingles(t) for _, t in rows], defaultdict(list), Counter(), list(range(len(rows)))
    for i, s in enumerate(sets):
        for x in s:
            shared.update((j, i) for j in at[x])
            at[x].append(i)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    pairs = [p for p, c in shared.items() if c >= 0.8 * len(sets[p[0]] | sets[p[1]])]
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {r[0] for i, r in enumerate(rows) if find(i) == i}, len(pairs)


def test_stage_links_what_all_pairs_link(spark):
    """Chains, where a copy is near its neighbour and not the first, and copies with a few words changed anywhere."""
    rng, rows = random.Random(11), []
    for group in range(12):
        words = sentence(rng, 150).split()
        for _ in range(8):
            rows.append((len(rows), " ".join(words), "en", "a", 1))
            for at in rng.sample(range(len(words)), 1 + group % 4):
                words[at] = f"changed{rng.random()}"
    want, pairs = survivors([r[:2] for r in rows])
    assert pairs > 50 and 12 <= len(want) < 60
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert {r.doc_id for r in got.collect()} == want


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_stage_on_tables(spark, sf, size):
    docs = corpus_pipeline.exact_dedup(spark, spark.read.parquet(f"{sf}/../{size}/documents.parquet"), sf)
    want, pairs = survivors([(r.doc_id, r.text) for r in docs.collect()])
    assert pairs > 0
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, sf).collect()} == want


def test_buckets_beyond_a_block(spark):
    """Buckets dealt into blocks, with few leaders, connect what all pairs connect."""
    rng, rows = random.Random(4), []
    for group in range(4):
        words = sentence(rng, 150).split()
        for _ in range(60):
            copy = list(words)
            for at in rng.sample(range(len(copy)), rng.randint(0, 7)):
                copy[at] = f"changed{rng.random()}"
            rows.append((len(rows), " ".join(copy)))
    texts = spark.createDataFrame(rows, "doc_id long, text string")
    stored = near_copies.shingle_rows(texts)
    want, pairs = survivors(rows)
    assert pairs > 500 and 4 < len(want) < 200
    for block, leaders in ((8, 1), (8, 0), (1000, 32)):
        roots = {r.node: r.root for r in simhash.components(near_copies.links_between(stored, block, leaders)).collect()}
        groups = {}
        for r in stored.select("doc_id", "fp").collect():
            groups.setdefault(roots.get(r.fp, r.fp), []).append(r.doc_id)
        assert {min(g) for g in groups.values()} == want


def test_components_in_one_task_and_in_rounds(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    frame = spark.createDataFrame(edges, "a long, b long")
    one, rounds = (sorted(map(tuple, simhash.components(frame, n).collect())) for n in (1000, 0))
    assert one == rounds and len(one) > 100


def test_pivot_tables_stand_before_every_candidate(spark):
    """Texts that share a passage meet in buckets; the tables discard most of their pairs, and no link."""
    rng, rows = random.Random(21), []
    passage = sentence(rng, 160)
    for _ in range(60):
        words = sentence(rng, 240).split()
        rows.append((len(rows), f"{passage} {' '.join(words)}"))
        words[120] = "changed"
        rows.append((len(rows), f"{passage} {' '.join(words)}"))
    stored = near_copies.shingle_rows(spark.createDataFrame(rows, "doc_id long, text string"))
    found = near_copies.search(stored)
    looked, left = simhash.pivot_effect(found)
    edges = {frozenset((r.a, r.b)) for r in near_copies.edges_of(found).collect()}
    of = {r.doc_id: r.fp for r in stored.collect()}
    assert edges == {frozenset((of[i], of[i + 1])) for i in range(0, 120, 2)}
    assert 60 <= left < looked / 2


def test_fingerprints_are_op7s_and_wider():
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.random()}" for _ in range(n)) for n in (1, 4, 5, 6, 9, 300, 3000)]
    wide = near_copies.fingerprints([near_copies.shingle_hashes(t) for t in texts])
    assert wide.shape == (7, 4) and (wide[:, 0] == simhash.fingerprints_of(texts, 5)).all()
    apart = np.bitwise_count(wide[:, None] ^ wide[None, :]).sum(axis=2)
    near, left = near_copies.within(wide)
    assert (near == (apart <= near_copies.RADIUS) & ~np.eye(7, dtype=bool)).all() and near.sum() <= 2 * left


def test_radius_holds_what_is_similar():
    """Pairs of similarity 0.8 just so, of small and of large sets, are well within the radius; unrelated ones are not."""
    rng = np.random.default_rng(3)
    for common, one, two in ((4, 0, 1), (8, 1, 1), (8, 2, 0), (40, 5, 5), (400, 50, 50), (400, 0, 100)):
        h = rng.integers(0, 1 << 64, (300, common + one + two), np.uint64)
        a, b = near_copies.fingerprints(list(h[:, : common + one])), near_copies.fingerprints([np.append(x[:common], x[common + one :]) for x in h])
        assert np.bitwise_count(a ^ b).sum(axis=1).max() <= near_copies.RADIUS - 8
        assert np.bitwise_count(a[1:] ^ b[:-1]).sum(axis=1).min() > near_copies.RADIUS


def test_a_worker_forgets_what_the_stage_before_remembers():
    ordinal._memory(1)["word"] = (1,)
    list(near_copies._set_batches(5)(iter([])))
    assert ordinal._memory(1) == {}
    _shared.give_back()
