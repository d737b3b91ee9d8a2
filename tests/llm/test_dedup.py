"""op7 and op10 against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from oracle import check, connection

from lumbre.llm import digest_index, queries, simhash


def fingerprint(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]
    if not words:
        return 0
    parts = [" ".join(words)] if len(words) < shingle else [" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64(p.encode(), seed=42).intdigest() for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(fps))]


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    comp = brute_components(fps)
    least = {}
    for (i, _), c in zip(rows, comp):
        if i is not None:
            least[c] = min(i, least.get(c, i))
    return sorted(((i, f"{f:016x}", least.get(c)) for (i, _), f, c in zip(rows, fps, comp)), key=repr)


def test_op7_equals_brute_force(spark, sf, documents):
    want = expected([(r.doc_id, r.text) for r in documents.collect()])
    got = sorted((tuple(r) for r in queries.op7_simhash(spark, sf).collect()), key=repr)
    assert got == want


def test_op7_odd_rows(odd, odd_rows):
    got = simhash.near_duplicates(odd).select("doc_id", "fingerprint", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == expected([r[:2] for r in odd_rows])


def test_op7_keeps_one_of_each_group(odd, odd_rows):
    left = simhash.one_of_each_group(odd)
    assert left.columns == odd.columns
    groups = len(set(brute_components([fingerprint(r[1]) for r in odd_rows])))
    # Rows that repeat an id with its text are one row to it; exact deduplication tells them apart.
    assert left.dropDuplicates(["doc_id", "text"]).count() == groups


def test_op7_empty(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert simhash.one_of_each_group(empty).columns == empty.columns


def test_spark_hash_is_the_contracts_hash(spark):
    texts = ["a b c", "ñandú x y", "z" * 100]
    got = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) h").collect()
    assert [r.h % (1 << 64) for r in got] == [xxhash.xxh64(t.encode(), seed=42).intdigest() for t in texts]


def clustered(seed, n, spread):
    """Fingerprints in clusters, chains among them, and apart."""
    rng = random.Random(seed)
    out = []
    for _ in range(n // spread):
        x = rng.getrandbits(64)
        for _ in range(spread):
            out.append(x)
            for b in rng.sample(range(64), rng.randint(1, 4)):
                x ^= 1 << b
    return sorted(set(out))


def test_every_link_meets_in_a_bucket():
    rng = random.Random(5)
    for _ in range(300):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(0, 3)):
            y ^= 1 << b
        pair = np.array([x, y], np.uint64)
        shared = [(c, k) for c, k in simhash.block_keys(pair) if k[0] == k[1]]
        assert shared
        assert any(f[0] == f[1] for f in simhash.fine_keys(pair, shared[0][0]))


def test_fine_buckets_have_a_bound():
    x = np.array([0], np.uint64)
    for choice in (0, 7, 19):
        free = [64 - int(np.bitwise_count(simhash.fine_keys(np.array([0xFFFFFFFFFFFFFFFF], np.uint64), choice)[g])[0]) for g in range(56)]
        assert len(free) == 56 and max(free) <= 13 and len(simhash.fine_keys(x, choice)) == 56


@pytest.mark.parametrize(("n", "spread", "limit"), [(400, 40, 16384), (400, 40, 5), (150, 1, 16384)])
def test_links_and_components(spark, n, spread, limit):
    fps = clustered(n + spread, n, spread)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links_between(df, 3, limit)
    for a, b in map(tuple, edges.collect()):
        assert ((a ^ b) & (1 << 64) - 1).bit_count() <= 3
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    comp = brute_components(fps)
    mine = [roots.get(f, f) for f in signed]
    assert len(set(zip(comp, mine))) == len(set(comp)) == len(set(mine))


def test_pivots_discard_nothing_that_links():
    fps = np.array(clustered(9, 300, 30), np.uint64)
    table = simhash.pivot_table(fps, fps[::20]).astype(int)
    for i in range(len(fps)):
        for j in range(i):
            if int(fps[i] ^ fps[j]).bit_count() <= 3:
                assert np.abs(table[i] - table[j]).max() <= 3


def test_pivots_work_in_buckets_of_any_size(spark):
    """3,000 fingerprints that agree in half their bits, some of them near others: the table discards nearly all pairs, and nothing is lost."""
    rng = random.Random(12)
    low = rng.getrandbits(33)
    fps = [rng.getrandbits(31) << 33 | low for _ in range(3000)]
    for i in range(0, 3000, 10):
        fps.append(fps[i] ^ 1 << rng.randrange(33, 64) ^ 1 << rng.randrange(33, 64))
    fps = sorted(set(fps) | {rng.getrandbits(64) for _ in range(100)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = simhash.search(spark.createDataFrame([(f,) for f in signed], "fp long"))
    looked, left = simhash.pivot_effect(found)
    assert looked > 1_000_000 and left < 0.01 * looked
    roots = {r.node: r.root for r in simhash.components(found.filter("a is not null").select("a", "b")).collect()}
    comp, mine = brute_components(fps), [roots.get(f, f) for f in signed]
    assert len(set(zip(comp, mine))) == len(set(comp)) == len(set(mine)) < len(fps)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r.root for r in simhash.components(edges).collect()} == {0}


def test_op10_equals_sql(spark, sf):
    check(queries.op10_exact_dedup(spark, sf), connection(sf), queries.oracle_sql()["op10_exact_dedup"])


def norm(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def test_op10_odd_rows(odd, odd_rows):
    groups = {}
    for i, t, *_ in odd_rows:
        groups.setdefault(norm(t), []).append(i)
    want = []
    for i, t, *_ in odd_rows:
        ids = [x for x in groups[norm(t)] if x is not None]
        keep = min(ids) if ids else None
        want.append((i, keep, len(groups[norm(t)]), i == keep, norm(t)))
    got = digest_index.exact_dedup(odd).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_op10_distinct_rows(odd, odd_rows):
    left = digest_index.distinct_rows(odd)
    assert left.columns == odd.columns
    assert sorted(norm(r.text) for r in left.collect()) == sorted({norm(r[1]) for r in odd_rows})


def test_op10_empty(empty):
    assert digest_index.exact_dedup(empty).collect() == []
    assert digest_index.distinct_rows(empty).columns == empty.columns


def test_op10_index_grows_by_new_texts_only(spark, documents):
    index = digest_index.DigestIndex(spark, buckets=3)
    first, second = documents.filter("doc_id % 3 = 0"), documents
    index.append_new(index.digests(first))
    before = index.table().count()
    groups = index.append_new(index.digests(second))
    assert before + groups.filter("fresh").count() == index.table().count() == documents.select(digest_index.normalised(documents.text)).distinct().count()
    assert index.append_new(index.digests(second)).filter("fresh").count() == 0
    plan = index.digests(second).hint("merge").join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert plan.count("Exchange") == 1  # of the new digests
    index.drop()
    assert not index.exists() and not spark.catalog.tableExists(f"{index.name}_copies")


@pytest.mark.parametrize("batches", [1, 2, 5])
def test_op10_batches_give_the_same_rows(odd, batches):
    one = digest_index.exact_dedup(odd).collect()
    assert sorted(map(tuple, digest_index.exact_dedup(odd, batches=batches).collect()), key=repr) == sorted(map(tuple, one), key=repr)


def test_op10_later_batches_count_with_earlier_ones(spark):
    """Sizes and smallest ids hold over all batches; distinct_rows returns what is new to the index, once."""
    make = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = digest_index.DigestIndex(spark, buckets=2)
    digest_index.exact_dedup(make((5, "a b"), (6, "a  b"), (7, "c")), index=index)
    got = digest_index.exact_dedup(make((0, "a b"), (8, "a\tb"), (8, "a b"), (9, "d"), (None, "a b")), index=index).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in got) == [(False, 0, 0, 6, True), (False, 8, 0, 6, False), (False, 8, 0, 6, False), (False, 9, 9, 1, True), (True, 0, 0, 6, False)]
    new = digest_index.distinct_rows(make((1, "c"), (2, "e"), (2, "e"), (3, "e "), (4, "a b")), index=index)
    assert [tuple(r) for r in new.collect()] == [(2, "e"), (3, "e ")]
    assert digest_index.distinct_rows(make((2, "e"), (20, "f")), index=index).collect() == [(20, "f")]
    index.drop()


def test_op10_leaves_no_table(spark, documents):
    before = len(spark.catalog.listTables())
    digest_index.exact_dedup(documents).count()
    digest_index.distinct_rows(documents).count()
    assert len(spark.catalog.listTables()) == before
