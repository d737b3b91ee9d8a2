"""Near copies by SimHash and pivot distance tables, for texts whose sets of five-word shingles have a Jaccard similarity
of 0.8 or more: op7's method with a wider fingerprint, and an exact check of the sets after it.

1. A set of 64-bit hashes (XXH64) per document; equal sets collapse to one row. The set's fingerprint is op7's bitwise
   majority, over BITS = 256 bits: the first 64 of the hashes themselves, the others of the hashes mixed again.
2. Candidates meet in buckets. Op7's own 20 choices of three blocks, of the first 64 bits, hold all pairs of up to 3
   differing bits there. Sets of similarity 0.8 differ in some ten of 64 bits, which no blocks are sure to share, so each
   set is also dealt by 35 bands of 5 minima under random orders of its hashes: a pair of similarity 0.8 shares none
   with odds of (1 - 0.8^5)^35 = 9e-7; more similar pairs with less. Of buckets with the same members one stays.
3. A bucket's pivot table holds the Hamming distances of its fingerprints to PIVOTS = 32 of its members. By the triangle
   inequality a pair whose largest coordinate difference is over RADIUS = 84 bits can't be within it: each candidate pair
   of each bucket is discarded by the table or verified by its exact distance, and both are counted (`search`). A bit of
   two sets of similarity 0.8 differs with odds of 0.19 at most (sets of 4 and 5; 0.15 for large ones), so 84 bits are
   passed with odds of 3e-8 at most; two unrelated sets differ in 128 bits and come within 84 with odds of 2e-8.
4. What is within the radius is checked exactly, by the similarity of the whole sets: as a product of 0/1 matrices, for
   each group that distances within the radius connect. What leaves the task is a spanning forest of the links, less
   edges than members.
5. A bucket of more than BLOCK_SETS members is dealt into blocks, and each block also gets the bucket's leaders (some
   LEADERS members, by hash), which connect blocks. What is in different components after that is compared in pairs of
   blocks: those outside the bucket's largest component with all the bucket. So nothing is lost, and a group of copies
   that hangs together costs no more than its size.
6. Components as in op7.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import _shared as S
from lumbre.llm import simhash

SHINGLE = 5
#: The least similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
BANDS, MINIMA = 35, 5
#: Bits of a fingerprint, and how many may differ.
BITS, RADIUS = 256, 84
#: Members of a bucket that its pivot table holds the distances to.
PIVOTS = 32
#: Sets that are compared in one task, and members of a larger bucket that all its blocks get.
BLOCK_SETS, LEADERS = 768, 32
#: Columns of a 0/1 matrix at a time.
COLUMNS = 4096
#: Hashes that are brought into one random order at a time.
BLOCK = 1 << 15


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; a text of fewer words is one shingle, one without words has none."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= shingle:
        return np.array([digest(b" ".join(words), simhash.SEED)], np.uint64)
    return np.unique(np.array([digest(b" ".join(w), simhash.SEED) for w in zip(*(words[k:] for k in range(shingle)))], np.uint64))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """One row per set (none of them empty), one bucket per band."""
    rng = np.random.default_rng(simhash.SEED)
    turn = rng.integers(0, 1 << 64, BANDS * MINIMA, np.uint64)
    times = rng.integers(0, 1 << 64, BANDS * MINIMA, np.uint64) | np.uint64(1)
    out = np.empty((len(sets), BANDS), np.uint64)
    at = 0
    while at < len(sets):
        end, n = at + 1, len(sets[at])
        while end < len(sets) and n + len(sets[end]) <= BLOCK:
            n += len(sets[end])
            end += 1
        h = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at : end - 1])])
        work = np.empty_like(h)
        for band in range(BANDS):
            key = np.full(end - at, band, np.uint64)
            for i in range(band * MINIMA, (band + 1) * MINIMA):
                np.bitwise_xor(h, turn[i], out=work)
                np.multiply(work, times[i], out=work)
                key = (key ^ np.minimum.reduceat(work, starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(29)
            out[at:end, band] = key
        at = end
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of 64-bit words per set (none of them empty): a bit is 1 if it is set in over half of the set's hashes."""
    out = np.empty((len(sets), BITS // 64), np.uint64)
    if not len(sets):
        return out
    counts = np.array([len(s) for s in sets])
    starts, h = np.cumsum(counts) - counts, np.concatenate(sets)
    for word, times in enumerate(np.random.default_rng(simhash.SEED + 1).integers(0, 1 << 64, BITS // 64, np.uint64) | np.uint64(1)):
        if word:
            h = h * times
            h ^= h >> np.uint64(32)
        out[:, word] = ((2 * simhash._lane_sums(h, starts) > counts[:, None]).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _set_batches(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        S.forget()
        for b in S.batches_of(batches, 4 << 20):
            sets = [shingle_hashes(t, shingle) for t in b.column(2).to_pylist()]
            fp = np.array([xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED) for s in sets], np.uint64)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            prints = np.zeros((len(sets), BITS // 64), np.uint64)
            prints[full] = fingerprints([sets[i] for i in full])
            keys = np.concatenate([band_keys([sets[i] for i in full]), *(k[:, None] for _, k in simhash.block_keys(prints[full, 0]))], axis=1)
            sizes = np.zeros(len(sets), np.int64)
            sizes[full] = keys.shape[1]
            held = lambda n, values: pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(values.view(np.int64)))
            members = np.concatenate([np.empty(0, np.uint64), *sets])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64)), held(sizes, keys.ravel()), held([len(s) for s in sets], members), pa.array([r.tobytes() for r in prints], pa.binary())], names=["doc_id", "text_hash", "fp", "bands", "members", "print"])
            del b, sets, keys, members
        S.give_back()

    return run


def within(prints: np.ndarray, radius: int = RADIUS, pivots: int = PIVOTS) -> tuple[np.ndarray, int]:
    """(which pairs of fingerprints differ in at most radius bits, as a symmetric matrix; the number of pairs that the pivot table left)."""
    n = len(prints)
    refs = prints[np.unique(np.linspace(0, n - 1, min(n, pivots)).astype(int))]
    table = np.zeros((n, len(refs)), np.int16)
    for word in range(prints.shape[1]):
        table += simhash.pivot_table(prints[:, word], refs[:, word])
    near = np.triu(np.ones((n, n), bool), 1)
    for p in range(len(refs)):
        near &= np.abs(table[:, None, p] - table[None, :, p]) <= radius
    x, y = np.nonzero(near)
    far = np.bitwise_count(prints[x] ^ prints[y]).sum(axis=1) > radius
    near[x[far], y[far]] = False
    return near | near.T, len(x)


def reached(near: np.ndarray) -> Iterator[np.ndarray]:
    """The groups of several members that the pairs of a symmetric matrix connect, each in rising order."""
    left = np.arange(len(near))
    while len(left):
        group, queue, left = [int(left[0])], [int(left[0])], left[1:]
        while queue and len(left):
            hit = near[queue.pop(), left]
            found = left[hit].tolist()
            group += found
            queue += found
            left = left[~hit]
        if len(group) > 1:
            yield np.sort(np.array(group))


def checked(prints: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """(links as a matrix, upper triangle; the number of pairs that the pivot table left)."""
    near, survivors = within(prints)
    out = np.zeros(near.shape, bool)
    for group in reached(near):
        at = np.ix_(group, group)
        out[at] = linked([sets[i] for i in group]) & near[at]
    return out, survivors


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Which pairs reach the threshold, as a matrix (upper triangle)."""
    sizes = np.array([len(s) for s in sets])
    if len(sets) == 2:
        shared = np.full((2, 2), len(np.intersect1d(sets[0], sets[1], assume_unique=True)), np.int64)
    else:
        owner = np.repeat(np.arange(len(sets)), sizes)
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        several = times[column] > 1
        column, owner = (np.cumsum(times > 1) - 1)[column[several]], owner[several]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        shared = np.zeros((len(sets), len(sets)), np.float32)
        for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            i, j = np.searchsorted(column, [at, at + COLUMNS])
            m = np.zeros((len(sets), COLUMNS), np.float32)
            m[owner[i:j], column[i:j] - at] = 1
            shared += m @ m.T
        shared = shared.astype(np.int64)
    # i / (m + n - i) >= p / q, that is (p + q) i >= p (m + n).
    p, q = LEAST
    return np.triu((p + q) * shared >= p * (sizes[:, None] + sizes[None, :]), 1)


def forest(links: np.ndarray, roots: np.ndarray | None) -> list[tuple[int, int]]:
    """Links that connect whatever all links connect; members of one root are connected already."""
    at = np.arange(len(links)) if roots is None else np.unique(roots, return_inverse=True)[1]
    group = np.arange(len(links))[: at.max() + 1].tolist()

    def find(i: int) -> int:
        while group[i] != i:
            group[i] = group[group[i]]
            i = group[i]
        return i

    out = []
    for x, y in np.argwhere(links).tolist():
        a, b = find(int(at[x])), find(int(at[y]))
        if a != b:
            group[a] = b
            out.append((x, y))
    return out


def _compare(keys: int) -> Callable:
    """Rows (keys..., fp, root, members, print), sorted by the keys; a block may go on in the next batch. Rows as `simhash.search` returns them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, roots, sets, prints = None, [], [], [], []
        looked = left = 0

        def links() -> Iterator[pa.RecordBatch]:
            nonlocal looked, left
            if len(sets) > 1:
                pairs, survivors = checked(np.frombuffer(b"".join(prints), np.uint64).reshape(len(sets), -1), sets)
                looked, left = looked + len(sets) * (len(sets) - 1) // 2, left + survivors
                found = forest(pairs, None if roots[0] is None else np.array(roots, np.int64))
                none = pa.array(np.zeros(len(found), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([fps[x] for x, _ in found], pa.int64()), pa.array([fps[y] for _, y in found], pa.int64()), none, none], schema=simhash.FOUND)

        for batch in batches:
            own = zip(*(batch.column(i).to_pylist() for i in range(keys + 2)))
            members, ends = batch.column(keys + 2).values.to_numpy().view(np.uint64), batch.column(keys + 2).offsets.to_numpy()
            for i, row in enumerate(own):
                if row[:keys] != key:
                    yield from links()
                    key, fps, roots, sets, prints = row[:keys], [], [], [], []
                if fps and fps[-1] == row[keys]:
                    continue  # a leader that is a member of the block
                fps.append(row[keys])
                roots.append(row[keys + 1])
                sets.append(members[ends[i] : ends[i + 1]].copy())
                prints.append(batch.column(keys + 3)[i].as_py())
        yield from links()
        batch, members, sets, prints = None, None, [], []
        S.give_back()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([looked]), pa.array([left])], schema=simhash.FOUND)

    return run


def compared(placed: DataFrame, sets: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Stored rows (a, b, candidates, survivors) of the blocks of `placed` (keys, fp, root)."""
    rows = placed.join(sets, "fp").select(*keys, "fp", "root", "members", "print")
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return S.store(dealt.mapInArrow(_compare(len(keys)), "a long, b long, candidates long, survivors long"), label)


def search(rows: DataFrame, block_sets: int = BLOCK_SETS, leaders: int = LEADERS) -> DataFrame:
    """Stored rows (a, b, candidates, survivors): edges among the distinct sets of the stored rows (fp, bands, members, print)
    that connect all that candidates connect, and rows without an edge as in `simhash.search`."""
    dealt = S.store(rows.select("fp", "bands").dropDuplicates(["fp"]).select(F.explode("bands").alias("bucket"), "fp"), "near-dealt")
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("fp")).alias("who")).filter("n > 1")
    kept = S.store(sizes.groupBy("n", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "near-sizes")
    met = S.store(S.lookup_skew_safe(dealt, kept, "bucket", "n", dealt.count()), "near-met")
    S.discard(dealt)
    # The sets that meet any other, once each.
    few = S.few_or_merge(S.store(met.select("fp").distinct(), "near-wanted"))
    sets = S.store(rows.select("fp", "members", "print").join(few, "fp", "left_semi").dropDuplicates(["fp"]), "near-sets")
    no_root = F.lit(None).cast("long").alias("root")
    blocks = F.ceil(F.col("n") / block_sets).cast("int")
    mine = F.pmod(F.xxhash64("fp", "bucket"), F.col("blocks")).cast("int")
    leads = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("bucket", "fp"), F.col("n")) < leaders)
    where = F.when(leads, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(mine))
    placed = met.withColumn("blocks", blocks).select("bucket", F.explode(where).alias("block"), "fp", no_root)
    found = compared(placed, sets, ["bucket", "block"], "near-links")
    large = met.filter(F.col("n") > block_sets)
    if large.isEmpty():
        return found
    roots = simhash.components(edges_of(found))
    large = S.store(large.join(roots, F.col("fp") == F.col("node"), "left").select("bucket", "fp", F.coalesce("root", "fp").alias("root")), "near-large")
    parts = large.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("bucket").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.max("k").alias("k"), F.sum("k").alias("n")).filter("n > k")
    main = S.store(main.select("bucket", "main", "n", F.ceil((F.col("n") - F.col("k")) / (block_sets // 2)).cast("int").alias("apart"), F.ceil(F.col("k") / (block_sets // 2)).cast("int").alias("together")), "near-main")
    left = S.lookup_skew_safe(large, main, "bucket", "n", large.count())
    # Blocks of those apart are numbered first. (x, y) with x <= y names a pair of blocks; x is of those apart.
    inside = F.col("root") == F.col("main")
    number = F.pmod(F.xxhash64("fp"), F.when(inside, F.col("together")).otherwise(F.col("apart"))).cast("int") + F.when(inside, F.col("apart")).otherwise(0)
    other = F.when(inside, F.sequence(F.lit(0), F.col("apart") - 1)).otherwise(F.sequence(F.lit(0), F.col("apart") + F.col("together") - 1))
    pairs = left.select("bucket", number.alias("one"), F.explode(other).alias("two"), "fp", "root")
    pairs = pairs.select("bucket", F.least("one", "two").alias("x"), F.greatest("one", "two").alias("y"), "fp", "root")
    return found.unionByName(compared(pairs, sets, ["bucket", "x", "y"], "near-cross"))


def edges_of(found: DataFrame) -> DataFrame:
    return found.filter("a is not null").select("a", "b").distinct()


def links_between(rows: DataFrame, block_sets: int = BLOCK_SETS, leaders: int = LEADERS) -> DataFrame:
    """Edges (a, b) of `search`."""
    return edges_of(search(rows, block_sets, leaders))


def shingle_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Stored rows (doc_id, text_hash, fp, bands, members, print), one per row of docs."""
    texts = docs.select(F.col(id_col).alias("doc_id"), S.text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    return S.store(texts.mapInArrow(_set_batches(shingle), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long, bands array<long>, members array<long>, print binary"), "near-rows")


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs, all columns, with the smallest id of their component.

    Nulls and texts without words are copies of each other. A null id comes after all others, and of rows with one id the
    least hash of the text comes first; rows that repeat id and text stay or go together. An empty table gives no rows.
    """
    rows = shingle_rows(docs, id_col, text_col, shingle)
    gone = simhash.grouped(rows.select("doc_id", "text_hash", "fp"), lambda _: links_between(rows.select("fp", "bands", "members", "print"))).filter("not kept").select("doc_id", "text_hash").distinct()
    return S.without_rows(docs, S.store(gone, "near-copies"), id_col, text_col)
