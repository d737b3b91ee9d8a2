"""SimHash near-duplicates by pivot distance tables.

1. A fingerprint of 64 bits per document (XXH64 of its word shingles, bitwise majority).
2. Equal fingerprints collapse to one row before anything else moves, so a group of copies costs one row.
3. Two fingerprints that differ in at most r = 3 bits agree in at least 3 of 6 blocks of bits. Every distinct
   fingerprint is dealt to the C(6, 3) = 20 buckets named by three of its blocks: all links meet in some bucket, and
   random fingerprints share one with odds of 20 in 2^32, so buckets stay small as the corpus grows.
4. The pivot table holds the Hamming distances of every fingerprint to PIVOTS reference fingerprints, the same for all
   buckets (members of the corpus, by hash). By the triangle inequality, a pair whose largest coordinate difference is
   over r cannot link: each candidate pair, in a bucket of any size, is discarded by the table or verified by its exact
   distance, and both are counted (`search`). Members of a bucket share 31 to 33 bits, so their distances to a reference
   differ only by the other bits; 32 references discard over 99 % of pairs that don't link. The search walks a bucket
   breadth first and never looks again at a fingerprint it has reached: it returns less edges than members (a spanning
   forest), not all pairs.
5. A bucket with more than `bucket_rows` members is dealt again: of its other bits in 8 groups, at least 5
   agree, which makes C(8, 5) = 56 keys. At most 13 bits are left, so no bucket can hold over 8,192 members. Exact.
6. Components of the edges by alternating large and small stars, written to the shared folder each round.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

#: Widths of the six blocks, 64 bits together.
BLOCKS = (11, 11, 11, 11, 10, 10)
SEED = 42
#: Reference fingerprints.
PIVOTS = 32


def _lane_sums(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each segment of hashes, how many have each of the 64 bits. Eight counters of 8 bits share a word, over at most 255 hashes."""
    ends = np.append(starts[1:], len(h))
    cuts, owner = [], []
    for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist())):
        n = len(range(a, b, 255))
        cuts.extend(range(a, b, 255))
        owner.extend([i] * n)
    first = np.flatnonzero(np.diff(np.array(owner), prepend=-1))
    out = np.empty((len(starts), 64), np.int64)
    lane = np.uint64(0x0101010101010101)
    for bit in range(8):
        part = np.add.reduceat((h >> np.uint64(bit)) & lane, np.array(cuts))
        out[:, bit::8] = np.add.reduceat(part.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def fingerprints_of(texts: list[str | None], shingle: int = 3) -> np.ndarray:
    """Unsigned fingerprints: a bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    import xxhash

    digest, hashes, starts, at, n = xxhash.xxh64_intdigest, [], [], [], 0
    out = np.zeros(len(texts), np.uint64)
    for i, text in enumerate(texts):
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            continue
        k = max(1, len(words) - shingle + 1)
        pieces = zip(*(words[j : j + k] for j in range(min(shingle, len(words)))))
        starts.append(n)
        at.append(i)
        hashes.append(np.fromiter((digest(b" ".join(w), SEED) for w in pieces), np.uint64, k))
        n += k
    if n:
        sums = _lane_sums(np.concatenate(hashes), np.array(starts))
        counts = np.diff(np.append(starts, n))
        bits = (2 * sums > counts[:, None]).astype(np.uint64)
        out[np.array(at)] = (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint_batches(shingle: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in S.batches_of(batches, 2 << 20):
            fp = fingerprints_of(b.column(2).to_pylist(), shingle).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp)], names=["doc_id", "text_hash", "fp"])

    return run


def block_keys(fp: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(number of the choice, key) for each choice of three of the six blocks."""
    cuts, at = [], 0
    for w in BLOCKS:
        cuts.append((fp >> np.uint64(at)) & np.uint64((1 << w) - 1))
        at += w
    out = []
    for c, chosen in enumerate(combinations(range(len(BLOCKS)), 3)):
        key = np.zeros(len(fp), np.uint64)
        for b in chosen:
            key = (key << np.uint64(BLOCKS[b])) | cuts[b]
        out.append((c, (key << np.uint64(5)) | np.uint64(c)))
    return out


def fine_keys(fp: np.ndarray, choice: int) -> list[np.ndarray]:
    """56 finer keys: the bits outside the chosen blocks in 8 groups, five of them at a time (as 64-bit words, bits outside zero)."""
    chosen = list(combinations(range(len(BLOCKS)), 3))[choice]
    bits, at = [], 0
    for b, w in enumerate(BLOCKS):
        if b not in chosen:
            bits.extend(range(at, at + w))
        at += w
    coarse = np.uint64((1 << 64) - 1 - sum(1 << x for x in bits))
    groups = [sum(1 << x for x in g.tolist()) for g in np.array_split(np.array(bits, object), 8)]
    return [fp & (coarse | np.uint64(sum(groups[g] for g in five))) for five in combinations(range(8), 5)]


def pivot_table(fp: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Distances of each fingerprint to the reference fingerprints."""
    return np.stack([np.bitwise_count(fp ^ r).astype(np.int8) for r in refs], axis=1) if len(refs) else np.zeros((len(fp), 1), np.int8)


def spanning_links(fp: np.ndarray, table: np.ndarray, radius: int) -> tuple[list[tuple[int, int]], int, int]:
    """(index pairs that link and connect whatever links of at most `radius` bits connect among the distinct values fp, pairs looked at, pairs that the table left)."""
    left, fresh = np.arange(len(fp)), np.ones(len(fp), bool)
    out: list[tuple[int, int]] = []
    candidates = survivors = 0
    while len(left):
        queue, left = deque([int(left[0])]), left[1:]
        while queue and len(left):
            x = queue.popleft()
            candidates += len(left)
            near = left
            for p in range(table.shape[1]):
                near = near[np.abs(table[near, p] - table[x, p]) <= radius]
                if not len(near):
                    break
            survivors += len(near)
            found = near[np.bitwise_count(fp[near] ^ fp[x]) <= radius]
            if len(found):
                out.extend((x, int(y)) for y in found)
                queue.extend(found.tolist())
                fresh[found] = False
                left = left[fresh[left]]
    return out, candidates, survivors


def _deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for _, key in block_keys(fp):
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0)], names=["bucket", "fp"])


def _deal_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        bucket = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        fp = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        for c in np.unique(bucket & np.uint64(31)).tolist():
            own = fp[(bucket & np.uint64(31)) == c]
            for g, key in enumerate(fine_keys(own, int(c))):
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, c * 64 + g, np.int64)), pa.array(key.view(np.int64)), pa.array(own.view(np.int64))], names=["choice", "bucket", "fp"])


FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("candidates", pa.int64()), ("survivors", pa.int64())])


def _links_of_groups(radius: int, refs: np.ndarray) -> Callable:
    """Rows (keys..., fp) come sorted by the keys; a bucket may go on in the next batch. Edges, and per batch a row without one that counts the pairs looked at and those that the table left."""

    def links(keys: list[np.ndarray], fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        table = pivot_table(fp, refs)
        fresh = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
        first = np.append(0, np.flatnonzero(fresh) + 1)
        sizes = np.diff(np.append(first, len(fp)))
        # Buckets of two, all at once.
        x = first[sizes == 2]
        near = x[(np.abs(table[x] - table[x + 1]) <= radius).all(axis=1)]
        candidates, survivors = len(x), len(near)
        near = near[np.bitwise_count(fp[near] ^ fp[near + 1]) <= radius]
        a, b = [near], [near + 1]
        for i, n in zip(first[sizes > 2].tolist(), sizes[sizes > 2].tolist()):
            found, looked, left = spanning_links(fp[i : i + n], table[i : i + n], radius)
            candidates, survivors = candidates + looked, survivors + left
            if found:
                pairs = np.array(found) + i
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        a, b = fp[np.concatenate(a)].view(np.int64), fp[np.concatenate(b)].view(np.int64)
        none = np.zeros(len(a), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(none), pa.array(none)], schema=FOUND)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([candidates]), pa.array([survivors])], schema=FOUND)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            own = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            own = [np.concatenate(x) for x in zip(held, own)] if held is not None else own
            if not len(own[0]):
                continue
            other = np.logical_or.reduce([k != k[-1] for k in own[:-1]])
            cut = int(np.flatnonzero(other)[-1]) + 1 if other.any() else 0
            held = [c[cut:] for c in own]
            if cut:
                yield from links([k[:cut] for k in own[:-1]], own[-1][:cut].view(np.uint64))
        if held is not None:
            yield from links(held[:-1], held[-1].view(np.uint64))

    return run


def search(distinct: DataFrame, radius: int = 3, bucket_rows: int = 16384, pivots: int = PIVOTS) -> DataFrame:
    """Stored rows (a, b, candidates, survivors): edges among the distinct values of column fp that connect all that links
    of at most radius bits connect, and rows without an edge whose sums are the pairs looked at and those the pivot table left."""
    if radius > 3:
        raise ValueError("three equal blocks of six are only sure up to 3 bits")
    refs = np.array([r["fp"] for r in distinct.orderBy(F.xxhash64("fp"), "fp").limit(pivots).collect()], np.int64).view(np.uint64)
    dealt = S.store(distinct.mapInArrow(_deal, "bucket long, fp long"), "simhash-dealt")
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    hot = S.store(sizes.filter(F.col("n") > bucket_rows).select("bucket"), "simhash-hot")
    found = "a long, b long, candidates long, survivors long"
    if hot.isEmpty():
        small = dealt
    else:
        # Buckets over the limit number at most 20 n / bucket_rows; the join is left to the planner, which knows their size.
        small = dealt.join(hot, "bucket", "left_anti")
        fine = dealt.join(hot, "bucket", "left_semi").mapInArrow(_deal_again, "choice long, bucket long, fp long")
        again = fine.repartition("choice", "bucket").sortWithinPartitions("choice", "bucket", "fp").mapInArrow(_links_of_groups(radius, refs), found)
    out = small.repartition("bucket").sortWithinPartitions("bucket", "fp").mapInArrow(_links_of_groups(radius, refs), found)
    if not hot.isEmpty():
        out = out.unionByName(again)
    stored = S.store(out, "simhash-links")
    S.discard(dealt)
    return stored


def links_between(distinct: DataFrame, radius: int = 3, bucket_rows: int = 16384) -> DataFrame:
    """Edges (a, b) among the distinct values of column fp that connect all that links of at most radius bits connect."""
    return search(distinct, radius, bucket_rows).filter("a is not null").select("a", "b").distinct()


def pivot_effect(found: DataFrame) -> tuple[int, int]:
    """(pairs that `search` looked at, pairs that the pivot table left to verify)."""
    row = found.filter("a is null").agg(F.coalesce(F.sum("candidates"), F.lit(0)), F.coalesce(F.sum("survivors"), F.lit(0))).collect()[0]
    return row[0], row[1]


#: Up to so many edges (16 bytes each) are connected in one task.
LOCAL_EDGES = 500_000


def _connect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges in one task: (node, root) by union and find."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.setdefault(i, i)) != i:
            root[i] = root[up]
            i = up
        return i

    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
    nodes = [i for i in list(root) if find(i) != i]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(i) for i in nodes], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b) that isn't a root itself; the root is the least node that can be reached.

    Up to local_edges edges, counted, are connected in one task. More are connected by alternating large-star and
    small-star steps: a step's groups are aggregated map-side, and each round is written out, so lineage stays short. The
    number of rounds grows with the logarithm of a component's diameter.
    """
    e = S.store(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    if e.count() <= local_edges:
        return S.store(e.coalesce(1).mapInArrow(_connect, "node long, root long"), "cc-roots")
    while True:
        # Large star: each node sends its larger neighbours to the least node among itself and its neighbours.
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = S.store(large, "cc-large")
        # Small star: each node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v").distinct()
        new = S.store(small, "cc")
        S.discard(large)
        same = new.count() == e.count() and new.join(e, ["u", "v"], "left_anti").isEmpty()
        S.discard(e)
        e = new
        if same:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def grouped(rows: DataFrame, links: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """near_duplicates' columns for the stored rows (doc_id, text_hash, fp): equal fp are one, links gives the edges (a, b) among the distinct ones."""
    # The least row: smallest id, null ids last, and of rows with one id that of the least hash.
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash"))
    groups = S.store(rows.groupBy("fp").agg(least_row.alias("least"), F.count(F.lit(1)).alias("n")), "simhash-groups")
    roots = components(links(groups.select("fp")))
    # Each fingerprint's component; those without links are their own. Then the least row of each component.
    rooted = S.store(groups.join(roots, groups["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root")), "simhash-rooted")
    least = S.store(rooted.groupBy("root").agg(F.min("least").alias("least"), F.count(F.lit(1)).alias("members")), "simhash-least")
    named = S.store(S.lookup_skew_safe(rooted.select("root", "fp", "n"), least, "root", "members", rooted.count()).select("fp", "n", "least"), "simhash-named")
    out = S.lookup_skew_safe(rows, named, "fp", "n", rows.count())
    return out.select(
        "doc_id", "text_hash", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least.doc_id").alias("component_id"),
        (F.col("doc_id").eqNullSafe(F.col("least.doc_id")) & (F.col("text_hash") == F.col("least.text_hash"))).alias("kept"),
    )


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, bucket_rows: int = 16384) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, fingerprint (16 hex digits), component_id (smallest id that links reach), kept (the component's first row).

    Nulls and texts without words have the fingerprint zero and link like any other; a null id is carried, and never
    is a component_id unless its component has no other. Repeated rows are equal fingerprints. Empty tables give no
    rows. Extra columns are ignored.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), S.text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = S.store(texts.mapInArrow(_fingerprint_batches(shingle), f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, text_hash long, fp long"), "simhash-fp")
    return grouped(rows, lambda distinct: links_between(distinct, radius, bucket_rows))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs, all columns, with the smallest id of their component. Nulls, empty texts, repeated rows, null ids, empty tables and extra columns as for near_duplicates; rows that repeat id and text stay or go together."""
    gone = near_duplicates(docs, id_col, text_col, **options).filter("not kept").select("doc_id", "text_hash").distinct()
    return S.without_rows(docs, S.store(gone, "near-copies"), id_col, text_col)
