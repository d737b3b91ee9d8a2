"""Token ids on disk: encoded documents in ascending id order, as independent rANS blocks.

File format: a Parquet folder of blocks, one row each. A block holds whole documents (an end id after each), up to
BLOCK_TOKENS tokens unless a single document has more:
  first_start  tokens of all documents before the block
  doc_ids, sizes  the block's documents and their numbers of tokens
  n_tokens, words  the rANS stream (32-bit words, little endian)
  marks  checkpoints (row, word, states), from any of which a reader can decode on
  crc32  of the documents' own CRCs, each over its ids as little-endian unsigned 32-bit integers
and beside it one row with the shared frequency table. A reader needs one block and the table, nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import _shared as S
from lumbre.llm import rans
from lumbre.llm import unit_encoder as U

BLOCK_TOKENS = 1 << 19
#: Rows of lanes between checkpoints.
MARK_ROWS = 64
BITS = 20
#: Characters of a text by which rows of one id are dealt to ranges.
PREFIX = 64


def _id_ddl(docs: DataFrame, id_col: str) -> str:
    return docs.select(id_col).schema[0].dataType.simpleString()


def _encode_partition(path: str, end_id: int, block_tokens: int) -> Callable:
    """Rows (doc_id, text), sorted: rows of blocks with plain ids, and at the partition's end its token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc = U.encoder(path)
        part = TaskContext.get().partitionId()
        counts = np.zeros(max(enc.vocab_size, end_id + 1), np.int64)
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        n_held, block = 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, n_held, block
            doc_ids = pa.chunked_array([h[0] for h in held]).combine_chunks()
            sizes = np.concatenate([h[1] for h in held])
            ids = np.concatenate([h[2] for h in held])
            counts[: len(counts)] += np.bincount(ids, minlength=len(counts))
            one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
            out = pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([block], pa.int32()), one(doc_ids), one(pa.array(sizes, pa.int64())), pa.array([len(ids)], pa.int64()), pa.array([ids.astype("<u4" if len(counts) > 1 << 16 else "<u2").tobytes()], pa.binary())],
                names=["part", "block", "doc_ids", "sizes", "n_tokens", "ids"],
            )
            held, n_held, block = [], 0, block + 1
            return out

        for batch in S.batches_of(batches, 10 << 20):
            ids, sizes = enc.encode(batch.column(1))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, end_id)
            sizes = sizes + 1
            ends = np.cumsum(sizes)
            first = 0
            while first < len(sizes):
                # As many documents as fit; one at least.
                done = int(ends[first - 1]) if first else 0
                last = max(first + (0 if held else 1), int(np.searchsorted(ends, done + block_tokens - n_held, "right")))
                if last > first:
                    held.append((batch.column(0).slice(first, last - first), sizes[first:last], ids[done : ends[last - 1]]))
                    n_held += int(ends[last - 1]) - done
                if last < len(sizes) or n_held >= block_tokens:
                    yield flush()
                first = last
        if held:
            yield flush()
        if counts.any():
            empty = pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), pa.array([], pa.int64()))
            seen = np.flatnonzero(counts)
            packed = np.stack([seen, counts[seen]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([-1], pa.int32()), _empty_like(batch.column(0)), empty, pa.array([0], pa.int64()), pa.array([packed], pa.binary())], names=["part", "block", "doc_ids", "sizes", "n_tokens", "ids"])

    return run


def _empty_like(column: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, 0], pa.int32()), column.slice(0, 0))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for raw in b.column(0).to_pylist():
            pairs = np.frombuffer(raw, "<i8").reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["token", "n"])


def _document_crcs(ids: np.ndarray, sizes: np.ndarray) -> list[int]:
    view, ends = memoryview(ids.astype("<u4", copy=False)).cast("B"), np.cumsum(sizes)
    return [zlib.crc32(view[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]


def _block_crc(crcs: list[int]) -> int:
    return zlib.crc32(np.array(crcs, "<u4").tobytes())


def _write_blocks(freq, bits: int, mark_rows: int, wide: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.table(freq.value, bits)
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("ids")[i].as_buffer(), "<u4" if wide else "<u2")
                words, marks = rans.encode(ids, table, mark_rows)
                mark = pa.array([[{"row": r, "word": w, "states": s.astype("<u8").tobytes()} for r, w, s in marks]], MARKS)
                keep = [b.column(c).slice(i, 1) for c in ("part", "block", "doc_ids", "sizes", "n_tokens", "first_start")]
                yield pa.RecordBatch.from_arrays([*keep, pa.array([words.astype("<u4").tobytes()], pa.binary()), mark, pa.array([_block_crc(_document_crcs(ids, b.column("sizes").slice(i, 1).flatten().to_numpy()))], pa.int64())], names=["part", "block", "doc_ids", "sizes", "n_tokens", "first_start", "words", "marks", "crc32"])

    return run


MARKS = pa.list_(pa.struct([("row", pa.int32()), ("word", pa.int64()), ("states", pa.binary())]))


def read_block(words: bytes, marks: list[dict], n_tokens: int, table: rans.Table, first: int = 0, last: int | None = None) -> np.ndarray:
    """Tokens first to last of a block, decoded from the nearest checkpoint."""
    stream = np.frombuffer(words, "<u4").astype(np.uint64)
    mark = max((m for m in marks if m["row"] * rans.LANES <= first), key=lambda m: m["row"])
    ids = rans.decode(stream, table, n_tokens, np.frombuffer(mark["states"], "<u8").astype(np.uint64), mark["row"], mark["word"], last)
    return ids[first - mark["row"] * rans.LANES :]


def _read(freq, bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rans.table(freq.value, bits)
        for b in batches:
            for i in range(b.num_rows):
                n = b.column("n_tokens")[i].as_py()
                ids = read_block(b.column("words")[i].as_buffer(), b.column("marks")[i].as_py(), n, table).astype("<u4")
                sizes = b.column("sizes").slice(i, 1).flatten().to_numpy()
                ends = np.cumsum(sizes)
                crc = _document_crcs(ids, sizes)
                if _block_crc(crc) != b.column("crc32")[i].as_py():
                    raise ValueError(f"checksum of block {b.column('part')[i]}/{b.column('block')[i]}")
                start = b.column("first_start")[i].as_py() + ends - sizes
                yield pa.RecordBatch.from_arrays([b.column("doc_ids").slice(i, 1).flatten(), pa.array(start, pa.int64()), pa.array(sizes, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


@dataclass
class TokenStore:
    spark: SparkSession
    path: str

    def blocks(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/blocks")

    def table(self) -> tuple[np.ndarray, int]:
        row = self.spark.read.parquet(f"{self.path}/table").collect()[0]
        freq = np.zeros(row["vocabulary"], np.int64)
        freq[np.array(row["tokens"], np.int64)] = row["freq"]
        return freq, row["bits"]

    def documents(self) -> DataFrame:
        """doc_id, start, n_tokens, ids_crc32, decoded from the files."""
        freq, bits = self.table()
        blocks = self.blocks()
        kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
        shared = self.spark.sparkContext.broadcast(freq)  # as many numbers as the vocabulary has tokens
        return blocks.mapInArrow(_read(shared, bits), f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def write_tokens(docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_tokens: int = BLOCK_TOKENS) -> TokenStore:
    """Encodes every whole text (null: empty) and writes the store.

    The rows are dealt by ranges of the id, so only texts move, once; plain ids are held on the shared folder until the
    frequencies of all documents are known. Rows that repeat an id stand side by side, in order of the first PREFIX
    characters of their texts (within a range, of their texts): a range may end among them, also among rows that are
    alike, so that an id which many rows have is many tasks' work. A null id comes first. An empty table gives a store
    without blocks. Extra columns are ignored.
    """
    spark = docs.sparkSession
    path = path or S.fresh_path(spark, "tokens")
    tokenizer = tokenizer or U.default_path()
    kind = _id_ddl(docs, id_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.substring(F.col(text_col), 1, PREFIX).alias("prefix"), F.monotonically_increasing_id().alias("place"))
    rows = rows.repartitionByRange("doc_id", "prefix", "place").sortWithinPartitions("doc_id", "prefix", "text").select("doc_id", "text")
    staged = S.store(rows.mapInArrow(_encode_partition(tokenizer, end_id, block_tokens), f"part int, block int, doc_ids array<{kind}>, sizes array<long>, n_tokens long, ids binary"), "staged-ids", "snappy")
    counted = staged.filter("block = -1").select("ids").mapInArrow(_counts, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect()
    vocabulary = max([end_id + 1, *(r["token"] + 1 for r in counted)])
    counts = np.zeros(vocabulary, np.int64)
    counts[[r["token"] for r in counted]] = [r["n"] for r in counted]
    freq = rans.scaled(counts, BITS)
    seen = np.flatnonzero(freq)
    spark.createDataFrame([(vocabulary, BITS, seen.tolist(), freq[seen].tolist())], "vocabulary int, bits int, tokens array<int>, freq array<int>").coalesce(1).write.parquet(f"{path}/table")
    # One total per range: as many rows as partitions.
    totals = staged.filter("block >= 0").groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    before, done = [], 0
    for r in totals:
        before.append((r["part"], done))
        done += r["n"]
    from pyspark.sql import Window

    base = F.broadcast(spark.createDataFrame(before, "part int, base long"))
    sizes = staged.filter("block >= 0").select("part", "block", "n_tokens")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.join(base, "part").select("part", "block", (F.col("base") + F.coalesce(F.sum("n_tokens").over(w), F.lit(0))).alias("first_start"))
    starts = S.store(starts, "starts")  # one row per block, some 2^19 tokens
    few = S.within_bound(starts)
    placed = staged.filter("block >= 0").join(F.broadcast(starts) if few else starts, ["part", "block"])
    shared = spark.sparkContext.broadcast(freq)
    wide = U.encoder(tokenizer).vocab_size > 1 << 16 or end_id >= 1 << 16
    schema = f"part int, block int, doc_ids array<{kind}>, sizes array<long>, n_tokens long, first_start long, words binary, marks array<struct<row:int,word:long,states:binary>>, crc32 long"
    placed.mapInArrow(_write_blocks(shared, BITS, MARK_ROWS, wide), schema).write.option("compression", "none").parquet(f"{path}/blocks")
    S.discard(staged)
    return TokenStore(spark, path)


def token_output(docs: DataFrame, **options) -> DataFrame:
    return write_tokens(docs, **options).documents()
