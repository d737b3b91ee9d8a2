"""A hidden Markov language model, trained by Baum-Welch over the whole training corpus.

The latent states are trained on an alphabet that a broadcast can hold: the HEAD most frequent training words, and
BUCKETS classes into which all other words fall by hash. Rounds are passes over all training documents; the tasks return
expected counts (one row per symbol), summed by Spark. The last pass counts by word instead: every training word's
expected number in each state. Emissions of the final model are word by word, by one formula for all words, frequent or
rare: the word's counts by state, interpolated with the unigram model,

    P(w | s) = (n(w, s) + k(s) u(w)) / (n(s) + k(s)),   u(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)),

where k(s) grows with the different words of the state as Witten and Bell have it, and one share is left for words never
seen. Each state's emissions are thus a proper distribution over words. A token's share in a state is rounded to 1 / GRAIN
in that pass, so that counts add up exactly, in whatever order and blocks they are taken. The counts of the KNOWN most frequent words are
broadcast; those of all others are a table that grows with the corpus and stays distributed.

Documents are coded in blocks (some megabytes of text). A block names its rarer words once, however often its documents
repeat them; those that training has seen are joined with the table of words, and the block's texts are scored by the
exact scaled forward recursion.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

STATES = 8
HEAD, BUCKETS = 60_000, 4096
#: Words whose counts are broadcast; it bounds what a worker holds, and changes no result.
KNOWN = 200_000
#: Passes over all training documents at most; they end when a pass gains less than GAIN (natural logarithm, per token).
ROUNDS, GAIN = 8, 1e-3
#: Parts of a token's share in a state, in the last pass; words of up to PACKED tokens have theirs in 16 bits each.
GRAIN, PACKED = 4096, 15
#: Bytes of text in a block.
BLOCK_BYTES = 8 << 20
#: Tokens of documents that are worked on together; a longer document stands alone.
BATCH_TOKENS = 500_000
#: Tokens whose rows, in a few tables, fit a core's cache.
CACHE_TOKENS = 2048
#: Steps between scalings. A step changes a state's weight by its emission relative to the unigram model, well within 1e15.
SCALE_STEPS = 16
#: The end of a text, as a word: no word holds white space.
END = "\n"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, the number of each word of all texts in a row, words per text).

    Words are runs of anything but space, tab, line feed, vertical tab, form feed and return, A-Z lower-cased. Null is empty.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    coded = lists.flatten().dictionary_encode()
    at, distinct = coded.indices.to_numpy(), coded.dictionary
    ends = lists.offsets.to_numpy()
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # white space at a text's ends
        word = at != empty
        ends = np.append(0, np.cumsum(word))[ends]
        at = at[word]
    return distinct, at, np.diff(ends)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows, ends = [], 0, 0

    def merged() -> pa.Table:
        return pa.concat_tables(held).group_by("word").aggregate([("c", "sum")]).rename_columns(["word", "c"])

    for b in S.batches_of(batches, BLOCK_BYTES):
        distinct, at, _ = words_of(b.column(0))
        n = np.bincount(at, minlength=len(distinct))
        held.append(pa.table({"word": distinct, "c": pa.array(n, pa.int64())}).filter(pa.array(n > 0)))
        rows, ends = rows + held[-1].num_rows, ends + b.num_rows
        if rows > 1_000_000:
            held = [merged()]
            rows = held[0].num_rows
            if rows > 500_000:
                yield from held[0].to_batches()
                held, rows = [], 0
    if held:
        yield from merged().to_batches()
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends], pa.int64())], names=["word", "c"])


def class_of(word: str) -> int:
    return zlib.crc32(word.encode()) % BUCKETS


@dataclass
class Alphabet:
    """Numbers of the known words, most frequent first after the end of a text; the first `head` are symbols by themselves."""

    known: dict[str, int]
    symbols: np.ndarray  # of each known word
    counts: np.ndarray  # of each known word
    head: int
    tokens: int
    words: int

    @staticmethod
    def of(top: pa.Table, ends: int, head: int, tokens: int, words: int) -> Alphabet:
        names = [END, *S.strings(top["word"])]
        symbols = np.array([i if i < head else head + class_of(w) for i, w in enumerate(names)], np.int64)
        return Alphabet({w: i for i, w in enumerate(names)}, symbols, np.append(float(ends), top["c"].to_numpy()), head, tokens, words)

    @property
    def size(self) -> int:
        """Symbols."""
        return self.head + BUCKETS

    def shares(self, counts: np.ndarray) -> np.ndarray:
        """u of words with these counts."""
        return (counts + 0.5) / (self.tokens + 0.5 * (self.words + 1))

    def unigram(self, rest: np.ndarray) -> np.ndarray:
        """Shares of the symbols; rest: what words that aren't known add to each class."""
        c = np.bincount(self.symbols, self.counts, self.size)
        c[self.head :] += rest
        return (c + 0.5) / (c + 0.5).sum()


def _code(shared) -> Callable:
    """A row per block: its documents, their tokens as symbols, and for each token of a class its word: a known word's number, or that plus the place in `tail`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        alphabet: Alphabet = shared.value
        known, n_known = alphabet.known, len(alphabet.known)
        block = TaskContext.get().partitionId() << 33
        one = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        for b in S.batches_of(batches, BLOCK_BYTES):
            distinct, at, sizes = words_of(b.column(2))
            distinct = S.strings(distinct)
            number = np.fromiter((known.get(w, -1) for w in distinct), np.int64, len(distinct))
            present = np.zeros(len(distinct), bool)
            present[at] = True
            rare = np.flatnonzero((number < 0) & present)
            words = [distinct[i] for i in rare.tolist()]
            number[rare] = n_known + np.arange(len(rare))
            symbol = np.concatenate([alphabet.symbols, np.fromiter((alphabet.head + class_of(w) for w in words), np.int64, len(words))])[number]
            symbols = np.insert(symbol[at], np.cumsum(sizes), 0)
            own = number[at]
            own = own[own >= alphabet.head]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int64()), one(b.column(0)), one(b.column(1)), one(pa.array(sizes + 1, pa.int64())), pa.array([symbols.astype("<u2").tobytes()], pa.binary()), one(pa.array(words, pa.string())), pa.array([own.astype("<u4").tobytes()], pa.binary())],
                names=["block", "doc_ids", "held_out", "sizes", "symbols", "tail", "numbers"],
            )
            block += 1

    return run


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray  # from, to
    emit: np.ndarray  # symbol, state

    @staticmethod
    def initial(unigram: np.ndarray, states: int = STATES, seed: int = 7) -> Hmm:
        noise = np.random.default_rng(seed).gamma(2.0, 0.5, (len(unigram), states)) + 0.05
        emit = unigram[:, None] * noise
        move = np.full((states, states), 0.1 / max(1, states - 1))
        np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
        return Hmm(np.full(states, 1 / states), move, emit / emit.sum(axis=0))

    @staticmethod
    def weights(types: np.ndarray, prior: float = 200.0) -> np.ndarray:
        """k(s): what the unigram model weighs against the state's own counts."""
        return prior + types

    @staticmethod
    def from_counts(start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray) -> Hmm:
        """The M step over symbols."""
        e = emit + Hmm.weights(np.minimum(emit, 1).sum(axis=0)) * unigram[:, None]
        m = move + 0.1
        s = start + 0.1
        return Hmm(s / s.sum(), m / m.sum(axis=1, keepdims=True), e / e.sum(axis=0))


def aligned_room(n: int, k: int) -> np.ndarray:
    """Rows of k doubles, not set; rows of eight are one cache line each."""
    room = np.empty(n * k + 8)
    at = (-room.ctypes.data % 64) // 8
    return room[at : at + n * k].reshape(n, k)


def aligned(table: np.ndarray) -> np.ndarray:
    out = aligned_room(*table.shape)
    out[:] = table
    return out


class Scratch:
    """Arrays of a row per token that a worker uses again and again: memory of this size, freshly mapped for each group, costs more than the recursions."""

    def __init__(self):
        self.held: dict[str, np.ndarray] = {}

    def rows(self, name: str, n: int, k: int) -> np.ndarray:
        a = self.held.get(name)
        if a is None or len(a) < n or a.shape[1] != k:
            self.held[name] = a = aligned_room(n + n // 8, k)
        return a[:n]

    def gathered(self, name: str, table: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.take(table, at, axis=0, out=self.rows(name, len(at), table.shape[1]), mode="clip")

    def clear(self) -> None:
        """At a task's end: the worker may go on with other work."""
        self.held.clear()
        pa.default_memory_pool().release_unused()


SCRATCH = Scratch()


@dataclass
class Batch:
    """Sequences laid side by side, step by step: the first step of all, then the second of all that have one, ..."""

    order: np.ndarray  # sequence numbers, longest first
    sizes: np.ndarray  # in that order
    rank: np.ndarray  # of each token in the layout, its sequence's place in that order
    step: np.ndarray  # of each token in the layout
    active: np.ndarray  # sequences at each step
    at: np.ndarray  # where each step begins

    @staticmethod
    def of(sizes: np.ndarray) -> Batch:
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(int(sizes[0])), "right")
        at = np.cumsum(active) - active
        return Batch(order, sizes, np.arange(int(sizes.sum())) - np.repeat(at, active), np.repeat(np.arange(len(active)), active), active, at)

    @property
    def last(self) -> np.ndarray:
        """Where each sequence's last token stands."""
        return self.at[self.sizes - 1] + np.arange(len(self.order))

    def laid(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The tokens of the sequences, which begin at `starts` in flat, in this layout."""
        at = starts[self.order].take(self.rank)
        at += self.step
        return flat.take(at).astype(np.intp, copy=False)


def forward(start: np.ndarray, move: np.ndarray, e: np.ndarray, b: Batch, out: np.ndarray | None = None, scales: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(forward variables, each sequence's likelihood as a logarithm, longest first) for the emissions e of b's tokens; may overwrite e.
    `scales` takes what the steps are divided by, one array for each step that is scaled."""
    a = e if out is None else out
    logs, ones = np.zeros(len(b.order)), np.ones(len(start))
    active, at = b.active.tolist(), b.at.tolist()
    np.multiply(e[: active[0]], start, out=a[: active[0]])
    held, mul = np.empty((active[0], len(start))), np.multiply
    # Most steps are small and their time is that of the calls: an array's own dot begins soonest.
    for t in range(1, len(active)):
        n, i, j = active[t], at[t], at[t - 1]
        now = a[i : i + n]
        mul(a[j : j + n].dot(move, held[:n]), e[i : i + n], now)
        if not t % SCALE_STEPS:
            c = now.dot(ones)
            now /= c[:, None]
            logs[:n] += np.log(c)
            if scales is not None:
                scales.append(c)
    return a, logs + np.log(a[b.last] @ ones)


def expected(start: np.ndarray, move: np.ndarray, e: np.ndarray, b: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start counts, move counts, states of each token in b's layout, likelihoods). Overwrites e; the states stand in scratch memory until the next call, one state after the other."""
    n_tokens, k = e.shape
    scales: list[np.ndarray] = []
    alpha, logs = forward(start, move, e, b, SCRATCH.rows("alpha", n_tokens, k), scales)
    # Both ways have the same scales, and a sequence's last step its likelihood's inverse: each token's states add to 1 as they are.
    beta, last = SCRATCH.rows("beta", n_tokens, k), b.last
    beta[last] = 1 / alpha[last].sum(axis=1)[:, None]
    back = np.ascontiguousarray(move.T)
    active, at, mul = b.active.tolist(), b.at.tolist(), np.multiply
    for t in range(len(active) - 1, 0, -1):
        n, i, j = active[t], at[t], at[t - 1]
        ahead = e[i : i + n]
        mul(ahead, beta[i : i + n], ahead)
        if not t % SCALE_STEPS:
            ahead /= scales.pop()[:, None]
        ahead.dot(back, beta[j : j + n])
    # What stands in e from the second step on is the successors' share. After steps of as many sequences, tokens and those before them lie side by side.
    moves, ends = np.zeros((k, k)), [*at[1:], n_tokens]
    alike = np.flatnonzero(np.diff(b.active[:-1], prepend=0, append=0)).tolist()  # steps whose number of sequences is another than the step's before; the last
    for t, until in zip(alike, alike[1:]):
        i, j, n = at[t + 1], ends[until], active[t]
        moves += alpha[i - n : j - n].T.dot(e[i:j])
    # Some tokens at a time, which stay in the processor's cache while they are turned.
    states, held = SCRATCH.rows("states", n_tokens, k).reshape(k, n_tokens), np.empty((CACHE_TOKENS, k))
    for i in range(0, n_tokens, CACHE_TOKENS):
        some = slice(i, min(i + CACHE_TOKENS, n_tokens))
        states[:, some] = mul(alpha[some], beta[some], held[: some.stop - i]).T
    return states[:, : active[0]].sum(axis=1), moves * move, states.T, logs


def groups_of(sizes: np.ndarray, chosen: np.ndarray, tokens: int = BATCH_TOKENS) -> Iterator[np.ndarray]:
    """The chosen sequences, longest first, in groups of up to some `tokens` tokens, which are alike in tokens."""
    chosen = chosen[np.argsort(-sizes[chosen], kind="stable")]
    total = int(sizes[chosen].sum())
    number = (np.cumsum(sizes[chosen]) - sizes[chosen]) * -(-total // tokens) // max(1, total)
    for k in np.unique(number).tolist():
        yield chosen[number == k]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for i in range(b.num_rows):
            row = {n: b.column(n).slice(i, 1) for n in b.schema.names}
            row["sizes"] = row["sizes"].flatten().to_numpy()
            row["starts"] = np.cumsum(row["sizes"]) - row["sizes"]
            row["flat"] = np.frombuffer(row["symbols"][0].as_buffer(), "<u2").astype(np.int32)
            row["held"] = row["held_out"].flatten().to_numpy(zero_copy_only=False)
            yield row


def _counts(word: pa.Array, symbol: pa.Array, c: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    columns = [word, symbol, pa.array(c, pa.int64()), *(pa.array(np.ascontiguousarray(values[:, i])) for i in range(values.shape[1]))]
    return pa.RecordBatch.from_arrays(columns, names=["word", "symbol", "c", *(f"s{i}" for i in range(values.shape[1]))])


def _word_numbers(row: dict, head: int) -> np.ndarray:
    """Of each token the known word's number, or that plus the place in the block's tail."""
    out = row["flat"].copy()
    out[out >= head] = np.frombuffer(row["numbers"][0].as_buffer(), "<u4")
    return out


def _expect(shared, words: bool) -> Callable:
    """Rows (word, symbol, c, counts by state): symbol -1 the start states, -2 the likelihood (in s0), -3 - i the moves from state i.
    From 0 on symbols, or with `words` numbers of known words; other words then come by name, with their counts c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, unigram, head, n_known = shared.value
        k, size = len(model.start), n_known if words else len(model.emit)
        ratio = aligned(model.emit / unigram[:, None])
        logs_of = np.log(unigram)
        start, moves, symbols, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, size)), 0.0
        for row in _blocks(batches):
            numbers = _word_numbers(row, head) if words else row["flat"]
            n_tail = len(row["tail"].flatten()) if words else 0
            tail, tail_c = np.zeros((k, n_tail)), np.zeros(n_tail, np.int64)
            for group in groups_of(row["sizes"], np.flatnonzero(~row["held"])):
                b = Batch.of(row["sizes"][group])
                flat = b.laid(row["flat"], row["starts"][group])
                a, m, gamma, logs = expected(model.start, model.move, SCRATCH.gathered("e", ratio, flat), b)
                start += a
                moves += m
                likelihood += float(logs.sum() + logs_of[flat].sum())
                own = b.laid(numbers, row["starts"][group]) if words else flat
                if words:
                    np.rint(np.multiply(gamma, GRAIN, out=gamma), out=gamma)
                for s in range(k):
                    got = np.bincount(own, gamma[:, s], size + n_tail)
                    symbols[s] += got[:size]
                    tail[s] += got[size:]
                if n_tail:
                    tail_c += np.bincount(own, minlength=size + n_tail)[size:]
            seen = np.flatnonzero(tail_c)
            if len(seen):
                yield _counts(row["tail"].flatten().take(pa.array(seen)), pa.nulls(len(seen), pa.int32()), tail_c[seen], tail.T[seen] / GRAIN)
        symbols = symbols.T
        seen = np.flatnonzero(symbols.any(axis=1))
        number = np.concatenate([seen, [-1, -2], -3 - np.arange(k)])
        values = np.concatenate([symbols[seen] / (GRAIN if words else 1), start[None], np.eye(1, k) * likelihood, moves])
        SCRATCH.clear()
        yield _counts(pa.nulls(len(number), pa.string()), pa.array(number, pa.int32()), np.zeros(len(number), np.int64), values)

    return run


@dataclass
class Final:
    """The model word by word."""

    start: np.ndarray
    move: np.ndarray
    alphabet: Alphabet  # without names and symbols, which scoring has no use for
    counts: np.ndarray  # of the known words by state
    total: np.ndarray  # n(s)
    weight: np.ndarray  # k(s)

    def ratio(self, counts: np.ndarray, shares: np.ndarray, out: np.ndarray) -> None:
        """P(w | s) / u(w) of words with these counts by state and shares u; out may be counts."""
        np.divide(counts, shares[:, None], out=out)
        out += self.weight
        out /= self.total + self.weight


def _score(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Final = shared.value
        alphabet, k = model.alphabet, len(model.start)
        n_words, known_share, held = len(alphabet.counts), alphabet.shares(alphabet.counts), np.empty((0, k))
        for row in _blocks(batches):
            sizes, flat, n_tail = row["sizes"], _word_numbers(row, alphabet.head), row["n_tail"][0].as_py()
            if len(held) < n_words + n_tail:  # one table for all blocks: the known words' rows stay, the others are each block's own
                held = aligned_room(n_words + n_tail + n_tail // 8, k)
                model.ratio(model.counts, known_share, held[:n_words])
            ratio, tail, tail_c = held[: n_words + n_tail], held[n_words : n_words + n_tail], np.zeros(n_tail)
            tail.fill(0)
            met = row["met"].flatten()
            if len(met):
                at = met.field("pos").to_numpy()
                tail_c[at] = met.field("c").to_numpy()
                for s in range(k):
                    tail[at, s] = (met.field(f"p{s // 4}").to_numpy() >> 16 * (s % 4) & 0xFFFF) / GRAIN
                many = met.field("many")
                full = np.flatnonzero(many.is_valid().to_numpy(zero_copy_only=False))
                if len(full):
                    tail[at[full]] = many.drop_null().flatten().to_numpy().reshape(-1, k)
            tail_share = alphabet.shares(tail_c)
            share = np.log10(np.concatenate([known_share, tail_share]))
            model.ratio(tail, tail_share, tail)
            seen = np.concatenate([alphabet.counts, tail_c]) > 0
            base = np.add.reduceat(share[flat], row["starts"])
            n_known = np.add.reduceat(seen[flat], row["starts"], dtype=np.int64)
            score = np.empty(len(sizes))
            for group in groups_of(sizes, np.arange(len(sizes))):
                b = Batch.of(sizes[group])
                _, logs = forward(model.start, model.move, SCRATCH.gathered("e", ratio, b.laid(flat, row["starts"][group])), b)
                score[group[b.order]] = logs / math.log(10)
            yield pa.RecordBatch.from_arrays([row["doc_ids"].flatten(), row["held_out"].flatten(), pa.array(sizes, pa.int64()), pa.array(n_known), pa.array(base), pa.array(base + score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])
            del row, met, flat, share
            pa.default_memory_pool().release_unused()
        SCRATCH.clear()

    return run


def _state_names(states: int) -> list[str]:
    return [f"s{i}" for i in range(states)]


def _pass(coded: DataFrame, model: Hmm, unigram: np.ndarray, alphabet: Alphabet, words: bool) -> tuple[DataFrame, object]:
    """The rows of `_expect`. Blocks are gathered to a few tasks per core, as each task returns up to a row per symbol."""
    sc, states = coded.sparkSession.sparkContext, len(model.start)
    shared = sc.broadcast((model, unigram, alphabet.head, len(alphabet.known)))
    columns = ["held_out", "sizes", "symbols", *(["tail", "numbers"] if words else [])]
    few = coded.select(*columns).coalesce(2 * sc.defaultParallelism)
    return few.mapInArrow(_expect(shared, words), "word string, symbol int, c long, " + ", ".join(f"{c} double" for c in _state_names(states))), shared


def _summed(rows: DataFrame, size: int, states: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(start counts, move counts, counts by symbol, likelihood). At most one row per symbol comes back: the alphabet bounds it."""
    names = _state_names(states)
    got = rows.filter("symbol is not null").groupBy("symbol").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
    number, values = got["symbol"].to_numpy(), np.stack([got[c].to_numpy() for c in names], axis=1)
    emit, move = np.zeros((size, states)), np.zeros((states, states))
    emit[number[number >= 0]] = values[number >= 0]
    move[-3 - number[number < -2]] = values[number < -2]
    return values[number == -1].sum(axis=0), move, emit, float(values[number == -2, 0].sum())


def train(coded: DataFrame, unigram: np.ndarray, alphabet: Alphabet, states: int = STATES, rounds: int = ROUNDS, gain: float = GAIN) -> Hmm:
    """coded: blocks; documents that are held out teach nothing."""
    model, last = Hmm.initial(unigram, states), -math.inf
    for _ in range(rounds if alphabet.tokens else 0):
        rows, shared = _pass(coded, model, unigram, alphabet, False)
        start, move, emit, likelihood = _summed(rows, len(unigram), states)
        model = Hmm.from_counts(start, move, emit, unigram)
        shared.unpersist()
        if likelihood - last < gain * alphabet.tokens:
            break
        last = likelihood
    return model


def frequent(counts: DataFrame, most: int) -> tuple[pa.Table, int]:
    """(word and c of the most frequent words, in order; the least count among them): all words from that count on,
    which is the least one that leaves no more than `most`. It is found from how many words have each count, so the
    driver gets the head alone."""
    per = counts.groupBy("c").agg(F.count(F.lit(1)).alias("k"))
    if counts.limit(most + 1).count() <= most:
        least = 0
    else:
        words = 0
        for r in per.filter(F.col("c") > 1).orderBy(F.col("c").desc()).limit(most + 1).collect():
            words += r["k"]
            if words > most:
                least = r["c"] + 1
                break
        else:
            least = 2
    got = counts.select("word", "c").filter(F.col("c") >= least).toArrow()
    return got.take(pc.sort_indices(got, [("c", "descending"), ("word", "ascending")])), least


def lm_scores(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, head_words: int = HEAD, known_words: int = KNOWN) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, and the two scores per token.

    held_out is a column of booleans (null: false); its rows teach nothing. A null text is empty and has one token, its
    end. Repeated rows each teach and are each returned; null ids are carried; extra columns are ignored. With no
    training rows every word is unknown and the score is the base score. An empty table gives no rows. Scores do not
    depend on how rows lie in files, but for rounding.
    """
    spark = docs.sparkSession
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    counts = S.store(rows.filter("not held_out").select("text").mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).collect()[0]
    top, least = frequent(counts.filter(F.col("word") != END), known_words)
    # The head: all words from some count on, as many as it may hold.
    c = top["c"].to_numpy()
    n_head = next((i for i in range(min(head_words, len(c)), 0, -1) if i == len(c) or c[i] < c[i - 1]), 0)
    ends = counts.filter(F.col("word") == END).collect()
    alphabet = Alphabet.of(top, ends[0]["c"] if ends else 0, n_head + 1, total["n"], total["v"])
    bucket = (F.crc32(F.col("word").cast("binary")) % BUCKETS).cast("int").alias("bucket")
    rest = np.zeros(BUCKETS)
    for r in counts.filter((F.col("word") != END) & (F.col("c") < least)).groupBy(bucket).agg(F.sum("c").alias("c")).collect():
        rest[r["bucket"]] = r["c"]
    unigram = alphabet.unigram(rest)

    shared = spark.sparkContext.broadcast(alphabet)
    kind = rows.schema["doc_id"].dataType.simpleString()
    coded = S.store(rows.mapInArrow(_code(shared), f"block long, doc_ids array<{kind}>, held_out array<boolean>, sizes array<long>, symbols binary, tail array<string>, numbers binary"), "coded")
    S.discard(counts)
    model = train(coded, unigram, alphabet, states, rounds)
    S.release(spark)

    # The last pass: counts by state of every word.
    names, n_known = _state_names(states), len(alphabet.known)
    last, _ = _pass(coded, model, unigram, alphabet, True)
    last = S.store(last.groupBy("word", "symbol").agg(F.sum("c").alias("c"), *(F.sum(c).alias(c) for c in names)), "word-states")
    S.release(spark)
    start, move, own, _ = _summed(last if total["n"] else last.limit(0), n_known, states)
    words = last.filter("word is not null").select("word", "c", *names)
    rare = words.agg(*(F.coalesce(F.sum(x), F.lit(0.0)).alias(f"{k}{c}") for c in names for k, x in (("n", F.col(c)), ("k", F.least(F.col(c), F.lit(1.0)))))).collect()[0]
    fitted = Hmm.from_counts(start, move, np.zeros_like(model.emit), unigram) if total["n"] else model
    of_rare = lambda k: np.array([rare[f"{k}{c}"] for c in names])
    weight = Hmm.weights(np.minimum(own, 1).sum(axis=0) + of_rare("k"))
    best = spark.sparkContext.broadcast(Final(fitted.start, fitted.move, replace(alphabet, known={}, symbols=alphabet.symbols[:0]), own, own.sum(axis=0) + of_rare("n"), weight))

    # A block's rarer words meet their counts; each word is one row per block, so no word is frequent here.
    asked = coded.select("block", F.posexplode("tail").alias("pos", "word"))
    # Their counts come back as whole GRAINs: four states to a 64-bit number, for most words; words of more tokens have them in full.
    few = F.col("c") <= PACKED
    grains = lambda i: F.shiftleft(F.round(F.col(names[i]) * GRAIN).cast("long"), 16 * (i % 4))
    packed = [f"p{k}" for k in range(-(-states // 4))]
    numbers = [F.when(few, reduce(lambda x, y: x.bitwiseOR(y), (grains(i) for i in range(4 * k, min(states, 4 * k + 4))))).otherwise(F.lit(0).cast("long")).alias(p) for k, p in enumerate(packed)]
    rows_back = asked.join(words, "word").select("block", "pos", "c", *numbers, F.when(~few, F.array(*names)).alias("many"))
    met = rows_back.groupBy("block").agg(F.collect_list(F.struct("pos", "c", *packed, "many")).alias("met"))
    item = "struct<pos:int,c:long," + ",".join(f"{p}:long" for p in packed) + ",many:array<double>>"
    ready = coded.join(met, "block", "left").select("doc_ids", "held_out", "sizes", "symbols", F.size("tail").alias("n_tail"), "numbers", F.coalesce("met", F.expr(f"cast(array() as array<{item}>)")).alias("met"))
    scored = ready.mapInArrow(_score(best), f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total["n"]).cast("long").alias("train_tokens"), "base_score", "score",
        (F.col("score") / F.col("n_tokens")).alias("score_per_token"), (F.col("base_score") / F.col("n_tokens")).alias("base_per_token"),
    )
