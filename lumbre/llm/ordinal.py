"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight per hashed text feature is shared by all grades; ordered thresholds c_1 < c_2 < ... cut the score s, and
P(grade >= k) = logistic(s - c_k). The expected grade is the sum of these tail probabilities. Features are whether a
text holds a word, a word shape or a trait of the whole (repetition, capitals, marks), hashed into 2^18 places; presence
rather than frequency, so that a text of any length is judged by what it holds.

The model is fitted on a bounded sample of the rated documents (at most SAMPLE_DOCS rows, those whose ids and texts have
the least hashes, and of them no more than hold SAMPLE_PLACES features together), so on the same rows at any partitioning,
with an L1 penalty; scoring reads every text once and shuffles nothing.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

SPACES = 1 << 18
#: The bounds on the rated documents that the model is fitted on, and on the features that they hold together.
SAMPLE_DOCS, SAMPLE_PLACES = 12_000, 16_000_000
_LETTERS = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1+")


def _place(feature: str) -> int:
    return zlib.crc32(feature.encode("utf-8", "surrogatepass")) % SPACES


def chunk_features(chunk: str) -> tuple[int, ...]:
    """Places of a chunk between white space: its letters in lower case, and its shape (letter runs as a or A, digits as 0, runs collapsed)."""
    words = _LETTERS.findall(chunk)
    shape = _LETTERS.sub(lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "a", re.sub(r"\d+", "0", chunk))
    return (*(_place("w " + w.lower()) for w in words), _place("s " + _RUN.sub(r"\1", shape)[:12]))


def _bin(name: str, share: float, cuts: tuple[float, ...]) -> int:
    return _place(f"{name} {sum(share > c for c in cuts)}")


def text_features(chunks: list[str], distinct: set[str]) -> list[int]:
    """Places of the traits of the whole text."""
    n = len(chunks)
    if not n:
        return [_place("empty")]
    shares = (0.02, 0.05, 0.1, 0.2, 0.4, 0.7)
    repeats = sum(a == b for a, b in zip(chunks, chunks[1:])) / n
    marked = sum(not c[-1].isalnum() and c[-1] not in ".,;:?" for c in chunks) / n
    upper = sum(len(c) > 1 and c.isupper() for c in chunks) / n
    bare = sum(not any(x.isalpha() for x in c) for c in chunks) / n
    return [
        _bin("distinct", len(distinct) / n, (0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
        _bin("repeats", repeats, shares),
        _bin("marked", marked, shares),
        _bin("upper", upper, shares),
        _bin("bare", bare, shares),
        _bin("length", math.log2(n), (2, 3, 4, 5, 6, 8, 10, 12)),
    ]


def places_of(text: str | None) -> np.ndarray:
    """Sorted distinct places of all features of a whole text."""
    chunks = (text or "").split()
    distinct = set(chunks)
    out = set(text_features(chunks, distinct))
    for c in distinct:
        out.update(chunk_features(c))
    return np.array(sorted(out), np.int32)


@dataclass
class OrdinalModel:
    """Weights of the places that have one, ordered thresholds (one fewer than grades) and the grades' names in order."""

    places: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray
    grades: tuple[int, ...]

    def dense(self) -> np.ndarray:
        w = np.zeros(SPACES)
        w[self.places] = self.weights
        return w

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..., one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -60, 60)))


def fit_arrays(rows: list[np.ndarray], grades: np.ndarray, n_grades: int, l1: float | None = None, rounds: int = 250, min_docs: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by accelerated proximal gradient on the mean negative log-likelihood. The L1 penalty falls with the root of the sample's size."""
    l1 = 0.0045 / math.sqrt(len(rows)) if l1 is None else l1
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    seen = np.bincount(flat, minlength=SPACES)
    use = seen[flat] >= min_docs
    flat, owner = flat[use], owner[use]
    places, column = np.unique(flat, return_inverse=True)
    n, k = len(rows), n_grades - 1
    counts = np.bincount(grades, minlength=n_grades)
    above = np.clip(1 - np.cumsum(counts)[:-1] / n, 1e-4, 1 - 1e-4)
    cuts = -np.log(above / (1 - above))
    cuts = np.maximum.accumulate(cuts + 1e-3 * np.arange(k))
    low = np.where(grades > 0, grades - 1, 0)  # the threshold below the grade, if any
    w = np.zeros(len(places))
    wy, cy, t = w.copy(), cuts.copy(), 1.0
    # Places differ widely in how many texts have them; steps are scaled by that.
    scale = 1.0 / (0.25 * np.bincount(column, minlength=len(places)) / n * np.bincount(owner, minlength=n).max() ** 0.5 + 1e-3)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    rate = 0.5
    for _ in range(rounds):
        s = np.bincount(owner, wy[column], n)
        # P(g) = F(s - c_g) - F(s - c_{g+1}), with F = 1 below the first and 0 above the last threshold.
        upper = np.where(grades > 0, sig(s - cy[low]), 1.0)
        lower = np.where(grades < k, sig(s - cy[np.minimum(grades, k - 1)]), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        du, dl = np.where(grades > 0, upper * (1 - upper), 0.0) / p, np.where(grades < k, lower * (1 - lower), 0.0) / p
        ds = -(du - dl) / n
        g = np.bincount(column, ds[owner], len(places))
        gc = np.bincount(low, np.where(grades > 0, du, 0) / n, k)[:k] - np.bincount(np.minimum(grades, k - 1), np.where(grades < k, dl, 0) / n, k)[:k]
        step = rate * scale
        new = wy - step * g
        new = np.sign(new) * np.maximum(np.abs(new) - step * l1, 0)
        new_cuts = np.maximum.accumulate(cy - rate * gc + 1e-6 * np.arange(k))
        t_next = (1 + math.sqrt(1 + 4 * t * t)) / 2
        if ((wy - new) @ ((new - w) / scale)) > 0:  # momentum that points back is dropped
            t_next, t = 1.0, 1.0
        wy, cy = new + (t - 1) / t_next * (new - w), np.maximum.accumulate(new_cuts + (t - 1) / t_next * (new_cuts - cuts))
        w, cuts, t = new, new_cuts, t_next
    out = np.zeros(SPACES)
    out[places] = w
    return out, cuts


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in S.batches_of(batches, 4 << 20):
        rows = [places_of(t) for t in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(3)), pa.array([len(r) for r in rows], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], names=["r_id", "text_hash", "grade", "n", "places"])


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", sample_docs: int = SAMPLE_DOCS, sample_places: int = SAMPLE_PLACES) -> OrdinalModel:
    """ratings: (id, grade), grades any integers; rows with a null are ignored, of several ratings of an id the least holds.

    Rows that repeat id and text teach once. The rows with the least hashes of id and text are taken, in that order, up
    to sample_docs rows and sample_places features; the first row always.
    """
    rated = ratings.filter(F.col(id_col).isNotNull() & F.col(grade_col).isNotNull()).groupBy(F.col(id_col).alias("r_id")).agg(F.min(grade_col).cast("int").alias("grade"))
    order = [F.xxhash64("r_id"), "r_id"]
    sample = S.store(rated.orderBy(*order).limit(sample_docs), "rated")
    rows = docs.select(F.col(id_col).alias("d_id"), S.text_hash(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")).join(F.broadcast(sample), F.col("d_id") == F.col("r_id")).select("r_id", "text_hash", "grade", "text")
    kind = rows.schema["r_id"].dataType.simpleString()
    # An id may repeat with many texts: the bounds hold for rows.
    held = S.store(rows.mapInArrow(_features, f"r_id {kind}, text_hash long, grade int, n long, places binary").dropDuplicates(["r_id", "text_hash"]), "rated-features")
    first = held.select("r_id", "text_hash", "n").orderBy(*order, "text_hash").limit(sample_docs).collect()
    total, taken = 0, 0
    while taken < len(first) and (not taken or total + first[taken]["n"] <= sample_places):
        total, taken = total + first[taken]["n"], taken + 1
    got = held.orderBy(*order, "text_hash").limit(taken).select("grade", "places").collect() if taken else []
    if not got:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.zeros(0), ())
    got.sort(key=lambda r: (r["grade"], bytes(r["places"])))
    names = tuple(sorted({r["grade"] for r in got}))
    if len(names) == 1:
        return OrdinalModel(np.empty(0, np.int64), np.empty(0), np.zeros(0), names)
    order = {g: i for i, g in enumerate(names)}
    w, cuts = fit_arrays([np.frombuffer(r["places"], np.int32) for r in got], np.array([order[r["grade"]] for r in got]), len(names))
    places = np.flatnonzero(w)
    return OrdinalModel(places, w[places], cuts, names)


#: Chunks whose places with weight a worker remembers.
CACHE_CHUNKS = 250_000


@functools.lru_cache(maxsize=1)
def _memory(key: int) -> dict[str, tuple[int, ...]]:
    return {}


MEMORIES = (_memory,)


def _scorer(model: OrdinalModel, key: int) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Texts to (scores, tails)."""
    weights, memory = model.dense(), _memory(key)

    def run(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        scores = np.zeros(len(texts))
        for i, text in enumerate(texts.to_pylist()):
            chunks = (text or "").split()
            distinct = set(chunks)
            found = set(text_features(chunks, distinct))
            for c in distinct:
                own = memory.get(c)
                if own is None:
                    own = tuple(p for p in chunk_features(c) if weights[p])
                    if len(memory) < CACHE_CHUNKS:
                        memory[c] = own
                if own:
                    found.update(own)
            scores[i] = math.fsum(weights[p] for p in found)
        return scores, model.tails(scores)

    return run


def _score(shared, key: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: OrdinalModel = shared.value
        scored = _scorer(model, key)
        names = np.array(model.grades, np.float64)
        for b in S.batches_of(batches, 4 << 20):
            scores, tails = scored(b.column(1))
            expected = names[0] + tails @ np.diff(names) if len(names) else np.zeros(b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores), pa.array(expected), pa.array(list(tails), pa.list_(pa.float64()))], names=["key", "score", "expected_grade", "tails"])

    return run


def score(docs: DataFrame, model: OrdinalModel, keys: list[str], text_col: str = "text") -> DataFrame:
    """The columns `keys` of docs with score, expected_grade and tails (P(grade >= k) for each grade but the first). A null text has the features of an empty one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.struct(*keys).alias("key"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(_score(shared, shared._jbroadcast.id()), f"key {rows.schema['key'].dataType.simpleString()}, score double, expected_grade double, tails array<double>")
    return out


def graded(labels: DataFrame) -> DataFrame:
    """Grades from the labels: 0 toxic, 1 of low quality, 2 good. A null label is no rating."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, score, expected_grade (0 to 2), p_not_toxic and p_good (tail probabilities), selected (p_good >= 0.5).

    Without rated documents, or with one grade only, the tails are null and every document is selected. Null texts are
    scored as empty, null ids carried, repeated rows each returned, extra columns ignored.
    """
    model = fit(docs, graded(labels), id_col, text_col)
    out = score(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), model, ["doc_id"])
    good = F.get("tails", F.size("tails") - 1)
    return out.select("key.doc_id", "score", "expected_grade", F.get("tails", F.lit(0)).alias("p_not_toxic"), good.alias("p_good"), F.coalesce(good >= 0.5, F.lit(True)).alias("selected"))


def _select(shared, key: int, text_at: int, threshold: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scored = _scorer(shared.value, key)
        for b in S.batches_of(batches, 4 << 20):
            _, tails = scored(b.column(text_at))
            yield b.filter(pa.array(tails[:, -1] >= threshold)) if tails.shape[1] else b

    return run


def select_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, whose tail probability of the best grade reaches the threshold.

    Without ratings, or with one grade only, all rows. Null texts are scored as empty, null ids carried, repeated rows
    each judged alike; an empty table gives no rows; columns may have any names.
    """
    model = fit(docs, graded(labels), id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    # The columns go by number, as names with dots would be taken for fields.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    out = plain.mapInArrow(_select(shared, shared._jbroadcast.id(), docs.columns.index(text_col), threshold), plain.schema)
    return out.toDF(*docs.columns)
