"""Language identification with bit-sliced Bloom filters over character n-grams.

Learning: n-gram counts per language over all training documents, aggregated map-side. A language keeps the n-grams of
at least MIN_RATE of its own n-grams, and at least MIN_SHARE of the rate that the n-gram's most typical language has, so
it keeps at most 1 / MIN_RATE of them however large the corpus: that bounds the filter. The filter has one row of bits
per slot and one bit per language in it; the AND of an n-gram's k rows is the mask of all languages that hold it.

Prediction: the masks of a text's n-grams are counted per language, c_l of n. A filter that is full to f_l answers yes
by mistake at the rate f_l^k, so the count is corrected to (c_l - n f_l^k) / (1 - f_l^k); the largest decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

SIZES = (2, 3, 4)
MIN_RATE, MIN_SHARE = 1e-5, 0.1
HASHES = 3
#: Slots for each n-gram that the fullest language keeps, rounded up to a power of two.
SLOTS_PER_GRAM = 8


def cut_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(words of all texts, coded by the distinct ones; words per text): runs of letters in lower case. Some are empty, which counts for nothing."""
    lists = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts.cast(pa.string()), "")), r"\P{L}+")
    return lists.flatten().dictionary_encode(), np.diff(lists.offsets.to_numpy())


def grams_of(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes of the character n-grams of each word between marks of its start and end; number of the word of each)."""
    number = np.array([i for i, w in enumerate(words) if w], np.int64)
    if not len(number):
        return np.empty(0, np.uint64), number
    code = np.frombuffer(("<" + "><".join(w for w in words if w) + ">").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(number, np.fromiter((len(w) + 2 for w in words if w), np.int64, len(number)))
    hashes, owners = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        h = np.full(len(code) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[k : len(code) - n + 1 + k]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        own = owner[: len(h)]
        inside = own == owner[n - 1 :]
        hashes.append(h[inside])
        owners.append(own[inside])
    return np.concatenate(hashes), np.concatenate(owners)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: dict[str, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, own in words.items():
            h, owner = grams_of(list(own))
            weight = np.fromiter(own.values(), np.int64, len(own))[owner]
            grams, at = np.unique(h, return_inverse=True)
            n = np.bincount(at, weight, len(grams)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], names=["lang", "gram", "n"])
        words.clear()

    for b in S.batches_of(batches, 4 << 20):
        for lang in pc.unique(b.column(1)).to_pylist():
            coded, _ = cut_words(b.column(0).filter(pc.equal(b.column(1), lang)))
            n = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
            own = words.setdefault(lang, Counter())
            for w, k in zip(S.strings(coded.dictionary), n.tolist()):
                own[w] += k
        if sum(map(len, words.values())) > 300_000:
            yield from out()
    yield from out()


@dataclass
class LanguageFilter:
    """rows[slot] holds a bit per language, 64 languages to a word; rate[l] is the false positive rate."""

    languages: tuple[str, ...]
    rows: np.ndarray
    rate: np.ndarray
    usual: int  # the language with most training n-grams, for texts of which nothing is known

    def slots(self, grams: np.ndarray) -> np.ndarray:
        step = (grams >> np.uint64(32)) | np.uint64(1)
        return ((grams[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) & np.uint64(len(self.rows) - 1)).astype(np.int64)

    def masks(self, grams: np.ndarray) -> np.ndarray:
        """For each n-gram, the languages that hold it (with false positives), as words of 64 bits."""
        return np.bitwise_and.reduce(self.rows[self.slots(grams)], axis=1)

    def word_counts(self, words: list[str]) -> np.ndarray:
        """For each word, how many of its n-grams each language holds, and last, how many it has."""
        grams, owner = grams_of(words)
        masks = self.masks(grams)
        out = np.zeros((len(words), len(self.languages) + 1), np.int64)
        for i in range(len(self.languages)):
            bit = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
            out[:, i] = np.bincount(owner, bit.astype(np.float64), len(words))
        out[:, -1] = np.bincount(owner, minlength=len(words))
        return out

    def decide(self, counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language, score) of texts with these per-language counts of their n n-grams."""
        share = (counts / np.maximum(n, 1)[:, None] - self.rate) / (1 - self.rate)
        best = share.argmax(axis=1)
        score = np.clip(share[np.arange(len(best)), best], 0, 1)
        return np.where(score > 0, best, self.usual), score


def slots_for(most: int) -> int:
    return 1 << max(10, (SLOTS_PER_GRAM * most - 1).bit_length())


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> LanguageFilter | None:
    """From all rows with a text and a language; None if there are none."""
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("text is not null and lang is not null")
    counts = S.store(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    seen = tuple(sorted(set(totals) | {r["lang"] for r in rows.select("lang").distinct().collect()}))
    if not seen:
        return None
    total = F.broadcast(counts.groupBy("lang").agg(F.sum("n").alias("total")))
    rates = counts.join(total, "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("rate")).filter(F.col("rate") >= MIN_RATE)
    top = rates.groupBy("gram").agg(F.max("rate").alias("top"))
    kept = S.store(rates.join(top, "gram").filter(F.col("rate") >= MIN_SHARE * F.col("top")).select("lang", "gram"), "grams-kept")
    most = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).collect()[0][0] or 1
    return filter_of(kept, seen, max(seen, key=lambda x: (totals.get(x, 0), x)), most)


def filter_of(kept: DataFrame, languages: tuple[str, ...], usual: str, most: int) -> LanguageFilter:
    """The filter of (lang, gram) rows. Slots of a language meet in Spark, OR-ed to words of 64 languages, so what comes back is the filter itself: a row per slot and word at most."""
    m = slots_for(most)
    low, step = F.col("gram").bitwiseAND(m - 1), F.shiftrightunsigned("gram", 32).bitwiseOR(1).bitwiseAND(m - 1)
    order = F.element_at(F.create_map(*(x for i, lang in enumerate(languages) for x in (F.lit(lang), F.lit(i)))), F.col("lang"))
    slots = kept.select(order.alias("l"), F.explode(F.array(*((low + k * step).bitwiseAND(m - 1) for k in range(HASHES)))).alias("slot"))
    # A bit per language, twice set or not: of a language's equal slots one counts.
    bits = slots.distinct().groupBy("slot", F.floor(F.col("l") / 64).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(l % 64 as int))")).alias("bits"))
    out = LanguageFilter(languages, np.zeros((m, -(-len(languages) // 64)), np.uint64), np.zeros(len(languages)), languages.index(usual))
    got = bits.toArrow()
    out.rows[got["slot"].to_numpy(), got["word"].to_numpy()] = got["bits"].to_numpy().view(np.uint64)
    for i in range(len(languages)):
        out.rate[i] = (np.count_nonzero(out.rows[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / m) ** HASHES
    return out


def _predict(shared) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: LanguageFilter | None = shared.value
        for b in S.batches_of(batches, 4 << 20):
            if model is None:
                lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
            else:
                coded, counts = cut_words(b.column(2))
                per_word = model.word_counts(S.strings(coded.dictionary))
                # Each text has one word at least, if an empty one.
                sums = np.add.reduceat(per_word[coded.indices.to_numpy()], np.cumsum(counts) - counts, axis=0)
                letters = sums[:, -1] > 0
                best, score = model.decide(sums[:, :-1], sums[:, -1])
                score = np.where(letters, score, 0.0)
                lang = [model.languages[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, held_out=None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    held_out is a column of booleans (null: false); its rows teach nothing. Predictions see the text alone: `und` with
    score 0 if it is null or has no letter, and for all if nothing can be learnt. Ties go to the language that sorts
    first. Repeated rows are each returned and each teach; null ids are carried; extra columns are ignored.
    """
    held = F.coalesce(held_out if held_out is not None else F.lit(False), F.lit(False))
    model = learn(docs.filter(~held), text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(F.col(id_col).alias("doc_id"), held.alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predict(shared), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
