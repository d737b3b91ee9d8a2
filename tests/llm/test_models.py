"""op4, op8 and op9: held-out accuracy, exact probabilities, brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumbre.llm import hmm, language_id, ordinal, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger(spark):
    import os

    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


def test_op4_grades_held_out_documents(spark, larger):
    docs, labels = spark.read.parquet(f"{larger}/documents.parquet"), spark.read.parquet(f"{larger}/labels.parquet")
    grades = ordinal.graded(labels)
    model = ordinal.fit(docs.filter("doc_id % 3 <> 0"), grades)
    assert list(model.thresholds) == sorted(model.thresholds) and len(model.thresholds) == 2
    out = ordinal.score(docs.filter("doc_id % 3 = 0"), model, ["doc_id"]).select("key.doc_id", "expected_grade", "tails").join(grades, "doc_id").collect()
    good = [r for r in out if r.grade == 2]
    bad = [r for r in out if r.grade < 2]
    assert sum(r.tails[1] >= 0.5 for r in good) >= 0.95 * len(good)
    assert sum(r.tails[1] < 0.5 for r in bad) >= 0.7 * len(bad)
    assert all(1 >= r.tails[0] >= r.tails[1] >= 0 and abs(r.expected_grade - sum(r.tails)) < 1e-9 for r in out)


def test_op4_query_covers_all_documents(spark, sf):
    out = queries.op4_quality(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_op4_odd_rows_and_clashing_columns(spark, odd, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, 0), (6, 0, 1), (6, 0, 1), (9, 0, 1), (11, None, None), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = ordinal.quality(odd, labels).collect()
    assert len(out) == len(odd_rows) and all(0 <= r.p_good <= r.p_not_toxic <= 1 for r in out)
    left = ordinal.select_good(odd, labels)
    assert left.columns == odd.columns and left.schema == odd.schema
    assert left.count() == sum(r.selected for r in out)


def test_op4_without_ratings(spark, odd, empty, odd_rows):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ordinal.select_good(odd, none).count() == len(odd_rows)
    assert ordinal.select_good(odd, spark.createDataFrame([(1, 1, 0)], none.schema)).count() == len(odd_rows)
    assert ordinal.quality(empty, none).collect() == []


def test_op4_scores_equal_a_plain_recomputation(spark):
    """The optimum: at the fitted weights, no direction of a feature or threshold lowers the penalised likelihood; and scores, tails and grades are those of the weights."""
    rng = np.random.default_rng(5)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(5)]
    rows = []
    for i in range(400):
        grade = int(rng.integers(0, 3))
        own = [*rng.choice(words, 8), *(["vile"] if grade == 0 and rng.random() < 0.9 else []), *(["dull"] if grade == 1 and rng.random() < 0.9 else [])]
        rows.append((i, " ".join(own), grade))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = ordinal.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, grade int"))
    places = [set(ordinal.places_of(t).tolist()) for _, t, _ in rows]

    def loss(w, cuts):
        total = 0.0
        for own, (_, _, g) in zip(places, rows):
            s = sum(w.get(p, 0.0) for p in own)
            tail = [1.0, *(1 / (1 + math.exp(c - s)) for c in cuts), 0.0]
            total -= math.log(tail[g] - tail[g + 1])
        return total / len(rows) + 0.0045 / math.sqrt(len(rows)) * sum(map(abs, w.values()))

    w, cuts = dict(zip(model.places.tolist(), model.weights.tolist())), model.thresholds.tolist()
    best = loss(w, cuts)
    for p in [ordinal._place("w vile"), ordinal._place("w dull"), *list(w)[:10]]:
        for d in (-0.05, 0.05):
            assert loss({**w, p: w.get(p, 0.0) + d}, cuts) > best - 1e-4
    for k in (0, 1):
        for d in (-0.05, 0.05):
            assert loss(w, [c + d * (i == k) for i, c in enumerate(cuts)]) > best - 1e-4
    for r in ordinal.score(docs, model, ["doc_id"]).collect():
        s = sum(w.get(p, 0.0) for p in places[r.key.doc_id])
        tails = [1 / (1 + math.exp(c - s)) for c in cuts]
        assert abs(r.score - s) < 1e-9 and abs(r.expected_grade - sum(tails)) < 1e-9 and all(abs(a - b) < 1e-9 for a, b in zip(r.tails, tails))


def test_op4_sample_is_bounded_and_the_same_at_any_partitioning(spark):
    rows = [(i % 40, f"text number {i} " + "word " * (i % 7)) for i in range(300)]
    ratings = spark.createDataFrame([(i, i % 3) for i in range(40)], "doc_id long, grade int")
    models = [ordinal.fit(spark.createDataFrame(order, "doc_id long, text string").repartition(n), ratings, sample_docs=25, sample_places=400) for order, n in ((rows, 1), (rows[::-1], 6), (rows + rows, 3))]
    for m in models[1:]:
        assert m.places.tolist() == models[0].places.tolist() and m.weights.tolist() == models[0].weights.tolist() and m.thresholds.tolist() == models[0].thresholds.tolist()


def test_op4_column_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "good text", 1), (2, "other text", 2)], "`doc_id` long, `text` string, `a.b` long")
    left = ordinal.select_good(docs, spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int"))
    assert left.columns == docs.columns and left.count() <= 2


def test_op4_thresholds_of_four_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(600):
        level = rng.integers(0, 4)
        rows.append(np.array(sorted({int(level), *rng.integers(10, 60, 4).tolist()}), np.int32))
        grades.append(level)
    w, cuts = ordinal.fit_arrays(rows, np.array(grades), 4)
    model = ordinal.OrdinalModel(np.flatnonzero(w), w[w != 0], cuts, (0, 1, 2, 3))
    tails = model.tails(np.array([w[r].sum() for r in rows]))
    assert list(cuts) == sorted(cuts) and ((tails > 0.5).sum(axis=1) == grades).mean() > 0.95


def held(doc_id, n, k):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % n == k


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split(r"[\x20\x09-\x0D]+", low) if w]


def base_scores(rows):
    """(id, held_out, n_tokens, n_known, N, base) by the contract's formula."""
    counts = Counter()
    for i, t in rows:
        if not held(i, 5, 1):
            counts.update([*words(t), None])
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        tokens = [*words(t), None]
        out.append((i, held(i, 5, 1), len(tokens), sum(counts[w] > 0 for w in tokens), n, sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens)))
    return out


def assert_base(got, want):
    key = lambda r: repr((r[0], r[1], r[2], r[3], round(r[5], 4)))
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 * max(1, abs(b[5]))


def test_op8_base_scores_and_gain(spark, larger):
    got = [tuple(r) for r in queries.op8_hmm(spark, larger).collect()]
    assert_base(got, base_scores([(r.doc_id, r.text) for r in spark.read.parquet(f"{larger}/documents.parquet").collect()]))
    out = [r for r in got if r[1]]
    assert sum(r[6] for r in out) > 0.95 * sum(r[5] for r in out)  # held-out documents are likelier than under the unigram model


def test_op8_with_a_small_head_scores_rare_words_exactly(spark, odd, odd_rows):
    out = hmm.lm_scores(odd, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, head_words=3, known_words=5, rounds=1)
    assert_base([tuple(r) for r in out.collect()], base_scores([r[:2] for r in odd_rows]))
    assert all(math.isfinite(r.score) and r.score < 0 for r in out.collect())


def test_op8_empty(empty):
    assert hmm.lm_scores(empty).collect() == []


def tiny(states=3, symbols=5, seed=2):
    rng = np.random.default_rng(seed)
    return hmm.Hmm(rng.dirichlet(np.ones(states)), rng.dirichlet(np.ones(states), states), rng.dirichlet(np.ones(symbols), states).T)


def paths(model, sequence):
    """Probabilities of all state paths, by enumeration."""
    from itertools import product

    k = len(model.start)
    for path in product(range(k), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[sequence[0], path[0]]
        for t in range(1, len(sequence)):
            p *= model.move[path[t - 1], path[t]] * model.emit[sequence[t], path[t]]
        yield path, p


def swept(model, sequences):
    """(batch, tokens in its layout, expected counts, likelihood of each sequence as given)."""
    sizes, flat = np.array([len(s) for s in sequences]), np.concatenate(sequences)
    batch = hmm.Batch.of(sizes)
    laid = batch.laid(flat, np.cumsum(sizes) - sizes)
    start, moves, gamma, logs = hmm.expected(model.start, model.move, model.emit[laid], batch)
    symbols = np.stack([np.bincount(laid, gamma[:, s], len(model.emit)) for s in range(len(model.start))], axis=1)
    _, alone = hmm.forward(model.start, model.move, model.emit[laid], batch)
    np.testing.assert_allclose(alone, logs)
    own = np.empty(len(sizes))
    own[batch.order] = logs
    return (start, moves, symbols), own


def test_forward_and_expected_counts_equal_enumeration():
    model = tiny()
    sequences = [np.array(s) for s in ([0], [1, 2], [4, 4, 0, 1, 3], [2, 2, 2], [3, 0, 1, 2, 4, 1])]
    counts, logs = swept(model, sequences)
    start, moves, symbols = np.zeros(3), np.zeros((3, 3)), np.zeros((5, 3))
    for i, s in enumerate(sequences):
        everything = list(paths(model, s))
        total = sum(p for _, p in everything)
        assert abs(logs[i] - math.log(total)) < 1e-9
        for path, p in everything:
            start[path[0]] += p / total
            for t, state in enumerate(path):
                symbols[s[t], state] += p / total
                if t:
                    moves[path[t - 1], state] += p / total
    for mine, want in zip(counts, (start, moves, symbols)):
        np.testing.assert_allclose(mine, want, atol=1e-9)


def test_rounds_raise_the_likelihood():
    rng = np.random.default_rng(4)
    sequences = [rng.integers(0, 3, 30) + 3 * (i % 2) for i in range(40)]
    unigram = np.full(6, 1 / 6)
    model, before = hmm.Hmm.initial(unigram, 2), -np.inf
    for _ in range(25):
        counts, logs = swept(model, sequences)
        assert logs.sum() > before - 1
        before = logs.sum()
        model = hmm.Hmm.from_counts(*counts, unigram)
    assert before / 1200 > math.log(1 / 6) + 0.2  # it tells the two halves apart, as far as the unigram's weight lets it


def test_the_model_is_a_distribution():
    """Over all sequences of a length, likelihoods sum to one."""
    from itertools import product

    _, logs = swept(tiny(2, 3), [np.array(s) for s in product(range(3), repeat=4)])
    assert abs(np.exp(logs).sum() - 1) < 1e-9


def plain_sweep(model, s):
    """(log-likelihood, states of each token, move counts) of one sequence, each step scaled."""
    a, c = np.empty((len(s), len(model.start))), np.empty(len(s))
    for t, x in enumerate(s):
        a[t] = (model.start if t == 0 else a[t - 1] @ model.move) * model.emit[x]
        c[t] = a[t].sum()
        a[t] /= c[t]
    beta, moves = np.ones_like(a), np.zeros_like(model.move)
    for t in range(len(s) - 1, 0, -1):
        ahead = model.emit[s[t]] * beta[t] / c[t]
        beta[t - 1] = model.move @ ahead
        moves += np.outer(a[t - 1], ahead) * model.move
    return np.log(c).sum(), a * beta, moves


@pytest.mark.parametrize("known", [20, 45, 10_000])
def test_op8_score_equals_a_plain_recomputation(spark, known):
    """Every round and the final word model, document by document and word by word, with a head of 20 words, whichever words are broadcast."""
    from conftest import SCHEMA, sentence
    import random

    rng, rounds, states = random.Random(6), 3, 3
    rows = [(i, sentence(rng, rng.randint(0, 40)), "en", "a", 1) for i in range(150)] + [(150, "ba " * 300, "en", "a", 1), (151, None, "en", "a", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.doc_id: r for r in hmm.lm_scores(docs, F.col("doc_id") % 5 == 1, states=states, rounds=rounds, head_words=20, known_words=known).collect()}
    texts = {i: [*words(t), hmm.END] for i, t, *_ in rows}
    taught = [i for i in texts if i % 5 != 1]
    c = Counter(w for i in taught for w in texts[i])
    n, v = sum(c.values()), len(c)
    by = sorted((w for w in c if w != hmm.END), key=lambda w: (-c[w], w))
    least = c[by[20]] + 1  # all words of a count are in the head, or none
    head = [hmm.END, *(w for w in by if c[w] >= least)]
    symbol = lambda w: head.index(w) if w in head else len(head) + zlib.crc32(w.encode()) % hmm.BUCKETS
    number = {w: symbol(w) for i in texts for w in texts[i]}
    unigram = np.full(len(head) + hmm.BUCKETS, 0.5)
    for w, k in c.items():
        unigram[number[w]] += k
    unigram /= unigram.sum()
    model = hmm.Hmm.initial(unigram, states)
    for turn in range(rounds + 1):
        start, moves, emit, own = np.zeros(states), np.zeros((states, states)), np.zeros((len(unigram), states)), {}
        for i in taught:
            s = [number[w] for w in texts[i]]
            _, gamma, m = plain_sweep(model, s)
            start += gamma[0]
            moves += m
            for w, x, g in zip(texts[i], s, gamma):
                emit[x] += g
                own[w] = own.get(w, 0) + np.rint(g * hmm.GRAIN) / hmm.GRAIN
        last, model = model, hmm.Hmm.from_counts(start, moves, emit, unigram)
    total = sum(own.values())
    weight = 200 + sum(np.minimum(x, 1) for x in own.values())
    u = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    p = {w: (own.get(w, 0) + weight * u(w)) / (total + weight) for i in texts for w in texts[i]}
    unseen = weight * 0.5 / (n + 0.5 * (v + 1)) / (total + weight)
    np.testing.assert_allclose(sum(p[w] for w in c) + unseen, 1)  # a distribution over the words seen, with one share for all others
    vocabulary = list(p)
    final = hmm.Hmm(model.start, model.move, np.array([p[w] for w in vocabulary]))
    for i, ws in texts.items():
        want, _, _ = plain_sweep(final, [vocabulary.index(w) for w in ws])
        assert abs(got[i].score - want / math.log(10)) < 1e-9 * abs(want)
        assert got[i].n_tokens == len(ws) and abs(got[i].score_per_token * len(ws) - got[i].score) < 1e-9 * abs(want)


def test_frequent_words_are_all_above_one_count(spark):
    counts = spark.createDataFrame([("a", 9), ("b", 5), ("c", 5), ("d", 2), ("e", 1)], "word string, c long")
    names = lambda n: hmm.frequent(counts, n)[0]["word"].to_pylist()
    assert names(1) == ["a"] and names(2) == ["a"] and names(3) == ["a", "b", "c"] and names(4) == ["a", "b", "c", "d"] and names(5) == list("abcde")


def test_op9_predicts_held_out_documents(spark, larger):
    out = queries.op9_language_id(spark, larger).join(spark.read.parquet(f"{larger}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(out) > 100
    assert sum(r.lang == r.lang_pred for r in out) >= 0.97 * len(out)
    assert all(0 <= r.score <= 1 for r in out)


def test_op9_split(spark, sf, documents):
    got = {r.doc_id: r.held_out for r in queries.op9_language_id(spark, sf).collect()}
    assert got == {r.doc_id: held(r.doc_id, 4, 2) for r in documents.collect()}


def test_op9_odd_rows(odd, odd_rows, empty):
    out = language_id.identify(odd).collect()
    assert len(out) == len(odd_rows)
    langs = {r[2] for r in odd_rows if r[2] and r[1] is not None}
    for r in out:
        assert r.lang_pred in langs | {"und"}
    texts = Counter(any(c.isalpha() for c in r[1] or "") for r in odd_rows)
    assert Counter(r.lang_pred != "und" for r in out) == texts
    assert language_id.identify(empty).collect() == []


def test_op9_nothing_to_learn(odd):
    assert {r.lang_pred for r in language_id.identify(odd, F.lit(True)).collect()} == {"und"}


def test_filter_has_no_false_negatives_and_many_languages(spark):
    languages = tuple(f"l{i:03}" for i in range(130))
    grams = np.unique(language_id.grams_of([f"w{chr(0x4E00 + j)}" for j in range(200)])[0])
    kept = spark.createDataFrame([(x, int(g)) for i, x in enumerate(languages) for g in grams[i : i + 40].view(np.int64)], "lang string, gram long")
    f = language_id.filter_of(kept, languages, languages[0], 40)
    assert f.rows.shape == (1024, 3)
    masks = f.masks(grams)
    for i in range(len(languages)):
        held = (masks[:, i // 64] >> np.uint64(i % 64)) & np.uint64(1)
        assert held[i : i + 40].all()
        slots = np.unique(f.slots(grams[i : i + 40]))
        assert abs(f.rate[i] - (len(slots) / 1024) ** 3) < 1e-12 and held.sum() < 80


def test_op9_equals_a_plain_recomputation(spark):
    """Counts, cuts, masks and corrected shares with sets instead of filters; a text's language is that of the largest share, ties to the first."""
    rng = __import__("random").Random(2)
    parts = {"aa": "ba lo ti ne".split(), "bb": "ra mi ko lo".split(), "cc": "xu zi ba qe".split()}
    rows = [(i, " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(1, 30))), x) for i, x in enumerate(rng.choices(list(parts), k=120))]
    docs = spark.createDataFrame([*rows, (500, "12 34", "aa"), (501, "xx yy", None)], "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language_id.identify(docs, F.col("doc_id") % 4 == 2).collect()}
    counts = {x: Counter() for x in parts}
    grams = lambda text: [int(h) for w in re.findall(r"[^\W\d_]+", text.lower()) for h in language_id.grams_of([w])[0]]
    for i, t, x in rows:
        if i % 4 != 2:
            counts[x].update(grams(t))
    rate = {x: {g: n / sum(c.values()) for g, n in c.items()} for x, c in counts.items()}
    top = {g: max(r.get(g, 0) for r in rate.values()) for r in rate.values() for g in r}
    kept = {x: {g for g, v in r.items() if v >= language_id.MIN_RATE and v >= language_id.MIN_SHARE * top[g]} for x, r in rate.items()}
    m = language_id.slots_for(max(map(len, kept.values())))
    f = language_id.LanguageFilter(("aa", "bb", "cc"), np.zeros((m, 1), np.uint64), np.zeros(3), 0)
    slots = {x: set(f.slots(np.array(sorted(k), np.uint64)).ravel().tolist()) for x, k in kept.items()}
    for i, t, _ in rows:
        own = grams(t)
        share = []
        for x in ("aa", "bb", "cc"):
            wrong = (len(slots[x]) / m) ** 3
            hits = sum(all(s in slots[x] for s in f.slots(np.array([g], np.uint64))[0].tolist()) for g in own)
            share.append((hits / len(own) - wrong) / (1 - wrong))
        assert got[i].lang_pred == ("aa", "bb", "cc")[share.index(max(share))] and abs(got[i].score - min(1, max(0, max(share)))) < 1e-9
    assert got[500].lang_pred == "und" and got[500].score == 0 and got[501].lang_pred in parts


def test_op9_ties_go_to_the_first_language(spark):
    docs = spark.createDataFrame([(1, "ba lo", "zz"), (2, "ba lo", "aa"), (3, "ba", None)], "doc_id long, text string, lang string")
    assert {r.doc_id: r.lang_pred for r in language_id.identify(docs).collect()} == {1: "aa", 2: "aa", 3: "aa"}


def test_grams_are_those_of_the_marked_word():
    words = ["abc", "", "é", "abc"]
    h, owner = language_id.grams_of(words)
    assert np.bincount(owner, minlength=4).tolist() == [4 + 3 + 2, 0, 2 + 1, 9]
    assert sorted(h[owner == 0].tolist()) == sorted(h[owner == 3].tolist())
    assert len(set(h[owner == 0].tolist())) == 9
    assert language_id.grams_of([""])[0].size == 0


def test_false_positives_are_corrected():
    f = language_id.LanguageFilter(("a", "b"), np.zeros((8, 1), np.uint64), np.array([0.0, 0.5]), 0)
    best, _ = f.decide(np.array([[30, 60]]), np.array([100]))
    assert best[0] == 0  # 60 hits of a half-wrong filter are worth (60 - 50) / 50 = 20 %
