"""op1, op2 and op3 against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lumbre.llm import queries as Q
from lumbre.llm import rans, token_counts, token_store, trie_bpe, unit_encoder


@pytest.fixture(scope="module")
def bytes_tokenizer():
    return Tokenizer.from_file(unit_encoder.default_path())


@pytest.fixture(scope="module")
def words_tokenizer():
    return Tokenizer.from_file(trie_bpe.default_path())


def expected_tokens(rows, tokenizer):
    """(doc_id, start, n, crc) in order of id, null first, then text."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_op1_equals_library(spark, sf, documents, bytes_tokenizer):
    want = expected_tokens([(r.doc_id, r.text) for r in documents.collect()], bytes_tokenizer)
    got = sorted(tuple(r) for r in Q.op1_token_output(spark, sf).collect())
    assert got == want


def test_op1_odd_rows_and_long_documents_in_small_blocks(odd, odd_rows, bytes_tokenizer):
    want = expected_tokens([r[:2] for r in odd_rows], bytes_tokenizer)
    got = [tuple(r) for r in token_store.token_output(odd, block_tokens=500).orderBy("start").collect()]
    assert got == want


def test_op1_empty(empty):
    assert token_store.token_output(empty).collect() == []


def test_op1_checkpoints_and_checksums(odd):
    store = token_store.write_tokens(odd, block_tokens=1 << 19)
    freq, bits = store.table()
    table = rans.table(freq, bits)
    assert int(freq.sum()) == 1 << bits
    for row in store.blocks().collect():
        marks = [m.asDict() for m in row["marks"]]
        whole = token_store.read_block(row["words"], marks, row["n_tokens"], table)
        ends = np.cumsum(row["sizes"])
        own = [zlib.crc32(whole[e - s : e].astype("<u4").tobytes()) for s, e in zip(row["sizes"], ends)]
        assert zlib.crc32(np.array(own, "<u4").tobytes()) == row["crc32"]
        for first in {0, row["n_tokens"] // 2, row["n_tokens"] - 1}:
            last = min(first + 10, row["n_tokens"])
            assert token_store.read_block(row["words"], marks, row["n_tokens"], table, first, last).tolist() == whole[first:last].tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), max_size=300), st.integers(1, 4), st.integers(6, 20))
def test_rans_round_trip(symbols, repeat, bits):
    ids = np.array(symbols * repeat * 9, np.uint32)
    t = rans.table(rans.scaled(np.bincount(ids, minlength=41), bits), bits)
    words, marks = rans.encode(ids, t, 1)
    for row, word, states in marks:
        assert rans.decode(words.astype(np.uint64), t, len(ids), states, row, word).tolist() == ids[row * rans.LANES :].tolist()


def test_rans_approaches_entropy():
    rng = np.random.default_rng(1)
    ids = rng.choice(50, 200_000, p=(p := rng.dirichlet(np.ones(50)))).astype(np.uint32)
    t = rans.table(rans.scaled(np.bincount(ids, minlength=50), 16), 16)
    words, _ = rans.encode(ids, t, 10**6)
    assert 32 * len(words) < 1.02 * len(ids) * -(p * np.log2(p)).sum()


TEXT = st.text(st.one_of(st.sampled_from(list("abe 't.,\n\t12éñ")), st.characters(exclude_categories=["Cs"])), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_units_equal_library(texts):
    enc = unit_encoder.encoder(unit_encoder.default_path())
    flat, sizes = enc.encode(pa.array(texts, pa.string()))
    want = [enc.library.encode(t, add_special_tokens=False).ids for t in texts]
    assert flat.tolist() == [i for ids in want for i in ids]
    assert sizes.tolist() == [len(ids) for ids in want]


def test_units_beyond_the_memory():
    enc = unit_encoder.UnitEncoder(unit_encoder.default_path(), cache_units=3)
    for text in ("one two three four five six", "six seven  eight", "one nine"):
        assert enc.encode(pa.array([text]))[0].tolist() == enc.library.encode(text, add_special_tokens=False).ids
    assert len(enc.index) <= 6


def expected_bpe(text, tokenizer):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(decoded), ids, decoded


def test_op1_rows_of_one_id_are_many_tasks(spark):
    """A third of the rows have one id, and most of those one text: ranges end among them, and the order holds."""
    rows = [(7, "hot row" if i % 4 else f"hot {i}") for i in range(900)] + [(i, f"row {i}") for i in range(1000, 2800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    store = token_store.write_tokens(docs, block_tokens=200)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = store.blocks().filter("array_contains(doc_ids, 7)").select("part").distinct().count()
    assert parts > 1
    got = store.documents().orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted(i for i, _ in rows)
    ends = [r.start + r.n_tokens for r in got]
    assert [r.start for r in got] == [0, *ends[:-1]]


def test_op2_equals_library(spark, sf, documents, words_tokenizer):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = Q.op2_bpe_trie(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected_bpe(texts[r.doc_id], words_tokenizer)[:3]


def test_op2_odd_rows(odd, odd_rows, words_tokenizer):
    got = sorted((tuple(r)[:4], r.ids, r.decoded) for r in trie_bpe.encode_decode(odd, full=True).filter("doc_id is not null").collect())
    want = []
    for i, text, *_ in odd_rows:
        if i is not None:
            n, a, b, ids, decoded = expected_bpe(text, words_tokenizer)
            want.append(((i, n, a, b), ids, decoded))
    assert got == sorted(want)
    assert trie_bpe.encode_decode(odd).count() == len(odd_rows)


def test_op2_empty(empty):
    assert trie_bpe.encode_decode(empty).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.one_of(TEXT, st.text(st.sampled_from("abcin'é "), max_size=80)))
def test_trie_equals_library(text):
    bpe = trie_bpe.coder(trie_bpe.default_path())
    tokenizer = _words()
    ids = tokenizer.encode(text, add_special_tokens=False).ids
    joined, decoded, n, got = bpe.batch([text], True)
    assert (got.to_pylist(), n.tolist()) == ([ids], [len(ids)])
    assert (joined.to_pylist(), decoded.to_pylist()) == ([" ".join(map(str, ids))], [tokenizer.decode(ids, skip_special_tokens=False)])


def test_trie_equals_library_at_every_code_point():
    """Classes, lower case, composition and white space are the library's, alone, in a word, doubled, beside digits and marks."""
    bpe, tokenizer = trie_bpe.coder(trie_bpe.default_path()), _words()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    shapes = (":{0}", "a{0}B", "{0}{0}", "1{0}'s", "\u0301{0}\u0301")
    for texts in (["".join(c) for c in zip(points, "a" * len(points))], [s.format(c) for s in shapes for c in points[:0x3000]]):
        for i in range(0, len(texts), 50_000):
            part = texts[i : i + 50_000]
            want = [e.ids for e in tokenizer.encode_batch_fast(part, add_special_tokens=False)]
            got = bpe.batch(part, True)[3].to_pylist()
            assert [(t, g) for t, g, w in zip(part, got, want) if g != w] == []


def test_trie_special_tokens():
    bpe, tokenizer = trie_bpe.coder(trie_bpe.default_path()), _words()
    texts = ["<|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>\n", "", None, "<|no|> x", "É<|endoftext|>ΟΔΟΣ Σ", " <|endoftext|> "]
    assert bpe.batch(texts, True)[3].to_pylist() == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


_CACHE = []


def _words():
    if not _CACHE:
        _CACHE.append(Tokenizer.from_file(trie_bpe.default_path()))
    return _CACHE[0]


def test_op3_equals_brute_force(spark, sf, documents, bytes_tokenizer):
    sizes = sorted(len(bytes_tokenizer.encode(r.text, add_special_tokens=False).ids) for r in documents.collect())
    got = Q.op3_token_counts(spark, sf).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.docs) for r in got] == sorted((n, sizes.count(n)) for n in set(sizes))
    for r in got:
        longer = [n for n in sizes if n >= r.n_tokens]
        assert (r.docs_at_least, r.tokens_at_least) == (len(longer), sum(longer))
        assert r.truncated_tokens == sum(min(n, r.n_tokens) for n in sizes)
        assert (r.rank_from, r.rank_to) == (sizes.index(r.n_tokens) + 1, len(sizes) - sizes[::-1].index(r.n_tokens))


def test_op3_answers(odd, odd_rows, bytes_tokenizer):
    sizes = sorted(len(bytes_tokenizer.encode(r[1] or "", add_special_tokens=False).ids) for r in odd_rows)
    report = token_counts.token_counts(odd).cache()
    limits, quantiles = token_counts.answer(report, [0, 3, 10, 10**6], [0.0, 0.25, 0.5, 1.0])
    for limit, a in limits.items():
        assert a == {"docs_over": sum(n > limit for n in sizes), "tokens_kept": sum(min(n, limit) for n in sizes)}
    assert [quantiles[q] for q in (0.25, 0.5, 1.0)] == [sizes[max(1, -(-int(q * len(sizes) * 4) // 4)) - 1] for q in (0.25, 0.5, 1.0)]


def test_op3_empty(empty):
    assert token_counts.token_counts(empty).collect() == []
