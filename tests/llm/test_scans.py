"""op5 and op6 against brute force and SQL."""

import hashlib
import re

import pytest
from oracle import check, connection
from pyspark.sql import functions as F

from lumbre.llm import license_digest, positional_index, queries


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(positional_index.WORD, low)


def brute(rows, items, k=10):
    out = []
    for i, text in rows:
        w, hit, found = words(text), set(), set()
        for item, t in items:
            q = words(t)
            n = min(k, len(q))
            for s in range(len(q) - n + 1) if q else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == q[s : s + n]:
                        hit.update(range(p, p + n))
                        found.add(str(item))
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_op5_equals_sql(spark, sf):
    assert check(queries.op5_decontamination(spark, sf), connection(sf), queries.oracle_sql()["op5_decontamination"]) == 200


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (10, "la la la la la la la la la la la la"), (3, None), (4, "..."), (5, "ÑANDÚ"), (2, "again short"), (6, "one two three four five six seven eight nine ten")]
TEXTS = [
    (1, "x one two, three four five six seven eight nine ten eleven twelve y"),
    (2, "one two three four five six seven eight nine TEN"),
    (3, "one two three four five six seven eight nine"),
    (4, "la " * 30),
    (5, "short item again short item"),
    (6, "short, item"),
    (7, "ñandÚ"),
    (8, "ÑANDÚ"),
    (9, None),
    (10, ""),
    (None, "a short item"),
    (11, "two three four five six seven eight nine ten eleven"),
    (11, "two three four five six seven eight nine ten eleven"),
    (11, "short item"),
    (12, "one two three four five six seven eight nine ten " * 3),
    (13, "filler " * 5000 + "short item"),
]


@pytest.mark.parametrize("window", [10, 3])
def test_op5_odd_rows(spark, window):
    docs = spark.createDataFrame([(*r, 0, "x", 1) for r in TEXTS], "doc_id long, text string, pos int, term string, key int")
    items = spark.createDataFrame([(*r, 0) for r in ITEMS], "item_id long, text string, key int")
    got = positional_index.contamination(docs, items, window).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=repr) == brute(TEXTS, ITEMS, window)


def test_op5_clean_rows_and_empty_tables(spark, odd, odd_rows, empty):
    items = spark.createDataFrame([(1, "hello world hello")], "item_id long, text string")
    left = positional_index.clean_rows(odd, items)
    assert left.columns == odd.columns and left.count() == len(odd_rows) - 1
    none = spark.createDataFrame([], "item_id long, text string")
    assert positional_index.clean_rows(odd, none).count() == len(odd_rows)
    assert positional_index.contamination(empty, items).collect() == []


def test_op5_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(positional_index.S, "MAX_BROADCAST_ROWS", -1)
    docs, items = spark.createDataFrame(TEXTS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = positional_index.contamination(docs, items).drop("text_hash").collect()
    assert sorted(map(tuple, got), key=repr) == brute(TEXTS, ITEMS)


def test_op5_proximity(spark):
    docs = spark.createDataFrame([(1, "a x b x c"), (2, "a b c"), (3, "c b a"), (4, "a " + "x " * 20 + "b c"), (5, "b c")], "doc_id long, text string")
    queries_ = spark.createDataFrame([(7, ["a", "b"]), (8, ["c", "zzz"])], "query_id long, words array<string>")
    vocabulary = queries_.select(F.explode("words").alias("word")).distinct()
    index = positional_index.build_index(docs, vocabulary)
    got = positional_index.proximity_matches(index, queries_, 2).select("query_id", "doc_id").distinct().collect()
    assert sorted(map(tuple, got)) == [(7, 1), (7, 2), (7, 3)]


def test_op6_equals_sql(spark, sf):
    assert check(queries.op6_license_digest(spark, sf), connection(sf), queries.oracle_sql()["op6_license_digest"]) == 200


def test_op6_finds_licenses_whatever_their_form(spark):
    by_id = dict(license_digest.LICENSES)
    mit, bsd = by_id["MIT"], by_id["BSD-3-Clause"]
    rows = [
        (1, mit),
        (2, "MIT LICENSE\n\nCopyright (c) 2020 Someone\n" + mit[len("MIT License") :].upper()),
        (3, "/* " + mit.replace("\n", "\n * ") + " */"),
        (4, bsd.replace('"AS IS"', "``AS IS''").replace(",", " ,")),
        (5, mit + " And one more word."),
        (6, None),
        (7, ""),
        (8, "Copyright 2020 me\nAll rights reserved."),
        (None, by_id["ISC"]),
        (9, by_id["Zlib"].replace("acknowledgment", "acknowledgement")),
        (9, by_id["Zlib"]),
    ]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, license_id string")
    got = {}
    for r in license_digest.license_scan(docs).collect():
        got.setdefault(r.doc_id, []).append(r.license_id)
    assert got == {1: ["MIT"], 2: ["MIT"], 3: ["MIT"], 4: ["BSD-3-Clause"], 5: [None], 6: [None], 7: [None], 8: [None], None: ["ISC"], 9: ["Zlib", "Zlib"]}


def test_op6_own_licenses_and_empty(spark, odd, odd_rows, empty):
    mine = spark.createDataFrame([("b", "Hello, WORLD! hello"), ("a", "hello world hello"), ("e", "")], "license_id string, text string")
    got = {r.doc_id: r.license_id for r in license_digest.license_scan(odd, mine).collect()}
    assert got[1] == "a" and got[3] is None
    assert license_digest.license_scan(odd).count() == len(odd_rows)
    assert license_digest.license_scan(empty).collect() == []


def test_op5_and_op6_run_no_python(spark, sf):
    for name in ("op5_decontamination", "op6_license_digest"):
        plan = queries.queries()[name](spark, sf)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|InArrow", plan)
