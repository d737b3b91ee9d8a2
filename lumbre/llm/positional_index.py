"""Benchmark decontamination with a positional inverted index. DataFrame operations only.

Index: `postings` (term, doc_id, text_hash, pos, is_doc), one row per occurrence of a test term in the training texts, sorted
by term within its files and written once. It is partitioned by document, so that building it needs no shuffle, and the
hottest term is spread over all files. A posting with is_doc stands for the document itself; its pos is the number of
words. A term is the 64-bit hash of its word; were two words to share one, the comparison at the end tells them apart.

Search: the postings give each test term's frequency. Every window of an item names its two rarest terms (their places
are the item's anchors; neighbouring windows mostly share them). An anchor's posting list, adjusted by its offset,
proposes alignments (document, item, shift); an alignment stays if the adjusted lists of both anchors of some window
meet in it. The few that stay are compared with the words of the text, which gives the exact intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumbre.llm import _shared as S

#: A word: digits, a-z after lower-casing, and everything outside ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10


def words_of(text):
    return F.regexp_extract_all(S.ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


@dataclass
class PositionalIndex:
    """postings as above; terms (term, word)."""

    postings: DataFrame
    terms: DataFrame

    def documents(self) -> DataFrame:
        return self.postings.filter("is_doc").select("doc_id", "text_hash", F.col("pos").alias("n_words"))


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item_id, words) of items that have words; key tells rows apart that repeat an id."""
    return S.store(items.select(F.monotonically_increasing_id().alias("key"), F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).filter(F.size("words") > 0), "items")


def build_index(docs: DataFrame, vocabulary: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> PositionalIndex:
    """vocabulary: the distinct test terms, column `word`. Words outside it can't be part of a match and get no posting."""
    terms = S.store(vocabulary.select("word").distinct().select(F.xxhash64("word").alias("term"), "word"), "terms")
    parsed = docs.select(F.col(id_col).alias("doc_id"), S.text_hash(F.col(text_col)).alias("text_hash"), words_of(F.col(text_col)).alias("words"))
    # The empty word, which no text has, leads every array: its posting is the document's own row.
    spread = parsed.select("doc_id", "text_hash", F.size("words").alias("n_words"), F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("place", "word"))
    known = S.store(terms.unionByName(docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit("").alias("word"))), "terms-known")
    found = S.lookup_small(spread, known, "word", "text_hash")
    postings = found.select("term", "doc_id", "text_hash", F.when(F.col("word") == "", F.col("n_words")).otherwise(F.col("place") - 1).alias("pos"), (F.col("word") == "").alias("is_doc"))
    return PositionalIndex(S.store(postings.sortWithinPartitions("term"), "postings"), terms)


def _anchors(index: PositionalIndex, items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(anchors: key, term, at; windows: key, first, second), where first and second are the places of a window's two rarest terms."""
    counts = index.postings.filter("not is_doc").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    # A word of the items that no document has gets 0: windows with it can't occur.
    ranked = index.terms.join(counts, "term", "left").select("term", "word", F.coalesce("df", F.lit(0)).alias("df"))
    places = items.select("key", F.size("words").alias("n"), F.posexplode("words").alias("at", "word")).join(ranked, "word")
    packed = places.groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("at", "df", "term"))).alias("w"))
    length = F.least(F.col("n"), F.lit(window))
    starts = packed.select("key", "w", length.alias("len"), F.explode(F.sequence(F.lit(0), F.col("n") - length)).alias("start"))
    part = F.array_sort(F.transform(F.slice("w", F.col("start") + 1, F.col("len")), lambda x: F.struct(x["df"].alias("df"), x["at"].alias("at"), x["term"].alias("term"))))
    # The second anchor: the rarest place with another term; a window that repeats one word has the first twice.
    best = starts.select("key", part.alias("p"))
    other = F.filter("p", lambda x: x["term"] != F.col("p")[0]["term"])
    picked = best.select("key", F.col("p")[0].alias("one"), F.when(F.size(other) > 0, F.get(other, F.lit(0))).otherwise(F.col("p")[0]).alias("two")).filter("one.df > 0")
    picked = S.store(picked.distinct(), "windows")
    windows = picked.select("key", F.col("one.at").alias("first"), F.col("two.at").alias("second")).distinct()
    anchors = picked.select("key", F.explode(F.array("one", "two")).alias("x")).select("key", F.col("x.term").alias("term"), F.col("x.at").alias("at")).distinct()
    return S.store(anchors, "anchors"), windows


def alignments(index: PositionalIndex, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, text_hash, key, n, shift): where the adjusted posting lists of some window's two rarest terms meet. shift is the document's place of the item's first word and may lie outside it; n is the number of the item's words."""
    anchors, windows = _anchors(index, items, window)
    lists = S.lookup_small(index.postings.filter("not is_doc"), anchors, "term", "text_hash")
    met = lists.groupBy("doc_id", "text_hash", "key", (F.col("pos") - F.col("at")).alias("shift")).agg(F.collect_set("at").alias("places"))
    pairs = windows.groupBy("key").agg(F.collect_list(F.struct("first", "second")).alias("pairs"))
    pairs = S.store(pairs.join(items.select("key", F.size("words").alias("n")), "key"), "window-pairs")
    both = F.exists("pairs", lambda p: F.array_contains(F.col("places"), p["first"]) & F.array_contains(F.col("places"), p["second"]))
    return S.lookup_small(met, pairs, "key", "text_hash").filter(both).select("doc_id", "text_hash", "key", "n", "shift")


def _intervals(equal, window, n):
    """Places (from, to) of runs of true in the array `equal` that hold a whole window."""
    need = F.least(window, n)
    run = F.aggregate(
        F.concat(equal, F.array(F.lit(False))),
        F.struct(F.lit(0).alias("i"), F.lit(0).alias("run"), F.expr("cast(array() as array<struct<a:int,b:int>>)").alias("out")),
        lambda s, e: F.struct(
            (s["i"] + 1).alias("i"),
            F.when(e, s["run"] + 1).otherwise(0).alias("run"),
            F.when(~e & (s["run"] >= need), F.concat(s["out"], F.array(F.struct((s["i"] - s["run"]).alias("a"), s["i"].alias("b"))))).otherwise(s["out"]).alias("out"),
        ),
    )
    return run["out"]


def phrase_matches(docs: DataFrame, index: PositionalIndex, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, item_id, a, b): maximal runs [a, b) of document words that equal consecutive item words and hold a whole window."""
    found = S.store(alignments(index, items, window).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("key", "n", "shift")).alias("at")), "alignments")
    own = docs.select(F.col(id_col).alias("d_id"), S.text_hash(F.col(text_col)).alias("d_hash"), F.col(text_col).alias("d_text"))
    few = S.few_or_merge(found)
    hit = own.join(few, F.col("d_id").eqNullSafe(F.col("doc_id")) & (F.col("d_hash") == F.col("text_hash"))).select("doc_id", "text_hash", "at", words_of(F.col("d_text")).alias("words")).dropDuplicates(["doc_id", "text_hash"])
    # An alignment takes the document's words from shift to shift + n with it, not the whole text.
    part = lambda x: F.slice("words", F.greatest(x["shift"], F.lit(0)) + 1, F.greatest(x["n"] + F.least(x["shift"], F.lit(0)), F.lit(0)))
    each = hit.select("doc_id", "text_hash", F.explode(F.transform("at", lambda x: F.struct(x["key"].alias("key"), x["shift"].alias("shift"), part(x).alias("part")))).alias("x")).select("doc_id", "text_hash", "x.key", "x.shift", "x.part")
    asked = items.select("key", "item_id", F.col("words").alias("asked"))
    joined = S.lookup_small(each, asked, "key", "text_hash")
    place = lambda k: k + F.least(F.col("shift"), F.lit(0))
    equal = F.transform("asked", lambda w, k: F.coalesce(F.when(place(k) >= 0, F.get(F.col("part"), place(k)) == w), F.lit(False)))
    runs = joined.select("doc_id", "text_hash", "item_id", "shift", F.explode(_intervals(equal, F.lit(window), F.size("asked"))).alias("r"))
    return runs.select("doc_id", "text_hash", "item_id", (F.col("shift") + F.col("r.a")).alias("a"), (F.col("shift") + F.col("r.b")).alias("b"))


def proximity_matches(index: PositionalIndex, queries: DataFrame, within: int) -> DataFrame:
    """(query_id, doc_id, text_hash, pos): places of a query's rarest word from which each of its other words lies at most `within` words away.

    queries: (query_id, words); words that repeat count once, one without words matches nothing, and a word that the
    index lacks can't be found. Null ids of documents are carried, empty tables give no rows, extra columns are ignored.
    The lists meet in buckets of `within` places, so no list is paired with a whole other.
    """
    width = max(1, within)
    asked = queries.select("query_id", F.explode(F.array_distinct("words")).alias("word"))
    counts = index.postings.filter("not is_doc").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    ranked = asked.join(index.terms, "word", "left").join(counts, "term", "left").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("df", F.lit(0)), "word")))
    ranked = S.store(ranked, "proximity-terms")
    size = ranked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
    lists = index.postings.filter("not is_doc").select("term", "doc_id", "text_hash", "pos", F.floor(F.col("pos") / width).alias("cell"))
    base = lists.join(ranked.filter("rank = 1").select("term", "query_id"), "term").drop("term")
    near = lists.join(ranked.filter("rank > 1").select("term", "query_id", "rank"), "term")
    probes = base.select("query_id", "doc_id", "text_hash", F.col("pos").alias("base"), F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    met = probes.join(near, (probes["query_id"] == near["query_id"]) & probes["doc_id"].eqNullSafe(near["doc_id"]) & (probes["text_hash"] == near["text_hash"]) & (probes["cell"] == near["cell"]))
    met = met.filter(F.abs(F.col("base") - F.col("pos")) <= within).select(probes["query_id"], probes["doc_id"], probes["text_hash"], "base", "rank")
    full = met.unionByName(base.select("query_id", "doc_id", "text_hash", F.col("pos").alias("base"), F.lit(1).alias("rank")))
    return full.groupBy("query_id", "doc_id", "text_hash", "base").agg(F.count_distinct("rank").alias("k")).join(size, "query_id").filter("k = n_terms").select("query_id", "doc_id", "text_hash", F.col("base").alias("pos"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; items without words never occur; an item id that repeats counts
    once. Rows that repeat id and text get the same figures each. Null ids are carried. Extra columns are ignored.
    """
    items = item_words(benchmark, item_col, item_text_col)
    vocabulary = items.select(F.explode("words").alias("word")).distinct()
    index = build_index(docs, vocabulary, id_col, text_col)
    runs = phrase_matches(docs, index, items, window, id_col, text_col)
    # Words covered by the union of the runs: in order of their starts, each adds what lies beyond the furthest end so far.
    reach = F.aggregate(
        F.array_sort("runs"),
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda s, r: F.struct(F.greatest(s["end"], r["b"]).alias("end"), (s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(s["end"], r["a"]))).alias("n")),
    )["n"]
    per_doc = runs.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("a", "b")).alias("runs"), F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    hits = S.store(per_doc.select(F.col("doc_id").alias("h_id"), F.col("text_hash").alias("h_hash"), reach.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.concat_ws(",", "items").alias("items")), "hits")
    own = index.documents()
    out = own.join(S.few_or_merge(hits), own["doc_id"].eqNullSafe(F.col("h_id")) & (own["text_hash"] == F.col("h_hash")), "left")
    return out.select(
        "doc_id", "text_hash", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0).cast("long")) > 0).alias("contaminated"),
    )


def clean_rows(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, **columns: str) -> DataFrame:
    """The rows of docs, all columns, that hold no window of an item. Nulls, empty texts, items without words, repeated rows and null ids as for contamination: null and empty texts stay; an empty table gives no rows."""
    found = S.store(contamination(docs, benchmark, window, **columns).filter("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    return S.without_rows(docs, found, columns.get("id_col", "doc_id"), columns.get("text_col", "text"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT item_id, w, least(len(w), 10) AS k, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)
), grams AS (
  SELECT doc_id, s, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)
), hit AS (
  SELECT doc_id, s, g.k, item_id FROM grams g JOIN win USING (k, phrase)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""
