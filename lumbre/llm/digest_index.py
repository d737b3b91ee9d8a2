"""Exact deduplication against a persistent digest index.

The index is a table with one row per distinct text: `digest` (32 bytes), `keep_id`, `group_size`, as of the batch that
brought the text. It is bucketed by `digest` and each file is sorted by it, so the anti-join of new data moves the new
digests alone, however large the index has grown; a bucket that has several files, one per batch, is sorted again as it
is read. Later copies of a known text are appended to a second table of the same form, `<name>_copies`, which gives the
size and the smallest id of a text over all batches. No row of either table is ever rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumbre.llm import _shared as S


def normalised(col):
    """Runs of white space become one space; null counts as the empty text."""
    return F.regexp_replace(F.coalesce(col, F.lit("")), S.SPACE, " ")


class DigestIndex:
    """Two bucketed tables in the session's warehouse; drop() deletes them.

    Nulls: a null text is the empty text; rows with a null id are counted, and a group with null ids only has a null
    keep_id. Repeated rows are copies of each other. An empty batch appends nothing. Extra columns are ignored.
    """

    def __init__(self, spark: SparkSession, name: str | None = None, buckets: int | None = None):
        self.spark, self.name = spark, name or f"digest_index_{uuid.uuid4().hex}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def exists(self) -> bool:
        return self.spark.catalog.tableExists(self.name)

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def copies(self) -> DataFrame:
        return self.spark.table(f"{self.name}_copies")

    def _append(self, groups: DataFrame, name: str) -> None:
        rows = groups.select("digest", "keep_id", "group_size").repartition(self.buckets, "digest")
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(name)

    @staticmethod
    def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, text_hash, digest) of every row."""
        return docs.select(F.col(id_col).alias("doc_id"), S.text_hash(F.col(text_col)).alias("text_hash"), F.unhex(F.sha2(normalised(F.col(text_col)), 256)).alias("digest"))

    def append_new(self, digests: DataFrame) -> DataFrame:
        """Adds the texts of the batch (doc_id, digest) that the index lacks. Returns the batch's groups, stored: digest, keep_id, group_size (both of the batch alone), fresh.

        Copies within the batch collapse in the map-side aggregate, so a digest that a third of the rows share moves
        one row per task. What is left meets the index in a sort-merge anti-join.
        """
        groups = S.store(digests.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "digest-groups")
        if not self.exists():
            for name in (self.name, f"{self.name}_copies"):
                self._append(groups.limit(0), name)
        known = self.table().select("digest").hint("merge")
        fresh = S.store(groups.hint("merge").join(known, "digest", "left_anti"), "digests-new")
        old = S.store(groups.hint("merge").join(known, "digest", "left_semi"), "digests-known")
        self._append(fresh, self.name)
        self._append(old, f"{self.name}_copies")
        return fresh.withColumn("fresh", F.lit(True)).unionByName(old.withColumn("fresh", F.lit(False)))

    def totals(self, digests: DataFrame) -> DataFrame:
        """(digest, keep_id, group_size) over all batches, of the distinct digests asked for."""
        later = self.copies().groupBy("digest").agg(F.min("keep_id").alias("later_id"), F.sum("group_size").alias("later_size"))
        both = digests.select("digest").hint("merge").join(self.table().hint("merge"), "digest").join(later.hint("merge"), "digest", "left")
        return both.select("digest", F.least("keep_id", "later_id").alias("keep_id"), (F.col("group_size") + F.coalesce("later_size", F.lit(0))).alias("group_size"))

    def drop(self) -> None:
        for name in (self.name, f"{self.name}_copies"):
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None, batches: int = 1) -> DataFrame:
    """One row per row of docs: doc_id, text_hash, keep_id, group_size, kept, text_sha256, over all that the index has seen.

    kept is true for the row with the smallest id of its text; of rows that repeat that id with that text, all are
    marked, as nothing tells them apart (`distinct_rows` returns one of them). Null ids are never kept unless
    the whole group has null ids. An empty table gives no rows; extra columns are ignored. docs are added in `batches`
    parts, dealt by the hash of their ids. Without an index, one is made and dropped again.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    rows = S.store(index.digests(docs, id_col, text_col), "digests")
    for k in range(batches):
        index.append_new(rows.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == k))
    asked = S.store(rows.groupBy("digest").agg(F.count(F.lit(1)).alias("here")), "digests-asked")
    totals = S.store(index.totals(asked).join(asked, "digest"), "digest-totals")
    if own:
        index.drop()
    out = S.lookup_skew_safe(rows, totals, "digest", "here", rows.count())
    return out.select("doc_id", "text_hash", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """One row of docs, all columns, per distinct text that the index did not have: that of the smallest id.

    Null texts count as empty; null ids come after all others; of rows that repeat id and text one is returned; an empty
    table gives no rows. Without an index, one is made and dropped again.
    """
    own = index is None
    index = index or DigestIndex(docs.sparkSession)
    rows = S.store(index.digests(docs, id_col, text_col), "digests")
    groups = index.append_new(rows)
    if own:
        index.drop()
    total = rows.count()
    kept = F.col("fresh") & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    marked = S.store(S.lookup_skew_safe(rows, groups, "digest", "group_size", total).select("doc_id", "text_hash", kept.alias("kept")), "marked")
    out = S.without_rows(docs, S.store(marked.filter("not kept").select("doc_id", "text_hash").distinct(), "copies"), id_col, text_col)
    if marked.filter("kept").count() > groups.filter("fresh").count():
        # Rows that repeat an id with its text (or null ids): only then is a shuffle of texts needed.
        out = out.withColumn("_digest", F.sha2(normalised(F.col(text_col)), 256)).dropDuplicates([id_col, "_digest"]).drop("_digest")
    return out


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
"""
