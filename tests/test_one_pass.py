"""Work that one task, or a second pass, must not repeat."""

from lumbre import queries_io as IO


def test_quoted_line_ends_are_written_by_ranges(spark, sf, monkeypatch):
    sizes, write = [], IO._csv

    def seen(df, label, files=None):
        sizes.extend(len(p) for p in df.rdd.glom().collect())
        return write(df, label, files)

    monkeypatch.setattr(IO, "_csv", seen)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = IO.csv_quoted_line_ends(spark, sf).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert len(rows) == sum(sizes) and max(sizes) < len(rows) / 2
    assert sum(r.texto == "uno\ndos" for r in rows) == 6
