"""op6: licences as their files wrap them."""

import re
import textwrap

import pytest

from lumbre.llm import license_digest


@pytest.mark.parametrize("width", [60, 70, 74, 78, 80])
@pytest.mark.parametrize("mark", ["", " * ", "# "])
def test_wrapped_licences_are_found(spark, width, mark):
    rows = []
    for name, text in license_digest.LICENSES:
        body = "\n\n".join(textwrap.fill(" ".join(part.split()), width, break_long_words=False, break_on_hyphens=False) for part in text.split("\n\n"))
        rows.append((name, textwrap.indent("Copyright (c) 2020 Some Body\nCopyright 2021, Other\nCopyright The Authors\n\n" + body, mark, lambda _: True)))
    got = license_digest.license_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert {r.doc_id: r.license_id for r in got} == {name: name for name, _ in license_digest.LICENSES}


def test_isc_breaks_before_copyright_notice(spark):
    text = dict(license_digest.LICENSES)["ISC"].replace("above copyright notice", "above\ncopyright notice")
    assert license_digest.license_scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first().license_id == "ISC"


def test_repeated_variants_have_one_digest(spark):
    rows = [(1, "the licence licence here"), (2, "the license license here"), (3, "The LICENCE, license licence-here"), (4, "whilst whilst whilst")]
    got = {r.doc_id: r.canonical_sha256 for r in license_digest.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[3] != got[1] and got[4] != got[1]


def test_planted_licenses_are_found_by_the_query_and_its_sql(spark, tmp_path):
    """Every known license among other documents, in capitals, with a copyright line and British spelling."""
    import duckdb

    rows = [(i, "Copyright (c) 2020 Someone\n\n" + re.sub(r"\bLICENSE\b", "LICENCE", text.upper()), name) for i, (name, text) in enumerate(license_digest.LICENSES)]
    rows += [(100 + i, text + " and more", None) for i, (_, text) in enumerate(license_digest.LICENSES)] + [(200, None, None), (201, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, want string")
    docs.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.canonical_sha256, r.license_id) for r in license_digest.license_scan(docs).collect()}
    assert {i: x[1] for i, x in got.items()} == {i: want for i, _, want in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: r[1:] for r in con.execute(license_digest.oracle()).fetchall()} == got
