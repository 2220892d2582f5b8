"""Every query of the reference's operators against its SQL, over whole small tables."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from compare import assert_same, connect

from millrace.plans import catalogue, flows, intake

QUERIES, SQL = catalogue.QUERIES | intake.QUERIES | flows.QUERIES, catalogue.SQL | intake.SQL | flows.SQL
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, tables, name):
    assert_same(QUERIES[name](spark, SF), SQL[name], tables)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


A = "abcdefghijkl"
#: Ids, texts and sources. A stored text has an even id, a batch's an odd one or one that ends in 0.
ODD_DOCUMENTS = [
    (1, "", "a"), (3, "\t", "a"), (5, None, "a"), (None, "no id", "a"),  # an empty text that nothing is stored for
    (2, " " * 14, "a"), (7, " " * 12 + "apply now", "b"), (4, "\t" * 12, "a"), (9, "\t" * 12 + "a", "b"),  # a text that does not inform is no richer than a blank one
    (11, "unknown source", None), (20, "its own row", None), (6, f"{A} b", None), (13, f"{A} more", "b"), (8, f"z{A} b", "a"), (15, f"z{A} more", None), (12, f"y{A}", None), (17, f"y{A}", None),
    (19, "İstanbul İ", "a"), (14, "ΟΔΟΣ ΟΔΟΣ ΟΔ", "a"), (21, "οδοσ οδοσ οδ more", "b"),  # openings that are equal letter by letter
    (22, f"x{A} \xa0　", "a"), (23, f"x{A} a", "b"), (24, f"w{A} \x0b\x0b", "a"), (25, f"w{A} a", "b"), (26, f"v{A} İİ", "a"), (27, f"v{A} abc", "b"), (28, f"u{A} http://x\x0bxx", "a"), (29, f"u{A} a", "b"),
]


def _odd(spark, folder, rows):
    made = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    pq.write_table(made.toArrow(), f"{folder}/documents.parquet")
    return str(folder)


@pytest.mark.parametrize("name", ["ingest_reconcile", "informative_length"])
def test_odd_documents_match_sql(spark, tmp_path, name):
    folder = _odd(spark, tmp_path, ODD_DOCUMENTS)
    assert_same(QUERIES[name](spark, folder), SQL[name], connect(folder))


def test_openings_match_sql(spark, tmp_path):
    folder = _odd(spark, tmp_path, [r for r in ODD_DOCUMENTS if all(r)])
    assert_same(QUERIES["ingest_merge"](spark, folder), SQL["ingest_merge"], connect(folder))
