"""Registered queries against their SQL on the smallest driver tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")

import __spark_entry__ as entry  # noqa: E402

NAMES = [
    "lang_score", "phi_extract", "phi_redact", "span_fusion", "sentences", "dictionary_tags", "negation_scope", "temporal_warnings",
    "numeric_findings", "match_cascade", "vector_link", "best_per_concept", "disease_ranking", "note_prf", "patient_documents",
    "dossier_match", "stream_redaction",
]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _plain(v):
    if isinstance(v, float):
        return round(v, 4)
    if isinstance(v, (int, str, bool)) or v is None:
        return v
    return float(v) if not math.isnan(float(v)) else None


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    got = sorted((tuple(_plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    want = sorted((tuple(_plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=repr)
    assert got == want
