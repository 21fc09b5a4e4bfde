"""Queries beside their SQL where documents are empty, blank or null, or have no tenant."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()
ODD = {
    "empty": [("", "src1"), ("", "src1"), ("  \n", "src2"), ("", "only_empty"), ("null", "src3")],
    "null": [(None, "src1"), (None, "only_null"), ("Some text. And more. Yet more.", None)],
}


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """The smallest tables with odd documents added, one folder and database per kind."""
    made = {}
    for kind, rows in ODD.items():
        folder, con = tmp_path_factory.mktemp(kind), duckdb.connect()
        for f in glob.glob(os.path.join(SF, "*.parquet")):
            name = os.path.basename(f)
            if name != "documents.parquet":
                os.symlink(f, folder / name)
                con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{f}'")
        con.execute(f"CREATE TABLE documents AS SELECT * FROM '{SF}/documents.parquet'")
        con.executemany("INSERT INTO documents VALUES (?, ?, 'en', ?, ?)", [(10**7 + i, t, s, len(t or "")) for i, (t, s) in enumerate(rows)])
        con.execute(f"COPY documents TO '{folder}/documents.parquet'")
        made[kind] = str(folder), con
    return made


@pytest.mark.parametrize("kind", sorted(ODD))
@pytest.mark.parametrize("name", ["kno_09_belief_type", "kno_12_index_records", "val_02_persona_issues"])
def test_query_on_odd_documents(spark, odd, kind, name):
    folder, con = odd[kind]
    found = QUERIES[name](spark, folder)
    want = con.sql(f"SELECT {', '.join(found.columns)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))
