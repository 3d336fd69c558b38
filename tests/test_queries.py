"""The registered queries against their SQL on the smallest tables."""

import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry_module  # noqa: E402
from workload import queries as library  # noqa: E402
from workload.oracles import ORACLES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = entry_module.queries(), entry_module.oracle_sql()
# a share of the queries, one per module; the driver compares all
CHECKED = (
    "syslog_parse", "cef_parse", "leef_parse", "json_parse", "windows_parse", "filter_limit",
    "peak_distinct", "brute_force", "password_spray", "priv_esc", "allowlist_events", "geo_enrich",
    "correlate_reference", "report_timeline", "stream_logins", "files_load", "files_csv", "stream_late",
)


def test_every_query_has_sql():
    assert set(library.QUERIES) == set(ORACLES)
    assert set(library.QUERIES) <= set(QUERIES) and set(ORACLES) <= set(SQL)
    assert not [q for q in library.QUERIES if re.match(r"op\d|pipeline|llm", q)]


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{FOLDER}/{file}'")
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    cur = con.execute(SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(r[i] for i in at) for r in cur.fetchall()), key=repr)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="driver tables are not here")
def test_entry(spark):
    df = entry_module.entry(spark)
    assert df.count() > 0 and "burst_count" in df.columns
