"""Registered queries against their check SQL on the smallest data set."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
CHECKED = (
    "vector_topk", "tag_vote", "semantic_retrieve", "session_promotion", "procedural_retrieve", "messages_to_steps", "chunk_text", "parse_facts",
    "tag_upsert", "consolidate_greedy", "cost_curve", "em_f1", "session_timeline", "topology_budget",
)
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="supplied tables not present")


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)
    return repr(v)


def _rows(table):
    names = sorted(table.column_names)
    return names, sorted(tuple(_plain(r[n]) for n in names) for r in table.to_pylist())


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_its_sql(spark, engine, name):
    got = entry.queries()[name](spark, FOLDER).toArrow()
    assert _rows(got) == _rows(engine.sql(entry.oracle_sql()[name]).to_arrow_table())


def test_every_check_sql_binds(engine):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    for name, sql in entry.oracle_sql().items():
        engine.execute("explain " + sql)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
