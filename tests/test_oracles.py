"""Some registered queries against their SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = ["q_childof", "q_subtree_all", "q_supertree", "q_childof_nested", "q_linked_k2", "q_deref", "v_number", "v_date", "v_duration", "v_deref", "v_link_field", "v_link_hops", "v_parent", "v_childof", "v_not", "v_linksto", "v_sections", "live_upsert_delete", "da_expand_all", "da_paged", "p2_found"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "vault_pages", "page_fields", "page_links", "canvases", "vault_files"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, tables, name):
    rows = entry.queries()[name](spark, SF)
    found = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in found.description]
    assert sorted(rows.columns) == sorted(columns)
    text = lambda r: tuple("" if v is None else str(v) for v in r)
    assert sorted(map(text, rows.select(*columns).collect())) == sorted(map(text, found.fetchall()))


def test_every_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) > 120
