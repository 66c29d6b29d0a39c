"""Queries over whole tables whose SQL would be too dear, against plain loops."""

import duckdb

from quadrille.plans import catalog
from quadrille.plans.panel_queries import panel
from test_queries import SF, rows


def test_no_query_reads_a_part_of_its_table():
    assert not [n for n, s in catalog.ORACLE_SQL.items() if "FROM events WHERE event_id %" in s or "FROM orders WHERE o_custkey %" in s]


def test_simulation_of_all_bins(spark):
    series = {}
    for r in panel(spark, SF).select("region_id", "ts", "pickups", "dropoffs").orderBy("ts").collect():
        series.setdefault(r.region_id, []).append((r.pickups, r.dropoffs))
    got = {r.region_id: r for r in catalog.QUERIES["simulate_no_moves"](spark, SF).collect()}
    assert set(got) == set(series)
    for name, steps in series.items():
        inv, served, unserved, over = 10, 0, 0, 0
        for p, q in steps:
            out = min(p, inv)
            into = min(q, 20 - inv + out)
            inv, served, unserved, over = inv - out + into, served + out, unserved + p - out, over + q - into
        assert (got[name].end_inventory, got[name].served, got[name].unserved, got[name].overflow) == (inv, served, unserved, over)


def test_nearby_events_on_more_rows(spark):
    sf = "/root/testdata/sf0.01"  # the smallest table has no event that runs then
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{sf}/events.parquet'")
    want = rows(con.sql(catalog.ORACLE_SQL["nearby_events"]).df())
    assert want and rows(catalog.QUERIES["nearby_events"](spark, sf).toPandas()) == want
