"""Every query of the reference's operators against its SQL twin, on the smallest tables."""

import math
import os

import duckdb
import pytest

from vellum.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
ORACLE = registry.oracle_sql()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)) or hasattr(v, "item"):
        return None if math.isnan(float(v)) else round(float(v), 6)
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query(spark, db, name):
    got = registry.queries()[name](spark, SF)
    want = db.sql(ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


def test_every_oracle_has_its_query():
    assert set(ORACLE) <= set(registry.queries())


def test_report_names_no_document(spark):
    frame = registry.queries()["corpus_report"](spark, SF)
    assert [c for c, t in frame.dtypes if t == "string"] == ["engine"]


def test_variant_sweep_renders_every_order(spark):
    n = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert {r["mode"]: r["n_docs"] for r in registry.queries()["variant_sweep"](spark, SF).collect()} == dict.fromkeys(("legacy", "ct120", "rowfill"), n)


@pytest.mark.parametrize("name", ["char_in_cell", "render_page", "rotated_ratio", "subtract_nested", "variant_sweep", "pdf_convert", "corpus_measure"])
def test_exploded_rows_are_no_broadcast_table(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "BroadcastHashJoin" not in plan


def test_subtracting_ships_no_pair_of_character_and_cell(spark):
    plan = registry.queries()["subtract_nested"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


def test_nesting_is_counted_without_comparing_all_boxes_of_a_page(spark):
    plan = registry.queries()["nested_cells"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("name", ["char_in_cell", "rotated_ratio"])
def test_characters_in_cells_are_counted_without_their_pairs(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
