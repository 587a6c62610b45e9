import importlib

import __spark_entry__ as e


def test_contract(spark):
    q, sql = e.queries(), e.oracle_sql()
    assert set(sql) <= set(q)
    assert e.entry(spark).count() > 0


def test_core_alone(spark):
    core = importlib.import_module("driftlog.queries")
    assert len(core.queries()) == len(core.oracle_sql()) > 55
