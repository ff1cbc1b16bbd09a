"""Queries of the review process on odd tables, and what their plans hold."""

import shutil

import pytest

from paperloom.plans import registry
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
ORDER = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
LINE = (
    "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
    "l_returnflag string, l_linestatus string, l_shipdate timestamp"
)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Tables with keys that are null, an order that occurs twice, one without a customer, and lines that repeat a pair."""
    from datetime import datetime

    d = str(tmp_path_factory.mktemp("odd") / "sf")
    shutil.copytree(SF, d, copy_function=shutil.copyfile)
    at = datetime(1999, 5, 6)
    line = lambda order, supplier, no, flag="N", status="F", quantity=3.0: (order, 1, supplier, no, quantity, 9.5, 0.0, 0.0, flag, status, at)
    orders = [(1, 1, "O", 1.0, at, "1-URGENT"), (2, 2, "P", 1.0, at, "2-HIGH"), (2, 2, "O", 1.0, at, "2-HIGH"), (3, -9, "O", 1.0, at, "5-LOW"), (4, 1, "F", 1.0, at, "5-LOW"), (5, 1, "O", 1.0, at, "5-LOW")]
    lines = [line(1, 7, 1), line(1, 7, 2), line(1, 8, 1), line(2, 7, 1), line(2, 9, 2), line(3, 7, 1), line(3, 7, 1), line(4, 7, 1), line(4, 8, 2)]
    lines += [line(5, 7, 2), line(5, 7, 1, "R", "O"), line(None, 7, 1), line(None, 7, 2), line(6, None, 1), line(6, None, 2)]
    for name, rows, schema in (("orders", orders, ORDER), ("lineitem", lines, LINE)):
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{d}/{name}.parquet")
    return d


def test_audit_of_odd_tables(spark, odd):
    assert differences(spark, registry.QUERIES["having_audit"], registry.ORACLES["having_audit"], odd) == []
    found = {(r["rule"], r["subject"], r["n"]) for r in registry.QUERIES["having_audit"](spark, odd).collect()}
    assert {("duplicate_assignment", None, 2), ("all_done_not_completed", "2", 4), ("all_done_not_completed", "1", 2)} <= found


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_audit_reads_lines_once_and_groups_after_the_shuffle(spark):
    plan = plan_of(registry.QUERIES["having_audit"](spark, SF)).split("\n")
    (scan,) = [i for i, x in enumerate(plan) if "lineitem.parquet" in x]
    depth = lambda x: len(x) - len(x.lstrip(" :+-"))
    above, at = [], depth(plan[scan])
    for x in reversed(plan[:scan]):
        if depth(x) < at:
            above.append(x.lstrip(" :+-"))
            at = depth(x)
    assert [x.split()[0] for x in above if x.startswith(("Exchange", "SortAggregate", "HashAggregate", "ObjectHashAggregate"))][0] == "Exchange"


def test_sheets_read_lines_three_times_and_move_no_lines_by_sheet(spark):
    plan = plan_of(registry.QUERIES["category_sheets"](spark, SF))
    assert plan.count("lineitem.parquet") == 3
    assert "Exchange hashpartitioning(coalesce(sheet" not in plan
