"""Every checked query of the library against its SQL in DuckDB, at the smallest scale."""

import math

import duckdb
import pytest

import adloom.plans as plans

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Queries that join a table of one row (counts, limits) without a key, and how often; the only nested loops.
ONE_ROW_SIDES = {"j11_prefix_best_match": 1, "r1_split": 2, "r7_assemble_examples": 2, "r10_roc_auc": 2, "r11_linear_baseline": 13}
#: Queries whose sums over vectors run in NumPy.
IN_PYTHON = ("j7_dense_topk", "r8_masked_mean_history", "r8_weighted_history")
#: Scans of one plan, before reuse.
MOST_SCANS = 60


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def canon(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "NULL"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    made = plans.QUERIES[name](spark, DATA)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert plan.count("BroadcastNestedLoopJoin") <= ONE_ROW_SIDES.get(name, 0)
    assert plan.count("FileScan") <= MOST_SCANS
    assert name in IN_PYTHON or not any(w in plan for w in ("Python", "Pandas", "Arrow"))
    rows, columns = made.collect(), sorted(made.columns)
    assert len(set(columns)) == len(columns)
    if name not in plans.ORACLES:
        return
    found = duck.execute(plans.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == columns
    want = sorted(tuple(canon(r[names.index(c)]) for c in columns) for r in found.fetchall())
    assert sorted(tuple(canon(r[c]) for c in columns) for r in rows) == want
