import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.graphs import component, core_numbers

REF = sorted(n for n in entry.registry.QUERIES)


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(REF) <= set(q)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["query_id", "found", "k", "label"]


def test_deep_graph_against_brute_force(spark, data):
    rows = spark.read.parquet(f"{data}/lineitem.parquet").join(spark.read.parquet(f"{data}/orders.parquet"), F.expr("l_orderkey = o_orderkey")).select("o_custkey", "l_suppkey").distinct().collect()
    edges = [(-r.l_suppkey - 1, r.o_custkey) for r in rows]
    core = core_numbers(edges)
    label = {}
    for k in sorted(set(core.values())):
        left = {v for v in core if core[v] >= k}
        while left:
            found = component(edges, core, k, min(left))
            label |= {(k, v): min(found) for v in found}
            left -= found
    assert {(r.k, r.id): r.label for r in entry.queries()["kcore_components_deep"](spark, data).collect()} == label
    assert {r.query_id: (r.k, r.label) for r in entry.queries()["max_core_community_deep"](spark, data).collect()} == {v: (core[v], label[core[v], v]) for v in core}
    visited = {r.query_id: r for r in entry.queries()["local_kcore_visited"](spark, data).collect()}
    shown = {r.query_id: r.k for r in entry.queries()["local_kcore"](spark, data).collect()}
    assert {q: r.k for q, r in visited.items()} == shown and all(r.visited > r.k for r in visited.values())


def norm(v):
    return round(v, 9) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v


@pytest.mark.parametrize("name", [n for n in REF if n in entry.oracle_sql()])
def test_against_sql(spark, data, name):
    duckdb = pytest.importorskip("duckdb")
    sql = entry.oracle_sql()[name]
    con = duckdb.connect()
    for t in set(re.findall(r"\b(lineitem|orders|nation|supplier)\b", sql)):
        con.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    want = sorted(repr([norm(r[i]) for i in order]) for r in cur.fetchall())
    df = entry.queries()[name](spark, data)
    got = sorted(repr([norm(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    assert sorted(df.columns) == sorted(names)
    assert got == want
