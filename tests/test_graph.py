import random

import pytest
from pyspark.sql import functions as F

from cohesia.functions import h_index, seconds
from cohesia.operators import components, graph, workload
from tests.graphs import adjacency


@pytest.fixture(scope="module")
def messy():
    rnd = random.Random(3)
    return [(rnd.randrange(40), rnd.randrange(40)) for _ in range(150)] + [(1, 1), (2, 5), (5, 2), (3_000_000_000, 7), (7, 3_000_000_000)]


def frame(spark, edges):
    return spark.createDataFrame(edges, "u long, v long")


def test_cleaning(spark, messy):
    df = frame(spark, messy).unionAll(spark.createDataFrame([(None, 1)], "u long, v long"))
    got = {tuple(r) for r in graph.canonical_edges(df).collect()}
    assert got == {(min(e), max(e)) for e in messy if e[0] != e[1]}
    both = [tuple(r) for r in graph.symmetric(frame(spark, sorted(got))).collect()]
    assert sorted(both) == sorted([*got, *((v, u) for u, v in got)])


@pytest.mark.parametrize("bin_rows", [1_000_000, 7])
def test_ids(spark, messy, monkeypatch, bin_rows):
    monkeypatch.setattr(graph, "BIN_ROWS", bin_rows)
    df = frame(spark, messy)
    ids = graph.dense_ids(graph.vertex_set(df)).collect()
    want = sorted({x for e in messy for x in e})
    assert sorted((r.id, r.orig) for r in ids) == list(enumerate(want))
    back = graph.restore(graph.restore(graph.relabel(df, graph.dense_ids(graph.vertex_set(df))), graph.dense_ids(graph.vertex_set(df)), "u"), graph.dense_ids(graph.vertex_set(df)), "v")
    assert sorted((r.u, r.v) for r in back.collect()) == sorted(messy)


def test_degrees_and_neighbourhoods(spark, messy):
    edges = graph.canonical_edges(frame(spark, messy))
    adj, near = graph.symmetric(edges), adjacency(messy)
    assert {r.id: r.degree for r in graph.degree(adj).collect()} == {v: len(n) for v, n in near.items()}
    multi = {r.id: r.degree for r in graph.degree_multiset(frame(spark, messy)).collect()}
    assert multi[1] == sum((u == 1) + (v == 1) for u, v in messy)
    start = spark.createDataFrame([(3,), (7,)], "id long")
    assert {r.id for r in graph.closed_neighbourhood(adj, start).collect()} == {3, 7} | near[3] | near[7]
    hops = {r.id: r.hop for r in graph.k_hop(adj, start, 3).collect()}
    dist, todo = {3: 0, 7: 0}, [3, 7]
    for v in todo:
        for w in near[v]:
            if w not in dist and dist[v] < 3:
                dist[w] = dist[v] + 1
                todo.append(w)
    assert hops == dist
    some = set(list(near)[:20])
    inside = graph.induced(edges, spark.createDataFrame([(v,) for v in some], "id long"))
    assert {tuple(r) for r in inside.collect()} == {(min(e), max(e)) for e in messy if e[0] != e[1] and set(e) <= some}


@pytest.mark.parametrize("small", [0, 10**6])
def test_components(spark, messy, small):
    path = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5000 + i) for i in range(1, 400)]
    edges = messy + path + star + [(9, None)]
    near, want = adjacency([e for e in edges if e[1] is not None]), {}
    for v in sorted({x for e in edges if e[1] is not None for x in e}):
        if v not in want:
            todo = [v]
            want[v] = v
            for x in todo:
                for y in near.get(x, ()):
                    if y not in want:
                        want[y] = v
                        todo.append(y)
    got = components.connected_components(frame(spark, edges), "u", "v", small)
    assert {r.id: r.component for r in got.collect()} == want
    assert components.connected_components(frame(spark, []), "u", "v", small).count() == 0


def test_workloads(spark):
    degrees = spark.createDataFrame([(i, i % 37) for i in range(1000)], "id long, degree long")
    values = sorted(i % 37 for i in range(1000))
    assert graph.quantile_nearest(degrees, "degree", 0.99) == values[round(0.99 * 999)]
    assert {r.id for r in workload.high_degree(degrees).collect()} == {i for i in range(1000) if i % 37 >= values[round(0.99 * 999)]}
    a = workload.singletons(degrees, 50, 1337, False, 10).collect()
    b = workload.singletons(degrees.repartition(7), 50, 1337, False, 10).collect()
    assert a == b and [r.query_id for r in a] == list(range(50)) and len({r.q[0] for r in a}) == 50
    adj = spark.createDataFrame([(1, i) for i in range(20)], "src long, dst long")
    roots = spark.createDataFrame([(1,)], "id long")
    assert workload.neighbour_sets(adj, roots).first().q == list(range(20))
    assert workload.neighbour_sets(adj, roots, 5).first().q == list(range(5))
    assert len(workload.neighbour_sets(adj, roots, 5, 3).first().q) == 5
    assert graph.quantile_nearest(degrees.limit(0), "degree", 0.5) is None


def test_functions(spark):
    rows = spark.createDataFrame([([5, 3, 3, 1],), ([],), ([9, 9, 9],), ([1],)], "a array<long>")
    assert [r[0] for r in rows.select(h_index(F.col("a"))).collect()] == [3, 0, 3, 1]
    clock = spark.createDataFrame([("1:02:03.5",), ("2:03",), ("x",), (None,)], "t string")
    assert [r[0] for r in clock.select(seconds(F.col("t"))).collect()] == [3723.5, 123.0, None, None]
