import random

import pytest

from cohesia.index import Index
from cohesia.operators import analysis, coreness, graph, hierarchy, search
from cohesia.plans.fixpoint import fixpoint
from tests.graphs import all_answers, clique_chain, component, core_numbers
from tests.graphs import search as plain_search

CHAINS = {"one": [4], "hill": [3, 5, 6, 5, 3], "valley": [6, 5, 3, 5, 6], "short": [4, 5, 4], "step": [3, 7]}
LONG = random.Random(17).choices(range(3, 12), k=18)


def index(spark, edges):
    return Index(graph.canonical_edges(spark.createDataFrame(edges, "u long, v long")))


def batch(spark, queries, kmins=None):
    rows = [(i, None if kmins is None else kmins[i], list(q)) for i, q in enumerate(queries)]
    return spark.createDataFrame(rows, "query_id long, kmin int, q array<long>")


def answers(frame, comp):
    sets = {}
    for r in comp.collect():
        sets.setdefault((r.k, r.label), set()).add(r.id)
    return {r.query_id: (r.k, sets[r.k, r.label] if r.label is not None else set(), r.found) for r in frame.collect()}


@pytest.mark.parametrize("name", CHAINS)
def test_chains(spark, name):
    sizes = CHAINS[name]
    n = sum(sizes)
    x = index(spark, clique_chain(sizes))
    queries = [[v] for v in range(n)] + [[a, b] for a in range(n) for b in range(a + 1, n)]
    want = {i: (*a, True) for i, a in enumerate(all_answers(clique_chain(sizes), queries))}
    assert answers(search.multi_search(batch(spark, queries), x.comp, x.core), x.comp) == want
    assert answers(search.index_search(batch(spark, queries), x.members, x.ancestors, x.core), x.comp) == want


def test_long_chain_all_pairs(spark):
    n = sum(LONG)
    x = index(spark, clique_chain(LONG))
    queries = [[a, b] for a in range(n) for b in range(a + 1, n)]
    got = answers(search.multi_search(batch(spark, queries), x.comp, x.core), x.comp)
    assert len(got) == n * (n - 1) // 2 and got == {i: (*a, True) for i, a in enumerate(all_answers(clique_chain(LONG), queries))}
    low = sum(LONG[: LONG.index(min(LONG))])
    asked = spark.createDataFrame([(0, low, min(LONG))], "query_id long, id long, k int")
    assert search.fixed_k_community(asked, x.comp, x.core).first().label is None


def test_trees(spark):
    x = index(spark, clique_chain(CHAINS["hill"]))
    nodes = {(r.core, r.label): (r.parent_core, r.parent_label, r.depth, r["size"]) for r in x.nodes.collect()}
    assert nodes == {(5, 8): (4, 3, 2, 6), (4, 3): (2, 0, 1, 10), (2, 0): (2, 0, 0, 6)}
    y = index(spark, clique_chain(CHAINS["valley"]))
    assert {(r.core, r.label, r.parent_core, r.parent_label) for r in y.nodes.collect()} == {(5, 0, 4, 0), (5, 19, 4, 14), (4, 0, 2, 0), (4, 14, 2, 0), (2, 0, 2, 0)}
    assert hierarchy.draw(x.nodes).splitlines() == ["2:0 (6)", "  4:3 (10)", "    5:8 (6)"]
    two = index(spark, [(0, 1), (1, 2), (0, 2), (10, 11), (11, 12), (10, 12)])
    assert {tuple(r) for r in two.nodes.collect()} == {(0, -1, 0, -1, 0, 0), (2, 0, 0, -1, 1, 3), (2, 10, 0, -1, 1, 3)}
    assert sorted(map(tuple, hierarchy.core_profile(two.nodes).collect())) == [(0, 1, 0), (1, 0, 0), (2, 2, 6)]


def test_rules(spark):
    edges = clique_chain([3, 4, 3]) + [(100, 101), (101, 102), (100, 102), (5, 5), (1, 0)]
    x = index(spark, edges)
    queries = [[0, 100], [0, 999], [0], [3], [3], [5, 5], [], [999]]
    kmins = [0, 0, 3, None, 4, 0, 0, 0]
    got = answers(search.multi_search(batch(spark, queries, kmins), x.comp, x.core), x.comp)
    assert got[0] == (0, set(), True) and got[1] == (0, set(), False) and got[7] == (0, set(), False) and got[6] == (0, set(), False)
    assert got[2] == (2, set(), True)
    assert got[3][:2] == (3, {3, 4, 5, 6}) and got[4] == (3, set(), True)
    assert got[5][:2] == (3, {3, 4, 5, 6})
    numbered = search.community_ids(search.multi_search(batch(spark, queries, kmins), x.comp, x.core)).collect()
    assert {r.comm_id for r in numbered if r.query_id in (3, 5)} == {0}


@pytest.mark.parametrize("small", [0, 10**6])
def test_random_graphs_against_plain_python(spark, small):
    rnd = random.Random(11)
    for n, m in ((25, 60), (60, 110)):
        edges = [(rnd.randrange(n), rnd.randrange(n)) for _ in range(m)]
        edges = [e for e in edges if e[0] != e[1]]
        simple = graph.canonical_edges(spark.createDataFrame(edges, "u long, v long"))
        core = coreness.coreness(graph.symmetric(simple), small)
        want = core_numbers(edges)
        assert {r.id: r.core for r in core.collect()} == want
        comp = hierarchy.components_by_level(simple, core, coreness.edge_weights(simple, core), small)
        assert {(r.k, r.id, r.label) for r in comp.collect()} == {(k, v, min(component(edges, want, k, v))) for k in set(want.values()) for v in want if want[v] >= k}
        ids = sorted(want)
        queries = [[rnd.choice(ids) for _ in range(rnd.randint(1, 3))] for _ in range(40)]
        got = answers(search.multi_search(batch(spark, queries), comp, core), comp)
        assert {i: g[:2] for i, g in got.items()} == {i: plain_search(edges, q) for i, q in enumerate(queries)}


@pytest.mark.parametrize("small", [0, 10**6])
def test_path_star_and_large_ids(spark, small):
    path = [(i, i + 1) for i in range(20)]
    star = [(3_000_000_000, 3_000_000_001 + i) for i in range(300)]
    adj = graph.symmetric(graph.canonical_edges(spark.createDataFrame(path + star, "u long, v long")))
    core = {r.id: r.core for r in coreness.coreness(adj, small).collect()}
    assert set(core.values()) == {1} and len(core) == 21 + 301
    assert coreness.coreness(adj.limit(0), small).count() == 0


def test_single_vertex_searches_agree(spark):
    rnd = random.Random(2)
    edges = clique_chain([4, 3, 5, 3]) + [(rnd.randrange(15), 20 + rnd.randrange(15)) for _ in range(25)] + [(50, 51)]
    x = index(spark, edges)
    core = core_numbers(edges)
    singles = spark.createDataFrame([(v, 0, v) for v in core] + [(-5, 0, -5)], "query_id long, kmin int, id long")
    by_core = {r.query_id: (r.k, r.label) for r in search.max_core_community(singles, x.members).collect()}
    assert by_core[-5] == (0, None)
    assert all(by_core[v] == (core[v], min(component(edges, core, core[v], v))) for v in core)
    asked = singles.selectExpr("query_id", "id", "cast(null as int) k")
    free = {r.query_id: (r.k if r.k is not None else 0, r.label) for r in search.fixed_k_community(asked, x.comp, x.core).collect()}
    assert free == by_core
    for k in (1, 2, 3):
        visited = []
        for small in (0, 10**6):
            rows, listed = search.local_search(singles.selectExpr("query_id", "id", f"{k} k"), x.edges, x.adj, small)
            sets = {}
            for r in listed.collect():
                sets.setdefault(r.query_id, set()).add(r.id)
            found = rows.collect()
            assert len(found) == len(core) + 1
            for r in found:
                if core.get(r.query_id, 0) >= k:
                    assert r.k == core[r.query_id] and sets[r.query_id] == component(edges, core, r.k, r.query_id) and r.visited >= len(sets[r.query_id])
                else:
                    assert r.k == 0 and r.query_id not in sets
            visited.append({r.query_id: r.visited for r in found})
        assert visited[0] == visited[1]


@pytest.mark.parametrize("small", [0, 10**6])
def test_bounds_spare_most_of_a_bridged_chain(spark, small):
    edges = clique_chain([8, 4, 5, 4, 8, 4, 9])
    x = index(spark, edges)
    asked = spark.createDataFrame([(0, 0, 1), (1, 41, 1), (2, 13, 4), (3, 13, 6)], "query_id long, id long, k int")
    rows, listed = search.local_search(asked, x.edges, x.adj, small)
    got = {r.query_id: (r.k, r.visited) for r in rows.collect()}
    # In the first step a query knows no more than its own k; after it, the bridges lead nowhere.
    assert got[0][0] == 7 and got[1][0] == 8 and got[2][0] == 4 and got[3][0] == 0
    assert got[0][1] <= 12 and got[1][1] <= 13 and got[2][1] < sum([8, 4, 5, 4, 8, 4, 9]) // 2 and got[3][1] == 0
    assert {r.id for r in listed.where("query_id = 1").collect()} == set(range(33, 42))


def test_analysis(spark):
    x = index(spark, clique_chain([3, 4, 3]))
    a = spark.createDataFrame([(0, 2, 0), (1, 3, 3), (2, 0, None), (3, 0, None)], "query_id long, k int, label long")
    b = spark.createDataFrame([(0, 3, 3), (1, 3, 3), (2, 0, None), (3, 2, 0)], "query_id long, k int, label long")
    assert {r.query_id: round(r.distance, 9) for r in analysis.jaccard_of_answers(a, b, x.comp).collect()} == {0: 0.6, 1: 0.0, 2: 0.0, 3: 1.0}
    sizes = {(r.k, r.label): (r.nodes, r.nbrhood) for r in analysis.community_sizes(x.comp, x.adj).collect()}
    assert sizes == {(2, 0): (10, 10), (3, 3): (4, 6)}
    edges = {(r.u, r.v) for r in search.community_edges(x.edges, x.comp.where("k = 3")).collect()}
    assert edges == {(i, j) for i in range(3, 7) for j in range(i + 1, 7)}


def test_fixpoint(spark):
    start = spark.createDataFrame([(5, True), (2, True)], "n long, moved boolean")
    end = fixpoint(start, lambda s: s.selectExpr("greatest(n - 1, 0) n", "n > 0 moved"), lambda s: s.where("moved"))
    assert [r.n for r in end.collect()] == [0, 0]
