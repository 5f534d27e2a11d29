"""Small graphs and plain-Python answers for the tests."""

from collections import defaultdict
from itertools import accumulate, combinations, pairwise


def clique_chain(sizes):
    """Cliques of the given sizes, next ones joined by an edge between their nearest vertices."""
    ends = [0, *accumulate(sizes)]
    inside = [pair for low, high in pairwise(ends) for pair in combinations(range(low, high), 2)]
    bridges = [(high - 1, high) for high in ends[1:-1]]
    return inside + bridges


def adjacency(edges):
    near = defaultdict(set)
    for u, v in edges:
        if u != v:
            near[u].add(v)
            near[v].add(u)
    return near


def core_numbers(edges):
    near = {v: set(n) for v, n in adjacency(edges).items()}
    core, k = {}, 0
    while near:
        v = min(near, key=lambda x: len(near[x]))
        k = max(k, len(near[v]))
        core[v] = k
        for w in near.pop(v):
            near[w].discard(v)
    return core


def component(edges, core, k, v):
    near, seen, todo = adjacency(edges), {v}, [v]
    while todo:
        for w in near[todo.pop()]:
            if core[w] >= k and w not in seen:
                seen.add(w)
                todo.append(w)
    return seen


def search(edges, query):
    """(k, vertices); (0, empty) for unknown vertices and disconnected queries."""
    core = core_numbers(edges)
    if not query or any(v not in core for v in query):
        return 0, set()
    for k in range(min(core[v] for v in query), 0, -1):
        found = component(edges, core, k, query[0])
        if set(query) <= found:
            return k, found
    return 0, set()


def all_answers(edges, queries):
    """Answers of many queries: components of every level first, then the highest that holds the query."""
    core = core_numbers(edges)
    levels = []
    for k in range(max(core.values()), 0, -1):
        open_ = {v for v in core if core[v] >= k}
        while open_:
            found = component(edges, core, k, next(iter(open_)))
            levels.append((k, found))
            open_ -= found
    return [next(((k, c) for k, c in levels if q and set(q) <= c), (0, set())) for q in queries]
