"""Everything a graph is searched with, built once."""

from __future__ import annotations

from pyspark.sql import DataFrame

from cohesia.operators.coreness import coreness, edge_weights
from cohesia.operators.graph import symmetric
from cohesia.operators.hierarchy import components_by_level, shell_ancestors, shell_members, shell_nodes
from cohesia.storage import cut


class Index:
    """Tables of a graph given by canonical edges; each is made on first use and kept in the shared folder."""

    def __init__(self, edges: DataFrame):
        self._made: dict[str, DataFrame] = {"edges": cut(edges.select("u", "v"), "edges")}

    def _get(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = cut(make(), name)
        return self._made[name]

    @property
    def edges(self) -> DataFrame:
        return self._made["edges"]

    @property
    def adj(self) -> DataFrame:
        return symmetric(self.edges)

    @property
    def core(self) -> DataFrame:
        return self._get("core", lambda: coreness(self.adj))

    @property
    def weights(self) -> DataFrame:
        return self._get("weights", lambda: edge_weights(self.edges, self.core))

    @property
    def comp(self) -> DataFrame:
        return self._get("comp", lambda: components_by_level(self.edges, self.core, self.weights))

    @property
    def members(self) -> DataFrame:
        return self._get("members", lambda: shell_members(self.comp, self.core))

    @property
    def ancestors(self) -> DataFrame:
        return self._get("ancestors", lambda: shell_ancestors(self.members, self.comp))

    @property
    def nodes(self) -> DataFrame:
        return shell_nodes(self.members, self.ancestors)

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in ("core", "comp", "members", "ancestors", "nodes")}
