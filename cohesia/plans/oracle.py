"""DuckDB SQL with the meaning of the queries, put together from common table expressions."""

from __future__ import annotations


def with_graph(final: str, above: int = 45) -> str:
    """Simple copurchase edges as ``e0(u, v)`` (u < v) and ``e`` in both directions."""
    return f"""with recursive
e0 as (select distinct least(a.l_partkey, b.l_partkey) u, greatest(a.l_partkey, b.l_partkey) v
       from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_partkey < b.l_partkey
       where a.l_quantity > {above} and b.l_quantity > {above}),
e as (select u, v from e0 union all select v, u from e0)
{final}"""


CORE = """
c(it, id, h) as (
  select 0, u, count(*)::bigint from e group by u
  union all
  select it + 1, id, nh from (
    select it, id, h, nh, bool_or(nh < h) over () chg from (
      select it, id, any_value(h) h, max(least(hn, rn)) nh from (
        select cu.it, e.u id, cu.h h, cv.h hn, row_number() over (partition by e.u order by cv.h desc) rn
        from e join c cu on cu.id = e.u join c cv on cv.id = e.v)
      group by it, id)) where chg),
core as (select id, min(h)::int core from c group by id),
w as (select e.u, e.v, least(a.core, b.core) w from e join core a on a.id = e.u join core b on b.id = e.v)"""

COMP = """,
ks as (select distinct core k from core),
l(it, k, id, lab) as (
  select 0, k, id, id from core join ks on core >= k
  union all
  select it + 1, k, id, nl from (
    select it, k, id, nl, bool_or(nl < lab) over () chg from (
      select l.it, l.k, l.id, l.lab, least(l.lab, min(n.lab)) nl
      from l join w on w.u = l.id and w.w >= l.k join l n on n.id = w.v and n.k = l.k
      group by l.it, l.k, l.id, l.lab)) where chg),
comp as (select k, id, min(lab) as label from l group by k, id)"""

TREE = """,
members as (select core.id, core.core, comp.label from core join comp on comp.id = core.id and comp.k = core.core),
nodes0 as (select core, label, count(*) size from members group by core, label),
anc as (select n.core, n.label, c.k anc_core, c.label anc_label from nodes0 n join comp c on c.id = n.label and c.k <= n.core
        join nodes0 a on a.core = c.k and a.label = c.label),
up as (select core, label, max(anc_core) pc, count(*) above from anc where anc_core < core group by core, label),
tops as (select count(*) t from nodes0 n where not exists (select 1 from up where up.core = n.core and up.label = n.label)),
nodes as (select n.core, n.label,
            coalesce(up.pc, case when t > 1 then 0 else n.core end)::int parent_core,
            coalesce(anc.anc_label, case when t > 1 then -1 else n.label end)::bigint parent_label,
            (coalesce(above, 0) + (t > 1)::int)::int depth, n.size::bigint size
          from nodes0 n cross join tops left join up on up.core = n.core and up.label = n.label
          left join anc on anc.core = n.core and anc.label = n.label and anc.anc_core = up.pc
          union all select 0, -1, 0, -1, 0, 0 from tops where t > 1)"""

QUERIES = """,
qs as (select distinct l_orderkey query_id, l_partkey id from lineitem where l_quantity > 40),
qn as (select query_id, count(*) n, least(count(*), 3) kmin from qs group by query_id),
known as (select query_id, count(*) known from qs join core using (id) group by query_id),
hit as (select query_id, k, label, count(*) c from qs join comp using (id) group by query_id, k, label),
best as (select hit.query_id, max(k) k, arg_max(label, k) as label from hit join qn on qn.query_id = hit.query_id and hit.c = qn.n group by hit.query_id),
answers as (select qn.query_id, coalesce(known, 0) = n as found, coalesce(k, 0)::int k,
              case when k > 0 then label end as any_label, case when k > 0 and k >= kmin then label end as label
            from qn left join known using (query_id) left join best using (query_id))"""


def with_core(final: str, above: int = 45) -> str:
    return with_graph("," + CORE + "\n" + final, above)


def with_comp(final: str, above: int = 45) -> str:
    return with_graph("," + CORE + COMP + "\n" + final, above)


def with_tree(final: str, above: int = 45) -> str:
    return with_graph("," + CORE + COMP + TREE + "\n" + final, above)


def with_answers(final: str, above: int = 45) -> str:
    return with_graph("," + CORE + COMP + QUERIES + "\n" + final, above)
