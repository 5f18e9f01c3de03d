"""Repair of dirty graphs: raw tables, and the same rows packed into JSON documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.operators import repair as R
from lodemap.plans.cut import cut
from workload.graph_queries import sql_case, sql_list
from workload.views import duck, query, view


def clean(spark, sf):
    nodes, ni = R.repair_nodes(view(spark, sf, "v_raw_nodes"))
    nodes = cut(nodes)
    edges, ei = R.repair_edges(view(spark, sf, "v_raw_edges"), nodes)
    return nodes, edges, ni.unionByName(ei)


def q_nodes(spark, sf):
    return clean(spark, sf)[0].select("repo_id", "id", "type", "name", "complexity", "summary", F.array_join("tags", ",").alias("tags"), "node_ord")


RAW = f"""rn as (select *, case when type = '' then 'file' else lower(type) end as given from v_raw_nodes),
 tn as (select *, case when given in {sql_list([t for t in dims.NODE_CATEGORY if t == t.lower()])} then given
  else {sql_case('given', dims.NODE_ALIASES)} end as ty, {sql_case('lower(complexity)', dims.COMPLEXITY_ALIASES)} as cx from rn),
 ok as (select *, row_number() over (partition by repo_id, id order by node_ord) as nth from tn where ty is not null),
 n as (select * from ok where nth = 1)"""
S_NODES = duck(f"""with {RAW} select repo_id, id, ty as type, id as name,
 coalesce(cx, case when complexity in ('simple', 'moderate', 'complex') then complexity else 'moderate' end) as complexity,
 'Not yet analyzed.' as summary, 'untagged' as tags, node_ord from n""")


def q_edges(spark, sf):
    return clean(spark, sf)[1].select("repo_id", "source", "target", "type", "direction", "weight", "edge_ord")


EDGES = f"""re as (select *, case when type = '' then 'depends_on' else lower(type) end as given from v_raw_edges where source <> target),
 te as (select *, case when given in {sql_list(dims.EDGE_CATEGORY)} then given else {sql_case('given', dims.EDGE_ALIASES)} end as ty from re),
 je as (select te.*, a.id is not null as s_ok, b.id is not null as t_ok from te
  left join n a on a.repo_id = te.repo_id and a.id = te.source left join n b on b.repo_id = te.repo_id and b.id = te.target)"""
S_EDGES = duck(f"""with {RAW}, {EDGES} select repo_id, source, target, type, direction, weight, edge_ord from (
 select repo_id, source, target, ty as type, 'forward' as direction, greatest(0.0, least(1.0, cast(weight as double))) as weight, edge_ord,
  row_number() over (partition by repo_id, source, target, ty order by edge_ord) as rn from je where ty is not null and s_ok and t_ok) where rn = 1""")


def q_totals(spark, sf):
    return R.issue_report(cut(clean(spark, sf)[2]), 500)["totals"]


ISSUES = f"""{RAW}, {EDGES}, i as (
 select repo_id, 'missing-field' as category, 'auto-corrected' as level from tn where type = ''
 union all select repo_id, 'alias', 'auto-corrected' from tn where ty is not null and ty <> given
 union all select repo_id, 'invalid-node', 'dropped' from tn where ty is null
 union all select repo_id, 'alias', 'auto-corrected' from tn where ty is not null and cx is not null
 union all select repo_id, 'invalid-node', 'dropped' from ok where nth > 1
 union all select repo_id, 'alias', 'auto-corrected' from te where ty is not null and ty <> given
 union all select repo_id, 'invalid-edge', 'dropped' from te where ty is null
 union all select repo_id, 'out-of-range', 'auto-corrected' from te where ty is not null and (weight > 1 or weight < 0)
 union all select repo_id, 'invalid-reference', 'dropped' from je where ty is not null and not (s_ok and t_ok))"""
S_TOTALS = duck(f"with {ISSUES} select repo_id, category, count(*) as n from i group by 1, 2")


def q_levels(spark, sf):
    return R.issue_report(cut(clean(spark, sf)[2]), 500)["levels"]


S_LEVELS = duck(f"""with {ISSUES} select repo_id, count(*) filter (where level = 'fatal') as fatal, count(*) filter (where level = 'dropped') as dropped,
 count(*) filter (where level = 'auto-corrected') as corrected, count(*) as total,
 case when count(*) filter (where level = 'dropped') > 0 then 'dropped' else 'auto-corrected' end as worst_level, count(*) > 500 as truncated from i group by 1""")


def q_stored(spark, sf):
    return R.issue_report(cut(clean(spark, sf)[2]), 500)["issues"].groupBy("repo_id").agg(F.count("*").alias("n"))


S_STORED = duck(f"with {ISSUES} select repo_id, least(500, count(*)) as n from i group by 1")


def q_messages(spark, sf):
    return clean(spark, sf)[2].filter("category in ('missing-field', 'invalid-reference')").select("repo_id", "message", "path")


S_MESSAGES = duck(f"""with {RAW}, {EDGES}
 select repo_id, 'Node "' || id || '" came without a type and counts as a file.' as message, 'nodes[' || node_ord || '].type' as path from tn where type = ''
 union all select repo_id, 'Edge source "' || source || '" is none of the nodes.', 'edges[' || edge_ord || '].source' from je where ty is not null and not s_ok
 union all select repo_id, 'Edge target "' || target || '" is none of the nodes.', 'edges[' || edge_ord || '].target' from je where ty is not null and s_ok and not t_ok""")


# --- documents: one per customer, its orders as nodes and a chain of edges -----------------------

DOCS = """select o_custkey as repo_id, case when o_custkey % 29 = 0 then '[1]' when o_custkey % 31 = 0 then '{"nodes": []}'
 when o_custkey % 37 = 0 then '{"project": {"name": "c"}, "nodes": {"a": 1}}' when o_custkey % 41 = 0 then '{"project": {"name": "c"}, "nodes": []}'
 else '{"project": {"name": "c' || cast(o_custkey as string) || '"}, "kind": "codebase", "nodes": [' || array_join(nodes, ',') || '], "edges": ['
 || array_join(edges, ',') || '], "layers": [{"name": "All Orders", "nodes": [{"id": "o1"}, "' || first_id || '", 5]}, {"id": "x"}], "tour": [{"title": "T", "nodesToInspect": ["'
 || first_id || '", "nope"], "order": 3}, {"description": "no title"}]}' end as document
 from (select o_custkey, min('o' || cast(o_orderkey as string)) as first_id, array_sort(collect_list('{"id": " o' || cast(o_orderkey as string) || ' ", "type": "' ||
   case o_orderkey % 3 when 0 then 'fn' when 1 then 'class' else 'wat' end || '", "complexity": ' || case o_orderkey % 4 when 0 then '5' when 1 then '"5"' when 2 then '"HIGH"' else '2.5' end
   || ', "tags": ' || case o_orderkey % 2 when 0 then '["a", 1]' else '["a", "b"]' end || ', "lineRange": [1, ' || cast(o_orderkey % 9 as string) || ']}')) as nodes,
   array_sort(collect_list('{"source": "o' || cast(o_orderkey as string) || '", "target": "o' || coalesce(cast(nxt as string), '-none') || '", "type": "uses", "weight": '
    || case o_orderkey % 3 when 0 then '"0.25"' when 1 then '7' else '0.5' end || '}')) as edges
  from (select *, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders) group by o_custkey)"""


def documents(spark, sf):
    return R.validate(query(spark, sf, DOCS))


def q_doc_nodes(spark, sf):
    return documents(spark, sf)["nodes"].select("repo_id", "id", "type", "complexity", F.array_join("tags", ",").alias("tags"), "line_end")


LIVE = "o_custkey % 29 <> 0 and o_custkey % 31 <> 0 and o_custkey % 37 <> 0 and o_custkey % 41 <> 0"
S_DOC_NODES = f"""select o_custkey as repo_id, 'o' || o_orderkey as id, case o_orderkey % 3 when 0 then 'function' else 'class' end as type,
 case o_orderkey % 4 when 0 then 'moderate' when 1 then 'moderate' when 2 then 'complex' else 'simple' end as complexity,
 case o_orderkey % 2 when 0 then 'untagged' else 'a,b' end as tags, cast(o_orderkey % 9 as integer) as line_end
 from orders where {LIVE} and o_orderkey % 3 < 2"""


def q_doc_issues(spark, sf):
    return documents(spark, sf)["issues"].groupBy("repo_id", "level", "category").agg(F.count("*").alias("n"))


S_DOC_ISSUES = f"""with o as (select o_custkey as r, o_orderkey as k, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders),
 d as (select r as c, count(*) filter (where k % 3 < 2) as good from o group by 1), a as (select o.*, good from o join d on d.c = o.r where {LIVE.replace('o_custkey', 'r')}),
 i as (select r, 'auto-corrected' as level, 'alias' as category from a where k % 3 = 0
  union all select r, 'dropped', 'invalid-node' from a where k % 3 = 2
  union all select r, 'auto-corrected', 'type-coercion' from a where k % 3 < 2 and k % 4 in (0, 3)
  union all select r, 'auto-corrected', 'alias' from a where k % 3 < 2 and k % 4 = 2
  union all select r, 'auto-corrected', 'alias' from a where good > 0
  union all select r, 'auto-corrected', case k % 3 when 0 then 'type-coercion' else 'out-of-range' end from a where good > 0 and k % 3 < 2
  union all select r, 'dropped', 'invalid-reference' from a where good > 0 and (k % 3 = 2 or coalesce(nxt, 2) % 3 = 2)
  union all select c, 'dropped', 'invalid-layer' from d where good > 0 and {LIVE.replace('o_custkey', 'c')}
  union all select c, 'dropped', 'invalid-tour-step' from d where good > 0 and {LIVE.replace('o_custkey', 'c')}
  union all select c, 'fatal', case when c % 29 = 0 then 'invalid-collection' when c % 31 = 0 then 'missing-field' when c % 37 = 0 then 'invalid-collection' else 'invalid-node' end
   from d where not ({LIVE.replace('o_custkey', 'c')}) or good = 0)
 select r as repo_id, level, category, count(*) as n from i group by 1, 2, 3"""


def q_doc_edges(spark, sf):
    return documents(spark, sf)["edges"].select("repo_id", "source", "target", "type", "weight")


S_DOC_EDGES = f"""select o_custkey as repo_id, 'o' || k as source, 'o' || nxt as target, 'depends_on' as type, cast(case k % 3 when 0 then 0.25 else 1.0 end as double) as weight
 from (select o_custkey, o_orderkey as k, lead(o_orderkey) over (partition by o_custkey order by o_orderkey) as nxt from orders)
 where {LIVE} and k % 3 < 2 and nxt % 3 < 2"""


def q_doc_layers(spark, sf):
    t = documents(spark, sf)
    return t["layer_members"].select("repo_id", "layer_id", "node_id").unionByName(
        t["tour_steps"].select("repo_id", F.concat_ws(":", F.lit("tour"), F.col("step_order").cast("string"), "title").alias("layer_id"), F.array_join("node_ids", ",").alias("node_id")))


S_DOC_LAYERS = f"""with d as (select o_custkey as r, min('o' || o_orderkey) as f, arg_min(o_orderkey, 'o' || o_orderkey) as k,
  count(*) filter (where o_orderkey % 3 < 2) as good, count(*) filter (where o_orderkey = 1) as one from orders where {LIVE} group by 1)
 select r as repo_id, 'layer:all-orders' as layer_id, f as node_id from d where k % 3 < 2
 union all select r, 'layer:all-orders', 'o1' from d where one > 0
 union all select r, 'tour:3:T', case when k % 3 < 2 then f else '' end from d where good > 0"""

QUERIES = {
    "repair_nodes": (q_nodes, S_NODES),
    "repair_edges": (q_edges, S_EDGES),
    "issue_totals": (q_totals, S_TOTALS),
    "issue_levels": (q_levels, S_LEVELS),
    "issues_stored": (q_stored, S_STORED),
    "issue_messages": (q_messages, S_MESSAGES),
    "document_nodes": (q_doc_nodes, S_DOC_NODES),
    "document_edges": (q_doc_edges, S_DOC_EDGES),
    "document_issues": (q_doc_issues, S_DOC_ISSUES),
    "document_layers_tour": (q_doc_layers, S_DOC_LAYERS),
}
