"""Inputs made from the driver's tables. Each is one SQL text that Spark and DuckDB both read."""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()

VIEWS: dict[str, str] = {
    "v_files": """
select p_partkey % 7 as repo_id,
 (case p_partkey % 5 when 0 then 'src/api' when 1 then 'src/services' when 2 then 'lib/models'
  when 3 then 'web/components' else 'app' end)
 || '/p' || cast(p_partkey as varchar(20)) ||
 (case when p_size % 10 = 0 then '.test.ts' when p_size % 10 < 6 then '.ts' when p_size % 10 < 8 then '.py'
  else '.md' end) as path,
 p_partkey, p_size as n_lines, p_name as name from part""",
    "v_pair_files": """
select repo_id, path from v_files
 union all select repo_id, replace(path, '.test.ts', case when p_partkey % 3 = 0 then '.ts' else '.tsx' end)
  from v_files where path like '%.test.ts' and p_partkey % 3 <> 2
 union all select distinct repo_id, case when repo_id < 3 then 'src/index.ts' when repo_id < 5
  then 'cmd/tool/main.go' else 'main.py' end from v_files where repo_id <> 6""",
    "v_imports": """
select distinct fa.repo_id, fa.path as importer, fb.path as target_path, fa.p_partkey as src_key,
  fb.p_partkey as dst_key
 from lineitem a join lineitem b on a.l_orderkey = b.l_orderkey and a.l_linenumber + 1 = b.l_linenumber
 join v_files fa on fa.p_partkey = a.l_partkey join v_files fb on fb.p_partkey = b.l_partkey
 where fa.repo_id = fb.repo_id and fa.p_partkey <> fb.p_partkey""",
    "v_specs": """
select repo_id, importer, target_path,
 (case when importer like 'app/%' then '../' else '../../' end) ||
 (case when target_path like '%.ts' then substr(target_path, 1, length(target_path) - 3) else target_path end) as spec
 from v_imports""",
    "v_nodes": """
select 'file:n' || cast(n_nationkey as varchar(20)) as id, 'file' as type, n_name as name, n_regionkey as repo_id
  from nation
 union all select 'class:c' || cast(c_custkey as varchar(20)), 'class', c_name, n_regionkey
  from customer join nation on c_nationkey = n_nationkey
 union all select 'function:o' || cast(o_orderkey as varchar(20)), 'function', o_orderpriority, n_regionkey
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "v_edges": """
select 'file:n' || cast(c_nationkey as varchar(20)) as source, 'class:c' || cast(c_custkey as varchar(20)) as target,
  'contains' as type from customer
 union all select 'class:c' || cast(o_custkey as varchar(20)), 'function:o' || cast(o_orderkey as varchar(20)),
  'contains' from orders
 union all select 'class:c' || cast(o_custkey as varchar(20)), 'function:o' || cast(o_orderkey as varchar(20)),
  'exports' from orders where o_orderstatus = 'F'
 union all select source, target, 'calls' from (select 'function:o' || cast(o_orderkey as varchar(20)) as source,
  'function:o' || cast(lead(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey)
   as varchar(20)) as target from orders) q where target is not null""",
    # Nodes with all texts that a search looks at; tags are joined by spaces.
    "v_search_nodes": """
select 'class:c' || cast(c_custkey as varchar(20)) as id, n_regionkey as repo_id, c_name as name, c_mktsegment || ' ' || n_name as tag_text,
  n_name as summary, c_mktsegment || ' of ' || n_name as language_notes from customer join nation on c_nationkey = n_nationkey
 union all select 'file:p' || cast(p_partkey as varchar(20)), p_partkey % 5, p_name, p_brand || ' ' || p_type,
  case when p_size % 3 = 0 then 'Not yet analyzed.' else p_name || ' by ' || p_brand end, p_type || ' ' || p_name from part
 union all select 'function:o' || cast(o_orderkey as varchar(20)), o_custkey % 5, o_orderpriority, 'status ' || o_orderstatus,
  cast(null as varchar(20)), 'order ' || o_orderpriority from orders""",
    # A request for each supplier and each part: letters left out, nations, words of names, brands.
    "v_requests": """
select 's' || cast(s_suppkey as varchar(20)) as query_id, case s_suppkey % 3 when 0 then 'cmr' || cast(s_suppkey as varchar(20))
  when 1 then n_name else substr(n_name, 2, 4) || ' urgnt' end as text from supplier join nation on s_nationkey = n_nationkey
 union all select 'p' || cast(p_partkey as varchar(20)), case p_partkey % 4 when 0 then p_name when 1 then p_brand || '  brnd' when 2 then p_type
  else substr(p_name, 1, 5) || substr(p_name, 7) end from part""",
    # v_edges with its repository: the owner of an edge is the owner of its source node.
    "v_repo_edges": """
select n.repo_id, e.source, e.target, e.type from v_edges e join v_nodes n on n.id = e.source""",
    "v_raw_nodes": """
select n_regionkey as repo_id,
 case when c_custkey % 50 = 0 then 'c1' else 'c' || cast(c_custkey as varchar(20)) end as id,
 case c_custkey % 6 when 0 then 'func' when 1 then 'file' when 2 then 'Struct' when 3 then '' when 4 then 'zzz'
  else 'page' end as type,
 case c_custkey % 4 when 0 then 'high' when 1 then 'easy' when 2 then 'odd' else 'simple' end as complexity,
 c_custkey as node_ord
 from customer join nation on c_nationkey = n_nationkey""",
    "v_raw_edges": """
select n_regionkey as repo_id, 'c' || cast(o_custkey as varchar(20)) as source,
 'c' || cast(o_custkey * 7 % 1600 as varchar(20)) as target,
 case o_orderkey % 5 when 0 then 'extends' when 1 then 'uses' when 2 then 'imports' when 3 then '' else 'nope' end
  as type,
 o_totalprice / 200000.0 as weight, o_orderkey as edge_ord
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""",
    "v_snap_old": """
select doc_id % 9 as repo_id, source || '/' || lang || '/d' || cast(doc_id as varchar(20)) || '.txt' as path,
 text as content from documents where doc_id % 11 <> 3""",
    "v_snap_new": """
select doc_id % 9 as repo_id, source || '/' || lang || '/d' || cast(doc_id as varchar(20)) || '.txt' as path,
 case when doc_id % 4 = 0 then text || ' x' else text end as content from documents where doc_id % 13 <> 5""",
    "v_sig_old": """
select n_regionkey as repo_id, 'src/c' || cast(o_custkey as varchar(20)) || '.ts' as path, o_orderpriority as name,
 count(*) as line_count, max(o_orderstatus) as params
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 where o_orderkey % 10 <> 3 group by n_regionkey, o_custkey, o_orderpriority""",
    "v_sig_new": """
select n_regionkey as repo_id, 'src/c' || cast(o_custkey as varchar(20)) || '.ts' as path, o_orderpriority as name,
 count(*) as line_count, max(o_orderstatus) as params
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 where o_orderkey % 10 <> 4 group by n_regionkey, o_custkey, o_orderpriority""",
    "v_commits": """
select o_custkey as repo_id, o_orderkey as commit_id, case when o_orderkey % 6 = 0
 then lag(o_orderkey, 2) over (partition by o_custkey order by o_orderdate, o_orderkey)
 else lag(o_orderkey, 1) over (partition by o_custkey order by o_orderdate, o_orderkey) end as parent_id
 from orders""",
    "v_fs_events": """
select event_id, ts, user_id as repo_id, 'src/u' || cast(user_id % 20 as varchar(20)) || (case event_type
 when 'error' then '/dist/x.js' when 'view' then '/a.ts' when 'click' then '/.hidden' when 'purchase' then '/b.py'
 else '/c.tmp' end) as path from events""",
}

SOURCE_BODY = (" || 'export function f' || cast(f.p_partkey as varchar(20)) || '(a, b) {' || chr(10)"
               " || '  return g(a); // not h(b)' || chr(10) || '}' || chr(10) as content")


def _source(agg: str) -> str:
    return f"""
select f.repo_id, f.path, coalesce(i.lines, ''){SOURCE_BODY}
 from v_files f left join (select repo_id, importer, {agg} as lines from v_specs group by repo_id, importer) i
 on f.repo_id = i.repo_id and f.path = i.importer where f.path like '%.ts'"""


DUCK_VIEWS = VIEWS | {
    "v_source": _source("string_agg('import { x } from \"' || spec || '\";' || chr(10), '' order by spec)"),
    "v_points": "select label as repo_id, vec_id as node_id, cast(embedding[1] as double) * 1000 as x, "
                "cast(embedding[2] as double) * 1000 as y from embeddings",
}
SPARK_VIEWS = VIEWS | {
    "v_source": _source("listagg('import { x } from \"' || spec || '\";' || chr(10), '') within group (order by spec)"),
    "v_points": "select label as repo_id, vec_id as node_id, cast(embedding[0] as double) * 1000 as x, "
                "cast(embedding[1] as double) * 1000 as y from embeddings",
}


@functools.cache
def _needs(dialect: str, text: str) -> tuple[str, ...]:
    """Names of the views a SQL text uses, dependencies first."""
    views = DUCK_VIEWS if dialect == "duck" else SPARK_VIEWS
    found: list[str] = []
    for name in views:
        if re.search(rf"\b{name}\b", text):
            for dep in (*_needs(dialect, views[name]), name):
                if dep not in found:
                    found.append(dep)
    return tuple(found)


def duck(sql: str) -> str:
    """``sql`` for DuckDB with the views it names put in front. It may start with its own ``with`` list."""
    ctes = [f"{n} as ({DUCK_VIEWS[n]})" for n in _needs("duck", sql)]
    if not ctes:
        return sql
    body = sql.strip()
    match = re.match(r"with\s+(recursive\s+)?", body, re.I)
    rec = "recursive " if match and match.group(1) else ""
    return f"with {rec}" + ",\n".join(ctes) + (",\n" + body[match.end():] if match else "\n" + body)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def query(spark: SparkSession, sf: str, sql: str, dealt: tuple[str, ...] = ()) -> DataFrame:
    """Run ``sql`` over the driver's tables and the views above; no temporary views are left behind.

    Rows of the tables in ``dealt`` are dealt over all tasks: a small file of many rows is one task, whatever is made of a row.
    """
    hint = f"/*+ REPARTITION({spark.conf.get('spark.sql.shuffle.partitions')}) */ "
    views = _needs("spark", sql)
    text = " ".join([sql, *[SPARK_VIEWS[v] for v in views]])
    ctes = [f"{t} as (select {hint if t in dealt else ''}* from parquet.`{sf}/{t}.parquet`)" for t in TABLES if re.search(rf"\b{t}\b", text)]
    ctes += [f"{v} as ({SPARK_VIEWS[v]})" for v in views]
    return spark.sql("with " + ",\n".join(ctes) + "\n" + sql)


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return query(spark, sf, f"select * from {name}")
