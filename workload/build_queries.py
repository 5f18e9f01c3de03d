"""Import resolution, test pairing, caps, entry points and tours over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.operators import build as B
from lodemap.operators import paths as P
from lodemap.operators import resolve as R
from lodemap.plans.cut import cut
from workload.graph_queries import COLLAPSED, DEGREES, sql_case, sql_list
from workload.path_queries import LAYER_SQL, NODE_ID, file_nodes
from workload.views import duck, query, view

SPECS = """select repo_id, importer as path, target_path, spec as source,
 cast(row_number() over (partition by repo_id, importer order by spec) as int) as decl_seq from v_specs"""


def imports(spark, sf, sql=SPECS):
    return query(spark, sf, sql).select("repo_id", "path", "decl_seq", "source",
                                        F.array().cast("array<string>").alias("specifiers"), F.lit("typescript").alias("language"))


def files(spark, sf):
    return view(spark, sf, "v_files").select("repo_id", "path")


def q_tsjs(spark, sf):
    return R.resolve_tsjs(imports(spark, sf), files(spark, sf)).select("repo_id", "path", "target")


# A TypeScript specifier that keeps .py or .md is an exact path; all 4,088 at sf0.01 have one target.
S_TSJS = duck("select repo_id, importer as path, target_path as target from v_specs")

# The same imports spelled through a configured alias: "@/<target without extension>", one config per repository.
ALIAS_SPECS = """select repo_id, importer as path, 0 as decl_seq_, '@' || (case when target_path like 'app/%' then 'app' else 'all' end)
 || '/' || (case when target_path like 'app/%' then substr(target_path, 5, length(target_path) - 7) else
 substr(target_path, 1, length(target_path) - 3) end) as source, target_path,
 cast(row_number() over (partition by repo_id, importer order by target_path) as int) as decl_seq
 from v_imports where target_path like '%.ts' and target_path not like '%.test.ts'"""


def q_alias(spark, sf):
    configs = query(spark, sf, """select repo_id, 'tsconfig.json' as path, '// aliases of ' || cast(count(*) as string) || chr(10)
 || '{"compilerOptions": {"baseUrl": "./", /* order */ "paths": {"@none/*": ["nowhere/*"], "@app/*": ["missing/*", "app/*"],
 "@all/*": ["./*"],},}}' as content from v_files group by repo_id""")
    return R.resolve_tsjs(imports(spark, sf, ALIAS_SPECS), files(spark, sf), R.ts_configs(configs)).select(
        "repo_id", "path", "target")


S_ALIAS = duck("select repo_id, importer as path, target_path as target from v_imports where target_path like '%.ts'"
               " and target_path not like '%.test.ts'")

PATH_SPECS = """select repo_id, importer as path, target_path, cast(row_number() over (partition by repo_id, importer order by target_path) as int)
 as decl_seq, case dst_key % 4 when 0 then '/' || target_path || '#top' when 1 then target_path || '?raw=1' when 2 then
 (case when importer like 'app/%' then '../' else '../../' end) || target_path else '../../../../' || target_path end as source from v_imports"""


def q_path(spark, sf):
    return R.resolve_path(imports(spark, sf, PATH_SPECS).withColumn("language", F.lit("markdown")), files(spark, sf)).select(
        "repo_id", "path", "target")


S_PATH = duck("select repo_id, importer as path, target_path as target from v_imports where dst_key % 4 < 3")

PY_IMPORTS = """select i.repo_id, importer as path, target_path, '.' || replace(substr(target_path, 1, length(target_path) - 3), '/', '.') as dotted,
 cast(row_number() over (partition by i.repo_id, importer order by target_path) as int) as decl_seq from v_imports i
 where target_path like '%.py'"""


def q_python(spark, sf):
    # Half of them absolute (found below the src and lib roots too), half relative to the top package.
    raw = query(spark, sf, PY_IMPORTS)
    depth = F.size(F.split("path", "/")) - 1
    rel = F.concat(F.repeat(F.lit("."), depth + 1), F.substring(F.col("dotted"), 2, F.length("dotted")))
    absolute = F.regexp_replace(F.substring(F.col("dotted"), 2, F.length("dotted")), r"^(src|lib)\.", "")
    imps = raw.select("repo_id", "path", "decl_seq", F.when(F.length("target_path") % 2 == 0, rel).otherwise(absolute).alias("source"),
                      F.array(F.lit("x")).alias("specifiers"), F.lit("python").alias("language"))
    return R.resolve_python(imps, files(spark, sf)).select("repo_id", "path", "target")


S_PYTHON = duck("select repo_id, importer as path, target_path as target from v_imports where target_path like '%.py'")


def q_unresolved(spark, sf):
    broken = """select repo_id, importer as path, cast(row_number() over (partition by repo_id, importer order by spec) as int) as decl_seq,
 case when length(spec) % 3 = 0 then spec || '_gone' else spec end as source from v_specs"""
    imps = imports(spark, sf, broken)
    return R.unresolved(imps, R.resolve_tsjs(imps, files(spark, sf))).select("repo_id", "category", "n")


S_UNRESOLVED = duck("select repo_id, 'unresolved-import' as category, count(*) as n from v_specs where length(spec) % 3 = 0 group by 1")


def q_file_imports(spark, sf):
    imps = imports(spark, sf)
    pairs = R.file_imports(R.resolve_tsjs(imps, files(spark, sf)))
    return pairs.groupBy("repo_id", "path").agg(F.count("*").alias("n"))


S_FILE_IMPORTS = duck("select repo_id, importer as path, count(*) as n from v_imports where importer <> target_path group by 1, 2")


def q_reference(spark, sf):
    i = view(spark, sf, "v_imports").select("repo_id", F.col("importer").alias("path"), F.col("target_path").alias("target"))
    return B.reference_edges(i, file_nodes(spark, sf)).select("repo_id", "source", "target", "type", "weight")


S_REFERENCE = duck(f"""select repo_id, {NODE_ID.replace('path', 'importer')} as source, {NODE_ID.replace('path', 'target_path')} as target,
 case when importer like '%.md' then 'documents' else 'imports' end as type,
 case when importer like '%.md' then 0.5 else 0.7 end as weight from v_imports""")


# --- tests ---------------------------------------------------------------------

def pair_nodes(spark, sf):
    f = view(spark, sf, "v_pair_files").distinct().withColumn("size_lines", F.lit(1))
    return B.file_nodes(P.with_category(P.with_language(f)))


GIVEN = """select repo_id, 'file:' || path as source, 'file:' || min(path) over (partition by repo_id) as target from v_files
 where path like '%.test.ts' and p_partkey % 4 = 0 union all
 select repo_id, 'file:' || path, 'file:' || max(path) over (partition by repo_id) from v_files where p_partkey % 50 = 0 and path like '%.ts'"""


def linked(spark, sf):
    given = query(spark, sf, GIVEN)
    edges = given.select("repo_id", "source", "target", F.lit("tested_by").alias("type"), F.lit("forward").alias("direction"),
                         F.lit(None).cast("string").alias("description"), F.lit(0.5).alias("weight"),
                         F.monotonically_increasing_id().alias("edge_ord"))
    return B.link_tests(cut(pair_nodes(spark, sf)), cut(edges))


def q_pairs(spark, sf):
    return linked(spark, sf)[2]


PAIRS = f"""f as (select distinct repo_id, path, 'file:' || path as id, path like '%.test.ts' as is_test from v_pair_files where path not like '%.md'),
 g as ({GIVEN}), t1 as (select distinct g.repo_id, case when a.is_test then g.target else g.source end as prod_id,
   case when a.is_test then g.source else g.target end as test_id
  from g join f a on a.repo_id = g.repo_id and a.id = g.source join f b on b.repo_id = g.repo_id and b.id = g.target
  where a.is_test <> b.is_test),
 c as (select f.repo_id, f.id as test_id, e.o, left(f.path, length(f.path) - 8) || e.x as cand from f,
  (values (0, '.ts'), (1, '.cjs'), (2, '.js'), (3, '.jsx'), (4, '.mjs'), (5, '.ts'), (6, '.tsx'), (7, '.vue')) e(o, x)
  where f.is_test and not exists (select 1 from t1 where t1.repo_id = f.repo_id and t1.test_id = f.id)),
 t2 as (select c.repo_id, c.test_id, arg_min(p.id, c.o) as prod_id from c join f p on p.repo_id = c.repo_id and p.path = c.cand
  and not p.is_test group by 1, 2),
 pairs as (select repo_id, prod_id, test_id from t1 union all select repo_id, prod_id, test_id from t2)"""
S_PAIRS = duck(f"with {PAIRS} select * from pairs")


def q_tested(spark, sf):
    return linked(spark, sf)[0].filter(F.array_contains("tags", "tested")).select("repo_id", "id")


S_TESTED = duck(f"with {PAIRS} select distinct repo_id, prod_id as id from pairs")


def q_entry(spark, sf):
    return B.entry_points(view(spark, sf, "v_pair_files"))


S_ENTRY = duck("""with c as (select distinct repo_id, path, case path when 'src/index.ts' then 0 when 'main.py' then 4
  when 'cmd/tool/main.go' then 100 end as o from v_pair_files)
 select repo_id, arg_min(path, o) as path from c where o is not null group by 1""")

# --- dedupe, caps, tour -----------------------------------------------------------


def q_dedupe(spark, sf):
    nodes = query(spark, sf, "select repo_id, 'x' || cast(p_partkey % 700 as string) as id, p_partkey as node_ord from v_files")
    edges = query(spark, sf, "select l_suppkey % 3 as repo_id, l_partkey % 50 as source, l_suppkey % 40 as target, l_returnflag as type,"
                             " l_orderkey * 1000 + l_linenumber * 10 + l_quantity / 100 as edge_ord from lineitem")
    n, e = B.dedupe(nodes, edges)
    return n.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum("node_ord").alias("s")).withColumn("what", F.lit("nodes")).unionByName(
        e.groupBy("repo_id").agg(F.count("*").alias("n"), F.sum(F.floor("edge_ord")).alias("s")).withColumn("what", F.lit("edges")))


S_DEDUPE = duck("""with n as (select repo_id, 'x' || (p_partkey % 700) as id, min(p_partkey) as o from v_files group by 1, 2),
 e as (select l_suppkey % 3 as repo_id, l_partkey % 50 as source, l_suppkey % 40 as target, l_returnflag,
  min(l_orderkey * 1000 + l_linenumber * 10 + l_quantity / 100) as o from lineitem where l_partkey % 50 <> l_suppkey % 40 group by 1, 2, 3, 4)
 select repo_id, count(*) as n, cast(sum(o) as bigint) as s, 'nodes' as what from n group by 1
 union all select repo_id, count(*), cast(sum(floor(o)) as bigint), 'edges' from e group by 1""")


def q_cap_nodes(spark, sf):
    n, e, issues = B.cap_nodes(view(spark, sf, "v_nodes"), view(spark, sf, "v_repo_edges"), 400)
    return (
        n.select("repo_id", F.lit("node").alias("what"), F.col("id").alias("v"))
        .unionByName(e.select("repo_id", F.lit("edge").alias("what"), F.concat_ws(" ", "source", "type", "target").alias("v")))
        .unionByName(issues.select("repo_id", F.lit("issue").alias("what"), F.col("message").alias("v")))
    )


S_CAP_NODES = duck(f"""with k as (select * from (select *, row_number() over (partition by repo_id
  order by type not in {sql_list(dims.FILE_LEVEL_TYPES)}, id) as rn from v_nodes) where rn <= 400)
 select repo_id, 'node' as what, id as v from k union all
 select e.repo_id, 'edge', source || ' ' || e.type || ' ' || target from v_repo_edges e
  join k a on a.repo_id = e.repo_id and a.id = source join k b on b.repo_id = e.repo_id and b.id = target union all
 select repo_id, 'issue', 'This project has more than 400 nodes. ' || (count(*) - 400) || ' sub-file node'
  || case when count(*) = 401 then '' else 's' end || ' did not fit; all files stayed.' from v_nodes group by 1 having count(*) > 400""")


def q_cap_edges(spark, sf):
    e = view(spark, sf, "v_repo_edges").withColumn("weight", B.weight_of("type")).withColumn("edge_ord", F.lit(0))
    kept, issues = B.cap_edges(e, 3000)
    return kept.groupBy("repo_id", "type").agg(F.count("*").alias("n")).unionByName(
        issues.select("repo_id", F.col("message").alias("type"), F.lit(1).cast("long").alias("n")))


S_CAP_EDGES = duck(f"""with k as (select * from (select *, row_number() over (partition by repo_id
  order by {sql_case('type', dims.EDGE_WEIGHT)} desc, type, source, target) as rn from v_repo_edges) where rn <= 3000)
 select repo_id, type, count(*) as n from k group by 1, 2 union all
 select repo_id, 'More than 3000 edges. ' || (count(*) - 3000) || ' with the least weight did not fit.', 1 from v_repo_edges group by 1 having count(*) > 3000""")


def q_tour(spark, sf):
    nodes = cut(file_nodes(spark, sf))
    i = view(spark, sf, "v_imports").select("repo_id", F.col("importer").alias("path"), F.col("target_path").alias("target"))
    edges = B.reference_edges(i, nodes)
    table, members = (cut(t) for t in B.layers(nodes))
    entry = view(spark, sf, "v_files").filter("repo_id < 3").groupBy("repo_id").agg(F.max("path").alias("path"))
    return B.tour(nodes, edges, table, members, entry).select(
        "repo_id", "step_order", "title", "description", F.array_join("node_ids", ",").alias("node_ids"))


S_TOUR = duck(f"""with n as (select repo_id, path, {NODE_ID} as id, {LAYER_SQL} as layer from v_files),
 e as (select repo_id, importer as p from v_imports union all select repo_id, target_path from v_imports),
 d as (select n.*, count(e.p) as deg from n left join e on e.repo_id = n.repo_id and e.p = n.path group by all),
 o as (select repo_id, max(path) as path from n where repo_id < 3 group by 1 union all
  select repo_id, path from (select *, row_number() over (partition by repo_id order by deg desc, path) as rn from d where repo_id >= 3) where rn = 1),
 r as (select d.*, row_number() over (partition by d.repo_id, layer order by deg desc, id) as rn from d
  where not exists (select 1 from o where o.repo_id = d.repo_id and o.path = d.path)),
 t as (select repo_id, layer, string_agg(id, ',' order by rn) as ids from r where rn <= 4 group by 1, 2),
 c as (select repo_id, layer, count(*) as m from n group by 1, 2),
 s as (select d.repo_id, 0 as k, 'Start here' as title, 'What the project says of itself.' as description, d.id as ids
   from o join d on d.repo_id = o.repo_id and d.path = o.path union all
  select t.repo_id, {sql_case('t.layer', {n: i + 1 for i, n in enumerate(dims.TOUR_ORDER)})}, t.layer,
   {sql_case('t.layer', dims.LAYER_DESCRIPTION)} || '. ' || c.m || case when c.m = 1 then ' file' else ' files' end
   || ' here; these have the most connections.', t.ids from t join c on c.repo_id = t.repo_id and c.layer = t.layer)
 select repo_id, cast(row_number() over (partition by repo_id order by k) as integer) as step_order, title, description, ids as node_ids from s""")

MANIFESTS = """select p_partkey % 40 as repo_id, case p_partkey % 4 when 0 then 'package.json' when 1 then 'svc' || cast(p_size as varchar(20)) || '/package.json'
 when 2 then 'requirements.txt' else 'pyproject.toml' end as path,
 max(case p_size % 5 when 0 then '{"dependencies": {"React": 1}}' when 1 then 'Django==4' when 2 then '{"express": 1}' when 3 then 'uvicorn flask' else 'none' end) as content
 from part group by 1, 2"""


def q_frameworks(spark, sf):
    return B.frameworks(query(spark, sf, MANIFESTS)).select("repo_id", "framework", "framework_ord")


S_FRAMEWORKS = duck(f"""with m as ({MANIFESTS}),
 j as (select repo_id, lower(arg_min(content, (case when path = 'package.json' then '0' else '1' end) || path)) as t
  from m where path like '%package.json' group by 1),
 p as (select repo_id, lower(arg_min(content, case when path = 'requirements.txt' then 0 else 1 end)) as t from m
  where path in ('requirements.txt', 'pyproject.toml') group by 1)
 select repo_id, f as framework, cast(o as integer) as framework_ord from j, (values ('React', 3, 'react'), ('Next.js', 4, '"next":'), ('Express', 5, '"express":'), ('Vue', 6, 'vue')) v(f, o, k)
  where contains(t, k) union all
 select repo_id, f, cast(o as integer) from p, (values ('Django', 0, 'django'), ('FastAPI', 1, 'uvicorn'), ('Flask', 2, 'flask')) v(f, o, k) where contains(t, k)""")

QUERIES = {
    "resolve_tsjs": (q_tsjs, S_TSJS),
    "resolve_alias": (q_alias, S_ALIAS),
    "resolve_path": (q_path, S_PATH),
    "resolve_python": (q_python, S_PYTHON),
    "unresolved_imports": (q_unresolved, S_UNRESOLVED),
    "file_imports": (q_file_imports, S_FILE_IMPORTS),
    "reference_edges": (q_reference, S_REFERENCE),
    "test_pairs": (q_pairs, S_PAIRS),
    "tested_tag": (q_tested, S_TESTED),
    "entry_points": (q_entry, S_ENTRY),
    "dedupe": (q_dedupe, S_DEDUPE),
    "cap_nodes": (q_cap_nodes, S_CAP_NODES),
    "cap_edges": (q_cap_edges, S_CAP_EDGES),
    "tour": (q_tour, S_TOUR),
    "frameworks": (q_frameworks, S_FRAMEWORKS),
}
