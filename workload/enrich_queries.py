"""Description jobs, sources and exports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.operators import build as B
from lodemap.operators import enrich as E
from lodemap.operators import graph as G
from lodemap.sources import corpus as C
from lodemap.sources import documents as D
from workload import extract_queries as XQ
from workload.graph_queries import COLLAPSED, DEGREES, edges, nodes, sql_case, sql_list
from workload.views import duck, query, table, view


def full_nodes(spark, sf):
    n = nodes(spark, sf)
    return n.select(
        "repo_id", "id", "type", "name", F.concat("name", F.lit("/"), "id").alias("file_path"),
        F.when(F.col("type") == "function", F.length("id")).cast("int").alias("line_start"), F.when(F.col("type") == "function", F.length("id") + 4).cast("int").alias("line_end"),
        F.when(F.col("id").endswith("3"), "Told before.").otherwise(dims.PENDING_SUMMARY).alias("summary"),
        F.when(F.col("id").endswith("4"), F.array(F.lit("tested"), F.lit("entry-point"))).otherwise(F.array(F.lit("x"))).alias("tags"), F.lit("simple").alias("complexity"))


FULL = """fn as (select repo_id, id, type, name, name || '/' || id as file_path, case when type = 'function' then length(id) end as ls from v_nodes)"""


def q_pending(spark, sf):
    return E.pending(full_nodes(spark, sf)).select("repo_id", "id", "fingerprint")


S_PENDING = duck(f"""with {FULL} select repo_id, id, sha256(id || '|' || name || '|' || type || '|simple|' || file_path || '|' || coalesce(ls || '-' || (ls + 4), '')) as fingerprint
 from fn where id not like '%3'""")


def q_replay(spark, sf):
    n = E.pending(full_nodes(spark, sf))
    j = n.select("repo_id", F.col("id").alias("node_id"), F.when(F.col("id").endswith("1"), F.lit("old")).otherwise(F.col("fingerprint")).alias("fingerprint"),
                 F.col("name").alias("summary"), F.array(F.lit("t")).alias("tags")).filter("node_id like '%1' or node_id like '%2'")
    return E.replay(n, j).select("repo_id", "id", "summary")


S_REPLAY = duck("select repo_id, id, name as summary from v_nodes where id like '%2'")


def q_batches(spark, sf):
    return E.batches(E.pending(full_nodes(spark, sf)), 14).select("repo_id", "id", "batch_no", "item_no")


S_BATCHES = duck(f"""with {FULL}, r as (select repo_id, id, row_number() over (partition by repo_id order by file_path, id) - 1 as p from fn where id not like '%3')
 select repo_id, id, cast(p // 14 + 1 as bigint) as batch_no, cast(p % 14 + 1 as integer) as item_no from r""")


def q_facts(spark, sf):
    return E.facts(full_nodes(spark, sf), edges(spark, sf)).select("repo_id", "id", F.array_join("facts", "; ").alias("facts"))


S_FACTS = duck(f"""with {FULL}, o as (select repo_id, source as id, count(*) as n, array_to_string(list_sort(list(distinct type))[1:4], ', ') as k from v_repo_edges group by 1, 2),
 i as (select repo_id, target as id, count(*) as n from v_repo_edges group by 1, 2)
 select fn.repo_id, fn.id, concat_ws('; ', case when ls is not null then '5 lines' end, 'complexity: simple', case when fn.id like '%4' then 'covered by tests; an entry point' end,
  case when o.n > 0 then o.n || ' outgoing (' || o.k || ')' end, case when i.n > 0 then 'used by ' || i.n end) as facts
 from fn left join o on o.repo_id = fn.repo_id and o.id = fn.id left join i on i.repo_id = fn.repo_id and i.id = fn.id""")

SPANS = """select doc_id % 9 as repo_id, 'f' || cast(doc_id as varchar(20)) || ':' || cast(k as varchar(20)) as id, cast(doc_id as varchar(20)) as file_path,
 cast(case when k = 0 then null else k * 2 end as int) as line_start, cast(k * 2 + 5 as int) as line_end from documents, (select 0 as k union all select 1 union all select 3) s"""


def q_excerpts(spark, sf):
    # Three nodes per document: its head and two spans.
    docs = table(spark, sf, "documents").select((F.col("doc_id") % 9).alias("repo_id"), F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))
    spans = docs.select("repo_id", "path", F.explode(F.array(F.lit(0), F.lit(1), F.lit(3))).alias("k")).select(
        "repo_id", F.concat(F.lit("f"), "path", F.lit(":"), F.col("k").cast("string")).alias("id"), F.col("path").alias("file_path"),
        F.when(F.col("k") > 0, F.col("k") * 2).cast("int").alias("line_start"))
    return E.excerpts(spans, docs, 500).select("repo_id", "id", F.sha2("excerpt", 256).alias("digest"))


S_EXCERPTS = """with s as (select doc_id % 9 as repo_id, doc_id, text, unnest([0, 1, 3]) as k from documents),
 e as (select repo_id, 'f' || doc_id || ':' || k as id, array_to_string(string_split(text, chr(10))[case when k = 0 then 1 else k * 2 end : case when k = 0 then 60 else k * 2 + 59 end], chr(10)) as t from s)
 select repo_id, id, sha256(case when length(t) > 500 then left(t, 500) || chr(10) || '…' else t end) as digest from e where not regexp_matches(t, '^\\s*$')"""


def q_requests(spark, sf):
    n = E.batches(E.pending(full_nodes(spark, sf)), 14)
    items = E.facts(n, edges(spark, sf)).withColumn("excerpt", F.lit(None).cast("string"))
    projects = n.select("repo_id").distinct().select("repo_id", F.lit("P").alias("name"), F.lit("d").alias("description"), F.array(F.lit("go")).alias("languages"))
    return E.requests(items, projects).select("repo_id", "batch_no", F.size("node_ids").cast("long").alias("n"), F.element_at("node_ids", 1).alias("first_id"),
                                              F.size(F.split("prompt", "\nid: ")).cast("long").alias("n_blocks"))


S_REQUESTS = duck(f"""with {FULL}, r as (select repo_id, id, row_number() over (partition by repo_id order by file_path, id) - 1 as p from fn where id not like '%3')
 select repo_id, cast(p // 14 + 1 as bigint) as batch_no, count(*) as n, arg_min(id, p) as first_id, count(*) + 1 as n_blocks from r group by 1, 2""")

# A response per order: fenced, prefixed, broken or plain, about items of which one was not asked for.
RESPONSES = """select o_custkey % 5 as repo_id, o_orderkey as request_id, case o_orderkey % 5 when 0 then 'Here it is: ' when 1 then '```json' || chr(10) else '' end
 || '{"items": [{"id": "a' || cast(o_orderkey as varchar(20)) || '", "summary": "  Uses {braces} and \\\\"quotes\\\\" ' || o_orderpriority || '", "tags": ["One ", "two", "", "3", "4", "5", "6"]}, '
 || '{"id": "zz", "summary": "not asked"}, {"id": "b", "summary": " "}' || case when o_orderkey % 7 = 0 then ', 5' else '' end || ']}'
 || case o_orderkey % 5 when 1 then chr(10) || '```' when 2 then ' done }' when 3 then '' else '' end as text from orders"""


def q_responses(spark, sf):
    r = query(spark, sf, RESPONSES)
    asked = r.select("repo_id", "request_id", F.explode(F.array(F.concat(F.lit("a"), F.col("request_id").cast("string")), F.lit("b"))).alias("id"))
    return E.parse_responses(r, asked).select("repo_id", "request_id", "id", "summary", F.array_join("tags", ",").alias("tags"))


S_RESPONSES = """select o_custkey % 5 as repo_id, o_orderkey as request_id, 'a' || o_orderkey as id, 'Uses {braces} and "quotes" ' || o_orderpriority as summary, 'one,two,3,4,5' as tags
 from orders where o_orderkey % 7 <> 0"""


def q_plain_text(spark, sf):
    # Turns of conversations hold no JSON object with items, so nothing may come out of them.
    turns = table(spark, sf, "conversations").select((F.col("conv_id") % 5).alias("repo_id"), F.col("conv_id").alias("request_id"), F.col("text"))
    asked = turns.select("repo_id", "request_id", F.lit("a").alias("id"))
    out = E.parse_responses(turns, asked)
    return turns.groupBy("repo_id").agg(F.count("*").alias("n_turns")).join(out.groupBy("repo_id").agg(F.count("*").alias("n_found")), "repo_id", "left").select(
        "repo_id", "n_turns", F.coalesce("n_found", F.lit(0)).alias("n_found"))


S_PLAIN_TEXT = "select conv_id % 5 as repo_id, count(*) as n_turns, cast(0 as bigint) as n_found from conversations group by 1"


def q_apply(spark, sf):
    d = nodes(spark, sf).filter("id like '%4'").select("repo_id", "id", F.col("name").alias("summary"), F.array(*[F.lit(t) for t in ("tested", "a", "b", "c", "d", "e", "f", "g")]).alias("tags"))
    return E.apply_descriptions(full_nodes(spark, sf), d).select("repo_id", "id", "summary", F.array_join("tags", ",").alias("tags"))


S_APPLY = duck("""select repo_id, id, case when id like '%4' then name when id like '%3' then 'Told before.' else 'Not yet analyzed.' end as summary,
 case when id like '%4' then 'tested,entry-point,a,b,c,d,e,f' else 'x' end as tags from v_nodes""")

NARRATIVE = """select n_nationkey as repo_id, 'layers' as kind, '{"layers": [{"id": "LAYER-core", "description": "  Everything about ' || n_name || ' that starts the program. "}, {"id": "api layer", "description": "API Layer"}]}' as text from nation
 union all select n_nationkey, 'steps', '{"steps": [{"order": 2, "title": "' || n_name || '", "description": ""}, {"order": "3", "title": "no"}]}' from nation"""


def q_narrative(spark, sf):
    layers = query(spark, sf, "select n_nationkey as repo_id, 'layer:core' as layer_id, 'Core' as name, 'old' as description from nation union all"
                              " select n_nationkey, 'layer:api-layer', 'API Layer', 'old api' from nation")
    tour = query(spark, sf, "select n_nationkey as repo_id, s as step_order, 'T' as title, 'D' as description from nation, (select 2 as s union all select 3) x")
    a, b = E.apply_narrative(layers, tour, query(spark, sf, NARRATIVE))
    return a.select("repo_id", F.col("layer_id").alias("what"), "description").unionByName(
        b.select("repo_id", F.concat("title", F.col("step_order").cast("string")).alias("what"), "description"))


S_NARRATIVE = """select n_nationkey as repo_id, 'layer:core' as what, 'Everything about ' || n_name || ' that starts the program.' as description from nation
 union all select n_nationkey, 'layer:api-layer', 'old api' from nation union all select n_nationkey, n_name || '2', 'D' from nation union all select n_nationkey, 'T3', 'D' from nation"""

# A business map per customer: two domains that share a node, a flow of two steps, an entry without a name.
DOMAIN_TEXT = """select c_custkey as repo_id, 'Sure: {"domains": [{"name": " ' || c_mktsegment || ' Sales! ", "summary": "s", "nodeIds": ["n1", "nope"], "flows": [{"name": "Check out", "steps": [{"name": "Pay", "nodeId": "n1"}, {"summary": "x"}, {"name": "Ship ' || cast(c_nationkey as varchar(20)) || '"}]}, {"steps": []}]}, {"summary": "none"}, {"name": "Stock", "nodeIds": ["n1"]}]}' as text from customer"""


def domains(spark, sf):
    known = query(spark, sf, "select c_custkey as repo_id, 'n1' as id from customer where c_custkey % 3 > 0")
    return E.domain_graph(query(spark, sf, DOMAIN_TEXT), known)


def q_domain_nodes(spark, sf):
    return domains(spark, sf)[0].select("repo_id", "id", "type", "name")


_D = "lower(c_mktsegment) || '-sales'"
S_DOMAIN_NODES = f"""with c as (select *, 'domain:' || {_D} as d from customer)
 select c_custkey as repo_id, d as id, 'domain' as type, c_mktsegment || ' Sales!' as name from c union all select c_custkey, 'domain:stock', 'domain', 'Stock' from c
 union all select c_custkey, d || ':flow:check-out', 'flow', 'Check out' from c union all select c_custkey, d || ':flow:check-out:step:0-pay', 'step', 'Pay' from c
 union all select c_custkey, d || ':flow:check-out:step:1-ship-' || c_nationkey, 'step', 'Ship ' || c_nationkey from c"""


def q_domain_edges(spark, sf):
    return domains(spark, sf)[1]


S_DOMAIN_EDGES = f"""with c as (select *, 'domain:' || {_D} as d, 'domain:' || {_D} || ':flow:check-out' as f from customer), e as (
 select c_custkey, d as s, f as t, 'contains_flow' as k, 1.0 as w from c union all select c_custkey, f, f || ':step:0-pay', 'flow_step', 0.9 from c
 union all select c_custkey, f, f || ':step:1-ship-' || c_nationkey, 'flow_step', 0.9 from c union all select c_custkey, f || ':step:0-pay', f || ':step:1-ship-' || c_nationkey, 'flow_step', 0.7 from c
 union all select c_custkey, d, 'n1', 'depends_on', 0.6 from c where c_custkey % 3 > 0 union all select c_custkey, 'domain:stock', 'n1', 'depends_on', 0.6 from c where c_custkey % 3 > 0
 union all select c_custkey, f || ':step:0-pay', 'n1', 'depends_on', 0.5 from c where c_custkey % 3 > 0 union all select c_custkey, d, 'domain:stock', 'cross_domain', 0.6 from c where c_custkey % 3 > 0)
 select c_custkey as repo_id, s as source, t as target, k as type, cast(w as double) as weight from e"""


def q_replace(spark, sf):
    old = query(spark, sf, "select c_custkey as repo_id, 'domain:old' as id, 'domain' as type from customer union all select c_custkey, 'n1', 'file' from customer")
    old_edges = query(spark, sf, "select c_custkey as repo_id, 'domain:old' as source, 'n1' as target, 'depends_on' as type from customer")
    new = query(spark, sf, "select c_custkey as repo_id, 'domain:new' as id, 'domain' as type from customer where c_custkey % 2 = 0")
    new_edges = query(spark, sf, "select c_custkey as repo_id, 'domain:new' as source, 'n1' as target, 'depends_on' as type from customer where c_custkey % 2 = 0")
    n, e = E.replace_domains(old, old_edges, new, new_edges)
    return n.select("repo_id", "id").unionByName(e.select("repo_id", F.concat_ws(">", "source", "target").alias("id")))


S_REPLACE = """with d as (select c_custkey as r, case when c_custkey % 2 = 0 then 'domain:new' else 'domain:old' end as d from customer)
 select r as repo_id, d as id from d union all select r, 'n1' from d union all select r, d || '>n1' from d"""


def q_explain(spark, sf):
    return E.explain_context(edges(spark, sf), nodes(spark, sf).filter("type <> 'function'"), 24).select("repo_id", "seed", "id", "pos", "relation")


S_EXPLAIN = duck(f"""with c as (select repo_id, source, target, min(type) as o from v_repo_edges where source <> target group by 1, 2, 3),
 a as (select repo_id, source as seed, target as id, o from c union all select repo_id, target, source, o from c),
 r as (select a.*, row_number() over (partition by a.repo_id, seed order by o, a.id) as pos from a join v_nodes n on n.id = a.seed where n.type <> 'function')
 select r.repo_id, seed, r.id, pos, case when exists (select 1 from c where c.source = r.seed and c.target = r.id) then replace(o, '_', ' ') else 'is ' || replace(o, '_', ' ') || ' by' end as relation
 from r where pos <= 24""")


def q_ask(spark, sf):
    return E.ask_context(nodes(spark, sf), edges(spark, sf), {"hit": "france", "none": "qqqq xxzz"}, 18)


S_ASK = duck(f"""with {COLLAPSED}, {DEGREES}, h as (select repo_id, id from v_nodes where lower(name) = 'france'),
 a as (select repo_id, source as seed, target as id, type from collapsed union all select repo_id, target, source, type from collapsed),
 m as (select a.repo_id, a.id, row_number() over (partition by a.repo_id, seed order by a.type, a.id) as rn from a join h on h.repo_id = a.repo_id and h.id = a.seed),
 f as (select repo_id, 'hit' as query_id, id, 1 as pos from h union all select repo_id, 'hit', id, rn + 1 from m where rn <= 6),
 d as (select repo_id, id, row_number() over (partition by repo_id order by degree desc, id) as pos from deg)
 select * from f union all select repo_id, 'none', id, pos from d where pos <= 18
 union all select repo_id, 'hit', id, pos from d where pos <= 18 and repo_id not in (select repo_id from h)""")


def q_domain_context(spark, sf):
    return E.domain_context(nodes(spark, sf), edges(spark, sf), 220).select("repo_id", "id", "degree", "pos")


S_DOMAIN_CONTEXT = duck("""with e as (select repo_id, source as id from v_repo_edges union all select repo_id, target from v_repo_edges),
 d as (select n.repo_id, n.id, count(e.id) as degree from v_nodes n left join e on e.repo_id = n.repo_id and e.id = n.id where n.type in ('file', 'class') group by 1, 2)
 select * from (select repo_id, id, degree, row_number() over (partition by repo_id order by degree desc, id desc) as pos from d) where pos <= 220""")


# --- sources and exports -------------------------------------------------------------------------

def docs(spark, sf):
    return view(spark, sf, "v_snap_old")


def q_probe(spark, sf):
    return C.probe_files(docs(spark, sf)).select("repo_id", "path", "language", "category", "size_lines", "content_hash", "n_bytes")


S_PROBE = duck("""select repo_id, path, 'txt' as language, 'docs' as category, cast(length(content) - length(replace(content, chr(10), '')) as integer) as size_lines,
 sha256(content) as content_hash, cast(strlen(content) as bigint) as n_bytes from v_snap_old""")


def q_digest(spark, sf):
    # Equal inputs in another order digest alike; any change shows. Compared by repository against a changed copy.
    a = C.content_digest(C.probe_files(docs(spark, sf)))
    b = C.content_digest(C.probe_files(docs(spark, sf).orderBy(F.desc("path"))))
    c = C.content_digest(C.probe_files(docs(spark, sf).withColumn("content", F.when(F.col("repo_id") % 2 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")))))
    return a.join(b.withColumnRenamed("content_digest", "b"), "repo_id").join(c.withColumnRenamed("content_digest", "c"), "repo_id").select(
        "repo_id", (F.col("content_digest") == F.col("b")).alias("same"), (F.col("content_digest") != F.col("c")).alias("changed"))


S_DIGEST = duck("select distinct repo_id, true as same, repo_id % 2 = 0 as changed from v_snap_old")


def q_cap_files(spark, sf):
    kept, issues = C.cap_files(view(spark, sf, "v_files").select("repo_id", "path"), 285)
    return kept.unionByName(issues.select("repo_id", F.col("message").alias("path")))


S_CAP_FILES = duck("""select repo_id, path from (select repo_id, path, row_number() over (partition by repo_id order by path) as rn from v_files) where rn <= 285
 union all select repo_id, 'Project has ' || count(*) || ' files; analyzing the first 285.' from v_files group by 1 having count(*) > 285""")

PROJECT_FILES = """select c_custkey as repo_id, case c_custkey % 5 when 0 then 'package.json' when 1 then 'sub/pyproject.toml' when 2 then 'go.mod' when 3 then 'Cargo.toml' else 'setup.py' end as path,
 case c_custkey % 5 when 0 then '{"name": "' || c_name || '", "description": ' || case when c_custkey % 2 = 0 then '"web"' else '7' end || '}' when 1 then '[project]' || chr(10) || 'name = "A' || cast(c_custkey as varchar(20)) || '"'
 when 2 then '// m' || chr(10) || 'module ex.org/' || lower(c_mktsegment) when 3 then 'description = ''d''' else 'x' end as content from customer"""


def q_identity(spark, sf):
    folders = query(spark, sf, "select c_custkey as repo_id, 'folder' || cast(c_custkey as string) as folder from customer")
    return C.project_identity(folders, C.manifests(query(spark, sf, PROJECT_FILES)))


S_IDENTITY = """select c_custkey as repo_id, case c_custkey % 5 when 0 then c_name when 1 then 'A' || c_custkey when 2 then lower(c_mktsegment) else 'folder' || c_custkey end as name,
 case c_custkey % 5 when 0 then case when c_custkey % 2 = 0 then 'web' else 'A ' || c_name || ' project.' end when 1 then 'An A' || c_custkey || ' project.'
 when 2 then 'Go module ex.org/' || lower(c_mktsegment) || '.' when 3 then 'd' else 'A folder' || c_custkey || ' project.' end as description from customer"""


def q_stale(spark, sf):
    return C.stale_builds(query(spark, sf, "select c_custkey as repo_id, cast(case when c_custkey % 3 = 0 then null else c_custkey % 4 end as int) as analyzer_version from customer"), 2)


S_STALE = "select c_custkey as repo_id, cast(case when c_custkey % 3 = 0 then null else c_custkey % 4 end as integer) as analyzer_version from customer where c_custkey % 3 = 0 or c_custkey % 4 <> 2"


def q_compact_nodes(spark, sf):
    return D.export_compact(full_nodes(spark, sf), edges(spark, sf))[0].select("repo_id", "i", "n", "t", "d", "s", "g", "label")


S_COMPACT_NODES = duck(f"""with {COLLAPSED}, {DEGREES}, x as (select d.repo_id, d.id, d.degree, row_number() over (partition by d.repo_id order by d.id) - 1 as i from deg d),
 y as (select *, row_number() over (partition by repo_id order by degree desc, i) as r from x)
 select y.repo_id, y.i, n.name as n, n.type as t, y.degree as d, case when y.id like '%3' then 'Told before.' else '' end as s,
 case when y.id like '%4' then 'tested entry-point' else 'x' end as g, r <= 60 as label from y join v_nodes n on n.repo_id = y.repo_id and n.id = y.id""")


def q_compact_edges(spark, sf):
    return D.export_compact(full_nodes(spark, sf), edges(spark, sf))[1]


S_COMPACT_EDGES = duck(f"""with {COLLAPSED}, x as (select repo_id, id, row_number() over (partition by repo_id order by id) - 1 as i from v_nodes)
 select c.repo_id, a.i as a, b.i as b from collapsed c join x a on a.repo_id = c.repo_id and a.id = c.source join x b on b.repo_id = c.repo_id and b.id = c.target""")


# --- symbols ------------------------------------------------------------------------------------------

def q_symbols(spark, sf):
    t = XQ.X.extract(XQ.files(spark, sf))
    return B.symbol_nodes(t).select("repo_id", "id", "type", "complexity", F.array_join("tags", ",").alias("tags"))


_SYM = [  # (template, type, name, tags) of the symbols that are significant in XQ.TEMPLATES
    (0, "class", "C{k}", "exported,class"), (0, "function", "C{k}.m", "exported,function"), (0, "function", "f{k}", "exported,function"),
    (1, "class", "A{k}", "exported,class"), (1, "function", "A{k}.get", "exported,function"),
    (2, "class", "T{k}", "exported,class"), (2, "function", "Run", "exported,function"), (3, "table", "t{k}", "database,table"), (3, "table", "v{k}", "database,view"),
    (5, "service", "s{k}", "containerization,infrastructure,networking"), (5, "service", "app", "containerization,infrastructure"),
    (5, "step", "FROM base:{k} AS s{k}", "ci-cd,build-system"), (5, "step", "EXPOSE 80", "ci-cd,build-system"), (5, "step", "FROM reg/app:1", "ci-cd,build-system"),
    (6, "resource", "r.n{k}", "infrastructure,r"), (7, "schema", "M{k}", "schema-definition,message"), (7, "endpoint", "rpc S{k}.Get", "api-schema,endpoint"),
    (8, "function", "f{k}", "exported,function"), (11, "function", "go", "exported,function"), (11, "class", "I{k}", "exported,type-definition"),
]
_SYM_ROWS = ",\n ".join(f"({i}, '{t}', '{n}', '{g}')" for i, t, n, g in _SYM)
S_SYMBOLS = f"""with f as (select *, p_partkey % 7 as repo_id, {XQ._filled(f"(case p_partkey % {XQ.M} " + ' '.join(XQ._case(i, t[0]) for i, t in enumerate(XQ.TEMPLATES)) + " end)")} as path from part),
 w(i, ty, nm, tags) as (values {_SYM_ROWS})
 select repo_id, ty || ':' || path || ':' || replace(nm, '{{k}}', cast(p_partkey as varchar)) as id, ty as type, 'simple' as complexity, tags from f join w on f.p_partkey % {XQ.M} = w.i"""

# Calls between files: each order calls the function named like its customer's segment; a name may be defined often.
CALLS = "select o_custkey % 5 as repo_id, 'f' || cast(o_custkey % 97 as varchar(20)) as path, 'main' as caller, case when o_orderkey % 3 = 0 then 'u' || cast(o_orderkey % 211 as varchar(20)) else o_orderpriority end as callee, cast(min(o_orderkey) as int) as line from orders group by 1, 2, 4"
INDEX = """select distinct c_custkey % 5 as repo_id, 'main' as name, 'function:f' || cast(c_custkey % 97 as varchar(20)) || ':main' as id, 'f' || cast(c_custkey % 97 as varchar(20)) as path from customer
 union all select distinct o_custkey % 5, o_orderpriority, 'function:f' || cast(o_orderkey % 97 as varchar(20)) || ':' || o_orderpriority, 'f' || cast(o_orderkey % 97 as varchar(20)) from orders
 union all select distinct o_custkey % 5, 'u' || cast(o_orderkey % 211 as varchar(20)), 'function:g' || cast(o_orderkey % 3 as varchar(20)) || ':u' || cast(o_orderkey % 211 as varchar(20)), 'g' || cast(o_orderkey % 3 as varchar(20)) from orders"""
USES = "select distinct o_custkey % 5 as repo_id, 'f' || cast(o_custkey % 97 as varchar(20)) as path, 'f' || cast(o_orderkey % 89 as varchar(20)) as target from orders where o_orderkey % 4 = 0"


def q_calls(spark, sf):
    out = B.call_edges(query(spark, sf, CALLS), query(spark, sf, INDEX), query(spark, sf, USES))
    return out.select("repo_id", "source", "target", "type", "weight").distinct()


S_CALLS = f"""with c as ({CALLS}), x as ({INDEX}), u as ({USES}), k as (select c.*, 'function:' || path || ':' || caller as cid from c),
 v as (select k.* from k where exists (select 1 from x where x.repo_id = k.repo_id and x.id = k.cid)),
 near as (select distinct v.repo_id, v.path, v.cid, v.callee, x.id from v join x on x.repo_id = v.repo_id and x.name = v.callee
  where x.path = v.path or exists (select 1 from u where u.repo_id = v.repo_id and u.path = v.path and u.target = x.path)),
 one as (select repo_id, name, min(id) as id from x group by 1, 2 having count(*) = 1),
 far as (select v.repo_id, v.cid, o.id from v join one o on o.repo_id = v.repo_id and o.name = v.callee where not exists (select 1 from near n where n.repo_id = v.repo_id and n.path = v.path and n.callee = v.callee))
 select distinct repo_id, cid as source, id as target, 'calls' as type, cast(0.8 as double) as weight from (select repo_id, cid, id from near union all select * from far) where cid <> id"""


def q_flags(spark, sf):
    entry = nodes(spark, sf).groupBy("repo_id").agg(F.max(F.concat("name", F.lit("/"), "id")).alias("path"))
    return G.with_flags(full_nodes(spark, sf), entry).select("repo_id", "id", "file_level", "tested", "entry_point", "is_test", "enriched")


S_FLAGS = duck(f"""with {FULL}, e as (select repo_id, max(file_path) as p from fn group by 1)
 select fn.repo_id, id, type in {sql_list(dims.FILE_LEVEL_TYPES)} as file_level, id like '%4' as tested, id like '%4' or file_path = p as entry_point, false as is_test, id like '%3' as enriched
 from fn join e on e.repo_id = fn.repo_id""")


def q_inherit(spark, sf):
    # Files sit in a layer per nation; classes and functions take it over from their file's path.
    n = query(spark, sf, "select c_nationkey as repo_id, 'class:c' || cast(c_custkey as string) as id, 'f' || cast(c_custkey % 4 as string) as file_path from customer"
                         " union all select n_nationkey, 'config:f1', 'f1' from nation")
    m = query(spark, sf, "select n_nationkey as repo_id, case k when 0 then 'file:f0' when 1 then 'config:f1' else 'file:f1' end as node_id, case k when 0 then 'layer:a' when 1 then 'layer:b' else 'layer:c' end as layer_id,"
                         " k as layer_ord from nation, (select 0 as k union all select 1 union all select 2) s")
    return G.inherit_layer(n, m).select("repo_id", "id", "layer_id")


S_INHERIT = """select c_nationkey as repo_id, 'class:c' || c_custkey as id, case c_custkey % 4 when 0 then 'layer:a' when 1 then 'layer:c' end as layer_id from customer
 union all select n_nationkey, 'config:f1', 'layer:b' from nation"""

QUERIES = {
    "pending": (q_pending, S_PENDING),
    "journal_replay": (q_replay, S_REPLAY),
    "batches": (q_batches, S_BATCHES),
    "facts": (q_facts, S_FACTS),
    "excerpts": (q_excerpts, S_EXCERPTS),
    "requests": (q_requests, S_REQUESTS),
    "parse_responses": (q_responses, S_RESPONSES),
    "parse_plain_text": (q_plain_text, S_PLAIN_TEXT),
    "apply_descriptions": (q_apply, S_APPLY),
    "apply_narrative": (q_narrative, S_NARRATIVE),
    "domain_nodes": (q_domain_nodes, S_DOMAIN_NODES),
    "domain_edges": (q_domain_edges, S_DOMAIN_EDGES),
    "replace_domains": (q_replace, S_REPLACE),
    "explain_context": (q_explain, S_EXPLAIN),
    "ask_context": (q_ask, S_ASK),
    "domain_context": (q_domain_context, S_DOMAIN_CONTEXT),
    "probe_files": (q_probe, S_PROBE),
    "content_digest": (q_digest, S_DIGEST),
    "cap_files": (q_cap_files, S_CAP_FILES),
    "project_identity": (q_identity, S_IDENTITY),
    "stale_builds": (q_stale, S_STALE),
    "compact_nodes": (q_compact_nodes, S_COMPACT_NODES),
    "compact_edges": (q_compact_edges, S_COMPACT_EDGES),
    "symbol_nodes": (q_symbols, S_SYMBOLS),
    "call_edges": (q_calls, S_CALLS),
    "node_flags": (q_flags, S_FLAGS),
    "inherit_layer": (q_inherit, S_INHERIT),
}
