"""Graph questions over the driver's tables, each with the same question in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.operators import graph as G
from lodemap.operators import search as S
from workload.views import duck, query, view


def sql_case(column: str, table: dict, default: str = "null") -> str:
    """A fixed table as a SQL CASE."""
    def lit(v):
        return "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    whens = " ".join(f"when {lit(k)} then {lit(v)}" for k, v in table.items())
    return f"(case {column} {whens} else {default} end)"


def sql_list(values) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def nodes(spark, sf):
    return view(spark, sf, "v_nodes")


def edges(spark, sf):
    return view(spark, sf, "v_repo_edges")


COLLAPSED = f"""collapsed as (
 select repo_id, source, target, type, w from (
  select repo_id, source, target, type, {sql_case('type', dims.EDGE_WEIGHT, '0.5')} as w,
   row_number() over (partition by repo_id, source, target
    order by {sql_case('type', dims.EDGE_WEIGHT, '0.5')} desc, type) as rn
  from v_repo_edges where source <> target) where rn = 1)"""

SEARCHES = {"exact": "indonesia", "words": "urgent 5-low", "loose": "mrcan", "part": "000000012"}


def seeds_sql() -> str:
    return "select repo_id, id from v_nodes where type = 'function' and id like '%7'"


def q_blast(spark, sf):
    changed = query(spark, sf, seeds_sql())
    out = G.blast_radius(nodes(spark, sf), edges(spark, sf), changed, 2)
    return out.groupBy("repo_id", "hop").agg(F.count("*").alias("n"))


S_BLAST = duck(f"""with {COLLAPSED},
 back as (select repo_id, source, target from collapsed where type in {sql_list(dims.PROPAGATING_EDGES)}),
 h0 as ({seeds_sql()}),
 h1 as (select distinct b.repo_id, b.source as id from back b join h0 on h0.repo_id = b.repo_id and h0.id = b.target
  where not exists (select 1 from h0 x where x.repo_id = b.repo_id and x.id = b.source)),
 h2 as (select distinct b.repo_id, b.source as id from back b join h1 on h1.repo_id = b.repo_id and h1.id = b.target
  where not exists (select 1 from h0 x where x.repo_id = b.repo_id and x.id = b.source)
  and not exists (select 1 from h1 x where x.repo_id = b.repo_id and x.id = b.source))
select repo_id, 0 as hop, count(*) as n from h0 group by 1 union all
select repo_id, 1, count(*) from h1 group by 1 union all select repo_id, 2, count(*) from h2 group by 1""")


def q_collapse(spark, sf):
    return G.collapse_edges(edges(spark, sf)).select("repo_id", "source", "target", "type")


S_COLLAPSE = duck(f"with {COLLAPSED} select repo_id, source, target, type from collapsed")


def q_degree(spark, sf):
    return G.degree(nodes(spark, sf), edges(spark, sf)).select("repo_id", "id", "degree")


DEGREES = """deg as (select n.repo_id, n.id, count(e.id) as degree from v_nodes n left join (
  select repo_id, source as id from collapsed union all select repo_id, target from collapsed) e
  on e.repo_id = n.repo_id and e.id = n.id group by 1, 2)"""
S_DEGREE = duck(f"with {COLLAPSED}, {DEGREES} select repo_id, id, degree from deg")


def q_degree_raw(spark, sf):
    return G.degree(nodes(spark, sf), edges(spark, sf), collapsed=False).select("repo_id", "id", "degree")


S_DEGREE_RAW = duck("""select n.repo_id, n.id, count(e.id) as degree from v_nodes n left join (
  select repo_id, source as id from v_repo_edges union all select repo_id, target from v_repo_edges) e
  on e.repo_id = n.repo_id and e.id = n.id group by 1, 2""")


def q_hubs(spark, sf):
    return G.hubs(nodes(spark, sf), edges(spark, sf), 60)


S_HUBS = duck(f"""with {COLLAPSED}, {DEGREES} select * from (select repo_id, id, degree,
 row_number() over (partition by repo_id order by degree desc, id) as hub_rank from deg) where hub_rank <= 60""")


def q_neighbourhood(spark, sf):
    seeds = nodes(spark, sf).filter("type = 'class'")
    return G.neighbourhood(edges(spark, sf), seeds).groupBy("repo_id", "seed").agg(F.count("*").alias("n"))


S_NEIGHBOURHOOD = duck("""with s as (select repo_id, id from v_nodes where type = 'class'),
 h as (select repo_id, source as seed, target as id from v_repo_edges union
  select repo_id, target, source from v_repo_edges union select repo_id, id, id from s)
 select h.repo_id, h.seed, count(*) as n from h join s on s.repo_id = h.repo_id and s.id = h.seed group by 1, 2""")


def q_links(spark, sf):
    seeds = nodes(spark, sf).filter("type <> 'function'")
    return G.links(nodes(spark, sf), edges(spark, sf), seeds, 40).select(
        "repo_id", "id", "neighbour", "type", "outgoing", "link_ord")


S_LINKS = duck(f"""with {COLLAPSED}, both_ways as (
 select repo_id, source as id, target as neighbour, type, w, true as outgoing from collapsed union all
 select repo_id, target, source, type, w, false from collapsed),
 best as (select * from (select b.*, row_number() over (partition by b.repo_id, b.id, neighbour
   order by w desc, b.type, outgoing) as rn from both_ways b join v_nodes n on n.id = b.id where n.type <> 'function') where rn = 1)
 select * from (select b.repo_id, b.id, b.neighbour, b.type, b.outgoing, row_number() over (partition by b.repo_id, b.id
   order by b.outgoing desc, n.name, b.neighbour) as link_ord from best b join v_nodes n on n.id = b.neighbour)
 where link_ord <= 40""")


def q_summary(spark, sf):
    return G.summary_counts(nodes(spark, sf), edges(spark, sf))


S_SUMMARY = duck(f"""select repo_id, 'node_type' as metric, type as key, count(*) as n from v_nodes group by 1, 3
 union all select repo_id, 'category', {sql_case('type', dims.NODE_CATEGORY)}, count(*) from v_nodes group by 1, 3
 union all select repo_id, 'edge_type', type, count(*) from v_repo_edges group by 1, 3
 union all select repo_id, 'headline', case when type in {sql_list(dims.FILE_LEVEL_TYPES)} then 'files'
  when type = 'function' then 'functions' when type = 'class' then 'types' end, count(*) from v_nodes group by 1, 3""")


def q_categories(spark, sf):
    return G.category_counts(nodes(spark, sf))


S_CATEGORIES = duck(f"""select repo_id, {sql_case('type', dims.NODE_CATEGORY)} as category, count(*) as n,
 {sql_case(sql_case('min(type)', dims.NODE_CATEGORY), dims.CATEGORY_ORDER)} as category_ord
 from v_nodes group by 1, 2""")


def q_search(spark, sf):
    return G.search(nodes(spark, sf), SEARCHES, 50)


def _sql_token(tok: str) -> str:
    m = len(tok)
    pattern = tok[0] + "".join(f"([^{c}]*){c}" for c in tok[1:])
    runs = " + ".join(f"(case when regexp_extract(nm, '{pattern}', {i}) = '' then 1 else 0 end)" for i in range(1, m))
    return f"""case when nm = '' then 1.0 when nm = '{tok}' then 0.0 when starts_with(nm, '{tok}') then 0.05
 when strpos(nm, '{tok}') > 0 then 0.12 + least(0.2, (strpos(nm, '{tok}') - 1)::double / length(nm) * 0.2)
   + (1 - {m}::double / greatest({m}, length(nm))) * 0.18
 when regexp_matches(nm, '{pattern}') then greatest(0.26, 0.40 - ({runs})::double / {m - 1} * 0.12 - {m}::double / length(nm) * 0.05)
 else 1.0 end"""


def _sql_search() -> str:
    parts = [f"select repo_id, '{q}' as query_id, id, round(least("
             + ", ".join(_sql_token(t) for t in text.lower().split()) + ", 1.0)::double, 6) as score from n"
             for q, text in SEARCHES.items()]
    return duck("with n as (select repo_id, id, lower(name) as nm from v_nodes), s as (" + " union all ".join(parts)
                + """) select * from (select *, row_number() over (partition by repo_id, query_id order by score, id)
 as hit_rank from s where score <= 0.4) where hit_rank <= 50""")


def q_search_requests(spark, sf):
    found = view(spark, sf, "v_search_nodes").withColumn("tags", F.split("tag_text", " "))
    return S.search_requests(found, view(spark, sf, "v_requests"), 50)


# Every word against every text; ``walk`` takes a word's letters one by one, each where it comes first.
S_SEARCH_REQUESTS = duck("""with recursive n as (select repo_id, id, unnest([{'f': 'name', 'scale': 1.0, 't': lower(name)},
   {'f': 'tags', 'scale': 0.4 / 0.3, 't': lower(tag_text)},
   {'f': 'summary', 'scale': 2.0, 't': case when lower(summary) <> 'not yet analyzed.' then lower(summary) end},
   {'f': 'notes', 'scale': 4.0, 't': lower(language_notes)}]) as x from v_search_nodes),
 words as (select distinct query_id, unnest(string_split_regex(lower(text), '[ \t]+')) as w from v_requests),
 pairs as (select t.t, w.w from (select distinct x.t as t from n where x.t <> '') t, (select distinct w from words where w <> '') w),
 walk as (select t, w, 1 as i, strpos(t, w[1]) as pos, 0 as adjacent from pairs where strpos(t, w[1]) > 0 union all
  select t, w, i + 1, pos + strpos(substr(t, pos + 1), w[i + 1]), adjacent + (case when substr(t, pos + 1, 1) = w[i + 1] then 1 else 0 end)
  from walk where i < length(w) and strpos(substr(t, pos + 1), w[i + 1]) > 0),
 scored as (select t, w, case when t = w then 0.0 when starts_with(t, w) then 0.05
   when strpos(t, w) > 0 then 0.12 + least(0.2, (strpos(t, w) - 1)::double / length(t) * 0.2) + (1 - length(w)::double / greatest(length(w), length(t))) * 0.18
   when length(w) > 1 then greatest(0.26, 0.40 - adjacent::double / (length(w) - 1) * 0.12 - length(w)::double / length(t) * 0.05) end as s
  from walk where i = length(w)),
 asked as (select distinct query_id, t, s from scored join words using (w)),
 hits as (select n.repo_id, a.query_id, n.id, min(round((a.s * n.x.scale)::double, 6)) as score from n join asked a on a.t = n.x.t group by 1, 2, 3)
select * from (select *, row_number() over (partition by repo_id, query_id order by score, id) as hit_rank from hits where score <= 0.4)
 where hit_rank <= 50""")


def q_paths(spark, sf):
    ways = view(spark, sf, "v_imports").select("repo_id", F.col("importer").alias("source"),
                                               F.col("target_path").alias("target"), F.lit("imports").alias("type"))
    ends = view(spark, sf, "v_files").groupBy("repo_id").agg(F.min("path").alias("start"), F.max("path").alias("end"))
    return G.shortest_paths(ways, ends).select("repo_id", "start", "end", "hops")


S_PATHS = duck("""with recursive u as (select repo_id, importer as a, target_path as b from v_imports union
 select repo_id, target_path, importer from v_imports),
 ends as (select repo_id, min(path) as s, max(path) as t from v_files group by 1),
 walk as (select repo_id, s as node, 0 as hops from ends union
  select u.repo_id, u.b, w.hops + 1 from walk w join u on u.repo_id = w.repo_id and u.a = w.node where w.hops < 12)
 select e.repo_id, s as start, t as "end", cast(min(hops) as integer) as hops from ends e
 join walk w on w.repo_id = e.repo_id and w.node = e.t group by 1, 2, 3""")


def q_rank(spark, sf):
    return G.dependency_rank(nodes(spark, sf), edges(spark, sf)).select("repo_id", "id", "rank")


S_RANK = duck(f"""with recursive {COLLAPSED}, r as (select repo_id, id, 0 as rank from v_nodes union
 select c.repo_id, c.target, r.rank + 1 from r join collapsed c on c.repo_id = r.repo_id and c.source = r.id)
 select repo_id, id, max(rank) as rank from r group by 1, 2""")


def q_tree(spark, sf):
    return G.dir_tree(view(spark, sf, "v_files"))


S_TREE = duck("""with f as (select distinct repo_id, path, string_split(path, '/') as p from v_files),
 d as (select repo_id, array_to_string(p[1:i], '/') as path, i - 1 as depth from f, unnest(range(1, len(p))) t(i))
 select repo_id, path, cast(depth as integer) as depth, true as is_directory, count(*) as n from d group by 1, 2, 3
 union all select repo_id, path, cast(len(p) - 1 as integer), false, 0 from f""")


def q_owner_pairs(spark, sf):
    owners = query(spark, sf, "select distinct l_partkey % 5 as repo_id, 's' || cast(l_suppkey % 12 as string) as owner,"
                              " l_partkey as node_id from lineitem")
    return G.shared_owner_pairs(owners)


S_OWNER_PAIRS = """with o as (select distinct l_partkey % 5 as repo_id, 's' || cast(l_suppkey % 12 as varchar) as owner,
 l_partkey as node_id from lineitem)
 select distinct x.repo_id, x.owner as a, y.owner as b from o x join o y
 on x.repo_id = y.repo_id and x.node_id = y.node_id and x.owner < y.owner"""


QUERIES = {
    "blast_radius": (q_blast, S_BLAST),
    "collapse_edges": (q_collapse, S_COLLAPSE),
    "degree": (q_degree, S_DEGREE),
    "degree_all_edges": (q_degree_raw, S_DEGREE_RAW),
    "hubs": (q_hubs, S_HUBS),
    "neighbourhood": (q_neighbourhood, S_NEIGHBOURHOOD),
    "links": (q_links, S_LINKS),
    "summary_counts": (q_summary, S_SUMMARY),
    "category_counts": (q_categories, S_CATEGORIES),
    "search": (q_search, _sql_search()),
    "search_requests": (q_search_requests, S_SEARCH_REQUESTS),
    "shortest_paths": (q_paths, S_PATHS),
    "dependency_rank": (q_rank, S_RANK),
    "dir_tree": (q_tree, S_TREE),
    "shared_owner_pairs": (q_owner_pairs, S_OWNER_PAIRS),
}
