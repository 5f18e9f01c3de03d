"""Wikis, web pages, points and file events over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.operators import spatial as S
from lodemap.operators import wiki as W
from lodemap.streaming import watch as K
from workload.graph_queries import sql_list
from workload.views import duck, query, table, view

# A wiki per 25 parts: markdown articles that link to their neighbours, an index with sections, and raw sources.
WIKI = """select p_partkey % 7 as repo_id, 'notes/p' || cast(p_partkey as varchar(20)) || '.md' as path,
  (case when p_partkey % 3 = 0 then '---' || chr(10) || 'title: "' || p_name || '"' || chr(10) || '---' || chr(10) when p_partkey % 3 = 1
   then '# ' || p_name || chr(10) else '' end) || '> quoted' || chr(10) || 'Made **by** ' || p_brand || ' next to [[p' || cast(p_partkey + 7 as varchar(20))
   || '|more]].' || chr(10) || 'See [[P' || cast(p_partkey - 14 as varchar(20)) || ']] and [[nobody ' || cast(p_size as varchar(20)) || ']]; data in src'
   || cast(p_size % 9 as varchar(20)) || '_' || lower(p_brand) || '.' as content from part
 union all select p_partkey % 7, 'index.md', '# Index' || chr(10) || '[[p7]]' || chr(10) || '## First Half' || chr(10) || '- [[p' || cast(min(p_partkey) as varchar(20)) || ']] [[p'
   || cast(max(p_partkey) as varchar(20)) || ']]' || chr(10) || '## Other' || chr(10) || '- [[p' || cast(max(p_partkey) as varchar(20)) || ']]' from part where p_partkey % 7 < 5 group by p_partkey % 7
 union all select distinct p_partkey % 7, 'raw/Src' || cast(p_size % 9 as varchar(20)) || '_' || p_brand || '.csv', 'x' from part"""


def files(spark, sf):
    return query(spark, sf, WIKI)


def arts(spark, sf):
    return W.articles(files(spark, sf))


def q_detect(spark, sf):
    return W.detect_wikis(files(spark, sf))


S_DETECT = "select p_partkey % 7 as repo_id, 'index.md' as index_path, count(*) as articles from part where p_partkey % 7 < 5 group by 1"


def q_articles(spark, sf):
    return arts(spark, sf).select("repo_id", "id", "name", "summary", F.array_join("wikilinks", "|").alias("links"), "complexity")


S_ARTICLES = """select p_partkey % 7 as repo_id, 'article:notes/p' || p_partkey || '.md' as id, case when p_partkey % 3 < 2 then p_name else 'p' || p_partkey end as name,
 'Made by ' || p_brand || ' next to p' || (p_partkey + 7) || '.' as summary, 'p' || (p_partkey + 7) || '|P' || (p_partkey - 14) || '|nobody ' || p_size as links, 'simple' as complexity from part"""


def q_links(spark, sf):
    out = W.resolve_links(arts(spark, sf))
    return out["edges"].select("repo_id", "source", "target").unionByName(
        out["unresolved"].groupBy("repo_id").agg(F.count("*").cast("string").alias("target")).select("repo_id", F.lit("unresolved").alias("source"), "target")).unionByName(
        out["backlinks"].groupBy("repo_id").agg(F.count("*").cast("string").alias("target")).select("repo_id", F.lit("backlinks").alias("source"), "target"))


LINKS = """a as (select p_partkey as k, p_partkey % 7 as r, p_size from part),
 l as (select k, r, k + 7 as t from a union all select k, r, k - 14 from a), hit as (select l.* from l join a on a.k = l.t)"""
S_LINKS = f"""with {LINKS} select r as repo_id, 'article:notes/p' || k || '.md' as source, 'article:notes/p' || t || '.md' as target from hit
 union all select r, 'unresolved', cast(count(*) filter (where not exists (select 1 from a where a.k = l.t)) + (select count(*) from a where a.r = l.r) as varchar) from l group by r
 union all select r, 'backlinks', cast(count(*) as varchar) from hit group by r"""


def q_topics(spark, sf):
    t = W.topics(files(spark, sf).filter("path = 'index.md'"), arts(spark, sf))
    return t["edges"].select("repo_id", "source", "target").unionByName(
        t["category"].select("repo_id", F.col("id").alias("source"), F.concat(F.lit("category "), "category").alias("target")))


S_TOPICS = """with m as (select p_partkey % 7 as r, min(p_partkey) as a, max(p_partkey) as b from part where p_partkey % 7 < 5 group by 1)
 select r as repo_id, 'article:notes/p' || a || '.md' as source, 'topic:first-half' as target from m union all
 select r, 'article:notes/p' || b || '.md', 'topic:first-half' from m union all select r, 'article:notes/p' || b || '.md', 'topic:other' from m union all
 select r, 'article:notes/p' || a || '.md', 'category First Half' from m union all select r, 'article:notes/p' || b || '.md', 'category Other' from m"""


def q_citations(spark, sf):
    f = files(spark, sf)
    return W.citations(f.filter("path like 'notes/%'"), f.filter("path like 'raw/%'"))


S_CITATIONS = """select a.p_partkey % 7 as repo_id, 'article:notes/p' || a.p_partkey || '.md' as source, 'source:' || s.path as target, 'cites' as type
 from part a join (select distinct p_partkey % 7 as r, 'raw/Src' || (p_size % 9) || '_' || p_brand || '.csv' as path, 'src' || (p_size % 9) || '_' || lower(p_brand) as stem from part) s
 on s.r = a.p_partkey % 7 and contains('src' || (a.p_size % 9) || '_' || lower(a.p_brand) || '.', s.stem)"""


def q_wiki_layers(spark, sf):
    a = arts(spark, sf)
    t = W.topics(files(spark, sf).filter("path = 'index.md'"), a)
    cols = ["repo_id", "id", "type"]
    nodes = a.select(*cols).unionByName(t["nodes"].select(*cols)).unionByName(W.source_nodes(files(spark, sf)).select(*cols))
    return W.wiki_layers(nodes, t["category"])[0]


S_WIKI_LAYERS = """with m as (select p_partkey % 7 as r, count(*) as n, count(distinct (p_size % 9, p_brand)) as s from part group by 1),
 l as (select r as repo_id, 'layer:topic:first-half' as layer_id, 'First Half' as name, 1 as n_members, 0 as layer_ord, 'Articles of the topic First Half.' as description from m where r < 5
 union all select r, 'layer:topic:other', 'Other', 1, 1, 'Articles of the topic Other.' from m where r < 5
 union all select r, 'layer:uncategorised', 'Uncategorised', n + s - case when r < 5 then 2 else 0 end, case when r < 5 then 2 else 0 end, 'Articles the index does not list.' from m)
 select repo_id, layer_id, name, cast(n_members as bigint) as n_members, cast(layer_ord as integer) as layer_ord, description from l"""


def pages(spark, sf):
    # A page is called by the first word of its title; sites are language editions.
    return query(spark, sf, "select page_id % 3 as repo_id, page_id, lower(regexp_extract(html, '<title>([^ <]*)', 1)) as name, html from pages")


def q_page_links(spark, sf):
    out = W.page_links(pages(spark, sf))
    return out["edges"].unionByName(out["unresolved"].groupBy("repo_id", "source").agg(F.count("*").alias("target")).withColumn("target", -F.col("target")))


S_PAGE_LINKS = r"""with p as (select page_id % 3 as r, page_id, lower(regexp_extract(html, '<title>([^ <]*)', 1)) as nm, html from pages),
 k as (select r, replace(replace(replace(regexp_replace(nm, '\.md$', ''), '_', '-'), ' ', '-'), '/', '-') as key, min(page_id) as t from p group by 1, 2),
 h as (select distinct r, page_id, href from (select r, page_id, unnest(regexp_extract_all(html, '(?i)(?:src|href)\s*=\s*["'']([^"'']+)["'']', 1)) as href from p) where not regexp_matches(href, '^(http|//|#|data:)')),
 n as (select *, replace(replace(replace(regexp_replace(lower(trim(regexp_replace(href, '^/|[#?].*$', '', 'g'))), '\.md$', ''), '_', '-'), ' ', '-'), '/', '-') as key from h)
 select distinct n.r as repo_id, n.page_id as source, k.t as target from n join k on k.r = n.r and k.key = n.key where n.page_id <> k.t
 union all select n.r, n.page_id, -count(*) from n where not exists (select 1 from k where k.r = n.r and k.key = n.key) group by 1, 2"""


# --- points --------------------------------------------------------------------------------

def points(spark, sf):
    return view(spark, sf, "v_points").withColumn("r", F.abs(F.col("x")) % 7 + 3)


def q_bounds(spark, sf):
    return S.bounds(points(spark, sf)).select("repo_id", *[F.round(c, 6).alias(c) for c in ("min_x", "min_y", "width", "height")])


S_BOUNDS = duck("""select repo_id, round(min(x) - 120, 6) as min_x, round(min(y) - 120, 6) as min_y, round(max(x) - min(x) + 240, 6) as width,
 round(max(y) - min(y) + 240, 6) as height from v_points group by 1""")

RECTS = "select repo_id, node_id as rect_id, x - (10 + node_id % 40 * 9) as x0, y - 30 as y0, x + (10 + node_id % 40 * 9) as x1, y + 45 as y1 from v_points"


def q_rects(spark, sf):
    return S.rect_query(points(spark, sf), query(spark, sf, RECTS), cell=25.0).groupBy("repo_id", "rect_id").agg(F.count("*").alias("n"))


S_RECTS = duck(f"""select r.repo_id, r.rect_id, count(*) as n from ({RECTS}) r join v_points p on p.repo_id = r.repo_id and x between x0 and x1 and y between y0 and y1 group by 1, 2""")

PROBES = "select repo_id, node_id as probe_id, x + 5.0 as px, y - 7.0 as py from v_points"


def q_nearest(spark, sf):
    return S.nearest(points(spark, sf), query(spark, sf, PROBES), 8.5).select("repo_id", "probe_id", "node_id")


S_NEAREST = duck(f"""select repo_id, probe_id, node_id from (select q.repo_id, q.probe_id, p.node_id, row_number() over (partition by q.repo_id, q.probe_id
 order by (x - px) * (x - px) + (y - py) * (y - py), floor(y / 8.5) desc, floor(x / 8.5) desc, p.node_id desc) as rn
 from ({PROBES}) q join v_points p on p.repo_id = q.repo_id and (x - px) * (x - px) + (y - py) * (y - py) <= 72.25) where rn = 1""")


def q_pairs(spark, sf):
    return S.close_pairs(points(spark, sf), 120.0)


S_PAIRS = duck("""with p as (select *, abs(x) % 7 + 3 as r, floor(x / 120) as cx, floor(y / 120) as cy from v_points)
 select a.repo_id, count(*) as pairs from p a join p b on a.repo_id = b.repo_id and a.cx = b.cx and a.cy = b.cy and a.node_id < b.node_id
 where sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) < (a.r + b.r) * 1.4 group by 1""")


# --- file events ------------------------------------------------------------------------------

def q_interesting(spark, sf):
    return K.interesting(view(spark, sf, "v_fs_events")).select("event_id", "path")


S_INTERESTING = duck("select event_id, path from v_fs_events where path like '%.ts' or path like '%.py'")


def q_debounce(spark, sf):
    e = view(spark, sf, "v_fs_events").withColumn("ts", F.col("ts").cast("timestamp"))
    return K.debounce(K.interesting(e), "6 hours").select("repo_id", F.date_format("quiet_from", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("quiet_from"), "n_events")


S_DEBOUNCE = duck("""with e as (select repo_id, ts from v_fs_events where path like '%.ts' or path like '%.py'),
 g as (select *, case when ts - lag(ts) over w < interval 6 hours then 0 else 1 end as new from e window w as (partition by repo_id order by ts)),
 s as (select *, sum(new) over (partition by repo_id order by ts rows unbounded preceding) as s from g)
 select repo_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') as quiet_from, count(*) as n_events from s group by repo_id, s""")


def q_gate(spark, sf):
    def snap(name):
        return view(spark, sf, name).withColumn("content_hash", F.sha2("content", 256))
    # Repositories 0-2 have no baseline, 3-5 did not change, the rest did.
    old = snap("v_snap_old").filter("repo_id > 2")
    new = snap("v_snap_old").filter("repo_id <= 5").unionByName(snap("v_snap_new").filter("repo_id > 5"))
    return K.rebuild_gate(new, old, new)


S_GATE = duck("select distinct repo_id, repo_id < 3 or repo_id > 5 as rebuild from v_snap_old")


def q_journal(spark, sf):
    rows = query(spark, sf, "select user_id % 20 as repo_id, 'n' || cast(user_id as string) as node_id, ts, lpad(cast(event_id as string), 9, '0') as fingerprint, event_type as summary from events")
    return K.journal_latest(rows).select("repo_id", "node_id", "fingerprint", "summary")


S_JOURNAL = """select user_id % 20 as repo_id, 'n' || user_id as node_id, lpad(cast(event_id as varchar), 9, '0') as fingerprint, event_type as summary
 from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1"""


def q_totals(spark, sf):
    return K.issue_totals(table(spark, sf, "events").select((F.col("user_id") % 20).alias("repo_id"), F.col("event_type").alias("category")))


S_TOTALS = "select user_id % 20 as repo_id, event_type as category, count(*) as n from events group by 1, 2"

QUERIES = {
    "wiki_detect": (q_detect, S_DETECT),
    "wiki_articles": (q_articles, S_ARTICLES),
    "wiki_links": (q_links, S_LINKS),
    "wiki_topics": (q_topics, S_TOPICS),
    "wiki_citations": (q_citations, S_CITATIONS),
    "wiki_layers": (q_wiki_layers, S_WIKI_LAYERS),
    "page_links": (q_page_links, S_PAGE_LINKS),
    "bounds": (q_bounds, S_BOUNDS),
    "rect_query": (q_rects, S_RECTS),
    "nearest": (q_nearest, S_NEAREST),
    "close_pairs": (q_pairs, S_PAIRS),
    "interesting_events": (q_interesting, S_INTERESTING),
    "debounce": (q_debounce, S_DEBOUNCE),
    "rebuild_gate": (q_gate, S_GATE),
    "journal_latest": (q_journal, S_JOURNAL),
    "running_issue_totals": (q_totals, S_TOTALS),
}
