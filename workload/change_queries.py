"""Snapshots, signatures and history over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.operators import changes as C
from lodemap.plans import incremental as I
from workload.views import duck, query, view


def snap(spark, sf, name):
    return view(spark, sf, name).withColumn("content_hash", F.sha2("content", 256))


def diff(spark, sf):
    return C.snapshot_diff(snap(spark, sf, "v_snap_old"), snap(spark, sf, "v_snap_new"))


DIFF = """o as (select *, sha256(content) as h from v_snap_old), n as (select *, sha256(content) as h from v_snap_new),
 d as (select coalesce(o.repo_id, n.repo_id) as repo_id, coalesce(o.path, n.path) as path,
  case when o.h is null then 'added' when n.h is null then 'deleted' when o.h = n.h then 'unchanged' else 'structural' end as state
  from o full join n on o.repo_id = n.repo_id and o.path = n.path)"""


def q_kind(spark, sf):
    sizes = view(spark, sf, "v_snap_old").groupBy("repo_id").agg(F.count("*").alias("total_files"))
    # The last repository's history is calmer, so that all kinds of update occur.
    calm = diff(spark, sf).withColumn("state", F.when((F.col("repo_id") < 4) & ~F.col("path").rlike("[0-9]{2}0[.]txt$"), "unchanged").otherwise(F.col("state")))
    return C.update_kind(calm, sizes)


S_KIND = duck(f"""with {DIFF}, c as (select repo_id, path, case when repo_id < 4 and not regexp_matches(path, '[0-9]{{2}}0[.]txt$') then 'unchanged' else state end as state from d),
 s as (select repo_id, count(*) as total from v_snap_old group by 1),
 t as (select repo_id, split_part(path, '/', 1) as top, count(*) filter (where state not in ('added', 'deleted')) as stay from c group by 1, 2),
 a as (select repo_id, count(*) filter (where state in ('structural', 'added', 'deleted')) as changed from c group by 1)
 select a.repo_id, a.changed, exists (select 1 from t where t.repo_id = a.repo_id and stay = 0) as new_top,
  case when changed = 0 then 'skip' when changed > 30 then 'full' when changed / total > 0.5 then 'full' when changed > 10 then 'architecture'
  when exists (select 1 from t where t.repo_id = a.repo_id and stay = 0) then 'architecture' else 'partial' end as update_kind
 from a join s on s.repo_id = a.repo_id""")


def q_changed(spark, sf):
    return C.changed_files(snap(spark, sf, "v_snap_old"), snap(spark, sf, "v_snap_new")).select("repo_id", "path")


def q_signatures(spark, sf):
    return C.signature_changes(view(spark, sf, "v_sig_old"), view(spark, sf, "v_sig_new"))


S_SIGNATURES = duck("""with j as (select coalesce(o.repo_id, n.repo_id) as repo_id, coalesce(o.path, n.path) as path, o.name as onm, n.name as nnm,
  o.params as op, n.params as np, o.line_count as ol, n.line_count as nl
  from v_sig_old o full join v_sig_new n on o.repo_id = n.repo_id and o.path = n.path and o.name = n.name)
 select repo_id, path, case when count(onm) = 0 then 'added' when count(nnm) = 0 then 'deleted'
  when bool_or(onm is null or nnm is null or op <> np or nl > 1.5 * ol or nl < 0.5 * ol) then 'structural'
  when bool_or(ol <> nl) then 'cosmetic' else 'none' end as change from j group by 1, 2""")


def _prints(spark, sf, name):
    sig = view(spark, sf, name)
    fn = F.struct("name", F.array("params").alias("params"), F.lit(None).cast("string").alias("return_type"), F.lit(True).alias("exported"),
                  F.col("line_count").cast("int").alias("line_count"))
    return sig.groupBy("repo_id", "path").agg(F.collect_list(fn).alias("functions")).select(
        "repo_id", "path", F.sha2(F.to_json(F.array_sort("functions")), 256).alias("content_hash"), "functions",
        F.array().cast(C.CLASS).alias("classes"), F.array().cast("array<string>").alias("imports"),
        F.array().cast("array<string>").alias("exports"), F.lit(True).alias("has_structure"))


def q_class(spark, sf):
    return C.change_class(_prints(spark, sf, "v_sig_old"), _prints(spark, sf, "v_sig_new"))


# --- history: the graph of each customer was built at some order, HEAD is another ------------------

BUILDS = """select repo_id, case repo_id % 10 when 0 then null when 1 then cast(-1 as bigint) else min(commit_id) end as c_min,
 case repo_id % 10 when 0 then null when 1 then cast(-1 as bigint) when 2 then max(commit_id) when 3 then max(commit_id) else
 min(case when commit_id % 3 = 1 then commit_id end) end as commit from v_commits where repo_id % 13 <> 0 group by repo_id"""
HEADS = """select repo_id, case when repo_id % 17 = 0 then null when repo_id % 10 = 4 then min(commit_id) else max(commit_id) end as commit from v_commits group by repo_id"""
FILES = """select repo_id, commit_id, case when commit_id % 7 = 0 then '.ua/graph.json' else 'src/f' || cast(commit_id % 5 as varchar(20)) || '.ts' end as path from v_commits"""
WORKING = """select repo_id, case when commit_id % 2 = 0 then '.ua/meta.json' else 'src/g' || cast(commit_id % 4 as varchar(20)) || '.ts' end as path from v_commits where commit_id % 11 = 3"""


def q_fresh(spark, sf):
    builds = query(spark, sf, f"select repo_id, commit from ({BUILDS})")
    return C.freshness(builds, query(spark, sf, HEADS).filter("commit is not null"), view(spark, sf, "v_commits"), query(spark, sf, FILES), query(spark, sf, WORKING))


S_FRESH = duck(f"""with recursive b as (select repo_id, commit as g from ({BUILDS})), h as (select repo_id, commit as hd from ({HEADS})),
 s as (select b.repo_id, g, hd, case when g is null then 'missing-graph-commit' when hd is null then 'git-head-unavailable'
   when not exists (select 1 from v_commits c where c.repo_id = b.repo_id and c.commit_id = g) then 'graph-commit-unavailable' end as reason
  from b join h on h.repo_id = b.repo_id),
 a as (select repo_id, 'g' as l, g as c from s where reason is null union select repo_id, 'h', hd from s where reason is null
  union select a.repo_id, a.l, v.parent_id from a join v_commits v on v.repo_id = a.repo_id and v.commit_id = a.c where v.parent_id is not null),
 x as (select repo_id, c, bool_or(l = 'g') as ig, bool_or(l = 'h') as ih from a group by 1, 2),
 f as (select repo_id, commit_id, path from ({FILES}) where path not like '.ua/%'),
 o as (select x.*, f.path from x join f on f.repo_id = x.repo_id and f.commit_id = x.c where ig <> ih),
 w as (select distinct repo_id, path from ({WORKING}) where path not like '.ua/%'),
 u as (select distinct repo_id, path from o), al as (select repo_id, path from u union select repo_id, path from w),
 r as (select s.*, (select count(*) from u where u.repo_id = s.repo_id) as nc, (select count(*) from w where w.repo_id = s.repo_id) as nd,
  (select count(*) from al where al.repo_id = s.repo_id) as na, (select count(*) from o where o.repo_id = s.repo_id and ih) as bh,
  (select count(*) from o where o.repo_id = s.repo_id and ig) as ah,
  (select bool_or(ih) from x where x.repo_id = s.repo_id and x.c = s.g) as gb, (select bool_or(ig) from x where x.repo_id = s.repo_id and x.c = s.hd) as hb from s),
 t as (select *, case when reason is not null then 'unknown' when nc > 0 then 'stale' when nd > 0 then 'dirty' else 'fresh' end as status from r)
 select repo_id, status, reason, case when status = 'stale' then case when gb then 'behind' when hb then 'ahead' else 'diverged' end end as relation,
  case when status = 'stale' then bh end as behind, case when status = 'stale' then ah end as ahead,
  case status when 'stale' then na when 'dirty' then nd else 0 end as n_changed_files,
  case status when 'fresh' then 0 when 'unknown' then 1 when 'dirty' then 2 else 3 end as severity, status in ('dirty', 'stale') as actionable from t""")


def q_ancestors(spark, sf):
    starts = query(spark, sf, "select repo_id, 'head' as label, max(commit_id) as commit_id from v_commits group by repo_id")
    return C.ancestors(view(spark, sf, "v_commits"), starts).groupBy("repo_id").agg(F.count("*").alias("n"))


S_ANCESTORS = duck("""with recursive a as (select repo_id, max(commit_id) as c from v_commits group by 1 union
 select a.repo_id, v.parent_id from a join v_commits v on v.repo_id = a.repo_id and v.commit_id = a.c where v.parent_id is not null)
 select repo_id, count(*) as n from a group by 1""")


def q_carry(spark, sf):
    new = query(spark, sf, "select c_custkey % 5 as repo_id, 'c' || cast(c_custkey as string) as id, 'Not yet analyzed.' as summary, array('t') as tags,"
                           " cast(c_custkey % 3 as string) as fingerprint from customer")
    old = query(spark, sf, "select c_custkey % 5 as repo_id, 'c' || cast(c_custkey as string) as id, case when c_custkey % 4 = 0 then c_name else 'Not yet analyzed.' end as summary,"
                           " array('t', 'o') as tags from customer")
    journal = query(spark, sf, "select c_custkey % 5 as repo_id, 'c' || cast(c_custkey as string) as node_id, '1' as fingerprint, c_mktsegment as summary, array('j') as tags from customer where c_custkey % 2 = 0")
    return C.carry_prose(new, old, journal).select("repo_id", "id", "summary", F.array_join("tags", ",").alias("tags"))


S_CARRY = """select c_custkey % 5 as repo_id, 'c' || c_custkey as id, case when c_custkey % 2 = 0 and c_custkey % 3 = 1 then c_mktsegment
 when c_custkey % 4 = 0 then c_name else 'Not yet analyzed.' end as summary,
 't' || case when c_custkey % 4 = 0 then ',o' else '' end || case when c_custkey % 2 = 0 and c_custkey % 3 = 1 then ',j' else '' end as tags from customer"""

# --- a maintained analysis: a hundredth of the files each is changed, noted, deleted and added -------

SOURCE_AT = "select repo_id, path, content, cast(regexp_extract(path, '/p([0-9]+)', 1) as bigint) % 100 as k from v_source"
SOURCE_OLD = f"select repo_id, path, content from ({SOURCE_AT}) s where k <> 21"
SOURCE_NEW = f"""select repo_id, path, case k when 7 then content || 'export function extra(q) {{' || chr(10) || '}}' || chr(10)
  when 33 then content || '// a note' || chr(10) else content end as content from ({SOURCE_AT}) s where k <> 13"""


def q_incremental(spark, sf):
    state = I.update_state(I.full_state(query(spark, sf, SOURCE_OLD)), query(spark, sf, SOURCE_NEW))
    names = state["functions"].groupBy("repo_id", "path").agg(F.array_join(F.sort_array(F.collect_list("name")), ",").alias("functions"))
    parsed = state["parsed"].withColumn("parsed", F.lit(True))
    return state["diff"].join(names, ["repo_id", "path"], "left").join(parsed, ["repo_id", "path"], "left").select(
        "repo_id", "path", "state", "functions", F.coalesce("parsed", F.lit(False)).alias("parsed"))


S_INCREMENTAL = duck(f"""with s as ({SOURCE_AT}) select repo_id, path,
 case k when 7 then 'structural' when 33 then 'cosmetic' when 13 then 'deleted' when 21 then 'added' else 'unchanged' end as state,
 case when k <> 13 then case when k = 7 then 'extra,' else '' end || 'f' || regexp_extract(path, '/p([0-9]+)', 1) end as functions, k in (7, 21, 33) as parsed from s""")

def q_trees(spark, sf):
    both = snap(spark, sf, "v_snap_old").withColumn("side", F.lit("old")).unionByName(snap(spark, sf, "v_snap_new").withColumn("side", F.lit("new")))
    entries, roots = C.folder_trees(both.select("repo_id", "path", "content_hash", "side"), "side")
    pairs = roots.groupBy("repo_id").agg(F.max(F.when(F.col("side") == "old", F.col("tree"))).alias("old"), F.max(F.when(F.col("side") == "new", F.col("tree"))).alias("new"))
    return C.tree_changes(entries, pairs)


QUERIES = {
    "tree_changes": (q_trees, duck(f"with {DIFF} select repo_id, path, case state when 'structural' then 'changed' else state end as state from d where state <> 'unchanged'")),
    "incremental_update": (q_incremental, S_INCREMENTAL),
    "snapshot_diff": (diff, duck(f"with {DIFF} select * from d")),
    "changed_files": (q_changed, duck(f"with {DIFF} select repo_id, path from d where state in ('structural', 'added')")),
    "update_kind": (q_kind, S_KIND),
    "signature_changes": (q_signatures, S_SIGNATURES),
    "change_class": (q_class, S_SIGNATURES.replace("case when count(onm) = 0 then 'added' when count(nnm) = 0 then 'deleted'\n  when", "case when")
                     .replace("from j group by 1, 2", "from j group by 1, 2 having count(onm) > 0 and count(nnm) > 0")),
    "freshness": (q_fresh, S_FRESH),
    "ancestors": (q_ancestors, S_ANCESTORS),
    "carry_prose": (q_carry, S_CARRY),
}
