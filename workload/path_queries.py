"""Path classification, ignore rules and per-repository summaries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.functions import text as T
from lodemap.operators import build as B
from lodemap.operators import paths as P
from workload.graph_queries import sql_list
from workload.views import duck, query, view

# Paths of many kinds from part rows: dot files, infrastructure, nested tests, odd separators.
MIXED = """
select repo_id, (case p_partkey % 12 when 0 then '.github/workflows/w' when 1 then 'deploy/k8s/x' when 2 then 'Dockerfile.'
 when 3 then 'docs/readme' when 4 then '.env.' when 5 then 'src/Main' when 6 then 'LICENSE' when 7 then 'Makefile'
 when 8 then 'db' || chr(92) || 'schema/t' when 9 then 'src/test/java/A' when 10 then 'pkg/foo' else 'scripts//run' end)
 || (case when p_partkey % 12 in (6, 7) then '' else cast(n_lines as varchar(20)) end)
 || (case p_partkey % 12 when 0 then '.yml' when 1 then '.yaml' when 3 then '.md' when 5 then '.Swift' when 8 then '.sql'
  when 9 then 'Test.java' when 10 then '_test.go' when 11 then '.sh' else '' end) as path, p_partkey from v_files"""


def mixed(spark, sf):
    return query(spark, sf, MIXED)


def q_classify(spark, sf):
    df = view(spark, sf, "v_files").select("repo_id", "path").unionByName(mixed(spark, sf).select("repo_id", "path"))
    return df.distinct().select("repo_id", "path", P.language_of("path").alias("language"),
                                P.category_of("path").alias("category"), P.is_test_path("path").alias("is_test"))


S_CLASSIFY = duck(f"""with p as (select repo_id, path from v_files union select repo_id, path from ({MIXED})),
 q as (select *, regexp_extract(path, '([^/]*)$', 1) as base from p),
 r as (select *, case when regexp_matches(base, '^.+\\.[^.]*$') then lower(regexp_extract(base, '(\\.[^.]*)$', 1)) else '' end as ext,
   regexp_replace(base, '^(.+)\\.[^.]*$', '\\1') as stem from q)
 select repo_id, path,
  case when base = 'Dockerfile' or base like 'Dockerfile.%' then 'dockerfile' when base like '.env.%' then 'config'
   when ext = '.ts' then 'typescript' when ext = '.py' then 'python' when ext = '.md' then 'markdown'
   when ext in ('.yml', '.yaml') then 'yaml' when ext = '.swift' then 'swift' when ext = '.sql' then 'sql'
   when ext = '.java' then 'java' when ext = '.go' then 'go' when ext = '.sh' then 'shell'
   when ext <> '' then substr(ext, 2) when base = 'Makefile' then 'makefile' else 'unknown' end as language,
  case when base = 'LICENSE' then 'code' when base = 'Makefile' or base like 'Dockerfile%' then 'infra'
   when path like '.github/workflows/%' or path like '%/k8s/%' then 'infra'
   when ext = '.md' then 'docs' when ext in ('.yml', '.yaml') then 'config' when ext = '.sql' then 'data'
   when ext = '.sh' then 'script' when base like '.env%' then 'config' else 'code' end as category,
  case when ext = '.ts' then stem like '%.test' or stem like '%.spec' when ext = '.py' then stem like 'test\\_%' escape '\\' or stem like '%\\_test' escape '\\'
   when ext = '.java' then regexp_matches(stem, '(Test|Tests|IT)$') when ext = '.go' then stem like '%\\_test' escape '\\'
   when ext = '.swift' then regexp_matches(stem, '(Test|Tests)$') else false end as is_test from r""")


def q_path_parts(spark, sf):
    p = mixed(spark, sf).unionByName(view(spark, sf, "v_files").select("repo_id", "path", "p_partkey"))
    n = T.normalize("path")
    return p.select("p_partkey", n.alias("normal"), T.directory(n).alias("dir"), T.basename(n).alias("base"),
                    T.file_extension(n).alias("ext"), T.stem(n).alias("stem"), T.top_directory(n).alias("top"),
                    T.resolve(T.directory(n), F.concat(F.lit("../../"), T.basename(n))).alias("up_two"),
                    T.is_safe_relative("path").alias("safe"))


S_PATH_PARTS = duck(f"""with p as (select path, p_partkey from ({MIXED}) union all select path, p_partkey from v_files),
 n as (select p_partkey, path, array_to_string(list_filter(regexp_split_to_array(path, '[/\\\\]'), lambda x: x <> ''), '/') as normal from p),
 m as (select *, string_split(normal, '/') as s from n)
 select p_partkey, normal, array_to_string(s[:-2], '/') as dir, s[-1] as base,
  case when regexp_matches(s[-1], '^.+\\.[^.]*$') then lower(regexp_extract(s[-1], '(\\.[^.]*)$', 1)) else '' end as ext,
  regexp_replace(s[-1], '^(.+)\\.[^.]*$', '\\1') as stem, case when len(s) > 1 then s[1] end as top,
  case when len(s) < 3 then '' else array_to_string(list_append(s[:-4], s[-1]), '/') end as up_two,
  path <> '' and path not like '/%' and not list_contains(string_split(path, '/'), '..') as safe from m""")

EXCLUDES = ["*.md", "!p1*.md", "/src/api/", "lib/**/p?2*.py", "# a comment", "web/components/p[0-4]*.ts", "!**/*.TEST.ts  "]


def q_ignore(spark, sf):
    return P.apply_ignore(view(spark, sf, "v_files").select("repo_id", "path"), excludes=EXCLUDES)


S_IGNORE = duck("""select repo_id, path, case when regexp_matches(path, '(?i)^(.*/)?[^/]*\\.test\\.ts(/.*)?$') then false
 when regexp_matches(path, '(?i)^web/components/p[0-4][^/]*\\.ts(/.*)?$') then true
 when regexp_matches(path, '(?i)^lib/(.*/)?p[^/]2[^/]*\\.py(/.*)?$') then true
 when regexp_matches(path, '(?i)^src/api/.*$') then true
 when regexp_matches(path, '(?i)^(.*/)?p1[^/]*\\.md(/.*)?$') then false
 when regexp_matches(path, '(?i)^(.*/)?[^/]*\\.md(/.*)?$') then true else false end as ignored,
 false as ignored_by_default from v_files""")

# Every repository's own rule file: hide its markdown, but keep what its number of files says.
RULE_FILES = """select repo_id, 2 as layer_no, '*.md' || chr(10) || '# keep' || chr(10) || '!p' || cast(repo_id as varchar(20))
 || '*.md' || chr(10) || 'app/' || chr(10) || '*.test.ts' || chr(10) || '!/src/**/p*5.test.ts' as content
 from v_files group by repo_id"""
S_RULES = """case when regexp_matches(path, '(?i)^src/(.*/)?p[^/]*5\\.test\\.ts(/.*)?$') then false
 when regexp_matches(path, '(?i)^(.*/)?[^/]*\\.test\\.ts(/.*)?$') then true
 when regexp_matches(path, '(?i)^(.*/)?app/.*$') then true
 when regexp_matches(path, '(?i)^(.*/)?p' || repo_id || '[^/]*\\.md(/.*)?$') then false
 when regexp_matches(path, '(?i)^(.*/)?[^/]*\\.md(/.*)?$') then true else false end"""


def rules(spark, sf):
    return P.layered_rules(query(spark, sf, RULE_FILES))


def q_repo_rules(spark, sf):
    return P.apply_ignore(view(spark, sf, "v_files").select("repo_id", "path"), rules(spark, sf)).select(
        "repo_id", "path", "ignored")


def q_user_filtered(spark, sf):
    return P.user_filtered_counts(view(spark, sf, "v_files").select("repo_id", "path"), rules(spark, sf))


def q_ignore_effect(spark, sf):
    n = view(spark, sf, "v_files").select("repo_id", F.col("path").alias("file_path"))
    return P.ignore_effect(n, ["*.py", "src/", "!src/api/"])


S_IGNORE_EFFECT = duck("""select repo_id, count(*) filter (where case when regexp_matches(path, '^src/api/.*$') then false
  when regexp_matches(path, '^(.*/)?src/.*$') then true else path like '%.py' end) as excluded, count(*) as total
 from (select distinct repo_id, path from v_files) group by 1""")

GITIGNORES = """select repo_id, '# made' || chr(10) || 'dist/' || chr(10) || ' tmp' || cast(count(*) as varchar(20))
 || '/ ' || chr(10) || chr(10) || '*.bak' as content from v_files group by repo_id"""


def q_suggest(spark, sf):
    projects = query(spark, sf, "select repo_id, array(case when repo_id % 2 = 0 then 'python' else 'go' end, 'css') as languages"
                                " from v_files group by repo_id")
    return P.suggest_rules(query(spark, sf, GITIGNORES), projects).select("repo_id", "origin", "pattern")


S_SUGGEST = duck("""with n as (select repo_id, count(*) as c from v_files group by 1)
 select repo_id, 'gitignore' as origin, 'tmp' || c || '/' as pattern from n union all select repo_id, 'gitignore', '*.bak' from n
 union all select repo_id, 'tests', '**/*_test.go' from n where repo_id % 2 = 1
 union all select repo_id, 'tests', p from n, (values ('**/test_*.py'), ('**/*_test.py'), ('tests/')) t(p) where repo_id % 2 = 0""")


def q_readable(spark, sf):
    req = query(spark, sf, "select repo_id, case when p_partkey % 5 = 0 then '/' || path when p_partkey % 5 = 1"
                           " then '../' || path when p_partkey % 5 = 2 then path || 'x' else path end as path from v_files")
    nodes = view(spark, sf, "v_files").select("repo_id", F.col("path").alias("file_path"))
    return P.readable_paths(req, nodes)


S_READABLE = duck("select repo_id, path from v_files where p_partkey % 5 > 2")


def q_hide(spark, sf):
    nodes, edges = P.hide_categories(query(spark, sf, "select *, case when type = 'class' then 'config' else type end as t2 from v_nodes")
                                     .withColumn("type", F.col("t2")).drop("t2"), view(spark, sf, "v_repo_edges"), ["config"])
    return nodes.groupBy("repo_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")).unionByName(
        edges.groupBy("repo_id").agg(F.count("*").alias("n")).withColumn("what", F.lit("edges")))


S_HIDE = duck("""select repo_id, count(*) as n, 'nodes' as what from v_nodes where type <> 'class' group by 1
 union all select repo_id, count(*), 'edges' from v_repo_edges where source not like 'class:%' and target not like 'class:%' group by 1""")


def q_filter(spark, sf):
    return P.filter_paths(view(spark, sf, "v_files").select("repo_id", F.col("path").alias("file_path")), "API/P1")


S_FILTER = duck("select repo_id, path as file_path from v_files where contains(lower(path), 'api/p1')")


def q_file_level(spark, sf):
    return P.file_level(view(spark, sf, "v_nodes")).select("repo_id", "id")


S_FILE_LEVEL = duck(f"select repo_id, id from v_nodes where type in {sql_list(dims.FILE_LEVEL_TYPES)}")


def q_binary(spark, sf):
    src = query(spark, sf, "select page_id, cast(case when page_id % 3 = 0 then html || chr(0) else html end as binary)"
                           " as content_bytes from pages")
    return P.binary_files(src).select("page_id")


S_BINARY = "select page_id from pages where page_id % 3 = 0"


def q_layers(spark, sf):
    nodes = file_nodes(spark, sf)
    table, members = B.layers(nodes)
    return table.select("repo_id", "layer_id", "name", "n_members", "layer_ord")


def file_nodes(spark, sf):
    f = view(spark, sf, "v_files").select("repo_id", "path", F.col("n_lines").alias("size_lines"))
    return B.file_nodes(P.with_category(P.with_language(f)))


LAYER_SQL = """case when path like 'src/api/%' then 'API Layer' when path like 'src/services/%' then 'Service Layer'
 when path like 'lib/models/%' then 'Data Layer' when path like 'web/components/%' then 'UI Layer' else 'Core' end"""
S_LAYERS = duck(f"""with l as (select repo_id, {LAYER_SQL} as name, min(path) as f, count(*) as n_members from v_files group by 1, 2)
 select repo_id, 'layer:' || replace(lower(name), ' ', '-') as layer_id, name, n_members,
  cast(row_number() over (partition by repo_id order by f) - 1 as integer) as layer_ord from l""")


def q_members(spark, sf):
    _, members = B.layers(file_nodes(spark, sf))
    return members.select("repo_id", "layer_id", "node_id")


NODE_ID = "case when path like '%.md' then 'document:' else 'file:' end || path"
S_MEMBERS = duck(f"""select repo_id, 'layer:' || replace(lower({LAYER_SQL}), ' ', '-') as layer_id, {NODE_ID} as node_id from v_files""")


def q_file_nodes(spark, sf):
    return file_nodes(spark, sf).select("repo_id", "id", "type", "name", "complexity", F.array_join("tags", ",").alias("tags"))


S_FILE_NODES = duck(f"""select repo_id, {NODE_ID} as id, case when path like '%.md' then 'document' else 'file' end as type,
 regexp_extract(path, '([^/]*)$', 1) as name,
 case when n_lines < 50 then 'simple' when n_lines < 201 then 'moderate' else 'complex' end as complexity,
 case when path like '%.md' then 'documentation,docs' when path like '%.test.ts' then 'test,typescript'
  when path like '%.ts' then 'typescript,code' else 'python,code' end as tags from v_files""")


def q_languages(spark, sf):
    return B.primary_languages(P.with_language(view(spark, sf, "v_files"))).select("repo_id", "language", "n", "rank")


S_LANGUAGES = duck("""with c as (select repo_id, case when path like '%.ts' then 'typescript' else 'python' end as language,
 count(*) as n from v_files where path not like '%.md' group by 1, 2)
 select repo_id, language, n, cast(row_number() over (partition by repo_id order by n desc, language) as integer) as rank from c""")


def q_size(spark, sf):
    return B.project_size(view(spark, sf, "v_files"))


S_SIZE = duck("""select repo_id, count(*) as total_files, case when count(*) <= 30 then 'small' when count(*) <= 150 then 'moderate'
 when count(*) <= 500 then 'large' else 'very-large' end as complexity from v_files group by 1""")

QUERIES = {
    "classify_paths": (q_classify, S_CLASSIFY),
    "path_parts": (q_path_parts, S_PATH_PARTS),
    "ignore_filter": (q_ignore, S_IGNORE),
    "ignore_repo_rules": (q_repo_rules, duck(f"select repo_id, path, {S_RULES} as ignored from v_files")),
    "user_filtered_counts": (q_user_filtered, duck(f"select repo_id, count(*) filter (where {S_RULES}) as filtered_by_ignore"
                                                   " from v_files group by 1")),
    "ignore_effect": (q_ignore_effect, S_IGNORE_EFFECT),
    "suggest_rules": (q_suggest, S_SUGGEST),
    "readable_paths": (q_readable, S_READABLE),
    "hide_categories": (q_hide, S_HIDE),
    "filter_paths": (q_filter, S_FILTER),
    "file_level": (q_file_level, S_FILE_LEVEL),
    "binary_files": (q_binary, S_BINARY),
    "layers": (q_layers, S_LAYERS),
    "layer_members": (q_members, S_MEMBERS),
    "file_nodes": (q_file_nodes, S_FILE_NODES),
    "primary_languages": (q_languages, S_LANGUAGES),
    "project_size": (q_size, S_SIZE),
}
