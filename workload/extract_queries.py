"""Extraction over source text made from the driver's tables: one file per part, in many languages."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.operators import extract as X
from lodemap.operators.paths import with_language
from lodemap.plans.cut import cut
from workload.views import duck, query, table, view

# Path ending, text and expected declarations (kind, name, first line, last line). {k} is the part's key and ~ a line
# break; every file starts with p_size % 3 blank lines, which shift all line numbers.
TEMPLATES = [
    ("src/c{k}.py", "import os~class C{k}(Base):~    size: int = 1~    def m(self, a):~        return run(a)~~def f{k}(x=1):~    # def no(): pass~    return C{k}(x)~",
     [("class", "C{k}", 2, 5), ("function", "C{k}.m", 4, 5), ("function", "f{k}", 7, 9), ("import", "os", 1, 1)]),
    ("src/A{k}.java", "package a.b;~import x.Y{k};~public class A{k} {~  private int n{k} = 1;~  public int get(int a) {~    return go(a);~  }~}~",
     [("class", "A{k}", 3, 8), ("function", "A{k}.get", 5, 7), ("import", "package:a.b", 1, 1), ("import", "x.Y{k}", 2, 2)]),
    ("cmd/m{k}.go", 'package main~~import (~\t"fmt"~)~~type T{k} struct {~\tA int~}~~func (t *T{k}) Run() {~\tfmt.Println(1)~}~',
     [("class", "T{k}", 7, 9), ("function", "Run", 11, 13), ("import", "package:main", 1, 1), ("import", "fmt", 4, 4)]),
    ("db/t{k}.sql", "CREATE TABLE t{k} (~  id INT,~  PRIMARY KEY (id)~);~CREATE VIEW v{k} AS SELECT 1;~ALTER TABLE o{k} ADD x INT;~",
     [("definition", "t{k}", 1, 4), ("definition", "v{k}", 5, 5), ("import", "table:o{k}", 6, 6)]),
    ("docs/d{k}.md", "# Top {k}~[a](x{k}.md)~## Sub~```~# no~```~## Last~",
     [("section", "Top {k}", 1, 7), ("section", "Sub", 3, 6), ("section", "Last", 7, 7), ("import", "x{k}.md", 2, 2)]),
    ("img{k}/Dockerfile", "FROM base:{k} AS s{k}~EXPOSE 80~FROM reg/app:1~",
     [("service", "s{k}", 1, 2), ("service", "app", 3, 3), ("step", "FROM base:{k} AS s{k}", 1, 1), ("step", "EXPOSE 80", 2, 2), ("step", "FROM reg/app:1", 3, 3)]),
    ("infra/m{k}.tf", 'resource "r" "n{k}" {~  a = 1~}~variable "v{k}" {}~', [("resource", "r.n{k}", 1, 3), ("definition", "v{k}", 4, 4)]),
    ("api/s{k}.proto", "message M{k} {~  string a = 1;~}~service S{k} {~  rpc Get(M) returns (M);~}~", [("definition", "M{k}", 1, 3), ("endpoint", "S{k}.Get", 5, 5)]),
    ("src/r{k}.rs", "use a::B{k};~pub fn f{k}(a: i32) {~  if a {~  }~}~", [("import", "a::B{k}", 1, 1), ("function", "f{k}", 2, 5)]),
    ("web/s{k}.css", '@import "b{k}.css";~.c{k} {~  color: red;~}~', [("import", "b{k}.css", 1, 1), ("section", ".c{k}", 2, 4)]),
    ("conf/c{k}.toml", "[a{k}]~x = 1~[[b]]~", [("section", "a{k}", 1, 2), ("section", "[[b]]", 3, 3)]),
    ("web/w{k}.ts", "import {~  a as b,~  c~} from './m{k}';~export const go = (x) => {~  call(x);~};~export interface I{k} {~  p: string;~}~",
     [("import", "./m{k}", 1, 1), ("function", "go", 5, 7), ("class", "I{k}", 8, 10)]),
]
M = len(TEMPLATES)


def _case(i: int, text: str) -> str:
    quoted = text.replace("\\", "\\\\").replace("'", "''").replace("\t", "    ")
    return f"when {i} then '{quoted}'"


def _filled(expr: str) -> str:
    return f"replace(replace({expr}, '{{k}}', cast(p_partkey as varchar(20))), '~', chr(10))"


FILES_SQL = f"""select p_partkey % 7 as repo_id, {_filled(f"(case p_partkey % {M} " + ' '.join(_case(i, t[0]) for i, t in enumerate(TEMPLATES)) + " end)")} as path,
 repeat(chr(10), p_size % 3) || {_filled(f"(case p_partkey % {M} " + ' '.join(_case(i, t[1]) for i, t in enumerate(TEMPLATES)) + " end)")} as content from part"""


def files(spark, sf):
    return with_language(query(spark, sf, FILES_SQL, dealt=("part",)))


def q_packs(spark, sf):
    t = X.extract(files(spark, sf))
    cols = ["repo_id", "path", "kind", "name", "line_start", "line_end"]
    parts = [
        t["classes"].withColumn("kind", F.lit("class")), t["functions"].withColumn("kind", F.lit("function")),
        t["imports"].withColumn("kind", F.lit("import")).withColumn("name", F.col("source")).withColumn("line_start", F.col("line")).withColumn("line_end", F.col("line")),
        t["definitions"].withColumn("kind", F.lit("definition")), t["sections"].withColumn("kind", F.lit("section")),
        t["services"].withColumn("kind", F.lit("service")), t["steps"].withColumn("kind", F.lit("step")),
        t["resources"].withColumn("kind", F.lit("resource")), t["endpoints"].withColumn("kind", F.lit("endpoint")).withColumn("name", F.col("endpoint")),
    ]
    out = parts[0].select(*cols)
    for p in parts[1:]:
        out = out.unionByName(p.select(*cols))
    return out


_ROWS = ",\n ".join(f"({i}, '{kind}', '{name}', {a}, {b})" for i, (_, _, want) in enumerate(TEMPLATES) for kind, name, a, b in want)
S_PACKS = f"""with f as (select *, p_partkey % 7 as repo_id, {_filled(f"(case p_partkey % {M} " + ' '.join(_case(i, t[0]) for i, t in enumerate(TEMPLATES)) + " end)")} as path from part),
 w(i, kind, nm, a, b) as (values {_ROWS})
 select repo_id, path, kind, replace(nm, '{{k}}', cast(p_partkey as varchar)) as name, cast(a + p_size % 3 as integer) as line_start, cast(b + p_size % 3 as integer) as line_end
 from f join w on f.p_partkey % {M} = w.i"""


# --- TypeScript sources that import each other --------------------------------------------------

def source(spark, sf):
    return with_language(view(spark, sf, "v_source"))


def code(spark, sf):
    return X.code_tables(cut(X.marks(source(spark, sf))))


def q_imports(spark, sf):
    return code(spark, sf)["imports"].select("repo_id", "path", "source", F.array_join("specifiers", ",").alias("specifiers"), "line")


S_IMPORTS = duck("""select repo_id, importer as path, spec as source, 'x' as specifiers, cast(row_number() over (partition by repo_id, importer order by spec) as integer) as line
 from v_specs where importer like '%.ts'""")


def q_functions(spark, sf):
    return code(spark, sf)["functions"].select("repo_id", "path", "name", F.array_join("params", ",").alias("params"), "line_start", "line_end")


_COUNT = "(select count(*) from v_specs s where s.repo_id = f.repo_id and s.importer = f.path)"
S_FUNCTIONS = duck(f"""select f.repo_id, f.path, 'f' || p_partkey as name, 'a,b' as params, cast(1 + {_COUNT} as integer) as line_start, cast(3 + {_COUNT} as integer) as line_end
 from v_files f where path like '%.ts'""")


def q_calls(spark, sf):
    return code(spark, sf)["calls"]


S_CALLS = duck(f"select f.repo_id, f.path, 'f' || p_partkey as caller, 'g' as callee, cast(2 + {_COUNT} as integer) as line from v_files f where path like '%.ts'")


# --- lines, depths and links of the driver's own texts -------------------------------------------

def q_lines(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit(1).cast("long").alias("repo_id"), F.col("doc_id").cast("string").alias("path"),
                                                F.lit("plaintext").alias("language"), F.col("text").alias("content"))
    lines = X.lines(docs)
    return lines.groupBy("path").agg(F.count("*").alias("n_lines"), F.sum("depth").alias("depths"), F.max("depth").alias("deepest"),
                                     F.sum("indent").alias("indents"), F.count_if(F.col("blank")).alias("blanks"))


S_LINES = r"""with l as (select doc_id, unnest(string_split(text, chr(10))) as raw, unnest(range(1, len(string_split(text, chr(10))) + 1)) as n, len(string_split(text, chr(10))) as total from documents),
 k as (select * from l where not (n = total and total > 1 and raw = '')),
 c as (select doc_id, n, unnest(b) as ch, unnest(range(1, len(b) + 1)) as pos from (select doc_id, n, regexp_extract_all(regexp_replace(raw, '"[^"\\\n]*(\\[^\n]?[^"\\\n]*)*"?', '', 'g'), '[\[\](){}]') as b from k)),
 s as (select doc_id, n, pos, sum(case when ch in ('(', '[', '{') then 1 else -1 end) over w as s from c window w as (partition by doc_id order by n, pos)),
 d as (select doc_id, n, pos, s - least(0, min(s) over (partition by doc_id order by n, pos)) as d from s),
 e as (select doc_id, n, arg_max(d, pos) as d from d group by 1, 2),
 g as (select k.*, coalesce(last_value(e.d ignore nulls) over (partition by k.doc_id order by k.n rows between unbounded preceding and 1 preceding), 0) as depth from k left join e on e.doc_id = k.doc_id and e.n = k.n)
 select cast(doc_id as varchar) as path, count(*) as n_lines, cast(sum(depth) as bigint) as depths, cast(max(depth) as bigint) as deepest,
  cast(sum(length(regexp_extract(raw, '^[ \t]*', 0))) as bigint) as indents, count(*) filter (where trim(raw, ' ' || chr(9)) = '') as blanks from g group by 1"""


def q_html(spark, sf):
    pages = table(spark, sf, "pages").select((F.col("page_id") % 3).alias("repo_id"), F.concat("page_id", F.lit(".html")).alias("path"),
                                             F.lit("html").alias("language"), F.col("html").alias("content"))
    out = X.markup(X.other_lines(pages))
    return out["imports"].groupBy("path").agg(F.count("*").alias("n")).withColumn("kind", F.lit("assets")).unionByName(
        out["sections"].groupBy("path").agg(F.count("*").alias("n")).withColumn("kind", F.lit("landmarks")))


S_HTML = r"""with l as (select page_id, unnest(string_split(html, chr(10))) as raw from pages),
 c as (select * from l where trim(regexp_replace(raw, '<!--.*?-->', '', 'g')) <> '')
 select page_id || '.html' as path, count(*) as n, 'assets' as kind from (select page_id, unnest(regexp_extract_all(raw, '(?i)(?:src|href)\s*=\s*["'']([^"'']+)["'']', 1)) as h from c)
  where not regexp_matches(h, '^(http|//|#|data:)') group by 1
 union all select page_id || '.html', count(*), 'landmarks' from c where regexp_matches(raw, '(?i)<(header|nav|main|section|article|aside|footer|form|table)\b') group by 1"""

QUERIES = {
    "extract_packs": (q_packs, S_PACKS),
    "extract_imports": (q_imports, S_IMPORTS),
    "extract_functions": (q_functions, S_FUNCTIONS),
    "extract_calls": (q_calls, S_CALLS),
    "line_metrics": (q_lines, S_LINES),
    "html_markup": (q_html, S_HTML),
}
