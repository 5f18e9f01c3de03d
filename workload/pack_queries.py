"""Extraction in the languages that ``extract_packs`` doesn't have: one file per part, template by key, like there."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodemap.operators import extract as X
from lodemap.operators.paths import with_language
from workload.extract_queries import _case, _filled
from workload.views import query

# Path, text and expected declarations (kind, name, first line, last line); {k} is the part's key, ~ a line break. A type
# without a body takes the next block that opens within three lines (Kotlin), that is a rule and no slip.
TEMPLATES = [
    ("lib/a{k}.rb", "require 'set{k}'~class C{k}~  attr_reader :a~  def bar(x)~    baz(x)~  end~end~def top{k}~end~",
     [("import", "set{k}", 1, 1), ("class", "C{k}", 2, 6), ("function", "C{k}.bar", 4, 5), ("function", "top{k}", 8, 8)]),
    ("x{k}.lua", "local j = require 'json{k}'~function M.go{k}(a)~  run(a)~end~local hid = function(b)~end~",
     [("import", "json{k}", 1, 1), ("function", "go{k}", 2, 3), ("function", "hid", 5, 5)]),
    ("bin/run{k}.sh", "source ./env{k}.sh~setup{k}() {~  build_it~}~function two~{~  x~}~",
     [("import", "./env{k}.sh", 1, 1), ("function", "setup{k}", 2, 4), ("function", "two", 5, 8)]),
    ("bin/a{k}.ps1", "Import-Module Foo{k}~function Get-It{k} {~  param($Name, $Size)~  Do-It~}~",
     [("import", "Foo{k}", 1, 1), ("function", "Get-It{k}", 2, 5)]),
    ("src/A{k}.kt", "package k~import k.b{k}~data class P{k}(val x: Int)~fun f{k}(a: Int) {~  g(a)~}~",
     [("import", "package:k", 1, 1), ("import", "k.b{k}", 2, 2), ("class", "P{k}", 3, 6), ("function", "f{k}", 4, 6)]),
    ("src/A{k}.scala", "import a.b{k}~object O{k} {~  def run(x: Int) = y(x)~}~",
     [("import", "a.b{k}", 1, 1), ("class", "O{k}", 2, 4), ("function", "O{k}.run", 3, 3)]),
    ("src/A{k}.cs", "using System{k};~namespace N{k};~public class C{k} {~  public void Do(int a) {~    Run(a);~  }~}~",
     [("import", "System{k}", 1, 1), ("import", "package:N{k}", 2, 2), ("class", "C{k}", 3, 7), ("function", "C{k}.Do", 4, 6)]),
    ("src/A{k}.swift", "import UIKit~struct S{k} {~    let a: Int~    func go(_ x: Int) {~        call(x)~    }~}~func free{k}() {~}~",
     [("import", "UIKit", 1, 1), ("class", "S{k}", 2, 7), ("function", "S{k}.go", 4, 6), ("function", "free{k}", 8, 9)]),
    ("src/a{k}.php", "<?php~namespace App;~use App{k};~class C{k} {~  public $a;~  function m($x) { go($x); }~}~",
     [("import", "package:App", 2, 2), ("import", "App{k}", 3, 3), ("class", "C{k}", 4, 7), ("function", "C{k}.m", 6, 6)]),
    ("lib/a{k}.dart", "import \"b{k}.dart\";~class W{k} {~  final int n = 1;~  void build(int c) { draw(c); }~}~void main() {~  run();~}~",
     [("import", "b{k}.dart", 1, 1), ("class", "W{k}", 2, 5), ("function", "W{k}.build", 4, 4), ("function", "main", 6, 8)]),
    ("src/a{k}.c", "#include \"x{k}.h\"~struct node{k} {~  int v;~};~static int sum{k}(int a, int b) {~  return add(a, b);~}~",
     [("import", "x{k}.h", 1, 1), ("class", "node{k}", 2, 4), ("function", "sum{k}", 5, 7)]),
    (".github/workflows/ci{k}.yml", "name: CI{k}~jobs:~  build{k}:~    steps:~      - name: Check out {k}~  test:~    x: 1~",
     [("section", "name", 1, 1), ("section", "jobs", 2, 7), ("step", "build{k}", 3, 5), ("step", "Check out {k}", 5, 5), ("step", "test", 6, 7)]),
    ("conf/t{k}.json", '{~  "a{k}": {~    "$ref": "other{k}.json"~  },~  "b": 1~}~',
     [("section", "a{k}", 2, 4), ("section", "b", 5, 5), ("import", "other{k}.json", 3, 3)]),
    ("conf/app{k}.env", "# c~export KEY{k}=1~B = 2~", [("definition", "KEY{k}", 2, 2), ("definition", "B", 3, 3)]),
    ("api/s{k}.graphql", "type User{k} {~  id: ID~  posts(n: Int): [Post]~}~type Query {~  me{k}: User~}~scalar Date{k}~",
     [("definition", "User{k}", 1, 4), ("definition", "Date{k}", 8, 8), ("endpoint", "me{k}", 6, 6)]),
    ("m{k}/Makefile", "X := 1~all{k}: build~\techo~~build:~\tcc a.c~.PHONY: all~", [("step", "all{k}", 2, 3), ("step", "build", 5, 6)]),
    ("web/w{k}.vue", "<template>~  <p>import x</p>~</template>~<script>~import a from './m{k}';~export function go{k}(x) {~  call(x);~}~</script>~",
     [("import", "./m{k}", 5, 5), ("function", "go{k}", 6, 8)]),
    ("notes/n{k}.txt", "import a~def f{k}(x):~  pass~", []),
]
KINDS = ["class", "function", "definition", "section", "service", "step", "resource", "endpoint"]
M = len(TEMPLATES)
PATH = _filled(f"(case p_partkey % {M} " + " ".join(_case(i, t[0]) for i, t in enumerate(TEMPLATES)) + " end)")
TEXT = _filled(f"(case p_partkey % {M} " + " ".join(_case(i, t[1]) for i, t in enumerate(TEMPLATES)) + " end)")
FILES_SQL = f"select p_partkey % 7 as repo_id, {PATH} as path, repeat(chr(10), p_size % 3) || {TEXT} as content from part"


def files(spark, sf):
    return with_language(query(spark, sf, FILES_SQL, dealt=("part",)))


def declared(tables):
    """(repo_id, path, kind, name, line_start, line_end) of every declaration."""
    out = tables["imports"].select("repo_id", "path", F.lit("import").alias("kind"), F.col("source").alias("name"), F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    for kind in KINDS:
        plural = kind + ("es" if kind == "class" else "s")
        out = out.unionByName(tables[plural].select("repo_id", "path", F.lit(kind).alias("kind"), F.col("endpoint" if kind == "endpoint" else "name").alias("name"), "line_start", "line_end"))
    return out


def q_packs(spark, sf):
    return declared(X.extract(files(spark, sf)))


_ROWS = ",\n ".join(f"({i}, '{kind}', '{name}', {a}, {b})" for i, (_, _, want) in enumerate(TEMPLATES) for kind, name, a, b in want)
S_PACKS = f"""with f as (select *, p_partkey % 7 as repo_id, {PATH} as path from part), w(i, kind, nm, a, b) as (values {_ROWS})
 select repo_id, path, kind, replace(nm, '{{k}}', cast(p_partkey as varchar)) as name, cast(a + p_size % 3 as integer) as line_start, cast(b + p_size % 3 as integer) as line_end
 from f join w on f.p_partkey % {M} = w.i"""

QUERIES = {"extract_more_packs": (q_packs, S_PACKS)}
