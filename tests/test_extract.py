"""Declarations of small files in every language that has rules."""

import pytest
from pyspark.sql import functions as F

from lodemap.operators import extract as X
from lodemap.operators.paths import with_language

FILES = {
    "src/a.ts": """// export function no() {}
import {
  x as y,
  z
} from './lib';
import type { T } from "./types";
import './side';
export { b as c } from './b';
export * from './all';
const q = require('./req');
/* export class Hidden {} */
export default class User extends Base {
  private name: string = "a";
  constructor(private id: number, { a, b } = {}) {
    init(id);
  }
  save(cb: () => void, ...rest): void {
    this.store(cb("if ("));
  }
}
export interface Shape { }
export type Alias = string;
enum Color { Red }
export async function load(url: string, n = 3): Promise<void> {
  fetchIt(url);
}
export const add = (a, b) => a + b;
export const LIMIT = 3;
const text = "export function quoted() {}";
""",
    "pkg/m.py": '''"""doc
def nope(): pass
"""
import os, sys as system
from .util import (one, two as deux)

class Cat(Animal):
    name: str = "x"

    def speak(self, *args, **kw):
        # def hidden(): pass
        helper(1)

    async def run(self,
                  times=3) -> None:
        pass

def main(a: int, b=2) -> int:
    return work(a)


x = 1
''',
    "go/main.go": """package main

import (
	"fmt"
	u "example.com/m/util"
)

type Server struct {
	Port int
	name string
}

func (s *Server) Start(addr string) error {
	return listen(addr)
}

func helper() {
	fmt.Println(1)
}
""",
    "lib/a.rb": "require 'set'\nclass Foo\n  attr_reader :a, :b\n  def bar(x)\n    baz(x)\n  end\nend\ndef top\nend\n",
    "x.lua": "local j = require 'json'\nfunction M.go(a)\n  run(a)\nend\nlocal hid = function(b)\nend\n",
    "run.sh": "source ./env.sh\nsetup() {\n  build_it\n}\nfunction two\n{\n  x\n}\n",
    "a.ps1": "Import-Module Foo\nfunction Get-It {\n  param($Name, $Size)\n  Do-It\n}\n",
    "b.bat": ":start\necho hi\n",
    "A.java": "package com.x;\nimport com.y.Thing;\npublic class A {\n  private int n = 1;\n  public int get(int a) { return calc(a); }\n}\nclass B {}\n",
    "A.kt": "package k\nimport k.b\ndata class P(val x: Int)\nfun f(a: Int) { g(a) }\n",
    "A.scala": "import a.b\nobject O {\n  def run(x: Int) = y(x)\n}\n",
    "A.cs": "using System;\nnamespace N;\npublic class C {\n  public void Do(int a) { Run(a); }\n}\n",
    "A.swift": "import UIKit\nstruct S {\n    let a: Int\n    func go(_ x: Int) {\n        call(x)\n    }\n}\nfunc free() {\n}\n",
    "a.rs": "use crate::a::B;\nmod util;\npub struct P {\n    x: i32,\n}\nimpl P {\n    pub fn new(a: i32) -> P { make(a) }\n}\nfn hid() {}\n",
    "a.php": "<?php\nnamespace App;\nuse App\\Foo;\nclass C {\n  public $a;\n  function m($x) { go($x); }\n}\n",
    "a.dart": "import 'b.dart';\nclass W {\n  final int n = 1;\n  void build(int c) { draw(c); }\n}\nvoid main() {\n  run();\n}\n",
    "a.c": "#include \"x.h\"\nstruct node {\n  int v;\n};\nstatic int sum(int a, int b) {\n  return add(a, b);\n}\n",
    "README.md": "# Top\nsee [a](src/a.ts) [w](http://x) [h](#h)\n## One\n```\n# not\n[no](no.md)\n```\n### Deep\n## Two\n",
    ".github/workflows/ci.yml": "name: CI\njobs:\n  build:\n    steps:\n      - name: Check out\n  test:\n    x: 1\n",
    "docker-compose.yml": "version: '3'\nservices:\n  web:\n    image: \"nginx:1\"\n    ports:\n      - \"8080:80\"\n  db:\n    image: pg\nvolumes:\n  d: {}\n",
    "t.json": '{\n  "a": {\n    "$ref": "other.json"\n  },\n  "b": 1\n}\n',
    "t.toml": "[a.b]\nx = 1\n[[c]]\ny = 2\n",
    "app.env": "# c\nexport KEY=1\nB = 2\n",
    "Dockerfile": "FROM node:18 AS build\nRUN npm ci\nEXPOSE 80 443/tcp\nFROM reg/nginx:1\nCOPY . .\n",
    "s.sql": "CREATE TABLE users (\n  id INT PRIMARY KEY,\n  \"name\" TEXT,\n  PRIMARY KEY (id)\n);\nCREATE VIEW v AS SELECT 1;\nCREATE INDEX ix ON users(id);\nALTER TABLE old ADD x INT;\n",
    "s.graphql": "type User {\n  id: ID\n  posts(n: Int): [Post]\n}\ntype Query {\n  me: User\n}\nscalar Date\n",
    "s.proto": "import \"a.proto\";\nmessage M {\n  repeated string a = 1;\n}\nenum E {\n  X = 0;\n}\nservice S {\n  rpc Get(M) returns (M);\n}\n",
    "m.tf": "resource \"aws_s3\" \"b\" {\n  x = 1\n}\ndata \"d\" \"n\" {}\nmodule \"m\" {}\nvariable \"v\" {}\noutput \"o\" {}\n",
    "Makefile": "X := 1\nall: build\n\techo\n\nbuild:\n\tcc a.c\n.PHONY: all\n",
    "i.html": "<main id=\"m\">\n<a href=\"/x.html\">a</a><img src='http://y'>\n</main>\n",
    "i.css": "@import \"base.css\";\n.a {\n  color: red;\n}\n",
}


@pytest.fixture(scope="module")
def found(spark):
    files = with_language(spark.createDataFrame([(1, p, c) for p, c in FILES.items()], "repo_id long, path string, content string"))
    return {k: [r.asDict() for r in v.collect()] for k, v in X.extract(files).items()}


def of(found, kind, path, *cols):
    out = [tuple(tuple(r[c]) if isinstance(r[c], list) else r[c] for c in cols) for r in sorted(
        (r for r in found[kind] if r["path"] == path), key=lambda r: (r.get("decl_seq") or r.get("line") or 0, str(r.get("name"))))]
    return out


def test_typescript(found):
    assert of(found, "imports", "src/a.ts", "source", "specifiers") == [
        ("./lib", ("y", "z")), ("./types", ("T",)), ("./side", ()), ("./b", ("c",)), ("./all", ("*",)), ("./req", ())]
    assert of(found, "classes", "src/a.ts", "name", "methods", "properties", "line_start", "line_end") == [
        ("User", ("constructor", "save"), ("name",), 12, 20), ("Shape", (), (), 21, 21), ("Alias", (), (), 22, 22), ("Color", (), (), 23, 23)]
    assert of(found, "functions", "src/a.ts", "name", "params", "return_type", "line_start", "line_end") == [
        ("User.constructor", ("id", "{…}"), None, 14, 14), ("User.save", ("cb",), None, 17, 19),
        ("load", ("url", "n"), "Promise<void>", 24, 26), ("add", ("a", "b"), None, 27, 27)]
    assert sorted(of(found, "exports", "src/a.ts", "name", "is_default")) == sorted([
        ("c", False), ("User", True), ("Shape", False), ("Alias", False), ("load", False), ("add", False), ("LIMIT", False)])
    assert sorted(of(found, "calls", "src/a.ts", "caller", "callee")) == [
        ("User.constructor", "constructor"), ("User.save", "cb"), ("User.save", "save"), ("User.save", "store"), ("load", "fetchIt")]


def test_python(found):
    assert of(found, "imports", "pkg/m.py", "source", "specifiers") == [("os", ("os",)), ("sys", ("system",)), (".util", ("one", "deux"))]
    assert of(found, "classes", "pkg/m.py", "name", "methods", "properties", "line_start", "line_end") == [("Cat", ("speak", "run"), ("name",), 7, 16)]
    assert of(found, "functions", "pkg/m.py", "name", "params", "return_type", "line_start", "line_end") == [
        ("nope", (), None, 2, 2), ("Cat.speak", ("*args", "**kw"), None, 10, 12), ("Cat.run", ("times",), None, 14, 16), ("main", ("a", "b"), "int", 18, 19)]
    assert sorted(of(found, "calls", "pkg/m.py", "caller", "callee")) == [
        ("Cat.run", "run"), ("Cat.speak", "helper"), ("Cat.speak", "speak"), ("main", "work")]


def test_go(found):
    assert of(found, "imports", "go/main.go", "source", "specifiers") == [("package:main", ()), ("fmt", ("fmt",)), ("example.com/m/util", ("u",))]
    assert of(found, "classes", "go/main.go", "name", "methods", "properties") == [("Server", ("Start",), ("Port", "name"))]
    assert of(found, "functions", "go/main.go", "name", "params", "line_start", "line_end") == [("Start", ("string",), 13, 15), ("helper", (), 17, 19)]
    assert {r[0] for r in of(found, "exports", "go/main.go", "name")} == {"Start", "Server"}


@pytest.mark.parametrize("path,functions,classes,imports", [
    ("lib/a.rb", [("Foo.bar", 4, 5), ("top", 8, 8)], [("Foo", ("bar",), ("a", "b"))], ["set"]),
    ("x.lua", [("go", 2, 3), ("hid", 5, 5)], [], ["json"]),
    ("run.sh", [("setup", 2, 4), ("two", 5, 8)], [], ["./env.sh"]),
    ("a.ps1", [("Get-It", 2, 5)], [], ["Foo"]),
    ("b.bat", [("start", 1, 1)], [], []),
    ("A.java", [("A.get", 5, 5)], [("A", ("get",), ("n",)), ("B", (), ())], ["package:com.x", "com.y.Thing"]),
    ("A.kt", [("f", 4, 4)], [("P", (), ())], ["package:k", "k.b"]),
    ("A.scala", [("O.run", 3, 3)], [("O", ("run",), ())], ["a.b"]),
    ("A.cs", [("C.Do", 4, 4)], [("C", ("Do",), ())], ["System", "package:N"]),
    ("A.swift", [("S.go", 4, 6), ("free", 8, 9)], [("S", ("go",), ("a",))], ["UIKit"]),
    ("a.rs", [("P.new", 7, 7), ("hid", 9, 9)], [("P", (), ("x",)), ("P", ("new",), ())], ["crate::a::B", "util"]),
    ("a.php", [("C.m", 6, 6)], [("C", ("m",), ("a",))], ["package:App", "App\\Foo"]),
    ("a.dart", [("W.build", 4, 4), ("main", 6, 8)], [("W", ("build",), ("n",))], ["b.dart"]),
    ("a.c", [("sum", 5, 7)], [("node", (), ("v",))], ["x.h"]),
])
def test_other_code(found, path, functions, classes, imports):
    assert of(found, "functions", path, "name", "line_start", "line_end") == functions
    assert of(found, "classes", path, "name", "methods", "properties") == classes
    assert sorted(r[0] for r in of(found, "imports", path, "source")) == sorted(imports)


def test_parameters_of_script(found):
    assert of(found, "functions", "a.ps1", "params") == [(("Name", "Size"),)]


def test_markdown(found):
    assert of(found, "sections", "README.md", "name", "level", "line_start", "line_end") == [
        ("Top", 1, 1, 9), ("One", 2, 3, 8), ("Deep", 3, 8, 8), ("Two", 2, 9, 9)]
    assert of(found, "imports", "README.md", "source") == [("src/a.ts",)]


def test_yaml(found):
    assert of(found, "sections", ".github/workflows/ci.yml", "name", "line_start", "line_end") == [("name", 1, 1), ("jobs", 2, 7)]
    assert of(found, "steps", ".github/workflows/ci.yml", "name", "line_start", "line_end") == [("build", 3, 5), ("Check out", 5, 5), ("test", 6, 7)]
    assert of(found, "services", "docker-compose.yml", "name", "image", "ports", "line_start", "line_end") == [
        ("web", "nginx:1", (80, 8080), 3, 6), ("db", "pg", (), 7, 8)]


def test_config(found):
    assert of(found, "sections", "t.json", "name", "line_start", "line_end") == [("a", 2, 4), ("b", 5, 5)]
    assert of(found, "imports", "t.json", "source") == [("other.json",)]
    assert of(found, "sections", "t.toml", "name", "level", "line_end") == [("a.b", 2, 2), ("[[c]]", 1, 4)]
    assert of(found, "definitions", "app.env", "name", "kind") == [("KEY", "variable"), ("B", "variable")]


def test_dockerfile(found):
    assert of(found, "services", "Dockerfile", "name", "image", "ports", "line_start", "line_end") == [
        ("build", "node:18", (80, 443), 1, 3), ("nginx", "reg/nginx:1", (), 4, 5)]
    assert of(found, "steps", "Dockerfile", "name")[1] == ("RUN npm ci",)


def test_schemas(found):
    assert of(found, "definitions", "s.sql", "name", "kind", "fields", "line_end") == [
        ("users", "table", ("id", "name"), 5), ("v", "view", (), 6), ("ix", "index", (), 7)]
    assert of(found, "imports", "s.sql", "source") == [("table:old",)]
    assert of(found, "definitions", "s.graphql", "name", "kind", "fields") == [("User", "type", ("id", "posts")), ("Date", "scalar", ())]
    assert of(found, "endpoints", "s.graphql", "method", "endpoint") == [("Query", "me")]
    assert of(found, "definitions", "s.proto", "name", "kind", "fields") == [("M", "message", ("a",)), ("E", "enum", ("X",))]
    assert of(found, "endpoints", "s.proto", "method", "endpoint") == [("rpc", "S.Get")]
    assert of(found, "resources", "m.tf", "name", "kind", "line_end") == [("aws_s3.b", "aws_s3", 3), ("data.d.n", "data.d", 4), ("module.m", "module", 5)]
    assert of(found, "definitions", "m.tf", "name", "kind") == [("v", "variable"), ("o", "output")]
    assert of(found, "steps", "Makefile", "name", "line_start", "line_end") == [("all", 2, 3), ("build", 5, 6)]


def test_markup(found):
    assert of(found, "sections", "i.html", "name") == [("main#m",)] or of(found, "sections", "i.html", "name") == [("main",)]
    assert of(found, "imports", "i.html", "source") == [("/x.html",)]
    assert of(found, "imports", "i.css", "source") == [("base.css",)]
    assert of(found, "sections", "i.css", "name", "line_end") == [(".a", 4)]


def test_parameters_nest_to_any_depth(spark):
    texts = [("f(a, b = (1, (2, (3, (4, (5, (6, 7)))))))", ["a", "b"]), ("f(" + "x = " + "(" * 40 + ")" * 40 + ", y)", ["x", "y"]), ("f()", []), ("f(a, (b", []), ('f(a = ")", c)', ["a", "c"])]
    df = spark.createDataFrame([(t,) for t, _ in texts], "t string")
    got = {r.t: r.p for r in df.select("t", X.params_of(F.col("t"), F.lit(False)).alias("p")).collect()}
    assert got == dict(texts)


def test_statements_of_any_length(spark):
    names = [f"p{i}" for i in range(300)]
    each = ",\n".join(f"  {n}" for n in names)
    typed = ",\n".join(f"  {n}: Int" for n in names)
    files = {
        "f.ts": f"import {{\n{each}\n}} from './barrel'\nexport {{\n{each}\n}} from './out'\nexport function f(\n{each}\n) {{\n  g(1);\n}}\nclass C {{\n  m(\n{each}\n  ) {{\n    h(1);\n  }}\n}}\n",
        "f.py": f"def f(\n{each},\n):\n    return g(1)\n", "F.kt": f"fun f(\n{typed}\n) {{\n  g(1)\n}}\n",
        "f.ps1": "function F {\n  param(\n" + ",\n".join(f"    ${n}" for n in names) + "\n  )\n}\n",
        "t.sql": f"CREATE TABLE t (\n{each.replace(',', ' INT,')} INT\n)\nCREATE TABLE u\n(\n{each.replace(',', ' INT,')} INT\n)\nINSERT INTO x\n",
    }
    df = with_language(spark.createDataFrame([(1, p, c) for p, c in files.items()], "repo_id long, path string, content string"))
    found = {k: [r.asDict() for r in v.collect()] for k, v in X.extract(df).items() if k in ("functions", "imports", "exports", "definitions", "calls")}
    want = tuple(names)
    assert of(found, "functions", "f.ts", "name", "params", "line_start", "line_end") == [("f", want, 605, 908), ("C.m", want, 910, 1213)]
    assert [(s, len(n)) for s, n in of(found, "imports", "f.ts", "source", "specifiers")] == [("./barrel", 300), ("./out", 300)]
    assert len(of(found, "exports", "f.ts", "name")) == 301
    assert ("f", "g") in of(found, "calls", "f.ts", "caller", "callee") and ("C.m", "h") in of(found, "calls", "f.ts", "caller", "callee")
    assert of(found, "functions", "f.py", "name", "params") == [("f", want)]
    assert of(found, "functions", "F.kt", "name", "params", "line_end") == [("f", want, 304)]
    assert of(found, "functions", "f.ps1", "name", "params") == [("F", want)]
    assert of(found, "definitions", "t.sql", "name", "fields", "line_end") == [("t", want, 302), ("u", want, 605)]


def test_tasks_go_by_bytes_of_text(spark, monkeypatch):
    """Files that shrink to almost nothing in a shuffle still have to be dealt over tasks."""
    files = spark.createDataFrame([(1, f"src/a{i}.py", "python", "def f(x):\n" + "    run(x)\n" * 50) for i in range(40)], "repo_id long, path string, language string, content string")
    want = sorted(map(str, X.marks(files).collect()))
    monkeypatch.setattr(X, "TASK_BYTES", 2000, raising=False)
    dealt = X.marks(files)
    assert dealt.rdd.getNumPartitions() == 12  # 22,440 bytes
    assert len(want) == 40 * 51 and sorted(map(str, dealt.collect())) == want
