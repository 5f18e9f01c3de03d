"""A maintained analysis equals a full one, and parses only what moved."""

import uuid

from lodemap.operators import extract as X
from lodemap.operators import resolve as R
from lodemap.plans import incremental as I

OLD = {
    "src/a.ts": "import { b } from './b';\nexport function a(x) {\n  return b(x);\n}\n", "src/b.ts": "export function b(y) {\n  return y;\n}\n",
    "src/c.ts": "import { d } from './d';\nexport class C {\n  run(z) {\n  }\n}\n", "lib/e.py": "def e(v):\n    return v\n", "README.md": "# Title\n[a](src/a.ts)\n",
    "gone.ts": "export const gone = () => {\n};\n", "img.png": "\x00bin", "tsconfig.json": "{}",
}
NEW = {k: v for k, v in OLD.items() if k != "gone.ts"} | {
    "src/b.ts": "export function b(y, w) {\n  return y;\n}\n", "src/d.ts": "export function d() {\n}\n", "lib/e.py": "def e(v):\n    return v\n# note\n", "docs/new.md": "# New\n",
}
ALL = [f"q{i}.ts" for i in range(60)]


def corpus(spark, files):
    rows = [(repo, p, t) for repo in (1, 2) for p, t in files.items()] + [(2, p, f"export function {p[:-3]}() {{\n}}\n") for p in ALL] + [(3, "empty.ts", ""), (3, "null.ts", None)]
    return spark.createDataFrame([(*r, "extra") for r in rows], "repo_id long, path string, content string, state string")


def test_update_equals_full_run(spark, rows, tmp_path, monkeypatch):
    folder = f"{tmp_path}/{uuid.uuid4().hex}"
    I.save_state(I.full_state(corpus(spark, OLD)), folder)
    lexed = []
    extract = X.extract
    monkeypatch.setattr(X, "extract", lambda files: lexed.extend(files.select("repo_id", "path").collect()) or extract(files))
    new = corpus(spark, NEW)
    state = I.update_state(I.load_state(spark, folder), new)
    assert {(r.repo_id, r.path) for r in lexed} == {(repo, p) for repo in (1, 2) for p in ("src/b.ts", "src/d.ts", "lib/e.py", "docs/new.md")} | {(3, "null.ts")}
    whole = I.full_state(new)
    for name in ("fingerprints", "functions"):
        assert rows(state[name], *whole[name].columns) == rows(whole[name], *whole[name].columns), name
    # An import of an unchanged file meets the file that is new.
    config = spark.createDataFrame([], "repo_id long, path string, content string")
    met = [(r.path, r.target) for r in R.resolve_all(state["imports"], state["files"], config).filter("repo_id = 1").collect()]
    assert ("src/c.ts", "src/d.ts") in met
    diff = dict(((r, p), s) for r, p, s in rows(state["diff"], "repo_id", "path", "state"))
    assert [diff[1, p] for p in ("src/a.ts", "src/b.ts", "lib/e.py", "src/d.ts", "gone.ts")] == ["unchanged", "structural", "cosmetic", "added", "deleted"]
    assert dict(rows(state["kinds"], "repo_id", "update_kind"))[2] == "architecture"
