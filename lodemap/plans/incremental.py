"""A maintained analysis: only files whose content moved are parsed again; everything else comes from the stored tables.

A state holds one row per file with its hash, one fingerprint per file, and the declarations of every file. An update
compares hashes, parses new and changed files, and replaces their rows by (repo_id, path). The graph is made from
declarations, without source text, since an unchanged import may mean another file once files come and go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.operators import changes as H
from lodemap.operators import extract as X
from lodemap.plans.analyze import graph_of
from lodemap.plans.cut import cut
from lodemap.sources import corpus as C

K = "repo_id"
KEY = [K, "path"]
DECLARATIONS = ["functions", "classes", "imports", "exports", "calls", *X.SCHEMAS]


def _parsed(source_files: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    src = source_files.join(files.select(*KEY, "language"), KEY)
    decls = X.extract(src.select(K, "path", "language", "content"))
    return {**decls, "fingerprints": cut(H.fingerprints(files.select(*KEY, "content_hash", "language"), decls, X.has_structure(F.col("language"))))}


def full_state(source_files: DataFrame) -> dict[str, DataFrame]:
    """The state of ``source_files(repo_id, path, content)``: ``files``, ``fingerprints`` and all declaration tables.

    Files are taken as they are, so ignored ones have to be dropped before. Content that is null has no hash and counts as
    changed whenever it is met again. No files give empty tables.
    """
    text = C.with_text(source_files)
    files = cut(C.probe_files(text))
    return {"files": files, **_parsed(text, files)}


def update_state(old: dict[str, DataFrame], source_files: DataFrame) -> dict[str, DataFrame]:
    """The state of ``source_files`` made from the state of an earlier snapshot, with two more tables.

    ``diff(repo_id, path, state)`` tells unchanged, cosmetic, structural, added and deleted files, ``kinds`` how much each
    repository has to redo. Text of unchanged files is hashed and not looked at further.
    """
    text = C.with_text(source_files)
    files = cut(C.probe_files(text))
    moved = cut(H.snapshot_diff(old["files"], files).filter("state <> 'unchanged'"))
    fresh = cut(files.join(moved.filter("state <> 'deleted'").select(*KEY), KEY, "left_semi"))
    parsed = _parsed(text.join(fresh.select(*KEY), KEY, "left_semi"), fresh)
    state = {"files": files}
    for name in ("fingerprints", *DECLARATIONS):
        kept = old[name].join(moved.select(*KEY), KEY, "left_anti")
        state[name] = kept.unionByName(parsed[name].select(*kept.columns))
    changed = moved.filter("state = 'structural'").select(*KEY)
    classes = H.change_class(old["fingerprints"].join(changed, KEY, "left_semi"), parsed["fingerprints"])
    diff = cut(H.snapshot_diff(old["files"], files, classes))
    sizes = old["files"].groupBy(K).agg(F.count("*").alias("total_files"))
    return {**state, "diff": diff, "kinds": H.update_kind(diff, sizes), "parsed": fresh.select(*KEY)}


def state_graph(state: dict[str, DataFrame], source_files: DataFrame) -> dict[str, DataFrame]:
    """Nodes, edges, imports and the rest of the code graph of a state; of ``source_files`` only configuration is read."""
    return graph_of({name: state[name] for name in DECLARATIONS}, state["files"], C.config_files(C.with_text(source_files)))


def save_state(state: dict[str, DataFrame], folder: str) -> None:
    """A state below ``folder``, which must not hold one yet: an update reads the old state while it writes the new one."""
    for name in ("files", "fingerprints", *DECLARATIONS):
        state[name].write.parquet(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in ("files", "fingerprints", *DECLARATIONS)}
