"""What changed between two snapshots, whether it matters, and how stale a graph is against its history."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.functions.text import top_directory
from lodemap.plans.bounded import TASK_ROWS, TASK_STEPS, split_groups
from lodemap.plans.cut import cut, first_rows

K = "repo_id"
FUNCTION = "array<struct<name:string,params:array<string>,return_type:string,exported:boolean,line_count:int>>"
CLASS = "array<struct<name:string,methods:array<string>,properties:array<string>,exported:boolean,line_count:int>>"


def _line_count() -> Column:
    return F.greatest(F.lit(0), F.col("line_end") - F.col("line_start") + 1)


def fingerprints(files: DataFrame, decls: dict[str, DataFrame], has_structure: Column | None = None) -> DataFrame:
    """One row per file: content hash and the sorted shape of its declarations.

    ``files(repo_id, path, content_hash)``. Lists are per file. Declarations of all
    kinds are stacked and grouped once, so there is one shuffle instead of one per kind.
    """
    exports = decls["exports"].select(K, "path", "name").distinct()
    none = F.array().cast("array<string>")

    def exported(df: DataFrame) -> DataFrame:
        return df.join(exports.withColumn("exported", F.lit(True)), [K, "path", "name"], "left").withColumn(
            "exported", F.coalesce("exported", F.lit(False)))

    fn = F.struct("name", F.coalesce("params", none).alias("params"), "return_type", "exported", _line_count().cast("int").alias("line_count"))
    cl = F.struct("name", F.sort_array("methods").alias("methods"), F.sort_array("properties").alias("properties"), "exported",
                  _line_count().cast("int").alias("line_count"))
    spec = F.concat_ws(":", "source", F.array_join(F.sort_array(F.coalesce("specifiers", none)), ","))

    def rows(df: DataFrame, f: Column | None = None, c: Column | None = None, i: Column | None = None, e: Column | None = None) -> DataFrame:
        def placed(value: Column | None, kind: str) -> Column:
            if value is None:
                return F.lit(None).cast(f"struct<seq:int,v:{kind[6:-1]}>")
            return F.struct(F.col("decl_seq").cast("int").alias("seq"), value.alias("v"))

        null = F.lit(None).cast("string")
        return df.select(
            K, "path", placed(f, FUNCTION).alias("_f"), placed(c, CLASS).alias("_c"), (i if i is not None else null).alias("_i"),
            (e if e is not None else null).alias("_e"))

    stacked = reduce(DataFrame.unionByName, [
        rows(exported(decls["functions"]), f=fn), rows(exported(decls["classes"]), c=cl),
        rows(decls["imports"], i=spec), rows(decls["exports"], e=F.col("name"))])
    shape = stacked.groupBy(K, "path").agg(
        F.transform(F.array_sort(F.collect_list("_f")), lambda s: s["v"]).alias("functions"),
        F.transform(F.array_sort(F.collect_list("_c")), lambda s: s["v"]).alias("classes"),
        F.sort_array(F.collect_list("_i")).alias("imports"), F.sort_array(F.collect_list("_e")).alias("exports"))
    structured = has_structure if has_structure is not None else F.lit(True)
    return files.select(K, "path", "content_hash", structured.alias("has_structure")).join(shape, [K, "path"], "left").select(
        K, "path", "content_hash", F.coalesce("functions", F.array().cast(FUNCTION)).alias("functions"),
        F.coalesce("classes", F.array().cast(CLASS)).alias("classes"), F.coalesce("imports", none).alias("imports"),
        F.coalesce("exports", none).alias("exports"), "has_structure")


def _first_named(items: Column) -> Column:
    """First entry of each name, as a list sorted by name: two such lists are compared by position."""
    return F.array_sort(F.filter(items, lambda x, i: F.size(F.filter(
        F.slice(items, 1, F.greatest(i, F.lit(0))), lambda y: y["name"] == x["name"])) == 0))


def _same_functions(old: Column, new: Column) -> Column:
    def same(a: Column, b: Column) -> Column:
        ratio = b["line_count"] / a["line_count"]
        return (
            (a["name"] == b["name"]) & a["params"].eqNullSafe(b["params"]) & a["return_type"].eqNullSafe(b["return_type"])
            & (a["exported"] == b["exported"])
            & ((a["line_count"] <= 0) | ((ratio <= 1.5) & (ratio >= 0.5)))
        )
    pairs = F.arrays_zip(old.alias("a"), new.alias("b"))
    return (F.size(old) == F.size(new)) & F.forall(pairs, lambda p: F.coalesce(same(p["a"], p["b"]), F.lit(False)))


def _same_classes(old: Column, new: Column) -> Column:
    def same(a: Column, b: Column) -> Column:
        return ((a["name"] == b["name"]) & a["methods"].eqNullSafe(b["methods"]) & a["properties"].eqNullSafe(b["properties"])
                & (a["exported"] == b["exported"]))
    pairs = F.arrays_zip(old.alias("a"), new.alias("b"))
    return (F.size(old) == F.size(new)) & F.forall(pairs, lambda p: F.coalesce(same(p["a"], p["b"]), F.lit(False)))


def change_class(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files in both snapshots: none, cosmetic or structural. Equal hashes settle most of them without looking further."""
    o = old.select(K, "path", *[F.col(c).alias(f"_o_{c}") for c in ("content_hash", "functions", "classes", "imports", "exports", "has_structure")])
    both = new.join(o, [K, "path"])
    same = (
        F.col("has_structure") & F.col("_o_has_structure") & (F.col("imports") == F.col("_o_imports"))
        & (F.col("exports") == F.col("_o_exports"))
        & _same_functions(F.col("_of"), F.col("_nf")) & _same_classes(F.col("_oc"), F.col("_nc"))
    )
    equal = F.col("content_hash") == F.col("_o_content_hash")
    named = both.withColumn("_of", _first_named(F.col("_o_functions"))).withColumn("_nf", _first_named(F.col("functions"))).withColumn(
        "_oc", _first_named(F.col("_o_classes"))).withColumn("_nc", _first_named(F.col("classes")))
    return named.select(K, "path", F.when(equal, "none").when(same, "cosmetic").otherwise("structural").alias("change"))


def signature_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Same verdict from tall signature tables (repo_id, path, name, params, line_count) instead of per-file lists.

    Full outer join on (file, name), then one map-side-combined fold per file; no list is ever built.
    """
    o = old.select(K, "path", "name", F.struct("params", "line_count").alias("o"))
    n = new.select(K, "path", "name", F.struct("params", "line_count").alias("n"))
    ratio = F.col("n.line_count") / F.col("o.line_count")
    moved = (
        F.col("o").isNull() | F.col("n").isNull() | ~F.col("o.params").eqNullSafe(F.col("n.params"))
        | F.coalesce((F.col("o.line_count") > 0) & ((ratio > 1.5) | (ratio < 0.5)), F.lit(False))
    )
    other = F.coalesce(F.col("o.line_count") != F.col("n.line_count"), F.lit(False))
    joined = o.join(n, [K, "path", "name"], "full")
    return joined.groupBy(K, "path").agg(
        F.max(F.col("o").isNotNull()).alias("_old"), F.max(F.col("n").isNotNull()).alias("_new"),
        F.max(moved).alias("_moved"), F.max(other).alias("_other")
    ).select(K, "path", F.when(~F.col("_old"), "added").when(~F.col("_new"), "deleted").when(F.col("_moved"), "structural")
             .when(F.col("_other"), "cosmetic").otherwise("none").alias("change"))


def snapshot_diff(old: DataFrame, new: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """State of every file of two snapshots: unchanged, cosmetic, structural, added or deleted.

    Inputs hold (repo_id, path, content_hash). Pass ``classes`` from :func:`change_class`, run on the files that this
    diff calls ``changed`` only, to tell cosmetic from structural; without it they count as structural.
    """
    o = old.select(K, "path", F.col("content_hash").alias("_o"))
    n = new.select(K, "path", F.col("content_hash").alias("_n"))
    state = (
        F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "deleted")
        .when(F.col("_o") == F.col("_n"), "unchanged").otherwise("structural")
    )
    diff = o.join(n, [K, "path"], "full").select(K, "path", state.alias("state"))
    if classes is None:
        return diff
    refined = F.when((F.col("state") == "structural") & (F.col("change") == "cosmetic"), "cosmetic").otherwise(F.col("state"))
    return diff.join(classes, [K, "path"], "left").select(K, "path", refined.alias("state"))


def changed_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files worth parsing again: new ones and those whose hash moved."""
    return new.join(old.select(K, "path", "content_hash"), [K, "path", "content_hash"], "left_anti")


def update_kind(diff: DataFrame, graph_sizes: DataFrame) -> DataFrame:
    """How much to redo per repository: skip, partial, architecture or full.

    ``graph_sizes(repo_id, total_files)``. A top folder that only added or deleted files have is a new one.
    """
    moved = F.col("state").isin("added", "deleted")
    folders = diff.select(K, top_directory("path").alias("_top"), moved.alias("_moved"),
                          F.col("state").isin("structural", "added", "deleted").alias("_counts"))
    per_top = folders.groupBy(K, "_top").agg(
        F.count_if("_counts").alias("_n"), (F.count_if("_moved") == F.count("*")).alias("_only_moved"))
    per_repo = per_top.groupBy(K).agg(
        F.sum("_n").alias("changed"), F.coalesce(F.max(F.col("_only_moved") & F.col("_top").isNotNull()), F.lit(False)).alias("new_top"))
    n, total = F.col("changed"), F.coalesce("total_files", F.lit(0))
    kind = (
        F.when(n == 0, "skip").when(n > 30, "full").when((total > 0) & (n / total > 0.5), "full").when(n > 10, "architecture")
        .when(F.col("new_top"), "architecture").otherwise("partial")
    )
    return per_repo.join(graph_sizes.select(K, "total_files"), K, "left").select(K, "changed", "new_top", kind.alias("update_kind"))


# --- history ------------------------------------------------------------------------------

def ancestors(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """Every commit reachable from each start, itself included: (repo_id, label, commit_id).

    ``commits(repo_id, commit_id, parent_id[, parent_no])`` has one row per parent. Histories of bounded size are walked in
    one task each, larger ones over the whole cluster.
    """
    starts = cut(starts.select(K, "label", "commit_id").distinct())
    arcs = commits.filter("parent_id is not null").join(starts.select(K).distinct(), K, "left_semi")
    n_arcs = F.coalesce("arcs", F.lit(0))
    sizes = starts.groupBy(K).agg(F.count("*").alias("n"), F.countDistinct("label").alias("labels")).join(arcs.groupBy(K).agg(F.count("*").alias("arcs")), K, "left")
    here, others, any_others = split_groups(sizes, K, (F.col("n") + n_arcs <= TASK_ROWS) & (F.col("labels") * n_arcs <= TASK_STEPS), F.col("n") + n_arcs)
    found = _ancestors_in_tasks(arcs.join(here, K), starts.join(here, K))
    if any_others:
        found = found.unionByName(_ancestors_by_jumps(arcs.join(others, K, "left_semi"), starts.join(others, K, "left_semi")))
    return found


def _ancestors_in_tasks(arcs: DataFrame, starts: DataFrame) -> DataFrame:
    kinds = {c: starts.schema[c].dataType.simpleString() for c in (K, "label", "commit_id")}

    def run(group: pa.Table) -> pa.Table:
        parents: dict = {}
        reached: dict = {}
        for repo, commit, parent, label in zip(*(group[c].to_pylist() for c in (K, "commit_id", "parent_id", "label")), strict=True):
            if parent is not None:
                parents.setdefault((repo, commit), []).append(parent)
            else:
                reached.setdefault((repo, label), set()).add(commit)
        for (repo, _), seen in reached.items():
            todo = list(seen)
            while todo:
                for parent in parents.get((repo, todo.pop()), ()):
                    if parent not in seen:
                        seen.add(parent)
                        todo.append(parent)
        rows = [(repo, label, commit) for (repo, label), seen in reached.items() for commit in seen]
        columns = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.table({c: pa.array(v, group.schema.field(c).type) for c, v in zip((K, "label", "commit_id"), columns, strict=True)})

    none = F.lit(None)
    rows = arcs.select("_pack", K, "commit_id", "parent_id", none.cast(kinds["label"]).alias("label")).unionByName(
        starts.select("_pack", K, "commit_id", none.cast(arcs.schema["parent_id"].dataType).alias("parent_id"), "label"))
    return rows.groupBy("_pack").applyInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()))


def _ancestors_by_jumps(commits: DataFrame, starts: DataFrame) -> DataFrame:
    """Walking one generation per round would need as many rounds as history is deep. Parents of one number form a forest, so
    each number is walked by doubling: tables of jumps of length 1, 2, 4, ... (each no larger than the commit table) cover a
    line of n commits in log n steps. A sweep walks every number in turn from what the last sweep found, until nothing is new.
    """
    no = F.col("parent_no") if "parent_no" in commits.columns else F.lit(0)
    arcs = cut(commits.filter("parent_id is not null").select(K, "commit_id", F.col("parent_id").alias("to"), no.alias("parent_no")))
    numbers = [r["parent_no"] for r in arcs.select("parent_no").distinct().orderBy("parent_no").collect()]  # a merge has few parents
    jumps = []
    for number in numbers:
        jump = arcs.filter(F.col("parent_no") == number).select(K, "commit_id", "to").distinct()
        while True:
            jumps.append(jump)
            jump = cut(jump.join(jump.select(K, F.col("commit_id").alias("to"), F.col("to").alias("_next")), [K, "to"])
                       .select(K, "commit_id", F.col("_next").alias("to")))
            if jump.isEmpty():
                break
    reached = fresh = cut(starts.select(K, "label", "commit_id").distinct())
    while True:
        line = fresh
        for jump in jumps:
            line = line.unionByName(line.join(jump, [K, "commit_id"]).select(K, "label", F.col("to").alias("commit_id"))).distinct()
        fresh = cut(line.join(reached, [K, "label", "commit_id"], "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = cut(reached.unionByName(fresh))
        if len(numbers) < 2:
            return reached


def folder_trees(files: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Hash trees of ``files`` (repo_id, path, content_hash and the columns ``by`` that name a snapshot).

    Returns ``entries(repo_id, tree, name, is_tree, child)``, one row per distinct folder and name in it, and
    ``roots(repo_id, *by, tree)``. A folder's hash is a sum over its entries, made on the map side, so folders of any size
    are fine and equal folders of all snapshots are stored once. One round per level of folders, deepest first.
    """
    group = [K, *by]
    parts = F.split("path", "/")
    level = cut(files.select(*group, F.slice(parts, 1, F.size(parts) - 1).alias("_at"), F.element_at(parts, -1).alias("name"),
                             F.lit(False).alias("is_tree"), F.coalesce("content_hash", F.lit("")).alias("child")).withColumn("_depth", F.size("_at")))
    deepest = level.agg(F.max("_depth")).first()[0]
    entries, roots = [], level.select(*group, F.lit("").alias("tree")).limit(0)
    word = lambda seed: F.sum(F.xxhash64(F.lit(seed), "name", "is_tree", "child").cast("decimal(38,0)"))
    for depth in range(deepest if deepest is not None else -1, -1, -1):
        here = level.filter(F.col("_depth") == depth)
        trees = here.groupBy(*group, "_at").agg(word(1).alias("_1"), word(2).alias("_2"), F.count("*").alias("_n"))
        trees = cut(trees.select(*group, "_at", F.sha2(F.concat_ws(":", "_1", "_2", "_n"), 256).alias("tree")))
        entries.append(here.join(trees, [*group, "_at"]).select(K, "tree", "name", "is_tree", "child").distinct())
        if depth == 0:
            roots = trees.select(*group, "tree")
        else:
            up = trees.select(*group, F.slice("_at", 1, depth - 1).alias("_at"), F.element_at("_at", -1).alias("name"), F.lit(True).alias("is_tree"),
                              F.col("tree").alias("child"), F.lit(depth - 1).alias("_depth"))
            level = cut(level.filter(F.col("_depth") < depth).unionByName(up))
    if not entries:
        return level.select(K, F.lit("").alias("tree"), "name", "is_tree", "child").limit(0), roots
    return cut(reduce(DataFrame.unionByName, entries).distinct()), roots


def tree_changes(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """Files in which the trees of ``pairs(repo_id, old, new)`` differ: (repo_id, path, state), state added, deleted or changed.

    Folders with one hash are never opened: each round compares the entries of those folders that differ one level up. A
    missing tree (null) has no files. A name that is a folder on one side and a file on the other is deleted and added.
    """
    todo = cut(pairs.filter(~F.col("old").eqNullSafe(F.col("new"))).select(K, F.lit("").alias("_at"), "old", "new"))
    found = todo.select(K, F.lit("").alias("path"), F.lit("").alias("state")).limit(0)
    both = [K, "_at", "name", "is_tree"]
    while not todo.isEmpty():
        side = lambda c: todo.select(K, "_at", F.col(c).alias("tree")).join(entries, [K, "tree"]).select(*both, F.col("child").alias(c))  # noqa: B023, E731
        met = cut(side("old").join(side("new"), both, "full").filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("_path", F.concat("_at", "name")))
        state = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").otherwise("changed")
        found = found.unionByName(met.filter("NOT is_tree").select(K, F.col("_path").alias("path"), state.alias("state")))
        todo = met.filter("is_tree").select(K, F.concat("_path", F.lit("/")).alias("_at"), "old", "new")
    return found


# --- fixed values: severities of freshness states --------------------------------------------
SEVERITY = {"fresh": 0, "unknown": 1, "dirty": 2, "stale": 3}


def freshness(builds: DataFrame, heads: DataFrame, commits: DataFrame, commit_files: DataFrame, working: DataFrame,
              own_dirs: list[str] | None = None, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """State of each built graph against its repository.

    ``trees`` are the hash trees of the commits (:func:`folder_trees` by ``commit_id``): with them changed files are those in
    which the two commits' trees differ, so a change and its revert leave a graph fresh.

    ``builds(repo_id, commit)`` and ``heads(repo_id, commit)`` name the graph's and the current commit; ``working``
    holds uncommitted paths. Missing rows give the unknown reasons. Only commits that touch files outside the
    analyzer's own folder count; changed files are those of the commits that just one side has.
    """
    own = "|".join(d.replace(".", r"\.") for d in (own_dirs or dims.OUTPUT_DIRECTORIES))
    outside = ~F.col("path").rlike(f"^({own})(/|$)")
    ids = commits.select(K, "commit_id").distinct()
    b = builds.select(K, F.nullif("commit", F.lit("") if dict(builds.dtypes)["commit"] == "string" else F.lit(None)).alias("graph_commit"))
    h = heads.select(K, F.col("commit").alias("head"))
    known = commits.select(K).distinct().withColumn("_repo", F.lit(True))
    state = (
        b.join(known, K, "left").join(h, K, "left")
        .join(ids.select(K, F.col("commit_id").alias("graph_commit"), F.lit(True).alias("_there")), [K, "graph_commit"], "left")
        .withColumn("reason", F.when(F.col("graph_commit").isNull(), "missing-graph-commit").when(F.col("_repo").isNull(), "not-a-git-repository")
                    .when(F.col("head").isNull(), "git-head-unavailable").when(F.col("_there").isNull(), "graph-commit-unavailable"))
    )
    moved = state.filter("reason is null and graph_commit <> head")
    starts = moved.select(K, F.explode(F.array(
        F.struct(F.lit("graph").alias("label"), F.col("graph_commit").alias("commit_id")),
        F.struct(F.lit("head").alias("label"), F.col("head").alias("commit_id")))).alias("s")).select(K, "s.label", "s.commit_id")
    # Counts, tips and files read the walked commits; they are walked once.
    sides = cut(ancestors(commits.join(moved.select(K).distinct(), K, "left_semi"), starts).groupBy(K, "commit_id").agg(
        F.max(F.col("label") == "graph").alias("in_graph"), F.max(F.col("label") == "head").alias("in_head")))
    one_side = sides.filter("in_graph <> in_head")
    touched = commit_files.filter(outside).select(K, F.col("commit_id"), "path")
    differing = one_side.join(touched, [K, "commit_id"])
    counts = one_side.join(touched.select(K, "commit_id").distinct(), [K, "commit_id"], "left_semi").groupBy(K).agg(
        F.count_if("in_head").alias("behind"), F.count_if("in_graph").alias("ahead"))
    tips = moved.join(sides.select(K, F.col("commit_id").alias("graph_commit"), F.col("in_head").alias("_graph_below")), [K, "graph_commit"], "left").join(
        sides.select(K, F.col("commit_id").alias("head"), F.col("in_graph").alias("_head_below")), [K, "head"], "left").select(
        K, "_graph_below", "_head_below")
    committed = differing.select(K, "path").distinct()
    if trees is not None:
        entries, roots = trees
        root = lambda c: roots.select(K, F.col("commit_id").alias(c), F.col("tree").alias("old" if c == "graph_commit" else "new"))
        pairs = moved.select(K, "graph_commit", "head").join(root("graph_commit"), [K, "graph_commit"], "left").join(root("head"), [K, "head"], "left")
        committed = tree_changes(entries, pairs).filter(outside).select(K, "path")
    dirty = working.filter(outside).select(K, "path").distinct()
    n_committed = committed.groupBy(K).agg(F.count("*").alias("_nc"))
    n_dirty = dirty.groupBy(K).agg(F.count("*").alias("_nd"))
    n_all = committed.unionByName(dirty).distinct().groupBy(K).agg(F.count("*").alias("_na"))
    out = state.join(n_committed, K, "left").join(n_dirty, K, "left").join(n_all, K, "left").join(counts, K, "left").join(tips, K, "left")
    status = (
        F.when(F.col("reason").isNotNull(), "unknown").when(F.col("_nc") > 0, "stale").when(F.col("_nd") > 0, "dirty").otherwise("fresh")
    )
    stale = F.col("status") == "stale"
    severity = F.create_map(*[F.lit(x) for kv in SEVERITY.items() for x in kv])
    return out.withColumn("status", status).select(
        K, "status", "reason",
        F.when(stale, F.when(F.coalesce("_graph_below", F.lit(False)), "behind").when(F.coalesce("_head_below", F.lit(False)), "ahead").otherwise("diverged")).alias("relation"),
        F.when(stale, F.coalesce("behind", F.lit(0))).alias("behind"), F.when(stale, F.coalesce("ahead", F.lit(0))).alias("ahead"),
        F.when(stale, F.col("_na")).when(F.col("status") == "dirty", F.col("_nd")).otherwise(0).alias("n_changed_files"),
        F.try_element_at(severity, "status").alias("severity"), (F.try_element_at(severity, "status") >= 2).alias("actionable"))


# --- descriptions that survive a rebuild --------------------------------------------------------

def carry_prose(new_nodes: DataFrame, old_nodes: DataFrame, journal: DataFrame) -> DataFrame:
    """Descriptions for rebuilt nodes: the journal's for the same fingerprint, else the old graph's for the same id.

    ``new_nodes`` carry ``fingerprint``; ``journal(repo_id, node_id, fingerprint, summary, tags)``. New tags are
    appended to a node's own, eight at most.
    """
    told = (F.col("summary") != "") & (F.col("summary") != dims.PENDING_SUMMARY)
    old = first_rows(old_nodes.filter(told), [K, "id"], ["summary"]).select(K, "id", F.col("summary").alias("_os"), F.col("tags").alias("_ot"))
    kept = journal.select(K, F.col("node_id").alias("id"), "fingerprint", F.col("summary").alias("_js"), F.col("tags").alias("_jt"))
    none = F.array().cast("array<string>")
    tags = F.slice(F.array_union(F.array_union("tags", F.coalesce("_ot", none)), F.coalesce("_jt", none)), 1, 8)
    return (
        new_nodes.join(old, [K, "id"], "left").join(kept, [K, "id", "fingerprint"], "left")
        .withColumn("tags", F.when(F.col("_os").isNotNull() | F.col("_js").isNotNull(), tags).otherwise(F.col("tags")))
        .withColumn("summary", F.coalesce("_js", "_os", "summary")).drop("_os", "_ot", "_js", "_jt")
    )
