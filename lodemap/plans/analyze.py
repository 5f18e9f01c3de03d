"""From source files to a finished graph, all repositories at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodemap.operators import build as B
from lodemap.operators import extract as X
from lodemap.operators import resolve as R
from lodemap.operators import wiki as W
from lodemap.operators.paths import apply_ignore, language_of
from lodemap.plans.cut import cut
from lodemap.sources import corpus as C

K = "repo_id"
NODE = ["repo_id", "id", "type", "name", "file_path", "summary", "tags", "complexity", "node_ord"]
EDGE = ["repo_id", "source", "target", "type", "direction", "description", "weight", "edge_ord"]


def _code_graph(src: DataFrame, files: DataFrame) -> dict[str, DataFrame]:
    return graph_of(X.extract(src.select(K, "path", "language", "content")), files, C.config_files(src))


def graph_of(decls: dict[str, DataFrame], files: DataFrame, config: DataFrame) -> dict[str, DataFrame]:
    """The graph of code from declarations, the file table and the configuration files; needs no other source text."""
    resolved = cut(R.resolve_all(decls["imports"], files, config))
    imports = R.file_imports(resolved)
    file_nodes = cut(B.file_nodes(files, decls))
    nodes = file_nodes.unionByName(B.symbol_nodes(decls))
    calls = B.call_edges(decls["calls"], B.definition_index(decls), imports)
    edges = reduce(DataFrame.unionByName, [B.structure_edges(file_nodes, decls), B.reference_edges(imports, file_nodes), calls])
    nodes, edges = B.dedupe(nodes, edges)
    nodes, edges, pairs = B.link_tests(cut(nodes), cut(edges))
    return {"nodes": nodes, "edges": edges, "imports": imports, "pairs": pairs, "decls": decls,
            "unresolved": R.unresolved(decls["imports"], resolved)}


def _wiki_graph(src: DataFrame, wikis: DataFrame) -> dict[str, DataFrame]:
    arts = cut(W.articles(src))
    links = W.resolve_links(arts)
    index = src.join(wikis.select(K, F.col("index_path").alias("path")), [K, "path"], "left_semi")
    topics = W.topics(index, arts)
    cited = W.citations(src.join(arts.select(K, F.col("file_path").alias("path")), [K, "path"], "left_semi"),
                        src.filter(F.col("path").rlike("^(raw|sources)/")))

    def node(df: DataFrame, kind: int) -> DataFrame:
        path = F.col("file_path") if "file_path" in df.columns else F.lit(None).cast("string")
        sort = path if "file_path" in df.columns else F.col("name")
        return df.withColumn("file_path", path).withColumn("node_ord", F.struct(
            F.lit("").alias("path"), F.lit(kind).alias("kind"), F.lit(0).alias("seq"))).withColumn(
            "node_ord", F.struct(sort.alias("path"), F.lit(kind).alias("kind"), F.lit(0).alias("seq"))).select(*NODE)

    nodes = reduce(DataFrame.unionByName, [node(arts, 0), node(topics["nodes"], 1), node(W.source_nodes(src), 2)])
    raw = reduce(DataFrame.unionByName, [links["edges"], topics["edges"], cited])
    edges = B.make_edges(raw, "source", "target", F.col("type"), F.struct(
        F.lit(0).alias("stage"), F.col("source").alias("path"), F.lit(0).alias("kind"), F.lit(0).alias("seq"), F.lit(0).alias("part"),
        F.concat_ws("\u0001", "type", "target").alias("text")))
    return {"nodes": nodes, "edges": edges, "category": topics["category"], "issues": links["issues"]}


def analyze(source_files: DataFrame, rules: DataFrame | None = None, excludes: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of the graph of every repository in ``source_files(repo_id, path, content)``.

    Ignored files are dropped first. Repositories that are wikis are read as such, the others as code. Intermediate
    tables that several branches read are written to the checkpoint folder.
    """
    text = C.with_text(source_files)
    verdict = apply_ignore(text, rules, excludes)
    kept = verdict.filter(~F.col("ignored")).drop("ignored", "ignored_by_default")
    filtered = verdict.groupBy(K).agg(F.count_if(F.col("ignored") & ~F.col("ignored_by_default")).alias("filtered_by_ignore"))
    files = cut(C.probe_files(kept))
    src = kept.withColumn("language", language_of("path"))
    wikis = cut(W.detect_wikis(kept.select(K, "path", "content")))
    is_wiki = wikis.select(K)
    code = _code_graph(src.join(is_wiki, K, "left_anti"), files.join(is_wiki, K, "left_anti"))
    wiki = _wiki_graph(src.join(is_wiki, K, "left_semi"), wikis)
    nodes, edges = cut(code["nodes"]), cut(code["edges"])
    manifests = cut(C.manifests(kept))
    frameworks = B.frameworks(manifests)
    entry = cut(B.entry_points(files, frameworks))
    layers, members = B.layers(nodes)
    layers, members = cut(layers), cut(members)
    tour = B.tour(nodes, edges, layers, members, entry)
    wiki_layers, wiki_members = W.wiki_layers(wiki["nodes"], wiki["category"])
    folders = files.select(K).distinct().withColumn("folder", F.col(K).cast("string"))
    ranked = B.primary_languages(files)
    languages = ranked.groupBy(K).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "language"))), lambda s: s["language"]).alias("languages"))
    fw = frameworks.groupBy(K).agg(F.transform(F.array_sort(F.collect_list(F.struct("framework_ord", "framework"))), lambda s: s["framework"]).alias("frameworks"))
    projects = (
        C.project_identity(folders, manifests).join(B.project_size(files), K, "left").join(languages, K, "left").join(fw, K, "left")
        .join(filtered, K, "left").join(C.content_digest(files), K, "left").join(entry.select(K, F.col("path").alias("entry_point")), K, "left")
    )
    lay = ["repo_id", "layer_id", "name", "description", "n_members", "layer_ord"]
    issue = ["repo_id", "level", "category", "message", "path"]
    return {
        "projects": projects, "files": files,
        "nodes": nodes.unionByName(wiki["nodes"], allowMissingColumns=True), "edges": edges.select(*EDGE).unionByName(wiki["edges"].select(*EDGE)),
        "layers": layers.select(*lay).unionByName(wiki_layers.select(*lay)),
        "layer_members": members.select(K, "layer_id", "node_id", "member_ord").unionByName(
            wiki_members.select(K, "layer_id", "node_id"), allowMissingColumns=True),
        "tour_steps": tour, "imports": code["imports"], "test_pairs": code["pairs"],
        "issues": code["unresolved"].select(*issue).unionByName(wiki["issues"].select(*issue)),
    } | {f"decl_{k}": v for k, v in code["decls"].items()}
