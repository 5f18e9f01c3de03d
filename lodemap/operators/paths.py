"""Path filters and classification: ignore rules, languages, categories, test names, access checks.

Everything is an expression on the path column; only rules that differ per repository need a join.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.functions.text import (
    basename, col, dotfile_key, file_extension, is_safe_relative, lookup, normalize,
)

K = "repo_id"


# --- ignore rules ----------------------------------------------------------

# Pieces of a glob, longest first: ``**/``, ``**``, ``*``, ``?``, a character class, an escape, any character.
_GLOB_PIECE = r"\*\*/|\*\*|\*|\?|\[[!^]?\]?[^\]]*\]|\\[\s\S]|[\s\S]"


def _piece_regex(p: Column) -> Column:
    quoted = F.regexp_replace(p, r"(?U)([^\w/])", r"\\$1")
    inner = F.regexp_replace(F.substring(p, 2, 1_000_000), r"\[", r"\\[")
    char_class = F.concat(F.lit("["), F.regexp_replace(inner, "^!", "^"))
    return (
        F.when(p == "**/", "(?:.*/)?").when(p == "**", ".*").when(p == "*", "[^/]*").when(p == "?", "[^/]")
        .when(p.startswith("[") & (F.length(p) > 1), char_class)
        .when(p.startswith("\\") & (F.length(p) > 1), F.regexp_replace(F.substring(p, 2, 1), r"(?U)([^\w/])", r"\\$1"))
        .otherwise(quoted)
    )


def rule_regex(pattern: Column | str) -> Column:
    """struct(negated, regex) of one ignore line; null for blanks and comments. Case is ignored when matching."""
    raw = F.regexp_replace(col(pattern), r"(\\[ \t])?[ \t]*$", "$1")
    unhashed = F.when(raw.startswith("\\#"), F.substring(raw, 2, 1_000_000)).otherwise(raw)
    negated = unhashed.startswith("!")
    body = F.when(negated, F.substring(unhashed, 2, 1_000_000)).otherwise(unhashed)
    only_dir = body.endswith("/")
    cut = F.regexp_replace(body, r"/$", "")
    anchored = cut.contains("/")
    glob = F.regexp_replace(cut, "^/", "")
    pieces = F.transform(F.regexp_extract_all(glob, F.lit(_GLOB_PIECE), 0), _piece_regex)
    regex = F.concat(
        F.when(anchored, "").otherwise("(?:.*/)?"), F.array_join(pieces, ""),
        F.when(only_dir, "/.*").otherwise("(?:/.*)?"),
    )
    usable = (raw != "") & ~raw.startswith("#") & (glob != "")
    return F.when(usable, F.struct(negated.alias("negated"), regex.alias("regex")))


def _whole(regex: Column) -> Column:
    return F.concat(F.lit("(?iu)^(?:"), regex, F.lit(")$"))


def literal_verdict(path: Column, patterns: list[str]) -> Column:
    """True/false by the last of the given rules that matches, null when none does.

    The patterns are literals, so Catalyst folds each regular expression at planning time.
    """
    verdict = F.lit(None).cast("boolean")
    for pattern in patterns:
        rule = rule_regex(F.lit(pattern))
        hit = F.coalesce(F.rlike(path, _whole(rule["regex"])), F.lit(False))
        verdict = F.when(hit, ~rule["negated"]).otherwise(verdict)
    return verdict


@functools.cache
def _default_regex() -> str:
    """The built-in rules have no negation and no anchor, so they are one alternation."""
    def glob(p: str) -> str:
        name = p.rstrip("/")
        body = "".join("[^/]*" if c == "*" else ("\\" + c if c in ".+()" else c) for c in name)
        return body + ("/.*" if p.endswith("/") else "(?:/.*)?")
    return "(?iu)^(?:.*/)?(?:" + "|".join(glob(p) for p in dims.DEFAULT_IGNORES) + ")$"


def ignored_by_default(path: Column) -> Column:
    return path.rlike(_default_regex())


def layered_rules(rule_files: DataFrame, excludes: DataFrame | None = None) -> DataFrame:
    """Rule lines in order of precedence: (repo_id, layer_no, line_no, pattern).

    ``rule_files`` holds (repo_id, layer_no, content): 1 the data folder's file, 2 the root file. ``excludes``
    (repo_id, line_no, pattern) come last. The built-in rules are layer 0 and always apply.
    """
    lines = rule_files.select(K, "layer_no", F.posexplode(F.split("content", "\n")).alias("line_no", "pattern"))
    if excludes is None:
        return lines
    return lines.unionByName(excludes.select(K, F.lit(3).alias("layer_no"), "line_no", "pattern"))


def _repo_programs(rules: DataFrame) -> DataFrame:
    """Rules of a repository as a short list of alternations: neighbours of equal sign become one regex."""
    one = rules.select(K, F.struct("layer_no", "line_no", rule_regex("pattern").alias("rule")).alias("r"))
    per_repo = (
        one.filter("r.rule is not null").groupBy(K).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    )
    kind = "array<struct<negated:boolean,regex:string>>"

    def merge(acc: Column, r: Column) -> Column:
        top = F.element_at(acc, -1)
        same = (F.size(acc) > 0) & (top["negated"] == r["rule"]["negated"])
        joined = F.struct(r["rule"]["negated"].alias("negated"),
                          F.concat_ws("|", top["regex"], r["rule"]["regex"]).alias("regex"))
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(joined))).otherwise(
            F.concat(acc, F.array(r["rule"])))

    runs = F.aggregate("rs", F.array().cast(kind), merge)
    ready = F.transform(runs, lambda r: F.struct(r["negated"].alias("negated"), _whole(r["regex"]).alias("regex")))
    return per_repo.select(K, F.reverse(ready).alias("_program"))


def apply_ignore(paths: DataFrame, rules: DataFrame | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Adds ``ignored`` and ``ignored_by_default``. The last rule that matches decides; ``!`` takes a path back.

    Per-repository rules join as one small row per repository; ``excludes`` are literals that override them.
    """
    p = normalize("path")
    default = ignored_by_default(p)
    layers = []
    if excludes:
        layers.append(literal_verdict(p, excludes))
    out = paths
    if rules is not None:
        out = out.join(_repo_programs(rules), K, "left")
        # regexp_instr keeps its last compiled pattern, so rows of one repository compile each rule run once.
        hit = F.filter("_program", lambda r: F.regexp_instr(p, r["regex"]) > 0)
        layers.append(F.when(F.size(hit) > 0, ~hit[0]["negated"]))
    verdict = F.coalesce(*layers, default) if layers else default
    return (
        out.withColumn("ignored", (p != "") & verdict).withColumn("ignored_by_default", (p != "") & default)
        .drop("_program")
    )


def user_filtered_counts(paths: DataFrame, rules: DataFrame | None = None,
                         excludes: list[str] | None = None) -> DataFrame:
    """Files removed by the user's rules alone, per repository."""
    v = apply_ignore(paths, rules, excludes)
    return v.groupBy(K).agg(F.count_if(F.col("ignored") & ~F.col("ignored_by_default")).alias("filtered_by_ignore"))


def ignore_effect(nodes: DataFrame, draft: list[str]) -> DataFrame:
    """How many of a graph's distinct paths a draft of rules would exclude."""
    paths = nodes.filter("file_path is not null").select(K, F.col("file_path").alias("path")).distinct()
    verdict = F.coalesce(literal_verdict(normalize("path"), draft), F.lit(False))
    return paths.groupBy(K).agg(F.count_if(verdict).alias("excluded"), F.count("*").alias("total"))


def suggest_rules(gitignores: DataFrame, projects: DataFrame) -> DataFrame:
    """Rules to offer: a repository's own git rules that are not built in, then test globs of its languages.

    ``gitignores`` (repo_id, content), ``projects`` (repo_id, languages array<string>) ->
    (repo_id, origin, suggestion_ord, pattern).
    """
    line = F.filter(
        F.transform(F.split("content", "\n"), lambda s: F.regexp_replace(s, r"^[ \t]+|[ \t]+$", "")),
        lambda s: (s != "") & ~s.startswith("#") & ~s.isin(dims.DEFAULT_IGNORES),
    )
    own = gitignores.select(K, F.lit("gitignore").alias("origin"),
                            F.posexplode(line).alias("suggestion_ord", "pattern"))
    # Offered in the fixed table's order, whatever order the project lists its languages in.
    globs = F.array(*[
        F.struct(F.lit(lang).alias("lang"), F.lit(i * 10 + j).alias("o"), F.lit(g).alias("g"))
        for i, (lang, gs) in enumerate(dims.TEST_GLOBS.items()) for j, g in enumerate(gs)
    ])
    tests = (
        projects.select(K, F.explode(F.filter(globs, lambda g: F.array_contains("languages", g["lang"]))).alias("g"))
        .select(K, F.lit("tests").alias("origin"), F.col("g.o").alias("suggestion_ord"), F.col("g.g").alias("pattern"))
    )
    return own.unionByName(tests)


# --- language and category -------------------------------------------------

def language_of(path: Column | str) -> Column:
    base, ext = basename(path), file_extension(path)
    return (
        F.when((base == "Dockerfile") | base.startswith("Dockerfile."), "dockerfile")
        .otherwise(F.coalesce(
            lookup(dotfile_key(path), dims.LANGUAGE_BY_EXTENSION),
            F.when(ext != "", F.coalesce(lookup(ext, dims.LANGUAGE_BY_EXTENSION), F.substring(ext, 2, 1_000_000))),
            lookup(base, dims.LANGUAGE_BY_FILENAME),
            F.lit("unknown"),
        ))
    )


_INFRA = (
    r"(?:^|/)(?:" + "|".join(re.escape(n) for n in dims.INFRA_FILENAMES)
    + r"|Dockerfile\.[^/]*|docker-compose\.[^/]*|compose\.ya?ml|[^/]*\.(?i:k8s\.ya?ml))$"
    r"|^\.github/workflows/|^\.circleci/|(?:^|/)(?:k8s|kubernetes)/"
)


def category_of(path: Column | str) -> Column:
    """Infrastructure by name or place comes before the extension. One pattern, so the path is named few times."""
    p = normalize(path)
    return F.when(p.rlike("(^|/)LICENSE$"), "code").when(p.rlike(_INFRA), "infra").otherwise(F.coalesce(
        lookup(file_extension(p), dims.CATEGORY_BY_EXTENSION), lookup(dotfile_key(p), dims.CATEGORY_BY_EXTENSION),
        F.lit("code")))


def with_language(files: DataFrame) -> DataFrame:
    return files.withColumn("language", language_of("path"))


def with_category(files: DataFrame) -> DataFrame:
    return files.withColumn("category", category_of("path"))


def _test_regex() -> str:
    def ext(es):
        return r"\.(?i:" + "|".join(e[1:] for e in es) + ")$"
    suffixes: dict[tuple, list[str]] = {}
    prefixed = [e for e, (ps, _) in dims.TEST_NAMES.items() if ps]
    for e, (_, ss) in dims.TEST_NAMES.items():
        suffixes.setdefault(tuple(ss), []).append(e)
    parts = [r"\.(?:test|spec)" + ext(dims.JS_FAMILY), "(?:^|/)test_[^/]*" + ext(prefixed)]
    return "|".join(parts + ["(?:" + "|".join(ss) + ")" + ext(es) for ss, es in suffixes.items()])


_TEST_NAME = _test_regex()


def is_test_path(path: Column | str) -> Column:
    """Test files by name alone; living in a test folder is not enough."""
    return col(path).rlike(_TEST_NAME)


def with_is_test(files: DataFrame) -> DataFrame:
    return files.withColumn("is_test", is_test_path("path"))


# --- small filters -----------------------------------------------------------

def readable_paths(requests: DataFrame, nodes: DataFrame) -> DataFrame:
    """Requested paths that the graph lists and that stay inside the project."""
    listed = nodes.select(K, F.col("file_path").alias("path"))
    return requests.filter(is_safe_relative("path")).join(listed, [K, "path"], "left_semi")


def hide_categories(nodes: DataFrame, edges: DataFrame, hidden: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes outside the hidden categories and the edges between them."""
    kept = nodes.filter(~lookup("type", dims.NODE_CATEGORY).isin(hidden))
    ids = kept.select(K, "id")
    left = (
        edges.join(ids.withColumnRenamed("id", "source"), [K, "source"], "left_semi")
        .join(ids.withColumnRenamed("id", "target"), [K, "target"], "left_semi")
    )
    return kept, left


def filter_paths(nodes: DataFrame, needle: str) -> DataFrame:
    return nodes.filter(F.lower("file_path").contains(needle.lower()))


def file_level(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("type").isin(dims.FILE_LEVEL_TYPES))


def looks_binary(content: Column | str) -> Column:
    """A NUL among the bytes."""
    return F.instr(F.decode(col(content), "ISO-8859-1"), "\0") > 0


def binary_files(source_files: DataFrame) -> DataFrame:
    return source_files.filter(looks_binary("content_bytes"))
