"""Reading a corpus of repositories: scan, probe, manifests, digests, project identity.

``source_files(repo_id, path, content[, n_bytes])`` is the table everything else starts from; ``content`` is text or
bytes and null for files over the size limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.functions import dims
from lodemap.functions.text import basename
from lodemap.operators.paths import category_of, language_of
from lodemap.plans.cut import cap_rows

K = "repo_id"


def scan_corpus(spark: SparkSession, root: str, tracked: DataFrame | None = None) -> DataFrame:
    """Files of every repository folder directly below ``root``: (repo_id, repo, path, content, n_bytes).

    Version-control and dependency folders and the analyzer's own output are left out. ``tracked(repo, path)`` restricts
    the scan to listed files. A repository is keyed by a hash of its folder name.
    """
    base = root.rstrip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    inside = F.regexp_replace("path", r"^(?:[a-z0-9]+:)?/*", "")
    plain = base.split(":", 1)[-1].lstrip("/")
    relative = F.substring(inside, len(plain) + 2, 1_000_000)
    parts = F.split("_rel", "/")
    out = (
        raw.load(base).select("path", "length", "content").withColumn("_rel", relative).filter(F.size(parts) > 1)
        .select(F.xxhash64(parts[0]).alias(K), parts[0].alias("repo"), F.regexp_replace("_rel", "^[^/]+/", "").alias("path"),
                "content", F.col("length").alias("n_bytes"))
    )
    folders = F.slice(F.split("path", "/"), 1, F.greatest(F.size(F.split("path", "/")) - 1, F.lit(1)))
    nested = F.instr("path", "/") > 0
    pruned = nested & F.arrays_overlap(folders, F.array(*[F.lit(d) for d in dims.PRUNED_DIRECTORIES]))
    own = F.split("path", "/")[0].isin(dims.OUTPUT_DIRECTORIES) & nested
    out = out.filter(~pruned & ~own)
    return out if tracked is None else out.join(tracked.select("repo", "path"), ["repo", "path"], "left_semi")


def _bytes(df: DataFrame) -> Column:
    return F.col("content") if dict(df.dtypes)["content"] == "binary" else F.encode("content", "UTF-8")


def _sized(source_files: DataFrame) -> DataFrame:
    if "n_bytes" in source_files.columns:
        return source_files
    return source_files.withColumn("n_bytes", F.octet_length("content").cast("long"))


def with_text(source_files: DataFrame) -> DataFrame:
    """``content`` as text; bytes that are not UTF-8 are replaced, not refused."""
    df = _sized(source_files)
    if dict(df.dtypes)["content"] == "binary":
        lossy = F.call_function("decode", F.col("content"), F.lit("UTF-8"))
        text = F.coalesce(F.try_validate_utf8(F.col("content").cast("string")), F.make_valid_utf8(F.col("content").cast("string")), lossy)
    else:
        text = F.col("content")
    return df.withColumn("content", text)


def probe_files(source_files: DataFrame) -> DataFrame:
    """The file table: (repo_id, path, language, category, size_lines, content_hash, n_bytes).

    Lines are newline bytes. Content that isn't there counts no lines and has no hash.
    """
    df = _sized(source_files)
    data = _bytes(df)
    as_text = F.decode(data, "ISO-8859-1")
    lines = F.length(as_text) - F.length(F.replace(as_text, F.lit("\n")))
    return df.select(
        K, "path", language_of("path").alias("language"), category_of("path").alias("category"),
        F.coalesce(lines, F.lit(0)).cast("int").alias("size_lines"), F.sha2(data, 256).alias("content_hash"), "n_bytes")


def manifests(source_files: DataFrame) -> DataFrame:
    """Package manifests."""
    return _sized(source_files).filter(basename("path").isin(dims.MANIFEST_FILENAMES))


def config_files(source_files: DataFrame) -> DataFrame:
    """Configuration that import resolution reads."""
    names = ["tsconfig.json", "jsconfig.json", "go.mod", "composer.json"]
    return source_files.filter(basename("path").isin(names)).select(K, "path", "content")


BUCKETS = 4096


def content_digest(files: DataFrame) -> DataFrame:
    """One digest per repository over the sorted (path, size, content hash) of its files.

    Two levels: files are digested in path order inside a bucket of their path's hash, then the bucket digests. Any
    change of a file changes the result, no group holds a whole repository, and the order of rows does not matter.
    """
    path = F.encode("path", "UTF-8")
    sizes = F.concat(F.lpad(F.hex(F.octet_length("path")), 8, "0"), F.lpad(F.hex("n_bytes"), 16, "0"))
    entry = F.concat(sizes, F.hex(path), F.col("content_hash"))
    buckets = (
        files.select(K, F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).alias("_b"), F.struct("path", entry.alias("e")).alias("_e"))
        .groupBy(K, "_b").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list("_e")), lambda s: s["e"]), "\n"), 256).alias("_d"))
    )
    return buckets.groupBy(K).agg(F.sha2(F.concat(F.lit("scan-content:v1\n"), F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("_b", "_d"))), lambda s: F.concat_ws(":", s["_b"].cast("string"), s["_d"])), "\n")), 256).alias("content_digest"))


def cap_files(files: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """At most ``n`` files per repository in path order, and an issue row for each repository that was cut."""
    kept, over = cap_rows(files, [K], ["path"], n)
    text = F.concat(F.lit("Project has "), F.col("total").cast("string"), F.lit(f" files; analyzing the first {n}."))
    return kept, over.select(K, F.lit("dropped").alias("level"), F.lit("truncated").alias("category"), text.alias("message"),
                             F.lit(None).cast("string").alias("path"))


def project_identity(projects: DataFrame, manifest_files: DataFrame) -> DataFrame:
    """Name and description of each repository of ``projects(repo_id, folder)``: (repo_id, name, description).

    The root package.json decides; else the first by path of pyproject.toml, Cargo.toml and go.mod; else the folder.
    """
    base, text = basename("path"), F.col("content")

    def toml(key: str) -> Column:
        return F.nullif(F.regexp_extract(text, rf"(?m)^\s*{key}\s*=\s*[\"']([^\"']+)[\"']", 1), F.lit(""))

    def field(key: str) -> Column:
        v = F.try_parse_json(text)
        return F.when(F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING", F.try_variant_get(v, f"$.{key}", "string"))

    is_json = (F.col("path") == "package.json") & F.coalesce(F.schema_of_variant(F.try_parse_json(text)).startswith("OBJECT"), F.lit(False))
    module = F.trim(F.regexp_extract(text, r"(?m)^[ \t]*module +([^\n]+)$", 1))
    is_toml, is_go = base.isin("pyproject.toml", "Cargo.toml"), (base == "go.mod") & (module != "")
    picked = (
        manifest_files.select(
            K, F.when(is_json, 0).when(is_toml | is_go, 1).alias("_prio"), "path",
            F.when(is_json, field("name")).when(is_toml, toml("name")).when(is_go, F.substring_index(module, "/", -1)).alias("name"),
            F.when(is_json, field("description")).when(is_toml, toml("description"))
            .when(is_go, F.concat(F.lit("Go module "), module, F.lit("."))).alias("description"))
        .filter("_prio is not null").groupBy(K).agg(F.min_by(F.struct("name", "description"), F.struct("_prio", "path")).alias("p"))
    )
    name = F.coalesce("p.name", "folder")
    article = F.when(name.rlike("^[AEIOUaeiou]"), "An ").otherwise("A ")
    return projects.join(picked, K, "left").select(
        K, name.alias("name"), F.coalesce(F.nullif("p.description", F.lit("")), F.concat(article, name, F.lit(" project."))).alias("description"))


def stale_builds(builds: DataFrame, current_version: int) -> DataFrame:
    """Graphs made by another version of the analyzer, or by an unknown one."""
    return builds.filter(~F.col("analyzer_version").eqNullSafe(F.lit(current_version)))
