"""Column helpers for paths, names and text. All are built-in expressions; none is a UDF."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lookup(c: Column | str, table: dict[str, object]) -> Column:
    """Value of a small fixed table, null when the key is absent. Stays in the projection, so no join is planned."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), col(c))


# --- paths ---------------------------------------------------------------

def normalize(p: Column | str) -> Column:
    """Forward slashes only, empty segments dropped (a leading slash goes too)."""
    return F.regexp_replace(F.regexp_replace(col(p), r"[/\\]+", "/"), r"^/|/$", "")


def directory(p: Column | str) -> Column:
    return F.regexp_extract(col(p), r"(?s)^(.*)/", 1)


def basename(p: Column | str) -> Column:
    return F.substring_index(col(p), "/", -1)


def file_extension(p: Column | str) -> Column:
    """Lower-cased, with the dot; a leading dot is not an extension."""
    return F.lower(F.regexp_extract(col(p), r"[^/](\.[^./]*)$", 1))


def stem(p: Column | str) -> Column:
    return F.regexp_replace(basename(p), r"(?s)^(.+)\.[^.]*$", "$1")


def join_path(*parts: Column | str) -> Column:
    return F.concat_ws("/", *[F.nullif(col(p), F.lit("")) for p in parts])


def top_directory(p: Column | str) -> Column:
    """First segment of a path that has a directory, else null."""
    return F.when(F.instr(col(p), "/") > 0, F.nullif(F.regexp_extract(col(p), r"^/*([^/]+)/", 1), F.lit("")))


def segments(p: Column | str) -> Column:
    return F.filter(F.split(col(p), "/"), lambda s: s != "")


def resolve(base_dir: Column | str, relative: Column | str) -> Column:
    """``relative`` seen from ``base_dir`` with ``.`` and ``..`` collapsed; '' when it leaves the root."""
    parts = F.filter(
        F.split(F.concat_ws("/", col(base_dir), col(relative)), "/"), lambda s: (s != "") & (s != ".")
    )
    empty = F.array().cast("array<string>")

    def step(acc: Column, seg: Column) -> Column:
        up = F.when(F.size(acc) > 0, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        return F.when(acc.isNull(), F.lit(None)).when(seg == "..", up).otherwise(F.concat(acc, F.array(seg)))

    return F.coalesce(F.array_join(F.aggregate(parts, empty, step), "/"), F.lit(""))


def is_safe_relative(p: Column | str) -> Column:
    c = col(p)
    return (
        (c != "")
        & ~c.contains("\0")
        & ~c.startswith("/")
        & (F.substring(c, 2, 1) != ":")
        & ~c.rlike(r"(?s)(^|/)\.\.(/|$)")
    )


def dotfile_key(p: Column | str) -> Column:
    """``.env`` for ``.env.local``; null for names that do not start with a dot and a letter or digit."""
    return F.nullif(F.lower(F.regexp_extract(col(p), r"(?:^|/)(\.[\p{L}\p{N}]+)[^/]*$", 1)), F.lit(""))


# --- names and text ------------------------------------------------------

def short_name(name: Column | str) -> Column:
    return F.regexp_replace(col(name), r"(?s)^.+\.([^.]*)$", "$1")


def owner_type(name: Column | str) -> Column:
    return F.nullif(F.regexp_extract(col(name), r"(?s)^(.+)\.[^.]*$", 1), F.lit(""))


def clamp(text: Column | str, limit: int) -> Column:
    c = col(text)
    return F.when(F.char_length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def newline_count(text: Column | str) -> Column:
    c = col(text)
    return (F.octet_length(c) - F.octet_length(F.replace(c, F.lit("\n")))).cast("int")


def slug(text: Column | str) -> Column:
    """Lower-case letters and digits with single dashes, at most 60 characters; ``domain`` when nothing is left."""
    dashed = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]+", "-")
    return F.left(F.coalesce(F.nullif(F.regexp_replace(dashed, r"^-+|-+$", ""), F.lit("")), F.lit("domain")), F.lit(60))


def loosely(text: Column | str) -> Column:
    return F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}]", "")
