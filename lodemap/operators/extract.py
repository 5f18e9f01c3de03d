"""Declarations out of source text, as one relational job over lines.

A file row is lexed in place (comments and strings blanked, length kept), exploded to lines, and everything that needs
neighbours - bracket depth, block ends, enclosing type, indentation - is a window over one file. Rows are spread by
(repo_id, path) once, before the explode, so no window shuffles again; a window holds one file. Only lines that
declare or call something leave the job.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodemap.functions import packs as P
from lodemap.functions.text import basename, file_extension, lookup, normalize
from lodemap.plans.cut import cut

K = "repo_id"
FILE = [K, "path"]
STRINGS = "array<string>"
IMPORTS = "array<struct<source:string,specifiers:array<string>>>"
EXPORTS = "array<struct<name:string,is_default:boolean>>"
#: Bytes of source text that one task turns into lines, at most, and bytes for which a task is worth its start.
TASK_BYTES = 1 << 20
LEAST_BYTES = 512 << 10


def _none(kind: str = "string") -> Column:
    return F.lit(None).cast(kind)


def _strip(c: Column, chars: str = " \t") -> Column:
    return F.btrim(c, F.lit(chars))


def _group(c: Column, pattern: str, i: int = 1) -> Column:
    """A group of the first match, null when it does not match or is empty."""
    return F.nullif(F.regexp_extract(c, pattern, i), F.lit(""))


def _first_group(c: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[_group(c, p) for p in patterns])


# --- lexing ---------------------------------------------------------------------------

def _token_pattern(name: str) -> str:
    """Comment, string, plain run or single character, in the order they are tried."""
    line, block, quotes, multi, esc = P.SYNTAX[name]
    e = re.escape(esc)
    parts = [re.escape(t) + r"[^\n]*" for t in line]
    parts += [re.escape(o) + r"[\s\S]*?(?:" + re.escape(c) + r"|\z)" for o, c in block + multi]
    parts += [f"{q}[^{q}{e}\\n]*+(?:{e}[^\\n]?[^{q}{e}\\n]*+)*+{q}?" for q in quotes]
    starts = "".join(sorted({re.escape(t[0]) for t in [*line, *[o for o, _ in block + multi], *quotes]}))
    return "|".join(parts + [f"[^{starts}]+", r"[\s\S]"])


def _array(items: list[str]) -> Column:
    return F.array(*[F.lit(i) for i in items])


def lex(files: DataFrame) -> DataFrame:
    """Adds ``text`` (comments blanked) and ``structure`` (strings blanked too); offsets stay those of ``content``.

    The token pattern is looked up per file: Spark keeps the last compiled one, so it is compiled once per change of
    language, and one expression serves all of them.
    """
    name = lookup("language", P.SYNTAX_OF)
    rules = {}
    for syntax, (line, block, quotes, multi, _) in P.SYNTAX.items():
        rules[syntax] = F.struct(
            F.lit(_token_pattern(syntax)).alias("pattern"), _array(["\0", *line, *[o for o, _ in block]]).alias("comment"),
            _array([*quotes, *[o for o, _ in multi]]).alias("string"))
    rule = F.try_element_at(F.create_map(*[x for k, v in rules.items() for x in (F.lit(k), v)]), name)
    typed = files.withColumn("_rule", rule).withColumn("_tokens", F.regexp_extract_all("content", F.col("_rule.pattern"), 0))

    def blanked(openers: Column) -> Column:
        return F.array_join(F.transform("_tokens", lambda t: F.when(
            F.exists(openers, lambda o: t.startswith(o)), F.regexp_replace(t, r"[^\n]", " ")).otherwise(t)), "")

    known = F.col("_rule").isNotNull()
    return typed.select(
        *files.columns, F.when(known, blanked(F.col("_rule.comment"))).otherwise(F.col("content")).alias("text"),
        F.when(known, blanked(F.concat("_rule.comment", "_rule.string"))).otherwise(F.col("content")).alias("structure"))


# --- parentheses and parameters --------------------------------------------------------------

def _nested(depth: int) -> str:
    flat = r"[^()\"']|\"[^\"]*\"|'[^']*'"
    inner = flat
    for _ in range(depth):
        inner = flat + r"|\((?:" + inner + r")*+\)"
    return inner


BALANCED = r"^[^(]*\(((?:" + _nested(5) + r")*+)\)"


def _balanced_inner(text: Column) -> Column:
    """What the first parenthesis of ``text`` holds, nested to any depth; null where it stays open or a quote does."""
    runs = F.regexp_extract_all(F.regexp_extract(text, r"(?s)^[^(]*\((.*)$", 1), F.lit(r"[^()\"']+|\"[^\"]*\"|'[^']*'|[\s\S]"), 0)
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("held"))

    def step(s: Column, c: Column) -> Column:
        # Depth 0 is the end; an open quote never ends.
        depth = F.when(s["depth"] <= 0, s["depth"]).when(c.isin('"', "'"), -1).when(c == "(", s["depth"] + 1).when(c == ")", s["depth"] - 1).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), F.when(depth > 0, F.concat(s["held"], c)).otherwise(s["held"]).alias("held"))

    return F.when(F.instr(text, "(") > 0, F.aggregate(runs, start, step, lambda s: F.when(s["depth"] == 0, s["held"])))


def params_of(text: Column, drop_self: Column) -> Column:
    """Names of the first balanced parenthesis of ``text``, which starts at the declared name.

    A first fold finds the closing parenthesis at any depth. A second over marks and the runs between them splits at commas outside brackets and quotes and stops each part at its default value
    or type. Declarations are few and their lists short.
    """
    inner = F.coalesce(F.nullif(F.regexp_extract(text, BALANCED, 1), F.lit("")), _balanced_inner(text), F.lit(""))
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("shut"), F.lit("").alias("cur"),
                     F.array().cast(STRINGS).alias("parts"))

    def step(s: Column, c: Column) -> Column:
        quoted = s["quote"] != ""
        opens, closes = ~quoted & c.isin("(", "[", "{", "<"), ~quoted & c.isin(")", "]", "}", ">")
        split = ~quoted & (c == ",") & (s["depth"] == 0)
        shut = s["shut"] | (~quoted & c.isin("=", ":") & (s["depth"] == 0))
        return F.struct(
            F.when(opens, s["depth"] + 1).when(closes, s["depth"] - 1).otherwise(s["depth"]).alias("depth"),
            F.when(quoted & (c == s["quote"]), "").when(~quoted & c.isin('"', "'", "`"), c).otherwise(s["quote"]).alias("quote"),
            F.when(split, False).otherwise(shut).alias("shut"),
            F.when(split, "").when(shut, s["cur"]).otherwise(F.concat(s["cur"], c)).alias("cur"),
            F.when(split, F.concat(s["parts"], F.array(s["cur"]))).otherwise(s["parts"]).alias("parts"))

    runs = F.regexp_extract_all(inner, F.lit(r"[^()\[\]{}<>\"'`,=:]+|[\s\S]"), 0)
    parts = F.aggregate(runs, start, step, lambda s: F.concat(s["parts"], F.array(s["cur"])))

    def name(raw: Column) -> Column:
        t = _strip(raw, " \t\r\n")
        mark = F.regexp_extract(t, r"^(\.\.\.|\*\*|\*|&)", 1)
        rest = F.regexp_replace(t, r"^(\.\.\.|\*\*|\*|&)", "")
        words = F.filter(F.split(rest, r"[ \t]+"), lambda w: (w != "") & ~w.isin(P.PARAM_MODIFIERS) & ~w.startswith("@"))
        last = _strip(F.try_element_at(words, F.lit(-1)), "()[]{}<>,;*&?")
        shown = F.when(rest.startswith("{"), "{…}").when(rest.startswith("["), "[…]").when(last.rlike(r"^[\p{L}_$]"), last)
        return F.when(t != "", F.concat(F.regexp_replace(mark, "&", ""), shown))

    names = F.array_compact(F.transform(parts, name))
    return F.filter(names, lambda n: ~(drop_self & n.isin("self", "cls")))


# --- lines ------------------------------------------------------------------------------------

JS_START = r"^\s*(?:import\s|export\s+(?:type\s+)?[*{])"
JS_DONE = "|".join(f"(?:{P.JS[k]})" for k in ("import_from", "import_bare", "reexport", "export_clause"))


def _sums(structure: Column, opens: str, closes: str) -> Column:
    """Of one kind of brackets in a line: how much it adds to the depth, the lowest point on the way, whether it has any."""
    found = F.regexp_extract_all(structure, F.lit(f"[{opens}{closes}]"), 0)
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"), F.lit(False).alias("any"))

    def step(s: Column, c: Column) -> Column:
        total = s["sum"] + F.when(c == opens, 1).otherwise(-1)
        return F.struct(total.alias("sum"), F.least(s["low"], total).alias("low"), F.lit(True).alias("any"))

    return F.when(structure.contains(opens) | structure.contains(closes), F.aggregate(found, zero, step)).otherwise(zero)


def _lines_to_close(sums: str, i: Column) -> Column:
    """How many lines below line ``i`` (from 0) the bracket closes that it leaves open, or the first one after it; null if none does."""
    own = F.get(F.col(sums), i)
    start = F.struct((own["sum"] - own["low"]).alias("depth"), F.lit(0).alias("n"), F.lit(False).alias("shut"))

    def step(s: Column, x: Column) -> Column:
        shut = s["shut"] | F.when(s["depth"] > 0, s["depth"] + x["low"] <= 0).otherwise(x["any"] & (x["sum"] <= 0))
        return F.struct(F.when(s["depth"] > 0, s["depth"] + x["sum"]).otherwise(F.greatest(x["sum"], F.lit(0))).alias("depth"),
                        F.when(s["shut"], s["n"]).otherwise(s["n"] + 1).alias("n"), shut.alias("shut"))

    def within(reach: Column) -> Column:
        return F.aggregate(F.slice(sums, i + 2, reach), start, step, lambda s: F.when(s["shut"], s["n"]))

    # Most close soon; the last one is the whole file.
    return F.coalesce(*[within(r) for r in (F.lit(8), F.lit(128), F.lit(2048), F.size(sums))])


def _dealt(files: DataFrame, written: bool) -> DataFrame:
    """``files`` by file over tasks of ``TASK_BYTES`` of text each, however well it is compressed.

    AQE would go by the bytes of the shuffle, some hundredth of what the rows of lines take. A task costs seconds of its
    own here (generated code of many windows), so that smaller tables get fewer. Texts are written once, if they aren't yet, and counted there.
    """
    laid = files if written else cut(files)
    size = laid.agg(F.sum(F.octet_length("content").cast("long")).alias("n")).first()["n"] or 0
    few = min(files.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES))
    return laid.repartition(max(1, few, -(-size // TASK_BYTES)), *FILE)


def lines(files: DataFrame, written: bool = False) -> DataFrame:
    """Every line with its blanked views and what its file says about it.

    ``line`` counts from 1. ``depth`` is the bracket depth at its start, ``closes`` the line below on which a parenthesis
    that it opens closes, ``block_end`` where the braces that open on it or the three lines below close (those of ``closes``,
    if that is further down), ``more`` the lines that continue an open parenthesis, ``stmt`` a joined import or export statement.
    """
    views = lex(_dealt(files.filter(F.col("content").isNotNull()), written))

    def split(c: str) -> Column:
        all_lines = F.split(c, "\n")
        return F.when((F.size(all_lines) > 1) & (F.element_at(all_lines, -1) == ""),
                      F.slice(all_lines, 1, F.greatest(F.size(all_lines) - 1, F.lit(1)))).otherwise(all_lines)

    arrays = views.select(K, "path", "language", split("content").alias("_r"), split("text").alias("_t"), split("structure").alias("_s"))
    is_js = F.col("language").isin(P.JS_LANGUAGES)
    is_code, is_sql = F.col("language").isin(P.CODE_LANGUAGES), F.col("language") == "sql"
    # Where a line's view doesn't close by its brackets (quotes that are none), so many lines are looked at.
    least = F.when(F.col("language") == "powershell", 20).otherwise(8)
    arrays = (
        arrays.withColumn("_p", F.when(is_code | is_sql, F.transform("_s", lambda x: _sums(x, "(", ")"))))
        .withColumn("_c", F.when(is_js, F.transform("_s", lambda x: _sums(x, "{", "}"))))
    )

    def closing(t: Column, i: Column) -> Column:
        is_open = is_code & t.rlike(r"(?i)\b(?:def|func|function|fun|fn|param)\b|\(") & ~t.rlike(BALANCED) & _balanced_inner(t).isNull()
        is_table = is_sql & t.rlike(P.SQL["table"]) & (_group(t, P.SQL["table"]).isNotNull())
        n = F.when(is_open | is_table, _lines_to_close("_p", i))
        return F.struct(n.alias("n"), F.when(is_open, F.concat_ws(" ", F.slice("_t", i + 2, F.greatest(least, n)))).alias("more"))

    def statement(t: Column, i: Column) -> Column:
        code = _strip(t)
        # To where the braces close, and on for the source.
        n = F.when(code.contains("{"), _lines_to_close("_c", i))
        below = F.transform(F.slice("_t", i + 2, F.coalesce(n, F.lit(0)) + 80), _strip)
        stop = F.array_position(F.transform(below, lambda x: F.when(x.endswith(";"), 1).otherwise(0)), 1).cast("int")
        joined = F.concat_ws(" ", code, F.array_join(F.filter(F.when(stop > 0, F.slice(below, 1, F.greatest(stop, F.lit(1)))).otherwise(below), lambda x: x != ""), " "))
        return F.when(is_js & code.rlike(JS_START) & ~code.rlike(JS_DONE) & ~code.endswith(";"), joined)

    rows = arrays.select(
        K, "path", "language", F.size("_r").alias("n"),
        F.posexplode(F.arrays_zip(F.col("_r").alias("raw"), F.col("_t").alias("text"), F.col("_s").alias("structure"),
                                  F.transform("_t", closing).alias("shut"), F.transform("_t", statement).alias("stmt"))).alias("_i", "_l"))
    base = rows.select(K, "path", "language", "n", (F.col("_i") + 1).alias("line"), "_l.raw", "_l.text", "_l.structure", F.col("_l.shut.more").alias("more"),
                       "_l.stmt", (F.col("_i") + 1 + F.col("_l.shut.n")).alias("closes"))
    brackets = F.transform(F.regexp_extract_all("structure", F.lit(r"[\[\](){}]"), 0), lambda c: F.when(c.isin("(", "[", "{"), 1).otherwise(-1))
    zero = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("low"))
    sums = F.when(F.col("structure").rlike(r"[\[\](){}]"), F.aggregate(brackets, zero, lambda s, d: F.struct(
        (s["sum"] + d).alias("sum"), F.least(s["low"], s["sum"] + d).alias("low")))).otherwise(zero)
    in_order = Window.partitionBy(*FILE).orderBy("line")
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    marked = (
        base.withColumn("code", _strip(F.col("text"))).withColumn("blank", _strip(F.col("raw")) == "")
        .withColumn("indent", F.length(F.regexp_extract("raw", r"^[ \t]*", 0))).withColumn("_b", sums)
        .withColumn("_sum", F.coalesce(F.sum("_b.sum").over(before), F.lit(0)))
        .withColumn("_low", F.col("_sum") + F.col("_b.low"))
        .withColumn("depth", F.col("_sum") - F.least(F.lit(0), F.coalesce(F.min("_low").over(before), F.lit(0))))
        .drop("_b", "_sum", "_low")
    )
    return _block_ends(marked)


def _block_ends(df: DataFrame) -> DataFrame:
    """Adds ``block_end``. Braces ride along as extra rows: at equal level the next brace row closes an open one."""
    keep = [c for c in df.columns if c not in (K, "path", "line", "n")]
    braces = F.transform(F.regexp_extract_all("structure", F.lit(r"[{}]"), 0), lambda c, i: F.struct((i + 1).alias("pos"), c.alias("ch")))
    both = df.withColumn("_x", F.explode(F.concat(F.array(F.struct(F.lit(0).alias("pos"), _none().alias("ch"))), braces)))
    # A brace row carries no text.
    slim = both.select(K, "path", "line", "n", F.col("_x.pos").alias("_pos"), F.col("_x.ch").alias("_ch"),
                       *[F.when(F.col("_x.pos") == 0, F.col(c)).alias(c) for c in keep])
    running = Window.partitionBy(*FILE).orderBy("line", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    delta = F.when(F.col("_ch") == "{", 1).when(F.col("_ch") == "}", -1).otherwise(0)
    level = F.when(F.col("_ch") == "{", F.col("_run") - 1).when(F.col("_ch") == "}", F.col("_run"))
    at_level = Window.partitionBy(*FILE, "_level").orderBy("line", "_pos")
    on_line = Window.partitionBy(*FILE, "line")
    closed = (
        slim.withColumn("_run", F.sum(delta).over(running)).withColumn("_level", level)
        .withColumn("_close", F.when(F.col("_ch") == "{", F.coalesce(F.lead("line").over(at_level), F.col("n"))))
        .withColumn("_first", F.min(F.when(F.col("_ch") == "{", F.struct("_pos", F.col("_close").alias("at")))).over(on_line))
        .filter("_pos = 0")
    )
    w = Window.partitionBy(*FILE).orderBy("line")
    ends = [F.col("_first.at"), *[F.lead("_first.at", i).over(w) for i in (1, 2, 3)]]
    # A head of more than three further lines meets the line that ends it by that line's number.
    head = F.when(F.col("closes") > F.col("line") + 3, F.col("closes"))
    at_close = Window.partitionBy(*FILE, F.coalesce(head, F.col("line")))
    near = closed.withColumn("_near", F.coalesce(*ends)).withColumn("_head", head)
    far = F.max(F.when(F.col("_head").isNull() & ~F.col("code").endswith(";"), F.col("_near"))).over(at_close)
    return near.withColumn("block_end", F.coalesce(F.when(F.col("_head").isNotNull(), far), F.col("_near"), F.col("line"))).drop("_near", "_head").drop("_pos", "_ch", "_run", "_level", "_close", "_first")


def _next_stop(stop: Column) -> Column:
    """Last line with content before the next line where ``stop`` holds: what an indented block ends on."""
    up = Window.partitionBy(*FILE).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*FILE)
    after = F.last(F.when(stop, F.col("_prev")), True).over(up)
    return F.greatest(F.col("line"), F.coalesce(after, F.max(F.when(~F.col("blank"), F.col("line"))).over(whole)))


def _with_prev(df: DataFrame) -> DataFrame:
    down = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_prev", F.coalesce(F.last(F.when(~F.col("blank"), F.col("line")), True).over(down), F.lit(0)))


# --- what a line of code declares -----------------------------------------------------------------

def _by_language(table: dict[str, Column], default: Column) -> Column:
    out = None
    for lang, value in table.items():
        out = F.when(F.col("language") == lang, value) if out is None else out.when(F.col("language") == lang, value)
    return out.otherwise(default) if out is not None else default


def _imports(*pairs: tuple[Column, Column | None]) -> Column:
    """List of one import from the first source that is not null."""
    out = _none(IMPORTS)
    for source, specs in reversed(pairs):
        spec = specs if specs is not None else F.array().cast(STRINGS)
        out = F.when(source.isNotNull(), F.array(F.struct(source.alias("source"), spec.alias("specifiers")))).otherwise(out)
    return out


def _clause_names(clause: Column) -> Column:
    """Names of an import or export clause: ``a as b`` is b; what stands before the braces comes after them."""
    inner = F.regexp_extract(clause, r"(?s)\{(.*)\}", 1)

    def piece(p: Column) -> Column:
        words = F.filter(F.split(_strip(p), r"[ \t]+"), lambda w: w != "")
        last = F.try_element_at(words, F.lit(-1))
        return F.when(F.size(words) > 0, F.when(last != "type", last).when((F.size(words) >= 3) & (F.try_element_at(words, F.lit(-2)) == "as"), last))

    outer = F.regexp_replace(_strip(clause), r"(?s)\{.*\}.*$", "")
    return F.concat(
        F.array_compact(F.transform(F.split(inner, ","), piece)),
        F.filter(F.transform(F.split(outer, ","), _strip), lambda s: (s != "") & (s != "type")))


def _named(name: Column, default: Column | bool = False) -> Column:
    is_default = F.lit(default) if isinstance(default, bool) else default
    return F.when(name.isNotNull(), F.array(F.struct(name.alias("name"), is_default.alias("is_default")))).otherwise(F.array().cast(EXPORTS))


def _declare(df: DataFrame) -> DataFrame:
    """Adds imp, typ, body, fn, fn_end, after, exp, ret: what each line of code declares at the outer level."""
    code, lang = F.col("code"), F.col("language")
    outer = (F.col("depth") == 0) & (code != "")

    # Brace languages: one rule table.
    brace = {k: _by_language({lng: (_first_group(code, r[k]) if isinstance(r[k], list) else _group(code, r[k])) if r.get(k) else _none()
                              for lng, r in P.BRACE.items()}, _none()) for k in ("imports", "package", "types", "functions")}
    tail = F.nullif(F.regexp_extract(_strip(F.col("_b_imp"), " \t\"'<>;"), r"[^/.:\\]*$", 0), F.lit(""))
    noise = "|".join(re.escape(x) for x in P.EXPORT_NOISE)
    visible = _by_language({lng: F.lit(True) if r["exports"] == "all" else code.rlike(
        rf"^(?:(?:{noise})[ \t]+)*(?:{'|'.join(r['exports'])})(?:[ \t]|$)") for lng, r in P.BRACE.items()}, F.lit(False))

    # JavaScript: statements may span lines.
    stmt = F.coalesce("stmt", "code")
    starts = code.startswith("import") | code.startswith("export")
    js = {k: _group(code, P.JS[k]) for k in ("function", "binding", "class", "interface", "alias", "enum", "export_default")}
    s_from, s_bare, s_re = _group(stmt, P.JS["import_from"], 2), _group(stmt, P.JS["import_bare"]), _group(stmt, P.JS["reexport"], 2)
    s_clause = F.when(stmt.rlike(P.JS["export_clause"]), F.regexp_extract(stmt, P.JS["export_clause"], 1))

    is_brace, is_js = lang.isin(list(P.BRACE)), lang.isin(P.JS_LANGUAGES)
    script_ok = F.coalesce(F.col("in_script"), F.lit(True))
    d = (
        df.withColumn("_top", outer & script_ok)
        .withColumn("_b_imp", F.when(is_brace & F.col("_top"), brace["imports"]))
        .withColumn("_b_pkg", F.when(is_brace & F.col("_top") & F.col("_b_imp").isNull(), brace["package"]))
        .withColumn("_b_typ", F.when(is_brace & F.col("_top") & F.col("_b_imp").isNull() & F.col("_b_pkg").isNull(), brace["types"]))
        .withColumn("_b_fn", F.when(is_brace & F.col("_top") & F.col("_b_imp").isNull() & F.col("_b_pkg").isNull() & F.col("_b_typ").isNull(), brace["functions"]))
        .withColumn("_js", is_js & F.col("_top"))
        .withColumn("_j_from", F.when(F.col("_js") & starts, s_from)).withColumn("_j_bare", F.when(F.col("_js") & starts & F.col("_j_from").isNull(), s_bare))
        .withColumn("_j_none", F.col("_j_from").isNull() & F.col("_j_bare").isNull())
        .withColumn("_j_re", F.when(F.col("_js") & starts & F.col("_j_none"), s_re))
        .withColumn("_j_clause", F.when(F.col("_js") & starts & F.col("_j_none") & F.col("_j_re").isNull(), s_clause))
        .withColumn("_j_live", F.col("_js") & F.col("_j_re").isNull() & F.col("_j_clause").isNull())
        .withColumn("_j_class", F.when(F.col("_j_live"), F.coalesce(js["class"], js["interface"])))
        .withColumn("_j_flat", F.when(F.col("_j_live") & F.col("_j_class").isNull(), F.coalesce(js["enum"], js["alias"])))
        .withColumn("_j_enum", js["enum"].isNotNull())
        .withColumn("_j_fn", F.when(F.col("_j_live") & F.col("_j_class").isNull() & F.col("_j_flat").isNull(), js["function"]))
        .withColumn("_j_bind", F.when(F.col("_j_live") & F.col("_j_class").isNull() & F.col("_j_flat").isNull() & F.col("_j_fn").isNull(), js["binding"]))
        .withColumn("_rhs", F.when(F.col("_j_bind").isNotNull(), _strip(F.regexp_extract(code, P.JS["binding"], 2))))
        .withColumn("_j_val", F.when(F.col("_rhs").rlike(P.JS["function_value"]), F.col("_j_bind")))
    )
    calls = F.regexp_extract_all("code", F.lit(P.JS["require"]), 1)
    none_imp = F.array().cast(IMPORTS)
    js_imp = F.concat(
        F.coalesce(_imports((F.col("_j_from"), _clause_names(F.regexp_extract(stmt, P.JS["import_from"], 1))), (F.col("_j_bare"), None),
                            (F.col("_j_re"), _clause_names(F.regexp_extract(stmt, P.JS["reexport"], 1)))), none_imp),
        F.when(F.col("_j_live"), F.transform(calls, lambda s: F.struct(s.alias("source"), F.array().cast(STRINGS).alias("specifiers")))).otherwise(none_imp))
    passed_on = F.when(F.col("_j_re").isNotNull(), F.regexp_extract(stmt, P.JS["reexport"], 1)).otherwise(F.col("_j_clause"))
    js_exp = F.concat(
        F.when(passed_on.isNotNull(), F.transform(F.filter(_clause_names(passed_on), lambda n: n != "*"), lambda n: F.struct(
            n.alias("name"), F.lit(False).alias("is_default")))).otherwise(F.array().cast(EXPORTS)),
        F.when(F.col("_j_live") & code.startswith("export default"), _named(F.coalesce(js["export_default"], F.lit("default")), True)).otherwise(F.array().cast(EXPORTS)),
        F.when(code.startswith("export "), _named(F.coalesce("_j_class", "_j_flat", "_j_fn", "_j_bind"),
                                                  F.col("_j_fn").isNotNull() & code.contains("export default"))).otherwise(F.array().cast(EXPORTS)))

    # Go: a grouped import is a state that lasts until its bracket.
    go = lang == "go"
    go_top = go & F.col("_top") & ~F.col("go_block")
    g_src = F.when(go & F.col("go_block"), _group(code, P.GO["import_line"], 2)).otherwise(F.when(go_top, _group(code, P.GO["import"], 2)))
    g_alias = F.when(F.col("go_block"), _group(code, P.GO["import_line"])).otherwise(_group(code, P.GO["import"]))
    g_spec = F.array(F.coalesce(g_alias, F.substring_index(g_src, "/", -1)))
    g_pkg = F.when(go_top & g_src.isNull(), _group(code, P.GO["package"]))
    g_method = F.when(go_top, _group(code, P.GO["method"], 2))
    g_fn = F.when(go_top, _group(code, P.GO["function"]))
    g_typ = F.when(go_top & g_method.isNull() & g_fn.isNull(), _group(code, P.GO["type"]))

    # Languages scoped by indentation: outer means no indent.
    left = (F.col("indent") == 0) & (code != "")
    py, rb, lua = (lang == "python") & left & outer, (lang == "ruby") & left & outer, (lang == "lua") & left
    p_from, p_mod = F.when(py, _group(code, P.PYTHON["from"])), F.when(py & code.startswith("import "), _group(code, P.PYTHON["import"]))

    def bound(part: Column) -> Column:
        words = F.filter(F.split(part, " "), lambda w: w != "")
        return F.struct(F.element_at(words, 1).alias("source"), F.array(
            F.when((F.size(words) >= 3) & (F.get(words, 1) == "as"), F.get(words, 2)).otherwise(F.element_at(words, 1))).alias("specifiers"))

    def from_name(part: Column) -> Column:
        words = F.filter(F.split(part, " "), lambda w: w != "")
        return F.when((F.size(words) >= 3) & (F.get(words, 1) == "as"), F.get(words, 2)).otherwise(F.get(words, 0))

    def pieces(text: Column) -> Column:
        return F.filter(F.transform(F.split(text, ","), _strip), lambda s: s != "")

    p_names = F.transform(pieces(F.regexp_replace(_strip(F.regexp_extract(code, P.PYTHON["from"], 2)), r"^\(|\)$", "")), from_name)
    r_req = F.when(rb, _group(code, P.RUBY["require"]))
    p_typ = F.when(py & p_from.isNull() & p_mod.isNull(), _group(code, P.PYTHON["class"]))
    r_typ = F.when(rb & r_req.isNull(), _group(code, P.RUBY["class"]))
    p_fn = F.when(py & p_from.isNull() & p_mod.isNull(), _group(code, P.PYTHON["function"]))
    r_fn = F.when(rb & r_req.isNull() & r_typ.isNull(), _group(code, P.RUBY["function"]))
    l_fn = F.when(lua, _first_group(code, P.LUA["function"]))
    l_imp = F.transform(F.when(lua, F.regexp_extract_all("code", F.lit(P.LUA["require"]), 1)), lambda s: F.struct(s.alias("source"), F.array().cast(STRINGS).alias("specifiers")))

    # Scripts.
    sh = lang.isin("shell", "jenkinsfile") & (code != "")
    sh_src = F.when(sh, _group(code, P.SHELL["source"]))
    opens_here, opens_next = code.contains("{"), F.coalesce(F.col("next_code").startswith("{"), F.lit(False))
    sh_fn = F.when(sh & sh_src.isNull() & (F.col("indent") == 0) & (opens_here | opens_next), _first_group(code, P.SHELL["function"]))
    is_bat = file_extension("path").isin(".bat", ".cmd")
    ps = lang.isin("powershell", "batch") & (code != "")
    ps_src = F.when(ps & ~is_bat, _group(code, P.POWERSHELL["import"]))
    ps_fn = F.when(ps & ~is_bat & ps_src.isNull(), _group(code, P.POWERSHELL["function"]))
    bat_fn = F.when(ps & is_bat, _group(code, P.POWERSHELL["label"]))

    capital = r"^\p{Lu}"
    imp = (
        F.when(is_brace, _imports((F.col("_b_imp"), F.when(tail.isNull(), F.array().cast(STRINGS)).otherwise(F.array(tail))),
                                  (F.concat(F.lit("package:"), "_b_pkg"), None)))
        .when(is_js, js_imp).when(go, _imports((g_src, g_spec), (F.concat(F.lit("package:"), g_pkg), None)))
        .when(lang == "python", F.when(p_from.isNotNull(), _imports((p_from, p_names))).when(p_mod.isNotNull(), F.transform(pieces(p_mod), bound)))
        .when(lang == "ruby", _imports((r_req, F.array(basename(r_req))))).when(lang == "lua", l_imp)
        .otherwise(_imports((sh_src, None), (ps_src, None)))
    )
    typ = F.coalesce("_b_typ", "_j_class", "_j_flat", g_typ, p_typ, r_typ)
    fn = F.coalesce("_b_fn", "_j_fn", "_j_val", g_method, g_fn, p_fn, r_fn, l_fn, sh_fn, ps_fn, bat_fn)
    exp = (
        F.when(is_brace, F.when(visible, _named(F.coalesce("_b_typ", "_b_fn")))).when(is_js, js_exp)
        .when(go, F.when(F.coalesce(g_method, g_fn, g_typ).rlike(capital), _named(F.coalesce(g_method, g_fn, g_typ))))
        .when(lang == "lua", F.when(~code.startswith("local"), _named(l_fn)))
        .otherwise(_named(F.coalesce(p_typ, p_fn, r_typ, r_fn, sh_fn, ps_fn, bat_fn)))
    )
    by_indent = lang.isin("python", "ruby", "lua")
    flat_end = F.when(F.col("_j_flat").isNotNull() & ~F.col("_j_enum") & ~code.contains("{"), F.col("line"))
    value_end = F.when(F.col("_j_val").isNotNull() & ~F.col("_rhs").contains("{"), F.col("line"))
    go_end = F.when(g_typ.isNotNull() & ~code.contains("{"), F.col("line"))
    bat_end = F.when(bat_fn.isNotNull(), F.col("line"))
    sh_end = F.when(sh_fn.isNotNull() & ~opens_here, F.col("next_block_end"))
    # Where the parameter list is looked for: after the name, the equals sign of a binding, a receiver.
    mark = F.when(F.col("_j_val").isNotNull(), "=").when(g_method.isNotNull(), ")").otherwise(fn)
    after = F.when(fn.isNotNull() & ~lang.isin("shell", "jenkinsfile", "batch"), F.concat_ws(" ", F.substring(
        F.col("text"), F.instr("text", mark) + F.length(mark), F.length("text")), F.col("more")))
    ret = (
        F.when(lang == "python", F.nullif(_strip(F.regexp_extract(code, r"->(.*)$", 1), " \t:"), F.lit("")))
        .when(F.col("_j_fn").isNotNull(), F.nullif(_strip(F.regexp_extract(code, r"\)[^):]*:([^)]*)$", 1), " \t{;"), F.lit("")))
    )
    return d.select(
        *df.columns, imp.alias("imp"), typ.alias("typ"),
        F.coalesce(F.col("_j_flat").isNull() & typ.isNotNull(), F.lit(False)).alias("body"), fn.alias("fn"),
        F.coalesce(flat_end, value_end, go_end, bat_end, sh_end, F.when(by_indent, F.col("indent_end")).otherwise(F.col("block_end"))).alias("end"),
        exp.alias("exp"), after.alias("after"), ret.alias("ret"), F.when(g_method.isNotNull(), _group(code, P.GO["method"])).alias("receiver"))


def _script_lines(df: DataFrame) -> DataFrame:
    """``in_script``: null outside component files, else whether the line is in the first script block."""
    whole = Window.partitionBy(*FILE)
    parts = F.col("path").rlike(r"(?i)\.(vue|svelte)$")
    low = F.lower("raw")
    return (
        df.withColumn("_s", F.when(parts, F.min(F.when(parts & low.contains("<script"), F.col("line"))).over(whole)))
        .withColumn("_e", F.when(parts, F.min(F.when(parts & low.contains("</script") & (F.col("line") >= F.col("_s")), F.col("line"))).over(whole)))
        .withColumn("in_script", F.when(parts, F.coalesce((F.col("line") > F.col("_s")) & (F.col("_e").isNull() | (F.col("line") < F.col("_e"))), F.lit(False))))
        .drop("_s", "_e")
    )


def marks(files: DataFrame, written: bool = False) -> DataFrame:
    """Lines of code that declare or call something, with the declarations of their members: the one pass over source."""
    down = Window.partitionBy(*FILE).orderBy("line")
    past = down.rowsBetween(Window.unboundedPreceding, -1)
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    all_lines = _with_prev(_script_lines(lines(files.filter(F.col("language").isin(P.CODE_LANGUAGES)), written)))
    go = F.col("language") == "go"
    event = F.when(go & F.col("code").startswith("import ("), 1).when(go & F.col("code").startswith(")"), 0)
    state = (
        all_lines.withColumn("go_block", F.coalesce(F.last(event, True).over(past) == 1, F.lit(False)) & ~F.col("code").startswith(")"))
        .withColumn("indent_end", _next_stop(~F.col("blank") & (F.col("indent") == 0)))
        .withColumn("next_code", F.lead("code").over(down)).withColumn("next_block_end", F.lead("block_end").over(down))
    )
    d = _declare(state)
    head = F.when(F.col("typ").isNotNull(), F.struct("line", "end", "typ", "body"))
    by_indent = F.col("language").isin("python", "ruby")
    d = d.withColumn("_h", F.last(head, True).over(upto))
    first_in = Window.partitionBy(*FILE, F.col("_h.line")).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("_body_indent", F.first(F.when(~F.col("blank") & (F.col("line") > F.col("_h.line")), F.col("indent")), True).over(first_in))
    d = d.withColumn("_m_end", _next_stop(~F.col("blank") & ((F.col("indent") == 0) | F.coalesce(F.col("indent") <= F.col("_body_indent"), F.lit(False)))))
    code = F.col("code")
    inside = F.when(
        by_indent, (F.col("line") > F.col("_h.line")) & (F.col("line") <= F.col("_h.end")) & ~F.col("blank") & (F.col("indent") == F.col("_body_indent"))
    ).otherwise(F.col("_h.body") & (F.col("depth") == 1) & (F.col("line") > F.col("_h.line")) & (F.col("line") < F.col("_h.end")) & (code != ""))
    js = dict.fromkeys(P.JS_LANGUAGES)
    method = _by_language(
        {lng: _group(code, r["method"]) for lng, r in P.BRACE.items()} | {lng: _group(code, P.JS["method"]) for lng in js}
        | {"python": _group(code, P.PYTHON["function"]), "ruby": _group(code, P.RUBY["function"])}, _none())
    prop = _by_language(
        {lng: _group(code, r["property"]) for lng, r in P.BRACE.items()} | {lng: _group(code, P.JS["property"]) for lng in js}
        | {"python": _group(code, P.PYTHON["property"]), "go": _group(code, P.GO["field"])}, _none())
    attrs = F.filter(F.transform(F.split(_group(code, P.RUBY["attr"]), ","), lambda s: _strip(s, " :\"'")), lambda s: s != "")
    props = F.when(F.col("language") == "ruby", attrs).when(prop.isNotNull(), F.array(prop))
    inside = F.coalesce(inside, F.lit(False))
    m_after = F.concat_ws(" ", F.substring(F.col("text"), F.instr("text", F.col("method")) + F.length("method"), F.length("text")), F.col("more"))
    callees = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(P.CALL_SITE), 1), lambda s: ~s.isin(P.NOT_CALLS)))
    out = (
        d.withColumn("method", F.when(inside, method)).withColumn("props", F.when(inside & F.col("method").isNull(), props))
        .withColumn("m_after", F.when(F.col("method").isNotNull(), m_after)).withColumn("calls", F.when(F.col("text").contains("("), callees))
        .withColumn("ps_param", F.when((F.col("language") == "powershell") & F.lower("code").startswith("param"), F.concat_ws(" ", "text", "more")))
        .select(
            K, "path", "language", "line", "imp", "typ", "body", "fn", "end", "exp", "after", "ret", "receiver", "method", "props", "m_after", "calls", "ps_param",
            F.when(F.col("method").isNotNull() | F.col("props").isNotNull(), F.col("_h.line")).alias("type_line"),
            F.when(F.col("method").isNotNull() | F.col("props").isNotNull(), F.col("_h.typ")).alias("type_name"),
            F.when(by_indent, F.col("_m_end")).otherwise(F.col("block_end")).alias("m_end"))
    )
    return out.filter("size(imp) > 0 or typ is not null or fn is not null or size(exp) > 0 or method is not null or props is not null"
                      " or size(calls) > 0 or ps_param is not null")


def code_tables(m: DataFrame) -> dict[str, DataFrame]:
    """functions, classes, imports, exports and calls from the marks of code files."""
    no = F.lit(False)
    seq = F.col("line").cast("long").alias("decl_seq")
    braces = ~F.col("language").isin("python", "ruby")
    members = m.filter("method is not null")
    firsts = members.groupBy(K, "path", "type_line", "method").agg(F.min("line").alias("line"))
    # Brace languages keep the first method of a name per type; the others keep all.
    kept = members.filter(~braces).unionByName(members.filter(braces).join(firsts, [K, "path", "type_line", "method", "line"], "left_semi"))
    self_languages = F.col("language").isin([*P.BRACE, *P.JS_LANGUAGES, "python"])
    methods = kept.select(
        K, "path", "language", seq, F.concat_ws(".", "type_name", "method").alias("name"), params_of(F.col("m_after"), self_languages).alias("params"),
        F.when(F.col("language") == "python", F.col("ret")).alias("return_type"), F.col("line").alias("line_start"),
        F.greatest("line", "m_end").alias("line_end"))
    blocks = m.filter("ps_param is not null").select(K, "path", F.col("line").alias("_pl"), F.col("ps_param").alias("_block"))
    ps = (
        m.filter((F.col("language") == "powershell") & F.col("fn").isNotNull())
        .join(blocks, FILE, "left").filter("_pl is null or (_pl >= line and _pl <= end)")
    )
    ps_first = ps.filter("_pl is not null").groupBy(K, "path", "line").agg(F.min_by("_block", "_pl").alias("_pp"))
    own = m.filter("fn is not null").join(ps_first, [K, "path", "line"], "left")
    listed = F.when(F.col("language") == "powershell", F.transform(params_of(F.coalesce("_pp", F.lit("")), no), lambda s: F.regexp_replace(s, r"^\$", ""))).when(
        F.col("after").isNull(), F.array().cast(STRINGS)).otherwise(params_of(F.col("after"), F.col("language") == "python"))
    top = own.select(K, "path", "language", seq, F.col("fn").alias("name"), listed.alias("params"), F.col("ret").alias("return_type"),
                     F.col("line").alias("line_start"), F.greatest("line", "end").alias("line_end"))
    functions = top.unionByName(methods)
    # A type's members are few and stay with their file.
    in_type = kept.select(K, "path", "type_line", F.struct("line", F.lit(0).alias("i"), F.col("method").alias("v")).alias("_m"), _none("struct<line:int,i:int,v:string>").alias("_p")).unionByName(
        m.filter("props is not null").select(K, "path", "type_line", "line", F.posexplode("props").alias("i", "v")).select(
            K, "path", "type_line", _none("struct<line:int,i:int,v:string>").alias("_m"), F.struct("line", "i", "v").alias("_p")))
    lists = in_type.groupBy(K, "path", "type_line").agg(
        F.transform(F.array_sort(F.collect_list("_m")), lambda s: s["v"]).alias("methods"),
        F.transform(F.array_sort(F.collect_list("_p")), lambda s: s["v"]).alias("properties"))
    received = m.filter("receiver is not null").groupBy(K, "path", F.col("receiver").alias("typ")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("line", "fn"))), lambda s: s["fn"]).alias("_go"))
    none = F.array().cast(STRINGS)
    distinct = F.when(F.col("language").isin("python", "ruby", "go"), F.coalesce("properties", none)).otherwise(F.array_distinct(F.coalesce("properties", none)))
    classes = (
        m.filter("typ is not null").withColumn("type_line", F.col("line")).join(lists, [K, "path", "type_line"], "left").join(received, [K, "path", "typ"], "left")
        .select(K, "path", "language", seq, F.col("typ").alias("name"), F.coalesce("_go", "methods", none).alias("methods"), distinct.alias("properties"),
                F.col("line").alias("line_start"), F.greatest("line", "end").alias("line_end"))
    )
    imports = m.filter("size(imp) > 0").select(K, "path", "language", "line", F.posexplode("imp").alias("_i", "_x")).select(
        K, "path", "language", (F.col("line").cast("long") * 1000 + F.col("_i")).alias("decl_seq"), "_x.source", "_x.specifiers", "line")
    shown = m.filter("size(exp) > 0").select(K, "path", "line", F.posexplode("exp").alias("_i", "_x")).select(
        K, "path", F.col("_x.name").alias("name"), F.struct("line", "_i", F.col("_x.is_default").alias("d")).alias("o"))
    exports = shown.groupBy(K, "path", "name").agg(F.min("o").alias("o")).select(K, "path", "name", F.col("o.line").alias("line"), F.col("o.d").alias("is_default"))
    return {"functions": functions, "classes": classes, "imports": imports, "exports": exports, "calls": call_sites(m, functions)}


def call_sites(m: DataFrame, functions: DataFrame) -> DataFrame:
    """First line on which a function calls a name: (repo_id, path, caller, callee, line).

    A function is spread over the lines it covers and meets the lines that have calls by equality.
    """
    covered = functions.select(K, "path", F.col("name").alias("caller"), F.explode(F.sequence("line_start", "line_end")).alias("line"))
    sites = m.filter("size(calls) > 0").select(K, "path", "line", "calls")
    return (
        covered.join(sites, [K, "path", "line"]).select(K, "path", "caller", "line", F.explode("calls").alias("callee"))
        .filter("callee <> caller").groupBy(K, "path", "caller", "callee").agg(F.min("line").alias("line"))
    )


# --- files that are not code ---------------------------------------------------------------------------

SECTION = [K, "path", "decl_seq", "name", "level", "line_start", "line_end"]


def other_lines(files: DataFrame, written: bool = False) -> DataFrame:
    """Lines of documents, configuration, schemas and markup with the windows their rules share."""
    keep = [K, "path", "language", "n", "line", "raw", "code", "blank", "indent", "depth", "block_end", "closes"]
    return _with_prev(lines(files.filter(F.col("language").isin(P.OTHER_LANGUAGES)), written).select(*keep))


def _seq() -> Column:
    return F.col("line").cast("long").alias("decl_seq")


def _section(df: DataFrame, name: Column, level: Column, end: Column) -> DataFrame:
    return df.select(K, "path", _seq(), name.alias("name"), level.cast("int").alias("level"), F.col("line").alias("line_start"), end.cast("int").alias("line_end"))


def _import(df: DataFrame, sources: Column) -> DataFrame:
    return df.select(K, "path", "language", "line", F.posexplode(sources).alias("_i", "source")).select(
        K, "path", "language", (F.col("line").cast("long") * 1000 + F.col("_i")).alias("decl_seq"), "source", F.array().cast(STRINGS).alias("specifiers"), "line")


def _until_next(flag: Column) -> Column:
    """Line before the next flagged line, else the last of the file."""
    up = Window.partitionBy(*FILE).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(F.when(flag, F.col("line")), True).over(up) - 1, F.col("n"))


def markdown(o: DataFrame) -> dict[str, DataFrame]:
    """Nested sections (a heading closes those of its level and below) and local links; fenced text is skipped."""
    md = o.filter(F.col("language").isin("markdown", "restructuredtext", "plaintext"))
    trimmed = _strip(F.col("raw"))
    fence = F.when(trimmed.rlike("^(```|~~~)"), F.left(trimmed, F.lit(1)))
    whole = Window.partitionBy(*FILE)
    # Fence lines of a file are few; one fold says which of them open or close.
    found = F.array_sort(F.collect_list(F.when(F.col("_f").isNotNull(), F.struct("line", F.col("_f").alias("m")))).over(whole))
    start = F.struct(F.lit("").alias("open"), F.array().cast("array<int>").alias("at"))
    toggles = F.aggregate("_fs", start, lambda s, x: F.struct(
        F.when(s["open"] == "", x["m"]).when(s["open"] == x["m"], "").otherwise(s["open"]).alias("open"),
        F.when((s["open"] == "") | (s["open"] == x["m"]), F.concat(s["at"], F.array(x["line"]))).otherwise(s["at"]).alias("at")), lambda s: s["at"])
    flip = F.when(F.col("_f").isNotNull(), F.array_contains(toggles, F.col("line")).cast("int")).otherwise(0)
    upto = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    text = md.withColumn("_f", fence).withColumn("_fs", found).withColumn("_in", F.sum(flip).over(upto) % 2 == 1).filter("_f is null and not _in")
    level = F.length(F.regexp_extract(trimmed, P.MARKDOWN["heading"], 1))
    heads = text.filter(trimmed.rlike(P.MARKDOWN["heading"])).withColumn("level", level)
    up = Window.partitionBy(*FILE).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("n")
    for lv in range(1, 7):
        nxt = F.last(F.when(F.col("level") <= lv, F.col("line")), True).over(up) - 1
        end = F.when(F.col("level") == lv, F.coalesce(nxt, F.col("n"))).otherwise(end)
    links = F.filter(F.regexp_extract_all("raw", F.lit(P.MARKDOWN["link"]), 1), lambda s: ~s.rlike("^(http|#|mailto:)"))
    return {
        "sections": _section(heads.withColumn("_end", end), _strip(F.regexp_extract(trimmed, P.MARKDOWN["heading"], 2)), F.col("level"), F.col("_end")),
        "imports": _import(text.filter(~trimmed.rlike(P.MARKDOWN["heading"])), links),
    }


def yaml(o: DataFrame) -> dict[str, DataFrame]:
    """Top keys as sections; jobs and steps of workflows; services of compose files with image and ports."""
    y = o.filter(F.col("language").isin("yaml", "kubernetes", "github-actions", "openapi", "docker-compose"))
    code, down = F.col("code"), Window.partitionBy(*FILE).orderBy("line")
    upto = down.rowsBetween(Window.unboundedPreceding, 0)
    key = _group(code, P.YAML["key"])
    is_top = (F.col("indent") == 0) & (code != "") & ~code.rlike("^[-#]") & key.isNotNull()
    y = y.withColumn("_key", key).withColumn("_is_top", is_top).withColumn("_top_end", _until_next(F.col("_is_top")))
    sections = _section(y.filter("_is_top"), F.col("_key"), F.lit(1), F.col("_top_end"))
    p = normalize("path")
    flow = y.filter(p.rlike(r"^\.github/workflows/|^\.circleci/|(^|/)\.gitlab-ci\.yml$"))
    flow = flow.withColumn("_jobs", F.coalesce(F.last(F.when((F.col("indent") == 0) & (code != ""), code.startswith("jobs:")), True).over(upto), F.lit(False)))
    flow = flow.withColumn("_job_indent", F.first(F.when(F.col("_jobs") & (F.col("indent") > 0) & (code != ""), F.col("indent")), True).over(upto))
    flow = flow.withColumn("_end", _next_stop(~F.col("blank") & F.coalesce(F.col("indent") <= F.col("_job_indent"), F.lit(False))))
    is_job = F.col("_jobs") & (F.col("indent") == F.col("_job_indent")) & F.col("_key").isNotNull()
    item = F.nullif(_strip(F.regexp_extract("raw", P.YAML["item"], 1)), F.lit(""))
    steps = (
        flow.filter((F.col("indent") > 0) & (code != "")).withColumn("_name", F.when(is_job, F.col("_key")).otherwise(item)).filter("_name is not null")
        .select(K, "path", _seq(), F.col("_name").alias("name"), F.col("line").alias("line_start"), F.when(is_job, F.col("_end")).otherwise(F.col("line")).cast("int").alias("line_end"))
    )
    part = y.filter(basename(p).rlike(r"^(docker-compose|compose\.)"))
    first_services = F.min(F.when(F.col("_is_top") & (F.col("_key") == "services"), F.struct("line", F.col("_top_end").alias("end")))).over(Window.partitionBy(*FILE))
    part = part.withColumn("_s", first_services).withColumn("_in", (F.col("line") > F.col("_s.line")) & (F.col("line") <= F.col("_s.end")) & (code != ""))
    part = part.withColumn("_si", F.first(F.when(F.col("_in") & (F.col("indent") > 0), F.col("indent")), True).over(upto))
    part = part.withColumn("_end", _next_stop(~F.col("blank") & F.coalesce(F.col("indent") <= F.col("_si"), F.lit(False))))
    is_service = F.col("_in") & (F.col("indent") == F.col("_si")) & F.col("_key").isNotNull()
    part = part.withColumn("_svc", F.last(F.when(is_service, F.struct("line", F.col("_end").alias("end"), F.col("_key").alias("name"))), True).over(upto))
    part = part.filter(F.col("_svc").isNotNull() & (F.col("line") <= F.col("_svc.end")))
    last = F.last(F.when((code != "") & ~code.startswith("-"), code.startswith("ports:")), True).over(
        Window.partitionBy(*FILE, F.col("_svc.line")).orderBy("line").rowsBetween(Window.unboundedPreceding, 0))
    image = F.when(code.startswith("image:"), F.nullif(_strip(F.substring(code, 7, 1_000_000), " \"'"), F.lit("")))
    ports = F.when(F.col("_ports") & code.startswith("-"), F.regexp_extract_all("code", F.lit(r"(\d{2,5})"), 1))
    services = (
        part.withColumn("_ports", F.coalesce(last, F.lit(False))).withColumn("_image", image).withColumn("_pp", ports)
        .groupBy(K, "path", F.col("_svc.line").alias("line_start"), F.col("_svc.end").alias("line_end"), F.col("_svc.name").alias("name"))
        .agg(F.min_by("_image", F.when(F.col("_image").isNotNull(), F.col("line"))).alias("image"), F.flatten(F.collect_list("_pp")).alias("_pp"))
        .select(K, "path", F.col("line_start").cast("long").alias("decl_seq"), "name", "image",
                F.sort_array(F.array_distinct(F.col("_pp").cast("array<int>"))).alias("ports"), "line_start", F.col("line_end").cast("int").alias("line_end"))
    )
    return {"sections": sections, "steps": steps, "services": services}


def json(o: DataFrame) -> dict[str, DataFrame]:
    """Keys one level deep and references to other files."""
    j = o.filter(F.col("language").isin("json", "jsonc", "json-schema"))
    key = _group(F.col("code"), P.JSON["key"])
    ref = _group(F.col("raw"), P.JSON["ref"])
    return {
        "sections": _section(j.filter((F.col("depth") == 1) & key.isNotNull()), key, F.lit(1), F.col("block_end")),
        "imports": _import(j.filter(F.col("depth") != 1), F.when(ref.isNotNull() & ~ref.startswith("#"), F.array(ref))),
    }


def toml(o: DataFrame) -> dict[str, DataFrame]:
    t = o.filter("language = 'toml'")
    name = _group(F.col("code"), P.TOML_TABLE, 2)
    shown = F.when(F.regexp_extract("code", P.TOML_TABLE, 1) == "[", F.concat(F.lit("[["), name, F.lit("]]"))).otherwise(name)
    t = t.withColumn("_name", shown).withColumn("_end", _until_next(F.col("_name").isNotNull()))
    level = F.size(F.filter(F.split("_name", r"\."), lambda s: s != ""))
    return {"sections": _section(t.filter("_name is not null"), F.col("_name"), level, F.col("_end"))}


def _definition(df: DataFrame, name: Column, kind: Column | str, end: Column, fields: Column | None = None) -> DataFrame:
    k = F.lit(kind) if isinstance(kind, str) else kind
    return df.select(K, "path", _seq(), name.alias("name"), k.alias("kind"), (fields if fields is not None else F.array().cast(STRINGS)).alias("fields"),
                     F.col("line").alias("line_start"), end.cast("int").alias("line_end"))


def env(o: DataFrame) -> dict[str, DataFrame]:
    e = o.filter(F.col("language").isin("env", "config", "properties"))
    line = _strip(F.col("raw"))
    name = F.when(~line.startswith("#"), _group(line, P.ENV_NAME))
    return {"definitions": _definition(e.filter(name.isNotNull()), name, "variable", F.col("line"))}


def dockerfile(o: DataFrame) -> dict[str, DataFrame]:
    """Build stages as services with the ports they expose; directives as steps."""
    d = o.filter("language = 'dockerfile'")
    code = F.col("code")
    image, alias = _group(code, P.DOCKER["from"]), _group(code, P.DOCKER["from"], 2)
    plain = F.substring_index(F.substring_index(image, ":", 1), "/", -1)
    d = d.withColumn("_image", image).withColumn("_name", F.coalesce(alias, plain)).withColumn("_end", _until_next(F.col("_image").isNotNull()))
    upto = Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    stage = F.last(F.when(F.col("_image").isNotNull(), F.struct("line", F.col("_end").alias("end"), F.col("_name").alias("name"), F.col("_image").alias("image"))), True).over(upto)
    opened = F.filter(F.transform(F.split(F.regexp_extract("code", P.DOCKER["expose"], 1), r"[ \t]+"), lambda s: F.substring_index(s, "/", 1)), lambda s: s.rlike(r"^[+-]?\d+$"))
    services = (
        d.withColumn("_stage", stage).filter("_stage is not null")
        .groupBy(K, "path", F.col("_stage.line").alias("line_start"), F.col("_stage.end").alias("line_end"), F.col("_stage.name").alias("name"), F.col("_stage.image").alias("image"))
        .agg(F.flatten(F.collect_list(opened)).alias("_p"))
        .select(K, "path", F.col("line_start").cast("long").alias("decl_seq"), "name", "image", F.sort_array(F.array_distinct(F.col("_p").cast("array<int>"))).alias("ports"),
                "line_start", F.col("line_end").cast("int").alias("line_end"))
    )
    text = F.concat_ws(" ", F.upper(F.regexp_extract("code", P.DOCKER["step"], 1)), _strip(F.regexp_extract("code", P.DOCKER["step"], 2)))
    steps = d.filter(code.rlike(P.DOCKER["step"])).select(K, "path", _seq(), text.alias("name"), F.col("line").alias("line_start"), F.col("line").alias("line_end"))
    return {"services": services, "steps": steps}


def _in_block(df: DataFrame, head: Column) -> DataFrame:
    """``_b``: the last header at or above each line."""
    return df.withColumn("_b", F.last(head, True).over(Window.partitionBy(*FILE).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)))


def _field_lists(df: DataFrame, fields: Column) -> DataFrame:
    """Names found below each header, in order: (repo_id, path, line, fields)."""
    return (
        df.withColumn("_f", fields).filter("_f is not null").groupBy(K, "path", F.col("_b.line").alias("line"))
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("line").alias("l"), F.col("_f").alias("f")))), lambda s: s["f"]).alias("fields"))
    )


def sql(o: DataFrame) -> dict[str, DataFrame]:
    """Tables with columns, views, indexes; altered tables as imports. The first of a name counts."""
    s = o.filter("language = 'sql'")
    code = F.col("code")
    kind, name = _none(), _none()
    for k in ("alter", "index", "view", "table"):
        found = _group(code, P.SQL[k])
        kind, name = F.when(found.isNotNull(), k).otherwise(kind), F.coalesce(found, name)
    up = Window.partitionBy(*FILE).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.last(F.when(code.contains(";"), F.col("line")), True).over(up)
    # A statement ends with its semicolon or before the next one; without both a table ends where its parenthesis does.
    s = s.withColumn("_k", kind).withColumn("_n", name)
    below = Window.partitionBy(*FILE).orderBy(F.desc("line")).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_k").isNotNull(), F.col("line")), True).over(below) - 1
    s = s.withColumn("_stop", stop).withColumn("_last", last)
    unended = F.greatest(F.col("line"), F.least(F.coalesce(F.when(F.col("_k") == "table", F.col("closes")), F.col("n")), F.col("_last")))
    s = s.withColumn("_end", F.when(F.col("_stop") <= F.coalesce("_last", "n"), F.col("_stop")).otherwise(unended))
    first = s.filter("_k is not null").groupBy(K, "path", "_k", "_n").agg(F.min("line").alias("line"))
    heads = s.filter("_k is not null").join(first, [K, "path", "_k", "_n", "line"], "left_semi")
    below = _in_block(s, F.when(F.col("_k").isNotNull(), F.struct("line", F.col("_end").alias("end"), F.col("_k").alias("k"))))
    word = F.regexp_extract(_strip(code, " \t,()"), r"^[^ \t(]+", 0)
    column = F.when((word != "") & ~F.lower(word).isin(P.SQL_CONSTRAINTS), _strip(word, "`\"[];,()"))
    inside = below.filter((F.col("_b.k") == "table") & (F.col("line") > F.col("_b.line")) & (F.col("line") <= F.col("_b.end")))
    columns = _field_lists(inside, F.when(column.rlike(r"^[\p{L}_]"), column))
    defs = heads.filter("_k <> 'alter'").join(columns, [K, "path", "line"], "left")
    return {
        "definitions": _definition(defs, F.col("_n"), F.col("_k"), F.when(F.col("_k") == "index", F.col("line")).otherwise(F.col("_end")),
                                   F.coalesce("fields", F.array().cast(STRINGS))),
        "imports": _import(heads.filter("_k = 'alter'"), F.array(F.concat(F.lit("table:"), "_n"))),
    }


def _endpoint(df: DataFrame, method: Column, endpoint: Column) -> DataFrame:
    return df.select(K, "path", _seq(), method.alias("method"), endpoint.alias("endpoint"), F.col("line").alias("line_start"), F.col("line").alias("line_end"))


def graphql(o: DataFrame) -> dict[str, DataFrame]:
    g = o.filter("language = 'graphql'")
    code = F.col("code")
    name = F.when(F.col("depth") == 0, _group(code, P.GRAPHQL["type"], 2))
    end = F.when(code.contains("{"), F.col("block_end")).otherwise(F.col("line"))
    g = g.withColumn("_n", name).withColumn("_k", _group(code, P.GRAPHQL["type"])).withColumn("_end", end)
    b = _in_block(g, F.when(F.col("_n").isNotNull(), F.struct("line", F.col("_end").alias("end"), F.col("_n").alias("n"))))
    inside = b.filter((F.col("line") > F.col("_b.line")) & (F.col("line") < F.col("_b.end")) & (F.col("depth") == 1))
    field = _group(code, P.GRAPHQL["field"])
    root = F.col("_b.n").isin(P.GRAPHQL_ROOTS)
    defs = g.filter(F.col("_n").isNotNull() & ~F.col("_n").isin(P.GRAPHQL_ROOTS)).join(_field_lists(inside.filter(~root), field), [K, "path", "line"], "left")
    return {
        "definitions": _definition(defs, F.col("_n"), F.col("_k"), F.col("_end"), F.coalesce("fields", F.array().cast(STRINGS))),
        "endpoints": _endpoint(inside.filter(root & field.isNotNull()), F.col("_b.n"), field),
    }


def protobuf(o: DataFrame) -> dict[str, DataFrame]:
    p = o.filter("language = 'protobuf'")
    code, top = F.col("code"), F.col("depth") == 0
    p = p.withColumn("_imp", F.when(top, _group(code, P.PROTO["import"])))
    kind, name = _none(), _none()
    for k in ("service", "enum", "message"):
        found = F.when(top & F.col("_imp").isNull(), _group(code, P.PROTO[k]))
        kind, name = F.when(found.isNotNull(), k).otherwise(kind), F.coalesce(found, name)
    p = p.withColumn("_k", kind).withColumn("_n", name)
    b = _in_block(p, F.when(F.col("_k").isNotNull(), F.struct("line", F.col("block_end").alias("end"), F.col("_k").alias("k"), F.col("_n").alias("n"))))
    inside = b.filter((F.col("line") > F.col("_b.line")) & (F.col("line") < F.col("_b.end")))
    field = F.when(F.col("_b.k") == "message", _group(code, P.PROTO["field"])).when(F.col("_b.k") == "enum", _group(code, P.PROTO["value"]))
    rpc = F.when(F.col("_b.k") == "service", _group(code, P.PROTO["rpc"]))
    defs = p.filter("_k in ('message', 'enum')").join(_field_lists(inside.filter("depth = 1"), field), [K, "path", "line"], "left")
    return {
        "imports": _import(p.filter("_imp is not null"), F.array("_imp")),
        "definitions": _definition(defs, F.col("_n"), F.col("_k"), F.col("block_end"), F.coalesce("fields", F.array().cast(STRINGS))),
        "endpoints": _endpoint(inside.filter(rpc.isNotNull()), F.lit("rpc"), F.concat_ws(".", "_b.n", rpc)),
    }


def terraform(o: DataFrame) -> dict[str, DataFrame]:
    t = o.filter("language = 'terraform' and depth = 0")
    code = F.col("code")
    res, res_name = _group(code, P.TERRAFORM["resource"]), _group(code, P.TERRAFORM["resource"], 2)
    dat, dat_name = _group(code, P.TERRAFORM["data"]), _group(code, P.TERRAFORM["data"], 2)
    mod = _group(code, P.TERRAFORM["module"])
    kind = F.coalesce(res, F.concat(F.lit("data."), dat), F.when(mod.isNotNull(), "module"))
    name = F.coalesce(F.when(res.isNotNull(), F.concat_ws(".", res, res_name)),
                      F.when(dat.isNotNull(), F.concat_ws(".", F.lit("data"), dat, dat_name)), F.concat(F.lit("module."), mod))
    var, out = _group(code, P.TERRAFORM["variable"]), _group(code, P.TERRAFORM["output"])
    return {
        "resources": t.filter(kind.isNotNull()).select(K, "path", _seq(), name.alias("name"), kind.alias("kind"), F.col("line").alias("line_start"), F.col("block_end").cast("int").alias("line_end")),
        "definitions": _definition(t.filter(kind.isNull() & F.coalesce(var, out).isNotNull()), F.coalesce(var, out), F.when(var.isNotNull(), "variable").otherwise("output"), F.col("block_end")),
    }


def makefile(o: DataFrame) -> dict[str, DataFrame]:
    m = o.filter("language = 'makefile'")
    code, raw = F.col("code"), F.col("raw")
    m = m.withColumn("_end", _next_stop(~F.col("blank") & ~raw.rlike(r"^(\t|  )")))
    name = F.when(~raw.rlike(r"^[\t ]") & ~code.contains(":=") & ~code.contains("?="), _group(code, P.MAKE_TARGET))
    return {"steps": m.filter(name.isNotNull() & ~name.startswith(".")).select(
        K, "path", _seq(), name.alias("name"), F.col("line").alias("line_start"), F.col("_end").cast("int").alias("line_end"))}


def markup(o: DataFrame) -> dict[str, DataFrame]:
    """Landmarks and assets of HTML, rules and imports of CSS."""
    h = o.filter((F.col("language") == "html") & (F.col("code") != ""))
    assets = F.filter(F.regexp_extract_all("raw", F.lit(P.HTML["asset"]), 1), lambda s: ~s.rlike("^(http|//|#|data:)"))
    tag, ident = _group(F.col("raw"), P.HTML["landmark"]), _group(F.col("raw"), P.HTML["landmark"], 2)
    c = o.filter((F.col("language") == "css") & (F.col("code") != ""))
    css_import = _group(F.col("code"), P.HTML["css_import"])
    rule = F.when(css_import.isNull() & (F.col("depth") == 0), _group(F.col("code"), P.HTML["css_rule"]))
    return {
        "imports": _import(h, assets).unionByName(_import(c.filter(css_import.isNotNull()), F.array(css_import))),
        "sections": _section(h.filter(tag.isNotNull()), F.concat_ws("#", tag, ident), F.lit(1), F.col("line")).unionByName(
            _section(c.filter(rule.isNotNull()), _strip(rule), F.lit(1), F.col("block_end"))),
    }


# --- everything ------------------------------------------------------------------------------------------

SCHEMAS = {
    "sections": "repo_id long, path string, decl_seq long, name string, level int, line_start int, line_end int",
    "definitions": "repo_id long, path string, decl_seq long, name string, kind string, fields array<string>, line_start int, line_end int",
    "services": "repo_id long, path string, decl_seq long, name string, image string, ports array<int>, line_start int, line_end int",
    "endpoints": "repo_id long, path string, decl_seq long, method string, endpoint string, line_start int, line_end int",
    "steps": "repo_id long, path string, decl_seq long, name string, line_start int, line_end int",
    "resources": "repo_id long, path string, decl_seq long, name string, kind string, line_start int, line_end int",
}
PACKS = [markdown, yaml, json, toml, env, dockerfile, sql, graphql, protobuf, terraform, makefile, markup]


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """All declaration tables of ``files(repo_id, path, language, content)``.

    Source text is written once, and read from there twice: once for code, once for the rest. Both results - the declaring
    lines, far fewer than the lines - are written to the checkpoint folder, and every table is derived from there. Files of
    languages without rules simply appear in none of the tables.
    """
    # Filtered only then: a filter on the language would be worked out where the rows are read, which may be one task.
    laid = cut(files.select(K, "path", "language", "content"))
    tables = code_tables(cut(marks(laid, written=True)))
    o = cut(other_lines(laid, written=True))
    found: dict[str, list[DataFrame]] = {}
    for pack in PACKS:
        for kind, df in pack(o).items():
            found.setdefault(kind, []).append(df)
    tables["imports"] = reduce(DataFrame.unionByName, [tables["imports"], *found.pop("imports")])
    for kind in SCHEMAS:
        tables[kind] = reduce(DataFrame.unionByName, found[kind])
    return tables


def has_structure(language: Column) -> Column:
    """Whether any rules exist for a language."""
    return lookup(language, P.SYNTAX_OF).isNotNull()


def inspect(tables: dict[str, DataFrame], repo_id: int, path: str) -> dict[str, DataFrame]:
    """Every declaration, and the resolved imports if given, of one file."""
    return {name: df.filter((F.col(K) == repo_id) & (F.col("path") == path)) for name, df in tables.items() if "path" in df.columns}
