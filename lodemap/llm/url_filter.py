"""URL filters: a weighted vocabulary found by an Aho-Corasick automaton, with boundary checks, below host and path rules."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodemap.llm.common import LOWER, arrow_map, batch, table

#: One of these in a url rejects it.
STRICT = ["casino", "porn", "xxx", "viagra", "escort", "sexcam", "jackpot", "betting"]
#: Two different ones of these reject it.
SOFT = ["ads", "track", "win", "free", "bonus", "click", "promo", "cheap", "adult", "poker", "slots", "loan", "pills", "download"]
#: (host and path, verdict)
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()),
    ("n_strict", pa.int64()), ("n_soft", pa.int64()),
])


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path); both empty for null or a url without ``://``."""
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host, rest = (rest[: min(ends)], rest[min(ends) :]) if ends else (rest, "")
    path = rest.split("?", 1)[0].split("#", 1)[0]
    return host.encode("utf-8", "surrogatepass").translate(LOWER).decode("utf-8", "surrogatepass"), path


class Rules:
    """The longest rule that fits: found by stepping through a host's own suffixes, so cost doesn't grow with the rules."""

    def __init__(self, rules: Sequence[tuple[str, str]]):
        self.of: dict[str, list[tuple[str, str, str]]] = {}
        for rule, verdict in rules:
            host, _, path = rule.partition("/")
            self.of.setdefault(host, []).append(("/" + path, rule, verdict))

    def find(self, host: str, path: str) -> tuple[str | None, str | None]:
        best: tuple[str | None, str | None] = (None, None)
        while host:
            for start, rule, verdict in self.of.get(host, ()):
                if path.startswith(start) and (best[0] is None or len(rule) > len(best[0])):
                    best = (rule, verdict)
            host = host.partition(".")[2]
        return best


class Vocabulary:
    """Distinct strict and soft terms of a url. A term counts where neither neighbour is a letter or digit."""

    def __init__(self, strict: Sequence[str], soft: Sequence[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for kind, terms in ((0, soft), (1, strict)):
            for term in terms:
                self.automaton.add_word(term, (kind, term))
        self.empty = not len(self.automaton)
        if not self.empty:
            self.automaton.make_automaton()

    def count(self, url: str | None) -> tuple[int, int]:
        if not url or self.empty:
            return 0, 0
        low, found = url.lower() if url.isascii() else "".join(c.lower() if c.isascii() else c for c in url), set()
        for end, (kind, term) in self.automaton.iter(low):
            before, after = end - len(term), end + 1
            if (before < 0 or not low[before].isalnum()) and (after >= len(low) or not low[after].isalnum()):
                found.add((kind, term))
        strict = sum(k for k, _ in found)
        return strict, len(found) - strict


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, strict: Sequence[str] = STRICT, soft: Sequence[str] = SOFT,
               soft_hits: int = 2, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, n_strict, n_soft.

    The longest fitting rule decides; without one, one strict term or ``soft_hits`` different soft terms block. Null,
    empty or odd urls have empty host and path, no rule, and are judged by their terms (none: allow). Repeated rows are
    judged one by one, other columns are ignored, no rows give no rows.
    """
    made: list = []

    def judge(rows: pa.RecordBatch) -> pa.RecordBatch:
        if not made:
            made.extend((Rules(rules), Vocabulary(strict, soft)))
        out: dict[str, list] = {f: [] for f in SCHEMA.names[1:]}
        for url in rows.column(1).to_pylist():
            host, path = split_url(url)
            rule, verdict = made[0].find(host, path)
            n_strict, n_soft = made[1].count(url)
            verdict = verdict or ("block" if n_strict or n_soft >= soft_hits else "allow")
            for key, value in zip(out, (host, path, rule, verdict, n_strict, n_soft), strict=True):
                out[key].append(value)
        return batch(SCHEMA, page_id=rows.column(0), **out)

    picked = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"))
    return arrow_map(picked, judge, "page_id long, host string, path string, rule string, verdict string, n_strict long, n_soft long")


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _hits(terms: Sequence[str]) -> str:
    one = "CAST(regexp_matches(low, '(^|[^\\p{{L}}\\p{{N}}]){0}($|[^\\p{{L}}\\p{{N}}])') AS BIGINT)"
    return " + ".join(one.format(t) for t in terms)


def _fits(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"


def oracle() -> str:
    longest = sorted(RULES, key=lambda r: -len(r[0]))
    rule = " ".join(f"WHEN {_fits(r)} THEN '{r}'" for r, _ in longest)
    verdict = " ".join(f"WHEN rule = '{r}' THEN '{v}'" for r, v in RULES)
    ascii_low = "translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH cut AS (
  SELECT page_id, {ascii_low} AS low,
         CASE WHEN url IS NOT NULL AND contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, low, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), hits AS (
  SELECT page_id, host, path, CASE {rule} END AS rule,
         CASE WHEN low IS NULL THEN 0 ELSE {_hits(STRICT)} END AS n_strict, CASE WHEN low IS NULL THEN 0 ELSE {_hits(SOFT)} END AS n_soft FROM parts
)
SELECT page_id, host, path, rule, CASE {verdict} WHEN n_strict > 0 OR n_soft >= 2 THEN 'block' ELSE 'allow' END AS verdict,
       CAST(n_strict AS BIGINT) AS n_strict, CAST(n_soft AS BIGINT) AS n_soft
FROM hits"""


QUERIES = {"op4_url_filter": (op4_url_filter, oracle())}
