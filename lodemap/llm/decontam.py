"""Benchmark decontamination by winnowing: fingerprints of both sides are joined, hits are extended word by word."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodemap.llm.common import ALNUM, arrow_map, batch, bit_table, blocks, cut, gram_hashes, in_table, mix, table, word_hashes

SPAN = 10
GRAM = 5

_ITEM = pa.schema([("len", pa.int32()), ("hash", pa.int64()), ("item_id", pa.int64()), ("item_left", pa.int32()), ("item_words", pa.string())])
_SEED = pa.struct([("len", pa.int32()), ("hash", pa.int64()), ("pos", pa.int64()), ("left", pa.int32()), ("words", pa.string())])
_DOC = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("seeds", pa.list_(_SEED))])
_SPAN = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("item_id", pa.int64()), ("s", pa.int64()), ("e", pa.int64())])


def winnow(words: np.ndarray, counts: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the grams kept: the smallest of every ``span - gram + 1`` neighbours in one text, the last of equals.

    Any ``span`` words that two texts share hold such a full set of neighbours, so both texts keep the same gram of it.
    """
    grams = gram_hashes(words, gram)
    window = span - gram + 1
    n = len(grams) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low, at = grams[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, window):
        here = grams[j : j + n]
        less = here <= low
        low[less] = here[less]
        at[less] = j
    text = np.repeat(np.arange(len(counts)), counts)
    kept = np.unique((at + np.arange(n))[text[:n] == text[span - 1 : span - 1 + n]])
    return kept, grams[kept]


def _with_length(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(hashes + np.uint64(length))


def _around(words: list[bytes], pos: int, gram: int, span: int) -> tuple[int, str]:
    """Words from ``span - gram`` before a gram to as many after it, with the number of those before."""
    left = min(pos, span - gram)
    return left, b" ".join(words[pos - left : pos + span]).decode()


def item_seeds(benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Winnowed grams of every item with the words around them; an item of fewer words than ``span`` is one whole gram."""

    def seeds(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f: [] for f in _ITEM.names}
        for item, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            raw = (text or "").encode()
            words = raw.translate(ALNUM).split()
            if not words:
                continue
            hashes, counts = word_hashes([raw], ALNUM)
            length = min(span, len(words))
            if length < span:
                at, h, size = np.zeros(1, np.int64), gram_hashes(hashes, length), length
            else:
                (at, h), size = winnow(hashes, counts, span, gram), gram
            for pos, x in zip(at.tolist(), _with_length(h, length).view(np.int64).tolist(), strict=True):
                left, around = _around(words, pos, size, length)
                for name, value in zip(_ITEM.names, (length, x, item, left, around), strict=True):
                    out[name].append(value)
        return batch(_ITEM, **out)

    picked = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    return arrow_map(picked, seeds, "len int, hash long, item_id long, item_left int, item_words string").distinct()


def _probes(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = hashes.view(np.uint64)
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def seed_filter(items: DataFrame, n_items: int, max_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of the items' hashes: about 64 bits for each, 8 MB at most. It only spares work; the join decides."""
    bits = min(max_bits, max(1 << 16, 1 << math.ceil(math.log2(64 * max(1, n_items)))))
    slots = F.array(F.col("hash").bitwiseAND(bits - 1), F.shiftrightunsigned("hash", 32).bitwiseAND(bits - 1))
    return bit_table(items.select(F.explode(slots).alias("slot")), bits)


def _in_filter(flags: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    a, b = _probes(hashes, len(flags) * 8)
    return in_table(flags, a) & in_table(flags, b)


def doc_seeds(docs: DataFrame, flags, lengths: list[int], span: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """Per row: number of words, and its grams that the filter lets through with the words around them."""

    def seeds(rows: pa.RecordBatch) -> pa.RecordBatch:
        held = flags.value
        texts = rows.column(2).to_pylist()
        n_words, found = [0] * len(texts), [[] for _ in texts]
        for first, raws in blocks(texts):
            hashes, counts = word_hashes(raws, ALNUM)
            tops = np.cumsum(counts)
            words_of: dict[int, list[bytes]] = {}
            for i, n in enumerate(counts.tolist()):
                n_words[first + i] = n
            text = np.repeat(np.arange(len(counts)), counts)
            for length in lengths:
                if length < span:
                    h = gram_hashes(hashes, length)
                    at = np.flatnonzero(text[: len(h)] == text[length - 1 :]) if len(h) else np.zeros(0, np.int64)
                    h, size = h[at], length
                else:
                    (at, h), size = winnow(hashes, counts, span, gram), gram
                h = _with_length(h, length)
                ok = _in_filter(held, h)
                for pos, x in zip(at[ok].tolist(), h[ok].view(np.int64).tolist(), strict=True):
                    i = int(text[pos])
                    if i not in words_of:
                        words_of[i] = raws[i].translate(ALNUM).split()
                    own = pos - int(tops[i] - counts[i])
                    left, around = _around(words_of[i], own, size, length)
                    found[first + i].append({"len": length, "hash": x, "pos": own, "left": left, "words": around})
        return batch(_DOC, doc_id=rows.column(0), key=rows.column(1), n_words=n_words, seeds=found)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    picked = picked.select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    return arrow_map(picked, seeds, "doc_id long, key long, n_words long, seeds array<struct<len:int,hash:long,pos:long,left:int,words:string>>")


def extend(pairs: DataFrame, span: int, gram: int) -> DataFrame:
    """Spans of document words: each pair of grams is compared word by word and grown to both sides."""

    def grow(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f: [] for f in _SPAN.names}
        for r in rows.to_pylist():
            a, b = r["words"].split(" "), r["item_words"].split(" ")
            i, j, size = r["left"], r["item_left"], gram if r["len"] == span else r["len"]
            if a[i : i + size] != b[j : j + size]:
                continue
            before = after = 0
            while before < min(i, j) and a[i - before - 1] == b[j - before - 1]:
                before += 1
            while i + size + after < len(a) and j + size + after < len(b) and a[i + size + after] == b[j + size + after]:
                after += 1
            if before + size + after >= r["len"]:
                for name, value in zip(_SPAN.names, (r["doc_id"], r["key"], r["item_id"], r["pos"] - before, r["pos"] + size + after), strict=True):
                    out[name].append(value)
        return batch(_SPAN, **out)

    return arrow_map(pairs, grow, "doc_id long, key long, item_id long, s long, e long").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, key, n_words, n_hit, n_items, items (sorted as strings), contaminated.

    Words are runs of digits, a-z (after lower-casing A-Z) and characters over U+007F. A document word is hit where it lies
    in ``span`` consecutive words of an item (all words of a shorter item). Null and empty texts have no words and no hits;
    null ids stay; repeated rows each get the same answer (rows are told apart by id and text); an item without an id hits
    but isn't counted; an empty benchmark hits nothing; no documents give no rows.
    """
    spark = docs.sparkSession
    items = cut(item_seeds(benchmark, span, gram, item_col, item_text_col))
    sizes = {r["len"]: r["n"] for r in items.groupBy("len").agg(F.count("*").alias("n")).collect()}  # at most ``span`` rows
    flags = spark.sparkContext.broadcast(seed_filter(items, sum(sizes.values())))
    seen = cut(doc_seeds(docs, flags, sorted(sizes), span, gram, id_col, text_col))
    flags.destroy()
    seeds = seen.filter(F.size("seeds") > 0).select("doc_id", "key", F.explode("seeds").alias("x")).select("doc_id", "key", "x.*")
    spans = cut(extend(seeds.join(items, ["len", "hash"]), span, gram))
    before = Window.partitionBy("doc_id", "key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    new = F.col("e") - F.greatest("s", F.coalesce(F.max("e").over(before), F.col("s")))
    hit = (
        spans.groupBy("doc_id", "key", "s").agg(F.max("e").alias("e")).withColumn("new", F.greatest(new, F.lit(0)))
        .groupBy("doc_id", "key").agg(F.sum("new").alias("n_hit"))
    )
    # At most one entry per distinct item that occurs in one document.
    which = spans.groupBy("doc_id", "key").agg(F.array_sort(F.transform(F.collect_set("item_id"), lambda x: x.cast("string"))).alias("items"))
    found = hit.join(which, hit["doc_id"].eqNullSafe(which["doc_id"]) & (hit["key"] == which["key"])).select(hit["doc_id"], hit["key"], "n_hit", "items")
    return (
        seen.join(found, seen["doc_id"].eqNullSafe(found["doc_id"]) & (seen["key"] == found["key"]), "left")
        .select(
            seen["doc_id"], seen["key"], "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
            F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
            F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce(F.col("n_hit") > 0, F.lit(False)).alias("contaminated"),
        )
    )


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(text, '{_UP}', '{_LOW}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item_id, w, least(len(w), {SPAN}) AS n FROM b WHERE len(w) > 0),
windows AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)
),
dw AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS x
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows))
),
hits AS (SELECT doc_id, i, n, item_id FROM dw JOIN windows USING (n, x)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(v, ',' ORDER BY v) AS s
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS v FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""

QUERIES = {"op3_decontaminate": (op3_decontaminate, ORACLE)}
