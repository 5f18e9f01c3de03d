"""Filter interaction audit by truth-table survival words and carry-save positional popcounts.

A document's failures of the five filters are five bits. They give a 32-bit word whose bit S says that the document survives
the subset S of filters. Summing every bit position over the words of one part and label gives the survivors of all 32
subsets at once, and these answer every question about orders: a filter removes what survives the filters before it, less
what survives them and itself.

Words are summed by carry-save adders: three words of one weight become one of that weight and one of double weight, until
at most two of each weight are left, so that only a few words are ever taken apart into bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import arrow_map, batch, cut, table

FILTERS = "ABCDE"
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
MARKS = b"#$%&*|"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"

_N = 1 << len(FILTERS)
_ALL = _N - 1
#: Survival word of each set of failed filters.
WORDS = np.array([sum(1 << s for s in range(_N) if not s & failed) for failed in range(_N)], np.uint32)
#: Groups of more words than this go through adders; the bits of smaller ones are added up directly.
_ADDERS = 64
#: (part, label) groups that a task holds before it hands them on.
_HELD = 20_000


def own_failures(text: str | None) -> int:
    """Failed filters A to D of one whole text, as bits."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    few = len(words) < LEAST_WORDS
    alike = 100 * len(set(words)) < DISTINCT_PERCENT * len(words)
    loud = 100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)
    marked = len(raw) != len(raw.translate(None, MARKS))
    return few | alike << 1 | loud << 2 | marked << 3


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many of ``words`` have each of the 32 bits."""
    out = np.zeros(32, np.int64)
    weight, level = 1, words
    while len(level):
        carried = []
        while len(level) >= 3:
            n = len(level) // 3
            a, b, c, rest = level[:n], level[n : 2 * n], level[2 * n : 3 * n], level[3 * n :]
            either = a ^ b
            carried.append((a & b) | (either & c))
            level = np.concatenate([either ^ c, rest])
        out += weight * _bits(level).sum(0)
        weight, level = 2 * weight, np.concatenate(carried) if carried else level[:0]
    return out


def _bits(words: np.ndarray) -> np.ndarray:
    return np.unpackbits(words.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little").astype(np.int64)


def grouped_popcounts(groups: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct groups, their positional popcounts)."""
    order = np.argsort(groups, kind="stable")
    groups, words = groups[order], words[order]
    found, starts, sizes = np.unique(groups, return_index=True, return_counts=True)
    out = np.zeros((len(found), 32), np.int64)
    large = sizes > _ADDERS
    for i in np.flatnonzero(large):
        out[i] = positional_popcount(words[starts[i] : starts[i] + sizes[i]])
    if not large.all():
        small = np.repeat(~large, sizes)
        begin = np.cumsum(sizes[~large]) - sizes[~large]
        out[~large] = np.add.reduceat(_bits(words[small]), begin, axis=0)
    return found, out


_JUDGED = pa.schema([("doc_id", pa.int64()), ("part", pa.string()), ("failed", pa.int8()), ("digest", pa.binary())])
_COUNTS = pa.schema([("part", pa.string()), ("good", pa.bool_()), ("toxic", pa.bool_()), ("survivors", pa.list_(pa.int64()))])


def judged(docs: DataFrame, id_col: str, text_col: str, part_col: str) -> DataFrame:
    """doc_id, part, failed filters A to D and a 128-bit digest of the text of every row."""

    def judge(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(2).to_pylist()
        digests = [blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
        return batch(_JUDGED, doc_id=rows.column(0), part=rows.column(1), failed=[own_failures(t) for t in texts], digest=digests)

    picked = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"),
        docs[text_col].cast("string").alias("text"),
    )
    return arrow_map(picked, judge, "doc_id long, part string, failed byte, digest binary")


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source",
             label_id_col: str = "doc_id", quality_col: str = "quality", toxic_col: str = "toxic") -> DataFrame:
    """One row per row of ``docs``: doc_id, part, failed (bits of A to E), good, toxic.

    E compares digests of 128 bits. Which document is the first of its text is found per digest, counted on the map side;
    rows then meet that answer and their label by their own id, so copies never gather under one text.
    """
    seen = cut(judged(docs, id_col, text_col, part_col))
    named = seen.filter("doc_id IS NOT NULL")
    firsts = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    # Labels of one document may lie on several rows.
    marks = (
        labels.select(labels[label_id_col].cast("long").alias("doc_id"), (labels[quality_col] == 1).alias("g"), (labels[toxic_col] == 1).alias("t"))
        .filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.coalesce(F.max("g"), F.lit(False)).alias("good"), F.coalesce(F.max("t"), F.lit(False)).alias("toxic"))
    )
    late = F.when(F.col("first").isNull(), 1 << FILTERS.index("E")).otherwise(0)
    joined = (
        named.join(firsts, ["doc_id", "digest"], "left").join(marks, "doc_id", "left")
        .select("doc_id", "part", (F.col("failed") + late).cast("byte").alias("failed"), F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    )
    # Rows without an id have no label and are nobody's copy; they never go through the joins.
    rest = seen.filter("doc_id IS NULL").select("doc_id", "part", "failed", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return joined.unionByName(rest)


def survivors(failed: DataFrame) -> DataFrame:
    """(part, subset, kept, good, toxic) for all 32 subsets of every part: documents that pass all filters of the subset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            part, good, toxic = zip(*held, strict=True)
            return batch(_COUNTS, part=part, good=good, toxic=toxic, survivors=[c.tolist() for c in held.values()])

        for rows in batches:
            if not rows.num_rows:
                continue
            part = rows.column(0).dictionary_encode()
            names = part.dictionary.to_pylist()
            label = rows.column(2).to_numpy(zero_copy_only=False).astype(np.int64) * 2 + rows.column(3).to_numpy(zero_copy_only=False)
            group = part.indices.to_numpy(zero_copy_only=False).astype(np.int64) * 4 + label
            for g, counts in zip(*grouped_popcounts(group, WORDS[rows.column(1).to_numpy(zero_copy_only=False)]), strict=True):
                key = names[g >> 2], bool(g & 2), bool(g & 1)
                held[key] = held[key] + counts if key in held else counts
            if len(held) > _HELD:
                yield out()
                held.clear()
        if held:
            yield out()

    counted = failed.select("part", "failed", "good", "toxic").mapInArrow(run, "part string, good boolean, toxic boolean, survivors array<long>")
    of = lambda flag: F.sum(F.when(F.col(flag), F.col("n")).otherwise(0))
    return (
        counted.select("part", F.col("good").alias("is_good"), F.col("toxic").alias("is_toxic"), F.posexplode("survivors").alias("subset", "n"))
        .groupBy("part", "subset").agg(F.sum("n").alias("kept"), of("is_good").alias("good"), of("is_toxic").alias("toxic"))
    )


def orders() -> list[tuple[str, int, int, int]]:
    """(filter_order, step, filters before the step as bits, the step's filter as a bit) of every order and step."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def report(counts: DataFrame) -> DataFrame:
    """One row per part, order and step of :func:`survivors`; see :func:`audit`."""
    by_part = counts.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("s"))  # 32 rows each

    def shapley(bit: int):
        # What the filter removes after each set of others, times the orders in which just that set comes before it.
        n = len(FILTERS)
        sets = [s for s in range(_N) if not s & bit]
        return sum((F.col("s")[s]["kept"] - F.col("s")[s | bit]["kept"]) * (factorial(s.bit_count()) * factorial(n - 1 - s.bit_count())) for s in sets)

    values = F.array(*[shapley(1 << i) for i in range(len(FILTERS))])
    steps = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit")) for o, k, b, f in orders()])
    at = by_part.select("part", "s", values.alias("values"), F.explode(steps).alias("x")).select("part", "s", "values", "x.*")
    without, with_it = F.col("s")[F.col("before")], F.col("s")[F.col("before").bitwiseOR(F.col("bit"))]
    removed = without["kept"] - with_it["kept"]
    fails = F.col("s")[0]["kept"] - F.col("s")[F.col("bit")]["kept"]
    return at.select(
        "part", "filter_order", F.col("step").cast("int").alias("step"), with_it["kept"].alias("kept"), removed.alias("removed"), (fails - removed).alias("redundant"),
        (F.col("s")[F.lit(_ALL) - F.col("bit")]["kept"] - F.col("s")[_ALL]["kept"]).alias("unique_fails"),
        (without["good"] - with_it["good"]).alias("good_lost"), (without["toxic"] - with_it["toxic"]).alias("toxic_lost"),
        F.col("values")[F.log2(F.col("bit")).cast("int")].alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    A null text counts as an empty one, a null part as the empty string. A row without an id has no label, is no copy of
    another and makes none. Of rows with equal texts those with the smallest id pass E, repeated rows too. A document is
    good (toxic) if any of its label rows says 1; other labels and label rows without an id are ignored, and labels never
    multiply rows. No rows give no rows. Other columns are ignored.
    """
    return report(cut(survivors(failures(docs, labels, **columns))))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_TOP = ", ".join(f"('{f}', {1 << i})" for i, f in enumerate(FILTERS))
ORACLE = rf"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
         + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first < d.doc_id, false)::INT AS f
  FROM d LEFT JOIN l ON d.doc_id = l.doc_id
),
filters(name, bit) AS (VALUES {_TOP}),
s1 AS (SELECT name AS o, bit AS done, 0 AS before, name, bit, 1 AS step FROM filters),
s2 AS (SELECT o || f.name AS o, done + f.bit AS done, done AS before, f.name, f.bit, 2 AS step FROM s1 JOIN filters f ON (s1.done & f.bit) = 0),
s3 AS (SELECT o || f.name AS o, done + f.bit AS done, done AS before, f.name, f.bit, 3 AS step FROM s2 JOIN filters f ON (s2.done & f.bit) = 0),
s4 AS (SELECT o || f.name AS o, done + f.bit AS done, done AS before, f.name, f.bit, 4 AS step FROM s3 JOIN filters f ON (s3.done & f.bit) = 0),
s5 AS (SELECT o || f.name AS o, done + f.bit AS done, done AS before, f.name, f.bit, 5 AS step FROM s4 JOIN filters f ON (s4.done & f.bit) = 0),
steps AS (
  SELECT s5.o AS filter_order, x.step, x.before, x.bit
  FROM s5 JOIN (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3 UNION ALL SELECT * FROM s4 UNION ALL SELECT * FROM s5) x
    ON s5.o[1:x.step] = x.o
),
g AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM m GROUP BY part, f),
r AS (
  SELECT part, filter_order, step, bit,
         sum(n) FILTER ((f & (before | bit)) = 0) AS kept, sum(n) FILTER ((f & before) = 0 AND (f & bit) <> 0) AS removed,
         sum(n) FILTER ((f & before) <> 0 AND (f & bit) <> 0) AS redundant, sum(n) FILTER (f = bit) AS unique_fails,
         sum(n_good) FILTER ((f & before) = 0 AND (f & bit) <> 0) AS good_lost, sum(n_toxic) FILTER ((f & before) = 0 AND (f & bit) <> 0) AS toxic_lost
  FROM g, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS BIGINT) AS shapley
FROM r"""

QUERIES = {"op11_filter_audit": (op11_filter_audit, ORACLE)}
