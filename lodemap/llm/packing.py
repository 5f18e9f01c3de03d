"""Best-fit packing into sequences of several permitted lengths.

Rows are dealt into shards of a bounded number of tokens; each shard is packed by best fit in decreasing order. Where no
open bin fits, the bin size is opened that costs least per token it can hope to hold, given all that is still to be packed.
At the end every bin shrinks to the smallest permitted length that holds its contents. A shard is packed once with that
rule and once for each permitted length as the least size to open; the cheapest of these packings is taken.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import arrow_map, batch, cut, table

CAPACITIES = (512, 1024, 2048, 4096, 8192)
#: A sequence costs its length, a fixed part, and a part that grows with its square (attention).
FIXED = 32.0
SQUARE = 1 / 32768
#: Tokens and rows of one shard, about.
SHARD_TOKENS = 4_000_000
SHARD_ROWS = 200_000


def cost(length):
    return length + FIXED + length * length * SQUARE


def best_fit(lengths: np.ndarray, capacities: Sequence[int], least: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(bin of each piece, size that each bin was opened with). ``lengths`` fall; none is over the largest capacity.

    ``least`` over 0 opens the smallest permitted size of at least that; 0 opens the size of least cost per token, where a
    bin is expected to hold its first piece and whatever shorter pieces still to come could fill it with.
    """
    caps = np.array(sorted(capacities))
    costs = cost(caps)
    totals = np.cumsum(np.bincount(lengths, lengths, int(caps[-1]) + 1))  # tokens of pieces up to each length
    bins, sizes = np.zeros(len(lengths), np.int64), []
    room: list[int] = []  # distinct free rooms of open bins, sorted
    open_: dict[int, list[int]] = {}
    for i, x in enumerate(lengths.tolist()):
        at = bisect_left(room, x)
        if at < len(room):
            free = room[at]
            b = open_[free].pop()
            if not open_[free]:
                del open_[free]
                room.pop(at)
        else:
            if least:
                free = int(caps[caps >= max(x, least)][0]) if caps[-1] >= max(x, least) else int(caps[-1])
            else:
                fits = caps >= x
                spare = caps[fits] - x
                hoped = x + np.minimum(spare, totals[np.minimum(spare, x)])
                free = int(caps[fits][np.argmin(costs[fits] / hoped)])
            b = len(sizes)
            sizes.append(free)
        bins[i] = b
        left = free - x
        if left:
            if left in open_:
                open_[left].append(b)
            else:
                open_[left] = [b]
                insort(room, left)
    return bins, np.array(sizes, np.int64)


def shrink(bins: np.ndarray, lengths: np.ndarray, capacities: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of each bin, smallest permitted size that holds them)."""
    used = np.bincount(bins, lengths).astype(np.int64)
    caps = np.array(sorted(capacities))
    return used, caps[np.searchsorted(caps, used)]


def pack_shard(lengths: np.ndarray, capacities: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each piece, tokens and size of each bin) of the cheapest packing tried. ``lengths`` fall."""
    best = None
    for least in (0, *sorted(capacities)):
        bins, _ = best_fit(lengths, capacities, least)
        used, size = shrink(bins, lengths, capacities)
        total = float(cost(size.astype(float)).sum())
        if best is None or total < best[0]:
            best = total, bins, used, size
    return best[1:]


_BIN = pa.schema([
    ("bin_id", pa.int64()), ("capacity", pa.int32()), ("used", pa.int64()), ("n_pieces", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("starts", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("cost", pa.float64()),
])
BIN_TYPES = "bin_id long, capacity int, used long, n_pieces long, doc_ids array<long>, starts array<long>, lengths array<long>, cost double"


def pack(lengths: DataFrame, capacities: Sequence[int] = CAPACITIES) -> DataFrame:
    """Bins of ``lengths`` (doc_id, length): one row per bin with its pieces in order.

    A row longer than the largest capacity is cut into pieces of that length and a rest; ``starts`` are offsets in the row.
    Every token of every row is in exactly one bin. Null or negative lengths count as 0 and aren't packed; null ids are
    carried; repeated rows are packed one by one; no rows give no bins.
    """
    longest = max(capacities)
    rows = cut(lengths.select("doc_id", F.col("length").cast("long").alias("length")).filter("length > 0").withColumn("row", F.monotonically_increasing_id()))
    size = rows.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("tokens"), F.sum(F.ceil(F.col("length") / longest)).alias("pieces")).first()
    if not size["tokens"]:
        return lengths.sparkSession.createDataFrame([], BIN_TYPES)
    n = max(1, -(-size["tokens"] // SHARD_TOKENS), -(-int(size["pieces"]) // SHARD_ROWS))
    pieces = rows.select("doc_id", "row", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(longest).cast("long"))).alias("start"))
    pieces = pieces.select(
        F.pmod(F.xxhash64("row", "start"), F.lit(n)).alias("shard"), "doc_id", "row", "start", F.least(F.col("length") - F.col("start"), F.lit(longest)).alias("piece"),
    )

    def run(group: pa.Table) -> pa.Table:
        length, row, start = (group[c].to_numpy() for c in ("piece", "row", "start"))
        order = np.lexsort((start, row, -length))
        length = length[order]
        bins, used, capacity = pack_shard(length, capacities)
        ids = group["doc_id"].to_pylist()
        found: list[tuple[list, list, list]] = [([], [], []) for _ in used]
        for b, i, at, k in zip(bins.tolist(), order.tolist(), start[order].tolist(), length.tolist(), strict=True):
            docs, starts, sizes = found[b]
            docs.append(ids[i])
            starts.append(at)
            sizes.append(k)
        shard = int(group["shard"][0].as_py())
        return pa.Table.from_batches([batch(
            _BIN, bin_id=(np.int64(shard) << 32) + np.arange(len(used)), capacity=capacity.astype(np.int32), used=used, n_pieces=[len(f[0]) for f in found],
            doc_ids=[f[0] for f in found], starts=[f[1] for f in found], lengths=[f[2] for f in found], cost=cost(capacity.astype(float)),
        )])

    return pieces.groupBy("shard").applyInArrow(run, BIN_TYPES)


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, length): words between ASCII white space, and one for the end of the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("length", pa.int64())])

    def count(rows: pa.RecordBatch) -> pa.RecordBatch:
        return batch(schema, doc_id=rows.column(0), length=[len(t.encode().split()) + 1 if t else 1 for t in rows.column(1).to_pylist()])

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(picked, count, "doc_id long, length long")


def pack_documents(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Bins of whole ``docs``, measured in words and an end each; null and empty texts are one end. See :func:`pack`.

    Other measures, such as token counts, go to :func:`pack` directly.
    """
    return pack(word_lengths(docs, id_col, text_col), capacities)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op1_best_fit_packing": (op1_best_fit_packing, None)}
