"""Shared helpers: hashing words of many texts at once in numpy, Arrow plumbing, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts are hashed in blocks of about this many bytes, so that work arrays stay at a few tens of MB.
BLOCK_BYTES = 1 << 20

_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_MULT = np.uint64(0x9E3779B97F4A7C15)

#: A-Z to a-z.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A-Z to a-z, digits and bytes over 127 kept, everything else a space.
ALNUM = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``. Local sessions without one get one below their warehouse."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, and read from there afterwards."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    frozen = df.checkpoint(eager=True)
    return frozen.select(*[F.col(f"`{c}`").alias(c) for c in frozen.columns])


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``fn`` over every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def blocks(texts: list[str | None], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """(index of the first text, texts as UTF-8) in blocks of about ``limit`` bytes; a longer text is a block of its own."""
    start, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = text.encode() if text else b""
        if held and size + len(raw) > limit:
            yield start, held
            start, held, size = i, [], 0
        held.append(raw)
        size += len(raw)
    if held:
        yield start, held


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xA0761D6478BD642F)
    return h ^ (h >> np.uint64(32))


def powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POW: dict[int, np.ndarray] = {}


def word_hashes(raws: list[bytes], translate: bytes = LOWER, prefixes: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words of all texts, in order, and the number of words of each text.

    Words are what ``translate`` leaves between ASCII white space. For each length in ``prefixes`` (under 64) another
    array has the hashes of the words' first bytes.
    """
    if not raws:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), *(np.zeros(0, np.uint64) for _ in prefixes)
    buf = np.frombuffer(b" ".join(raws).translate(translate) + b" ", np.uint8)
    space = IS_SPACE[buf]
    edge = np.flatnonzero(np.diff(space.astype(np.int8), prepend=1))
    starts, ends = edge[0::2], edge[1::2]
    sizes = np.fromiter(map(len, raws), np.int64, len(raws)) + 1
    counts = np.diff(np.searchsorted(starts, np.cumsum(sizes), "left"), prepend=0)
    if not len(starts):
        return np.zeros(0, np.uint64), counts, *(np.zeros(0, np.uint64) for _ in prefixes)
    # A word is a polynomial in its bytes. Words go from long to short, so that each Horner step takes a slice.
    length = ends - starts
    order = np.argsort(-length, kind="stable")
    s, n = starts[order], length[order]
    h = np.full(len(starts), np.uint64(0xCBF29CE484222325), np.uint64)
    alive = np.searchsorted(-n, -np.arange(1, 65), "right")
    found = {}
    for j, k in enumerate(alive[: min(64, n[0])].tolist()):
        h[:k] = h[:k] * _MULT + _BYTE[buf[s[:k] + j]]
        if j + 1 in prefixes:
            found[j + 1] = h.copy()
    for i in range(int((n > 64).sum())):  # the rest of a very long word at once
        part = _BYTE[buf[s[i] + 64 : s[i] + n[i]]]
        p = powers(len(part) + 1, _MULT)
        h[i : i + 1] = h[i : i + 1] * p[-1:] + np.sum(part * p[-2::-1], dtype=np.uint64)
    out = []
    for x in (h, *(found.get(q, h) for q in prefixes)):
        placed = np.empty_like(x)
        placed[order] = x
        out.append(mix(placed))
    return out[0], counts, *out[1:]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the ``k`` words from each position on (of any text; the last k - 1 positions have none)."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = h * _MULT + words[j : j + n]
    return mix(h)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


#: Bits of one slice of a bit table on its way to the driver.
_SLICE_BITS = 1 << 20


def bit_table(slots: DataFrame, bits: int) -> np.ndarray:
    """``bits`` bits (a power of two from 2^16 to 2^26) as bytes, those in ``slots.slot`` set.

    Slots become words on the map side, words become slices of 128 KB: the driver gets 64 rows at most.
    """
    words = slots.groupBy(F.shiftright("slot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(slot & 31 AS INT))")).alias("bits"))
    size = min(bits, _SLICE_BITS) // 32
    schema = pa.schema([("slice", pa.int64()), ("held", pa.binary())])

    def run(group: pa.Table) -> pa.Table:
        out = np.zeros(size, "<u4")
        word = group["word"].to_numpy()
        out[word % size] = group["bits"].to_numpy().astype("<u4")
        return pa.Table.from_batches([batch(schema, slice=[int(word[0]) // size], held=[out.tobytes()])])

    out = np.zeros(bits // 8, np.uint8)
    for row in words.withColumn("slice", (F.col("word") / size).cast("long")).groupBy("slice").applyInArrow(run, "slice long, held binary").collect():
        out[row["slice"] * size * 4 :][: size * 4] = np.frombuffer(row["held"], np.uint8)
    return out


def in_table(flags: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """Which of ``slots`` (int64) are set in a bit table."""
    return (flags[slots >> 3] >> (slots & 7).astype(np.uint8) & 1).astype(bool)
