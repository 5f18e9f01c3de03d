"""Quality rules: fixed counts of every text, and a calibrated logistic regression on hashed word and character n-grams."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import arrow_map, batch, blocks, table, word_hashes
from lodemap.llm.toxicity import calibrate

#: Labelled rows of each class that the regression is fitted on, at most.
SAMPLE_PER_CLASS = 1500
BITS = 16
FAMILIES = 4  # words, pairs of words, 3 and 4 bytes
#: A text is kept from this probability of good quality on.
KEEP_FROM = 0.5

AS_IS = bytes(range(256))


def _bucket(h: np.ndarray, family: int) -> np.ndarray:
    return ((h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * family) >> np.uint64(64 - BITS)).astype(np.int64)


def features(raws: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family: (bucket of every n-gram of all texts in order, number of n-grams of each text)."""
    words, counts = word_hashes(raws, AS_IS)
    out = [(_bucket(words, 0), counts)]
    text = np.repeat(np.arange(len(counts)), counts)
    if len(words) > 1:
        same = text[1:] == text[:-1]
        out.append((_bucket((words[:-1] * np.uint64(3) + words[1:])[same], 1), np.maximum(counts - 1, 0)))
    else:
        out.append((np.zeros(0, np.int64), np.zeros(len(counts), np.int64)))
    sizes = np.fromiter(map(len, raws), np.int64, len(raws))
    buf = np.frombuffer(b"".join(raws), np.uint8).astype(np.uint64)
    for family, n in ((2, 3), (3, 4)):
        if len(buf) < n:
            out.append((np.zeros(0, np.int64), np.zeros(len(raws), np.int64)))
            continue
        m = len(buf) - n + 1
        h = np.zeros(m, np.uint64)
        for j in range(n):
            h = (h << np.uint64(8)) | buf[j : j + m]
        # Grams that would run over the end of their text are left out.
        ok = np.ones(len(buf), bool)
        for j in range(1, n):
            ok[np.maximum(np.cumsum(sizes) - j, 0)[sizes >= j]] = False
        out.append((_bucket(h[ok[:m]], family), np.maximum(sizes - n + 1, 0)))
    return out


def _means(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(counts))
    full = np.flatnonzero(counts)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        out[full] = np.add.reduceat(values, starts, dtype=np.float64) / counts[full]
    return out


@dataclass
class Model:
    weights: np.ndarray  # families x buckets
    bias: float
    scale: tuple[float, float]

    def logits(self, raws: list[bytes]) -> np.ndarray:
        z = np.full(len(raws), self.bias)
        for family, (ids, counts) in enumerate(features(raws)):
            z += SCALE * _means(self.weights[family][ids], counts)
        return z

    def probability(self, texts: list[str | None]) -> np.ndarray:
        """Calibrated probability of good quality; texts are scored in blocks."""
        out = np.zeros(len(texts))
        for first, raws in blocks(texts):
            out[first : first + len(raws)] = self.logits(raws)
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * out + self.scale[1], -30, 30)))


SCALE = 20.0


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weights: np.ndarray, steps: int = 150, ridge: float = 1e-4) -> Model:
    """Logistic regression by Adam over all rows at once, calibrated on a fifth that is held back.

    ``rows`` are (feature, value). With one class only, or no rows, every text has the share of good rows (1 without rows).
    """
    share = float(np.average(y, weights=weights)) if len(y) else 1.0
    if not 0 < share < 1:
        return Model(np.zeros((FAMILIES, 1 << BITS), np.float32), 0.0, (0.0, 30.0 if share else -30.0))
    order = np.random.default_rng(11).permutation(len(y))
    parts = []
    for own in (order[len(y) // 5 :], order[: len(y) // 5]):
        sizes = np.array([len(rows[i][0]) for i in own], np.int64)
        idx = np.concatenate([rows[i][0] for i in own]) if len(own) else np.zeros(0, np.int32)
        val = np.concatenate([rows[i][1] for i in own]) if len(own) else np.zeros(0, np.float32)
        parts.append((own, sizes, idx, val))
    w, bias = np.zeros(FAMILIES << BITS), 0.0
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0

    def logit(part) -> np.ndarray:
        _, sizes, idx, val = part
        out = np.full(len(sizes), bias)
        full = np.flatnonzero(sizes)
        if len(full):
            out[full] += np.add.reduceat(w[idx] * val, np.concatenate([[0], np.cumsum(sizes[full])[:-1]]))
        return out

    own, sizes, idx, val = parts[0]
    for step in range(1, steps + 1):
        d = (1 / (1 + np.exp(-np.clip(logit(parts[0]), -30, 30))) - y[own]) / len(own)
        g = np.bincount(idx, weights=np.repeat(d, sizes) * val, minlength=len(w)) + ridge * w / len(own)
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        gb = d.sum()
        mb, vb = mb + 0.1 * (gb - mb), vb + 0.01 * (gb * gb - vb)
        bias -= 0.05 * (mb / (1 - 0.9**step)) / (np.sqrt(vb / (1 - 0.99**step)) + 1e-8)
    held = parts[1] if len(parts[1][0]) else parts[0]
    scale = calibrate(logit(held), y[held[0]], weights[held[0]])
    return Model(w.reshape(FAMILIES, -1).astype(np.float32), float(bias), scale)


def fit(docs: DataFrame, labels: DataFrame, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality") -> Model:
    """The model from at most ``per_class`` labelled rows of each class, taken in the order of a hash of their ids.

    Null labels and others than 0 and 1, ids without a document and ids with two different labels count for nothing. A
    sampled row reaches the driver as the sums of its n-grams: ``FAMILIES`` times 2 ** ``BITS`` numbers at most.
    """
    marked = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    )
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = (marked.filter(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1))
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("ids", pa.binary()), ("values", pa.binary())])

    def sums(rows: pa.RecordBatch) -> pa.RecordBatch:
        ids, values = [], []
        for text in rows.column(2).to_pylist():
            got = [np.unique(x, return_counts=True) for x, _ in features([(text or "").encode()])]
            ids.append(np.concatenate([u + (k << BITS) for k, (u, _) in enumerate(got)]).astype(np.int32).tobytes())
            values.append(np.concatenate([SCALE * c / max(1, c.sum()) for _, c in got]).astype(np.float32).tobytes())
        return batch(schema, doc_id=rows.column(0), y=rows.column(1), ids=ids, values=values)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    # At most 2 * per_class ids: small enough to broadcast at any size of the input.
    joined = picked.join(F.broadcast(bad.unionByName(good)), "doc_id").select("doc_id", "y", "text")
    rows = sorted(arrow_map(joined, sums, "doc_id long, y int, ids binary, values binary").collect(), key=lambda r: (r["doc_id"], r["ids"]))
    y = np.array([r["y"] for r in rows], np.float64)
    taken = {c: max(1, int((y == c).sum())) for c in (0, 1)}
    return train([(np.frombuffer(r["ids"], np.int32), np.frombuffer(r["values"], np.float32)) for r in rows], y,
                 np.array([sizes[r["y"]] / taken[r["y"]] for r in rows], np.float64))


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated 3-word windows)."""
    raw = (text or "").encode()
    words = raw.split()
    inside = b"".join(words)
    chars = len(inside) - len(inside.translate(None, _STARTS)) if not inside.isascii() else len(inside)
    symbols = len(inside) - len(inside.translate(None, b"#*$%&|<>"))
    lines = [x for x in raw.split(b"\n") if x.split()]
    windows = list(zip(words, words[1:], words[2:], strict=False))
    often = Counter(windows)
    repeated = 0
    if len(often) < len(windows):
        upto = 0  # first word not counted yet
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


#: Bytes that start a code point.
_STARTS = bytes(b for b in range(256) if b & 0xC0 != 0x80)

_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("quality", pa.float64()),
])


def judge_quality(docs: DataFrame, model: Model, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, the counts, base_failed, kept, quality (probability of good quality).

    A text of under 50 words, or with over half of its words in repeated windows, fails whatever its probability; so null
    and empty texts fail. Null ids stay; repeated rows are judged one by one; other columns are ignored; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def judge(rows: pa.RecordBatch) -> pa.RecordBatch:
        texts = rows.column(1).to_pylist()
        counts = np.array([base_counts(t) for t in texts], np.int64).reshape(-1, 5)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        p = Model(**sent.value).probability(texts)
        return batch(_SCHEMA, doc_id=rows.column(0), n_words=counts[:, 0], word_chars=counts[:, 1], n_symbols=counts[:, 2], n_dup_lines=counts[:, 3],
                     n_repeat_words=counts[:, 4], base_failed=failed, kept=~failed & (p >= keep_from), quality=p)

    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return arrow_map(picked, judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
                                    "base_failed boolean, kept boolean, quality double")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge_quality(docs, fit(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op5_quality": (op5_quality, None)}
