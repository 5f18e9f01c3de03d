"""Toxicity: a convolutional text classifier with hashed word embeddings, trained in numpy on all labelled rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import ALNUM, arrow_map, batch, bit_table, blocks, cut, in_table, table, word_hashes

#: Labelled rows of each class that the driver fits a net on, at most; their texts are taken whole. Where there are more, tasks go on with all.
SAMPLE_PER_CLASS = 2500
#: Labelled rows of one task, and rounds of all tasks, at most.
TASK_ROWS = 4096
ROUNDS = 4
#: Steps of a task in a round, at least, if four passes over its rows give so many.
ROUND_STEPS = 20

BUCKETS = 1 << 17
WIDTHS = (1, 2, 3)
FILTERS = 8
DIMS = 8
LEAST_STEPS = 600
HASHES = 3
#: Words in fewer labelled rows share one embedding, of zeros.
LEAST_ROWS = 4


def words_of(raws: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of every word: its own and those of its first four and five bytes, number of words of each text).

    Stems make unseen endings of a known word known. Bucket 0 is kept for rare words and padding.
    """
    hashes, counts, four, five = word_hashes(raws, ALNUM, (4, 5))
    return np.stack([((h >> np.uint64(13 * k)) % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for k, h in enumerate((hashes, four, five))]), counts


def windows(ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets with padding between texts, starts of the windows that hold a known word, the text of each start).

    All other windows see padding only: their activation is the bias.
    """
    pad = len(WIDTHS) - 1
    text = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(ids.shape[1]) + text * pad
    wide = np.zeros((HASHES, ids.shape[1] + pad * (len(counts) + 1)), np.int32)
    wide[:, at] = ids
    busy = wide.any(0)
    live = busy[at]
    for j in range(1, pad + 1):
        live = live | busy[at + j]
    return wide, at[live], text[live]


@dataclass
class Model:
    """Filters laid out by offset in the window, so that a convolution is a sum of looked-up rows."""

    ranks: np.ndarray  # per hash: row of every bucket in the tables, 0 for buckets of rare words
    tables: list[np.ndarray]  # per offset and hash: rows x filters of the widths that reach the offset
    bias: np.ndarray
    out: np.ndarray
    out_bias: float
    scale: tuple[float, float]  # calibration: probability = sigmoid(scale[0] * logit + scale[1])
    thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.3

    def features(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Largest activation of each filter in each text; 0 for a text without words."""
        n_filters, pad = len(self.bias), len(WIDTHS) - 1
        pooled = np.zeros((len(counts), n_filters), np.float32)
        pooled[counts > 0] = np.maximum(self.bias, 0)
        wide, at, text = windows(np.stack([self.ranks[k, ids[k]] for k in range(HASHES)]), counts)
        for lo in range(0, len(at), 1 << 16):
            here, row = at[lo : lo + (1 << 16)], text[lo : lo + (1 << 16)]
            act = np.zeros((len(here), n_filters), np.float32)
            for j in range(pad + 1):
                first = sum(FILTERS for w in WIDTHS if w <= j)
                for k in range(HASHES):
                    act[:, first:] += self.tables[HASHES * j + k][wide[k, here + j]]
            act = np.maximum(act + self.bias, 0)
            starts = np.flatnonzero(np.diff(row, prepend=-1))
            pooled[row[starts]] = np.maximum(pooled[row[starts]], np.maximum.reduceat(act, starts))
        return pooled

    def probability(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        logit = self.features(ids, counts) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logit.astype(np.float64) + self.scale[1], -30, 30)))


def _adam(p: np.ndarray, g: np.ndarray, state: dict, rate: float, step: int) -> None:
    m = state.setdefault("m", np.zeros_like(p))
    v = state.setdefault("v", np.zeros_like(p))
    m += 0.1 * (g - m)
    v += 0.01 * (g * g - v)
    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)


class Net:
    """The classifier while it is trained: embeddings of known buckets, convolutions and output, and their Adam steps."""

    def __init__(self, params: list[np.ndarray], lazy: bool = False) -> None:
        self.params = params
        self.states: list[dict] = [{} for _ in params]
        self.steps = 0
        # Lazy nets move and count only embeddings that have a gradient.
        self.hits = [np.zeros(len(p), np.int64) for p in params[:HASHES]] if lazy else None

    @staticmethod
    def start(sizes: list[int], rng: np.random.Generator) -> Net:
        """``sizes`` are the rows of the embeddings of each hash; row 0 stays zero."""
        n_filters = FILTERS * len(WIDTHS)
        emb = [rng.normal(0, 0.1, (n, DIMS)).astype(np.float32) for n in sizes]
        for e in emb:
            e[0] = 0
        conv = [rng.normal(0, 0.3, (w * DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
        return Net([*emb, *conv, np.zeros(n_filters, np.float32), rng.normal(0, 0.3, n_filters).astype(np.float32), np.zeros(1, np.float32)])

    def forward(self, parts: list[tuple[np.ndarray, np.ndarray]]):
        """(pooled activations, logits, what a step needs) of texts laid out by :func:`lay`."""
        emb, conv = self.params[:HASHES], self.params[HASHES : HASHES + len(WIDTHS)]
        bias, out, out_bias = self.params[HASHES + len(WIDTHS) :]
        pad = len(WIDTHS) - 1
        sizes = np.array([len(at) for _, at in parts])
        pooled, best = np.zeros((len(parts), len(bias)), np.float32), None
        if sizes.sum():
            win = np.stack([np.concatenate([wide[k, at + j] for wide, at in parts]) for j in range(pad + 1) for k in range(HASHES)])
            x = np.concatenate([sum(emb[k][win[HASHES * j + k]] for k in range(HASHES)) for j in range(pad + 1)], axis=1)
            act = np.concatenate([x[:, : w * DIMS] @ conv[k] for k, w in enumerate(WIDTHS)], axis=1) + bias
            full = np.flatnonzero(sizes)
            tops = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
            peak = np.maximum.reduceat(act, tops)
            pooled[full] = np.maximum(peak, 0)
            best = (win, x, act, full, tops, sizes[full])
        return pooled, pooled @ out + out_bias[0], best

    def step(self, parts: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, w: np.ndarray | float = 1.0) -> None:
        """One Adam step; ``w`` weighs the rows."""
        conv, out = self.params[HASHES : HASHES + len(WIDTHS)], self.params[-2]
        pooled, logit, best = self.forward(parts)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        d = (w * (p - y) / len(parts)).astype(np.float32)
        grads = [np.zeros_like(q) for q in self.params]
        grads[-1][0], grads[-2][:] = d.sum(), pooled.T @ d
        if best is not None:
            win, x, act, full, tops, sizes = best
            where = np.stack([act[t : t + n].argmax(0) + t for t, n in zip(tops.tolist(), sizes.tolist(), strict=True)])
            for k, width in enumerate(WIDTHS):
                own = slice(k * FILTERS, (k + 1) * FILTERS)
                i, f = np.nonzero(pooled[full, own] > 0)
                at, g = where[:, own][i, f], (d[full[i]] * out[own][f])[:, None]
                np.add.at(grads[HASHES + k].T, f, g * x[at, : width * DIMS])
                np.add.at(grads[HASHES + len(WIDTHS)][own], f, g[:, 0])
                gx = g * conv[k].T[f]
                for j in range(width):
                    for h in range(HASHES):
                        np.add.at(grads[h], win[HASHES * j + h, at], gx[:, j * DIMS : (j + 1) * DIMS])
            for h in range(HASHES):
                grads[h][0] = 0
        self.steps += 1
        for h, (q, g, s) in enumerate(zip(self.params, grads, self.states, strict=True)):
            if self.hits is not None and h < HASHES:
                rows = np.flatnonzero(g.any(1))
                own = {k: v[rows] for k, v in s.items()}
                moved = q[rows]
                _adam(moved, g[rows], own, 0.01, self.steps)
                q[rows] = moved * (1 - 1e-3)
                self.hits[h][rows] += 1
                for k, v in own.items():
                    s.setdefault(k, np.zeros_like(q))[rows] = v
                continue
            _adam(q, g, s, 0.01, self.steps)
            q *= 1 - 1e-3

    def logits(self, laid: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return np.concatenate([self.forward(laid[i : i + 64])[1] for i in range(0, len(laid), 64)] or [np.zeros(0)]).astype(np.float64)

    def model(self, dense: np.ndarray, scale: tuple[float, float]) -> Model:
        emb, conv = self.params[:HASHES], self.params[HASHES : HASHES + len(WIDTHS)]
        tables = []
        for j in range(len(WIDTHS)):
            for k in range(HASHES):
                tables.append(np.concatenate([emb[k] @ conv[i][j * DIMS : (j + 1) * DIMS] for i, w in enumerate(WIDTHS) if w > j], axis=1))
        return Model(dense, tables, self.params[-3], self.params[-2], float(self.params[-1][0]), scale)


def rows_of(seen: np.ndarray) -> np.ndarray:
    """Per hash the embedding row of every bucket, from the number of texts that have it; row 0 for buckets of rare words."""
    dense = np.zeros((HASHES, BUCKETS), np.int32)
    for k in range(HASHES):
        known = seen[k] >= LEAST_ROWS
        dense[k, known] = np.arange(1, known.sum() + 1)
    return dense


def lay(words: np.ndarray, dense: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedding rows and starts of the windows of one text, in as few bytes as hold them."""
    kind = np.uint16 if dense.max() < 1 << 16 else np.int32
    wide, at, _ = windows(np.stack([dense[k][words[k]] for k in range(HASHES)]), np.array([words.shape[1]]))
    return wide.astype(kind), at.astype(np.int32)


def fit_net(texts: list[np.ndarray], labels: np.ndarray, epochs: int, rng: np.random.Generator):
    """(net, embedding rows of buckets, texts laid out, held-back rows) of texts in memory, which are released as they are laid out."""
    seen = np.zeros((HASHES, BUCKETS), np.int32)
    for t in texts:
        for k in range(HASHES):
            seen[k, np.unique(t[k])] += 1
    dense = rows_of(seen)
    laid = []
    for i, t in enumerate(texts):
        laid.append(lay(t, dense))
        texts[i] = t = None
    net = Net.start([int(dense[k].max()) + 1 for k in range(HASHES)], rng)
    order = rng.permutation(len(texts))
    held, used = order[: len(texts) // 5], order[len(texts) // 5 :]
    held = held.tolist() or used.tolist()
    # Small samples get more rounds; training ends when the held-back rows haven't gained for a while.
    per_round = -(-len(used) // 64)
    patience = max(3, -(-150 // per_round))
    best_loss, best_params, stale = np.inf, net.params, 0
    for _ in range(max(epochs, -(-LEAST_STEPS // per_round))):
        rng.shuffle(used)
        for lo in range(0, len(used), 64):
            rows = used[lo : lo + 64].tolist()
            net.step([laid[i] for i in rows], labels[rows])
        logit = net.logits([laid[i] for i in held])
        loss = float(np.average(np.logaddexp(0, np.where(labels[held] > 0, -logit, logit))))
        stale += 1
        if loss < best_loss:
            best_loss, best_params, stale = loss, [q.copy() for q in net.params], 0
        if stale >= patience:
            break
    for q, x in zip(net.params, best_params, strict=True):
        q[...] = x
    return net, dense, laid, held


def train(texts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, langs: list[str | None], epochs: int = 8, seed: int = 7) -> Model:
    """Fits filters, embeddings and output by Adam on batches of texts; calibrates on a fifth that is held back.

    ``texts`` are buckets of words and are released as they are laid out, ``weights`` count in calibration and thresholds. With one
    class only, or no rows, every text scores the rate of toxic rows (0 without rows).
    """
    share = float(np.average(labels, weights=weights)) if len(labels) else 0.0
    if not 0 < share < 1:
        return one_class(share)
    net, dense, laid, held = fit_net(texts, labels, epochs, np.random.default_rng(seed))
    logit = net.logits([laid[i] for i in held])
    scale = calibrate(logit, labels[held], weights[held])
    prob = 1 / (1 + np.exp(-(scale[0] * logit + scale[1])))
    model = net.model(dense, scale)
    model.threshold = best_threshold(prob, labels[held], weights[held])
    for lang in sorted({x for x in (langs[i] for i in held) if x is not None}):
        own = np.array([langs[i] == lang for i in held])
        if labels[held][own].sum() >= 20:
            model.thresholds[lang] = best_threshold(prob[own], labels[held][own], weights[held][own])
    return model


def one_class(share: float) -> Model:
    """Every text scores ``share``, which is 0 or 1."""
    n_filters = FILTERS * len(WIDTHS)
    empty = [np.zeros((1, sum(FILTERS for w in WIDTHS if w > j)), np.float32) for j in range(len(WIDTHS)) for _ in range(HASHES)]
    none = np.zeros(n_filters, np.float32)
    return Model(np.zeros((HASHES, BUCKETS), np.int32), empty, none, none, 0.0, (0.0, 30.0 if share else -30.0))


def calibrate(logit: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 400) -> tuple[float, float]:
    """Scale and shift of logits by weighted logistic regression (Newton steps with a small pull towards 1 and 0)."""
    a, b = 1.0, 0.0
    w = w / w.sum() * len(w)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        r, h = w * (p - y), w * p * (1 - p)
        g = np.array([(r * logit).sum() + 0.1 * (a - 1), r.sum() + 0.01 * b])
        hess = np.array([[(h * logit * logit).sum() + 0.1, (h * logit).sum()], [(h * logit).sum(), h.sum() + 0.01]])
        step = np.clip(np.linalg.solve(hess, g), -1, 1)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(b)


def best_threshold(prob: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The cut with the best weighted F1 among 0.05, 0.1 ... 0.95; the middle one of equals."""
    cuts = np.round(np.arange(0.05, 0.96, 0.05), 2)
    scores = []
    for c in cuts:
        hit = prob >= c
        right = (w * hit * y).sum()
        scores.append(2 * right / max((w * hit).sum() + (w * y).sum(), 1e-9))
    best = np.flatnonzero(np.isclose(scores, max(scores)))
    return float(cuts[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, usable, per_class: int = SAMPLE_PER_CLASS, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "toxic", lang_col: str | None = "lang") -> Model:
    """The model from all labelled rows.

    ``usable`` is a condition on the id column ``doc_id`` that admits labels. Labels that are null or not 0 or 1, ids
    without a document and ids with two different labels count for nothing. Up to ``per_class`` rows of each class are
    trained on by the driver, which gets their words as hashes. Where a class has more, a net of so many rows of each
    class (in the order of a hash of their ids) is only the start: tasks go on from it with all rows, see :func:`_fit_by_tasks`.
    Language serves the thresholds only.
    """
    marked = (
        labels.select(labels[id_col].cast("long").alias("doc_id"), labels[label_col].cast("int").alias("y"))
        .filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & usable)
        .groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).filter("y = z").select("doc_id", "y")
    )
    sizes = {r["y"]: r["n"] for r in marked.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = marked.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("lang", pa.string()), ("words", pa.binary())])

    def words(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: list[bytes] = []
        for _, raws in blocks(rows.column(3).to_pylist()):
            out += [np.ascontiguousarray(t).tobytes() for t in texts_of(raws)]
        return batch(schema, doc_id=rows.column(0), y=rows.column(1), lang=rows.column(2), words=out)

    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), lang.alias("lang"), docs[text_col].cast("string").alias("text"))
    # At most 2 * per_class ids: small enough to broadcast at any size of the input.
    joined = picked.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "lang", "text")
    rows = sorted(arrow_map(joined, words, "doc_id long, y int, lang string, words binary").collect(), key=lambda r: (r["doc_id"], r["words"]))
    y = np.array([r["y"] for r in rows], np.float64)
    langs = [r["lang"] for r in rows]
    texts = [np.frombuffer(r["words"], np.int32).reshape(HASHES, -1) for r in rows]
    del rows
    if max(sizes.values(), default=0) <= per_class:
        return train(texts, y, np.ones(len(y)), langs)
    return _fit_by_tasks(_labelled(picked, marked, sum(sizes.values())), texts, y)


def texts_of(raws: list[bytes]) -> list[np.ndarray]:
    """Buckets of the words of each text."""
    ids, counts = words_of(raws)
    return np.split(ids, np.cumsum(counts)[:-1], axis=1)


def _labelled(picked: DataFrame, marked: DataFrame, n: int) -> DataFrame:
    """(doc_id, y, lang, text, held) of every labelled document, about ``TASK_ROWS`` of them in a partition.

    A bit table of the labelled ids (8 MB at most) keeps most other texts from being shuffled; the join decides. Both sides are
    dealt by the join's key beforehand, so that texts are shuffled once whichever join is taken. Where a session deals out
    more partitions, they are put together again: every task of a round hands on a net.
    """
    bits = 1 << min(26, max(16, (16 * n).bit_length()))
    flags = bit_table(marked.select(F.expr(f"xxhash64(doc_id) & {bits - 1}L").alias("slot")), bits)
    sent = picked.sparkSession.sparkContext.broadcast(flags)

    def hit(rows: pa.RecordBatch) -> pa.RecordBatch:
        return rows.filter(pa.array(in_table(sent.value, rows.column(3).to_numpy()))).drop_columns(["slot"])

    some = arrow_map(picked.filter("doc_id is not null").withColumn("slot", F.expr(f"xxhash64(doc_id) & {bits - 1}L")), hit, "doc_id long, lang string, text string")
    parts = -(-n // TASK_ROWS)
    # A fifth is held back from training, as on the driver.
    held = F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0
    dealt = some.repartition(parts, "doc_id").join(marked.repartition(parts, "doc_id"), "doc_id")
    return cut(dealt.select("doc_id", "y", "lang", "text", held.alias("held"))).coalesce(parts)


def _bucket_counts(rows: DataFrame) -> np.ndarray:
    """In how many texts each bucket of each hash is; tasks add up their own, 393,216 rows at most reach the driver."""
    schema = pa.schema([("at", pa.int32()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((HASHES, BUCKETS), np.int64)
        for some in batches:
            for _, raws in blocks(some.column(0).to_pylist()):
                for t in texts_of(raws):
                    for k in range(HASHES):
                        seen[k, np.unique(t[k])] += 1
        at = np.flatnonzero(seen)
        yield batch(schema, at=at.astype(np.int32), n=seen.ravel()[at])

    found = rows.select("text").mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(HASHES * BUCKETS, np.int64)
    out[found["at"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(HASHES, BUCKETS)


def _steps(n: int) -> int:
    """Steps of a task with ``n`` rows in a round: whole passes."""
    per_pass = max(1, -(-n // 64))
    return per_pass * min(4, -(-ROUND_STEPS // per_pass))


def _round(rows: DataFrame, params: list[np.ndarray], dense: np.ndarray, balance: np.ndarray, seed: int) -> tuple[float, list[np.ndarray]]:
    """(loss of ``params`` on all held-back rows, parameters after every task has stepped over its other rows).

    An embedding is averaged over the tasks by the number of their steps that moved it, all else by their texts. What was
    moved comes to the driver, one net at most.
    """
    schema = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("n", pa.float64()), ("w", pa.list_(pa.float32()))])
    sent = rows.sparkSession.sparkContext.broadcast((params, dense))
    wide = max(p.shape[1] for p in params if p.ndim == 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start, dense = sent.value
        net, first = Net([p.copy() for p in start], lazy=True), Net(start)
        rng = np.random.default_rng(seed)
        kept, kept_y, loss, weight = [], [], 0.0, 0.0
        for some in batches:
            y_all, held_all = some.column(0).to_numpy().astype(np.float64), some.column(2).to_numpy(zero_copy_only=False)
            for lo, raws in blocks(some.column(1).to_pylist()):
                laid = [lay(t, dense) for t in texts_of(raws)]
                y, held = y_all[lo : lo + len(laid)], held_all[lo : lo + len(laid)]
                w = balance[y.astype(int)]
                back = np.flatnonzero(held)
                logit = first.logits([laid[i] for i in back])
                loss += float((w[back] * np.logaddexp(0, np.where(y[back] > 0, -logit, logit))).sum())
                weight += float(w[back].sum())
                for i in np.flatnonzero(~held).tolist():
                    kept.append(laid[i])
                    kept_y.append(y[i])
        n, kept_y = len(kept), np.array(kept_y)
        for _ in range(_steps(n) // max(1, -(-n // 64))):
            order = rng.permutation(n)
            for at in range(0, n, 64):
                own = order[at : at + 64].tolist()
                net.step([kept[i] for i in own], kept_y[own], balance[kept_y[own].astype(int)])
        yield batch(schema, part=[-1], row=[0], n=[1.0], w=[[loss, weight]])
        for part, p in enumerate(net.params if n else []):
            count = net.hits[part] if part < HASHES else np.full(len(p), n)
            at = np.flatnonzero(count)
            table = (p if p.ndim == 2 else p[:, None])[at] * count[at, None]
            yield batch(schema, part=np.full(len(at), part, np.int32), row=at.astype(np.int32), n=count[at].astype(float), w=list(table.astype(np.float32)))

    made = rows.select("y", "text", "held").mapInArrow(run, "part int, row int, n double, w array<float>")
    sums = made.groupBy("part", "row").agg(F.sum("n").alias("n"), *[F.sum(F.get("w", F.lit(i)).cast("double")).alias(f"w{i}") for i in range(wide)])
    found = sums.toArrow()
    part, row, n = (found[c].to_numpy() for c in ("part", "row", "n"))
    values = np.stack([np.nan_to_num(found[f"w{i}"].to_numpy(zero_copy_only=False).astype(float)) for i in range(wide)], 1)
    after = [p.copy() for p in params]
    for k, p in enumerate(after):
        own = part == k
        mean = (values[own] / n[own][:, None]).astype(np.float32)
        p[row[own]] = mean[:, : p.shape[1]] if p.ndim == 2 else mean[:, 0]
    for e in after[:HASHES]:
        e[0] = 0
    loss, weight = values[part == -1][0, :2]
    return loss / max(weight, 1e-9), after


def _fit_by_tasks(rows: DataFrame, texts: list[np.ndarray], y: np.ndarray) -> Model:
    """The model from all ``rows`` of :func:`_labelled`; ``texts`` and ``y`` are those that the net starts from.

    Buckets are counted over all rows. In each round every task goes on from the same net with its own rows, classes weighing the
    same, and the nets are averaged; rounds end when all held-back rows together gain no more. Calibration and
    thresholds come from all held-back rows.
    """
    found = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(found) < 2:
        return one_class(float(max(found, default=0)))
    total = sum(found.values())
    balance = np.array([total / (2 * found[c]) for c in (0, 1)])
    dense = rows_of(_bucket_counts(rows))
    net = Net.start([int(dense[k].max()) + 1 for k in range(HASHES)], np.random.default_rng(7))
    if len(set(y.tolist())) == 2:
        first, own, _, _ = fit_net(texts, y, 8, np.random.default_rng(7))
        for k in range(HASHES):
            both = (dense[k] > 0) & (own[k] > 0)
            net.params[k][dense[k][both]] = first.params[k][own[k][both]]
        net.params[HASHES:] = first.params[HASHES:]
    params, best, least, stale = net.params, net.params, np.inf, 0
    # As on the driver, small tables get more rounds, and rounds without a gain are borne for a while.
    steps = _steps(min(total, TASK_ROWS) * 4 // 5)
    patience = max(2, -(-100 // steps))
    for i in range(max(ROUNDS, -(-LEAST_STEPS // (steps * -(-total // TASK_ROWS)))) + 1):
        loss, after = _round(rows, params, dense, balance, i)
        stale += 1
        if loss < least - 1e-3:
            stale = 0
        if loss < least:
            best, least = params, loss
        if stale >= patience:
            break
        params = after
    sent = rows.sparkSession.sparkContext.broadcast((best, dense))
    schema = pa.schema([("lang", pa.string()), ("y", pa.int32()), ("logit", pa.float64())])

    def judge(some: pa.RecordBatch) -> pa.RecordBatch:
        params, dense = sent.value
        one = Net(params)
        logit = [one.logits([lay(t, dense) for t in texts_of(raws)]) for _, raws in blocks(some.column(2).to_pylist())]
        return batch(schema, lang=some.column(0), y=some.column(1), logit=np.concatenate(logit))

    judged = cut(arrow_map(rows.filter("held").select("lang", "y", "text"), judge, "lang string, y int, logit double"))
    # Logits in steps of 1/256: 30,722 rows at most.
    step = F.round(F.greatest(F.least("logit", F.lit(30.0)), F.lit(-30.0)) * 256) / 256
    bins = judged.groupBy("y", step.alias("x")).agg(F.count("*").alias("n")).orderBy("y", "x").toArrow()
    x, c, n = (bins[k].to_numpy().astype(float) for k in ("x", "y", "n"))
    scale = calibrate(x, c, n) if len(x) else (1.0, 0.0)
    model = Net(best).model(dense, scale)
    cuts = np.round(np.arange(0.05, 0.96, 0.05), 2)
    met = sum((1 / (1 + F.exp(-(F.lit(scale[0]) * F.col("logit") + F.lit(scale[1])))) >= float(q)).cast("int") for q in cuts)
    levels = judged.groupBy("lang", "y", met.alias("met")).agg(F.count("*").alias("n")).collect()  # 40 for each language
    by_lang: dict[str | None, list] = {}
    for r in levels:
        by_lang.setdefault(r["lang"], []).append(r)

    def threshold(some: list) -> float:
        prob = np.array([cuts[r["met"] - 1] if r["met"] else 0.0 for r in some])
        return best_threshold(prob, np.array([r["y"] for r in some], float), np.array([r["n"] for r in some], float))

    if levels:
        model.threshold = threshold(levels)
    for lang, some in sorted((k, v) for k, v in by_lang.items() if k is not None):
        if sum(r["n"] for r in some if r["y"]) >= 20:
            model.thresholds[lang] = threshold(some)
    return model


def score_texts(model: Model, texts: list[str | None]) -> np.ndarray:
    out = np.zeros(len(texts))
    for first, raws in blocks(texts):
        out[first : first + len(raws)] = model.probability(*words_of(raws))
    return out


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1), toxic (score over the threshold of the row's language).

    Null and empty texts are scored as texts without words; a null or unknown language takes the common threshold; null
    ids stay; repeated rows are scored one by one; other columns are ignored; no rows give no rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("toxic", pa.bool_())])
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        m = Model(**sent.value)
        scores = score_texts(m, rows.column(2).to_pylist())
        limit = [m.thresholds.get(x, m.threshold) for x in rows.column(1).to_pylist()]
        return batch(schema, doc_id=rows.column(0), score=scores, toxic=scores >= np.array(limit, float))

    lang = docs[lang_col].cast("string") if lang_col else F.lit(None).cast("string")
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), lang.alias("lang"), docs[text_col].cast("string").alias("text"))
    return arrow_map(picked, score, "doc_id long, score double, toxic boolean")


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` without the rows over their language's threshold; columns, order and repeated rows stay.

    Null and empty texts are scored as texts without words; rows with a null language, and tables without ``lang_col``, take
    the common threshold; no rows give no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vars(model))
    text_at, lang_at = docs.columns.index(text_col), docs.columns.index(lang_col) if lang_col in docs.columns else None

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(**sent.value)
        for rows in batches:
            scores = score_texts(m, rows.column(text_at).to_pylist())
            langs = [None] * rows.num_rows if lang_at is None else rows.column(lang_at).to_pylist()
            limit = np.array([m.thresholds.get(x, m.threshold) for x in langs], float)
            yield rows.filter(pa.array(scores < limit))

    return docs.mapInArrow(keep, docs.schema)


def trainable():
    return F.crc32(F.col("doc_id").cast("string")) % 4 != 2


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), trainable())
    return toxicity(docs, model).select(
        "doc_id", F.coalesce(~trainable(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


QUERIES = {"op10_toxicity": (op10_toxicity, None)}
