"""LM scoring: a log-bilinear model over word classes, trained by noise-contrastive estimation on all training documents.

The corpus is counted whole. The commonest words are classes of their own, the next ones share classes by rank, all other
words (unseen ones too) are one class; a word's share of its class comes from the counts. The class of a token is
predicted from the token before it and from the last common word before that: ``score = (A[c1] + B[c2]) . Q[class] +
b[class]``. Every task trains on its own documents from the same start, weights are averaged by tokens, and the
normaliser of every pair of contexts is computed once by matrix products, so that log-probabilities are exactly normalised.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import LOWER, arrow_map, batch, blocks, cut, table, word_hashes

#: Words that executors look up by table, at most: 12 MB of arrays. Counts of all others are joined.
LOOKED_UP = 1 << 19
OWN_CLASSES, SHARED_CLASSES = 4000, 64
OWN_CONTEXTS, SHARED_CONTEXTS = 440, 64
RARE, END = OWN_CLASSES + SHARED_CLASSES, OWN_CLASSES + SHARED_CLASSES + 1
CLASSES = END + 1
RARE_CONTEXT, START = OWN_CONTEXTS + SHARED_CONTEXTS, OWN_CONTEXTS + SHARED_CONTEXTS + 1
CONTEXTS = START + 1
DIMS = 24
NOISE = 64
BATCH = 2048
RATE = 0.15
#: Gradients are sums over this many tokens of a batch's mean, large beside what Adagrad's sums begin with.
SCALE = 100
#: Counts gathered in a task before they are handed on.
HELD_COUNTS = 1 << 20

END_WORD = -1  # the end token's hash; no word is likely to have it


@dataclass
class Words:
    """The looked-up words by hash: count, class and context, and log10 of the share in the class."""

    hashes: np.ndarray  # uint64, sorted
    counts: np.ndarray
    classes: np.ndarray
    contexts: np.ndarray
    within: np.ndarray
    class_counts: np.ndarray  # tokens of each class
    tokens: int  # N
    distinct: int  # V
    rare_total: int  # tokens and words of the rare class, and one for unseen words

    def find(self, words: np.ndarray) -> np.ndarray:
        """Row of every word, -1 where it isn't looked up."""
        if not len(self.hashes) or not len(words):
            return np.full(len(words), -1)
        seen, back = np.unique(words, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, seen), len(self.hashes) - 1)
        return np.where(self.hashes[at] == seen, at, -1)[back]

    def tokens_of(self, words: np.ndarray, counts: np.ndarray):
        """(text, row, class, first context, second context) of every token, ends included, text by text."""
        n = counts + 1
        text = np.repeat(np.arange(len(counts)), n)
        ends = np.cumsum(n) - 1
        is_end = np.zeros(len(text), bool)
        is_end[ends] = True
        row = np.full(len(text), -1)
        row[~is_end] = self.find(words)
        known = row >= 0
        cls = np.full(len(text), RARE)
        cls[known] = self.classes[row[known]]
        cls[is_end] = END
        ctx = np.full(len(text), RARE_CONTEXT)
        ctx[known] = self.contexts[row[known]]
        begin = np.repeat(ends - n + 1, n)
        at = np.arange(len(text))
        one = np.full(len(text), START)
        follows = at > begin
        one[follows] = ctx[np.flatnonzero(follows) - 1]
        # The last word with a context of its own that ends two tokens before at the latest.
        common = np.maximum.accumulate(np.where(ctx < OWN_CONTEXTS, at, -1))
        two = np.full(len(text), START)
        far = np.flatnonzero(at > begin + 1)
        last = common[far - 2]
        ok = last >= begin[far]
        two[far[ok]] = ctx[last[ok]]
        return text, row, cls, one, two


@dataclass
class Model:
    a: np.ndarray
    b: np.ndarray
    q: np.ndarray
    bias: np.ndarray
    norm: np.ndarray | None = None  # log of the normaliser of every pair of contexts

    @staticmethod
    def start(class_counts: np.ndarray, seed: int = 5) -> Model:
        rng = np.random.default_rng(seed)
        p = (class_counts + 1) / (class_counts + 1).sum()
        return Model(*(rng.normal(0, 0.1, (n, DIMS)).astype(np.float32) for n in (CONTEXTS, CONTEXTS, CLASSES)), np.log(p).astype(np.float32))

    def train(self, batches: Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]], class_counts: np.ndarray, seed: int = 3) -> int:
        """Noise-contrastive steps with Adagrad: each batch of tokens is told from the same ``NOISE`` noise classes."""
        rng = np.random.default_rng(seed)
        p = (class_counts + 1) / (class_counts + 1).sum()
        edges, base = np.cumsum(p), (np.log(p) + math.log(NOISE)).astype(np.float32)
        sums = [np.full(len(w), 1e-2, np.float32) for w in (self.a, self.b, self.q, self.bias)]
        done = 0
        for cls, one, two in batches:
            n = len(cls)
            noise = np.minimum(np.searchsorted(edges, rng.random(NOISE)), CLASSES - 1)
            q = self.a[one] + self.b[two]
            target, other = self.q[cls], self.q[noise]
            good = 1 / (1 + np.exp(-np.clip((q * target).sum(1) + self.bias[cls] - base[cls], -30, 30))) - 1
            bad = 1 / (1 + np.exp(-np.clip(q @ other.T + (self.bias[noise] - base[noise]), -30, 30)))
            g_q = good[:, None] * target + bad @ other
            for k, (w, at, g) in enumerate((
                (self.a, one, g_q), (self.b, two, g_q), (self.q, np.concatenate([cls, noise]), np.concatenate([good[:, None] * q, bad.T @ q])),
            )):
                _step(w, at, g * (SCALE / n), sums[k])
            _step(self.bias[:, None], np.concatenate([cls, noise]), np.concatenate([good, bad.sum(0)])[:, None] * (SCALE / n), sums[3])
            done += n
        return done

    def normalise(self, block: int = 8) -> None:
        """Normalisers of all pairs of contexts, by products of blocks of contexts with all classes."""
        self.norm = np.zeros((CONTEXTS, CONTEXTS), np.float32)
        for lo in range(0, CONTEXTS, block):
            q = (self.a[lo : lo + block, None] + self.b[None]).reshape(-1, DIMS)
            s = q @ self.q.T + self.bias
            top = s.max(1, keepdims=True)
            s -= top
            np.exp(s, out=s)
            self.norm[lo : lo + block] = (top[:, 0] + np.log(s.sum(1))).reshape(-1, CONTEXTS)

    def log_probability(self, cls: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return ((self.a[one] + self.b[two]) * self.q[cls]).sum(1) + self.bias[cls] - self.norm[one, two]


def _step(w: np.ndarray, at: np.ndarray, g: np.ndarray, sums: np.ndarray) -> None:
    """One Adagrad step (a rate for each row) of the rows ``at``, which may repeat."""
    order = np.argsort(at, kind="stable")
    rows = at[order]
    starts = np.flatnonzero(np.diff(rows, prepend=-1))
    rows = rows[starts]
    g = np.add.reduceat(g[order], starts)
    sums[rows] += (g * g).mean(1)
    w[rows] -= RATE * g / np.sqrt(sums[rows])[:, None]


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, c) of all ``texts`` (one column): every task adds up what it reads, Spark adds up tasks."""
    schema = pa.schema([("word", pa.int64()), ("c", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for rows in batches:
            found = [held]
            for _, raws in blocks(rows.column(0).to_pylist(), 8 << 20):
                h, _ = word_hashes(raws, LOWER)
                found.append(np.unique(h, return_counts=True))
            words, back = np.unique(np.concatenate([w for w, _ in found]), return_inverse=True)
            held = words, np.bincount(back, np.concatenate([c for _, c in found]), len(words)).astype(np.int64)
            if len(words) > HELD_COUNTS:
                yield batch(schema, word=held[0].view(np.int64), c=held[1])
                held = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(held[0]):
            yield batch(schema, word=held[0].view(np.int64), c=held[1])

    return texts.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def lookup(counts: DataFrame, n_docs: int) -> Words:
    """The commonest words with classes. ``counts`` are of words; each of ``n_docs`` documents adds an end."""
    level = F.floor(F.log("c") * 64)
    levels = counts.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum("c").alias("c")).collect()  # at most 64 * ln(2^63) rows
    left, least = LOOKED_UP, math.inf
    for r in sorted(levels, key=lambda r: -r["level"]):
        left -= r["n"]
        if left < 0:
            break
        least = r["level"]
    top = counts.filter(level >= F.lit(least).cast("double")).select("word", "c").toArrow()  # LOOKED_UP rows at most
    words, c = top["word"].to_numpy().view(np.uint64), top["c"].to_numpy()
    order = np.lexsort((words, -c))
    words, c = words[order], c[order]
    rank = np.arange(len(words))

    def shared(own: int, n: int) -> np.ndarray:
        step = np.log(np.maximum(rank, own) / own + 1e-12) / math.log(max(2.0, LOOKED_UP / own))
        return np.where(rank < own, rank, own + np.clip((step * n).astype(np.int64), 0, n - 1))

    cls = shared(OWN_CLASSES, SHARED_CLASSES)
    ctx = shared(OWN_CONTEXTS, SHARED_CONTEXTS)
    size, kinds = np.bincount(cls, c, CLASSES), np.bincount(cls, minlength=CLASSES)
    n_words, distinct = sum(r["c"] for r in levels), sum(r["n"] for r in levels)
    rare, rare_kinds = int(n_words - c.sum()), distinct - len(words)
    size[RARE], size[END] = rare, n_docs
    within = np.where(cls < OWN_CLASSES, 0.0, np.log10((c + 1) / (size[cls] + kinds[cls])))
    back = np.argsort(words)
    return Words(words[back], c[back], cls[back].astype(np.int32), ctx[back].astype(np.int32), within[back], size, n_words + n_docs,
                 distinct + (n_docs > 0), rare + rare_kinds + 1)


def _averaged(texts: DataFrame, words: Words, sent) -> Model:
    """Each task trains a model on its texts; weights are averaged by tokens. What comes to the driver is one model."""
    schema = pa.schema([("part", pa.int32()), ("row", pa.int32()), ("n", pa.int64()), ("w", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Words(**sent.value)
        model = Model.start(own.class_counts)

        def tokens() -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            rng = np.random.default_rng(1)
            for rows in batches:
                for _, raws in blocks(rows.column(0).to_pylist(), 2 << 20):
                    _, _, cls, one, two = own.tokens_of(*word_hashes(raws, LOWER))
                    order = rng.permutation(len(cls))
                    for lo in range(0, len(cls), BATCH):
                        at = order[lo : lo + BATCH]
                        yield cls[at], one[at], two[at]

        n = model.train(tokens(), own.class_counts)
        if n:
            for part, w in enumerate((model.a, model.b, model.q, model.bias[:, None])):
                yield batch(schema, part=np.full(len(w), part, np.int32), row=np.arange(len(w), dtype=np.int32), n=np.full(len(w), n), w=list(w * np.float32(n)))

    rows = texts.mapInArrow(run, "part int, row int, n long, w array<float>")
    summed = rows.groupBy("part", "row").agg(F.sum("n").alias("n"), *[F.sum(F.get("w", F.lit(i)).cast("double")).alias(f"w{i}") for i in range(DIMS)])
    found = summed.toArrow()
    model = Model.start(words.class_counts)
    if not found.num_rows:
        return model
    part, row, n = (found[c].to_numpy() for c in ("part", "row", "n"))
    values = np.stack([np.nan_to_num(found[f"w{i}"].to_numpy(zero_copy_only=False).astype(float)) for i in range(DIMS)], 1) / n[:, None]
    for k, w in enumerate((model.a, model.b, model.q)):
        w[row[part == k]] = values[part == k]
    model.bias[row[part == 3]] = values[part == 3, 0]
    return model


_SEEN = pa.schema([
    ("row_id", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64()),
    ("rare", pa.list_(pa.struct([("word", pa.int64()), ("n", pa.int64())]))),
])


def lm_scores(docs: DataFrame, trains, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score, score (both log10 of the text's probability).

    Rows where the condition ``trains`` (on ``doc_id``) is true train; null counts as false. Null and empty texts are one end
    token; null ids stay; repeated rows count and are scored one by one; without training rows all words are unseen. Other
    columns are ignored; no rows give no rows.
    """
    spark = docs.sparkSession
    picked = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    training = picked.filter(F.coalesce(trains, F.lit(False)))
    counts = cut(word_counts(training.select("text")))
    words = lookup(counts, training.count())
    sent_words = spark.sparkContext.broadcast(vars(words))
    model = _averaged(training.select("text"), words, sent_words)
    model.normalise()
    sent_model = spark.sparkContext.broadcast(vars(model))
    base_norm, rare_norm = math.log10(words.tokens + words.distinct + 1), math.log10(words.rare_total)

    def score(rows: pa.RecordBatch) -> pa.RecordBatch:
        w, m = Words(**sent_words.value), Model(**sent_model.value)
        out: dict[str, list] = {f: [] for f in _SEEN.names[2:]}
        for _, raws in blocks(rows.column(2).to_pylist()):
            hashes, n_words = word_hashes(raws, LOWER)
            text, row, cls, one, two = w.tokens_of(hashes, n_words)
            size = len(raws)
            ends = cls == END
            known = row >= 0
            rare = ~known & ~ends
            ends_known = w.class_counts[END] > 0
            base = np.where(known, np.log10(w.counts[row] + 1.0) if len(w.counts) else 0.0, np.where(ends, math.log10(w.class_counts[END] + 1.0), 0.0)) - base_norm
            p = m.log_probability(cls, one, two).astype(float) / math.log(10) + np.where(known, w.within[row] if len(w.within) else 0.0, np.where(rare, -rare_norm, 0.0))
            out["n_tokens"] += (n_words + 1).tolist()
            out["n_known"] += np.bincount(text, known | (ends & ends_known), size).astype(np.int64).tolist()
            out["base"] += np.bincount(text, base, size).tolist()
            out["score"] += np.bincount(text, p, size).tolist()
            unseen: list[list] = [[] for _ in raws]
            own_word = np.zeros(len(text), np.uint64)
            own_word[~ends] = hashes
            at = np.flatnonzero(rare)
            if len(at):
                order = at[np.lexsort((own_word[at], text[at]))]
                t, h = text[order], own_word[order]
                first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (h[1:] != h[:-1])]))
                many = np.diff(np.append(first, len(t)))
                for i, word, k in zip(t[first].tolist(), h[first].view(np.int64).tolist(), many.tolist(), strict=True):
                    unseen[i].append({"word": word, "n": k})
            out["rare"] += unseen
        return batch(_SEEN, row_id=rows.column(0), doc_id=rows.column(1), **out)

    numbered = picked.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "text")
    seen = cut(arrow_map(numbered, score, "row_id long, doc_id long, n_tokens long, n_known long, base double, score double, rare array<struct<word:long,n:long>>"))
    rare = seen.select("row_id", F.explode("rare").alias("x")).select("row_id", "x.word", "x.n")
    joined = (
        rare.join(counts, "word")  # an unseen word adds log10(0 + 1)
        .groupBy("row_id").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("more"))
    )
    more = F.coalesce("more", F.lit(0.0))
    return seen.drop("rare").join(joined, "row_id", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("score") + more).alias("score"),
    )


def _trains():
    return F.crc32(F.col("doc_id").cast("string")) % 7 != 2


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"), _trains()).select(
        "doc_id", F.coalesce(~_trains(), F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
    )


QUERIES = {"op9_lm_scores": (op9_lm_scores, None)}
