import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodemap.llm import lm_score as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, trains):
    count = Counter()
    for doc, text in rows:
        if trains(doc):
            count.update([*WORD.findall((text or "").translate(UP)), None])
    n, v = sum(count.values()), len(count)
    out = []
    for doc, text in rows:
        tokens = [*WORD.findall((text or "").translate(UP)), None]
        base = sum(math.log10((count[t] + 1) / (n + v + 1)) for t in tokens)
        out.append((doc, len(tokens), sum(count[t] > 0 for t in tokens), n, round(base, 6)))
    return sorted(out, key=str)


def _trains(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 7 != 2


@pytest.mark.parametrize("looked_up", [1 << 19, 50])
def test_base_against_brute_force(monkeypatch, make, prose, odd_rows, looked_up):
    monkeypatch.setattr(L, "LOOKED_UP", looked_up)
    rows = odd_rows + [(100 + i, prose(i, 80)) for i in range(60)]
    got = L.lm_scores(make(rows).repartition(2), L._trains()).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got), key=str) == brute(rows, _trains)
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one(spark, make, prose):
    docs = make([(i, prose(i, 200)) for i in range(20)]).select("text")
    counts = L.word_counts(docs)
    words = L.lookup(counts, 20)
    model = L._averaged(docs, words, spark.sparkContext.broadcast(vars(words)))
    model.normalise()
    everything = np.arange(L.CLASSES)
    for one, two in ((0, 1), (L.START, L.START), (3, L.RARE_CONTEXT), (L.RARE_CONTEXT, 7)):
        p = np.exp(model.log_probability(everything, np.full(L.CLASSES, one), np.full(L.CLASSES, two)).astype(float))
        assert abs(p.sum() - 1) < 1e-4
    # Shares within every class that has words add up to one.
    shares = np.bincount(words.classes, 10.0**words.within, L.CLASSES)
    kinds = np.bincount(words.classes, minlength=L.CLASSES)
    assert np.allclose(shares[kinds > 0], 1)


def test_context_helps(make):
    import random

    r = random.Random(1)
    rows = []
    for i in range(200):  # two tongues: a unigram model can't tell which one a text is in
        own = "abcdefghij" if i % 2 else "klmnopqrst"
        rows.append((i, " ".join(r.choice(own) for _ in range(150))))
    got = [r for r in L.lm_scores(make(rows).coalesce(1), L._trains()).collect() if not _trains(r.doc_id)]
    assert sum(r.score for r in got) > 0.95 * sum(r.base_score for r in got) and len(got) > 10


def test_without_training_rows(make, odd_rows):
    got = L.lm_scores(make(odd_rows), F.lit(False)).collect()
    assert len(got) == len(odd_rows) and all(r.train_tokens == 0 and r.n_known == 0 and abs(r.base_score) < 1e-9 for r in got)
    assert L.lm_scores(make([]), L._trains()).count() == 0
