import re

import numpy as np

from lodemap.llm.quality import base_counts, fit, judge_quality, train

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words, seen, places, dup = WORD.findall(text), set(), {}, 0
    for i in range(len(words) - 2):
        places.setdefault(tuple(words[i : i + 3]), []).append(i)
    repeated = {j for at in places.values() if len(at) > 1 for i in at for j in (i, i + 1, i + 2)}
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated)


def test_counts(odd_rows):
    cases = [t for _, t in odd_rows] + ["a b c a b c", "a a a a", "a a a", "x\ny\nx\n\n\n x\nx", "#a *$ %&|<> é#", "a b c d a b c e b c d", "\x1c \x1c \x1c \x1c", "a\rb\x0bc"]
    for text in cases:
        assert base_counts(text) == brute(text)


def test_learns_junk_and_keeps_clean(spark, make, prose, odd_rows):
    rows, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        rows.append((1000 + i, prose(i) if good else " | ".join(prose(i).split()) + " %%% &&&"))
        labels.append((1000 + i, int(good)))
    table = spark.createDataFrame([*labels, (None, 1), (1, None), (77, 0), (5, 0), (5, 1)], "doc_id long, quality int")
    docs = make(rows[:90] + odd_rows)
    model = fit(docs, table)
    got = {r.doc_id: r for r in judge_quality(make(rows[90:]), model).collect()}
    assert all(got[1000 + i].kept == (i % 3 > 0) for i in range(90, 120))
    odd = judge_quality(make(odd_rows), model).collect()
    assert len(odd) == len(odd_rows)
    for r in odd:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) and 0 <= r.quality <= 1
    assert judge_quality(make([]), model).count() == 0


def test_without_labels(spark, make, prose):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.kept for r in judge_quality(make([(1, prose(1))]), fit(make([(1, prose(1))]), none)).collect()] == [True]
    assert train([(np.zeros(0, np.int32), np.zeros(0, np.float32))], np.zeros(1), np.ones(1)).probability(["x"])[0] < 0.01
