import hashlib
import re

import pytest
from pyspark.sql import functions as F

from lodemap.llm.decontam import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, span):
    windows = {}
    for item, text in items:
        words = WORD.findall((text or "").translate(UP))
        n = min(span, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, which = WORD.findall((text or "").translate(UP)), set(), set()
        for n in lengths:
            for i in range(len(words) - n + 1):
                if (w := tuple(words[i : i + n])) in windows:
                    hit.update(range(i, i + n))
                    which |= windows[w]
        ids = sorted(str(x) for x in which if x is not None)
        out.append((doc, len(words), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


@pytest.mark.parametrize("span, gram", [(10, 5), (6, 3)])
def test_against_brute_force(spark, make, odd_rows, prose, span, gram):
    items = [(1, prose(50, 40)), (2, prose(51, 12)), (3, "alpha Beta gamma"), (4, None), (5, ""), (6, prose(50, 40)), (None, prose(52, 30)), (7, prose(53, 10)), (7, prose(53, 10)), (8, "a a a a a a a a a a a a")]
    p50, p52 = prose(50, 40).split(), prose(52, 30).split()
    rows = odd_rows + [
        (20, prose(60, 80) + " " + " ".join(p50[5:25]) + " " + prose(61, 80)), (21, " ".join(p50[:9])), (22, " ".join(p50[3:13]).upper().replace("Ü", "ü").replace(" ", " - ")),
        (23, "x alpha beta, GAMMA y alpha beta"), (24, prose(51, 12)), (25, " ".join(p52)), (26, " ".join(p50[5:16] + p50[4:15])), (27, "a " * 30),
        (28, " ".join(p50[5:14] + ["zz"] + p50[14:25])), (29, prose(53, 10)), (29, prose(53, 10)), (30, prose(53, 10) + " q"),
    ]
    bench = spark.createDataFrame([(*x, "k") for x in items], "item_id long, text string, hash string")
    judged = decontaminate(make(rows), bench, span, gram)
    got = judged.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256), "contaminated").collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, items, span)


def test_empty_tables(spark, make, odd_rows):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontaminate(make(odd_rows), none).collect()] == [0] * len(odd_rows)
    assert decontaminate(make([]), spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0
