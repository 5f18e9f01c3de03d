import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from lodemap.llm import prefix_trie as module
from lodemap.llm.prefix_trie import prefix_trie, sketch

SCHEMA = "conv_id long, turn long, role string, text string, depth int, hi string, length int"


def brute(rows, five=False):
    own = {}
    for c, turn, role, text, *_ in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    built = own
    if five:
        built = {}
        for c, w in own.items():
            h = zlib.crc32(str(c).encode()) % 9
            built[c] = own.get(c - (c % 5 if c >= 0 else -(-c % 5)), [])[:h] + w[h:]
    members = {}
    for c, w in built.items():
        for d in range(len(w) + 1):
            members.setdefault(tuple(w[:d]), []).append(c)
    kids = {}
    for k in members:
        if k:
            kids.setdefault(k[:-1], []).append(k)

    def below(k):
        yield k
        for x in kids.get(k, []):
            yield from below(x)

    out = []
    for k, m in members.items():
        under = list(below(k)) if len(k) < 40 else None
        ended = ",".join(str(c) for c in sorted(m) if len(built[c]) == len(k))
        leaves = sum(x not in kids for x in under) if under else None
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x) if under else None
        out.append((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), len(kids.get(k, [])), leaves, saved, sha256(ended.encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(seed, n=60):
    r = random.Random(seed)
    rows = []
    for c in range(n):
        c = c if c % 7 else -c
        for turn in range(r.randrange(7)):
            rows.append((c, turn if turn else None, r.choice(["user", "assistant", None]) if r.random() < 0.2 else "user", r.choice(["hé", "a", "", None, "long text " * 40]) if r.random() < 0.7 else f"x{r.randrange(9)}"))
    rows += [(200 + i, t, "u", f"same {t}") for i in range(30) for t in range(5)]  # a large group of copies
    rows += [(300 + i, 0, "u", "same 0") for i in range(30)]
    rows += [(None, 1, "u", "nobody"), (None, None, None, None), (400, 3, "u", "again"), (400, 3, "u", "again")]
    return [(*x, 1, "h", 2) for x in rows]


def found(df, keep=lambda r: True):
    assert df.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in df.collect() if keep(r)), key=str)


@pytest.fixture
def pieces(spark):
    """Many partitions, so that conversations go over several of them."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


@pytest.mark.parametrize("seed, rough", [(1, False), (2, True)])
def test_against_brute_force(spark, pieces, monkeypatch, seed, rough):
    """With a rough sketch many singletons look shared; the result stays the same."""
    if rough:
        cells = module._cells
        monkeypatch.setattr(module, "_cells", lambda *a: cells(*a) % 24)
    rows = conversations(seed)
    made = spark.createDataFrame(rows, SCHEMA).repartition(4)
    assert found(prefix_trie(made)) == brute(rows)
    c = F.col("conv_id")
    assert found(prefix_trie(made, c - c % 5, F.crc32(c.cast("string").cast("binary")) % 9, 8)) == brute(rows, True)


def test_one_long_conversation(spark, pieces):
    rows = [(7, t, "u", f"t{t % 11}", 1, "h", 2) for t in range(3000)] + [(8, t, "u", f"t{t % 11}" if t < 2500 else "other", 1, "h", 2) for t in range(2600)]
    got = {(r.conv_id, r.depth): r for r in prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()}
    size = lambda lo, hi: sum(len(f"t{t % 11}") for t in range(lo, hi))
    assert len(got) == 3001 + 100
    for d in (0, 1, 777, 2499, 2500):
        r = got[7, d]
        assert (r.n_convs, r.n_leaves, r.n_children, r.saved_tokens) == (2, 2, 2 if d == 2500 else 1, size(max(d - 1, 0), 2500))
    assert got[7, 2501].parent_conv_id == 7 and got[8, 2501].parent_conv_id == 7 and got[8, 2502].parent_conv_id == 8
    assert got[7, 3000].ends_sha256 == sha256(b"7").hexdigest() and got[7, 3000].n_children == 0


def test_many_ends(spark, pieces, monkeypatch):
    monkeypatch.setattr(module, "CHUNK", 50)
    made = spark.range(3000).selectExpr("id AS conv_id", "0L AS turn", "'u' AS role", "'hello' AS text")
    root, node = sorted(prefix_trie(made).collect(), key=lambda r: r.depth)
    assert node.ends_sha256 == sha256(",".join(map(str, range(3000))).encode()).hexdigest() and node.saved_tokens == 2999 * 5 == root.saved_tokens


def test_sketch_never_counts_too_low(spark):
    rows = spark.range(4000).selectExpr("id % 3000 AS depth", "id % 3000 * 7919 AS hi", "id % 3000 AS lo")
    flags, width = sketch(rows, 4000)
    import numpy as np

    at = np.arange(3000, dtype=np.int64)
    seen = module.in_table(flags, module._cells(at, at * 7919, at, width)).all(0)
    assert seen[:1000].all() and seen[1000:].mean() < 0.05


def test_empty_and_single(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert found(prefix_trie(spark.createDataFrame([(5, None, None, None, 1, "h", 2)], SCHEMA))) == brute([(5, None, None, None)])
