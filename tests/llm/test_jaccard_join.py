import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from lodemap.llm import jaccard_join as J

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UP = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, width, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(UP))
        k = min(width, len(words))
        sets.append(frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else frozenset())
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        met = Counter(j for g in s for j in holders[g])
        for g in s:
            holders[g].append(i)
        for j, shared in met.items():
            if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(((doc, len(s), least.get(find(i)) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def _edited(r, words, share):
    out = list(words)
    for _ in range(int(len(out) * share)):
        at = r.randrange(len(out))
        out[at : at + r.randrange(2)] = [f"e{r.randrange(10**6)}"][: r.randrange(2)]
    return " ".join(out)


@pytest.fixture(scope="module")
def families(prose, odd_rows):
    """Families of near copies from almost equal to unlike, tiny texts, shared passages, exact copies."""
    r = random.Random(3)
    rows, n = list(odd_rows), 100
    for size in (6, 8, 11, 15, 22, 40, 90, 300):
        for family in range(3):
            words = prose(size * 10 + family, size).split()
            for share in (0, 0, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2):
                rows.append((n, _edited(r, words, share)))
                n += 1
    passage = prose(5, 60)
    for i in range(30):
        rows.append((n + i, prose(i + 500, 40) + " " + passage))
    chain = prose(77, 200).split()
    for i in range(25):  # each links with the next only
        rows.append((900 - i, " ".join(chain)))
        chain[i * 6 : i * 6 + 5] = [f"c{i}{k}" for k in range(5)]
    return rows


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80), (2, 60)])
def test_against_brute_force(make, families, width, percent):
    got = J.jaccard_join(make(families).repartition(3), width, percent).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=str) == brute(families, width, percent)


@pytest.mark.parametrize("block, small", [(256, 8), (30, 0), (30, 10**6)])
def test_large_group_of_near_copies(monkeypatch, make, prose, block, small):
    monkeypatch.setattr(J, "BLOCK_SETS", block)
    monkeypatch.setattr(J, "SMALL_GROUP", small)
    r = random.Random(8)
    words = prose(1, 150).split()
    rows = [(i, _edited(r, words, r.choice([0.01, 0.02, 0.06, 0.1, 0.2]))) for i in range(300)]
    got = J.jaccard_join(make(rows).repartition(3), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85)


def test_empty_and_lonely(make):
    assert J.jaccard_join(make([])).count() == 0
    assert sorted(map(tuple, J.jaccard_join(make([(3, "a b c"), (2, None), (5, "")])).collect())) == [(2, 0, 2), (3, 1, 3), (5, 0, 5)]


@pytest.mark.parametrize("percent", [60, 80, 85, 95])
def test_linked_sets_share_a_probed_signature(percent):
    rng = np.random.default_rng(percent)
    for n in [*range(1, 60), 100, 333, 1000]:
        for _ in range(6):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            for drop in range(J.differ(percent, n, n) + 1):
                add = int(rng.integers(0, J.differ(percent, n, n) - drop + 1))
                b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
                shared = len(np.intersect1d(a, b))
                if not len(b) or 100 * shared < percent * (len(a) + len(b) - shared):
                    continue
                large, small = (a, b) if len(a) >= len(b) else (b, a)
                probes = {int(s) >> 2 for s in J.signatures(large, percent) if int(s) & 3 != J.INDEX}
                index = {int(s) >> 2 for s in J.signatures(small, percent) if int(s) & 3 != J.PROBE}
                assert probes & index, (n, drop, add)


def test_counts_of_blocks():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64)) for _ in range(40)]
    got = J.shared_counts(sets, columns=64)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(40) for j in range(40) if i != j)


def test_allocation_is_the_cheapest():
    assert J.allocate(np.array([0, 5, 3, 1]), 2, False).tolist() == [0, 1, 1, 0]
    worth = J.allocate(np.array([0, 5, 4]), 3, True)
    assert worth.tolist() == [0, 2, 1] or worth.tolist() == [0, 1, 2]
    assert J.allocate(np.array([0, 0]), 4, True).tolist() == [2, 2]


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + r.randrange(40), 100 + r.randrange(40)) for _ in range(25)] + [(500, 500 + i) for i in range(1, 50)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {(x.node, x.label) for x in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(x, find(x)) for x in parent if any(x in e and e[0] != e[1] for e in edges)}


def test_unlike_texts_around_one_passage_are_not_compared(monkeypatch, spark, make, prose):
    """Their elements of their own rule all of them out before any two meet; real copies among them are still found."""
    passage = prose(5, 60)
    rows = [(i, prose(i + 500, 60, 10**6) + " " + passage) for i in range(400)]
    rows += [(1000 + i, rows[7 * i][1] + f" t{i}") for i in range(12)]
    seen = []
    blocks = J.family_links
    monkeypatch.setattr(J, "family_links", lambda members, *a: seen.append(members.count()) or blocks(members, *a))
    monkeypatch.setattr(J, "SMALL_GROUP", 3)
    got = J.jaccard_join(make(rows).repartition(3), 4, 85).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows, 4, 85)
    assert seen[0] <= 24
    sets = spark.createDataFrame([(i, np.array([*range(10), 100 + i, 200 + i, 300 + i] if i else [*range(10), 999], np.int64).tobytes()) for i in range(5)], "node long, elements binary")
    assert [r.node for r in J.rivals(sets, 85).collect()] == [0]
