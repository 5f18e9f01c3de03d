"""N-gram Jaccard join: sets are cut into segments of a hashed universe; sets that may link share a segment, by pigeonhole.

Two sets of sizes a and b with similarity of at least ``percent`` differ in at most H = (100 - percent) (a + b) / (100 +
percent) elements. All sets of one size band are cut into the same m > H segments, by a hash of each element. One of the
two (the larger, the prober) needs only segments worth H + 1: an equal segment is worth one; a segment whose
neighbourhood of single deletions is probed as well is worth two. It takes the cheapest: short segments are common, so
they cost most and are left out first. The other set is in the index with all its segments.

Candidates are met per segment without pairing a group's members: each meets the first prober. After these links are
verified and closed, only groups that still hold several components are looked at further. In large ones sets with more
elements of their own than a link allows go first: an element that no other of these sets has is shared with none, so unlike
texts around one passage leave their group without being compared. Small groups then give their pairs across components, as
far as sizes and the triangle inequality of the Jaccard distance allow. Large ones form families, which are packed into blocks;
each two blocks of a family, but two of its largest component, meet in one task that compares them by matrix products and
hands on at most one link for each set. So no link between components is lost, and no group's pairs are ever written out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import LOWER, arrow_map, batch, bit_table, blocks, cut, gram_hashes, in_table, mix, table, word_hashes

#: Bands up to this size also hold every segment's single deletions in the index.
DELETIONS_UP_TO = 24
#: Cost of probing an equal segment of 0, 1, 2 or more elements: what shorter ones meet by chance.
COSTS = (10_000.0, 60.0, 6.0, 1.0)

BOTH, PROBE, INDEX = 0, 1, 2
#: Groups of up to so many sets with several components give their pairs; larger ones are compared in blocks.
SMALL_GROUP = 8
#: Sets and elements of one block, about. A task holds two.
BLOCK_SETS = 1024
BLOCK_ELEMENTS = 400_000

#: A node's lowest byte is the logarithm of its set's size to this base.
_STEP = 1.06


def shingle_sets(raws: list[bytes], width: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's ``width``-word shingles; of all words of a shorter text; none without words."""
    words, counts = word_hashes(raws, LOWER)
    at = 0
    for n in counts.tolist():
        own = words[at : at + n]
        at += n
        yield np.unique(gram_hashes(own, min(width, n))) if n else own


def node_of(elements: np.ndarray) -> int:
    """Id of a set: equal sets have equal ids. 56 bits of hash and the size's logarithm."""
    n = len(elements)
    h = int(mix(np.array([np.sum(mix(elements), dtype=np.uint64) + np.uint64(n)], np.uint64))[0])
    code = min(255, int(math.log(n) / math.log(_STEP)))
    value = (h >> 8 << 8) | code
    return value - (1 << 64) if value >> 63 else value


_BANDS: dict[int, tuple[list[int], list[int]]] = {}


def bands(percent: int) -> tuple[list[int], list[int]]:
    """(largest size of each band, its number of segments). Band i begins after the largest size of band i - 1."""
    if percent in _BANDS:
        return _BANDS[percent]
    tops, segments, low = [], [], 1
    while low < 1 << 40:
        top = max(low, int(low * (100 / percent) ** 2) - 1)
        most = differ(percent, top, top * 100 // percent)
        tops.append(top)
        segments.append(most + 1 if top <= DELETIONS_UP_TO else most + 2 + most // 20)
        low = top + 1
    return _BANDS.setdefault(percent, (tops, segments))


def differ(percent: int, a: int, b: int) -> int:
    """Elements that linked sets of sizes ``a`` and ``b`` differ in, at most."""
    return (100 - percent) * (a + b) // (100 + percent)


def allocate(sizes: np.ndarray, need: int, deletions: bool) -> np.ndarray:
    """Worth of each segment (0 left out, 1 equal, 2 with deletions), cheapest first, until their sum is ``need``."""
    worth = np.zeros(len(sizes), np.int8)
    if not deletions:
        worth[np.argsort(-np.minimum(sizes, 8), kind="stable")[:need]] = 1
        return worth
    cost = np.array(COSTS)
    equal = cost[np.minimum(sizes, 3)]
    # Deletions meet sets that are one element shorter, and those that are one longer.
    more = np.where(sizes > 0, (sizes + 1) * cost[np.minimum(np.maximum(sizes - 1, 0), 3)] + equal, 2 * cost[0])
    more = np.maximum(more, equal)  # so that an equal segment is always taken before its deletions
    order = np.argsort(np.concatenate([equal, more]), kind="stable")[:need]
    np.add.at(worth, order % len(sizes), 1)
    return worth


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """All signatures of a set, as 62 bits and its role in the lowest two: :data:`BOTH`, :data:`PROBE` or :data:`INDEX`."""
    n = len(elements)
    tops, segments = bands(percent)
    own = int(np.searchsorted(tops, n))
    out = []
    marks = mix(elements ^ np.uint64(0x5851F42D4C957F2D))
    for band in (own, own - 1):
        if band < 0 or (band < own and 100 * tops[band] < percent * n):
            continue
        m = segments[band]
        need = differ(percent, n, min(n, tops[band])) + 1
        place = ((marks >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)).astype(np.int64)
        sizes = np.bincount(place, minlength=m)
        deletions = tops[band] <= DELETIONS_UP_TO
        worth = allocate(sizes, need, deletions)
        order = np.argsort(place, kind="stable")
        content = np.zeros(m, np.uint64)
        full = np.flatnonzero(sizes)
        content[full] = np.add.reduceat(mix(marks)[order], (np.cumsum(sizes) - sizes)[full])
        base = mix((np.arange(m, dtype=np.uint64) << np.uint64(20)) + np.uint64(band + 1))
        roles = np.where(worth > 0, BOTH, INDEX) if band == own else np.full(m, PROBE)
        kept = np.ones(m, bool) if band == own else worth > 0
        out.append((mix(content + base) & ~np.uint64(3) | roles.astype(np.uint64))[kept])
        if deletions:
            less = mix(content[place] - mix(marks) + base[place]) & ~np.uint64(3)
            probed = worth[place] > 1
            out.append((less | np.where(probed, BOTH, INDEX).astype(np.uint64)) if band == own else (less | np.uint64(PROBE))[probed])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("node", pa.int64())])
_SIGS = pa.schema([("sig", pa.int64()), ("node", pa.int64())])
_MET = pa.schema([("key", pa.int64()), ("rep", pa.int64()), ("rep_role", pa.int8()), ("node", pa.int64()), ("role", pa.int8())])
_FULL = pa.schema([("node", pa.int64()), ("elements", pa.binary())])
_SHARED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("shared", pa.int64())])


def document_sets(picked: DataFrame, width: int) -> DataFrame:
    """doc_id, n_shingles and node (null without words) of every row."""

    def sets(rows: pa.RecordBatch) -> pa.RecordBatch:
        n, node = [], []
        for _, raws in blocks(rows.column(1).to_pylist()):
            for s in shingle_sets(raws, width):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
        return batch(_SETS, doc_id=rows.column(0), n_shingles=n, node=node)

    return arrow_map(picked, sets, "doc_id long, n_shingles long, node long")


def signature_rows(picked: DataFrame, width: int, percent: int) -> DataFrame:
    """(sig, node) of every set; copies within a task give theirs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for rows in batches:
            for _, raws in blocks(rows.column(0).to_pylist()):
                sigs, nodes, sizes = [], [], []
                for s in shingle_sets(raws, width):
                    if len(s) and (node := node_of(s)) not in seen:
                        if len(seen) >= 1 << 20:  # forgetting only means repeated signatures
                            seen.clear()
                        seen.add(node)
                        sigs.append(signatures(s, percent))
                        nodes.append(node)
                        sizes.append(len(sigs[-1]))
                if nodes:
                    yield batch(_SIGS, sig=np.concatenate(sigs).view(np.int64), node=np.repeat(np.array(nodes, np.int64), sizes))

    return picked.select("text").mapInArrow(run, "sig long, node long")


def meetings(sigs: DataFrame) -> DataFrame:
    """Members of every signature that several sets share and one of them probes, each with the first prober.

    Rows of a signature are sorted, probers first, and pass by: no group is held in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (key, first node, its role) of the group that may go on
        for rows in batches:
            if not rows.num_rows:
                continue
            sig, node = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            key, role = sig >> 2, (sig & 3).astype(np.int8)
            new = np.ones(len(key), bool)
            new[1:] = key[1:] != key[:-1]
            if last is not None and key[0] == last[0]:
                new[0] = False
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            rep, rep_role = node[first], role[first]
            if last is not None:
                going = first < 0
                rep[going], rep_role[going] = last[1], last[2]
            met = (node != rep) & (rep_role != INDEX)
            last = (key[-1], rep[-1], rep_role[-1])
            if met.any():
                yield batch(_MET, key=key[met], rep=rep[met], rep_role=rep_role[met], node=node[met], role=role[met])

    laid = sigs.withColumn("key", F.shiftright("sig", 2)).repartition("key").sortWithinPartitions("sig", "node").select("sig", "node")
    return laid.mapInArrow(run, "key long, rep long, rep_role byte, node long, role byte")


def _filter_of(ids: DataFrame, n: int, max_bits: int = 1 << 26) -> np.ndarray:
    """A Bloom filter of ``ids.id``: 8 MB at most. It only spares work; joins decide."""
    bits = min(max_bits, max(1 << 16, 1 << math.ceil(math.log2(32 * max(1, n)))))
    h = F.xxhash64("id")
    return bit_table(ids.select(F.explode(F.array(h.bitwiseAND(bits - 1), F.shiftrightunsigned(h, 32).bitwiseAND(bits - 1))).alias("slot")), bits)


def full_sets(nodes: DataFrame, picked: DataFrame, holders: DataFrame, width: int) -> tuple[DataFrame, Broadcast]:
    """(node, elements) of ``nodes.node``: sets are made again, of one document for each set asked for. The broadcast is the
    caller's to destroy once the rows are used."""
    asked = cut(nodes.select("node").distinct().join(holders, "node").select(F.coalesce("holder", F.lit(0)).alias("id")))
    flags = nodes.sparkSession.sparkContext.broadcast(_filter_of(asked, asked.count()))

    def full(rows: pa.RecordBatch) -> pa.RecordBatch | None:
        held = flags.value
        h = rows.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        a, b = ((x & np.uint64(len(held) * 8 - 1)).astype(np.int64) for x in (h, h >> np.uint64(32)))
        texts = rows.column(1).filter(pa.array(in_table(held, a) & in_table(held, b))).to_pylist()
        found = {}
        for _, raws in blocks(texts):
            for s in shingle_sets(raws, width):
                if len(s):
                    found[node_of(s)] = s.tobytes()
        return batch(_FULL, node=list(found), elements=list(found.values())) if found else None

    hashed = picked.select(F.xxhash64(F.coalesce("doc_id", F.lit(0).cast("long"))).alias("h"), "text")
    return arrow_map(hashed, full, "node long, elements binary"), flags


def overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, shared) of ``pairs`` (a, b)."""

    def overlap(rows: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {f: [] for f in _SHARED.names}
        for a, b, x, y in zip(*(rows.column(i).to_pylist() for i in range(4)), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate([x, y])
            both.sort()
            for name, value in zip(out, (a, b, len(x), len(y), int((both[1:] == both[:-1]).sum())), strict=True):
                out[name].append(value)
        return batch(_SHARED, **out)

    with_b = pairs.join(sets.select(F.col("node").alias("b"), F.col("elements").alias("eb")), "b")
    with_both = with_b.join(sets.select(F.col("node").alias("a"), F.col("elements").alias("ea")), "a").select("a", "b", "ea", "eb")
    return arrow_map(with_both, overlap, "a long, b long, n_a long, n_b long, shared long").distinct()


def verified(pairs: DataFrame, picked: DataFrame, holders: DataFrame, width: int) -> DataFrame:
    sets, flags = full_sets(pairs.select(F.explode(F.array("a", "b")).alias("node")), picked, holders, width)
    found = cut(overlaps(pairs, sets))
    flags.destroy()
    return found


def shared_counts(sets: list[np.ndarray], columns: int = 4096) -> np.ndarray:
    """Sizes of all intersections of ``sets``, by products of incidence matrices of so many elements at a time."""
    out = np.zeros((len(sets), len(sets)), np.float32)
    elements, at, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    kept = often > 1
    place = np.cumsum(kept) - 1
    row, at = row[kept[at]], place[at[kept[at]]]
    order = np.argsort(at, kind="stable")
    row, at = row[order], at[order]
    for lo in range(0, int(kept.sum()), columns):
        i, j = np.searchsorted(at, [lo, lo + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[row[i:j], at[i:j] - lo] = 1
        out += part @ part.T
    return out


def block_links(nodes: list[int], sets: list[np.ndarray], labels: list[int], percent: int) -> list[tuple[int, int]]:
    """Links between ``sets`` of different labels, as few as keep all of them that are linked together."""
    sizes = np.array([len(s) for s in sets], np.float64)
    shared = shared_counts(sets).astype(np.float64)
    linked = np.triu(100 * shared >= percent * (sizes[:, None] + sizes - shared), 1)
    parent = {x: x for x in labels}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
        a, b = find(labels[i]), find(labels[j])
        if a != b:
            parent[a] = b
            out.append((nodes[i], nodes[j]))
    return out


def small_group_pairs(rows: DataFrame, percent: int, reach: int) -> DataFrame:
    """(a, b) of a prober and an indexed set in one group with different labels, unless sizes or distances rule out a link.

    ``rows`` are (key, node, role, label, from, d) in groups of :data:`SMALL_GROUP` at most.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    limit = (100 - percent) / 100 + 1e-9

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs(group: list[tuple]) -> Iterator[tuple[int, int]]:
            for i, (n, role, label, start, d) in enumerate(group):
                for n2, role2, label2, start2, d2 in group[i + 1 :]:
                    if label == label2 or abs((n & 255) - (n2 & 255)) > reach or start == start2 and abs(d - d2) > limit:
                        continue
                    if role != INDEX and role2 != PROBE or role2 != INDEX and role != PROBE:
                        yield max(n, n2), min(n, n2)

        for batch_ in batches:
            found: set[tuple[int, int]] = set()
            for k, *rest in zip(*(batch_.column(i).to_pylist() for i in range(6)), strict=True):
                if k != key:
                    found.update(pairs(held))
                    key, held = k, []
                held.append(tuple(rest))
            if found:
                a, b = zip(*found, strict=True)
                yield batch(schema, a=list(a), b=list(b))
        if found := set(pairs(held)):
            a, b = zip(*found, strict=True)
            yield batch(schema, a=list(a), b=list(b))

    laid = rows.select("key", "node", "role", "label", "from", "d").repartition("key").sortWithinPartitions("key")
    return laid.mapInArrow(run, "a long, b long").distinct()


def rivals(sets: DataFrame, percent: int) -> DataFrame:
    """(node) of ``sets`` (node, elements; each once) that may link with another of them.

    Linked sets hold at least ``percent`` of each other's elements. Elements that one set alone has are counted for it; they
    are found by a count per element and need no comparison.
    """
    schema = pa.schema([("element", pa.int64()), ("node", pa.int64())])

    def spread(rows: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for node, raw in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
            elements = np.frombuffer(raw, np.int64)
            yield batch(schema, element=elements, node=np.full(len(elements), node))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            held, size = [], 0
            for part in spread(rows):
                held.append(part)
                size += part.num_rows
                if size > 1 << 16:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held, size = [], 0
            if held:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    alone = sets.select("node", "elements").mapInArrow(run, "element long, node long").groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node")).filter("n = 1")
    own = alone.groupBy("node").agg(F.count("*").alias("own"))
    over = 800 * F.coalesce("own", F.lit(0)) > (100 - percent) * F.octet_length("elements")  # 8 bytes an element
    return sets.join(own, "node", "left").filter(~over).select("node")


def family_links(members: DataFrame, sets: DataFrame, percent: int, reach: int) -> DataFrame:
    """Links (a, b) within the families of ``members`` (key, hub, node, label): sets that large groups hold together.

    A family is cut by size and by whether its sets are of its largest component, then by hash, into blocks of bounded bytes.
    Each two blocks that sizes allow to link meet in a group of two rows, unless both are of the largest component.
    """
    # Any function of the group serves as its family; this one lets groups that share sets fall together mostly.
    lead = members.groupBy("node").agg(F.min("hub").alias("lead"))
    family = members.join(lead, "node").groupBy("key").agg(F.min("lead").alias("family"))
    nodes = members.join(family, "key").select("family", "node", "label").distinct()
    held = nodes.groupBy("family", "label").agg(F.count("*").alias("n")).groupBy("family").agg(F.max(F.struct("n", "label"))["label"].alias("main"), F.count("*").alias("labels"))
    nodes = nodes.join(held.filter("labels > 1"), "family").select("family", "node", "label", (F.col("label") == F.col("main")).alias("of_main"), F.col("node").bitwiseAND(255).alias("size"))
    kinds = nodes.groupBy("family", "of_main", "size").agg(F.count("*").alias("n"))
    per_set = F.pow(F.lit(_STEP), F.col("size") + 1)
    kinds = kinds.withColumn("n", F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("n") * per_set / BLOCK_ELEMENTS)))
    kind, block = ["family", "of_main", "size"], F.struct("of_main", "size", "block")
    nodes = nodes.join(kinds, kind).withColumn("block", F.pmod(F.xxhash64("node"), "n")).drop("n")
    packed = cut(
        nodes.join(sets, "node").groupBy(*kind, "block")
        .agg(F.collect_list(F.struct("node", "label", "elements")).alias("held"))  # bounded by the number of blocks
    )
    one = packed.select("family", block.alias("one"))
    pairs = one.join(one.withColumnRenamed("one", "two"), "family").filter(
        (F.col("one") <= F.col("two")) & (F.abs(F.col("one.size") - F.col("two.size")) <= reach) & ~(F.col("one.of_main") & F.col("two.of_main")))
    met = pairs.withColumn("block", F.explode(F.array_distinct(F.array("one", "two"))))
    dealt = met.join(packed.select("family", block.alias("block"), "held"), ["family", "block"]).select("family", "one", "two", "held")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        rows = [r for held in group["held"].to_pylist() for r in held]
        links = block_links([r["node"] for r in rows], [np.frombuffer(r["elements"], np.uint64) for r in rows], [r["label"] for r in rows], percent)
        return pa.Table.from_batches([batch(schema, a=[x for x, _ in links], b=[y for _, y in links])])

    return dealt.groupBy("family", "one", "two").applyInArrow(run, "a long, b long").distinct()


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) in the order of u and v; each node u hands its larger neighbours (``large``), or all of them and itself, to
    the smallest node it knows. A node's neighbours pass by as a stream, however many; repeated edges count once."""
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # (u, v, smallest) of the row before
        for rows in batches:
            if not rows.num_rows:
                continue
            u, v = (rows.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            new = np.ones(len(u), bool)
            new[1:] = u[1:] != u[:-1]
            again = np.zeros(len(u), bool)
            again[1:] = ~new[1:] & (v[1:] == v[:-1])
            if last is not None and u[0] == last[0]:
                new[0], again[0] = False, v[0] == last[1]
            first = np.maximum.accumulate(np.where(new, np.arange(len(u)), -1))
            least = np.minimum(u, v)[first]
            least[first < 0] = last[2] if last is not None else 0
            last = (u[-1], v[-1], least[-1])
            if large:
                keep = (v > u) & ~again
                yield batch(schema, u=v[keep], v=least[keep])
            else:
                keep = (v != least) & ~again
                yield batch(schema, u=np.concatenate([v[keep], u[new]]), v=np.concatenate([least[keep], least[new]]))

    return edges.repartition("u").sortWithinPartitions("u", "v").mapInArrow(run, "u long, v long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that ``links`` (a, b) reach, for every node of a link.

    Alternating stars: each node hands its larger neighbours, then all its smaller ones, to the smallest it knows.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v"))
    state = None
    while True:
        sym = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        edges = cut(_stars(_stars(sym, True), False))
        got = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if state == tuple(got):
            break
        state = tuple(got)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def _mixed(members: DataFrame) -> DataFrame:
    """``members`` of groups with several labels, with the group's smallest node (hub) and whether it is large."""
    groups = (
        members.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.min("node").alias("hub"), F.count("*").alias("n"))
        .filter("lo <> hi").select("key", "hub", (F.col("n") > SMALL_GROUP).alias("large"))
    )
    return members.join(groups, "key")


def jaccard_links(picked: DataFrame, sets: DataFrame, width: int, percent: int) -> DataFrame:
    """(node, label) of every set with a link; sets without are missing."""
    holders = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("holder"))
    met = cut(meetings(signature_rows(picked, width, percent)))
    reach = math.ceil(math.log(100 / percent) / math.log(_STEP)) + 1
    near = F.abs(F.col("a").bitwiseAND(255) - F.col("b").bitwiseAND(255)) <= reach
    # The first prober that a set meets most often.
    first = (
        met.groupBy("node", "rep").agg(F.count("*").alias("n")).withColumnsRenamed({"rep": "a", "node": "b"}).filter(near)
        .groupBy("b").agg(F.max(F.struct("n", "a")).alias("x")).select("x.a", "b")
    )
    linked = (100 * F.col("shared") >= percent * (F.col("n_a") + F.col("n_b") - F.col("shared")))
    done = verified(first, picked, holders, width).withColumn("linked", linked)
    labels = cut(components(done.filter("linked").select("a", "b")))
    # Groups with several components: their members with labels, and the distance to the set they were verified against.
    members = met.select("key", "node", "role").unionByName(met.select("key", F.col("rep").alias("node"), F.col("rep_role").alias("role"))).distinct()
    away = done.select(F.col("b").alias("node"), F.col("a").alias("from"), (1 - F.col("shared") / (F.col("n_a") + F.col("n_b") - F.col("shared"))).alias("d"))
    members = cut(
        members.join(labels, "node", "left").join(away, "node", "left")
        .select("key", "node", "role", F.coalesce("label", "node").alias("label"), F.coalesce("from", "node").alias("from"), F.coalesce("d", F.lit(0.0)).alias("d"))
    )
    open_ = cut(_mixed(members))
    # Large groups without the sets that can link with none of theirs; what is left may be small.
    large = open_.filter("large").drop("hub", "large")
    sets, flags = full_sets(large, picked, holders, width)
    sets = cut(sets.dropDuplicates(["node"]))
    flags.destroy()
    open_ = cut(open_.filter("NOT large").unionByName(_mixed(large.join(rivals(sets, percent), "node", "left_semi"))))
    tried = done.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    rest = cut(small_group_pairs(open_.filter("NOT large"), percent, reach).join(tried, ["a", "b"], "left_anti"))
    more = verified(rest, picked, holders, width).filter(linked).select("a", "b")
    in_blocks = family_links(open_.filter("large"), sets, percent, reach)
    more = cut(more.unionByName(in_blocks))
    if more.isEmpty():
        return labels
    return components(done.filter("linked").select("a", "b").unionByName(more))


def jaccard_join(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach, itself included).

    Words are what white space leaves, A-Z lower-cased. Two rows link when ``100 * shared >= percent * united`` shingles; the
    result is exact up to 64-bit hashes of shingles. Null and empty texts link with nothing, so their component is their own
    id. Rows without an id take their component's smallest id (null if none has one). Equal texts, repeated rows too, are one
    set. Other columns are ignored; no rows give no rows.
    """
    picked = _picked(docs, id_col, text_col)
    sets = cut(document_sets(picked, width))
    labels = jaccard_links(picked, sets, width, percent)
    nodes = sets.filter("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("least"))
    placed = cut(nodes.join(labels, "node", "left").select("node", "least", F.coalesce("label", "node").alias("label")))
    of_label = placed.groupBy("label").agg(F.min("least").alias("component_id"))
    of_node = placed.select("node", "label").join(of_label, "label").select("node", "component_id")
    # Null nodes never join: they are dealt out with the rest by their ids.
    whole = sets.filter("node IS NOT NULL").join(of_node, "node").select("doc_id", "n_shingles", "component_id")
    return whole.unionByName(sets.filter("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"), width=4, percent=85)


QUERIES = {"op7_jaccard_join": (op7_jaccard_join, None)}
