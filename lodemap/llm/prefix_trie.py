"""Trie of conversation prefixes, with count-min screening of prefix digests.

Every prefix of a conversation has a digest: a polynomial over the hashes of its turns modulo the prime 2^127 - 1, taken
along rows that are spread by ranges, so that one very long conversation is shared out too; digests of two parts combine, so
pieces of a conversation are joined by numbers per partition, and a conversation that takes its first turns from another
one needs only that one's first digests.

A count-min sketch counts all prefixes. It never counts too low: an estimate of one proves that a prefix is in a single
conversation, and so is all that follows. Such tails become nodes where they lie. Only prefixes that may be shared are
shuffled and grouped exactly.

Sums over subtrees need no walk over levels. The smallest member of a node is its owner, and a conversation that owns a node
owns all nodes after it on its path. So each conversation has one depth from which on it owns its nodes, and children,
leaves and bytes below a node are sums over the node's members of what each of them owns.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodemap.llm.common import arrow_map, batch, bit_table, cut, in_table, mix, table

PRIME = (1 << 127) - 1
BASE = 0x3C6EF372FE94F82A9E3779B97F4A7C15 % PRIME

#: Rows of the sketch, and the most cells of one row: 8 MB of bits in all.
SKETCH_ROWS = 4
MOST_CELLS = 1 << 24
#: Bytes of ids that are hashed at once.
CHUNK = 1 << 16

_LOW = (1 << 64) - 1


def _pair(digest: int) -> tuple[int, int]:
    low = digest & _LOW
    return digest >> 64, low - (1 << 64) if low >> 63 else low


def _digest(hi: int, lo: int) -> int:
    return hi << 64 | lo & _LOW


def _turn(role: str | None, text: str | None) -> tuple[bytes, int]:
    """(digest, UTF-8 bytes of the text) of one turn."""
    role, raw = (role or "").encode(), (text or "").encode()
    return blake2b(len(role).to_bytes(8) + role + raw, digest_size=16).digest(), len(raw)


_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("digest", pa.binary()), ("bytes", pa.int64())])
_PREFIX = [("hi", pa.int64()), ("lo", pa.int64()), ("phi", pa.int64()), ("plo", pa.int64()), ("bytes", pa.int64()), ("cum", pa.int64())]
_LAID = pa.schema([("conv_id", pa.int64()), ("piece", pa.int32()), ("pos", pa.int64()), *_PREFIX])
_PLACED = pa.schema([("conv_id", pa.int64()), ("pos", pa.int64()), *_PREFIX])
_FIELDS = [("conv_id", pa.int64()), ("depth", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("phi", pa.int64()), ("plo", pa.int64()), ("bytes", pa.int64()),
           ("before", pa.int64()), ("length", pa.int64()), ("total", pa.int64())]
_ROWS = pa.schema(_FIELDS)
_MARKED = pa.schema([*_FIELDS, ("shared", pa.bool_()), ("parent_shared", pa.bool_())])
_ENDS = pa.schema([("depth", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("first", pa.int64()), ("ids", pa.binary())])
_SHA = pa.schema([("depth", pa.int64()), ("hi", pa.int64()), ("lo", pa.int64()), ("sha", pa.string())])


def ddl(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.binary(): "binary", pa.string(): "string", pa.bool_(): "boolean"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, digest and bytes of every row that has a conversation."""

    def run(rows: pa.RecordBatch) -> pa.RecordBatch:
        digests, sizes = zip(*map(_turn, rows.column(2).to_pylist(), rows.column(3).to_pylist()), strict=True) if rows.num_rows else ((), ())
        return batch(_TURNS, conv_id=rows.column(0), turn=rows.column(1), digest=list(digests), bytes=list(sizes))

    c = conversations
    picked = c.select(c["conv_id"].cast("long").alias("conv_id"), c["turn"].cast("long").alias("turn"), c["role"].cast("string").alias("role"), c["text"].cast("string").alias("text"))
    return arrow_map(picked.filter("conv_id IS NOT NULL"), run, ddl(_TURNS))


def positions(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest of the prefix up to the turn (hi, lo) and before it (phi, plo), bytes, cum (bytes so far)."""

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = TaskContext.get().partitionId()
        conv, pos, digest, cum = None, 0, 0, 0
        for rows in batches:
            out: list[list] = [[] for _ in range(7)]
            for c, raw, size in zip(rows.column(0).to_pylist(), rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True):
                if c != conv:
                    conv, pos, digest, cum = c, 0, 0, 0
                before = digest
                pos, digest, cum = pos + 1, (digest * BASE + int.from_bytes(raw) + 1) % PRIME, cum + size
                for column, value in zip(out, (pos, *_pair(digest), *_pair(before), size, cum), strict=True):
                    column.append(value)
            if rows.num_rows:
                yield batch(_LAID, conv_id=rows.column(0), piece=[piece] * rows.num_rows, **dict(zip(("pos", *(n for n, _ in _PREFIX)), out, strict=True)))

    order = ("conv_id", "turn", "digest")  # nulls first
    laid = cut(turns(conversations).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(lay, ddl(_LAID)))
    # The last row of each partition, one each: what conversations that go on in the next one bring along.
    lasts = laid.groupBy("piece").agg(F.max(F.struct("conv_id", "pos", "hi", "lo", "cum")).alias("x")).select("piece", "x.*").collect()
    carried: dict[int, tuple] = {}
    for r in sorted(lasts):
        pos, digest, cum = r["pos"], _digest(r["hi"], r["lo"]), r["cum"]
        before = carried.get(-1)
        if before and before[0] == r["conv_id"]:
            pos, digest, cum = before[1] + pos, (before[2] * pow(BASE, pos, PRIME) + digest) % PRIME, before[3] + cum
        if before:
            carried[r["piece"]] = before
        carried[-1] = (r["conv_id"], pos, digest, cum)

    def place(rows: pa.RecordBatch) -> pa.RecordBatch:
        out = {n: rows.column(n).to_numpy(zero_copy_only=False).copy() for n in _PLACED.names}
        for piece in np.unique(rows.column("piece").to_numpy(zero_copy_only=False)).tolist():
            if piece not in carried:
                continue
            conv, pos, digest, cum = carried[piece]
            for i in np.flatnonzero((out["conv_id"] == conv) & (rows.column("piece").to_numpy(zero_copy_only=False) == piece)).tolist():
                k = int(out["pos"][i])
                for hi, lo, n in (("hi", "lo", k), ("phi", "plo", k - 1)):
                    out[hi][i], out[lo][i] = _pair((digest * pow(BASE, n, PRIME) + _digest(int(out[hi][i]), int(out[lo][i]))) % PRIME)
                out["pos"][i] += pos
                out["cum"][i] += cum
        return batch(_PLACED, **out)

    return arrow_map(laid, place, ddl(_PLACED))


def prefixes(conversations: DataFrame, base: Column | None = None, take: Column | None = None, most: int = 0) -> DataFrame:
    """One row per conversation and prefix, the empty one (depth 0) included.

    Columns: conv_id, depth, hi, lo (digest), phi, plo (digest of the prefix one turn shorter), bytes (of the last text),
    before (bytes of the texts before it), length (turns of the conversation), total (its bytes).

    ``base`` and ``take`` (expressions over conv_id; ``take`` is at most ``most``) rebuild each conversation: the first
    ``take`` turns of conversation ``base`` (all if it has fewer, none if it is missing), then its own after its first
    ``take``.
    """
    rows = cut(positions(conversations))
    head = F.array_sort(F.collect_list(F.when(F.col("pos") <= most, F.struct("pos", "hi", "lo", "bytes", "cum"))))  # ``most`` at most
    convs = cut(rows.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("cum").alias("own_total"), head.alias("head")))
    convs = convs.withColumn("base", base if base is not None else F.col("conv_id")).withColumn("take", (take if take is not None else F.lit(0)).cast("long"))
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"), F.col("head").alias("base_head"))
    at = lambda column, i, field: F.when(i > 0, F.try_element_at(column, i.cast("int"))[field]).otherwise(F.lit(0).cast("long"))
    info = convs.join(bases, "base", "left").withColumn("taken", F.least("take", F.coalesce("n_base", F.lit(0).cast("long"))))
    own = F.col("n") > F.col("take")
    info = cut(info.select(
        "conv_id", "n", "take", "taken", "base_head", (F.col("taken") + F.greatest(F.col("n") - F.col("take"), F.lit(0))).alias("length"),
        *[at(F.col("base_head"), F.col("taken"), f).alias(f"b_{f}") for f in ("hi", "lo", "cum")],
        *[F.when(own, at(F.col("head"), F.col("take"), f)).otherwise(F.lit(0).cast("long")).alias(f"o_{f}") for f in ("hi", "lo", "cum")],
        "own_total", own.alias("own"),
    ).withColumn("total", F.col("b_cum") + F.when(F.col("own"), F.col("own_total") - F.col("o_cum")).otherwise(0)))
    d, bh = F.col("depth"), F.col("base_head")
    heads = info.select("conv_id", "base_head", "length", "total", F.explode(F.sequence(F.lit(0).cast("long"), F.col("taken"))).alias("depth")).select(
        "conv_id", "depth", at(bh, d, "hi").alias("hi"), at(bh, d, "lo").alias("lo"), at(bh, d - 1, "hi").alias("phi"), at(bh, d - 1, "lo").alias("plo"),
        at(bh, d, "bytes").alias("bytes"), at(bh, d - 1, "cum").alias("before"), "length", "total",
    )

    def splice(part: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in _ROWS.names}
        for r in part.to_pylist():
            j = r["pos"] - r["take"]
            shift = (_digest(r["b_hi"], r["b_lo"]) - _digest(r["o_hi"], r["o_lo"])) % PRIME
            hi, lo, phi, plo = r["hi"], r["lo"], r["phi"], r["plo"]
            if shift:
                to = shift * pow(BASE, j - 1, PRIME)
                phi, plo = _pair((to + _digest(phi, plo)) % PRIME)
                hi, lo = _pair((to * BASE + _digest(hi, lo)) % PRIME)
            before = r["cum"] - r["bytes"] - r["o_cum"] + r["b_cum"]
            for name, value in zip(_ROWS.names, (r["conv_id"], r["taken"] + j, hi, lo, phi, plo, r["bytes"], before, r["length"], r["total"]), strict=True):
                out[name].append(value)
        return batch(_ROWS, **out)

    kept = rows.join(info.filter("own").drop("base_head", "n", "own_total", "own"), "conv_id").filter("pos > take")
    return heads.unionByName(arrow_map(kept, splice, ddl(_ROWS)))


def _cells(depth: np.ndarray, hi: np.ndarray, lo: np.ndarray, width: int) -> np.ndarray:
    """Cell of each prefix in each row of the sketch, row after row."""
    a, b = mix(lo.view(np.uint64) + depth.view(np.uint64)), mix(hi.view(np.uint64)) | np.uint64(1)
    rows = [mix(a + np.uint64(r) * b) & np.uint64(width - 1) | np.uint64(r * width) for r in range(SKETCH_ROWS)]
    return np.stack(rows).astype(np.int64)


def sketch(rows: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(cells of the count-min sketch that were met more than once, as bits; width of a row). Screening asks no more of counts."""
    width = min(MOST_CELLS, max(1 << 14, 1 << math.ceil(math.log2(4 * max(1, n)))))
    schema = pa.schema([("slot", pa.int64()), ("n", pa.int64())])

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        depth, hi, lo = (part.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        slot, count = np.unique(_cells(depth, hi, lo, width), return_counts=True)
        return batch(schema, slot=slot, n=np.minimum(count, 2))

    counts = arrow_map(rows.select("depth", "hi", "lo"), run, ddl(schema)).groupBy("slot").agg(F.sum("n").alias("n"))
    return bit_table(counts.filter("n > 1"), SKETCH_ROWS * width), width


def ends(rows: DataFrame) -> DataFrame:
    """SHA-256 of the ids of ``rows`` (depth, hi, lo, conv_id) per node, ascending, comma-joined.

    Rows are spread by ranges and put together to long strings there; only these pass, in order, through one hash per node.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, first, held, size = None, 0, [], 0

        def out() -> pa.RecordBatch:
            return batch(_ENDS, depth=[node[0]], hi=[node[1]], lo=[node[2]], first=[first], ids=[b",".join(held)])

        done: list[pa.RecordBatch] = []
        for part in batches:
            for *key, conv in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                if key != node or size > CHUNK:
                    if held:
                        done.append(out())
                    node, first, held, size = key, conv, [], 0
                held.append(b"%d" % conv)
                size += len(held[-1]) + 1
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
                done = []
        if held:
            yield out()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for part in batches:
            found = []
            for *key, ids in zip(*(part.column(i).to_pylist() for i in (0, 1, 2, 4)), strict=True):
                if key != node:
                    if node:
                        found.append((*node, sha.hexdigest()))
                    node, sha = key, sha256(ids)
                else:
                    sha.update(b"," + ids)
            if found:
                yield batch(_SHA, **dict(zip(_SHA.names, zip(*found, strict=True), strict=True)))
        if node:
            yield batch(_SHA, depth=[node[0]], hi=[node[1]], lo=[node[2]], sha=[sha.hexdigest()])

    order = ("depth", "hi", "lo", "conv_id")
    chunks = rows.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, ddl(_ENDS))
    return chunks.repartition("depth", "hi", "lo").sortWithinPartitions("depth", "hi", "lo", "first").mapInArrow(hashed, ddl(_SHA))


def trie(rows: DataFrame) -> DataFrame:
    """Nodes of :func:`prefixes`; see :func:`prefix_trie`."""
    spark = rows.sparkSession
    rows = cut(rows)
    size = rows.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    flags, width = sketch(rows, size["n"])
    sent = spark.sparkContext.broadcast(flags)

    def mark(part: pa.RecordBatch) -> pa.RecordBatch:
        depth, hi, lo, phi, plo = (part.column(n).to_numpy(zero_copy_only=False) for n in ("depth", "hi", "lo", "phi", "plo"))
        shared = in_table(sent.value, _cells(depth, hi, lo, width)).all(0)
        above = in_table(sent.value, _cells(depth - 1, phi, plo, width)).all(0) & (depth > 0)
        return batch(_MARKED, **{n: part.column(n) for n in _ROWS.names}, shared=shared, parent_shared=above)

    marked = arrow_map(rows.select(*_ROWS.names), mark, ddl(_MARKED))
    key = ["depth", "hi", "lo"]
    ending = F.col("depth") == F.col("length")
    alone = F.when(ending, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(F.sha2(F.lit("").cast("binary"), 256))
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    single = ["conv_id", "depth", one.alias("n_convs"), (~ending).cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), alone.alias("ends_sha256")]
    # Proven singletons below proven singletons: their parent has the same only member.
    tails = marked.filter("NOT shared AND NOT parent_shared").select(*single, F.when(F.col("depth") > 0, F.col("conv_id")).alias("parent_conv_id"))
    shared = cut(marked.filter("shared").drop("shared", "parent_shared"))
    tops = cut(marked.filter("NOT shared AND (parent_shared OR depth = 0)").drop("shared", "parent_shared"))

    owners = cut(shared.groupBy(*key).agg(F.min(F.struct("conv_id", "before")).alias("o"), F.max("length").alias("longest")))
    owned = owners.select("o.conv_id", "depth", "o.before", (F.col("longest") == F.col("depth")).alias("leaf"))
    owned = owned.unionByName(tops.select("conv_id", "depth", "before", F.lit(True).alias("leaf")))
    own = owned.groupBy("conv_id").agg(F.min(F.struct("depth", "before")).alias("x"), F.max("leaf").alias("leaf")).select(
        "conv_id", F.col("x.depth").alias("own_depth"), F.col("x.before").alias("own_before"), "leaf")
    next_ = F.col("depth") + 1
    nodes = shared.join(own, "conv_id", "left").groupBy(*key).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("phi").alias("phi"), F.min("plo").alias("plo"),
        F.sum(F.when((F.col("own_depth") <= next_) & (next_ <= F.col("length")), 1).otherwise(0)).alias("n_children"),
        F.sum(F.when(F.col("leaf"), 1).otherwise(0)).alias("n_leaves"),
        F.sum(F.greatest(F.coalesce("own_before", "total") - F.col("before"), none)).alias("saved_tokens"),
    )
    ids = ends(shared.filter(ending))
    nodes = nodes.join(ids, key, "left").withColumn("ends_sha256", F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)))
    below = nodes.select("conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "phi", "plo")
    below = below.unionByName(tops.filter("depth > 0").select(*single, "phi", "plo"))
    # All conversations meet in the root: its owner is the smallest conversation of all.
    first = below.filter("depth < 2").withColumn("parent_conv_id", F.when(F.col("depth") > 0, F.lit(size["least"]).cast("long"))).drop("phi", "plo")
    above = owners.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("o.conv_id").alias("above"))
    deeper = below.filter("depth > 1").join(above, ["depth", "phi", "plo"], "left").withColumn("parent_conv_id", F.coalesce("above", "conv_id")).drop("above", "phi", "plo")
    return tails.unionByName(first).unionByName(deeper).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, base: Column | None = None, take: Column | None = None, most: int = 0) -> DataFrame:
    """One row per distinct prefix of the conversations (conv_id, turn, role, text): conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns come by number, null first; turns of one number by the hash of role and text, so repeated rows are repeated turns.
    Null roles and texts are empty. Rows without a conversation id belong to none and give nothing. Empty tables give no
    rows. Other columns are ignored. Prefixes are told apart by digests of 127 bits. For ``base`` and ``take`` see
    :func:`prefixes`.
    """
    return trie(prefixes(conversations, base, take, most))


#: The query's conversations take up to so many turns less one from the first of their five.
TAKE = 9


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    take = F.crc32(c.cast("string").cast("binary")) % TAKE
    return prefix_trie(table(spark, sf_dir, "conversations"), c - c % 5, take, TAKE - 1)


_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i, 1))::BIGINT)),
  lambda h, b: list_reduce([xor(h, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END)), 4294967295)"""
ORACLE = f"""
WITH own AS (
  SELECT conv_id AS c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS w
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
h AS (SELECT c, w, {_CRC} % {TAKE} AS h FROM own),
built AS (SELECT h.c, list_concat(coalesce(b.w, [])[1:h.h], h.w[h.h + 1:]) AS w FROM h LEFT JOIN own b ON b.c = h.c - h.c % 5),
p AS (SELECT c, len(w) AS n, d, sha256(w[1:d]::VARCHAR || '|' || d) AS k, CASE WHEN d > 0 THEN sha256(w[1:d - 1]::VARCHAR || '|' || (d - 1)) END AS pk,
             CASE WHEN d > 0 THEN strlen(w[d].t) ELSE 0 END AS b
      FROM (SELECT c, w, unnest(range(0, len(w) + 1)) AS d FROM built)),
node AS (
  SELECT k, any_value(pk) AS pk, d AS depth, min(c) AS conv_id, count(*) AS n_convs, any_value(b) AS b,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (n = d), '')) AS ends_sha256
  FROM p GROUP BY k, d
),
kids AS (SELECT pk AS k, count(*) AS n_children FROM node WHERE pk IS NOT NULL GROUP BY pk),
under AS (SELECT DISTINCT a.k, b.k AS below FROM p a JOIN p b ON a.c = b.c AND a.d <= b.d),
sums AS (
  SELECT under.k, count(*) FILTER (kids.k IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.b) AS saved_tokens
  FROM under JOIN node x ON x.k = under.below LEFT JOIN kids ON kids.k = x.k GROUP BY under.k
)
SELECT node.conv_id, node.depth, up.conv_id AS parent_conv_id, node.n_convs, coalesce(kids.n_children, 0) AS n_children, sums.n_leaves,
       CAST(sums.saved_tokens AS BIGINT) AS saved_tokens, node.ends_sha256
FROM node JOIN sums USING (k) LEFT JOIN kids USING (k) LEFT JOIN node up ON up.k = node.pk"""

QUERIES = {"op13_prefix_trie": (op13_prefix_trie, ORACLE)}
