"""SimHash near-duplicate grouping by a binary trie self-join.

Fingerprint: the text's A-Z are lower-cased, words are runs of bytes other than
ASCII white space, shingles are three words joined by one space, repeats included
(a shorter text is one shingle; a text without words has fingerprint zero). Every
shingle is hashed with XXH64 (seed 42); a bit of the fingerprint is 1 if it is set
in over half of the hashes.

Join: fingerprints that differ in at most three bits are linked. Of two such fingerprints,
some 16-bit quarter is equal and the next one, cyclically, differs in at most one bit: if
each equal quarter were followed by one with two bits or more, one equal quarter would
leave 2 + 1 + 1 bits in the others, and two would leave 2 + 2. So the fingerprints are
turned by each quarter in turn and put in a trie, whose first 16 levels have a budget of
no bit, the next 16 of one, the rest of three in all. Pairs of its nodes are walked together,
bit by bit; differing bits are added up, and a pair of nodes is dropped once it exceeds
the budget.

The top of the walk is made of joins: a node of the first 16 levels is one task's, unless it
has over NODE_ROWS fingerprints. Such a crowded pair of nodes is taken STEP levels down:
of its two nodes' children, those pairs go on that keep within the budget (of 256 children,
9 partners each with one bit left), until a pair is small enough for a task. So a
fingerprint is copied by the budget's number of partners, not by how many rows its node has.
The rest of the walk is within tasks, over all their pairs at once. A task returns a
spanning forest of the links it has found, not the links.

Groups: alternating large-star and small-star steps over those forests, with a
checkpoint after each; no component is gathered anywhere.

Defined results: null text counts as empty; all texts without words have fingerprint
zero and are linked like any other; a null doc_id never names a component unless the
component has no other; repeated rows and ids are kept as rows; an empty table gives
an empty result; further columns of the input are ignored here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.llm.shared import cut, fresh

BITS, QUARTER, SEED = 64, 16, 42
SHINGLE_WORDS = 3
MAX_BITS = 3
#: Fingerprints of one pair of trie nodes that a task takes at most; a larger pair is split.
NODE_ROWS = 2048
#: Levels by which it is split.
STEP = 8
#: Edges of one node that a join may deal to one task; larger nodes, at most 2 x HUB_ROWS of them, are joined by broadcast.
HUB_ROWS = 10_000
#: Hashes that are turned into bits at once.
_BLOCK = 1 << 15


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    w = text.lower().split()
    if not w:
        return 0
    if len(w) <= words:
        shingles = [b" ".join(w)]
    elif words == 3:
        shingles = [b"%b %b %b" % x for x in zip(w, w[1:], w[2:], strict=False)]
    else:
        shingles = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(s, SEED) for s in shingles), dtype="<u8", count=len(shingles))
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), _BLOCK):
        block = hashes[i : i + _BLOCK]
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp, text_hash) for every row of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py() or b"", words) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64()), b.column(1)], ["doc_id", "fp", "text_hash"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, fp long, text_hash long")


def _components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each item's component; a, b: the ends of the links."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
        if len(a) and np.array_equal(before, label):
            break
    return label


def _budget(depth: int, max_bits: int) -> int:
    """Differing bits that a pair of nodes may have above this depth."""
    return 0 if depth <= QUARTER else max_bits // 2 if depth <= 2 * QUARTER else max_bits


def trie_links(codes: np.ndarray, starts: np.ndarray, max_bits: int = MAX_BITS, splits: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Positions of linked codes within each group; codes: ascending and distinct in each group, which start at `starts`.

    A group is one node, paired with itself, or two, of which the second starts at `splits`
    (a group's start means one node). All groups are walked at once: a node is a range of
    positions, a pair of nodes two ranges and the bits in which their prefixes differ.
    """
    lo = np.asarray(starts, dtype=np.int64)
    hi = np.append(lo[1:], len(codes)).astype(np.int64)
    mid = lo if splits is None else np.asarray(splits, dtype=np.int64)
    keep = hi - lo > 1
    lo, mid, hi = lo[keep], mid[keep], hi[keep]
    a0, a1, b0, b1, bits = lo, np.where(mid > lo, mid, hi), mid, hi, np.zeros(len(lo), dtype=np.int8)
    left: list[np.ndarray] = []
    right: list[np.ndarray] = []

    def settle(a0, a1, b0, b1):
        """Small pairs of nodes are compared leaf by leaf."""
        na, nb = a1 - a0, b1 - b0
        size = na * nb
        at = np.repeat(np.arange(len(size)), size)
        k = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        x, y = a0[at] + k // nb[at], b0[at] + k % nb[at]
        ok = x < y
        x, y = x[ok], y[ok]
        diff = codes[x] ^ codes[y]
        top = np.bitwise_count(diff >> np.uint64(2 * QUARTER))
        ok = (top <= _budget(2 * QUARTER, max_bits)) & (np.bitwise_count(diff) <= max_bits)
        left.append(x[ok])
        right.append(y[ok])

    for depth in range(QUARTER, BITS):
        if not len(a0):
            break
        small = (a1 - a0) * (b1 - b0) <= 16
        if small.any():
            settle(a0[small], a1[small], b0[small], b1[small])
            a0, a1, b0, b1, bits = (v[~small] for v in (a0, a1, b0, b1, bits))
        ones = np.concatenate([[0], np.cumsum((codes >> np.uint64(BITS - 1 - depth)) & np.uint64(1), dtype=np.int64)])
        am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
        same = a0 == b0
        more = bits + 1
        free = more <= _budget(depth + 1, max_bits)
        cross = free & ~same
        parts = [
            (a0, am, b0, bm, bits),
            (am, a1, bm, b1, bits),
            tuple(v[free] for v in (a0, am, bm, b1, more)),
            tuple(v[cross] for v in (am, a1, b0, bm, more)),
        ]
        a0, a1, b0, b1, bits = (np.concatenate([p[i] for p in parts]) for i in range(5))
        some = (a1 > a0) & (b1 > b0) & ~((a0 == b0) & (a1 - a0 < 2))
        a0, a1, b0, b1, bits = (v[some] for v in (a0, a1, b0, b1, bits))
    if len(a0):  # leaves
        left.append(a0)
        right.append(b0)
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _prefix(depth: int) -> Column:
    return F.shiftrightunsigned("code", BITS - depth)


def deal(distinct: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(by, depth, a, b, code, fp) of distinct fingerprints (fp): the members of each pair of nodes (a, b) that one task walks.

    code: the fingerprint turned left by `by` bits; a, b: its first `depth` bits.
    """
    turn = F.expr("shiftleft(fp, by) | if(by = 0, 0L, shiftrightunsigned(fp, 64 - by))")
    turns = distinct.select("fp", F.explode(F.array(*[F.lit(q * QUARTER) for q in range(BITS // QUARTER)])).alias("by")).withColumn("code", turn)
    at = turns.withColumn("p", _prefix(QUARTER))
    crowded = cut(at.groupBy("by", "p").count().where(F.col("count") > node_rows).select("by", F.col("p").alias("a"), F.col("p").alias("b"), F.lit(0).alias("used")))
    whole = lambda df, depth: df.select("by", F.lit(depth).alias("depth"), "a", "b", "code", "fp")
    if crowded.isEmpty():
        return whole(at.withColumns({"a": F.col("p"), "b": F.col("p")}), QUARTER)
    nodes = crowded.select("by", F.col("a").alias("p"))
    out = whole(at.join(nodes, ["by", "p"], "left_anti").withColumns({"a": F.col("p"), "b": F.col("p")}), QUARTER)
    live = cut(at.join(nodes, ["by", "p"], "left_semi").select("by", "code", "fp"))
    low = (1 << STEP) - 1
    for depth in range(QUARTER + STEP, BITS + 1, STEP):
        kids = cut(live.groupBy("by", _prefix(depth).alias("kid")).agg(F.count("*").alias("n")).withColumn("parent", F.shiftrightunsigned("kid", STEP)))
        left = crowded.join(kids.select("by", F.col("parent").alias("a"), F.col("kid").alias("x"), F.col("n").alias("nx")), ["by", "a"])
        partners = F.array()
        for more in range(max_bits + 1):
            masks = F.array(*[F.lit(m).cast("long") for m in range(low + 1) if m.bit_count() <= more])
            partners = F.when(F.lit(_budget(depth, max_bits)) - F.col("used") == more, masks).otherwise(partners)
        left = left.withColumn("mask", F.explode(partners))
        left = left.withColumn("y", F.shiftleft("b", STEP).bitwiseOR(F.col("x").bitwiseAND(F.lit(low)).bitwiseXOR(F.col("mask"))))
        pairs = left.join(kids.select("by", F.col("kid").alias("y"), F.col("n").alias("ny")), ["by", "y"]).where("a != b or x <= y")
        rows = F.when(F.col("x") == F.col("y"), F.col("nx")).otherwise(F.col("nx") + F.col("ny"))
        pairs = cut(pairs.where(rows > 1).select("by", F.col("x").alias("a"), F.col("y").alias("b"), (F.col("used") + F.bit_count("mask")).cast("int").alias("used"), rows.alias("rows")))
        small = pairs.where((F.col("rows") <= node_rows) | F.lit(depth == BITS))
        ends = F.explode(F.when(F.col("a") == F.col("b"), F.array("a")).otherwise(F.array("a", "b"))).alias("p")
        out = out.unionByName(whole(live.withColumn("p", _prefix(depth)).join(small.select("by", "a", "b", ends), ["by", "p"]), depth))
        crowded = pairs.where(F.col("rows") > node_rows).select("by", "a", "b", "used")
        if depth == BITS or crowded.isEmpty():
            return out
        live = cut(live.withColumn("p", _prefix(depth)).join(crowded.select("by", ends).distinct(), ["by", "p"], "left_semi").select("by", "code", "fp"))
    return out


def forests(distinct: DataFrame, max_bits: int = MAX_BITS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(u, v) with u < v: for distinct fingerprints (fp), forests whose components are those of all links."""
    if not 0 <= max_bits <= 3:
        raise ValueError("max_bits must be 0 to 3: above that, no quarter need be equal")
    keys = ("by", "depth", "a", "b")
    dealt = deal(distinct, max_bits, node_rows).withColumn("code", F.expr("code ^ (-9223372036854775807L - 1L)"))  # signed order is then unsigned order
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys, "code")

    def linked(keys: np.ndarray, code: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
        depth = keys[:, 1].astype(np.uint64)
        first = code[np.repeat(starts, np.diff(np.append(starts, len(code))))]
        other = np.flatnonzero((code ^ first) >> (np.uint64(BITS) - depth))  # the second node's rows
        splits = starts.copy()
        group = np.searchsorted(starts, other, side="right") - 1
        group, at = np.unique(group, return_index=True)
        splits[group] = other[at]
        a, b = trie_links(code, starts, max_bits, splits)
        label = _components(len(code), a, b)
        member = np.flatnonzero(label != np.arange(len(code)))
        x, y = fp[label[member]], fp[member]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(4)], axis=1)
            code = batch.column(4).to_numpy().view(np.uint64) ^ np.uint64(1 << 63)
            held.append((keys, code, batch.column(5).to_numpy()))
            keys, code, fp = (np.concatenate([h[i] for h in held]) for i in range(3))
            end = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            if end:  # the last group may go on in the next batch
                yield linked(keys[:end], code[:end], fp[:end])
            held = [(keys[end:], code[end:], fp[end:])]
        if held:
            yield linked(*held[0])

    return dealt.select(*keys, "code", "fp").mapInArrow(run, "u long, v long").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """(node, root): each node that has an edge (u, v), with the smallest node of its component."""

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def with_least(edges: DataFrame, by: str, least: Column) -> DataFrame:
        """edges with m, the least of their node `by`; the root of a large component is no hot key of the join."""
        low = edges.groupBy(by).agg(least.alias("m"), F.count("*").alias("n"))
        if now[0] <= hub:  # no node can have more edges
            return edges.join(low.drop("n"), by)
        low = cut(low)
        hubs = F.broadcast(low.where(F.col("n") > hub).drop("n"))
        few = edges.join(hubs.select(by), by, "left_anti").join(low.where(F.col("n") <= hub).drop("n"), by)
        return few.unionByName(edges.join(hubs, by))

    edges = cut(edges.where("u < v"))
    now = state(edges)
    while now[0]:
        hub = max(HUB_ROWS, 2 * now[0] // HUB_ROWS)  # so there are at most 2 x HUB_ROWS hubs, as both has 2 x now[0] rows
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = cut(with_least(both, "u", F.least(F.min("v"), F.first("u"))).where("v > u").select(F.col("m").alias("u"), "v").distinct())
        small = with_least(large, "v", F.min("u")).select(F.explode(F.array("u", "v")).alias("w"), "m").where("w > m").select(F.col("m").alias("u"), F.col("w").alias("v")).distinct()
        edges, before = cut(small), now
        now = state(edges)
        if now == before:
            break
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def near_duplicates(docs: DataFrame, max_bits: int = MAX_BITS, words: int = SHINGLE_WORDS, node_rows: int = NODE_ROWS) -> DataFrame:
    """(doc_id, fp, component_id, root, text_hash) for every row of docs (doc_id, text).

    component_id: the smallest doc_id reachable; root: the component's smallest fingerprint, which
    tells components without an id apart; text_hash: tells rows of one id apart.
    """
    prints = cut(fingerprints(docs, words))
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_doc")))
    star = stars(forests(distinct.select("fp"), max_bits, node_rows))
    members = star.join(distinct, star.node == distinct.fp).select("fp", "root", "first_doc")
    roots = members.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = members.join(roots, "root").select("fp", "component_id", "root")
    # cut, so that the last join is of two plain exchanges, of which Spark can split a hot fingerprint's
    named = cut(distinct.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"), F.coalesce("root", "fp").alias("root")))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each group: that of the smallest doc_id; of several rows with it, that of the smallest text hash."""
    return keep_first(docs, near_duplicates(docs, **options))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """docs with the row of each group that drop_near_duplicates keeps; groups: (doc_id, component_id, root, text_hash)."""
    groups = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    counted = groups.groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    first = cut(counted.groupBy("root").agg(F.min("text_hash").alias("text_hash"), F.min_by(F.struct("doc_id", "rows"), "text_hash").alias("of")).select("of.*", "text_hash"))
    key, tie = fresh(docs, "first_doc"), fresh(docs, "first_hash")
    is_first = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.xxhash64("text") == F.col(tie))
    kept = lambda rows: docs.join(first.where(rows).select(F.col("doc_id").alias(key), F.col("text_hash").alias(tie)), is_first, "left_semi")
    if first.where("rows > 1").isEmpty():
        return kept(F.lit(True))
    return kept(F.col("rows") == 1).unionByName(kept(F.col("rows") > 1).dropDuplicates(["doc_id", "text"]))
