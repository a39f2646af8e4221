"""SimHash near-duplicates by a self-join of binary tries.

Fingerprints of 64 bits that differ in two bits or fewer share at least two of their four blocks of 16 bits.
Distinct fingerprints are therefore dealt out by each of the six pairs of blocks: a deal is the
subtree of the trie (over the bits in that order) below one 32-bit prefix. In a subtree, pairs of nodes are
traversed together, differing bits are added up, and a pair of nodes is left as soon as they exceed the budget. A
prefix with too many fingerprints is split by the blocks of its remaining bits, once or twice; below 50 fixed
bits a subtree has at most 2**14 leaves, so no task holds an unbounded group. Each subtree
gives the edges of a spanning forest of its links, not all pairs.

Components come from repeated minimum labels with pointer jumping; each round is one table in the shared folder.
A jump follows the labels of the round before, so a round reads that one table and writes one. Fingerprints of very many documents, nodes
of very many links and labels of very many nodes are dealt to several tasks.

Defined results: a null, empty or wordless text has fingerprint zero, which links like any other. Repeated
rows and repeated doc_ids are members like others; a null doc_id is never a component_id unless its
component has no other. Texts of any length are read whole. An empty table gives an empty result. Columns of other names are not
returned by near_duplicates and pass through keep_representatives.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqloom.llm.common import LOWER, UPPER, durable, hot_keys, map_text, small_or_plain, spread_join, unused
from seqloom.shipping import ship

LOWERED = bytes.maketrans(UPPER.encode(), LOWER.encode())
SHINGLE = 3
BUDGET = 2
SEED = 42
#: A subtree with more fingerprints is split further.
MAX_GROUP = 1024
HASHES_AT_ONCE = 8192
#: First bits and lengths of blocks: four for the first deal, then three of the remaining 32 bits, then three of 21.
BLOCKS = tuple((at, 16) for at in (0, 16, 32, 48))


def fingerprint(text: str | None) -> int:
    """Unsigned SimHash of the text's word shingles."""
    words = (text or "").encode().translate(LOWERED).split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda a, n: a + 1 + n))
    ends = [e + len(words[0]) - ends[0] for e in ends]
    starts = [0, *[e + 1 for e in ends[: 1 - SHINGLE]]][: len(words) - SHINGLE + 1]
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(starts)
    spans = zip(starts, ends[SHINGLE - 1 :], strict=True)
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, n)
    for low in range(0, n, HASHES_AT_ONCE):
        part = hashes[low : low + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def add_fingerprint(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add fp, the fingerprint as a signed long."""
    return map_text(docs, lambda: lambda t: (_signed(fingerprint(t)),), [T.StructField("fp", T.LongType())], text)


def trie_links(values: list[int], budget: int = BUDGET) -> Iterator[tuple[int, int]]:
    """All pairs of distinct sorted values that differ in at most budget bits, by traversal of node pairs.

    A node is a range of the sorted values that agree above a bit.
    """
    stack = [(0, len(values), 0, len(values), 63, 0)]
    while stack:
        a, b, c, d, bit, used = stack.pop()
        same = a == c
        if (b - a) * (d - c) <= 64 or bit < 0:
            for i in range(a, b):
                for j in range(i + 1 if same else c, d):
                    if (values[i] ^ values[j]).bit_count() <= budget:
                        yield values[i], values[j]
            continue
        middle = [bisect_left(values, ((values[low] >> bit | 1) << bit), low, high) for low, high in ((a, b), (c, d))]
        left, right = ((a, middle[0]), (middle[0], b)), ((c, middle[1]), (middle[1], d))
        for i in (0, 1):
            for j in range(i if same else 0, 2):
                spent = used + (i != j)
                if spent <= budget and left[i][0] < left[i][1] and right[j][0] < right[j][1]:
                    stack.append((*left[i], *right[j], bit - 1, spent))


def forest(values: Iterable[int]) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the values."""
    order = sorted(values)
    up = {v: v for v in order}

    def root(v: int) -> int:
        while up[v] != v:
            up[v] = v = up[up[v]]
        return v

    edges = []
    for a, b in trie_links(order):
        x, y = root(a), root(b)
        if x != y:
            up[max(x, y)] = min(x, y)
            edges.append((a, b))
    return edges


def _block(fp: Column, at: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << bits) - 1))


def _deal(fps: DataFrame) -> DataFrame:
    """Each fingerprint once for each pair of blocks: deal, key, fp."""
    fp = F.col("fp")
    keys = [
        F.struct(F.lit(n).alias("deal"), F.shiftleft(_block(fp, *BLOCKS[i]), 16).bitwiseOR(_block(fp, *BLOCKS[j])).alias("key"))
        for n, (i, j) in enumerate(combinations(range(4), 2))
    ]
    return fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.deal", "k.key", "fp")


def _split(dealt: DataFrame, step: int) -> DataFrame:
    """Deal a hot prefix by one more block: of the open 32 bits, then of the 21 or 22 still open.

    Two differing bits leave one of three blocks as it is. The first step's blocks are the lower 11 bits of either
    open block and their upper bits together; the second step's are thirds of what then remains.
    """
    fp, deal = F.col("fp"), F.col("deal")
    choice = None
    for n, pair in enumerate(combinations(range(4), 2)):
        a, b = (BLOCKS[i][0] for i in range(4) if i not in pair)
        low, high = _block(fp, a, 16), _block(fp, b, 16)
        rest = F.shiftleft(high, 16).bitwiseOR(low)
        if step == 1:
            parts = [(0, 11), (11, 11), (22, 10)]
            keys = F.array(*[F.struct(F.lit(k).alias("part"), _block(rest, *p).alias("sub")) for k, p in enumerate(parts)])
        else:
            first = [(0, 11), (11, 11), (22, 10)]
            keys = None
            for k in range(3):
                (c, cn), (d, dn) = (first[i] for i in range(3) if i != k)
                left = F.shiftleft(_block(rest, d, dn), cn).bitwiseOR(_block(rest, c, cn))
                parts = [(0, 7), (7, 7), (14, cn + dn - 14)]
                these = F.array(*[F.struct(F.lit(10 * (k + 1) + i).alias("part"), _block(left, *p).alias("sub")) for i, p in enumerate(parts)])
                keys = these if keys is None else F.when(F.col("part") == k, these).otherwise(keys)
        choice = keys if choice is None else F.when(deal == n, keys).otherwise(choice)
    own = ["deal", "key"] if step == 1 else ["deal", "key", "part", "sub"]
    out = dealt.select(*own, "fp", F.explode(choice).alias("k"))
    if step == 1:
        return out.select("deal", "key", "k.part", "k.sub", "fp")
    return out.select("deal", "key", "part", "sub", F.col("k.part").alias("part2"), F.col("k.sub").alias("sub2"), "fp")


def links(fps: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """Edges a, b among the distinct fingerprints (column fp) that span all links of two bits or fewer."""
    ship(fps.sparkSession)

    def subtree(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            edges = [(a, b) for values in p["fps"] for a, b in forest(int(v) & (2**64 - 1) for v in values)]
            yield pd.DataFrame({"a": [_signed(a) for a, _ in edges], "b": [_signed(b) for _, b in edges]}, dtype="int64")

    out, dealt = None, _deal(fps)
    for step in range(3):
        key = [c for c in dealt.columns if c != "fp"]
        hot = None
        if step < 2:
            hot = durable(dealt.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > max_group).drop("n"), "hot")
            hot = None if hot.isEmpty() else hot
        cold = dealt.join(hot, key, "left_anti") if hot is not None else dealt
        groups = cold.groupBy(*key).agg(F.collect_list("fp").alias("fps")).filter(F.size("fps") > 1).select("fps")
        edges = groups.mapInPandas(subtree, "a long, b long")
        out = edges if out is None else out.unionByName(edges)
        if hot is None:
            break
        dealt = _split(dealt.join(hot, key, "left_semi"), step + 1)
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """Columns node, label: the smallest node reachable. Only nodes of some edge appear.

    Every round reads the edges, so they should be a table.
    """
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("node", "near")
    hubs = hot_keys(both.groupBy("near").agg(F.count("*").alias("n")), ["near"])
    labels = durable(both.groupBy("node").agg(F.least("node", F.min("near")).alias("label")), "labels")
    while True:
        near = spread_join(both, labels.select(F.col("node").alias("near"), "label"), ["near"], hubs).groupBy("node").agg(F.min("label").alias("low"))
        lower = labels.join(near, "node").select("node", "label", F.least("label", "low").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("label").alias("far"))
        # The nodes of a large component have one label soon.
        large = hot_keys(labels.groupBy(F.col("label").alias("low")).agg(F.count("*").alias("n")), ["low"])
        moved = spread_join(lower, jump, ["low"], large).select("node", F.col("far").alias("label"), (F.col("far") != F.col("label")).alias("moved"))
        moved = durable(moved, "labels")
        labels = moved.select("node", "label")
        if moved.filter("moved").isEmpty():
            return labels


def _members(docs: DataFrame, text: str, doc_id: str, max_group: int, *more: Column) -> DataFrame:
    """doc_id, fp and further columns of every document, with its component's id and root."""
    extra = [f"x{i}" for i in range(len(more))]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *[c.alias(x) for c, x in zip(more, extra, strict=True)])
    fps = durable(add_fingerprint(base).select("doc_id", "fp", *extra), "fingerprints")
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct")
    labels = components(durable(links(distinct.select("fp"), max_group), "links"))
    known = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", "n", F.coalesce("label", "fp").alias("label"))
    known = durable(known, "known")
    groups = known.groupBy("label").agg(F.min("low").alias("component_id"), F.count("*").alias("n"))
    found = spread_join(known.select("fp", "label"), groups.drop("n"), ["label"], hot_keys(groups, ["label"]))
    return spread_join(fps, found.select("fp", "label", "component_id"), ["fp"], hot_keys(distinct, ["fp"]))


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_group: int = MAX_GROUP) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return _members(docs, text, doc_id, max_group).select("doc_id", digits.alias("fingerprint"), "component_id")


def keep_representatives(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", max_group: int = MAX_GROUP, broadcast_bytes: int | None = None) -> DataFrame:
    """One row of each component: that with the smallest doc_id (none comes last), then the smallest hashes of its text.

    Rows with equal ids and texts count as one. What goes is decided on ids and hashes alone; if the keys of the rows that go are
    small enough, they are sent to all tasks and no text is moved.
    """
    one, two = unused(docs, "_hash1", "_hash2")
    hashes = [F.xxhash64(F.col(text)), F.xxhash64(F.lit(1), F.length(F.col(text)), F.col(text))]
    rows = _members(docs, text, doc_id, max_group, *hashes)
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "x0", "x1")
    keys = durable(rows.groupBy(key.alias("key"), "label").agg(F.count("*").alias("n")), "members")
    first = keys.groupBy("label").agg(F.min("key").alias("first"), F.count("*").alias("k"))
    judged = spread_join(keys, first.drop("k"), ["label"], hot_keys(first, ["label"], "k"))
    judged = durable(judged.select(F.col("key.doc_id").alias(doc_id), F.col("key.x0").alias(one), F.col("key.x1").alias(two), "n", (F.col("key") == F.col("first")).alias("kept")), "judged")
    plain = docs.withColumns({one: hashes[0], two: hashes[1]})
    same = lambda a, b: [a[doc_id].eqNullSafe(b[doc_id]), a[one] == b[one], a[two] == b[two]]
    size = F.coalesce(F.octet_length(F.col(doc_id).cast("string")), F.lit(0)) + 32
    # Rows that repeat a kept one go as well; one of each comes back below.
    gone = judged.filter(~F.col("kept") | (F.col("n") > 1))
    small, _ = small_or_plain(gone.select(doc_id, one, two), size, broadcast_bytes)
    out = plain.join(small, same(plain, small), "left_anti").select(*docs.columns)
    repeated = judged.filter(F.col("kept") & (F.col("n") > 1)).select(doc_id, one, two)
    if repeated.isEmpty():
        return out
    small, _ = small_or_plain(repeated, size, broadcast_bytes)
    back = plain.join(small, same(plain, small), "left_semi").dropDuplicates([doc_id, one, two]).select(*docs.columns)
    return out.unionByName(back)
