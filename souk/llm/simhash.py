"""SimHash near-duplicates by a hierarchical index in Gray order.

A fingerprint has 64 bits; bit b is set if more than half of the shingle hashes have it. Two
fingerprints that differ in at most MAX_BITS = 2 bits agree, after cutting the free bits into four
blocks, on at least two whole blocks. The upper nodes of the index are these shared masked bit
patterns: (mask, fingerprint & mask) for the six masks of two blocks. A node with more members than
LIMIT is cut again over its free bits, up to three times; then 8 bits are free and a node has 256
members at most. So no node grows with the data, and no link is lost.

Inside a node the members lie in Gray order, where neighbours share most bits. Runs of them are
factored into inner nodes that hold the bits common to the run. Two inner nodes whose common bits
already differ too often are pruned as a whole; only the others compare members. A node yields
a star of its linked members, not all pairs. Stars meet across nodes by large-star and small-star
steps over written tables.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm import shared as s

BITS = 64
MAX_BITS = 2
SHINGLE = 3
LIMIT = 4096   # members of a node that one task compares
LEAF = 32      # members of an inner node
SEED = 42
LINK = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])


# --- fingerprints ---------------------------------------------------------------------------------

def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; none: zero."""
    if not len(hashes):
        return 0
    bits = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):  # memory stays small for very long texts
        part = np.ascontiguousarray(hashes[at:at + (1 << 16)], "<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view("<u8")[0])


def shingle_hashes(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """XXH64 of the shingles of a text, A-Z lower-cased; repeats included."""
    words = text.lower().split()  # bytes: exactly the white space 09-0D and 20
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-size]]).tolist()
    stops = (ends[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


def with_fingerprints(docs: DataFrame, text: str = "text", size: int = SHINGLE) -> DataFrame:
    """All columns and __fp."""
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        prints = [fingerprint(shingle_hashes(x, size)) for x in s.utf8(batch.column(text))]
        return s.add_columns(batch, __fp=s.signed(np.array(prints, np.uint64)))
    return s.map_batches(docs, each, s.extended(docs, __fp="long"))


# --- upper nodes ----------------------------------------------------------------------------------

def signed_mask(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def child_masks(mask: int, max_bits: int = MAX_BITS) -> list[int]:
    """Masks that keep `mask` and add two of max_bits + 2 blocks of its free bits."""
    free = [b for b in range(BITS) if not mask >> b & 1]
    n = max_bits + 2
    blocks = [sum(1 << b for b in free[i * len(free) // n:(i + 1) * len(free) // n]) for i in range(n)]
    return [mask | x | y for x, y in combinations(blocks, 2)]


def upper_nodes(prints: DataFrame, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """(mask, pattern, fp) of all members; no node has more than `limit` while bits are left to cut."""
    def below(masks: list[int]) -> DataFrame:
        return prints.sparkSession.createDataFrame(
            [(signed_mask(m), [signed_mask(c) for c in child_masks(m, max_bits)]) for m in masks],
            "mask long, children array<long>")

    masks = [0]
    nodes = (prints.select("fp").withColumn("mask", F.explode(F.array(*(
        F.lit(signed_mask(m)) for m in child_masks(0, max_bits)))))
        .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))))
    while True:
        masks = sorted({c for m in masks for c in child_masks(m, max_bits)})
        if BITS - min(m.bit_count() for m in masks) <= 2 * (max_bits + 2):
            return nodes  # at most 2 ** 8 members for two bits
        sizes = nodes.groupBy("mask", "pattern").count().where(F.col("count") > limit)
        sizes = s.settle(sizes.select("mask", "pattern", F.lit(True).alias("hot")), "hot")
        if sizes.isEmpty():
            return nodes
        marked = nodes.join(sizes, ["mask", "pattern"], "left")
        split = (marked.where("hot").join(F.broadcast(below(masks)), "mask")  # 6, 36, 216 rows
                 .select("fp", F.explode("children").alias("mask"))
                 .withColumn("pattern", F.col("fp").bitwiseAND(F.col("mask"))))
        nodes = s.settle(marked.where("hot is null").select("fp", "mask", "pattern").unionByName(split), "nodes")


# --- inside a node --------------------------------------------------------------------------------

def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each pattern in the reflected Gray sequence."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _roots(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Least member reachable, after adding links a-b to the forest `root`."""
    while True:
        x, y = root[a], root[b]
        differ = x != y
        if not differ.any():
            return root
        low, high = np.minimum(x, y)[differ], np.maximum(x, y)[differ]
        np.minimum.at(root, high, low)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up


def node_links(prints: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Root of each member of one node; members are in Gray order and distinct."""
    n = len(prints)
    root = np.arange(n)
    starts = np.arange(0, n, LEAF)
    all_ones = np.bitwise_and.reduceat(prints, starts)
    any_ones = np.bitwise_or.reduceat(prints, starts)
    common = ~(all_ones ^ any_ones)  # bits that the whole inner node shares
    for i in range(len(starts)):
        near = np.bitwise_count((all_ones[i] ^ all_ones[i:]) & common[i] & common[i:]) <= max_bits
        others = i + np.flatnonzero(near)
        mine = np.arange(starts[i], min(starts[i] + LEAF, n))
        for at in range(0, len(others), 256):
            reach = (starts[others[at:at + 256]][:, None] + np.arange(LEAF)).ravel()
            reach = reach[reach < n]
            a, b = np.nonzero(np.bitwise_count(prints[mine][:, None] ^ prints[reach]) <= max_bits)
            a, b = mine[a], reach[b]
            new = root[a] != root[b]
            if new.any():
                root = _roots(n, a[new], b[new], root)
    return root


def _star_links(max_bits: int):
    """Over rows sorted by node and Gray rank: stars of linked members."""
    def links(mask: np.ndarray, pattern: np.ndarray, prints: np.ndarray) -> list[np.ndarray]:
        cut = np.flatnonzero((mask[1:] != mask[:-1]) | (pattern[1:] != pattern[:-1])) + 1
        starts = np.concatenate([[0], cut])
        sizes = np.diff(np.concatenate([starts, [len(prints)]]))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits]
        out = [np.stack([prints[two], prints[two + 1]], 1)]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            members = prints[start:start + size]
            root = node_links(members, max_bits)
            leaf = np.flatnonzero(root != np.arange(size))
            out.append(np.stack([members[root[leaf]], members[leaf]], 1))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []  # the node that the next batch may go on with

        def flush(rows: np.ndarray) -> pa.RecordBatch | None:
            found = np.concatenate(links(rows[0], rows[1], rows[2].view(np.uint64)))
            if not len(found):
                return None
            found = found.view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "pattern", "fp")])
            last = (rows[0] == rows[0, -1]) & (rows[1] == rows[1, -1])
            cut = len(last) if last.all() else len(last) - int(np.argmin(last[::-1]))
            if last.all() and kept and (kept[-1][:2, -1] == rows[:2, 0]).all():
                kept.append(rows)
                continue
            if last.all():
                cut = 0
            whole = np.concatenate([*kept, rows[:, :cut]], 1)
            kept = [rows[:, cut:]]
            if whole.shape[1] and (out := flush(whole)) is not None:
                yield out
        if kept and (out := flush(np.concatenate(kept, 1))) is not None:
            yield out
    return run


def links(prints: DataFrame, max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """Stars (a, b) that connect the distinct fingerprints `fp` within max_bits of each other."""
    nodes = upper_nodes(prints, max_bits, limit)
    gray = F.col("fp")
    for shift in (1, 2, 4, 8, 16, 32):
        gray = gray.bitwiseXOR(F.shiftrightunsigned(gray, shift))
    # Sort by the halves, so that the order is that of the unsigned rank.
    nodes = (nodes.repartition(s.spread(prints), "mask", "pattern").withColumn("g", gray)
             .sortWithinPartitions("mask", "pattern", F.shiftrightunsigned("g", 1), F.col("g").bitwiseAND(F.lit(1))))
    return s.map_arrow(nodes.select("mask", "pattern", "fp"), _star_links(max_bits), LINK)


# --- components -----------------------------------------------------------------------------------

def components(edges: DataFrame) -> DataFrame:
    """(v, root) of all ends of links (a, b): root is the least number reachable.

    Alternating large-star and small-star steps; every step folds by key before its shuffle, and
    each round is written to the shared folder. Ends when a round changes nothing.
    """
    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = s.settle(df.where("a <> b").distinct(), "stars")
        return df, df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    def large_star(e: DataFrame) -> DataFrame:
        both = e.select("a", "b").union(e.select(F.col("b"), F.col("a")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.join(least, "a").where("b > a").select(F.col("m").alias("a"), "b")

    def small_star(e: DataFrame) -> DataFrame:
        down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").select(F.col("m").alias("a"), "b")
        return moved.union(least.select(F.col("m").alias("a"), F.col("a").alias("b")))

    stars, before = written(edges.select("a", "b"))
    while before[0]:
        stars, _ = written(large_star(stars))
        stars, after = written(small_star(stars))
        if after == before:
            break
        before = after
    roots = stars.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("root"))
    return roots.union(roots.select("root", "root").distinct())


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                max_bits: int = MAX_BITS, limit: int = LIMIT) -> DataFrame:
    """__id, __th (hash of the text), __fp, __root and __group of every row.

    Rows link when their fingerprints differ in at most max_bits bits; __root is the least fingerprint
    reachable, which tells groups apart, and __group the smallest key reachable (null keys count only
    where there is no other; groups may share a repeated key). Null and empty texts and texts of
    white space have fingerprint zero and link like any other. Empty table: empty result.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("__text"))
    rows = s.settle(with_fingerprints(rows, "__text", size)
                    .select("__id", s.text_hash(F.col("__text")).alias("__th"), "__fp"), "prints")
    prints = s.settle(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("__id").alias("least")), "distinct")
    stars = s.settle(components(links(prints, max_bits, limit)), "components")
    member = prints.join(stars, F.col("fp") == F.col("v"), "left").withColumn(
        "root", F.coalesce("root", "fp")).select("fp", "least", "root")
    member = s.settle(member, "members")
    lowest = member.groupBy("root").agg(F.min("least").alias("__group"))
    named = s.settle(member.join(lowest, "root").select("fp", F.col("root").alias("__root"), "__group"), "named")
    return rows.join(named, F.col("__fp") == F.col("fp")).drop("fp")


def simhash_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SHINGLE,
                  max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each group: the smallest key; of rows that share it, the least hash of the text."""
    groups = s.settle(near_groups(docs, key, text, size, max_bits), "groups")
    # All rows of `first` in one group have one key, which is null only where the group has no other.
    first = groups.where(s.same(F.col("__id"), F.col("__group")))
    counted = first.groupBy("__root", "__id", "__th").agg(F.count("*").alias("__n"))
    best = counted.groupBy("__root", "__id").agg(F.min(F.struct("__th", "__n")).alias("m"))
    return s.keep_listed(docs, best.select("__id", "m.__th", "m.__n"), key, text)
