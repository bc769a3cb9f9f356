"""Exact de-duplication by an extendible-hash index kept in shared files.

Every text, lower-cased in A-Z, has a 64-bit key. The index holds one entry per distinct text. Its
directory maps the leading bits of a key to a bucket; it starts with one bucket and, while a bucket
has more entries than its capacity, splits that bucket, doubling the directory when the bucket
already uses all of its bits. Owner tasks each process a range of the directory: they sort their
entries by key, chain entries with equal keys and compare their bytes, and write the buckets.

Copies are folded by the map tasks before any shuffle that gathers them, so that a group with a
third of all rows reaches its owner as one row per task. Texts travel once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

CAPACITY = 1 << 16  # entries of a bucket
MAX_DEPTH = 16      # bits of the directory; its size on the driver is at most 2 ** MAX_DEPTH


def grow_directory(counts: dict[int, int], capacity: int = CAPACITY,
                   max_depth: int = MAX_DEPTH) -> list[int]:
    """Directory from entry counts by the leading `max_depth` bits of the key.

    Returns the bucket number of each directory slot; the length is 2 ** depth. Buckets are
    numbered in key order. A bucket at `max_depth` bits stays whole.
    """
    size = 1 << max_depth
    sums = [0] * (size + 1)
    for i in range(size):
        sums[i + 1] = sums[i] + counts.get(i, 0)

    def load(prefix: int, depth: int) -> int:
        width = max_depth - depth
        return sums[(prefix + 1) << width] - sums[prefix << width]

    depth, directory = 0, [(0, 0)]  # slot -> (prefix, local depth) of its bucket
    overfull = [(0, 0)] if load(0, 0) > capacity else []
    while overfull:
        prefix, local = overfull.pop()
        if local == max_depth:
            continue
        if local == depth:  # the bucket uses all bits: double the directory
            directory = [slot for slot in directory for _ in range(2)]
            depth += 1
        for half in (prefix << 1, (prefix << 1) | 1):
            width = depth - local - 1
            directory[half << width:(half + 1) << width] = [(half, local + 1)] * (1 << width)
            if load(half, local + 1) > capacity:
                overfull.append((half, local + 1))
    numbers: dict[tuple[int, int], int] = {}
    return [numbers.setdefault(slot, len(numbers)) for slot in directory]


def _tag(key_only: bool, text: str):
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [x.lower() for x in s.utf8(batch.column(text))]  # bytes: A-Z only
        keys = pa.array(s.signed([xxhash.xxh64_intdigest(x) for x in texts]))
        if key_only:
            return pa.RecordBatch.from_arrays([batch.column(0), keys], ["__id", "__h"])
        shas = [hashlib.sha256(x).hexdigest() for x in texts]
        return s.add_columns(batch, __h=keys, __sha=shas)
    return each


def _normalise(text: str):
    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        low = pa.array([x.lower() for x in s.utf8(batch.column(text))], pa.binary())
        return s.add_columns(batch, __norm=low)
    return each


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by key: number those of one key, after comparing their bytes."""
    last_key = last_norm = None
    link = 0
    for batch in batches:
        links = []
        for key, norm in zip(batch.column("__h").to_pylist(), batch.column("__norm").to_pylist()):
            if key != last_key:
                link = 0
            elif norm != last_norm:
                link += 1
            else:
                raise AssertionError("two entries of the index are equal")
            last_key, last_norm = key, norm
            links.append(link)
        yield s.add_columns(batch, __link=pa.array(links, pa.int32()))


def build_index(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Index files of entries (__h, __norm, __keep, __size): buckets written by owner tasks.

    `__norm` is null where no other row shares the key; then there is nothing to compare.
    """
    prefix = F.shiftrightunsigned("__h", 64 - MAX_DEPTH).cast("int")
    counted = entries.groupBy(prefix.alias("p")).count().collect()  # at most 2 ** MAX_DEPTH rows
    directory = grow_directory({r["p"]: r["count"] for r in counted}, capacity)
    depth = (len(directory) - 1).bit_length()
    slot = F.shiftrightunsigned("__h", 64 - depth).cast("int") if depth else F.lit(0)
    slots = entries.sparkSession.createDataFrame(list(enumerate(directory)), "__slot int, __bucket int")
    owners = min(directory[-1] + 1, s.spread(entries))
    owned = (entries.withColumn("__slot", slot)
             .join(F.broadcast(slots), "__slot")  # the directory: at most 2 ** MAX_DEPTH rows
             .withColumn("__owner", F.floor(F.col("__bucket") * owners / F.lit(directory[-1] + 1)))
             .repartition(owners, "__owner")
             .sortWithinPartitions("__bucket", "__h", "__norm").drop("__owner", "__slot"))
    return s.settle(s.map_arrow(owned, _chain, s.extended(owned, __link="int")), "index", "__bucket")


def mark_copies(docs: DataFrame, key: str = "doc_id", text: str = "text",
                capacity: int = CAPACITY, carry: bool = True) -> DataFrame:
    """All rows with __keep, __size, __kept and __sha.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal texts the
    row with the largest key stays (null keys rank below all others); of rows that also share the
    key, the first by their other columns, and one of wholly equal rows. Empty table: empty result.
    With `carry` false the text column comes back null where it has no copy.
    """
    light = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("text"))
    light = s.map_batches(light, _tag(True, "text"), f"__id {docs.schema[key].dataType.simpleString()}, __h long")
    keys = s.settle(light.groupBy("__h").agg(F.count("*").alias("__n"), F.max("__id").alias("__top")),
                    "keys")
    columns = docs.columns
    tagged = s.map_batches(docs, _tag(False, text), s.extended(docs, __h="long", __sha="string"))
    shared = keys.where("__n > 1").select("__h", F.lit(True).alias("__shared"))
    tagged = tagged.join(shared, "__h", "left")
    if not carry:
        tagged = tagged.withColumn(text, F.when(F.col("__shared"), F.col(f"`{text}`")))
    tagged = s.settle(tagged, "tagged")

    alone = tagged.where("__shared is null").withColumns({
        "__keep": F.col(f"`{key}`"), "__size": F.lit(1).cast("long"), "__kept": F.lit(True)})
    copies = tagged.where("__shared")
    copies = s.map_batches(copies, _normalise(text), s.extended(copies, __norm="binary"))
    folded = copies.groupBy("__h", "__norm").agg(F.max(F.col(f"`{key}`")).alias("__keep"),
                                                 F.count("*").alias("__size"))
    index = build_index(folded.unionByName(keys.where("__n = 1").select(
        "__h", F.lit(None).cast("binary").alias("__norm"), F.col("__top").alias("__keep"),
        F.col("__n").alias("__size"))), capacity)
    found = index.where("__norm is not null").select(
        F.col("__h").alias("__ih"), F.col("__norm").alias("__in"), "__keep", "__size", "__link")
    met = copies.join(found, (F.col("__h") == F.col("__ih")) & (F.col("__norm") == F.col("__in")))
    met = met.drop("__ih", "__in", "__norm")
    first = s.same(F.col(f"`{key}`"), F.col("__keep"))
    groups = index.where("__norm is not null")
    twins = met.where(first).groupBy("__h", "__link").count().where("count > 1")
    out = [*columns, "__sha", "__keep", "__size", "__kept"]
    if groups.isEmpty() or twins.isEmpty():
        marked = met.withColumn("__kept", first)
    else:
        marked = _settle_twins(s.settle(met, "met"), columns, key, text)
    pick = [F.col(f"`{c}`") for c in out]
    return alone.select(*pick).unionByName(marked.select(*pick))


def _settle_twins(met: DataFrame, columns: list[str], key: str, text: str) -> DataFrame:
    """Where several rows carry the key that stays: one of them stays."""
    first = s.same(F.col(f"`{key}`"), F.col("__keep"))
    own = [c for c in met.columns if c not in columns]
    whole = [*columns, *own]
    candidates = met.where(first).groupBy(*(F.col(f"`{c}`") for c in whole)).agg(F.count("*").alias("__m"))
    rank = F.to_json(F.struct(*(F.col(f"`{c}`") for c in columns)))
    candidates = s.settle(candidates.withColumn("__rank", rank), "candidates")
    best = candidates.groupBy("__h", "__link").agg(F.min("__rank").alias("__best"))
    chosen = candidates.join(best, ["__h", "__link"])
    chosen = chosen.withColumn("__i", F.explode(F.sequence(F.lit(1).cast("long"), "__m")))
    chosen = chosen.withColumn("__kept", (F.col("__i") == 1) & (F.col("__rank") == F.col("__best")))
    rest = met.where(~first).withColumn("__kept", F.lit(False))
    pick = [*(F.col(f"`{c}`") for c in whole), F.col("__kept")]
    return rest.select(*pick).unionByName(chosen.select(*pick))


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with. See mark_copies."""
    return mark_copies(docs, key, text).where("__kept").select(*(F.col(f"`{c}`") for c in docs.columns))
