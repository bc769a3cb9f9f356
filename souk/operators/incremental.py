"""Incremental maintenance: high-water mark, upsert, append, schema sync, null-key purge."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk import model

EPOCH = datetime(1970, 1, 1)


def high_water_mark(target: DataFrame | None, column: str) -> datetime:
    """Newest stamp in the target, the epoch if there is none (a one-row aggregate)."""
    top = target.agg(F.max(F.col(column).cast("timestamp_ntz"))).first()[0] if target is not None else None
    return top or EPOCH


def newer_than(source: DataFrame, target: DataFrame | None, column: str,
               target_column: str | None = None) -> DataFrame:
    """Source rows stamped after everything the target holds."""
    mark = high_water_mark(target, target_column or column)
    return source.filter(F.col(column) > F.lit(mark).cast("timestamp_ntz").cast("timestamp"))


def differing(fresh: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of `fresh` that the stored table lacks or holds with another content.

    Both are unique on the key, so the join has no popular key. Rows meet on the key alone: `least`, the
    conjunction of the other comparisons, is no join key, so neither side is hashed and sorted on all its columns.
    """
    held = stored.select(*(F.col(c).alias(f"_held_{c}") for c in fresh.columns))
    same = F.col(key) == F.col(f"_held_{key}")
    others = [F.col(c).eqNullSafe(F.col(f"_held_{c}")) for c in fresh.columns if c != key]
    if others:
        same = same & F.least(F.lit(True), *others)
    return fresh.join(held, same, "left_anti")


def _digest(seed: int, columns: Sequence[str]) -> Column:
    """64 bits of a row's content; a hash passes NULL over, so which columns are NULL is hashed too."""
    return F.xxhash64(F.lit(seed), *columns, *(F.col(c).isNull() for c in columns))


def compared(fresh: DataFrame, stored: DataFrame, key: str, place: str) -> DataFrame:
    """(gone, key, now, was): where news lie, by the column `place`, and the keys that only the stored table has.

    A row per pair of places that hold a key whose content differs or that is new (gone is false, the key NULL), and
    one per key that is gone. Only the key, its place and two digests of the row are shuffled. Rows without a key
    equal no other: such a fresh row is always new, such a stored one is not listed.
    """
    content = [c for c in fresh.columns if c not in {key, place}]
    digests = [_digest(1, content).alias("_one"), _digest(2, content).alias("_two")]
    new = fresh.filter(F.col(key).isNotNull()).select(F.col(key).alias("_new"), F.col(place).alias("_now"), F.struct(*digests).alias("_is"))
    old = stored.filter(F.col(key).isNotNull()).select(F.col(key).alias("_old"), F.col(place).alias("_was"), F.struct(*digests).alias("_held"))
    gone = F.col("_new").isNull()
    both = new.join(old, F.col("_new") == F.col("_old"), "full").filter(~F.col("_is").eqNullSafe(F.col("_held")))
    keyless = fresh.filter(F.col(key).isNull()).select(
        F.lit(False).alias("gone"), F.col(key), F.col(place).alias("now"), F.lit(None).cast("string").alias("was"))
    return both.select(gone.alias("gone"), F.when(gone, F.col("_old")).alias("key"), F.col("_now").alias("now"),
                       F.col("_was").alias("was")).union(keyless).distinct()


def superseding(fresh: DataFrame, held: DataFrame, key: str, latest: str, tie_breakers: Sequence[str]) -> DataFrame:
    """Rows of `fresh` that come before the held row of their key, as `keep_latest` orders rows, or whose key is new.

    Both are unique on the key, which is never NULL.
    """
    wins = F.lit(False)
    for c in (*reversed(tie_breakers), latest):
        new, old = F.col(c), F.col(f"_held_{c}")
        if c == latest:
            first = F.coalesce(new > old, new.isNotNull() & old.isNull())
        else:
            first = F.coalesce(new < old, new.isNull() & old.isNotNull())
        wins = first | (new.eqNullSafe(old) & wins)
    other = held.select(*(F.col(c).alias(f"_held_{c}") for c in (key, latest, *tie_breakers)))
    return (fresh.join(other, F.col(key) == F.col(f"_held_{key}"), "left")
            .filter(F.col(f"_held_{key}").isNull() | wins).select(*fresh.columns))


def not_older(rows: DataFrame, stored: DataFrame, key: str, stamp: str) -> DataFrame:
    """Rows whose key is new or whose stamp is not before that of the stored row."""
    held = stored.select(F.col(key).alias("_key"), F.col(stamp).alias("_stamp"))
    return rows.join(held, (F.col(key) == F.col("_key")) & (F.col("_stamp") > F.col(stamp)), "left_anti")


def synced(have: T.StructType, wanted: T.StructType) -> list[Column]:
    """Columns of one layout in another: new ones NULL, removed ones dropped, types changed where the value allows."""
    kinds = {f.name: f.dataType for f in have}
    out = []
    for f in wanted:
        if f.name not in kinds:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif kinds[f.name] == f.dataType:
            out.append(F.col(f.name))
        else:
            out.append(F.col(f.name).try_cast(f.dataType).alias(f.name))
    return out


def sync_columns(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target rows in the source's layout."""
    return target.select(*synced(target.schema, source.schema))


def upsert(target: DataFrame | None, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Matched rows replaced, others inserted; the result has the source's columns.

    `source` is unique on the keys, so the anti-join has no popular key to stumble over.
    """
    if target is None:
        return source
    untouched = target.join(source.select(*keys), list(keys), "left_anti")
    return sync_columns(untouched, source).unionByName(source)


def append(target: DataFrame | None, source: DataFrame) -> DataFrame:
    """Insert-only merge: source rows are added as they are."""
    return source if target is None else sync_columns(target, source).unionByName(source)


def purge_null_ids(df: DataFrame, id_column: str) -> DataFrame:
    """Rows that carry an id."""
    return df.filter(F.col(id_column).isNotNull())


def purge_report(df: DataFrame, id_column: str) -> DataFrame:
    """How many rows the purge keeps and drops."""
    missing: Column = F.col(id_column).isNull()
    return df.agg(F.count(F.when(~missing, 1)).alias("kept"),
                  F.count(F.when(missing, 1)).alias("dropped"))


def purge_raw(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The raw tables, those with a declared id without the rows that lack it."""
    return {name: purge_null_ids(df, model.PURGED_ON[name]) if name in model.PURGED_ON else df
            for name, df in raw.items()}
