"""Which folders of a stored table are live: one small file per version, the newest counts.

A write goes to a version folder of its own, then the list of live folders is written aside and renamed to
the next number. A reader that took an older list goes on reading the folders it names; one that opens the
table later sees the new list whole. A writer that stops before the rename leaves a folder that no list names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import SparkSession
from pyspark.sql import types as T

VERSION = "_version"  # version folders are named _version=<number>-<random>
KEEP = 10          # so many last versions stay readable
AND = "+"          # between the versions that hold a period together
LAYERS = 8         # so many at most


class OvertakenError(RuntimeError):
    """Another writer published this version first; nothing was changed."""


def place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def delete(spark: SparkSession, path: str) -> None:
    where, fs = place(spark, path)
    fs.delete(where, True)


def bytes_in(spark: SparkSession, path: str) -> int:
    where, fs = place(spark, path)
    return fs.getContentSummary(where).getLength()


def names_in(spark: SparkSession, path: str) -> list[str]:
    where, fs = place(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []


def read_text(spark: SparkSession, path: str) -> str:
    where, fs = place(spark, path)
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def rename_new(spark: SparkSession, source: str, target: str) -> None:
    """Rename to a name that must be free."""
    where, fs = place(spark, target)
    if fs.exists(where) or not fs.rename(place(spark, source)[0], where):
        delete(spark, source)
        raise OvertakenError(f"{target} is there already")


def latest_text(spark: SparkSession, folder: str) -> tuple[int, str | None]:
    """The newest of a folder's numbered files; (0, None) if there is none."""
    numbers = [int(n[:8]) for n in names_in(spark, folder) if re.fullmatch(r"[0-9]{8}\.json", n)]
    return (max(numbers), read_text(spark, f"{folder}/{max(numbers):08d}.json")) if numbers else (0, None)


def put_text(spark: SparkSession, folder: str, number: int, text: str) -> None:
    """Write a numbered file: readers see all of it or none."""
    aside = f"{folder}/.{uuid4().hex}.new"
    where, fs = place(spark, aside)
    stream = fs.create(where, True)
    stream.write(bytearray(text, "utf-8"))
    stream.close()
    rename_new(spark, aside, f"{folder}/{number:08d}.json")


@dataclass(frozen=True)
class Live:
    """Live folders of a table: of each period the version that holds it and that version's layout."""

    number: int = 0
    held: Mapping[str | None, str] = field(default_factory=dict)   # period -> version or versions; None: not partitioned
    layouts: Mapping[str, str] = field(default_factory=dict)       # version -> columns, as JSON
    newest: str = ""                                               # columns of the last write

    def schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self.newest))

    def by_layout(self) -> list[tuple[T.StructType, list[tuple[str | None, str]]]]:
        """Periods of each layout, with a version that holds them."""
        groups: dict[str, list[tuple[str | None, str]]] = {}
        for period, versions in self.held.items():
            for v in layers(versions):
                groups.setdefault(self.layouts[v], []).append((period, v))
        return [(T.StructType.fromJson(json.loads(text)), places) for text, places in groups.items()]

    def replaced(self, touched: list[str | None], version: str, written: list[str | None], layout: T.StructType) -> Live:
        """The next list: the touched periods are now those a version wrote; it adds to others that it wrote to."""
        stay = {p: v for p, v in self.held.items() if p not in set(touched)}
        held = stay | {p: f"{stay[p]}{AND}{version}" if p in stay else version for p in written}
        layouts = {**self.layouts, version: layout.json()}
        return Live(self.number + 1, held, {v: layouts[v] for vs in held.values() for v in layers(vs)}, layout.json())


def layers(versions: str) -> list[str]:
    """The versions that hold a period together, oldest first."""
    return versions.split(AND)


def folder(path: str, period: str | None, version: str, period_column: str) -> str:
    inside = "" if period is None else f"/{period_column}={period}"
    return f"{path}/{VERSION}={version}{inside}"


def manifest_folder(path: str) -> str:
    return f"{path.rstrip('/')}/_live"


def opened(spark: SparkSession, path: str) -> Live | None:
    number, text = latest_text(spark, manifest_folder(path))
    if text is None:
        return None
    got = json.loads(text)
    return Live(number, {p: v for p, v in got["held"]}, got["layouts"], got["newest"])


def publish(spark: SparkSession, path: str, live: Live) -> None:
    text = json.dumps({"held": sorted(([p, v] for p, v in live.held.items()), key=str), "layouts": dict(live.layouts),
                       "newest": live.newest})
    put_text(spark, manifest_folder(path), live.number, text)


def new_version(number: int) -> str:
    return f"{number:08d}-{uuid4().hex[:8]}"


def expire(spark: SparkSession, path: str, keep: int = KEEP) -> None:
    """Forget all but the last `keep` versions, and delete what only they and stopped writers hold."""
    folder = manifest_folder(path)
    numbers = [int(n[:8]) for n in names_in(spark, folder) if re.fullmatch(r"[0-9]{8}\.json", n)]
    kept, gone = sorted(numbers)[-keep:], sorted(numbers)[:-keep]
    if not gone:
        return
    lists = [json.loads(read_text(spark, f"{folder}/{n:08d}.json"))["held"] for n in kept]
    used = {(v, p) for held in lists for p, vs in held for v in layers(vs)}
    versions = {v for v, _ in used}
    for n in gone:
        delete(spark, f"{folder}/{n:08d}.json")
    for name in names_in(spark, path):
        version = name.removeprefix(f"{VERSION}=")
        if version == name or int(version[:8]) >= kept[0]:
            continue
        if version not in versions:
            delete(spark, f"{path}/{name}")
            continue
        for inner in names_in(spark, f"{path}/{name}"):
            if "=" in inner and (version, inner.partition("=")[2]) not in used:
                delete(spark, f"{path}/{name}/{inner}")
