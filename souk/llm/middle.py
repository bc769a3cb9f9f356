"""Fill-in-middle: documents cut in three, their middle moved to the end.

Units are words with the white space before them, and white space at the end of a text. The places
where units end form a boundary set in the manner of Roaring bitmaps: one container per 65,536
places, which holds them as a sorted array, a bitmap or runs, whichever is smallest, and the number of
places in all containers before it. The place after u units is a select: a search over the cumulative
counts finds the container, a select of its own kind finds the place in it.

Form and cuts depend on the key alone. A null key counts as the empty text, a null text as empty; an empty
text, or one that holds a mark, stays plain. Every row gives one row, repeated rows too; an empty table
gives none. Input columns that carry the name of a result column are replaced. Texts are worked on one
at a time, so memory is some 30 bytes for each code point of the longest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

MARKS = ("<P>", "<S>", "<M>")  # before prefix, suffix and middle
SEED = 42
RATE = 50            # of a hundred documents so many are rearranged
SUFFIX_FIRST = 80    # of a hundred of those so many start with the suffix
SPAN = 1 << 16       # places of a container
ADDED = {"__n": "long", "__form": "string", "__prefix_chars": "long", "__middle_chars": "long",
         "__output": "string"}


class ArrayContainer:
    """Sorted places, two bytes each."""

    def __init__(self, places: np.ndarray):
        self.places = places.astype(np.uint16)

    def select(self, rank: int) -> int:
        return int(self.places[rank])


class BitmapContainer:
    """A bit for each place; the ranks before each word of 64 bits find the word of a rank."""

    def __init__(self, places: np.ndarray):
        bits = np.zeros(SPAN, np.uint8)
        bits[places] = 1
        self.words = np.packbits(bits, bitorder="little").view(np.uint64)
        self.ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, rank: int) -> int:
        word = int(np.searchsorted(self.ranks, rank, "right")) - 1
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return word * 64 + int(np.flatnonzero(bits)[rank - self.ranks[word]])


class RunContainer:
    """First places of runs, and the ranks of those places."""

    def __init__(self, places: np.ndarray, heads: np.ndarray):
        self.starts = places[heads].astype(np.uint16)
        self.ranks = heads

    def select(self, rank: int) -> int:
        run = int(np.searchsorted(self.ranks, rank, "right")) - 1
        return int(self.starts[run]) + rank - int(self.ranks[run])


def container(places: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest of the three kinds for sorted places below SPAN."""
    heads = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1] + 1]))
    as_runs, as_array, as_bits = 4 * len(heads), 2 * len(places), SPAN // 8
    if as_runs < min(as_array, as_bits):
        return RunContainer(places, heads)
    return ArrayContainer(places) if as_array <= as_bits else BitmapContainer(places)


class BoundarySet:
    """Ordered places with select; built from a sorted array of distinct ones."""

    def __init__(self, places: np.ndarray):
        high = places // SPAN
        self.keys, first = np.unique(high, return_index=True)
        self.ranks = np.concatenate([first, [len(places)]])
        self.containers = [container(places[a:b] % SPAN) for a, b in zip(self.ranks, self.ranks[1:])]

    def __len__(self) -> int:
        return int(self.ranks[-1])

    def select(self, rank: int) -> int:
        """The place with so many places before it."""
        at = int(np.searchsorted(self.ranks, rank, "right")) - 1
        return int(self.keys[at]) * SPAN + self.containers[at].select(rank - int(self.ranks[at]))


def unit_ends(text: str) -> np.ndarray:
    """Code points before the end of each unit."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = (points == 0x20) | ((points >= 0x09) & (points <= 0x0D))
    ends = np.flatnonzero(~blank & np.concatenate([blank[1:], [True]])) + 1
    return np.append(ends, len(points)) if len(points) and blank[-1] else ends


def rearrange(key: str, text: str, marks: tuple[str, str, str] = MARKS, seed: int = SEED, rate: int = RATE,
              suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, output."""
    ends = unit_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[i:i + 8], 16) for i in range(0, 32, 8))
    if not text or any(m in text for m in marks) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    places = BoundarySet(np.concatenate([[0], ends]))
    first, second = (places.select(u) for u in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:first], text[first:second], text[second:]
    if h4 % 100 < suffix_first:
        form, parts = "spm", (marks[1], suffix, marks[0], prefix, marks[2], middle)
    else:
        form, parts = "psm", (marks[0], prefix, marks[1], suffix, marks[2], middle)
    return n, form, first, second - first, "".join(parts)


def fill_in_middle(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All rows and columns with __n units, __form, __prefix_chars, __middle_chars and __output.

    `how`: marks, seed, rate and suffix_first of `rearrange`.
    """
    names = list(ADDED)
    own = docs.drop(*(c for c in docs.columns if c.lower() in names and c not in (key, text)))
    own = own.withColumn("__key", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")))

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [rearrange(k, t, **how) for k, t in zip(batch.column("__key").to_pylist(),
                                                        s.strings(batch.column(text)))]
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = {name: pa.array([f[i] for f in found], kind)
                   for i, (name, kind) in enumerate(zip(names, kinds))}
        return s.add_columns(batch, **columns)
    return s.map_batches(own, each, s.extended(own, **ADDED)).drop("__key")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that was rearranged. No text with a mark is ever rearranged, and a mark cannot arise
    where a piece meets a mark as no mark ends as it begins: each mark occurs once."""
    parts = F.split(output, "|".join(f"\\Q{m}\\E" for m in marks), -1)
    in_order = {"psm": (1, 3, 2), "spm": (2, 3, 1)}
    out = F.when(form == "plain", output)
    for name, order in in_order.items():
        out = out.when(form == name, F.concat(*(F.element_at(parts, i + 1) for i in order)))
    return out
