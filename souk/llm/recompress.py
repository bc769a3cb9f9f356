"""Removal of word runs that repeat across documents, by recompression.

Words are symbols. A first round names runs of equal symbols, further rounds name pairs: a hash of
the symbol says on which side of a pair it may stand, so a left symbol followed by a right one is
always named, wherever it occurs. Names are hashes of what they stand for, hence the same in every
task without exchange. Of a window of WINDOW words, the symbols whose making can not depend on words
outside are its interior; it is a function of the window's words alone, and so is the run of UNIT
interior symbols with the least hash: the window's key. Equal windows share their key.

Spark gathers which keys occur in several documents. Only windows with such a key are verified:
a 128-bit digest of their words finds the smallest document in which they start. Keys are few, as
neighbouring windows mostly have the same; a hot key or window is folded by the map tasks before
its shuffle, and no group of documents is collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

WINDOW = 13
ROUNDS = 2          # rounds that name pairs, after the one that names runs
UNIT = 3            # interior symbols of a key
KNOWN = 1_000_000   # words a task keeps at a time
SPAN = 1 << 12      # a run of windows of one key is cut where it is longer
LAST = (1 << 63) - 1  # order of a null key: after all others
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BITS = 0xFFFFFFFFFFFFFFFF
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = (np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64 bits."""
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def pair_name(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    return mix(a * _ODD + mix(b + np.uint64((level + 1) * int(_STEP[0]) & _BITS)))


class Names(dict):
    """Number of each word met; two rows of 64 bits by that number."""

    def __init__(self):
        super().__init__()
        self.fresh: list[bytes] = []  # words met since the table was last filled
        self.table = np.zeros((0, 2), np.uint64)

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def numbers(self, texts: list[list[bytes]], rows: int = 2) -> np.ndarray:
        """Two rows: 128 bits of all words of all texts, in order. Or the first row alone."""
        if len(self) > KNOWN:
            self.clear()
            self.table = np.zeros((0, 2), np.uint64)
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(texts)), np.int64, sum(map(len, texts)))
        if self.fresh:
            digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, self.fresh)), ">u8")
            self.table = np.concatenate([self.table, digests.astype(np.uint64).reshape(-1, 2)])
            self.fresh = []
        return np.stack([self.table[:, r][at] for r in range(rows)])


class Windows:
    """The windows of some texts: first word and text of each, and their keys."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray):
        self.numbers = numbers
        doc = np.repeat(np.arange(len(sizes)), sizes)
        last = np.repeat(np.cumsum(sizes) - WINDOW, sizes)  # where the last window of the word's text begins
        self.first = np.flatnonzero(np.arange(numbers.shape[1]) <= last)
        self.doc = doc[self.first]
        self._sequence_doc = doc

    def digests(self, which: np.ndarray, rows: int = 2) -> list[np.ndarray]:
        """128 bits of the words of some windows, as two rows of 64; or the first row alone.

        Where they are many, sums are made for all places at once and theirs picked: neighbouring words need no gathering.
        """
        out, begin = [], self.first[which]
        places = self.numbers.shape[1] - WINDOW + 1
        many = len(which) * 4 > places
        for row, step in zip(self.numbers[:rows], _STEP):
            total = np.zeros(places if many else len(begin), np.uint64)
            for k in range(WINDOW):
                total *= step
                total += row[k:k + places] if many else row[begin + k]
            out.append(mix(total[begin] if many else total))
        return out

    def keys(self) -> np.ndarray:
        if not len(self.first):
            return np.zeros(0, np.uint64)
        symbols, doc = self.numbers[0], self._sequence_doc
        low, high = self.first.copy(), self.first + WINDOW - 1
        keys = np.zeros(len(self.first), np.uint64)
        alive = np.arange(len(self.first))

        # Runs: the first and the last of a window may go on outside, so they are not interior.
        head = np.concatenate([[True], (symbols[1:] != symbols[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(head)
        length = np.diff(np.concatenate([at, [len(symbols)]]))
        run = np.cumsum(head) - 1
        symbols, doc = np.where(length > 1, mix(symbols[at] + length.astype(np.uint64) * _STEP[1]), symbols[at]), doc[at]
        low, high = run[low] + 1, run[high] - 1
        for level in range(ROUNDS + 1):
            there = low <= high
            if not there.all():
                gone = ~there
                if level == 0:  # no interior at all: the digest
                    keys[alive[gone]] = self.digests(alive[gone], 1)[0]
                else:  # the interior of the round before was the last
                    of, lows, highs = before
                    keys[alive[gone]] = self._least(of, lows[gone], highs[gone], level - 1)
                alive, low, high = alive[there], low[there], high[there]
            if not len(alive):
                break
            if level == ROUNDS:
                keys[alive] = self._least(symbols, low, high, level)
                break
            before = symbols, low, high
            left = (mix(symbols + np.uint64((level + 1) * int(_STEP[1]) & _BITS)) >> np.uint64(63)) == 0
            joined = np.zeros(len(symbols), bool)  # right parts of named pairs
            joined[1:] = left[:-1] & ~left[1:] & (doc[1:] == doc[:-1])
            # A right symbol at the front may belong to a pair begun outside, a left one at the end
            # to a pair that ends outside; whether it does here must not matter.
            low, high = low + ~left[low], high - left[high]
            new = np.cumsum(~joined) - 1
            begin = np.flatnonzero(~joined)
            two = np.zeros(len(symbols), bool)
            two[:-1] = joined[1:]
            named = symbols.copy()
            pairs = np.flatnonzero(two)
            named[pairs] = pair_name(symbols[pairs], symbols[pairs + 1], level)
            edge = np.minimum(low, len(new) - 1), np.maximum(high, 0)
            empty = low > high
            low, high = new[edge[0]], new[edge[1]]
            low[empty], high[empty] = 1, 0
            symbols, doc = named[begin], doc[begin]
        return keys

    @staticmethod
    def _least(symbols: np.ndarray, low: np.ndarray, high: np.ndarray, level: int) -> np.ndarray:
        """Of the runs of UNIT symbols in low..high the least hash; of fewer symbols, that of all."""
        best = np.full(len(low), np.iinfo(np.uint64).max, np.uint64)
        size = high - low + 1
        top = len(symbols) - 1
        joined = symbols
        for unit in range(1, UNIT + 1):
            if unit > 1:
                after = np.concatenate([symbols[unit - 1:], np.zeros(min(unit - 1, len(symbols)), np.uint64)])
                joined = pair_name(joined, after, 99 + unit)
            mine = np.flatnonzero(size >= UNIT if unit == UNIT else size == unit)
            if not len(mine):
                continue
            hashes = mix(joined + np.uint64(unit + 10 * level))
            for k in range(int(size[mine].max()) - unit + 1):
                some = mine[size[mine] >= unit + k]
                best[some] = np.minimum(best[some], hashes[np.minimum(low[some] + k, top)])
        return best


# --- Spark ----------------------------------------------------------------------------------------

def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("doc"),
                       F.col(f"`{text}`").alias("text"))


def _parts(batch: pa.RecordBatch, size: int = 2 << 20) -> Iterator[tuple[int, list[list[bytes]]]]:
    """Words of runs of texts of some `size` bytes together, with the row of the first."""
    at, held, words = 0, 0, []
    for i, text in enumerate(s.utf8(batch.column("text"))):
        words.append(text.split())  # bytes: exactly the white space 09-0D and 20
        held += len(text)
        if held >= size:
            yield at, words
            at, held, words = i + 1, 0, []
    if words:
        yield at, words


def _each_part(make, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            for at, words in _parts(batch):
                columns = make(batch, at, words, names)
                if len(columns[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], schema_names)
    return run


def _sizes(words: list[list[bytes]]) -> np.ndarray:
    return np.array([len(w) for w in words], np.int64)


def _occurrences(batch: pa.RecordBatch, at: int, words: list[list[bytes]], names: Names):
    """Runs of neighbouring windows with one key: doc, key, and first window * SPAN + how many."""
    found = Windows(names.numbers(words, 1), _sizes(words))
    keys = found.keys()
    if not len(keys):
        return [[]] * 3
    doc = batch.column("doc").slice(at, len(words)).to_numpy()
    begins = np.searchsorted(found.doc, np.arange(len(words)))
    place = np.arange(len(keys)) - begins[found.doc]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]) | (place % (SPAN - 1) == 0))
    count = np.diff(np.concatenate([head, [len(keys)]]))
    return doc[found.doc[head]], s.signed(keys[head]), place[head] * SPAN + count


def _candidates(batch: pa.RecordBatch, at: int, words: list[list[bytes]], names: Names):
    """Digests of the windows in the spans of each text: h1, h2, doc; each once per text."""
    found = Windows(names.numbers(words), _sizes(words))
    doc = batch.column("doc").slice(at, len(words)).to_numpy()
    windows = np.bincount(found.doc, minlength=len(words))
    begins = np.concatenate([[0], np.cumsum(windows)[:-1]])
    marks = np.zeros(len(found.first) + 1, np.int64)
    for i, spans in enumerate(batch.column("spans").slice(at, len(words))):
        spans = spans.values.to_numpy()
        low = np.minimum(spans // SPAN, windows[i])
        high = np.minimum(spans // SPAN + spans % SPAN, windows[i])
        np.add.at(marks, begins[i] + low, 1)
        np.add.at(marks, begins[i] + high, -1)
    which = np.flatnonzero(np.cumsum(marks)[:-1] > 0)
    if not len(which):
        return [[]] * 3
    h1, h2 = found.digests(which)
    return s.signed(h1), (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), doc[found.doc[which]]


def _removed(words: list[list[bytes]], cuts: list[list[int] | None], names: Names) -> dict[int, np.ndarray]:
    """Of each text with something to remove, which words stay."""
    some = [i for i, cut in enumerate(cuts) if cut]
    if not some:
        return {}
    found = Windows(names.numbers([words[i] for i in some], 1), _sizes([words[i] for i in some]))
    h1 = found.digests(np.arange(len(found.first)), 1)[0].view(np.int64)
    bounds = np.searchsorted(found.doc, np.arange(len(some) + 1))
    out = {}
    for k, i in enumerate(some):
        hit = np.flatnonzero(np.isin(h1[bounds[k]:bounds[k + 1]], np.array(cuts[i], np.int64)))
        gone = np.zeros(len(words[i]) + 1, np.int64)
        np.add.at(gone, hit, 1)
        np.add.at(gone, hit + WINDOW, -1)
        out[i] = np.cumsum(gone)[:-1] == 0
    return out


def repeated_windows(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, cut): for each key the digests of its windows that start under a smaller key too."""
    rows = _texts(docs, key, text)
    occurrences = s.settle(s.map_arrow(rows, _each_part(_occurrences, ["doc", "key", "span"]),
                                       "doc long, key long, span long"), "occurrences")
    several = s.settle(occurrences.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                       .where("low < high").select("key"), "several")
    spans = s.settle(occurrences.join(several, "key").groupBy("doc")
                     .agg(F.collect_list("span").alias("spans")), "spans")
    s.release(occurrences)
    s.release(several)
    windows = s.settle(s.map_arrow(rows.join(spans, "doc"), _each_part(_candidates, ["h1", "h2", "doc"]),
                                   "h1 long, h2 int, doc long"), "windows")
    s.release(spans)
    first = s.settle(windows.groupBy("h1", "h2").agg(F.min("doc").alias("low"), F.max("doc").alias("high"))
                     .where("low < high").select("h1", "h2", "low"), "first")
    cuts = s.settle(windows.join(first, ["h1", "h2"]).where("doc > low").groupBy("doc")
                    .agg(F.collect_set("h1").alias("cut")), "cuts")
    s.release(windows)
    s.release(first)
    return cuts


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", texts: bool = True) -> DataFrame:
    """All rows with the key, __n_words, __n_removed, __kept (the words left, joined by one space), __sha.

    Without `texts` __kept comes back null.

    A word goes if a window of WINDOW words that covers it also starts in a text with a smaller
    key. Null texts have no words; rows that share a key are not smaller than each other; null keys
    come after all others. Keys are whole numbers.
    """
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("text"),
                       F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(LAST)).alias("doc"))
    rows = rows.join(repeated_windows(docs, key, text), "doc", "left").select("__id", "text", "cut")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Names()
        for batch in batches:
            for at, words in _parts(batch):
                ids = batch.column("__id").slice(at, len(words))
                cuts = batch.column("cut").slice(at, len(words)).to_pylist()
                left = _removed(words, cuts, names)
                removed = [len(own) - int(left[i].sum()) if i in left else 0 for i, own in enumerate(words)]
                kept = [b" ".join(compress(own, left[i].tolist()) if i in left else own)
                        for i, own in enumerate(words)]
                shown = pa.array(kept, pa.binary()).cast(pa.string()) if texts else pa.nulls(len(kept), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(_sizes(words)), pa.array(removed, pa.int64()),
                     shown,
                     pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())],
                    ["__id", "__n_words", "__n_removed", "__kept", "__sha"])

    kind = docs.schema[key].dataType.simpleString()
    return s.map_arrow(rows, run, f"__id {kind}, __n_words long, __n_removed long, __kept string, __sha string")
