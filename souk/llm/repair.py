"""Token ids in binary shards, compressed by Re-Pair grammars.

Texts are placed by key, encoded, and written in key order as shards of some SHARD_IDS ids. In a
shard, frequent pairs of neighbouring symbols are replaced by nonterminals, again and again; a
round takes all frequent pairs at once, from the left where they overlap. Pairs never reach from
one document into the next. A shard stores its rules, the length that each rule expands to, and for
each document the place of its symbols, so that a document, or some ids of it, is read without
expanding the rest.

Shard layout, little endian: magic, then the seven counts of HEADER, then the arrays in the order of
`write_shard`. Symbols take two bytes where all fit, else four. Shards are rows of a Parquet table in
the shared folder: Spark commits them whole, also when a task is run twice.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

SHARD_IDS = 1 << 20
ROUNDS = 6           # rounds of replacement at most
ROUND_RULES = 2500   # new nonterminals of a round at most: the most frequent pairs
LEAST = 6            # a pair must occur so often
SLOT_BITS = 21       # of the table that finds the chosen pairs
MULTIPLIERS = [(0x9E3779B97F4A7C15 * (2 * i + 1) ^ 0x632BE59BD9B4E019 * i << 1 | 1) % (1 << 64) for i in range(32)]
END_ID = 2
KNOWN = 1_000_000    # pieces whose ids a worker keeps at a time
TOGETHER = 2048      # texts encoded together,
TOGETHER_BYTES = 8 << 20  # or fewer, of some bytes
MAGIC = b"RPG1"
HEADER = struct.Struct("<4sIIIIQQI")  # magic, documents, rules, first nonterminal, width, symbols, ids, vocabulary
# Byte-level vocabularies show each byte as a character: itself where it prints, else one from 256 on.
_PRINTS = {*range(33, 127), *range(161, 173), *range(174, 256)}
_SHOWN = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTS)}
_ENDS = "!\"#$%&()*+,-./:;<=>?@[\\]^`{|}~"  # punctuation that never joins letters before it
_ID = attrgetter("id")
_BREAK = re.compile(r"(?<=\S)(?=[ \n])")
_ODD = re.compile("[\x00\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


# --- encoding -------------------------------------------------------------------------------------

def _cuts_by_bytes(file: dict) -> bool:
    """Is it a byte-level tokenizer that reads texts as they are: only then may texts be cut."""
    cutter = file.get("pre_tokenizer") or {}
    return (cutter.get("type") == "ByteLevel" and not cutter.get("add_prefix_space") and cutter.get("use_regex", True)
            and not file.get("normalizer") and file["model"].get("type") == "BPE" and not file["model"].get("dropout")
            and not file["model"].get("ignore_merges"))


def _split(pieces: pa.Array) -> list[str]:
    """Pieces as a list: joined and cut again, which is several times faster than one by one."""
    if not len(pieces):
        return []
    whole = pa.ListArray.from_arrays([0, len(pieces)], pieces)
    out = pc.binary_join(whole, pa.scalar("\x00", pieces.type))[0].as_py().split("\x00")
    return out if len(out) == len(pieces) else pieces.to_pylist()  # a piece holds a zero itself


class Encoder:
    """Ids of texts by a tokenizer file; pieces met before are not encoded again.

    A byte-level tokenizer never joins a character that is not white space with white space after
    it, so a text may be cut there without a change to its ids. With any other kind of tokenizer texts are
    not cut. The special tokens of the file are found as the library finds them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model  # asked for once: the library wraps it anew each time
        self.vocabulary = self.tokenizer.get_vocab_size()
        # Texts with one of these are read by the library alone, which finds them first.
        self.marks = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = _cuts_by_bytes(json.loads(self.tokenizer.to_str()))
        self.known: dict[str, bytes] = {}

    @staticmethod
    def plain(text: str) -> bool:
        """Cut at every space and line end, with no look at what stands around."""
        return not (text[:1] in (" ", "\n", "") or "  " in text or "\n\n" in text or " \n" in text or "\n " in text
                    or _ODD.search(text))

    @classmethod
    def pieces(cls, text: str) -> list[str]:
        if not text:
            return []
        if not cls.plain(text):
            return _BREAK.split(text)
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n").split("\x00")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if not self.cuts or any(m in t for m in self.marks)]
        if whole:
            made = self.tokenizer.encode_batch_fast([texts[i] for i in whole], add_special_tokens=False)
            for i, own in zip(whole, made):
                out[i] = np.array(own.ids, "<u4")
        rest = [i for i, x in enumerate(out) if x is None]
        for i, ids in zip(rest, self._by_pieces([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _by_pieces(self, texts: list[str]) -> list[np.ndarray]:
        """Pieces are told apart by Arrow, so that each distinct one of these texts is looked up once."""
        if not texts:
            return []
        plain = [self.plain(t) for t in texts]
        easy = pa.array([t for t, p in zip(texts, plain) if p], pa.large_string())
        easy = pc.replace_substring(pc.replace_substring(easy, " ", "\x00 "), "\n", "\x00\n")
        easy = pc.split_pattern(easy, "\x00")
        hard = pa.array([self.pieces(t) for t, p in zip(texts, plain) if not p], easy.type)
        cut = pa.chunked_array([easy, hard]).combine_chunks()
        coded = cut.flatten().dictionary_encode()
        found = self._look_up(_split(coded.dictionary))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        values = np.frombuffer(b"".join(found), "<u4")
        number = coded.indices.to_numpy(zero_copy_only=False)
        count = sizes[number]
        ends = np.concatenate([[0], np.cumsum(count)])
        flat = values[np.repeat(begins[number] - ends[:-1], count) + np.arange(ends[-1])]
        offsets = ends[np.concatenate([[0], np.cumsum(cut.value_lengths().to_numpy(zero_copy_only=False))])]
        made = [flat[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        first, second = iter(made[:len(easy)]), iter(made[len(easy):])
        return [next(first) if p else next(second) for p in plain]

    def _look_up(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces."""
        if len(self.known) > KNOWN:
            self.known.clear()
        found = list(map(self.known.get, pieces))
        if None in found:
            new = [i for i, ids in enumerate(found) if ids is None]
            self._learn([pieces[i] for i in new])
            for i in new:
                found[i] = self.known[pieces[i]]
        return found

    def _learn_words(self, words: list[str]) -> None:
        """Ids of what the pattern does not cut; the model takes each whole."""
        if not words:
            return
        shown = [("\u0120" + w[1:] if w[0] == " " else w) if w.isascii() and w != "\n"  # what prints shows as itself
                 else w.encode().decode("latin-1").translate(_SHOWN) for w in words]
        made = list(map(self.model.tokenize, shown))
        ids = np.fromiter(map(_ID, chain.from_iterable(made)), "<u4").tobytes()
        ends = list(accumulate([4 * len(x) for x in made]))
        self.known.update(zip(words, map(ids.__getitem__, map(slice, [0, *ends], ends))))

    def _learn(self, pieces: list[str]) -> None:
        known, rest, words, joined, lines = self.known, [], {"\n"}, [], []
        for piece in pieces:
            bare = piece.rstrip(_ENDS)
            if not bare[1:].isalpha() or not (bare[0] in " \n" or bare[0].isalpha()):
                rest.append(piece)
                continue
            if bare[0] == "\n":  # a line end before letters stands alone
                lines.append((piece, piece[1:]))
                piece, bare = piece[1:], bare[1:]
            words.add(bare)
            if len(bare) < len(piece):  # letters, then no more than punctuation
                end = piece[len(bare):]
                words.add(end)
                joined.append((piece, bare, end))
        self._learn_words([w for w in words if w not in known])
        for piece, bare, end in joined:
            known[piece] = known[bare] + known[end]
        for piece, own in lines:
            known[piece] = known["\n"] + known[own]
        for at in range(0, len(rest), 20_000):
            some = rest[at:at + 20_000]
            for piece, made in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[piece] = array("I", made.ids).tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, which runs many tasks."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # the tasks fill the cores
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


# --- grammar --------------------------------------------------------------------------------------

def places_of(chosen: np.ndarray, pairs: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a chosen pair stands inside a document, and which one.

    A table of 2 ** SLOT_BITS by a product of the pair names the one candidate of each place. Of several multipliers
    the first is taken that gives all chosen pairs slots of their own; if none does, they are searched for.
    """
    kind, shift = pairs.dtype.type, 8 * pairs.itemsize - SLOT_BITS
    for odd in MULTIPLIERS:
        own = chosen * kind(odd & (1 << 8 * pairs.itemsize) - 1) >> kind(shift)
        table = np.full(1 << SLOT_BITS, -1, np.int16)
        table[own] = np.arange(len(chosen))
        if (table[own] == np.arange(len(chosen))).all():
            rule = table.take((pairs * kind(odd & (1 << 8 * pairs.itemsize) - 1) >> kind(shift)).astype(np.intp))
            place = np.flatnonzero((rule >= 0) & inside)
            rule = rule[place].astype(np.int64)
            break
    else:
        place = np.flatnonzero(inside)
        rule = np.minimum(np.searchsorted(chosen, pairs[place]), len(chosen) - 1)
    hit = chosen[rule] == pairs[place]
    return place[hit], rule[hit]


def compress(ids: np.ndarray, starts: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, starts of the documents among them, and rules (left, right) of `first`, `first` + 1 ..."""
    # Where all symbols fit two bytes a pair fits four, which sorts several times faster.
    one, two, bits = ((np.uint16, np.uint32, 16) if first + ROUNDS * ROUND_RULES <= 1 << 16
                      else (np.uint32, np.uint64, 32))
    symbols, starts = ids.astype(one), starts.copy()
    rules: list[np.ndarray] = []
    named = 0
    for _ in range(ROUNDS):
        if len(symbols) < 2:
            break
        inside = np.ones(len(symbols) - 1, bool)
        inside[starts[(starts > 0) & (starts < len(symbols))] - 1] = False
        pairs = symbols[:-1].astype(two)
        pairs <<= two(bits)
        pairs |= symbols[1:]
        ordered = np.sort(pairs[inside])
        if len(ordered) < LEAST:
            break
        # Only pairs that occur LEAST times: then the entry LEAST - 1 places on is the same.
        same = ordered[LEAST - 1:] == ordered[:len(ordered) - LEAST + 1]
        fresh = np.ones(len(same), bool)
        fresh[1:] = ordered[1:len(same)] != ordered[:len(same) - 1]
        at = np.flatnonzero(same & fresh)
        count = np.searchsorted(ordered, ordered[at], "right") - at
        if not len(at):
            break
        often = np.argsort(-count, kind="stable")[:ROUND_RULES]
        chosen = np.sort(ordered[at[often]])
        left, right = (chosen >> two(bits)).astype(np.int64), (chosen & two((1 << bits) - 1)).astype(np.int64)
        place, rule = places_of(chosen, pairs, inside)
        # Overlaps: of a run of matches next to each other every second one, from the left.
        begins = np.concatenate([[True], place[1:] != place[:-1] + 1])
        run = np.arange(len(place)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]
        place, rule = place[run % 2 == 0], rule[run % 2 == 0]
        symbols[place] = (first + named + rule).astype(one)
        kept = np.ones(len(symbols), bool)
        kept[place + 1] = False
        moved = np.concatenate([[0], np.cumsum(kept)])
        starts = moved[starts]
        symbols = symbols[kept]
        rules.append(np.stack([left, right], 1))
        named += len(chosen)
    return symbols, starts, np.concatenate(rules) if rules else np.zeros((0, 2), np.int64)


def rule_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each rule expands to."""
    lengths = np.ones(first + len(rules), np.int64)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[first + i] = lengths[a] + lengths[b]
    return lengths[first:]


def expand(symbols: np.ndarray, rules: np.ndarray, first: int) -> np.ndarray:
    """Ids of some symbols; one pass per level of the grammar."""
    while True:
        deep = symbols >= first
        if not deep.any():
            return symbols
        out = np.repeat(symbols, np.where(deep, 2, 1))
        at = np.flatnonzero(deep) + np.arange(int(deep.sum()))
        pair = rules[symbols[deep] - first]
        out[at], out[at + 1] = pair[:, 0], pair[:, 1]
        symbols = out


# --- shards ---------------------------------------------------------------------------------------

def write_shard(keys: list[int | None], ids: list[np.ndarray], vocabulary: int) -> bytes:
    """Bytes of a shard: keys, which keys are null, symbol starts, id counts, rules, lengths, symbols."""
    counts = np.array([len(x) for x in ids], np.int64)
    starts = np.concatenate([[0], np.cumsum(counts)])
    flat = np.concatenate([np.zeros(0, np.uint32), *ids])
    symbols, places, rules = compress(flat, starts, vocabulary)
    width = 2 if vocabulary + len(rules) <= 1 << 16 else 4
    kind = f"<u{width}"
    head = HEADER.pack(MAGIC, len(keys), len(rules), vocabulary, width, len(symbols), len(flat), vocabulary)
    return b"".join([
        head, np.array([k or 0 for k in keys], "<i8").tobytes(),
        np.array([k is None for k in keys], "u1").tobytes(), places.astype("<u4").tobytes(),
        counts.astype("<u4").tobytes(), rules.astype(kind).tobytes(),
        rule_lengths(rules, vocabulary).astype("<u4").tobytes(), symbols.astype(kind).tobytes()])


class Shard:
    """A shard's arrays; documents are expanded when they are read."""

    def __init__(self, data: bytes):
        magic, n, n_rules, self.first, width, n_symbols, self.n_ids, _ = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        at = HEADER.size

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        keys, null = take("<i8", n), take("u1", n)
        self.keys = [None if z else int(k) for k, z in zip(keys, null)]
        self.places, self.counts = take("<u4", n + 1).astype(np.int64), take("<u4", n).astype(np.int64)
        self.rules = take(f"<u{width}", 2 * n_rules).astype(np.int64).reshape(-1, 2)
        self.lengths = take("<u4", n_rules).astype(np.int64)
        self.symbols = take(f"<u{width}", n_symbols).astype(np.int64)

    def document(self, i: int) -> np.ndarray:
        return expand(self.symbols[self.places[i]:self.places[i + 1]], self.rules, self.first)

    def ids(self, i: int, begin: int, end: int) -> np.ndarray:
        """Ids begin..end of a document: only the symbols that cover them are expanded."""
        own = self.symbols[self.places[i]:self.places[i + 1]]
        sizes = np.where(own >= self.first, self.lengths[np.maximum(own - self.first, 0)]
                         if len(self.lengths) else 1, 1)
        ends = np.cumsum(sizes)
        low, high = np.searchsorted(ends, begin, "right"), np.searchsorted(ends, end, "left") + 1
        skip = begin - (ends[low - 1] if low else 0)
        return expand(own[low:high], self.rules, self.first)[skip:skip + end - begin]

    def all(self) -> np.ndarray:
        """Ids of all documents: each rule is expanded once, then copied wherever it stands."""
        values = np.concatenate([np.arange(self.first), expand(
            np.arange(self.first, self.first + len(self.rules)), self.rules, self.first)])
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        begins = np.cumsum(sizes) - sizes
        count = sizes[self.symbols]
        ends = np.cumsum(count)
        places = np.repeat(begins[self.symbols] - (ends - count), count)
        places += np.arange(len(places))
        return values[places]


def together(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of at most TOGETHER rows; one begins anew where the texts so far reach TOGETHER_BYTES."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, size in enumerate(sizes.tolist()):
        held += size
        if held >= TOGETHER_BYTES or i + 1 - at == TOGETHER:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


SHARDS = "part int, shard int, start long, n_documents long, n_ids long, data binary"


def write_ids(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text",
              end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Shards of all texts in ascending key order, read back from the shared folder.

    `path` is the tokenizer file. Null texts are empty: the end id alone. Null keys come first; rows
    that share a key follow each other by the hash of their text. Keys are whole numbers. `start`
    counts the ids of the same part before a shard. Empty table: no shard.
    """
    rows = docs.select(F.col(f"`{key}`").cast("long").alias("key"), F.col(f"`{text}`").alias("text"))
    rows = rows.withColumn("th", s.text_hash(F.col("text")))
    placed = (rows.repartitionByRange(s.spread(docs), F.col("key").asc_nulls_first(), "th")
              .sortWithinPartitions(F.col("key").asc_nulls_first(), "th").select("key", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        tool = encoder(path)
        end = np.array([end_id], "<u4")
        keys: list[int | None] = []
        ids: list[np.ndarray] = []
        held = start = shard = 0

        def row() -> pa.RecordBatch:
            values = [[part], [shard], [start], [len(keys)], [held], [write_shard(keys, ids, tool.vocabulary)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            names = ["part", "shard", "start", "n_documents", "n_ids", "data"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for some in together(batch):
                for k, own in zip(some.column("key").to_pylist(), tool.encode(s.strings(some.column("text")))):
                    keys.append(k)
                    ids.append(np.concatenate([own, end]))
                    held += len(ids[-1])
                    if held >= shard_ids:
                        yield row()
                        start, shard, held = start + held, shard + 1, 0
                        keys, ids = [], []
        if keys:
            yield row()

    return s.settle(s.map_arrow(placed, run, SHARDS), "shards")


def read_ids(shards: DataFrame) -> DataFrame:
    """Per document, from the shards: key, start among all ids, n_tokens, ids_crc32."""
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n")).orderBy("part").collect()  # a row per task
    before, bases = 0, []
    for r in totals:
        bases.append((r["part"], before))
        before += r["n"]
    bases = shards.sparkSession.createDataFrame(bases, "part int, base long")
    based = shards.join(F.broadcast(bases), "part").select((F.col("base") + F.col("start")).alias("start"), "data")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for start, data in zip(batch.column("start").to_pylist(), batch.column("data")):
            shard = Shard(data.as_py())
            ids = shard.all().astype("<u4")
            ends = np.cumsum(shard.counts)
            begins = ends - shard.counts
            sums = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begins.tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(shard.keys, pa.int64()), pa.array(begins + start), pa.array(shard.counts),
                 pa.array(sums, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from each(batch)
    return s.map_arrow(based, run, "key long, start long, n_tokens long, ids_crc32 long")
