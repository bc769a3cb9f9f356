"""Benchmark decontamination by a BM25 index of the test items with block-max WAND.

Every passage of every training text is a query against an inverted index of the test items. An item
is split into a question and an answer; a passage that holds at least OVERLAP of the SHINGLE-word
shingles of both leaks it. Such a passage can lack only few words of the item, so its BM25 score is
at least the item's own score less its largest impacts of as many words. Impacts are divided by
that bound: one threshold, 1, then serves all items, and no leak is lost to retrieval.

Passages are windows of four times the longest item, overlapping by half. For all passages of a
batch at once, block maxima bound the score of each block of items; only passages with a block that
can reach the threshold are searched by WAND, and what it finds is verified word by word.

The corpus is never shuffled. The index is sent to the tasks in parts of ITEMS items at most, each
a pass over the texts.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm import shared as s

ITEMS = 1024        # items of one part of the index
BLOCK = 4           # items of a block
SHINGLE = 5
OVERLAP = 0.8
K1, B = 1.2, 0.75
SLACK = 1e-6        # for sums of floats
KNOWN = 1_000_000   # words a task keeps at a time
OUTER = string.punctuation + "¿¡«»“”„’‘…–—"
_SENTENCE = re.compile(r"(?<=[.!?])\s+")


def normal_words(text: str) -> list[str]:
    """Words in lower case without outer punctuation; what is only punctuation is left out."""
    return [w for w in (x.lower().strip(OUTER) for x in text.split()) if w]


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The last sentence is the answer; a single sentence is cut in halves."""
    parts = [w for w in map(normal_words, _SENTENCE.split(text)) if w]
    if len(parts) > 1:
        return [w for p in parts[:-1] for w in p], parts[-1]
    words = parts[0] if parts else []
    return words[:len(words) // 2], words[len(words) // 2:]


def shingles(words: list, size: int = SHINGLE) -> set[tuple]:
    """Distinct runs of `size` words; a shorter text is one run; none has none."""
    if not words:
        return set()
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))}


def _lacking(part: set) -> int:
    """Words that a passage with enough of these shingles may lack."""
    return len(part) - math.ceil(OVERLAP * len(part) - 1e-9)


class Index:
    """Inverted index of one part of the items."""

    def __init__(self, items: list[tuple[object, str]], frequency: dict[str, int], total: int, mean: float):
        self.ids = [i for i, _ in items]
        self.parts = []
        self.longest = 1
        postings: dict[str, list[tuple[int, float]]] = {}
        self.bounds = []
        for number, (_, text) in enumerate(items):
            question, answer = question_and_answer(text)
            words = question + answer
            self.longest = max(self.longest, len(words))
            asked, answered = shingles(question), shingles(answer)
            impacts = {}
            for term, n in Counter(words).items():
                idf = math.log(1 + (total - frequency[term] + 0.5) / (frequency[term] + 0.5))
                impacts[term] = idf * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean))
            # A shingle missing lacks one word at most; a word repeated in a shingle set may hide more.
            repeated = (len(question) + len(answer)) - (len(asked) + len(answered)) - 2 * (SHINGLE - 1)
            lack = _lacking(asked) + _lacking(answered) + max(0, repeated)
            ranked = sorted(impacts.values(), reverse=True)
            bound = max(sum(ranked[lack:]), 1e-9)
            self.bounds.append(bound)
            for term, impact in impacts.items():
                postings.setdefault(term, []).append((number, impact / bound))
            self.parts.append((asked, answered))
        self.vocabulary = {t: i for i, t in enumerate(sorted(postings))}
        self.parts = [tuple({tuple(self.vocabulary[w] for w in x) for x in side} for side in pair)
                      for pair in self.parts]
        self.blocks = -(-len(items) // BLOCK)
        self.block_max = np.zeros((len(self.vocabulary), self.blocks), np.float32)
        self.lists: list[tuple[list[int], list[float]]] = []
        for term in sorted(postings):
            row = self.vocabulary[term]
            for number, impact in postings[term]:
                self.block_max[row, number // BLOCK] = max(self.block_max[row, number // BLOCK], impact)
            self.lists.append(([n for n, _ in postings[term]], [x for _, x in postings[term]]))
        self.term_max = [max(x) for _, x in self.lists]

    def search(self, terms: list[int], open_blocks: set[int]) -> list[tuple[int, float]]:
        """Block-max WAND: items with a score of at least 1, of blocks that may have one."""
        threshold = 1 - SLACK
        cursors = [[self.lists[t][0][0], 0, t] for t in terms]
        found = []
        while cursors:
            cursors.sort(key=lambda c: c[0])
            upper, pivot = 0.0, -1
            for i, (_, _, t) in enumerate(cursors):
                upper += self.term_max[t]
                if upper >= threshold:
                    pivot = i
                    break
            if pivot < 0:
                break
            item = cursors[pivot][0]
            block = item // BLOCK
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == item:
                pivot += 1
            ahead = cursors[:pivot + 1]
            if block not in open_blocks or sum(float(self.block_max[c[2], block]) for c in ahead) < threshold:
                goal = (block + 1) * BLOCK  # no item of the block gets there
                if pivot + 1 < len(cursors):
                    goal = min(goal, cursors[pivot + 1][0])
                goal = max(goal, item + 1)
            elif cursors[0][0] == item:
                score = sum(self.lists[t][1][at] for _, at, t in ahead)
                if score >= threshold:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            for c in ahead:
                items = self.lists[c[2]][0]
                while c[1] < len(items) and items[c[1]] < goal:
                    c[1] += 1
                c[0] = items[c[1]] if c[1] < len(items) else -1
            cursors = [c for c in cursors if c[0] >= 0]
        return found

    def verify(self, words: list[int], item: int) -> tuple[float, float] | None:
        """Shares of the question's and the answer's shingles in a passage, where both are enough."""
        shares = []
        for side in self.parts[item]:
            if not side:
                shares.append(1.0)
                continue
            size = len(next(iter(side)))
            share = len(side & shingles(words, size)) / len(side)
            if share < OVERLAP - 1e-9:
                return None
            shares.append(share)
        return shares[0], shares[1]

    def leaks(self, words: np.ndarray, docs: np.ndarray, n_docs: int) -> list[dict[int, tuple]]:
        """For each text the items it leaks: {item: (score, question, answer)} of its best passage.

        `words`: numbers of the words of all texts in order, -1 for words no item has.
        """
        out: list[dict[int, tuple]] = [{} for _ in range(n_docs)]
        stride = 2 * self.longest
        sizes = np.bincount(docs, minlength=n_docs)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        windows = np.maximum(1, -(-sizes // stride) - 1)
        base = np.concatenate([[0], np.cumsum(windows)])
        at = (np.arange(len(words)) - starts[docs]) // stride
        known = words >= 0
        keys = []
        for back in (0, 1):
            within = known & (at - back >= 0) & (at - back < windows[docs])
            keys.append((base[docs[within]] + at[within] - back) * len(self.lists) + words[within])
        keys = np.concatenate(keys)
        if not len(keys):
            return out
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
        window, term = keys // len(self.lists), keys % len(self.lists)
        first = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        upper = np.add.reduceat(self.block_max[term], first, axis=0, dtype=np.float64)
        last = np.concatenate([first[1:], [len(term)]])
        for i in np.flatnonzero((upper >= 1 - SLACK).any(1)):
            number = int(window[first[i]])
            doc = int(np.searchsorted(base, number, "right")) - 1
            found = self.search(term[first[i]:last[i]].tolist(),
                                set(np.flatnonzero(upper[i] >= 1 - SLACK).tolist()))
            begin = starts[doc] + (number - base[doc]) * stride
            passage = words[begin:min(begin + 2 * stride, starts[doc] + sizes[doc])].tolist() if found else []
            for item, score in found:
                shares = self.verify(passage, item)
                if shares is not None:
                    hit = (score * self.bounds[item], *shares)
                    out[doc][item] = max(hit, out[doc].get(item, hit))
        return out


class Numbers(dict):
    """Number of each raw word: -1 for one that no item has, -2 for mere punctuation."""

    def __init__(self, vocabulary: dict[str, int]):
        super().__init__()
        self.vocabulary = vocabulary

    def __missing__(self, word: str) -> int:
        if len(self) > KNOWN:
            self.clear()
        plain = word.lower().strip(OUTER)
        self[word] = number = self.vocabulary.get(plain, -1) if plain else -2
        return number


def build_indexes(items: DataFrame, key: str = "item_id", text: str = "text") -> list[Index]:
    """Index parts over all items; document frequencies and mean length are those of all items.

    Null and empty items leak nowhere; equal rows count once.
    """
    rows = items.select(F.col(f"`{key}`").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    rows = rows.distinct()

    def words_of(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [question_and_answer(t) for t in s.strings(batch.column("text"))]
        return s.add_columns(batch, n=pa.array([len(q) + len(a) for q, a in found], pa.int64()),
                             terms=pa.array([sorted({*q, *a}) for q, a in found], pa.list_(pa.string())))

    counted = s.settle(s.map_batches(rows, words_of, s.extended(rows, n="long", terms="array<string>"))
                       .where("n > 0"), "items")
    total, length = counted.agg(F.count("*"), F.sum("n")).first()
    if not total:
        return []
    frequency = counted.select(F.explode("terms").alias("term")).groupBy("term").count()
    parts = -(-total // ITEMS)
    part = F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int")
    terms = counted.select(part.alias("part"), F.explode("terms").alias("term")).distinct()
    terms = s.settle(terms.join(frequency, "term"), "frequency", "part")
    out = []
    for p in range(parts):
        own = sorted(((r["id"], r["text"]) for r in counted.where(part == p).select("id", "text").collect()),
                     key=lambda x: (x[0] is not None, x))
        known = {r["term"]: r["count"] for r in terms.where(F.col("part") == p).collect()}
        for at in range(0, len(own), ITEMS):  # a hash may give a part a few more
            out.append(Index(own[at:at + ITEMS], known, total, length / total))
    return out


def mark_leaks(docs: DataFrame, items: DataFrame, key: str = "item_id", text: str = "text") -> DataFrame:
    """All rows and columns with __leaks, an array of (item, score, question, answer) by item.

    Null and empty texts and empty item tables leak nothing; the array is empty, never null.
    """
    kind = T.ArrayType(T.StructType([
        T.StructField("item", items.schema[key].dataType), T.StructField("score", T.DoubleType()),
        T.StructField("question", T.DoubleType()), T.StructField("answer", T.DoubleType())]))
    columns = docs.columns
    indexes = build_indexes(items, key)
    marked = docs.withColumn("__leaks", F.array().cast(kind))
    for index in indexes:
        schema = s.extended(docs, __found=kind.simpleString())
        found = s.map_batches(marked, _search(docs.sparkSession.sparkContext.broadcast(index), text),
                              schema.add("__leaks", kind))
        marked = found.select(*(F.col(f"`{c}`") for c in columns),
                              F.array_sort(F.concat("__leaks", "__found")).alias("__leaks"))
    return marked


def _search(shared, text: str):
    state: list[Numbers] = []  # one per task

    def leaks(texts: list[str]) -> np.ndarray:
        index = shared.value
        words = [t.split() for t in texts]
        flat = [w for own in words for w in own]
        numbers = np.fromiter(map(state[0].__getitem__, flat), np.int64, len(flat))
        docs = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        there = numbers != -2
        out = np.empty(len(texts), object)
        for i, hits in enumerate(index.leaks(numbers[there], docs[there], len(texts))):
            out[i] = [{"item": index.ids[n], "score": h[0], "question": h[1], "answer": h[2]}
                      for n, h in sorted(hits.items())]
        return out

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Numbers(shared.value.vocabulary))
        found = s.in_parts(s.strings(batch.column(text)), leaks, 4 << 20).tolist()
        kind = batch.schema.field("__leaks").type
        at = batch.schema.get_field_index("__leaks")
        names = [n for n in batch.schema.names if n != "__leaks"]
        columns = [c for i, c in enumerate(batch.columns) if i != at]
        return pa.RecordBatch.from_arrays([*columns, pa.array(found, kind), batch.columns[at]],
                                          names=[*names, "__found", "__leaks"])
    return each


def leaked() -> Column:
    return F.size("__leaks") > 0
