"""Toxicity by a factorization machine over hashed terms.

score = offset + sum of w_i x_i + sum over pairs of <v_i, v_j> x_i x_j, over the distinct terms of a text: its
words without case and outer punctuation, and their first letters, so that inflected forms share a term.
x_i falls from rare terms to 0 for one in every sampled text, and the x of a text have length one, so that
long texts are not judged by their number of terms. The pair term makes combinations count that single
words do not give away. Trained by AdaGrad on a bounded sample of labelled rows (SAMPLE per class, a
documented bound); scoring covers all rows and whole texts.
"""

from __future__ import annotations

import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s
from souk.llm.quality import fair_offset, labelled_sample

BUCKETS = 1 << 18
KNOWN = 100_000      # words a task keeps at a time
PART = 1 << 18       # bytes of text scored together
FACTORS = 8
STEM = 4            # letters of the second term of longer words
SAMPLE = 4000       # labelled rows per class that training reads
EPOCHS = 20
STEPS = 900          # at least so many steps: small samples get more epochs
RATE = 5.0
DECAY = 1e-4
RATE_PAIRS = 0.1
DECAY_PAIRS = 1e-3
BATCH = 32
SEED = 11
TINY = 1e-6
OUTER = string.punctuation + "¿¡«»“”„’‘…–—"


def term_buckets(word: str) -> tuple[int, int]:
    """Buckets of a word and of its first letters; (-1, -1) where only punctuation is left."""
    word = word.lower().strip(OUTER)
    if not word:
        return -1, -1
    own = zlib.crc32(word.encode("utf-8", "replace")) % BUCKETS
    stem = f"{word[:STEM]}*" if len(word) > STEM else word
    return own, zlib.crc32(stem.encode("utf-8", "replace")) % BUCKETS


def document_terms(text: str) -> np.ndarray:
    found = {b for w in set(text.split()) for b in term_buckets(w)}
    return np.array(sorted(found - {-1}), np.int64)


class Machine:
    """Factorization machine over presence of terms."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.offset = 0.0
        self.w = np.zeros(BUCKETS, np.float32)
        self.v = rng.normal(0, 0.1, (BUCKETS, FACTORS)).astype(np.float32)

    def train(self, rows: list[tuple[int, np.ndarray]]) -> Machine:
        """No rows: the offset stays zero and every score is one half."""
        self.x = np.ones(BUCKETS, np.float32)
        rng = np.random.default_rng(SEED)
        if not rows:
            self.v[:] = 0
            return self
        # Sums of squared gradients start at one: a term seen once moves by its gradient, no more.
        gw, gv, go = np.ones(BUCKETS), np.ones((BUCKETS, FACTORS)), 1.0
        seen = np.bincount(np.concatenate([r[1] for r in rows]), minlength=BUCKETS)
        self.x = (np.log(len(rows) / np.maximum(seen, 1)) / max(np.log(len(rows)), 1.0)).astype(np.float32)
        labels = np.array([r[0] for r in rows])
        ones = min(max(int(labels.sum()), 1), max(len(rows) - 1, 1))
        balance = np.where(labels == 1, len(rows) / (2 * ones), len(rows) / (2 * (len(rows) - ones) or 1))
        for _ in range(max(EPOCHS, STEPS * BATCH // len(rows))):
            order = rng.permutation(len(rows))
            for at in range(0, len(rows), BATCH):
                picked = order[at:at + BATCH]
                part = [rows[i] for i in picked]
                n = len(part)
                ids = np.concatenate([r[1] for r in part])
                doc = np.repeat(np.arange(n), [len(r[1]) for r in part])
                x = self.x[ids]
                x = x / np.sqrt(np.bincount(doc, x * x, n) + TINY)[doc]
                v = self.v[ids] * x[:, None]
                sums = np.stack([np.bincount(doc, v[:, f], n) for f in range(FACTORS)], 1)
                z = (self.offset + np.bincount(doc, self.w[ids] * x, n)
                     + 0.5 * ((sums ** 2).sum(1) - np.bincount(doc, (v ** 2).sum(1), n)))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                g = (p - labels[picked]) * balance[picked]
                go += g.sum() ** 2
                self.offset -= RATE * g.sum() / np.sqrt(go)
                used, place = np.unique(ids, return_inverse=True)
                d = np.bincount(place, g[doc] * x, len(used)) + DECAY * self.w[used]
                gw[used] += d * d
                self.w[used] -= RATE * d / np.sqrt(gw[used])
                for f in range(FACTORS):
                    d = np.bincount(place, g[doc] * x * (sums[doc, f] - v[:, f]), len(used)) + DECAY_PAIRS * self.v[used, f]
                    gv[used, f] += d * d
                    self.v[used, f] -= RATE_PAIRS * d / np.sqrt(gv[used, f])
        return self

    def columns(self) -> np.ndarray:
        """What a text's terms add up: w x, half the squared length of v x, the square of x, v x."""
        v = self.v * self.x[:, None]
        return np.concatenate([(self.w * self.x)[:, None], 0.5 * (v ** 2).sum(1, keepdims=True),
                               (self.x ** 2)[:, None], v], 1).astype(np.float32)


class Terms(dict):
    """The two buckets of each word met, as one number; -1 where there are none."""

    def __missing__(self, word: str) -> int:
        own, stem = term_buckets(word)
        self[word] = both = -1 if own < 0 else own * BUCKETS + stem
        return both

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def sum_terms(columns: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Log odds, without the offset, of the texts whose distinct terms begin at `starts`."""
    sums = np.add.reduceat(columns[ids], starts, axis=0, dtype=np.float64)
    norm = sums[:, 2] + TINY
    return sums[:, 0] / np.sqrt(norm) + (0.5 * (sums[:, 3:] ** 2).sum(1) - sums[:, 1]) / norm


def score_texts(texts: list[str], terms: Terms, columns: np.ndarray, offset: float) -> np.ndarray:
    words = [t.split() for t in texts]
    z = np.full(len(texts), offset)
    flat = [w for own in words for w in own]
    if flat:
        doc = np.repeat(np.arange(len(texts)), [len(w) for w in words])
        both = terms.look_up(flat)
        words = flat = None  # the sums need the memory
        doc, both = doc[both >= 0] * BUCKETS, both[both >= 0]
        keys = np.concatenate([doc + both // BUCKETS, doc + both % BUCKETS])
        keys.sort()
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys
        if len(keys):
            doc, ids = keys // BUCKETS, keys % BUCKETS
            starts = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            z[doc[starts]] += sum_terms(columns, ids, starts)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(rows: list[tuple[int, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Train on three quarters of the rows; the others set the offset at which one half is fair."""
    machine = Machine().train([r for i, r in enumerate(rows) if i % 4])
    columns = machine.columns()
    rest = rows[::4]
    z = np.array([sum_terms(columns, r[1], np.array([0]))[0] for r in rest if len(r[1])])
    return columns, fair_offset(z, np.array([r[0] for r in rest if len(r[1])]), float(machine.offset))


def train_on(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", key: str = "doc_id",
             text: str = "text", per_class: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Terms are found by the executors; the driver gets 2 * per_class rows of buckets."""
    picked = labelled_sample(labels, label, key, learn, per_class)
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(picked), "__id").select("__id", "label", "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [document_terms(t).astype(np.int32).tobytes() for t in s.strings(batch.column("text"))]
        return pa.RecordBatch.from_arrays([batch.column("__id"), batch.column("label"),
                                           pa.array(found, pa.binary())], ["__id", "label", "ids"])

    kind = docs.schema[key].dataType.simpleString()
    got = s.map_batches(rows, each, f"__id {kind}, label int, ids binary").collect()
    got.sort(key=lambda r: (r["__id"], bytes(r["ids"])))  # the order of rows must not matter
    return fit([(r["label"], np.frombuffer(r["ids"], np.int32).astype(np.int64)) for r in got])


def score_toxicity(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """All rows and columns with __score, the probability of class 1. Null text is empty."""
    columns, offset = model
    wide = docs.sparkSession.sparkContext.broadcast(columns)  # BUCKETS * (FACTORS + 3) numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            for part in s.slices(batch, text, PART):
                yield s.add_columns(part, __score=score_texts(s.strings(part.column(text)), terms, wide.value, offset))
    return s.map_arrow(docs, run, s.extended(docs, __score="double"))
