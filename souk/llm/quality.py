"""Quality classifier by supervised subword embeddings.

A document is the mean of the learned vectors of its features: words, character n-grams of words,
and pairs of neighbouring words, all hashed into BUCKETS rows. A softmax over two classes reads the
mean. Vectors and softmax are trained together by numpy stochastic gradient descent on a bounded
sample of labelled rows (SAMPLE per class, a documented bound); scoring covers all rows and whole
texts. As softmax and mean are linear, a document's score needs one number per feature, and those
of a word are summed once and kept while a task runs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from souk.llm import shared as s

BUCKETS = 1 << 16
DIM = 8
GRAMS = (3, 4)      # lengths of character n-grams
SAMPLE = 1500       # labelled rows per class that training reads
EPOCHS = 12
STEPS = 900          # at least so many steps: small samples get more epochs
RATE = 0.6
BATCH = 32
SEED = 7
KNOWN = 1_000_000   # words a task keeps at a time
REPEAT, SKIP_REPEAT = 0, 1  # buckets of "the same word again", next or after one other word


def word_buckets(word: str) -> list[int]:
    """Buckets of a word: itself, then its n-grams with marked ends."""
    raw = word.encode("utf-8", "replace")
    marked = f"<{word}>"
    grams = [marked[i:i + n] for n in range(GRAMS[0], GRAMS[1] + 1) for i in range(len(marked) - n + 1)]
    return [zlib.crc32(b"w" + raw) % BUCKETS,
            *(zlib.crc32(g.encode("utf-8", "replace")) % BUCKETS for g in grams)]


def pair_buckets(hashes: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of neighbouring words, and the position of the first word of each.

    `breaks`: positions of the words that begin a document. A repeated word has a bucket of its own
    whatever the word is, at distance one and two.
    """
    first = np.zeros(len(hashes) + 2, bool)
    first[breaks] = True
    a, b = hashes[:-1].astype(np.uint64), hashes[1:].astype(np.uint64)
    pair = ((a * np.uint64(0x9E3779B1) + b) >> np.uint64(7)) % np.uint64(BUCKETS)
    pair[a == b] = REPEAT
    at = np.flatnonzero(~first[1:len(hashes)])
    skip = np.flatnonzero((hashes[:-2] == hashes[2:]) & ~first[1:len(hashes) - 1] & ~first[2:len(hashes)])
    return (np.concatenate([pair[at].astype(np.int64), np.full(len(skip), SKIP_REPEAT)]),
            np.concatenate([at, skip]))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text with the share of its features that each has."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.float32)
    seen: dict[str, list[int]] = {}
    own = [seen.get(w) or seen.setdefault(w, word_buckets(w)) for w in words]
    hashes = np.fromiter((b[0] for b in own), np.int64, len(own))
    pairs, _ = pair_buckets(hashes, np.array([0]))
    ids = np.concatenate([np.fromiter((x for b in own for x in b), np.int64), pairs])
    buckets, counts = np.unique(ids, return_counts=True)
    return buckets, (counts / len(ids)).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent; returns each bucket's share in the log odds, and their offset.

    No rows: all shares are zero, every score is one half.
    """
    if not rows:
        return np.zeros(BUCKETS, np.float32), 0.0
    rng = np.random.default_rng(SEED)
    labels = np.array([r[0] for r in rows])
    ones = min(max(int(labels.sum()), 1), max(len(rows) - 1, 1))
    # Both classes weigh the same, so that one half is the fair bound.
    balance = np.where(labels == 1, len(rows) / (2 * ones), len(rows) / (2 * (len(rows) - ones) or 1))
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    output = np.zeros((DIM, 2), np.float32)
    offset = np.zeros(2, np.float32)
    each = -(-len(rows) // BATCH)
    epochs = max(EPOCHS, -(-STEPS // each))
    steps, step = epochs * each, 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            picked = order[at:at + BATCH]
            part = [rows[i] for i in picked]
            ids = np.concatenate([r[1] for r in part])
            share = np.concatenate([r[2] for r in part])
            doc = np.repeat(np.arange(len(part)), [len(r[1]) for r in part])
            mean = np.stack([np.bincount(doc, vectors[ids, d] * share, len(part)) for d in range(DIM)], 1)
            z = mean @ output + offset
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), labels[picked]] -= 1  # gradient of the loss
            p *= balance[picked][:, None]
            back = p @ output.T
            output -= (rate * mean.T @ p / len(part)).astype(np.float32)
            offset -= (rate * p.mean(0)).astype(np.float32)
            used, place = np.unique(ids, return_inverse=True)
            for d in range(DIM):  # the rate of a vector is per document, not per batch
                vectors[used, d] -= rate * np.bincount(place, back[doc, d] * share, len(used))
    return (vectors @ (output[:, 1] - output[:, 0])).astype(np.float32), float(offset[1] - offset[0])


def fair_offset(z: np.ndarray, labels: np.ndarray, fallback: float) -> float:
    """Offset that puts one half where held-back rows of the two classes part best.

    Of the bounds with the fewest errors, the middle of the first gap.
    With one class only: the trained offset.
    """
    if len(set(labels.tolist())) < 2:
        return fallback
    order = np.argsort(z, kind="stable")
    z, ones = z[order], labels[order]
    gain = np.cumsum(1 - 2 * ones)[:-1]  # rows put right by a bound above each, up to a constant
    gain[z[1:] == z[:-1]] = -len(z)
    at = int(np.argmax(gain))
    return -float(z[at] + z[at + 1]) / 2


def fit(rows: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, float]:
    """Train on three quarters of the rows; the others set the offset at which one half is fair."""
    weights, offset = train([r for i, r in enumerate(rows) if i % 4])
    rest = [r for r in rows[::4] if len(r[1])]
    z = np.array([weights[r[1]] @ r[2] for r in rest])
    return weights, fair_offset(z, np.array([r[0] for r in rest]), offset)


class Words(dict):
    """Number of each word met; `share`, `size` and `hash` by that number."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights
        self.rows: list[tuple[float, int, int]] = []
        self.table = np.zeros((0, 3))

    def __missing__(self, word: str) -> int:
        buckets = word_buckets(word)
        self[word] = number = len(self)
        self.rows.append((float(self.weights[buckets].sum()), len(buckets), buckets[0]))
        return number

    def look_up(self, words: list[str]) -> np.ndarray:
        if len(self) > KNOWN:
            self.clear()
            self.rows, self.table = [], np.zeros((0, 3))
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.rows:
            self.table = np.concatenate([self.table, np.array(self.rows)])
            self.rows = []
        return self.table[numbers]


def score_texts(texts: list[str], known: Words, offset: float) -> np.ndarray:
    """Probability of class 1. An empty text has the offset alone."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words])
    total = np.zeros(len(texts))
    count = np.zeros(len(texts))
    flat = [w for own in words for w in own]
    if flat:
        doc = np.repeat(np.arange(len(texts)), sizes)
        info = known.look_up(flat)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        pairs, at = pair_buckets(info[:, 2].astype(np.int64), starts[sizes > 0])
        total += np.bincount(doc, info[:, 0], len(texts))
        total += np.bincount(doc[at], known.weights[pairs], len(texts))
        count += np.bincount(doc, info[:, 1], len(texts)) + np.bincount(doc[at], minlength=len(texts))
    z = total / np.maximum(count, 1) + offset
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def labelled_sample(labels: DataFrame, label: str, key: str, learn, per_class: int) -> DataFrame:
    """At most `per_class` labelled keys of each class, by hash; `learn` says which keys may teach."""
    usable = labels.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{label}`").cast("int").alias("label"))
    usable = usable.where(learn(F.col("__id")) & F.col("__id").isNotNull())
    classes = [usable.where(F.col("label") == c).orderBy(F.xxhash64("__id"), "__id").limit(per_class)
               for c in (0, 1)]
    return classes[0].unionByName(classes[1])


def train_on(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", key: str = "doc_id",
             text: str = "text", per_class: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Features are made by the executors; the driver gets 2 * per_class rows of bucket shares."""
    picked = labelled_sample(labels, label, key, learn, per_class)
    rows = docs.select(F.col(f"`{key}`").alias("__id"), F.col(f"`{text}`").alias("text"))
    rows = rows.join(F.broadcast(picked), "__id").select("__id", "label", "text")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [document_features(t) for t in s.strings(batch.column("text"))]
        return pa.RecordBatch.from_arrays(
            [batch.column("__id"), batch.column("label"),
             pa.array([f[0].astype(np.int32).tobytes() for f in found], pa.binary()),
             pa.array([f[1].tobytes() for f in found], pa.binary())], ["__id", "label", "ids", "share"])

    kind = docs.schema[key].dataType.simpleString()
    got = s.map_batches(rows, each, f"__id {kind}, label int, ids binary, share binary").collect()
    got.sort(key=lambda r: (r["__id"], bytes(r["ids"])))  # the order of rows must not matter
    return fit([(r["label"], np.frombuffer(r["ids"], np.int32).astype(np.int64),
                   np.frombuffer(r["share"], np.float32)) for r in got])


def score_quality(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """All rows and columns with __score, the probability of class 1. Null text is empty."""
    weights, offset = model
    state: list[Words] = []  # one per task

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not state:
            state.append(Words(weights))
        texts = s.strings(batch.column(text))
        return s.add_columns(batch, __score=s.in_parts(texts, lambda part: score_texts(part, state[0], offset)))
    return s.map_batches(docs, each, s.extended(docs, __score="double"))
