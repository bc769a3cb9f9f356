from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from souk.llm import quality, shared, toxicity

WORDS = [f"{a}{b}{c}" for a in "bdgklm" for b in "aeiou" for c in ("n", "rt", "sh", "l")]


def sentence(rng, n=40):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def everyone(key):
    return F.lit(True)


def test_quality_learns_marks_shouting_and_repeats(spark, documents):
    rng = random.Random(1)
    rows = []
    for i in range(240):
        text = sentence(rng)
        if i % 2 == 0:
            text = rng.choice([text.upper(), " ".join(w + "***" for w in text.split()),
                               " ".join(w for w in text.split()[:6] for _ in range(8))])
        rows.append((i, text, i % 2))
    docs = documents(*((i, t) for i, t, _ in rows))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 180] + [(None, 1), (500, None)],
                                   "doc_id long, quality int")
    model = quality.train_on(docs, labels, everyone)
    got = {r["doc_id"]: r["__score"] for r in quality.score_quality(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == y for i, _, y in rows if i >= 180]) > 0.93


def test_toxicity_learns_pairs_that_single_terms_do_not_give_away():
    rng = random.Random(2)

    def rows(n):
        for i in range(n):
            words = rng.sample(WORDS, 15) + ["dolt"] * (i % 4 & 1) + ["clan"] * (i % 4 >> 1)
            yield int(i % 4 == 3), " ".join(words)
    model = toxicity.fit([(y, toxicity.document_terms(t)) for y, t in rows(1200)])
    test = list(rows(200))
    scores = toxicity.score_texts([t for _, t in test], toxicity.Terms(), *model)
    by_case = [scores[k::4].mean() for k in range(4)]
    assert by_case[3] > max(by_case[:3]) + 0.2
    assert np.mean((scores >= 0.5) == np.array([y for y, _ in test])) > 0.75


def test_toxicity_finds_inflected_insults(spark, documents):
    rng = random.Random(3)
    rows = [(i, sentence(rng) + (f" zorgu{rng.choice(['en', 'ish', 'a', 'os'])} " * 2 if i % 3 == 0 else ""))
            for i in range(300)]
    docs = documents(*rows)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = toxicity.train_on(docs, labels, everyone)
    got = {r["doc_id"]: r["__score"] for r in toxicity.score_toxicity(docs, model).collect()}
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in range(200, 300)]) > 0.9


def test_odd_texts_and_tables(spark, documents):
    docs = documents((1, None), (2, ""), (3, "..."), (None, "x"), (4, "a " * 50_000), (4, "a"))
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for train, score in ((quality.train_on, quality.score_quality), (toxicity.train_on, toxicity.score_toxicity)):
        model = train(docs, no_labels, everyone)
        scores = [r["__score"] for r in score(docs, model).collect()]
        assert len(scores) == 6 and all(abs(x - 0.5) < 1e-6 for x in scores)
        one_class = spark.createDataFrame([(2, 1, 1), (4, 1, 1)], "doc_id long, quality int, toxic int")
        assert all(0 <= r["__score"] <= 1 for r in score(docs, train(docs, one_class, everyone)).collect())
        assert score(docs.where("false"), model).collect() == []


def test_held_out_rows_never_teach(spark, documents):
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, quality int")
    learn = F.crc32(F.col("__id").cast("string")) % 3 != 1
    picked = quality.labelled_sample(labels, "quality", "doc_id", lambda key: learn, 1000).collect()
    import zlib
    assert {r["__id"] for r in picked} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1}


def test_texts_become_python_objects_in_slices():
    texts = ["a" * 6, None, "b" * 6, "", "é" * 40, "c", None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(7)), "text": pa.array(texts)})
    parts = list(shared.slices(batch, "text", 10))
    assert [p.num_rows for p in parts] == [3, 2, 2]
    assert [t for p in parts for t in p.column("text").to_pylist()] == texts
    assert [i for p in parts for i in p.column("id").to_pylist()] == list(range(7))
    assert list(shared.slices(batch.slice(0, 0), "text", 10)) == []


def test_toxicity_hands_batches_on_in_slices(spark, documents, monkeypatch):
    sizes = []
    monkeypatch.setattr(shared, "map_arrow", lambda docs, run, schema: sizes.extend(
        out.num_rows for out in run(iter([pa.RecordBatch.from_pydict({"text": ["x y"] * 300_000})]))))
    toxicity.score_toxicity(documents((1, "a")), (np.zeros((toxicity.BUCKETS, toxicity.FACTORS + 3), np.float32), 0.0))
    assert sum(sizes) == 300_000 and max(sizes) <= toxicity.PART // 3 + 1


def test_toxicity_forgets_words_without_changing_scores(monkeypatch):
    rng = np.random.default_rng(5)
    columns = rng.normal(0, 1, (toxicity.BUCKETS, toxicity.FACTORS + 3)).astype(np.float32) ** 2
    texts = ["", "...", *(" ".join(f"w{n}" for n in rng.integers(0, 300, 40)) + " ¿... W1! w1" for _ in range(30))]
    terms = toxicity.Terms()
    together = toxicity.score_texts(texts, terms, columns, 0.1)
    monkeypatch.setattr(toxicity, "KNOWN", 20)
    apart = [toxicity.score_texts([t], terms, columns, 0.1)[0] for t in texts]
    assert together.tolist() == apart
    for text, score in zip(texts, together):
        ids = toxicity.document_terms(text)
        z = 0.1 + (toxicity.sum_terms(columns, ids, np.array([0]))[0] if len(ids) else 0)
        assert score == 1 / (1 + np.exp(-np.clip(z, -30, 30)))
