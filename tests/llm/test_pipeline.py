from __future__ import annotations

import random

import corpus_pipeline
import public_tokenizers as P
import pytest
import tiktoken

from souk.llm import bpe, decontaminate, queries

WORDS = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te", "so") for b in "aeiou" for c in ("n", "r", "sh", "l")]


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with planted toxic texts, copies, near copies and leaks; what should stay."""
    rng = random.Random(12)
    folder = str(tmp_path_factory.mktemp("corpus"))
    clean = {i: sentence(rng, 200) for i in range(160)}
    rows = list(clean.items())
    labels = [(i, 1, 0) for i in clean]
    for i in range(200, 320):
        rows.append((i, sentence(rng, 60) + " vile scumbag vile scumbag"))
        labels.append((i, 1, 1))
    items = [(i, sentence(rng, 25) + ". " + sentence(rng, 12) + ".") for i in range(12)]
    rows += [(400 + i, sentence(rng, 80) + " " + t + " " + sentence(rng, 80)) for i, t in items]
    rows += [(500 + i, clean[i].upper()) for i in range(10)]  # exact copies: the larger id stays
    near = {i: clean[i] + " " + clean[i] for i in range(20, 24)}
    rows += [(600 + i, clean[i] + "  " + t.split(" ", 200)[-1]) for i, t in near.items()]
    rows += [(None, None), (None, "")]
    data = [(i, t, "en", "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long") \
        .repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, dict(rows)


def test_pipeline_keeps_what_it_should(spark, corpus):
    folder, texts = corpus
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, folder).collect()}
    kept = set(got)
    assert not kept & set(range(200, 320)), "toxic"
    assert not kept & set(range(400, 412)), "leaks"
    assert not kept & set(range(10)) and set(range(500, 510)) <= kept, "copies"
    assert set(range(10, 160)) - set(range(20, 24)) <= kept, "clean documents stay"
    tool = tiktoken.Encoding("own", pat_str=P.PATTERN, special_tokens={},
                             mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")))
    assert all(r["n_tokens"] == len(tool.encode_ordinary(texts[i] or "")) for i, r in got.items())


def test_stages_return_the_columns_of_documents(spark, corpus):
    folder, _ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.where("false"), folder).count() == 0, name
        odd = docs.where("doc_id < 12 or doc_id is null").withColumn("kept", docs["lang"])
        odd = odd.union(odd)
        assert stage(spark, odd, folder).columns == odd.columns, name
    assert not [n for n in corpus_pipeline.STAGES if n[0] == ""] and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_queries_are_registered_and_whole(spark, corpus):
    import __spark_entry__
    names = set(__spark_entry__.queries())
    assert set(queries.QUERIES) <= names and "pipeline" in names
    folder, texts = corpus
    leaks = queries.op2_decontamination(spark, folder).collect()
    assert {(r["doc_id"], r["item_id"]) for r in leaks} == {(400 + i, i) for i in range(12)}
    assert decontaminate.ITEMS >= 12
    for name in ("op1_quality", "op5_toxicity"):
        rows = queries.QUERIES[name](spark, folder)
        assert rows.count() == len(spark.read.parquet(f"{folder}/documents.parquet").collect())
        assert rows.where("held_out is null or score is null or predicted is null").count() == 0
