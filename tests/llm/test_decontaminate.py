from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from souk.llm import decontaminate as d

WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "so") for b in ("n", "r", "sh", "l", "d")] + ["the", "of"]


def item(rng, n):
    words = [rng.choice(WORDS) for _ in range(n)]
    cut = rng.randrange(2, n - 1)
    words[cut] += "."
    return " ".join(words).capitalize() + "."


def leaking(text, items):
    words = d.normal_words(text or "")
    out = set()
    for key, body in items:
        sides = [d.shingles(x) for x in d.question_and_answer(body or "")]
        if any(sides) and all(
                not s or len(s & d.shingles(words, len(next(iter(s))))) / len(s) >= d.OVERLAP for s in sides):
            out.add(key)
    return out


@pytest.fixture
def case(spark, documents):
    rng = random.Random(8)
    items = [(i, item(rng, rng.randrange(6, 40))) for i in range(60)] + [(60, None), (61, ""), (62, "..."), (63, "Kan.")]
    texts = []
    for i in range(150):
        words = [rng.choice(WORDS) for _ in range(rng.randrange(0, 400))]
        if i % 3 == 0:
            leak = items[rng.randrange(60)][1].split()
            if i % 2:
                leak[rng.randrange(len(leak))] = "changed"
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() for w in leak]
        texts.append(" ".join(words))
    texts += [None, "", "!!!", items[0][1], items[1][1] + " " + items[2][1]]
    return texts, items, spark.createDataFrame(items, "item_id long, text string")


def found(marked):
    return {r["doc_id"]: {x["item"] for x in r["__leaks"]} for r in marked.collect()}


@pytest.mark.parametrize("part", [1024, 7])
def test_leaks_match_brute_force(case, documents, monkeypatch, part):
    texts, items, table = case
    monkeypatch.setattr(d, "ITEMS", part)
    got = found(d.mark_leaks(documents(*enumerate(texts)), table))
    assert got == {i: leaking(t, items) for i, t in enumerate(texts)}


def test_search_finds_all_above_threshold():
    rng = random.Random(5)
    items = [(i, item(rng, 20)) for i in range(90)]
    frequency = Counter(w for _, t in items for w in set(d.normal_words(t)))
    index = d.Index(items, frequency, len(items), 20.0)
    every = set(range(index.blocks))
    for _ in range(60):
        terms = sorted(rng.sample(range(len(index.lists)), rng.randrange(1, len(index.lists))))
        scores = Counter()
        for t in terms:
            for number, impact in zip(*index.lists[t]):
                scores[number] += impact
        want = {n for n, x in scores.items() if x >= 1 - d.SLACK}
        assert {n for n, _ in index.search(terms, every)} == want


def test_empty_tables_and_repeated_rows(spark, documents, case):
    texts, items, table = case
    assert d.mark_leaks(documents(), table).collect() == []
    nothing = d.mark_leaks(documents((1, "a b")), table.where("false"))
    assert [r["__leaks"] for r in nothing.collect()] == [[]]
    twice = d.mark_leaks(documents((1, items[0][1]), (1, items[0][1])), table.union(table))
    assert [[x["item"] for x in r["__leaks"]] for r in twice.collect()] == [[0], [0]]
    assert twice.where(d.leaked()).count() == 2


def test_question_and_answer():
    assert d.question_and_answer("A b? C d.") == (["a", "b"], ["c", "d"])
    assert d.question_and_answer("a b c") == (["a"], ["b", "c"])
    assert d.question_and_answer("") == ([], [])
    assert np.isclose(len(d.shingles(list("abcdef"))), 2)
