from __future__ import annotations

import hashlib
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from souk.llm import middle

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_reading(key, text):
    """The contract word by word, without a boundary set."""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{key}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in (0, 8, 16, 24))
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, x = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{x}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{x}<M>{m}"


@pytest.mark.parametrize("places, kind", [
    (np.arange(5, 60_000), middle.RunContainer), (np.arange(0, 8_000, 2), middle.ArrayContainer),
    (np.arange(0, 65_536, 3), middle.BitmapContainer), (np.array([65_535]), middle.ArrayContainer)])
def test_kinds_of_container(places, kind):
    held = middle.container(places)
    assert isinstance(held, kind)
    assert [held.select(r) for r in range(0, len(places), 97)] == places[::97].tolist()


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, 400_000), min_size=1, max_size=300), st.integers(0, 300_000), st.integers(0, 90_000))
def test_select_of_mixed_sets(some, run, length):
    places = np.array(sorted(some | set(range(run, run + length))), np.int64)
    held = middle.BoundarySet(places)
    assert len(held) == len(places)
    ranks = {0, len(places) - 1, len(places) // 2, *range(0, len(places), 1 + len(places) // 50)}
    assert all(held.select(r) == places[r] for r in ranks)


@settings(max_examples=300, deadline=None)
@given(st.integers(), st.text(st.sampled_from(list("ab<PSM> \t\n\x0b\x0c\r\x1c  é😀")), max_size=40))
def test_as_the_plain_reading(key, text):
    assert middle.rearrange(str(key), text) == plain_reading(key, text)


def rearranged(spark, rows, schema="doc_id long, text string, __form string, n long"):
    out = middle.fill_in_middle(spark.createDataFrame([(*r, "mine", 7) for r in rows], schema))
    return out.withColumn("back", middle.restored(F.col("__output"), F.col("__form"))), out.columns


def test_rows_of_every_kind(spark):
    long = "wörd  😀\n" * 120_000
    texts = [None, "", " ", "\n\t ", "one", " two  words ", "has <M> inside", "a" * 200_000, long, " " * 70_000 + "x",
             "<<S", "S><P", "last\r\n"]
    rows = [(i, t) for i in range(30) for t in texts if len(t or "") < 1000 or i % 10 == 0] + [(None, "no key at all")]
    rows += rows[5:9]
    df, columns = rearranged(spark, rows)
    assert columns == ["doc_id", "text", "n", *middle.ADDED]  # a clashing input column is replaced
    got = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["n"], r["__n"], r["__form"], r["__prefix_chars"] or 0,
                  r["__middle_chars"] or 0, r["__output"], r["back"]) for r in df.collect())
    want = []
    for key, text in rows:
        n, form, p, m, out = plain_reading("" if key is None else key, text or "")
        want.append((key is None, key or 0, text or "", 7, n, form, p or 0, m or 0, out, text or ""))
    assert got == sorted(want)
    assert {r[5] for r in want} == {"plain", "spm", "psm"}


def test_empty_table(spark):
    df, _ = rearranged(spark, [])
    assert df.count() == 0


def test_other_marks_and_rates(spark):
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    df = spark.createDataFrame([(i, f"some words <P> of number {i}") for i in range(200)], "doc_id long, text string")
    out = middle.fill_in_middle(df, marks=marks, seed=7, rate=100, suffix_first=0)
    out = out.withColumn("back", middle.restored(F.col("__output"), F.col("__form"), marks)).collect()
    assert {r["__form"] for r in out} == {"psm"}
    assert all(r["back"] == r["text"] and r["__output"].startswith("<|pre|>") for r in out)
