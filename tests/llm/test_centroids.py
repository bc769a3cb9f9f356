from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from souk.llm import centroids


def brute(vectors, places):
    """Nearest place of each vector, the smaller number on ties."""
    d = ((vectors[:, None, :] - places[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


@settings(max_examples=150, deadline=None)
@given(st.integers(1, 12), st.integers(1, 6), st.integers(1, 40), st.integers(0, 5), st.integers(0, 2 ** 32 - 1))
def test_walk_finds_the_nearest(k, dims, n, width, seed):
    rng = np.random.default_rng(seed)
    places = rng.integers(-width, width + 1, (k, dims))  # small ranges: many ties and equal centroids
    vectors = rng.integers(-width - 2, width + 3, (n, dims))
    number, distance = centroids.SortedLists(places).nearest(vectors)
    want = brute(vectors, places)
    assert number.tolist() == want[0].tolist() and distance.tolist() == want[1].tolist()


def test_walk_with_many_centroids_and_large_numbers():
    rng = np.random.default_rng(1)
    top = centroids.LARGEST
    places, vectors = rng.integers(-top, top, (700, 64)), rng.integers(-top, top, (50, 64))
    number, distance = centroids.SortedLists(places).nearest(vectors)
    want = brute(vectors, places)
    assert number.tolist() == want[0].tolist() and distance.tolist() == want[1].tolist()


def plain_clusters(rows, k, rounds, scale, dims):
    """Lloyd's rounds in plain Python."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows
            if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    text = lambda i: "" if i is None else str(i)
    at = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"3:{text(r[0])}".encode()).hexdigest(), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(at))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for c in range(len(at)):
            mine = [v for (_, v), o in zip(kept, own) if o == c]
            if mine:
                at[c] = [sum(x) // len(mine) for x in zip(*mine)]
    return sorted((text(i), *reversed(nearest(v))) for i, v in kept), at


def as_rows(found):
    return sorted(("" if r["vec_id"] is None else str(r["vec_id"]), r["__cluster"], r["__distance"]) for r in found.rows.collect())


@pytest.mark.parametrize("rounds", [0, 1, 10])
def test_rounds_with_bad_rows_repeats_and_ties(spark, rounds):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(i % 4, 0.4, 3)]) for i in range(120)]
    rows += [(7, [1.0, 1.0, 1.0])] * 40 + [(None, [0.5, -0.5, 0.25]), (None, [2.0, 2.0, 2.0])]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, float("nan"), 2.0]),
             (905, [1.0, float("-inf"), 2.0]), (906, [1.0, 2.0, 3.0, 4.0])]
    df = spark.createDataFrame([(i, v, "mine", 5) for i, v in rows], "vec_id long, embedding array<double>, __cluster string, distance int")
    found = centroids.cluster(df, rounds=rounds, dimensions=3, k=5)
    want, places = plain_clusters(rows, 5, rounds, 1024, 3)
    assert as_rows(found) == want
    assert found.centroids.tolist() == places
    assert found.rows.columns == ["vec_id", "embedding", "distance", "__cluster", "__distance"]
    assert sum(found.totals().values()) == sum(r[2] for r in want)


def test_fewer_rows_than_centroids_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(1, [0.0, 1.0]), (2, [4.0, 4.0])], schema)
    found = centroids.cluster(df, dimensions=2)
    assert len(found.centroids) == 2 and {r["__distance"] for r in found.rows.collect()} == {0}
    none = centroids.cluster(df.limit(0), dimensions=2)
    assert none.rows.count() == 0 and none.totals() == {} and none.digests() == []


def test_equal_vectors_everywhere(spark):
    df = spark.createDataFrame([(i, [0.5] * 4) for i in range(50)], "vec_id long, embedding array<float>")
    found = centroids.cluster(df, dimensions=4)
    assert {(r["__cluster"], r["__distance"]) for r in found.rows.collect()} == {(0, 0)}
    assert len(found.centroids) == 8  # the empty ones stay


def test_components_without_room_raise(spark):
    df = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="a component is beyond"):
        centroids.cluster(df, dimensions=2)
