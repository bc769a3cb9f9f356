from __future__ import annotations

import random

import numpy as np
import pytest
import xxhash

from souk.llm import simhash


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints, bits=2):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(prints))]


def near_texts(rng, n):
    base = [" ".join(rng.choice(["the", "of", "ox", "elk", "yak"]) + str(rng.randrange(40)) for _ in range(60))
            for _ in range(n)]
    return base + [t.replace(t.split()[30], "changed", 1) for t in base] + [t.upper() for t in base[:5]]


def test_groups_match_brute_force(documents):
    rng = random.Random(4)
    texts = near_texts(rng, 40) + [None, "", " \t\n", "one", "one two", "　", "long " * 40_000]
    docs = documents(*enumerate(texts))
    got = {r["__id"]: (r["__fp"] & (1 << 64) - 1, r["__group"]) for r in simhash.near_groups(docs).collect()}
    prints = [brute_print(t) for t in texts]
    assert [got[i][0] for i in range(len(texts))] == prints
    assert [got[i][1] for i in range(len(texts))] == brute_groups(prints)


@pytest.mark.parametrize("limit", [8, 4096])
def test_links_keep_all_components(spark, limit):
    rng = np.random.default_rng(limit)
    seeds = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = {int(x) for x in seeds}
    for x in seeds:  # chains and clouds around a few patterns, so that nodes are hot
        for _ in range(40):
            x = int(x) ^ (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            prints.add(x)
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    found = {r["v"]: r["root"] for r in simhash.components(simhash.links(df, limit=limit)).collect()}
    groups = brute_groups(prints)
    by_root = {}
    for x, g in zip(signed, groups):
        by_root.setdefault(found.get(x, x), set()).add(g)
    assert all(len(g) == 1 for g in by_root.values()) and len(by_root) == len(set(groups))


def test_node_prunes_without_loss():
    rng = np.random.default_rng(1)
    prints = np.unique(rng.integers(0, 1 << 12, 700, dtype=np.uint64))
    ordered = prints[np.argsort(simhash.gray_rank(prints))]
    root = simhash.node_links(ordered)
    want = brute_groups([int(x) for x in ordered])
    assert len(set(zip(root.tolist(), want))) == len(set(want)) == len(set(root.tolist()))


def test_gray_rank_inverts_the_gray_code():
    n = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


def test_one_row_of_each_group_stays(documents):
    text = " ".join(f"w{i}" for i in range(50))
    docs = documents((4, text), (2, text.upper()), (2, text), (9, "other words here"), (9, "other words here"),
                     (3, None), (5, ""))
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 9]


def test_empty_table(documents):
    assert simhash.near_groups(documents()).collect() == []
    assert simhash.simhash_dedup(documents()).collect() == []


def test_groups_that_share_a_key_and_groups_of_null_keys(documents):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(50)) for x in "abcd")
    near = [t.upper() for t in (a, b, c, d)]  # another text, the same fingerprint
    docs = documents((7, a), (7, b), (8, near[0]), (9, near[1]), (7, a), (None, c), (None, near[2]), (None, d),
                     (None, near[3]), (None, near[1]))
    groups = simhash.near_groups(docs).collect()
    assert len({r["__root"] for r in groups}) == 4
    kept = [(r["doc_id"], r["text"].lower()) for r in simhash.simhash_dedup(docs).collect()]
    assert sorted(kept, key=str) == sorted([(7, a), (7, b), (None, c), (None, d)], key=str)
