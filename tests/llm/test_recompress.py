from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from souk.llm import recompress

VOCABULARY = [f"w{i}" for i in range(200)]


def brute(rows):
    words = [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for _, t in rows]
    first = {}
    for (key, _), own in zip(rows, words):
        for k in range(len(own) - 12):
            order = (key is None, key or 0)
            run = tuple(own[k:k + 13])
            first[run] = min(first.get(run, order), order)
    out = []
    for (key, _), own in zip(rows, words):
        gone = [False] * len(own)
        for k in range(len(own) - 12):
            if first[tuple(own[k:k + 13])] < (key is None, key or 0):
                gone[k:k + 13] = [True] * 13
        kept = b" ".join(w for w, g in zip(own, gone) if not g)
        out.append((key, len(own), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found(docs):
    return sorted(((r["__id"], r["__n_words"], r["__n_removed"], r["__sha"])
                   for r in recompress.remove_repeats(docs).collect()), key=repr)


@pytest.mark.parametrize("vocabulary", [1, 2, 200])
def test_removals_match_brute_force(documents, vocabulary):
    rng = random.Random(vocabulary)

    def words(n):
        return [rng.choice(VOCABULARY[:vocabulary]) for _ in range(n)]
    passages = [words(n) for n in (12, 13, 14, 30, 60)]
    rows = []
    for i in range(60):
        own = words(rng.randrange(0, 50))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own) + 1)
            own[at:at] = rng.choice(passages)
        rows.append((rng.randrange(40), rng.choice([" ", "\n", " \t\x0b"]).join(own)))
    rows += [(None, " ".join(passages[3])), (None, " ".join(passages[3])), (50, None), (51, ""), (52, " \n "),
             (53, "w1 w2　w3 " * 20), (54, "x " * 60_000), (55, "x " * 40_000)]
    rng.shuffle(rows)
    assert found(documents(*rows)) == brute(rows)


def test_equal_windows_have_equal_keys():
    rng = random.Random(9)
    names = recompress.Names()
    for _ in range(150):
        own = VOCABULARY[:rng.choice([1, 2, 3, 10])]

        def words(n):
            return [rng.choice(own).encode() for _ in range(n)]
        shared = words(rng.choice([13, 14, 20]))
        texts = [words(rng.randrange(9)) + shared + words(rng.randrange(9)) for _ in range(4)]
        windows = recompress.Windows(names.numbers(texts), np.array([len(t) for t in texts]))
        flat = [w for t in texts for w in t]
        key_of = {}
        for at, key in zip(windows.first.tolist(), windows.keys().tolist()):
            assert key_of.setdefault(tuple(flat[at:at + 13]), key) == key


def test_each_window_is_hashed_in_one_round_only(monkeypatch):
    """Keys of a round that a later one replaces are not worked out."""
    rng = random.Random(4)
    texts = [[rng.choice(VOCABULARY).encode() for _ in range(300)] for _ in range(5)]
    windows = recompress.Windows(recompress.Names().numbers(texts), np.array([300] * 5))
    least, hashed = recompress.Windows._least, []
    monkeypatch.setattr(recompress.Windows, "_least", staticmethod(
        lambda symbols, low, high, level: hashed.append(len(low)) or least(symbols, low, high, level)))
    windows.keys()
    assert 0 < sum(hashed) <= len(windows.first)


def test_empty_table(documents):
    assert found(documents()) == []


def test_digests_of_few_and_of_many_windows_are_the_same():
    """op9: many are summed for all places at once, few are gathered; the second row only where it is asked for."""
    texts = [[random.Random(n).choice(VOCABULARY).encode() for _ in range(n)] for n in (0, 12, 13, 40, 5, 300)]
    sizes = np.array([len(x) for x in texts])
    both = recompress.Windows(recompress.Names().numbers(texts), sizes)
    one = recompress.Windows(recompress.Names().numbers(texts, 1), sizes)
    every = np.arange(len(both.first))
    assert len(every) == 1 + 28 + 288 and one.numbers.shape[0] == 1
    whole = both.digests(every)
    assert (one.digests(every, 1)[0] == whole[0]).all() and len(one.digests(every, 1)) == 1
    few = every[::40]
    for row, some in zip(whole, both.digests(few)):
        assert (row[few] == some).all()


def test_words_are_numbered_by_their_digest():
    """op9: new words are hashed together; each keeps the digest it has alone."""
    names = recompress.Names()
    for texts in ([[b"a", b"b"], [b"a"]], [[b"c", b"b"]], [[]]):
        got = names.numbers(texts)
        alone = [xxhash.xxh3_128_intdigest(w) for own in texts for w in own]
        assert [int(h) << 64 | int(low) for h, low in got.T] == alone
    assert names.fresh == []
