"""Suffix dedup where one passage stands in many texts with different surroundings."""

import random
from collections import Counter

import brute
import numpy as np
import pytest

from turnwatch.llm import suffix_dedup as S
from turnwatch.llm.repeats import key_rows, rank_of


def shared_passage(n):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(33))
    return [" ".join(word() for _ in range(30)) + " " + passage + " " + " ".join(word() for _ in range(30)) for _ in range(n)] + ["x" * 900, "x" * 450]


@pytest.mark.parametrize("hot", [2, 30, S.HOT])
def test_hot_keys_give_the_same_result(spark, hot):
    texts = shared_passage(40)
    docs = spark.createDataFrame(list(enumerate(texts)) + [(None, texts[0]), (3, texts[3])], "doc_id long, text string").repartition(3)
    given = [(r[0], r[1]) for r in docs.collect()]
    want = [(i, *w) for (i, _), w in zip(given, brute.suffix_dedup([t for _, t in given], 200))]
    got = S.suffix_dedup(docs, parts=4, hot=hot).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == Counter(want)


def test_messy_rows_with_every_repeated_key_hot(messy):
    given = [(r["doc_id"], r["text"]) for r in messy.collect()]
    want = [(i, *w) for (i, _), w in zip(given, brute.suffix_dedup([t for _, t in given], 40))]
    got = S.suffix_dedup(messy, size=40, gram=10, step=8, parts=5, hot=1).collect()
    assert Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in got) == Counter(want)


def test_runs_of_a_hot_key_are_not_merged_together():
    """The runs that go to the task of one key stay below a bound however many texts share the passage."""
    texts = [t.encode() for t in shared_passage(60)]
    keys, n = np.unique(S.Bytes(texts, 200, 128).keys(), return_counts=True)
    windows = []
    found, _ = S._local(texts, keys[n > 1], keys[n > 10], 200, 128, lambda a, *w: windows.append(w))
    sizes = Counter()
    for text, (_, key, _) in found.items():
        sizes[int(key)] += len(text)
    assert max(sizes.values(), default=0) <= 10 * (2 * 200 - 128)
    first, second, _ = S._folded(windows[0][1], windows[0][2], np.zeros(len(windows[0][1]), bool))
    assert len({texts and b"".join(texts)[s:s + 200] for s in windows[0][0]}) == len(first) > 0


def test_copies_do_not_make_a_key_hot():
    rng = np.random.default_rng(1)
    hashes = rng.integers(0, 2**63, 4000, dtype=np.uint64) * np.uint64(2) + np.arange(4000, dtype=np.uint64) % np.uint64(2)
    assert rank_of(np.array([1, 8, 1 << 40, 0], np.uint64)).tolist() == [0, 3, 15, 15]
    assert rank_of(hashes).max() >= 9
    # Key 5 with 4,000 surroundings, key 6 with 4,000 copies of one.
    ranks = np.append(rank_of(hashes), np.zeros(4000, np.uint16))
    row = key_rows(0, np.repeat(np.array([5, 6], np.uint64), 4000), 1, ranks).to_pylist()[0]
    packed = np.frombuffer(row["many"], np.uint16)
    assert (packed >> 4).tolist() == [4000, 4000] and packed[0] & 15 == ranks.max() and packed[1] & 15 == 0
