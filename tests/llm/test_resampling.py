import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from labelweave.llm import resampling
from tests.llm.helpers import awkward, documents, empty, sentence, with_inner_names

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, n):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(docs, target, n, buckets, least, percent):
    """(doc_id, n_features, weight, score, rank) of every row, feature by feature."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, runs(text, n)[1]))
    for text in target:
        t.update(map(bucket, runs(text, n)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log(((t[b] + 1) * (all_s + buckets)) / ((s[b] + 1) * (all_t + buckets))))

    rows, able = [], []
    for doc_id, text in docs:
        words, features = runs(text, n)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in features)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(features), weight, score, None])
        if len(words) >= least:
            able.append(rows[-1])
    able.sort(key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for rank, row in enumerate(able[: percent * len(able) // 100], 1):
        row[4] = rank
    return rows


def key(row):
    return tuple((x is None, x or 0) for x in row)


def corpus(spark, n=120):
    rng = random.Random(4)
    return documents(spark, [(i, sentence(i, rng.randint(0, 60)) + f" Ä{i % 7}—x") for i in range(n)])


def target(spark):
    return spark.createDataFrame([(1, "alpha beta gamma alpha beta"), (2, None), (3, "")], "item_id long, text string")


@pytest.mark.parametrize("n, head", [(1, 100_000), (1, 10), (2, 20), (3, 30), (2, 100_000)])
def test_equals_hashing_every_feature(spark, n, head):
    docs, goal = corpus(spark), target(spark)
    found = resampling.drawn(resampling.weighted(docs, goal, max_words=n, buckets=50, head=head), 20, 30)
    got = [[r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")] for r in found.collect()]
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(got, key=key) == sorted(brute(plain, [r["text"] for r in goal.collect()], n, 50, 20, 30), key=key)


def test_ranks_over_many_ranges(spark, monkeypatch):
    docs, goal = corpus(spark), target(spark)
    rows = resampling.weighted(docs, goal)
    expected = sorted(map(tuple, resampling.drawn(rows, 20, 50).collect()), key=key)
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    assert sorted(map(tuple, resampling.drawn(rows, 20, 50).collect()), key=key) == expected


def test_head_and_pairs_are_bounded_and_exact(spark):
    head = resampling.head_of(corpus(spark), 2, 500)
    assert 0 < len(head.words) <= 500 and 0 < len(head.pairs) <= 500
    assert len(resampling.head_of(corpus(spark), 2, 3).words) == 0
    words = head.words.to_pylist()
    for pair, state in zip(head.pairs.tolist(), head.pair_states.tolist()):
        assert state == zlib.crc32(words[pair // len(words)] + b" " + words[pair % len(words)])


def test_awkward_and_empty_tables(spark):
    docs, goal = awkward(spark), target(spark)
    plain = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = sorted(brute(plain, [r["text"] for r in goal.collect()], 1, 10_000, 20, 10), key=key)
    for rows in (docs, with_inner_names(docs)):
        found = resampling.drawn(resampling.weighted(rows, goal))
        got = [[r[c] for c in ("doc_id", "n_features", "weight", "score", "rank")] for r in found.collect()]
        assert sorted(got, key=key) == expected
    assert resampling.drawn(resampling.weighted(empty(spark), goal)).count() == 0
    unaimed = resampling.drawn(resampling.weighted(docs, goal.limit(0))).collect()
    assert len(unaimed) == len(plain)


def test_resample_returns_whole_rows(spark):
    docs = corpus(spark)
    found = resampling.resample(docs, target(spark), 25).collect()
    able = sum(len(runs(r["text"], 1)[0]) >= 20 for r in docs.collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert sorted(r["rank"] for r in found) == list(range(1, able * 25 // 100 + 1))
    assert all(texts[r["doc_id"]] == r["text"] and r["lang"] == "en" for r in found)
