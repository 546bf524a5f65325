import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from labelweave.llm import mixing
from tests.llm.helpers import DOCS, awkward, empty, sentence, with_inner_names


def corpus(spark, seed=1, n=300):
    rng = random.Random(seed)
    sources = ["b", "a", None, "é", "hot", "hot", "hot", "hot", "z"]
    rows = [(i, sentence(i, rng.randint(0, 90)), "en", rng.choice(sources), 0, 0.0, "") for i in range(n)]
    rows += [(n + i, sentence(3, 40), "en", "hot", 0, 0.0, "") for i in range(100)]
    return spark.createDataFrame(rows, DOCS)


def size(text):
    return len(re.findall("[^\x20\x09-\x0d]+", text or ""))


def brute_targets(sizes, weights=(5, 2, 1)):
    """Water filling: excess of the sources above their limit is shared by the rest until none is above."""
    total, fixed = 1.5 * sum(sizes), {}
    weight = [weights[i % 3] for i in range(len(sizes))]
    while True:
        rest = [i for i in range(len(sizes)) if i not in fixed]
        left = total - sum(fixed.values())
        share = {i: left * weight[i] / sum(weight[j] for j in rest) for i in rest}
        over = {i: 2.0 * sizes[i] for i in rest if share[i] > 2 * sizes[i]}
        if not over:
            return [fixed.get(i, share.get(i)) for i in range(len(sizes))]
        fixed |= over


@pytest.mark.parametrize("n", [1, 2, 3, 10, 257, 5000])
def test_permutations_hit_every_place_once(n):
    for key in (0, 1, -5, 1 << 62):
        places = mixing.permuted(np.arange(n), np.full(n, n), np.full(n, key, np.int64))
        assert sorted(places.tolist()) == list(range(n))
    if n > 100:
        assert abs(np.corrcoef(np.arange(n), places)[0, 1]) < 0.2


@pytest.mark.parametrize("seed", range(5))
def test_targets_fill_up_to_the_limits(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 5, 100, 10_000]) for _ in range(rng.randint(1, 9))]
    found = mixing.targets(sizes)
    assert found == pytest.approx(brute_targets(sizes))
    assert all(t <= 2 * s for t, s in zip(found, sizes))
    assert sum(found) == pytest.approx(1.5 * sum(sizes))


def test_mix_holds_whole_blocks_in_the_wanted_shares(spark, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_SLOTS", 32)
    monkeypatch.setattr(mixing, "GROUP_SHARDS", 3)
    monkeypatch.setattr(mixing, "LINE_ROWS", 20)
    docs = corpus(spark)
    mix = mixing.mix(docs, 16).collect()
    rows = docs.collect()
    sizes = Counter()
    for r in rows:
        sizes[r["source"]] += size(r["text"])
    names = sorted(x for x in sizes if x is not None) + [None]
    target = dict(zip(names, brute_targets([sizes[x] for x in names])))
    words = Counter()
    places = defaultdict(int)
    covered = defaultdict(Counter)
    for r in mix:
        words[r["source"]] += r["end"] - r["begin"]
        places[r["shard"], r["slot"]] += r["end"] - r["begin"]
        for w in range(r["begin"], r["end"]):
            covered[r["doc_id"]][w] += 1
    for name in names:
        assert abs(words[name] - target[name]) <= 16 + 0.01 * target[name]
    # Slots are numbered without gaps in full shards, and hold a block each.
    shards = Counter(s for s, _ in places)
    assert all(shards[s] == 32 for s in range(max(shards)))
    assert sorted(s for s, _ in places) == sorted(shards.elements())
    assert all(k < 32 and 0 < n <= 16 for (_, k), n in places.items())
    # No word comes a third time, and none a second time before all of its source came once.
    first = {r["doc_id"]: r["source"] for r in rows}
    for doc_id, counts in covered.items():
        assert max(counts.values()) <= 2
        if target[first[doc_id]] > sizes[first[doc_id]] + 16:
            assert min(counts.values()) >= 1
    found = {r["doc_id"]: r for r in mixing.taken(docs, 16).collect()}
    assert len(found) == len(rows)
    for r in rows:
        one = found[r["doc_id"]]
        assert one["size"] == size(r["text"]) and one["source_size"] == sizes[r["source"]]
        assert one["target"] == pytest.approx(target[r["source"]])
        assert one["taken"] == sum(covered[r["doc_id"]].values()) <= 2 * one["size"]


def test_reruns_and_partitionings_agree(spark):
    docs = corpus(spark, 2)
    once = sorted(map(str, mixing.mix(docs).collect()))
    assert once == sorted(map(str, mixing.mix(docs.repartition(13, "text")).collect()))
    assert once != sorted(map(str, mixing.mix(docs, seed=99).collect()))


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    for rows in (docs, with_inner_names(docs)):
        found = mixing.taken(rows).collect()
        assert sorted(str((r["doc_id"], r["size"])) for r in found) == sorted(str((r["doc_id"], size(r["text"]))) for r in docs.collect())
        assert all(r["taken"] <= 2 * r["size"] for r in found)
        assert abs(sum(r["taken"] for r in found) - found[0]["target"]) <= 64
    assert mixing.taken(empty(spark)).count() == 0
    assert mixing.mix(empty(spark)).count() == 0
    blank = spark.createDataFrame([(1, None, None, None, 0, 0.0, ""), (2, " ", None, "s", 0, 0.0, "")], DOCS)
    assert sorted((r["doc_id"], r["taken"], r["target"]) for r in mixing.taken(blank).collect()) == [(1, 0, 0.0), (2, 0, 0.0)]
