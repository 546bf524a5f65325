import random

import numpy as np
import pytest
import xxhash

from labelweave.llm import golay, simhash
from labelweave.llm.components import connected_components
from tests.llm.helpers import awkward, documents, empty, sentence, with_inner_names


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def brute_components(prints):
    """Component of each position over all pairs within three bits."""
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def test_words_two_bits_apart_share_an_index():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 1 << 23, 3000)
    flipped = words ^ (1 << rng.integers(0, 23, 3000)) ^ (1 << rng.integers(0, 23, 3000))
    for a, b in zip(golay.neighbours(words), golay.neighbours(flipped)):
        assert set(a[a >= 0]) & set(b[b >= 0])


def test_every_pair_within_three_bits_shares_a_key():
    rng = random.Random(2)
    values = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    near = values.copy()
    for k in range(len(near)):
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            near[k] ^= np.uint64(1 << bit)
    keys = []
    for some in (values, near):
        found, rows = simhash.keys_of(some)
        keys.append([set(found[rows == k]) for k in range(len(some))])
    assert all(a & b for a, b in zip(*keys))


def test_near_duplicates_equal_brute_force(spark):
    docs = awkward(spark)
    rows = docs.collect()
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for row, root in zip(rows, roots):
        if row["doc_id"] is not None:
            least[root] = min(row["doc_id"], least.get(root, row["doc_id"]))
    expected = sorted(str((r["doc_id"], format(p, "016x"), least.get(root))) for r, p, root in zip(rows, prints, roots))
    found = simhash.near_duplicates(docs).collect()
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in found) == expected
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("run", [1024, 6])
def test_links_join_what_all_pairs_join(spark, run):
    """Crowds of close fingerprints, with the large groups' way forced for a small ``run``."""
    rng = random.Random(3)
    values = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(60):
            value = centre
            for bit in rng.sample(range(64), rng.randint(0, 5)):
                value ^= 1 << bit
            values.add(value)
    values = sorted(values)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distinct = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    joined = {r.node: r.component for r in connected_components(simhash.links(distinct, run)).collect()}
    roots = brute_components(values)
    groups = {}
    for value, root in zip(signed, roots):
        groups.setdefault(root, set()).add(joined.get(value, value))
    assert all(len(g) == 1 for g in groups.values())
    assert len(set().union(*groups.values())) == len(groups)


def test_one_of_each_group_stays(spark):
    docs = awkward(spark)
    rows = docs.collect()
    roots = brute_components([brute_print(r["text"]) for r in rows])
    least = {}
    for row, root in zip(rows, roots):
        least.setdefault(root, []).append((row["doc_id"] is None, row["doc_id"] or 0))
    expected = sorted(min(x) for x in least.values())
    kept = simhash.one_per_group(docs)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == expected
    assert kept.columns == docs.columns
    assert simhash.one_per_group(empty(spark)).count() == 0
    copies = documents(spark, [(5, sentence(1)), (5, sentence(1)), (5, sentence(2))])
    assert sorted(r.text for r in simhash.one_per_group(copies).collect()) == sorted([sentence(1), sentence(2)])


def test_components_of_a_chain_and_a_hub(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1000 + k) for k in range(1, 300)] + [(5, 5), (None, 3)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in found} == {k: 0 for k in range(201)} | {1000 + k: 1000 for k in range(300)}
    assert len(found) == 501
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_per_group_passes_columns_of_any_name(spark):
    docs = awkward(spark)
    kept = simhash.one_per_group(with_inner_names(docs))
    assert kept.columns == with_inner_names(docs).columns
    plain = simhash.one_per_group(docs)
    assert sorted(map(str, kept.select(docs.columns).collect())) == sorted(map(str, plain.collect()))
    assert kept.filter("_hash <> 'x' or _id <> 'x' or component <> 'x'").count() == 0
