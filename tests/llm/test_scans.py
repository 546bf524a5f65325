import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelweave.llm import licenses, minhash, multi_index
from tests.llm.helpers import awkward, documents, empty, sentence


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0d]+", text.lower())
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} or {" ".join(words)}


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b)


# ---------------------------------------------------------------- licenses


def brute_licenses(text):
    words = re.findall("[a-z0-9]+", (text or "").lower())
    out = {}
    for name, template in licenses.TEMPLATES.items():
        parts = re.findall("[a-z0-9]+", template.lower())
        wanted = {tuple(parts[i : i + 5]) for i in range(len(parts) - 4)}
        reach = max(len(re.findall("[a-z0-9]+", t.lower())) for t in licenses.TEMPLATES.values())
        best = 0
        for at in range(0, max(len(words) - 4, 0), licenses.STEP):
            own = {tuple(words[i : i + 5]) for i in range(at, min(at + licenses.SHINGLES, len(words) - 4))}
            near = words[max(at - reach, 0) : at + licenses.WINDOW + reach]
            if own & wanted:
                best = max(best, len(wanted & {tuple(near[i : i + 5]) for i in range(len(near) - 4)}) / len(wanted))
        if best >= licenses.CONTAINMENT:
            out[name] = best
    return out


def test_licenses_equal_brute_force(spark):
    lines = list(licenses.TEMPLATES.values())
    texts = [f"{sentence(k, 3 + k * 5)} {line} {sentence(k + 50, k)}" for k, line in enumerate(lines)]
    texts += [line.upper().replace(" ", "\n ** ") for line in lines]
    texts += [" ".join(line.split()[:-2]) for line in lines] + [" ".join(line.split()[1:]) for line in lines]
    texts += [" ".join(lines) * 3, "Licensed under the " + sentence(3), "released under the mit", None, "", "é ü", sentence(5, 3000) + lines[0]]
    docs = documents(spark, list(enumerate(texts)) + [(None, lines[0]), (0, texts[0])])
    found = {}
    for r in licenses.scan(docs).collect():
        found.setdefault(r.doc_id, {})[r.license] = r.containment
    expected = {k: x for k, t in enumerate(texts) if (x := brute_licenses(t))} | {None: brute_licenses(lines[0])}
    assert {k: {n: round(c, 9) for n, c in v.items()} for k, v in found.items()} == {
        k: {n: round(c, 9) for n, c in v.items()} for k, v in expected.items()
    }


def test_license_edges(spark):
    assert licenses.scan(empty(spark)).count() == 0
    assert licenses.scan(awkward(spark)).count() == 0
    with pytest.raises(ValueError, match="words"):
        licenses.scan(empty(spark), {"x": "too short"})


# ---------------------------------------------------------------- fingerprints


def test_fingerprints_estimate_similarity(spark):
    texts = [sentence(k, 150) for k in range(40)]
    pairs = []
    for k, text in enumerate(texts):
        words = text.split()
        other = sentence(100 + k, 150).split()
        cut = k * 150 // 40
        pairs.append((text, " ".join(words[:cut] + other[cut:])))
    frame = spark.createDataFrame(pairs, "a string, b string")
    got = frame.select(
        "a", "b", minhash.likeness(minhash.fingerprint(F.col("a")), minhash.fingerprint(F.col("b"))).alias("s")
    ).collect()
    errors = np.array([r.s - jaccard(r.a, r.b) for r in got])
    assert abs(errors.mean()) < 0.02 and np.abs(errors).max() < 0.2


def edits(rows):
    """Plain edited texts, rows in ascending (null last, doc_id) order given."""
    out = []
    for k, (doc_id, text) in enumerate(rows):
        half = len(text) // 2
        out.append((doc_id, len(text), hashlib.sha256((text[: len(text) - half] + rows[(k + 1) % len(rows)][1][:half]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("per_range", [4096, 3])
def test_edited_texts_follow_the_ids(spark, per_range, monkeypatch):
    monkeypatch.setattr(minhash, "ROWS_PER_RANGE", per_range)
    rows = [(k * 5 - 20, ("ü𝒳" if k % 3 else "") + sentence(k, k)) for k in range(30)] + [(1000, "")]
    docs = documents(spark, [*rows[::-1]][:-1] + [rows[0]])
    found = minhash.compare_with_edits(docs).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_chars, r.edited_sha256) for r in found] == edits(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_fingerprints_of_awkward_rows(spark):
    docs = awkward(spark)
    found = minhash.compare_with_edits(docs).collect()
    assert len(found) == docs.count()
    by = {}
    for r in found:
        by.setdefault(r.doc_id, []).append(r)
    same = {r.fingerprint for d in (1, 2) for r in by[d]}
    assert len(same) == 1 and all(len(r.fingerprint) == minhash.BINS * minhash.DIGITS for r in found)
    assert by[4][0].fingerprint == by[5][0].fingerprint == by[6][0].fingerprint
    assert max(r.near_next for r in by[1] + by[2]) == 1.0
    assert minhash.compare_with_edits(empty(spark)).count() == 0
    one = minhash.compare_with_edits(documents(spark, [(1, "a b c d e f")])).collect()
    assert one[0].near_next == 1.0


# ---------------------------------------------------------------- nearest neighbours

VECTORS = "vec_id long, embedding array<float>, score double, cell int, shard long"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1.0, 2, 3) for i, v in rows], VECTORS)


def test_full_visits_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(300, 8)).astype(np.float32).round(1)
    data[50:80] = data[0]  # copies, so ties
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data)]
    bad = [(1000, None), (1100, [0.0] * 8), (1200, [None] + [1.0] * 7), (1300, [float("nan")] * 8), (1400, [1.0] * 5), (None, [1.0] * 8)]
    found = multi_index.search(vectors(spark, rows + bad), query_every=50, visit=1.0).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert sorted(got) == [0, 50, 100, 150, 200, 250]
    exact = data.astype(float)
    for q, hits in got.items():
        d = np.sqrt(((exact - exact[q]) ** 2).sum(axis=1))
        order = [int(i) for i in np.lexsort((np.arange(300), d)) if i != q][:10]
        assert [hits[k][0] for k in range(1, 11)] == order
        assert np.allclose([hits[k][1] for k in range(1, 11)], d[order], atol=1e-12)


def test_recall_and_traversal(spark):
    rng = np.random.default_rng(6)
    data = rng.normal(size=(2000, 16))
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(data.astype(np.float32))]
    found = multi_index.search(vectors(spark, rows), least=100).collect()
    hits = {}
    for r in found:
        hits.setdefault(r.query_id, set()).add(r.vec_id)
    data = data.astype(np.float32).astype(float)
    recall = []
    for q in hits:
        d = ((data - data[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        recall.append(len(hits[q] & set(np.argsort(d)[:10].tolist())) / 10)
    assert np.mean(recall) >= 0.9
    a, b = rng.random(5), rng.random(6)
    sizes = np.arange(30) % 3
    cells = multi_index.traverse(a, b, sizes, 10**9)
    sums = [a[c // 6] + b[c % 6] for c in cells]
    assert sums == sorted(sums) and sorted(cells) == [c for c in range(30) if sizes[c]]


def test_few_or_no_vectors(spark):
    assert multi_index.search(vectors(spark, [])).count() == 0
    few = multi_index.search(vectors(spark, [(0, [1.0, 2.0]), (7, [1.0, 3.0]), (7, [1.0, 3.0])])).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in few) == [(0, 1, 7), (0, 2, 7)]
    assert multi_index.search(vectors(spark, [(0, [1.0]), (1, [3.0])])).collect()[0].score == 2.0
