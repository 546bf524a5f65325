"""The two Kneser-Ney models of words against a plain computation."""

import functools
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelweave.llm import ngrams, queries, toxicity
from tests.llm.helpers import documents, sentence

LABELS = "doc_id long, quality int, toxic int"


def pieces(text):
    """Words of each piece of a text."""
    found = [re.split("[\x00-\x20\x7f]+", p) for p in re.split(r"[!-&(-,./:-@\[-`{-~]", (text or "").lower())]
    return [[w for w in words if w] for words in found]


def told(text):
    return {e for words in pieces(text) for e in [*zip(words), *zip(words, words[1:])]}


def cut(counts):
    """What is cut from each count."""
    d = ngrams.discounts([sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)])
    return {e: d[min(v, 3) - 1] for e, v in counts.items()}


def brute_models(rows):
    """Pairs, chances of a word, and of a word given the one before, in both classes (0, 1) and in all texts (2)."""
    seen = {c: [t for t, toxic in rows if c == 2 or toxic == c] for c in (0, 1, 2)}
    pairs = {c: Counter(p for t in texts for words in pieces(t) for p in zip([None, *words], words)) for c, texts in seen.items()}
    follows = {c: Counter(w for _, w in pairs[c]) for c in pairs}

    cuts = {c: (cut(pairs[c]), cut(follows[c])) for c in pairs}

    def alone(c, w):
        off, total = cuts[c][1], sum(follows[c].values())
        below = 1 / (len(follows[2]) + 1) if c == 2 else alone(2, w)
        return (follows[c].get(w, 0) - off.get(w, 0) + sum(off.values()) * below) / total

    def given(c, a, b):
        off, total = cuts[c][0], sum(n for p, n in pairs[c].items() if p[0] == a)
        below = alone(2, b) if c == 2 else given(2, a, b)
        left = sum(x for p, x in off.items() if p[0] == a)
        return (pairs[c].get((a, b), 0) - off.get((a, b), 0) + left * below) / total if total else below

    return pairs, functools.cache(alone), functools.cache(given)


def brute_ratios(rows):
    pairs, alone, given = brute_models(rows)
    out = {}
    for _, b in pairs[1]:
        out[b,] = math.log(alone(1, b) / alone(0, b))
    for a, b in pairs[1]:
        if a is not None:
            both = (out[a,] + math.log(given(1, a, b) / given(0, a, b))) / 2
            if both > max(out[a,], out[b,]):
                out[a, b] = both
    return {e: r for e, r in out.items() if r >= toxicity.TELLING}


def taught_texts(n=160):
    """Texts with breaks, with a toxic word behind many words, one that always follows the same, and a toxic pair of plain words."""
    rows = []
    for k in range(n):
        words = sentence(k, 40).split()
        if k % 4 == 0:
            words[5::9] = ["zwump"] * len(words[5::9])
            words[7:9] = ["grelb", "snorf"]
            words[16:18] = ["blunt", "spoon"]
        else:  # words of any text, side by side in toxic ones only
            words[2], words[12], words[33], words[18] = "blunt", "blunt", "blunt", "spoon"
        if k % 5 == 0:
            words[20] += "."
        rows.append((k, " ".join(words)))
    return rows, [(k, 1, int(k % 4 == 0)) for k in range(n)]


def test_ratios_equal_the_formula(spark):
    rows, labels = taught_texts()
    docs, labels = documents(spark, rows), spark.createDataFrame(labels, LABELS)
    taught = [(t, int(k % 4 == 0)) for k, t in rows if zlib.crc32(str(k).encode()) % 3 != 1]
    ratios = brute_ratios(taught)
    assert ("zwump",) in ratios and ("blunt", "spoon") in ratios
    found, slope, _ = toxicity.means(docs, labels, toxicity.kneser_ney_ratios)
    assert slope > 0
    keyed = {(r["_key1"], r["_key2"]): r["mean"] for r in found.collect()}
    for r in ngrams.with_text_key(docs).collect():
        best = sorted((ratios[e] for e in told(r["text"]) if e in ratios), reverse=True)[:2]
        assert keyed.get((r["_key1"], r["_key2"]), 0.0) == pytest.approx(sum(best) / 2)


def test_fold_models_leave_their_part_out(spark):
    rows, _ = taught_texts(60)
    taught = [(k % 4 == 0, k % 3 == 0, t) for k, t in rows]
    docs = spark.createDataFrame([(int(x), int(p), t) for x, p, t in taught], "toxic int, part int, text string")
    _, tables = toxicity.kneser_ney_ratios(docs)
    for number in (0, 1):
        ratios = brute_ratios([(t, int(x)) for x, p, t in taught if int(p) != number])
        assert sorted(r["ratio"] for r in tables[number].collect()) == pytest.approx(sorted(ratios.values()))


def test_chances_of_the_formula_add_up():
    rows, _ = taught_texts(12)
    pairs, alone, given = brute_models([(t, int(k % 4 == 0)) for k, t in rows])
    words = {b for _, b in pairs[2]}
    unknown = sum(alone(1, w) for w in words)
    assert 0.9 < unknown < 1 and unknown + alone(1, "unknown") == pytest.approx(1)
    for a in ("grelb", "zwump", None):
        assert sum(given(1, a, w) for w in words) + given(1, a, "unknown") == pytest.approx(1)


def test_a_word_that_follows_one_word_is_not_telling_alone(spark):
    """Of two equally frequent toxic words the one behind many words has the higher ratio: continuations count, not occurrences."""
    rows = [(int(k % 2), k % 3 % 2, f"w{k % 23} zwump w{k % 19} grelb snorf" if k % 2 else f"w{k % 23} w{k % 19} w{k % 17}") for k in range(200)]
    docs = spark.createDataFrame(rows, "toxic int, part int, text string")
    ratio = {r["code"]: r["ratio"] for r in toxicity.kneser_ney_ratios(docs)[1][toxicity.ALL].collect()}
    codes = {w: toxicity._code(w.encode()) for w in ("zwump", "snorf")}
    codes = {w: c - (1 << 64) if c >= 1 << 63 else c for w, c in codes.items()}
    assert ratio[codes["zwump"]] > ratio.get(codes["snorf"], 0.0)


@pytest.mark.parametrize("labelled", [[], [(1, 1, 0), (2, 1, 0)], [(1, 1, 1), (2, 1, 1)], [(1, 1, 1), (2, 1, 0), (3, None, None)]])
def test_few_or_one_sided_labels(spark, labelled):
    docs = documents(spark, [(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "a b c"), (9, "x")])
    labels = spark.createDataFrame(labelled, LABELS)
    found = toxicity.scored(docs, labels, "p", teach=toxicity.kneser_ney_ratios).collect()
    assert len(found) == 6 and all(0 <= r["p"] <= 1 for r in found)


def test_the_query_takes_the_chain_of_words(spark, tmp_path):
    rows, labels = taught_texts()
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    asked = {r["doc_id"]: r["score"] for r in queries.op4(spark, str(tmp_path)).collect()}
    found = toxicity.scored(docs, spark.createDataFrame(labels, LABELS), "p", teach=toxicity.kneser_ney_ratios)
    assert asked == {r["doc_id"]: pytest.approx(r["p"]) for r in found.select("doc_id", F.col("p")).collect()}
