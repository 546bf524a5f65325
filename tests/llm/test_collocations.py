import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from labelweave.llm import bytewords, collocations
from tests.llm.helpers import DOCS, awkward, documents, empty, with_inner_names

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def pieces(text):
    for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
        yield re.findall("[^ \t]+", piece)


def brute(rows, longest, least, cover, top):
    """Candidates counted from all phrases of the texts, one by one."""
    counts = defaultdict(Counter)
    totals = Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                for i in range(len(words) - size + 1):
                    counts[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, f in counts.items():
        found = []
        for phrase, a in f.items():
            if len(phrase) < 2 or a < least:
                continue
            covered = any(
                f[longer] * 100 >= cover * a
                for longer in f
                if len(longer) > len(phrase)
                and f[longer] >= least
                and any(longer[i : i + len(phrase)] == phrase for i in range(len(longer)))
            )
            if covered:
                continue
            cuts = [(1_000_000 * a * a // (f[phrase[:k]] * f[phrase[k:]]), k) for k in range(1, len(phrase))]
            score, k = min(cuts)
            found.append((-score, -a, " ".join(phrase).encode(), f[phrase[:k]], f[phrase[k:]]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(out)


def corpus(spark, seed, n=60):
    rng = random.Random(seed)
    words = ["the", "a", "of", "Red", "ünï", "x1", "dog", "\x00z", "ran"]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(n):
        text = "".join(rng.choice(words) + rng.choice([" ", "  ", "\t", ", ", ". ", "\n", " ", " "]) for _ in range(rng.randint(0, 80)))
        if i % 4 == 0:
            text += ". " + passage
        rows.append((i, text, rng.choice(["en", "de", None, "und"])))
    return documents(spark, rows)


def got(df):
    columns = ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


@pytest.mark.parametrize("longest, least, cover", [(3, 3, 50), (2, 2, 100), (4, 3, 60)])
def test_equals_counting_every_phrase(spark, longest, least, cover):
    docs = corpus(spark, longest)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert got(collocations.mine(docs, longest, least, cover, 25)) == brute(rows, longest, least, cover, 25)


def test_hot_words_and_small_buckets_change_nothing(spark, monkeypatch):
    docs = corpus(spark, 9)
    expected = got(collocations.mine(docs, 3, 3, 50, 30))
    monkeypatch.setattr(collocations, "HOT_SHARE", 10)
    monkeypatch.setattr(collocations, "BUCKET_WORDS", 50)
    monkeypatch.setattr(collocations, "PATH_EDGES", 4)
    assert got(collocations.mine(docs, 3, 3, 50, 30)) == expected


def test_repeated_passages_are_compacted_to_paths(spark):
    text = " ".join(f"w{i}" for i in range(700))
    docs = documents(spark, [(i, f"{text}. other {i}") for i in range(5)])
    _, counts = collocations.phrase_counts(docs, 3, 3)
    paths = collocations.compacted(counts[3], collocations.nodes_of(counts[3], counts[2], 2), 3).collect()
    # 698 edges in rows of 256, one path.
    assert sorted(len(p["words"]) for p in paths) == [698 - 512 + 2, 258, 258]
    assert sum(p["opens"] for p in paths) == sum(p["closes"] for p in paths) == 1
    assert {p["n"] for p in paths} == {5}


def test_colliding_codes_lead_to_another_seed(spark, monkeypatch):
    docs = corpus(spark, 5)
    expected = got(collocations.mine(docs, 3, 3, 50, 30))
    plain, seeds = collocations.vocabulary, []

    def clashing(rows, seed=0):
        seeds.append(seed)
        found = plain(rows, seed)
        return found.withColumn("code", F.lit(7).cast("long")) if seed == 0 else found

    monkeypatch.setattr(collocations, "vocabulary", clashing)
    assert got(collocations.mine(docs, 3, 3, 50, 30)) == expected
    assert seeds == [0, 1]


def test_first_rows_of_large_groups_play_rounds(spark):
    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), F.pmod(F.xxhash64("id"), F.lit(300)).alias("x"), "id")
    found = collocations.first_of_each(rows, "g", [F.desc("x"), F.asc("id")], ["id"], 5)
    everything = sorted(((r["g"], -r["x"], r["id"]) for r in rows.collect()))
    expected = [[e for e in everything if e[0] == g][:5] for g in (0, 1)]
    assert sorted((r["g"], -r["x"], r["id"]) for r in found.collect()) == sorted(expected[0] + expected[1])
    assert {r["rank"] for r in found.collect()} == {1, 2, 3, 4, 5}


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    rows = [(r["text"], r["lang"]) for r in docs.collect()]
    assert got(collocations.mine(docs, 3, 10, 50, 50)) == brute(rows, 3, 10, 50, 50)
    assert got(collocations.mine(with_inner_names(docs), 3, 10, 50, 50)) == brute(rows, 3, 10, 50, 50)
    assert collocations.mine(empty(spark)).count() == 0
    assert collocations.mine(spark.createDataFrame([(1, None, None, None, 0, 0.0, "")], DOCS)).count() == 0


@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_long_texts_are_cut_between_pieces_only(size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("aB .,\tß") for _ in range(rng.randint(0, 200))) for _ in range(20)] + [None, ""]
    found = []
    for group in bytewords.words_of(pa.array(texts), collocations.KINDS, bytewords.BREAK, size):
        cuts = np.flatnonzero(np.diff(group.piece)) + 1
        for part in np.split(np.arange(len(group.piece)), cuts):
            found.append((int(group.row[part[0]]), [group.text[int(i)].as_py().decode() for i in part]))
    assert found == [(i, words) for i, t in enumerate(texts) for words in pieces(t) if words]
