import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelweave.llm import ngrams, quality, toxicity
from tests.llm.helpers import awkward, documents, empty, sentence, with_inner_names

LABELS = "doc_id long, quality int, toxic int"


def units(text):
    raw = text.lower().encode("utf-16-le", "surrogatepass")
    return [int.from_bytes(raw[i : i + 2], "little") for i in range(0, len(raw), 2)]


def grams(text, n):
    padded = [32] * (n - 1) + units(text)
    return [tuple(padded[i : i + n]) for i in range(len(padded) - n + 1)]


def brute_model(texts, n):
    """Interpolated modified Kneser-Ney, written down plainly: a function (gram) -> probability."""
    tables = {n: Counter(g for t in texts for g in grams(t, n))}
    for k in range(n - 1, 0, -1):
        tables[k] = Counter(g[1:] for g in tables[k + 1])
    off = {k: ngrams.discounts([sum(v == c for v in t.values()) for c in (1, 2, 3, 4)]) for k, t in tables.items()}
    below = {k: defaultdict(list) for k in tables}
    for k, t in tables.items():
        for g, c in t.items():
            below[k][g[:-1]].append(c)

    def probability(g):
        if not g:
            return 1 / 65536
        k = len(g)
        seen = below[k].get(g[:-1])
        if not seen:
            return probability(g[1:])
        d = lambda c: off[k][min(c, 3) - 1]
        own = tables[k][g] - d(tables[k][g]) if g in tables[k] else 0
        return (own + sum(map(d, seen)) * probability(g[1:])) / sum(seen)

    return probability


ODD = ["Zürich 12!", "", "ﬂ 日本語のテキスト 𝒳𝒴 \x00", "a" * 50]


@pytest.mark.parametrize("head, group", [(1 << 19, 1 << 20), (40, 64), (0, 7)])
def test_model_equals_the_formula(spark, monkeypatch, head, group):
    """Whatever is broadcast, and wherever texts are cut into groups."""
    monkeypatch.setattr(ngrams, "HEAD", head)
    monkeypatch.setattr(ngrams, "GROUP_UNITS", group)
    texts = [sentence(k) for k in range(6)] + ODD
    model = ngrams.train(ngrams.counts(documents(spark, list(enumerate(texts))), F.lit(0)))
    assert all(len(codes) <= head for codes, _ in model.head.values())
    plain = brute_model(texts, ngrams.ORDER)
    asked = [sentence(3), sentence(99), sentence(99), "unseen é ② 𝒳 語", *ODD, None]
    found = ngrams.log_likelihoods(documents(spark, list(enumerate(asked))), model, F.lit(0), ["doc_id"]).collect()
    assert len(found) == len(asked)
    for row in found:
        text = asked[row["doc_id"]] or ""
        assert row["length"] == len(units(text))
        assert row["loglik"] == pytest.approx(sum(math.log(plain(g)) for g in grams(text, ngrams.ORDER)), abs=1e-6)


def test_chances_of_a_context_add_up(spark):
    texts = ["abcab", "abd ca", "bad"]
    plain = brute_model(texts, 4)
    seen = {c for t in texts for c in units(t)} | {32}
    for context in [(97, 98), (32, 98), (1, 2)]:
        known = sum(plain((32, *context, c)) for c in seen)
        unseen = plain((32, *context, 7)) * (65536 - len(seen))
        assert known + unseen == pytest.approx(1)


def test_several_models_share_tables(spark):
    texts = [sentence(k) for k in range(8)]
    docs = documents(spark, list(enumerate(texts)))
    model = ngrams.train(ngrams.counts(docs, F.pmod("doc_id", F.lit(2)).cast("int")))
    assert model.numbers == (0, 1)
    found = ngrams.log_likelihoods(docs, model, F.pmod("doc_id", F.lit(2)).cast("int"), ["doc_id"]).collect()
    for row in found:
        plain = brute_model(texts[row["doc_id"] % 2 :: 2], 4)
        assert row["loglik"] == pytest.approx(sum(math.log(plain(g)) for g in grams(texts[row["doc_id"]], 4)), abs=1e-6)
    assert ngrams.train(ngrams.counts(empty(spark), F.lit(0))).numbers == ()


def toxic_docs(spark, n=300):
    rows = []
    for k in range(n):
        words = sentence(k, 40).split()
        if k % 4 == 0:
            words[5::9] = ["zwump"] * len(words[5::9])
        rows.append((k, " ".join(words)))
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0)) for k in range(n)], LABELS)
    return documents(spark, rows), labels


def told(text):
    """Expressions of one and two words, as tuples."""
    out = []
    for piece in re.split(r"[!-&(-,./:-@\[-`{-~]", (text or "").lower()):
        words = [w for w in re.split("[\x00-\x20\x7f]+", piece) if w]
        out += [(w,) for w in words] + list(zip(words, words[1:]))
    return out


def brute_ratios(rows):
    """Log-likelihood ratio per word of each expression of toxic texts, from (text, toxic)."""
    out = {}
    for k in (1, 2):
        n = {c: Counter(e for t, toxic in rows if toxic == c for e in told(t) if len(e) == k) for c in (0, 1)}
        texts = Counter(e for t, _ in rows for e in set(told(t)) if len(e) == k)

        def shares(counts):
            d = ngrams.discounts([sum(v == i for v in counts.values()) for i in (1, 2, 3, 4)])
            total = sum(counts.values())
            cut = {e: d[min(v, 3) - 1] for e, v in counts.items()}
            return {e: (v - cut[e]) / total for e, v in counts.items()}, sum(cut.values()) / total

        shared, freed = shares(texts)
        shared = {e: v + freed / (len(texts) + 1) for e, v in shared.items()}
        (ordinary, rest0), (toxic, rest1) = shares(n[0]), shares(n[1])
        for e in n[1]:
            chance = [ordinary.get(e, 0) + rest0 * shared[e], toxic[e] + rest1 * shared[e]]
            out[e] = (math.log(chance[1]) - math.log(chance[0])) / k
    return {e: r for e, r in out.items() if r >= toxicity.TELLING}


@pytest.mark.parametrize("bits", [1 << 24, 64])
def test_scores_equal_the_formula(spark, monkeypatch, bits):
    """Also where the filter of bits lets nearly everything pass."""
    monkeypatch.setattr(toxicity, "FILTER_BITS", bits)
    docs, labels = toxic_docs(spark, 120)
    taught = [(r["text"], int(r["doc_id"] % 4 == 0)) for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1]
    ratios = brute_ratios(taught)
    found, slope, start = toxicity.means(docs, labels)
    assert slope > 0
    keyed = {(r["_key1"], r["_key2"]): r["mean"] for r in found.collect()}
    for r in ngrams.with_text_key(docs).collect():
        best = sorted((ratios[e] for e in set(told(r["text"])) if e in ratios), reverse=True)[:2]
        assert keyed.get((r["_key1"], r["_key2"]), 0.0) == pytest.approx(sum(best) / 2)
    scores = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    for r in ngrams.with_text_key(docs).collect():
        mean = keyed.get((r["_key1"], r["_key2"]), 0.0)
        assert scores[r["doc_id"]] == pytest.approx(1 / (1 + math.exp(-(slope * mean + start))))


def test_expressions_of_text_without_spaces():
    import pyarrow as pa

    long = "日本語" * 20
    found = {k: (row.tolist(), code.tolist()) for k, row, code in toxicity.expressions(pa.array([long, None, "a b", long[:3]]))}
    assert len(found[1][0]) == 60 + 2 + 1 and len(set(found[1][1][:60])) == 3
    assert len(found[2][0]) == 59 + 1


def test_held_out_texts_are_told_apart(spark):
    docs, labels = toxic_docs(spark)
    found = toxicity.scored(docs, labels).collect()
    held = [r for r in found if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 60
    assert all((r[-1] >= toxicity.REJECT) == (r.doc_id % 4 == 0) for r in held)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = toxic_docs(spark, 90)
    turned = labels.withColumn("toxic", F.when(toxicity.fold_of() == toxicity.HELD_OUT, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    plain, other = (toxicity.scored(docs.drop("score"), x).select("doc_id", "score").collect() for x in (labels, turned))
    assert sorted(plain) == sorted(other)


def test_toxicity_of_awkward_rows(spark):
    docs = awkward(spark).drop("score")
    some = [(1, 1, 1), (2, 1, 0), (2, 1, 1), (3, None, None), (None, 1, 1), (4, 0, 0), (9, 1, 0), (999, 1, 1)]
    for rows in (some, [], [(1, 1, 0), (9, 1, 0)], [(1, 1, 1), (9, 1, 1), (10, 1, 1)]):
        found = toxicity.scored(docs, spark.createDataFrame(rows, LABELS)).collect()
        assert len(found) == docs.count()
        assert all(0 <= r.score <= 1 for r in found)
    assert toxicity.scored(empty(spark).drop("score"), spark.createDataFrame(some, LABELS)).count() == 0


def test_quality_keeps_clean_and_rejects_junk(spark):
    clean = [(k, sentence(k), "en" if k % 2 else "de") for k in range(80)]
    junk = [(100 + k, " ".join(w + "#%" for w in sentence(k).split()), "en") for k in range(9)]
    labels = spark.createDataFrame([(k, 1, 0) for k in range(60)] + [(100, 0, 0), (60, 1, 1)], LABELS)
    found = quality.judged(documents(spark, clean + junk), labels).collect()
    assert all(not r["_keep"] for r in found if r.doc_id >= 100)
    assert sum(r["_keep"] for r in found if r.doc_id < 100) >= 74
    texts = dict((r[0], r[1]) for r in clean[:60])
    folds = {k: zlib.crc32(str(k).encode()) % 2 for k in texts}
    unseen = [brute_model([t for k, t in texts.items() if folds[k] != fold], 4) for fold in (0, 1)]

    def perplexity(k):
        return math.exp(-sum(math.log(unseen[folds[k]](g)) for g in grams(texts[k], 4)) / len(texts[k]))

    for lang in ("en", "de"):
        levels = sorted(perplexity(k) for k, _, x in clean[:60] if x == lang)
        (threshold,) = {r["_threshold"] for r in found if r.lang == lang}
        assert threshold == pytest.approx(levels[math.ceil(0.99 * len(levels)) - 1])
    docs = documents(spark, clean + junk)
    assert sorted(map(str, quality.kept(docs, labels).collect())) == sorted(str(r) for r in docs.collect() if r.doc_id < 100 and next(f for f in found if f.doc_id == r.doc_id)["_keep"])
    assert quality.kept(docs, labels, limit=0).count() == quality.kept(docs, labels).count()


def test_kept_texts_by_either_way(spark):
    docs, labels = toxic_docs(spark, 120)
    wide = with_inner_names(docs)
    few, many = toxicity.kept(wide, labels), toxicity.kept(wide, labels, limit=0)
    assert few.columns == wide.columns
    assert sorted(r.doc_id for r in few.collect()) == sorted(r.doc_id for r in many.collect()) == [k for k in range(120) if k % 4]
    assert toxicity.kept(docs, labels.limit(0)).count() == 120
    assert toxicity.kept(empty(spark), labels).count() == 0


def test_pipeline_over_no_documents(spark, tmp_path):
    _, labels = toxic_docs(spark, 10)
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    empty(spark).select(*corpus_pipeline.COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (9, None, 0), (None, 1, 0), (7, 1, 0)], LABELS)
    found = quality.judged(docs, labels).collect()
    assert len(found) == docs.count()
    assert all(r["_keep"] and r["_perplexity"] is None for r in found if not r.text)
    assert all(r["_threshold"] is not None for r in found)
    none = quality.judged(docs, labels.filter("false")).collect()
    assert all(r["_keep"] for r in none) and len(none) == docs.count()
    assert quality.judged(empty(spark), labels).count() == 0


def test_pipeline_stages_keep_the_columns_of_documents(spark, tmp_path):
    docs, labels = toxic_docs(spark, 120)
    rows = docs.drop("score", "fingerprint")
    rows = rows.union(awkward(spark).drop("score", "fingerprint")).union(rows.filter("doc_id = 7"))
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    kept, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, stage(spark, kept, str(tmp_path))
        kept.write.parquet(f"{tmp_path}/{name}")
        kept = spark.read.parquet(f"{tmp_path}/{name}")
        assert kept.columns == corpus_pipeline.COLUMNS
        assert kept.count() and kept.exceptAll(before).count() == 0
    assert not [r for r in kept.collect() if "zwump" in (r.text or "")]
    pairs = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(pairs) == len(set(pairs))
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in kept.collect()}


def test_judged_passes_columns_of_any_name(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 1, 0), (7, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    found = quality.judged(with_inner_names(docs), labels)
    plain = quality.judged(docs, labels)
    assert sorted(map(str, found.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    assert found.filter("_lang <> 'x' or _none <> 'x' or _row <> 'x'").count() == 0
