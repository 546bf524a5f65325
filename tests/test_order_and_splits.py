import random
import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelweave.functions.order import prefix_sums, rank_by_key, shuffle_key
from labelweave.operators import splitting
from labelweave.sources import tables


def md5(*parts):
    return hashlib.md5(":".join(str(p) for p in parts).encode()).hexdigest()


def test_shuffle_is_the_md5_order(spark):
    rows = splitting.shuffle(spark.range(500).withColumnRenamed("id", "row_id"), 3).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == list(range(500))
    assert [r["row_id"] for r in rows] == sorted(range(500), key=lambda i: (md5(3, i), i))


def test_rank_per_group_with_limit_and_null_group(spark):
    df = spark.range(300).select(
        F.col("id").alias("row_id"), F.when(F.col("id") < 200, "hot").when(F.col("id") < 250, "cold").alias("g")
    )
    keyed = df.withColumn("k", shuffle_key(1, F.col("row_id")))
    ranks = rank_by_key(keyed, "k", ["row_id"], by=["g"], limit=60)
    counts = {r["g"]: r["count"] for r in ranks.groupBy("g").count().collect()}
    assert counts == {"hot": 60, "cold": 50, None: 50}
    hot = [r["row_id"] for r in ranks.filter("g = 'hot'").orderBy("ord").collect()]
    assert hot == sorted(range(200), key=lambda i: (md5(1, i), i))[:60]


@pytest.mark.parametrize("descending", [False, True])
def test_prefix_sums(spark, descending):
    df = spark.range(1000).select((F.col("id") * 0.5).alias("x"), F.lit(1).alias("one"), F.col("id").alias("v"))
    out = prefix_sums(df, "x", {"n": "one", "s": "v"}, descending).orderBy("x").collect()
    order = list(range(1000))[::-1] if descending else list(range(1000))
    total, expected = 0, {}
    for place, i in enumerate(order, 1):
        total += i
        expected[i * 0.5] = (place, total)
    assert {r["x"]: (r["n"], r["s"]) for r in out} == expected


def test_eleven_rows_in_three_chunks(spark):
    rows = splitting.chunk(spark.range(11).withColumnRenamed("id", "ord"), 3).collect()
    assert sorted(Counter(r["chunk"] for r in rows).items()) == [(1, 4), (2, 4), (3, 3)]
    assert all(r["chunk"] == 1 for r in rows if r["ord"] < 4)


def test_fewer_rows_than_chunks(spark):
    rows = splitting.chunk(spark.range(2).withColumnRenamed("id", "ord"), 5).orderBy("ord").collect()
    assert [r["chunk"] for r in rows] == [1, 2]


def test_fold_table_is_complementary():
    for n, n_train in ((3, 2), (4, 3), (5, 3)):
        rows = splitting.fold_table(n, n_train, n - n_train)
        for fold in {r[0] for r in rows}:
            train = {c for f, role, c in rows if f == fold and role == "train"}
            test = {c for f, role, c in rows if f == fold and role == "test"}
            assert not train & test and train | test == set(range(1, n + 1))
    assert [r for r in splitting.fold_table(3, 2, 1) if r[0] == 1] == [(1, "train", 1), (1, "train", 2), (1, "test", 3)]


def test_split_parts_and_no_join(spark):
    chunks = spark.range(12).select(F.col("id").alias("ord"), (F.col("id") % 3 + 1).cast("int").alias("chunk"))
    folds = splitting.fold_pairs(chunks, 3, 2, 1)
    assert folds.count() == 12 * 3
    plan = folds._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan


def test_batches(spark):
    ords = spark.range(10).withColumnRenamed("id", "ord")
    got = [r["iteration"] for r in splitting.assign_batches(ords, 3, 4).orderBy("ord").collect()]
    assert got == [1, 1, 1, 2, 2, 2, 2, 3, 3, 3]
    two = splitting.two_stage_batches(ords, 4, 3, 3).orderBy("ord").collect()
    assert [(r["stage"], r["iteration"]) for r in two] == [("init", 1)] * 3 + [("init", 2)] * 3 + [("retrain", 3)] * 3 + [
        ("retrain", 4)
    ]


def test_stratified_folds_are_even_per_label(spark):
    df = spark.range(100).select(F.col("id").alias("row_id"), (F.col("id") < 30).cast("int").alias("Label"))
    rows = splitting.stratified_kfold(df, 5, 2).groupBy("repeat", "Label", "fold").count().collect()
    assert {(r["Label"], r["count"]) for r in rows} == {(1, 6), (0, 14)} and len(rows) == 20


def test_samples_are_exact(spark):
    df = spark.range(1000).withColumnRenamed("id", "row_id")
    assert tables.sample_n(df, 123, 5).count() == 123
    assert tables.sample_n(df, 5000, 5).count() == 1000
    assert sorted(r["row_id"] for r in tables.sample_n(df, 9, 5).collect()) == sorted(
        sorted(range(1000), key=lambda i: (md5(5, i), i))[:9]
    )
    chunks = df.withColumn("chunk", (F.col("row_id") % 3 + 1).cast("int"))
    of_fold = splitting.repeated_subsamples(chunks, [(1, 10, 1), (2, 400, 7), (2, 900, 1)], 9, train_chunks={1: [1], 2: [1, 3]}).collect()
    for fold, size, repeat, own in ((1, 10, 1, {0}), (2, 400, 7, {0, 2}), (2, 900, 1, {0, 2})):
        ids = sorted((md5(f"9:{fold}:{size}:{repeat}", i), i) for i in range(1000) if i % 3 in own)[:size]
        got = sorted((r["ord"], r["row_id"]) for r in of_fold if (r["fold"], r["size"], r["repeat"]) == (fold, size, repeat))
        assert got == [(place, i) for place, (_, i) in enumerate(ids)]
    subsamples = splitting.repeated_subsamples(df, [(1, 10, 1), (1, 10, 2), (2, 40, 1)])
    assert sorted(r["count"] for r in subsamples.groupBy("fold", "size", "repeat").count().collect()) == [10, 10, 40]


@pytest.mark.parametrize("partitions", [2000, 10000])
def test_running_sums_at_cluster_settings(spark, partitions):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    rows = spark.createDataFrame([(k * 7 % 501, k) for k in range(501)], "place long, v long").coalesce(1)
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        found = {r.place: r.total for r in prefix_sums(rows, "place", {"total": "v"}).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    values, total = {k * 7 % 501: k for k in range(501)}, 0
    for place in sorted(values):
        total += values[place]
        assert found[place] == total


def test_samples_whose_bound_was_too_low_are_drawn_again(spark, monkeypatch):
    rows = spark.range(600).withColumnRenamed("id", "row_id")
    monkeypatch.setattr(splitting, "ROOM", 0.2)
    got = splitting.repeated_subsamples(rows, [(1, 100, 1), (1, 600, 2), (1, 5, 1)], 3).collect()
    assert sorted((r["size"], r["ord"]) for r in got) == sorted((n, k) for n in (5, 100, 600) for k in range(n))


@pytest.mark.parametrize("room", [1.0, 0.05])
def test_highest_values_of_every_group(spark, monkeypatch, room):
    """Also where bounds are too high at first, groups hold less than asked for, or ties decide."""
    from labelweave.functions import order

    monkeypatch.setattr(order, "ROOM", room)
    rng = random.Random(2)
    rows = [(k, rng.choice(["a", "a", "a", "b", None]), rng.choice([0.5, None, rng.random(), rng.random()])) for k in range(5000)]
    rows += [(9000 + k, "small", 0.1) for k in range(7)]
    df = spark.createDataFrame(rows, "row_id long, g string, x double")
    got = {}
    for r in order.top_by_value(df, "x", 300, ["g"], ["row_id"]).collect():
        got.setdefault(r["g"], []).append((r["rank"], r["row_id"]))
    for g in ("a", "b", None, "small"):
        ranked = sorted((x is None, -(x or 0), k) for k, group, x in rows if group == g)[:300]
        assert sorted(got[g]) == [(place, k) for place, (_, _, k) in enumerate(ranked, 1)]
    assert order.top_by_value(df.limit(0), "x", 3, ["g"], ["row_id"]).count() == 0
    whole = order.top_by_value(df.filter("x is not null"), "x", 5, [], ["row_id"]).orderBy("rank").collect()
    assert [r["row_id"] for r in whole] == [k for _, k in sorted((-x, k) for k, _, x in rows if x is not None)[:5]]


def test_subsample_keys_are_hashed_in_compiled_code(spark, capsys):
    """One hash of an exploded row, not a list of hashes for each row; a null id hashes as before."""
    df = spark.range(500).select(F.when(F.col("id") > 0, F.col("id")).alias("row_id"))
    got = splitting.repeated_subsamples(df, [(1, 20, 1), (1, 490, 2)], 4)
    for size, repeat in ((20, 1), (490, 2)):
        start = f"4:1:{size}:{repeat}"
        ids = sorted(range(500), key=lambda i: md5(start, i) if i else hashlib.md5(start.encode()).hexdigest())[:size]
        found = {r["row_id"]: r["ord"] for r in got.filter(F.col("repeat") == repeat).collect()}
        assert found == {i or None: place for place, i in enumerate(ids)}
    plans = []
    whole = splitting.materialise
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(splitting, "materialise", lambda rows, name: plans.append(rows) or whole(rows, name))
        splitting.repeated_subsamples(df, [(1, 20, 1)], 4)
    plans[0].explain()
    plan = capsys.readouterr().out
    assert "md5" in plan and "transform(" not in plan and "lambdafunction" not in plan
