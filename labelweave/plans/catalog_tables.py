"""Registered queries: sources, cleaning, splitting."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.functions.numbers import to_number
from labelweave.operators import cleaning, splitting
from labelweave.plans.catalog import query, table
from labelweave.session import scratch_path
from labelweave.sources import tables as src

# ---------------------------------------------------------------- sources


@query(
    "a1_scan_csv",
    "SELECT event_id, user_id, event_type, value, props FROM events",
)
def a1(spark, d):
    cols = ["event_id", "user_id", "event_type", "value", "props"]
    path = src.write_table(table(spark, d, "events").select(*cols), "flows", scratch_path(spark, "csv"), False, "csv")
    return src.scan_csv(spark, path, cols).select(
        to_number(F.col("event_id")).cast("long").alias("event_id"),
        to_number(F.col("user_id")).cast("long").alias("user_id"),
        "event_type",
        to_number(F.col("value")).alias("value"),
        "props",
    )


@query("a2_scan_indexed_csv", "SELECT o_orderkey AS row_id, o_orderstatus, o_totalprice FROM orders")
def a2(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    path = src.write_table(orders, "saved", scratch_path(spark, "csv"), False, "csv")
    df = src.scan_indexed_csv(spark, path, orders.columns)
    return df.withColumn("o_totalprice", to_number(F.col("o_totalprice")))


@query(
    "a3_union_sources",
    """
    SELECT source, key, balance,
           row_number() OVER (ORDER BY md5(concat_ws(':', source, key)), source, key) - 1 AS row_id
    FROM (SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS balance FROM customer
          UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier)
    """,
)
def a3(spark, d):
    frames = {
        "customer": table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance")),
        "supplier": table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("balance")),
    }
    return src.union_sources(frames, ["key"])


@query("a4_write_table", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def a4(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return spark.read.parquet(src.write_table(rows, "orders", scratch_path(spark, "out"), dated=True))


@query(
    "a5_write_iteration",
    """
    SELECT o_orderkey, o_totalprice, 'train_1' AS fold,
           CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS INTEGER) AS iteration
    FROM orders
    """,
)
def a5(spark, d):
    orders = table(spark, d, "orders")
    path = scratch_path(spark, "run")
    for iteration, status in enumerate(["F", "O", "P"], 1):
        rows = orders.filter(F.col("o_orderstatus") == status).select("o_orderkey", "o_totalprice")
        target = src.write_iteration(rows, path, "train", "run_1", "train_1", iteration)
    return spark.read.parquet(target).select("o_orderkey", "o_totalprice", "fold", "iteration")


@query(
    "a6_sample_n",
    """
    SELECT o_orderkey, o_totalprice FROM orders
    ORDER BY md5(concat_ws(':', 7, o_orderkey)), o_orderkey LIMIT 1000
    """,
)
def a6(spark, d):
    return src.sample_n(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), 1000, 7, "o_orderkey")


@query(
    "a7_sample_frac",
    """
    SELECT event_id, value FROM events
    WHERE substring(md5(concat_ws(':', 3, event_id)), 1, 8) < '40000000'
    """,
)
def a7(spark, d):
    return src.sample_frac(table(spark, d, "events").select("event_id", "value"), 0.25, 3, "event_id")


# ---------------------------------------------------------------- cleaning


@query(
    "b1_binarize_label",
    """
    SELECT event_id, event_type,
           CASE WHEN contains(event_type, 's') THEN 1 WHEN contains(event_type, 'i') THEN 0 END AS label
    FROM events
    """,
)
def b1(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    return cleaning.binarize_label(events, "event_type", (("i", 0), ("s", 1)), out="label")


def _raw_text():
    """A text column with numbers, blanks, words and infinities."""
    digits = F.regexp_extract("props", "[0-9]+", 0)
    return (
        F.when(F.col("event_type") == "error", F.col("props"))
        .when(F.col("event_type") == "signup", F.lit(""))
        .when(F.col("event_type") == "view", F.concat(digits, F.lit("e-1")))
        .when(F.col("event_type") == "click", F.concat(F.lit(" -"), digits, F.lit(".5 ")))
        .otherwise(F.lit("inf"))
    )


RAW_TEXT = """
    CASE event_type WHEN 'error' THEN props WHEN 'signup' THEN ''
         WHEN 'view' THEN regexp_extract(props, '[0-9]+') || 'e-1'
         WHEN 'click' THEN ' -' || regexp_extract(props, '[0-9]+') || '.5 '
         ELSE 'inf' END
"""
NUMBER = r"'[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?'"


@query(
    "b2_coerce_numeric",
    f"""
    SELECT event_id, CASE WHEN regexp_full_match(trim(t), {NUMBER}) THEN TRY_CAST(trim(t) AS DOUBLE) END AS k
    FROM (SELECT event_id, {RAW_TEXT} AS t FROM events)
    """,
)
def b2(spark, d):
    raw = table(spark, d, "events").select("event_id", _raw_text().alias("k"))
    return cleaning.coerce_numeric(raw, ["k"])


def _with_holes(events):
    return (
        F.when(F.col("event_type") == "error", F.lit(float("inf")))
        .when(F.col("event_type") == "view", F.lit(float("-inf")))
        .when(F.col("event_type") == "signup", F.lit(float("nan")))
        .otherwise(F.col("value"))
    )


@query(
    "b3_null_non_finite",
    "SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view', 'signup') THEN value END AS value FROM events",
)
def b3(spark, d):
    events = table(spark, d, "events")
    return cleaning.null_non_finite(events.select("event_id", _with_holes(events).alias("value")), ["value"])


@query(
    "b4_impute_median",
    """
    SELECT event_id, coalesce(v, (SELECT median(v) FROM (
        SELECT CASE WHEN event_type NOT IN ('error', 'view', 'signup') THEN value END AS v FROM events))) AS value
    FROM (SELECT event_id, CASE WHEN event_type NOT IN ('error', 'view', 'signup') THEN value END AS v FROM events)
    """,
)
def b4(spark, d):
    events = table(spark, d, "events")
    return cleaning.impute_median(events.select("event_id", _with_holes(events).alias("value")), ["value"])


@query(
    "b5_minmax_scale",
    """
    SELECT o_orderkey,
           round((o_totalprice - (SELECT min(o_totalprice) FROM orders))
                 / (SELECT max(o_totalprice) - min(o_totalprice) FROM orders), 6) AS o_totalprice,
           0.0::DOUBLE AS same
    FROM orders
    """,
)
def b5(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.lit(4.0).alias("same"))
    scaled = cleaning.minmax_scale(orders, ["o_totalprice", "same"])
    return scaled.withColumn("o_totalprice", F.round("o_totalprice", 6))


FLOW_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
FLOW_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _flows(spark, d):
    """Line items with missing values, as raw flow records."""
    return table(spark, d, "lineitem").select(
        *FLOW_KEY,
        F.when(F.col("l_quantity") != 10, F.col("l_quantity")).alias("l_quantity"),
        "l_extendedprice",
        F.when(F.col("l_discount") < 0.09, F.col("l_discount")).otherwise(F.lit(float("nan"))).alias("l_discount"),
        "l_tax",
    )


@query(
    "b6_clean",
    """
    WITH raw AS (
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
               CASE WHEN l_quantity <> 10 THEN l_quantity END AS l_quantity, l_extendedprice,
               CASE WHEN l_discount < 0.09 THEN l_discount END AS l_discount, l_tax
        FROM lineitem),
    fit AS (
        SELECT median(l_quantity) mq, min(l_quantity) aq, max(l_quantity) zq,
               median(l_extendedprice) mp, min(l_extendedprice) ap, max(l_extendedprice) zp,
               median(l_discount) md, min(l_discount) ad, max(l_discount) zd,
               median(l_tax) mt, min(l_tax) lt, max(l_tax) zt
        FROM raw)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           round((coalesce(l_quantity, mq) - aq) / (zq - aq), 6) AS l_quantity,
           round((coalesce(l_extendedprice, mp) - ap) / (zp - ap), 6) AS l_extendedprice,
           round((coalesce(l_discount, md) - ad) / (zd - ad), 6) AS l_discount,
           round((coalesce(l_tax, mt) - lt) / (zt - lt), 6) AS l_tax
    FROM raw, fit
    """,
)
def b6(spark, d):
    scaled = cleaning.clean(_flows(spark, d), FLOW_COLUMNS)
    return scaled.select(*FLOW_KEY, *[F.round(c, 6).alias(c) for c in FLOW_COLUMNS])


@query(
    "b7_profile",
    """
    SELECT 'value' AS "column", count(*) AS n_rows, 0::BIGINT AS n_null,
           count(*) FILTER (event_type = 'signup') AS n_nan,
           count(*) FILTER (event_type IN ('error', 'view')) AS n_inf,
           false AS all_finite,
           min(value) FILTER (event_type NOT IN ('error', 'view', 'signup')) AS min_value,
           max(value) FILTER (event_type NOT IN ('error', 'view', 'signup')) AS max_value
    FROM events
    UNION ALL
    SELECT 'user_id', count(*), 0, 0, 0, true, min(user_id)::DOUBLE, max(user_id)::DOUBLE FROM events
    """,
)
def b7(spark, d):
    events = table(spark, d, "events")
    return cleaning.profile(events.select("user_id", _with_holes(events).alias("value")), ["value", "user_id"])


@query(
    "b8_missing_report",
    """
    WITH n AS (SELECT count(*)::DOUBLE AS n FROM documents),
         m AS (SELECT count(*) FILTER (l.quality IS NULL) AS q, count(*) FILTER (d.lang IS NULL) AS g
               FROM documents d LEFT JOIN labels l USING (doc_id))
    SELECT 'quality' AS "column", q AS n_missing, round(q / n, 6) AS share FROM n, m
    UNION ALL SELECT 'lang', g, round(g / n, 6) FROM n, m
    """,
)
def b8(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return cleaning.missing_report(joined, ["quality", "lang"]).withColumn("share", F.round("share", 6))


@query("b9_drop_columns", "SELECT c_custkey, c_nationkey FROM customer")
def b9(spark, d):
    return cleaning.drop_columns(table(spark, d, "customer"), ["c_name"], last=2)


@query("b10_select_features", "SELECT o_orderkey, o_totalprice FROM orders")
def b10(spark, d):
    return cleaning.select_features(table(spark, d, "orders"), ["o_totalprice"], ["o_orderkey"])


@query(
    "b11_exclude_matching",
    "SELECT event_id, event_type FROM events WHERE NOT regexp_matches(event_type, 'click|^sign')",
)
def b11(spark, d):
    return cleaning.exclude_matching(table(spark, d, "events").select("event_id", "event_type"), "event_type", "click|^sign")


@query(
    "b12_concat_columns",
    "SELECT doc_id, lang, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)",
)
def b12(spark, d):
    left = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    return cleaning.concat_columns(left, table(spark, d, "labels"), "doc_id")


# ---------------------------------------------------------------- splitting

SEED = 11
ORD = f"row_number() OVER (ORDER BY md5(concat_ws(':', {SEED}, o_orderkey)), o_orderkey) - 1"


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_orderstatus")


@query("c1_shuffle", f"SELECT o_orderkey, o_orderstatus, {ORD} AS ord FROM orders")
def c1(spark, d):
    return splitting.shuffle(_orders(spark, d), SEED, "o_orderkey")


CHUNKS = """
    SELECT o_orderkey, o_orderstatus, ord,
           CAST(ntile({n}) OVER (ORDER BY ord) AS INTEGER) AS chunk
    FROM (SELECT o_orderkey, o_orderstatus, {ord} AS ord FROM orders)
"""


@query("c2_chunk", CHUNKS.format(n=7, ord=ORD))
def c2(spark, d):
    ordered = splitting.shuffle(_orders(spark, d), SEED, "o_orderkey", total="_total")
    return splitting.chunk(ordered, 7, rows=F.col("_total")).drop("_total")


def _fold_values(n, n_train, n_test, reverse=True):
    return ", ".join(f"({f}, '{r}', {c})" for f, r, c in splitting.fold_table(n, n_train, n_test, reverse))


@query(
    "c3_fold_pairs",
    """
    WITH chunks AS (SELECT p_partkey, CAST(p_size % 3 + 1 AS INTEGER) AS chunk FROM part)
    SELECT fold, role, p_partkey, chunk FROM chunks JOIN (
        SELECT * FROM (VALUES (1, 'train', 1), (1, 'train', 2), (2, 'train', 1), (2, 'train', 3),
                              (3, 'train', 2), (3, 'train', 3), (1, 'test', 3), (2, 'test', 2), (3, 'test', 1))
        v(fold, role, chunk)) USING (chunk)
    """,
)
def c3(spark, d):
    chunks = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3 + 1).cast("int").alias("chunk"))
    return splitting.fold_pairs(chunks, 3, 2, 1)


@query(
    "c4_split",
    f"""
    WITH chunks AS ({CHUNKS.format(n=5, ord=ORD)})
    SELECT fold, role, o_orderkey, o_orderstatus, ord, chunk FROM chunks
    JOIN (SELECT * FROM (VALUES {_fold_values(5, 3, 2)}) v(fold, role, chunk)) USING (chunk)
    """,
)
def c4(spark, d):
    return splitting.split(_orders(spark, d), 5, 3, 2, SEED, "o_orderkey")


@query(
    "c5_fold_pairs_forward",
    """
    WITH chunks AS (SELECT p_partkey, CAST(p_size % 3 + 1 AS INTEGER) AS chunk FROM part)
    SELECT fold, role, p_partkey, chunk FROM chunks JOIN (
        SELECT * FROM (VALUES (1, 'train', 1), (1, 'train', 2), (2, 'train', 1), (2, 'train', 3),
                              (3, 'train', 2), (3, 'train', 3), (1, 'test', 1), (2, 'test', 2), (3, 'test', 3))
        v(fold, role, chunk)) USING (chunk)
    """,
)
def c5(spark, d):
    chunks = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 3 + 1).cast("int").alias("chunk"))
    return splitting.fold_pairs(chunks, 3, 2, 1, reverse_test=False)


@query(
    "c6_assign_batches",
    f"""
    SELECT o_orderkey, ord, CAST(CASE WHEN ord < 500 THEN 1 ELSE 2 + (ord - 500) // 3000 END AS INTEGER) AS iteration
    FROM (SELECT o_orderkey, {ORD} AS ord FROM orders)
    """,
)
def c6(spark, d):
    rows = splitting.shuffle(_orders(spark, d).select("o_orderkey"), SEED, "o_orderkey")
    return splitting.assign_batches(rows, 500, 3000)


@query(
    "c7_two_stage_batches",
    f"""
    SELECT o_orderkey, ord, CASE WHEN ord < 1200 THEN 'init' ELSE 'retrain' END AS stage,
           CAST(CASE WHEN ord < 1200 THEN 1 + ord // 300 ELSE 5 + (ord - 1200) // 3000 END AS INTEGER) AS iteration
    FROM (SELECT o_orderkey, {ORD} AS ord FROM orders)
    """,
)
def c7(spark, d):
    rows = splitting.shuffle(_orders(spark, d).select("o_orderkey"), SEED, "o_orderkey")
    return splitting.two_stage_batches(rows, 1000, 300, 3000)


@query(
    "c8_remove_rows",
    "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def c8(spark, d):
    return splitting.remove_rows(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query(
    "c9_validation_slice",
    f"""
    WITH o AS (SELECT o_orderkey, {ORD} AS ord FROM orders),
         tail AS (SELECT * FROM o WHERE ord >= (SELECT count(*) - CAST(floor(count(*) * 0.1) AS BIGINT) FROM o))
    SELECT o_orderkey, ord FROM tail ORDER BY md5(concat_ws(':', 5, o_orderkey)), o_orderkey LIMIT 600
    """,
)
def c9(spark, d):
    rows = splitting.shuffle(_orders(spark, d).select("o_orderkey"), SEED, "o_orderkey")
    return splitting.validation_slice(rows, 0.1, 600, 5, id_col="o_orderkey")


@query(
    "c10_holdout_tail",
    f"""
    WITH o AS (SELECT o_orderkey, {ORD} AS ord FROM orders),
         s AS (SELECT count(*) - CAST(floor(count(*) * 0.3) AS BIGINT) AS start FROM o)
    SELECT o_orderkey, ord, ord >= start AS holdout, true AS train FROM o, s
    """,
)
def c10(spark, d):
    rows = splitting.shuffle(_orders(spark, d).select("o_orderkey"), SEED, "o_orderkey", total="_total")
    return splitting.holdout_tail(rows, 0.3, rows=F.col("_total")).drop("_total")


@query(
    "c11_stratified_kfold",
    """
    SELECT o_orderkey, o_orderstatus, repeat, CAST((row_number() OVER (
               PARTITION BY repeat, o_orderstatus
               ORDER BY md5(concat_ws(':', 2, repeat, o_orderkey)), o_orderkey) - 1) % 5 AS INTEGER) AS fold
    FROM orders, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS repeat)
    """,
)
def c11(spark, d):
    return splitting.stratified_kfold(_orders(spark, d), 5, 3, 2, "o_orderstatus", "o_orderkey", labels=3)


# Sizes and repeats of the initial samples, of each of the three folds.
SUBSAMPLES = [(f, s, r) for f in (1, 2, 3) for s in (1000, 3000) for r in range(1, 21)]
TRAIN_CHUNKS = {f: [c for g, role, c in splitting.fold_table(3, 2, 1) if g == f and role == "train"] for f in (1, 2, 3)}


@query(
    "c12_repeated_subsamples",
    f"""
    WITH chunks AS ({CHUNKS.format(n=3, ord=ORD)}),
    train AS (SELECT fold, o_orderkey FROM chunks JOIN (
        SELECT * FROM (VALUES {", ".join(f"({f}, {c})" for f, cs in TRAIN_CHUNKS.items() for c in cs)}) v(fold, chunk)) USING (chunk))
    SELECT fold, size, repeat, o_orderkey, ord FROM (
        SELECT fold, size, repeat, o_orderkey, row_number() OVER (
                   PARTITION BY fold, size, repeat
                   ORDER BY md5(concat_ws(':', 9, fold, size, repeat, o_orderkey)), o_orderkey) - 1 AS ord
        FROM train JOIN (SELECT * FROM (VALUES {", ".join(str(k) for k in SUBSAMPLES)}) v(fold, size, repeat)) USING (fold))
    WHERE ord < size
    """,
)
def c12(spark, d):
    ordered = splitting.shuffle(table(spark, d, "orders").select("o_orderkey"), SEED, "o_orderkey", total="_total")
    chunks = splitting.chunk(ordered, 3, rows=F.col("_total")).select("o_orderkey", "chunk")
    return splitting.repeated_subsamples(chunks, SUBSAMPLES, 9, "o_orderkey", TRAIN_CHUNKS).drop("chunk")
