"""Registered queries: scores, result tables, comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.operators import reporting, scoring
from labelweave.plans.catalog import query, table
from labelweave.session import scratch_path
from labelweave.sources import tables as src

# Predictions: was the item returned, guessed from its discount; undecided at 5 %.
PREDICTED = """
    SELECT l_linestatus AS fold, CAST(l_returnflag = 'R' AS INTEGER) AS y,
           CASE WHEN l_discount > 0.05 THEN 1 WHEN l_discount < 0.05 THEN 0 END AS yhat FROM lineitem
"""
COUNTS = f"""
    SELECT fold, count(*) FILTER (y = 0 AND yhat = 0) AS tn, count(*) FILTER (y = 0 AND yhat = 1) AS fp,
           count(*) FILTER (y = 1 AND yhat = 0) AS fn, count(*) FILTER (y = 1 AND yhat = 1) AS tp,
           count(*) FILTER (yhat IS NULL) AS n_undecided
    FROM ({PREDICTED}) GROUP BY fold
"""


def predicted(spark, d):
    discount = F.col("l_discount")
    return table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        F.when(discount > 0.05, F.lit(1)).when(discount < 0.05, F.lit(0)).alias("yhat"),
    )


@query("i1_confusion", COUNTS)
def i1(spark, d):
    return scoring.confusion(predicted(spark, d), "y", "yhat", ["fold"])


@query(
    "i2_precision_recall_f1",
    f"""
    SELECT fold, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM ({COUNTS})
    """,
)
def i2(spark, d):
    scores = scoring.precision_recall_f1(predicted(spark, d), "y", "yhat", ["fold"])
    return scores.select("fold", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


@query(
    "i3_label_error_rates",
    f"""
    SELECT fold, round(1 - tp / (tp + fn), 6) AS fnr, round(1 - tn / (tn + fp), 6) AS fpr FROM ({COUNTS})
    """,
)
def i3(spark, d):
    rates = scoring.label_error_rates(predicted(spark, d), "y", "yhat", ["fold"])
    return rates.select("fold", F.round("fnr", 6).alias("fnr"), F.round("fpr", 6).alias("fpr"))


@query(
    "i4_accuracy",
    f"SELECT fold, round(avg(CAST(y = yhat AS DOUBLE)), 6) AS accuracy FROM ({PREDICTED}) GROUP BY fold",
)
def i4(spark, d):
    return scoring.accuracy(predicted(spark, d), "y", "yhat", ["fold"]).withColumn("accuracy", F.round("accuracy", 6))


PAIRS = """
    WITH cells AS (SELECT lang, source, count(*)::DECIMAL(18,0) AS n FROM documents GROUP BY ALL),
         s AS (SELECT (SELECT sum(n * n) FROM cells) AS same,
                      (SELECT sum(n * n) FROM (SELECT sum(n)::DECIMAL(18,0) AS n FROM cells GROUP BY lang)) AS a,
                      (SELECT sum(n * n) FROM (SELECT sum(n)::DECIMAL(18,0) AS n FROM cells GROUP BY source)) AS b,
                      (SELECT sum(n) FROM cells) AS n)
"""


@query(
    "i5_rand_index",
    PAIRS + "SELECT round(((n * n - a - b + same) + (same - n))::DOUBLE / (n * n - n)::DOUBLE, 6) AS rand_index FROM s",
)
def i5(spark, d):
    found = scoring.rand_index(table(spark, d, "documents"), "lang", "source")
    return found.select(F.round("rand_index", 6).alias("rand_index"))


@query(
    "i6_pair_confusion",
    PAIRS
    + """
    SELECT CAST(n * n - a - b + same AS BIGINT) AS apart_apart, CAST(b - same AS BIGINT) AS apart_together,
           CAST(a - same AS BIGINT) AS together_apart, CAST(same - n AS BIGINT) AS together_together FROM s
    """,
)
def i6(spark, d):
    counts = scoring.pair_confusion(table(spark, d, "documents"), "lang", "source")
    return counts.select(*[F.col(c).cast("long").alias(c) for c in counts.columns])


@query(
    "i7_roc_curve",
    """
    WITH steps AS (SELECT value AS threshold, count(*) FILTER (event_type = 'click') AS pos,
                          count(*) FILTER (event_type <> 'click') AS neg FROM events GROUP BY value),
         run AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tps,
                        sum(neg) OVER (ORDER BY threshold DESC) AS fps FROM steps)
    SELECT threshold, round(fps / (SELECT sum(neg) FROM steps), 6) AS fpr,
           round(tps / (SELECT sum(pos) FROM steps), 6) AS tpr FROM run
    UNION ALL SELECT 'inf'::DOUBLE, 0.0, 0.0
    """,
)
def i7(spark, d):
    scores = table(spark, d, "events").select((F.col("event_type") == "click").cast("int").alias("y"), "value")
    curve = scoring.roc_curve(scores, "y", "value")
    return curve.select("threshold", F.round("fpr", 6).alias("fpr"), F.round("tpr", 6).alias("tpr"))


# ---------------------------------------------------------------- result tables


@query(
    "i8_iteration_report",
    f"""
    WITH tested AS ({COUNTS}),
         pseudo AS (SELECT l_linestatus AS fold, count(*) FILTER (l_returnflag <> 'R' AND l_quantity <= 25) AS tn,
                           count(*) FILTER (l_returnflag <> 'R' AND l_quantity > 25) AS fp,
                           count(*) FILTER (l_returnflag = 'R' AND l_quantity <= 25) AS fn,
                           count(*) FILTER (l_returnflag = 'R' AND l_quantity > 25) AS tp
                    FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
    SELECT fold, round(2 * t.tp / (2 * t.tp + t.fp + t.fn), 6) AS F1, round(t.tp / (t.tp + t.fp), 6) AS Precision,
           round(t.tp / (t.tp + t.fn), 6) AS Recall, n_undecided,
           round(coalesce(1 - p.tn / (p.tn + p.fp), 1), 6) AS Normal_traffic_label_err_rate_FPR,
           round(coalesce(1 - p.tp / (p.tp + p.fn), 1), 6) AS Botnet_label_err_rate_FNR,
           coalesce(p.tn + p.fp + p.fn + p.tp, 0) AS n_pseudo
    FROM tested t LEFT JOIN pseudo p USING (fold)
    """,
)
def i8(spark, d):
    pseudo = table(spark, d, "lineitem").filter("l_linestatus = 'F'").select(
        F.col("l_linestatus").alias("fold"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_quantity") > 25).cast("int").alias("new_label"),
    )
    report = reporting.iteration_report(predicted(spark, d), pseudo, ["fold"], "y", "yhat")
    rates = ["F1", "Precision", "Recall", "Normal_traffic_label_err_rate_FPR", "Botnet_label_err_rate_FNR"]
    return report.withColumns({c: F.round(c, 6) for c in rates})


@query(
    "i9_run_totals",
    """
    SELECT event_type AS method,
           count(*) FILTER (value > 50 AND user_id <= 40) AS n_fp, 0::BIGINT AS n_fn,
           count(*) FILTER (value > 50) AS n_high_confidence, count(*) FILTER (value <= 50) - 10 AS n_low_confidence
    FROM events GROUP BY event_type
    """,
)
def i9(spark, d):
    rows = table(spark, d, "events").select(
        F.col("event_type").alias("method"),
        (F.col("user_id") > 40).cast("int").alias("Label"),
        F.lit(1).alias("new_label"),
        F.when(F.col("value") > 50, "model").otherwise("oracle").alias("source"),
    )
    return reporting.run_totals(rows, ["method"], init=10)


# A result table with one row per method (priority), fold (status) and iteration (year).
RESULTS = """
    SELECT o_orderpriority AS ML_method, o_orderstatus AS Training_set, year(o_orderdate) - 1991 AS N_Retrains,
           count(*) FILTER (o_totalprice > 200000) AS Queries_to_Oracle,
           round(avg(o_totalprice) / 500000, 6) AS F1, CAST(count(*) AS DOUBLE) AS Number_of_Samples_trained
    FROM orders GROUP BY ALL
"""


def results(spark, d):
    price = F.col("o_totalprice")
    return (
        table(spark, d, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("ML_method"),
            F.col("o_orderstatus").alias("Training_set"),
            (F.year("o_orderdate") - 1991).cast("long").alias("N_Retrains"),
        )
        .agg(
            F.count_if(price > 200000).alias("Queries_to_Oracle"),
            F.round(F.avg(price) / 500000, 6).alias("F1"),
            F.count(F.lit(1)).cast("double").alias("Number_of_Samples_trained"),
        )
    )


@query("i10_typed_results", RESULTS)
def i10(spark, d):
    rows = results(spark, d)
    path = src.write_table(rows, "results", scratch_path(spark, "csv"), False, "csv")
    return reporting.typed_results(src.scan_csv(spark, path, rows.columns))


@query("i11_combine_results", RESULTS)
def i11(spark, d):
    rows = results(spark, d)
    return reporting.combine_results([rows.filter("Training_set = 'F'"), rows.filter("Training_set <> 'P'"), rows])


@query(
    "i12_final_iteration",
    f"SELECT * FROM ({RESULTS}) WHERE N_Retrains = (SELECT max(year(o_orderdate) - 1991) FROM orders)",
)
def i12(spark, d):
    return reporting.final_iteration(results(spark, d))


@query(
    "i12_final_iteration_per_method",
    f"SELECT * FROM ({RESULTS}) QUALIFY N_Retrains = max(N_Retrains) OVER (PARTITION BY ML_method)",
)
def i12_by(spark, d):
    return reporting.final_iteration(results(spark, d), ["ML_method"])


@query(
    "i13_curve",
    f"""
    SELECT N_Retrains, ML_method, round(avg(F1), 6) AS mean, round(stddev(F1), 6) AS spread, count(F1) AS n
    FROM ({RESULTS}) GROUP BY ALL
    """,
)
def i13(spark, d):
    line = reporting.curve(results(spark, d), "N_Retrains", "F1", ["ML_method"])
    return line.withColumns({"mean": F.round("mean", 6), "spread": F.round("spread", 6)})


@query(
    "i14_bars",
    f"SELECT ML_method, Training_set, round(avg(Queries_to_Oracle), 6) AS mean FROM ({RESULTS}) GROUP BY ALL",
)
def i14(spark, d):
    heights = reporting.bars(results(spark, d), "ML_method", "Queries_to_Oracle", "Training_set")
    return heights.withColumn("mean", F.round("mean", 6))


@query(
    "i15_melt",
    f"""
    SELECT ML_method, Training_set, N_Retrains, 'F1' AS score_name, F1 AS score FROM ({RESULTS})
    UNION ALL SELECT ML_method, Training_set, N_Retrains, 'Number_of_Samples_trained', Number_of_Samples_trained FROM ({RESULTS})
    """,
)
def i15(spark, d):
    return reporting.melt(
        results(spark, d), ["ML_method", "Training_set", "N_Retrains"], ["F1", "Number_of_Samples_trained"]
    )


@query(
    "i16_composite_key",
    f"""SELECT *, ML_method || '_' || Training_set || '_' || N_Retrains AS "ML_method_Training_set_N_Retrains" FROM ({RESULTS})""",
)
def i16(spark, d):
    return reporting.composite_key(results(spark, d), ["ML_method", "Training_set", "N_Retrains"])


@query(
    "i17_query_share",
    f"""
    SELECT ML_method, Training_set, N_Retrains, round(Queries_to_Oracle / Number_of_Samples_trained * 100, 6) AS query_share
    FROM ({RESULTS})
    """,
)
def i17(spark, d):
    share = F.round(reporting.query_share(), 6).alias("query_share")
    return results(spark, d).select("ML_method", "Training_set", "N_Retrains", share)


@query(
    "i18_label_error_counts",
    """
    WITH t AS (SELECT CASE event_type WHEN 'error' THEN 'PL_RF' ELSE event_type END AS ML_method,
                      count(*) FILTER (value > 50 AND user_id <= 40) AS n_fp,
                      count(*) FILTER (value <= 50 AND user_id > 40) AS n_fn FROM events GROUP BY 1)
    SELECT ML_method, 'n_fp' AS error, n_fp AS n FROM t WHERE ML_method <> 'PL_RF'
    UNION ALL SELECT ML_method, 'n_fn', n_fn FROM t WHERE ML_method <> 'PL_RF'
    """,
)
def i18(spark, d):
    rows = table(spark, d, "events").select(
        F.when(F.col("event_type") == "error", "PL_RF").otherwise(F.col("event_type")).alias("ML_method"),
        (F.col("user_id") > 40).cast("int").alias("Label"),
        (F.col("value") > 50).cast("int").alias("new_label"),
        F.lit("model").alias("source"),
    )
    return reporting.label_error_counts(reporting.run_totals(rows, ["ML_method"], init=0))


@query(
    "i19_compare_methods",
    """
    WITH p AS (SELECT l_linestatus AS Training_set, CAST(l_returnflag = 'R' AS INTEGER) AS y,
                      unnest(['discount', 'tax', 'quantity']) AS ML_method,
                      unnest([CAST(l_discount > 0.05 AS INTEGER), CAST(l_tax > 0.04 AS INTEGER),
                              CAST(l_quantity > 25 AS INTEGER)]) AS yhat FROM lineitem),
         c AS (SELECT Training_set, ML_method, count(*) FILTER (y = 1 AND yhat = 1) AS tp,
                      count(*) FILTER (y = 0 AND yhat = 1) AS fp, count(*) FILTER (y = 1 AND yhat = 0) AS fn
               FROM p GROUP BY ALL)
    SELECT Training_set, ML_method, round(tp / (tp + fp), 6) AS Precision, round(tp / (tp + fn), 6) AS Recall,
           round(2 * tp / (2 * tp + fp + fn), 6) AS F1 FROM c
    """,
)
def i19(spark, d):
    wide = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("Training_set"),
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") > 0.05).cast("int").alias("discount"),
        (F.col("l_tax") > 0.04).cast("int").alias("tax"),
        (F.col("l_quantity") > 25).cast("int").alias("quantity"),
    )
    methods = wide.unpivot(["Training_set", "y"], ["discount", "tax", "quantity"], "ML_method", "yhat")
    scores = reporting.compare_methods(methods, "y", "yhat")
    return scores.withColumns({c: F.round(c, 6) for c in ("Precision", "Recall", "F1")})


@query(
    "i20_query_saving",
    f"""
    WITH f AS (SELECT * FROM ({RESULTS}) QUALIFY N_Retrains = max(N_Retrains) OVER (PARTITION BY ML_method, Training_set))
    SELECT f.Training_set, f.ML_method, round(1 - f.Queries_to_Oracle / b.Queries_to_Oracle, 6) AS saving
    FROM f JOIN f b ON b.Training_set = f.Training_set AND b.ML_method = '5-LOW'
    """,
)
def i20(spark, d):
    final = reporting.final_iteration(results(spark, d), ["ML_method", "Training_set"])
    return reporting.query_saving(final, "5-LOW").withColumn("saving", F.round("saving", 6))


@query(
    "i22_stopwatch_totals",
    """
    WITH once AS (SELECT user_id, event_type, props, max(value) AS seconds FROM events GROUP BY ALL)
    SELECT user_id, round(coalesce(sum(seconds) FILTER (event_type = 'click'), 0), 4) AS train_seconds,
           round(coalesce(sum(seconds) FILTER (event_type = 'view'), 0), 4) AS test_seconds,
           round(coalesce(sum(seconds) FILTER (event_type = 'purchase'), 0), 4) AS tune_seconds
    FROM once GROUP BY user_id
    """,
)
def i22(spark, d):
    kind = F.create_map(*[F.lit(v) for v in ("click", "train", "view", "test", "purchase", "tune")])
    stages = table(spark, d, "events").select(
        "user_id", F.coalesce(F.try_element_at(kind, "event_type"), F.col("event_type")).alias("stage"),
        F.col("props").alias("iteration"), F.col("value").alias("seconds"),
    )
    totals = reporting.stopwatch_totals(stages, ["user_id"])
    return totals.select("user_id", *[F.round(f"{k}_seconds", 4).alias(f"{k}_seconds") for k in ("train", "test", "tune")])
