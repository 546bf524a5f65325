"""Registered queries: label propagation, committees, triage."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelweave.operators import classifiers, propagation, triage
from labelweave.operators.classifiers import Member
from labelweave.plans import loops
from labelweave.plans.catalog import query, table

# ---------------------------------------------------------------- propagation
# Clusters: one per user; errors are noise; high values are core rows.

CLUSTERED = """
    SELECT event_id AS ord,
           CAST(CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS INTEGER) AS cluster,
           CASE WHEN value >= 60 THEN 1.0::DOUBLE ELSE value / 60 END AS prob,
           CAST(event_type IN ('click', 'purchase') AS INTEGER) AS Label
    FROM events
"""
RULED = f"""
    rows AS ({CLUSTERED}),
    counts AS (SELECT cluster, Label, count(*) AS n_all, count(*) FILTER (prob = 1) AS n,
                      max(ord) FILTER (prob = 1) AS reached
               FROM rows WHERE cluster <> -1 GROUP BY cluster, Label),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, reached) AS place FROM counts),
    clusters AS (SELECT cluster, CAST(sum(n_all) AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS n_core,
                        count(*) FILTER (n > 0) AS kinds, max(n) AS best, max(Label) FILTER (place = 1) AS top
                 FROM ranked GROUP BY cluster),
    ruled AS (SELECT *, CASE WHEN n_core = 0 THEN 'fallback' WHEN kinds = 1 THEN 'homogeneous'
                             WHEN best / n_core >= {{threshold}} THEN 'majority' ELSE 'fallback' END AS rule
              FROM clusters)
"""


def clustered(spark, d):
    value = F.col("value")
    return table(spark, d, "events").select(
        F.col("event_id").alias("ord"),
        F.when(F.col("event_type") == "error", F.lit(-1)).otherwise(F.col("user_id")).cast("int").alias("cluster"),
        F.when(value >= 60, F.lit(1.0)).otherwise(value / 60).alias("prob"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("Label"),
    )


@query(
    "f1_noise_to_oracle",
    f"""
    SELECT ord, cluster, prob, Label, CASE WHEN cluster = -1 THEN Label END AS new_label,
           CAST(cluster = -1 AS INTEGER) AS n_query FROM ({CLUSTERED})
    """,
)
def f1(spark, d):
    return propagation.noise_to_oracle(clustered(spark, d))


@query("f2_core_rows", f"SELECT * FROM ({CLUSTERED}) WHERE cluster <> -1 AND prob = 1")
def f2(spark, d):
    return propagation.core_rows(clustered(spark, d))


@query(
    "f3_f4_f5_cluster_rules",
    f"""
    WITH {RULED.format(threshold=0.7)}
    SELECT cluster, size, n_core, rule, CASE WHEN rule <> 'fallback' THEN top END AS cluster_label,
           CASE WHEN rule = 'fallback' THEN size ELSE n_core END AS n_query FROM ruled
    """,
)
def f345(spark, d):
    return propagation.cluster_rules(clustered(spark, d), 0.7)


@query(
    "f6_propagate",
    f"""
    WITH {RULED.format(threshold=0.5)}
    SELECT ord, cluster, prob, Label, CASE WHEN rule IN ('homogeneous', 'majority') THEN top ELSE Label END AS new_label,
           coalesce(rule, 'noise') AS rule
    FROM rows LEFT JOIN ruled USING (cluster)
    """,
)
def f6(spark, d):
    return propagation.propagate(clustered(spark, d), 0.5)


TOTALS = """
    SELECT CAST((SELECT count(*) FROM rows WHERE cluster = -1)
                + (SELECT sum(CASE WHEN rule = 'fallback' THEN size ELSE n_core END) FROM ruled) AS BIGINT) AS n_query,
           (SELECT count(*) FROM rows WHERE cluster = -1) AS n_noise,
           (SELECT CAST(sum(n_core) AS BIGINT) FROM ruled) AS prob_one,
           (SELECT count(*) FROM ruled) AS n_clusters
"""


@query("f6_propagation_totals", f"WITH {RULED.format(threshold=0.9)} {TOTALS}")
def f6_totals(spark, d):
    return propagation.propagation_totals(clustered(spark, d), 0.9)


@query(
    "f7_majority_element",
    """
    WITH counts AS (SELECT user_id, event_type, count(*) AS n, max(event_id) AS reached FROM events GROUP BY ALL),
         ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, reached) AS place,
                           sum(n) OVER (PARTITION BY user_id) AS total FROM counts)
    SELECT user_id, CAST(total AS BIGINT) AS n, round(n / total, 6) AS share,
           CASE WHEN n / total >= 0.25 THEN event_type END AS majority
    FROM ranked WHERE place = 1
    """,
)
def f7(spark, d):
    found = propagation.majority_element(table(spark, d, "events"), ["user_id"], "event_type", 0.25, "event_id")
    return found.withColumn("share", F.round("share", 6))


CURVE_THRESHOLDS = (0.5, 0.6, 0.7, 0.8, 0.9)


def _curve_sql():
    parts = []
    for t in CURVE_THRESHOLDS:
        parts.append(
            f"""
            SELECT {t}::DOUBLE AS threshold, totals.n_query, wrong.n_wrong, (SELECT count(*) FROM events) AS n_rows
            FROM (WITH {RULED.format(threshold=t)} {TOTALS}) totals,
                 (WITH {RULED.format(threshold=t)}
                  SELECT count(*) FILTER (rule IN ('homogeneous', 'majority') AND top <> Label) AS n_wrong
                  FROM rows LEFT JOIN ruled USING (cluster)) wrong
            """
        )
    return " UNION ALL ".join(parts)


@query("f8_propagation_cost_curve", _curve_sql())
def f8(spark, d):
    return propagation.propagation_cost_curve(clustered(spark, d), CURVE_THRESHOLDS)


# ---------------------------------------------------------------- committees
# Three members score every event from its value, its property and its user.

MEMBERS = """
    SELECT event_id AS row_id, 'value' AS member, 1 - least(value / 100, 1.0) AS p0, least(value / 100, 1.0) AS p1 FROM events
    UNION ALL
    SELECT event_id, 'property', 1 - k / 100, k / 100 FROM (
        SELECT event_id, CAST(regexp_extract(props, '[0-9]+') AS DOUBLE) AS k FROM events)
    UNION ALL
    SELECT event_id, 'user', 1 - user_id / (user_id + 25.0::DOUBLE), user_id / (user_id + 25.0::DOUBLE) FROM events
"""
# Means that end exactly half-way at the last digit must round alike whatever
# the order of summing, hence the tiny push before rounding.
AVERAGE = f"SELECT row_id, round(avg(p0) + 1e-12, 9) AS p0, round(avg(p1) + 1e-12, 9) AS p1 FROM ({MEMBERS}) GROUP BY row_id"
SCORED = f"""
    SELECT row_id, a.p0, a.p1, CAST(event_type IN ('click', 'purchase') AS INTEGER) AS Label
    FROM ({AVERAGE}) a JOIN events ON event_id = row_id
"""


def members(spark, d):
    events = table(spark, d, "events")
    user = F.col("user_id").cast("double")
    wide = events.select(
        F.col("event_id").alias("row_id"),
        F.least(F.col("value") / 100, F.lit(1.0)).alias("value"),
        (F.regexp_extract("props", "[0-9]+", 0).cast("double") / 100).alias("property"),
        (user / (user + 25)).alias("user"),
    )
    return wide.unpivot(["row_id"], ["value", "property", "user"], "member", "p1").withColumn("p0", 1 - F.col("p1"))


def averaged(spark, d):
    mean = triage.committee_average(members(spark, d))
    return mean.withColumns({c: F.round(F.col(c) + 1e-12, 9) for c in ("p0", "p1")})


def scored(spark, d):
    labels = table(spark, d, "events").select(
        F.col("event_id").alias("row_id"), F.col("event_type").isin("click", "purchase").cast("int").alias("Label")
    )
    return averaged(spark, d).join(labels, "row_id")


@query("g6_committee_average", AVERAGE)
def g6(spark, d):
    return averaged(spark, d)


PREDICTED = "CASE WHEN p0 > 0.5 THEN 0 WHEN p1 > 0.5 THEN 1 END"


@query("g7_committee_predict", f"SELECT row_id, p0, p1, {PREDICTED} AS prediction FROM ({AVERAGE})")
def g7(spark, d):
    return triage.committee_predict(averaged(spark, d))


@query(
    "g8_soft_vote",
    f"SELECT row_id, p0, p1, CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS prediction FROM ({AVERAGE})",
)
def g8(spark, d):
    vote = triage.soft_vote(members(spark, d))
    return vote.withColumns({c: F.round(F.col(c) + 1e-12, 9) for c in ("p0", "p1")})


@query(
    "g9_binary_from_probability",
    "SELECT event_id, p1, CASE WHEN p1 > 0.5 THEN 1 ELSE 0 END AS prediction FROM (SELECT event_id, value / 100 AS p1 FROM events)",
)
def g9(spark, d):
    return triage.binary_from_probability(table(spark, d, "events").select("event_id", (F.col("value") / 100).alias("p1")))


# ---------------------------------------------------------------- triage


def _settled_sql(source: str, decision: str) -> str:
    return f"""
        SELECT * EXCLUDE (model), coalesce(model, Label) AS new_label,
               CASE WHEN model IS NULL THEN 'oracle' ELSE 'model' END AS source
        FROM (SELECT *, {decision} AS model FROM ({source}))
    """


@query("h1_triage_two_class", _settled_sql(SCORED, "CASE WHEN p0 > 0.7 THEN 0 WHEN p1 > 0.7 THEN 1 END"))
def h1(spark, d):
    return triage.triage_two_class(scored(spark, d), 0.7)


@query("h2_triage_binary", _settled_sql(SCORED, "CASE WHEN p1 > 0.7 THEN 1 WHEN p1 < 0.3 THEN 0 END"))
def h2(spark, d):
    return triage.triage_binary(scored(spark, d))


MARGIN = """
    SELECT event_id AS row_id, (value - 50) / 20 AS dist,
           CAST(event_type IN ('click', 'purchase') AS INTEGER) AS Label FROM events
"""


def _margins(spark, d):
    return table(spark, d, "events").select(
        F.col("event_id").alias("row_id"),
        ((F.col("value") - 50) / 20).alias("dist"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("Label"),
    )


@query("h3_triage_margin", _settled_sql(MARGIN, "CASE WHEN dist > 1 THEN 1 WHEN dist < -1 THEN 0 END"))
def h3(spark, d):
    return triage.triage_margin(_margins(spark, d))


@query("h4_triage_passive", f"SELECT *, Label AS new_label, 'oracle' AS source FROM ({MARGIN})")
def h4(spark, d):
    return triage.triage_passive(_margins(spark, d))


@query(
    "h7_soft_vote_entropy",
    f"""
    SELECT row_id, round(-(CASE WHEN p0 > 0 THEN p0 * ln(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * ln(p1) ELSE 0 END), 6) AS entropy
    FROM (SELECT row_id, avg(p0) AS p0, avg(p1) AS p1 FROM ({MEMBERS}) GROUP BY row_id)
    """,
)
def h7(spark, d):
    ranked = triage.soft_vote_entropy(members(spark, d))
    return ranked.select("row_id", F.round("entropy", 6).alias("entropy"))


@query(
    "h7_entropy_selection",
    f"""
    WITH votes AS (SELECT row_id, avg(p0) AS p0, avg(p1) AS p1 FROM ({MEMBERS}) GROUP BY row_id),
    e AS (SELECT row_id, CAST(row_id % 7 AS INTEGER) AS batch, CAST(row_id % 2 AS INTEGER) AS Label, p0, p1,
                 round(-(CASE WHEN p0 > 0 THEN p0 * ln(p0) ELSE 0 END + CASE WHEN p1 > 0 THEN p1 * ln(p1) ELSE 0 END), 9) AS entropy
          FROM votes),
    placed AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY entropy DESC, row_id) AS place FROM e)
    SELECT row_id, batch, round(entropy, 6) AS entropy,
           CASE WHEN place <= 100 THEN Label WHEN p1 - p0 > 1e-9 THEN 1 ELSE 0 END AS new_label,
           CASE WHEN place <= 100 THEN 'oracle' ELSE 'model' END AS source
    FROM placed
    """,
)
def h7_selection(spark, d):
    """The hundred rows of each batch that the committee is least sure of."""
    mean = triage.committee_average(members(spark, d))
    rows = mean.withColumns({"batch": F.pmod("row_id", F.lit(7)).cast("int"), "Label": F.pmod("row_id", F.lit(2)).cast("int")})
    chosen = triage.triage_entropy(rows, 100, ["batch"])
    return chosen.select("row_id", "batch", F.round(F.round("entropy", 9), 6).alias("entropy"), "new_label", "source")


POOL = f"""
    SELECT row_id, new_label, source, CAST(1 + row_id // 3000 AS INTEGER) AS iteration
    FROM ({_settled_sql(SCORED, "CASE WHEN p0 > 0.6 THEN 0 WHEN p1 > 0.6 THEN 1 END")})
"""


def _pool(spark, d):
    labelled = triage.triage_two_class(scored(spark, d), 0.6)
    iteration = (1 + F.floor(F.col("row_id") / 3000)).cast("int").alias("iteration")
    return labelled.select("row_id", "new_label", "source", iteration)


@query(
    "h8_append_to_pool",
    f"""
    SELECT source, iteration, count(*) AS n FROM (
        SELECT source, iteration FROM ({POOL})
        UNION ALL SELECT 'init', 0 FROM orders)
    GROUP BY source, iteration
    """,
)
def h8(spark, d):
    init = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"),
        F.lit(0).alias("new_label"),
        F.lit("init").alias("source"),
        F.lit(0).alias("iteration"),
    )
    grown = triage.append_to_pool(init, _pool(spark, d))
    return grown.groupBy("source", "iteration").agg(F.count(F.lit(1)).alias("n"))


@query("h9_pseudo_label_log", f"SELECT * FROM ({POOL}) WHERE source = 'model'")
def h9(spark, d):
    return triage.pseudo_label_log(_pool(spark, d))


H5_ROWS = f"""
    WITH scored AS ({SCORED}), ev AS (SELECT event_id, user_id, event_type, value FROM events),
    uncertain AS (
        SELECT row_id AS ord, Label, CAST(CASE WHEN event_type = 'error' THEN -1 ELSE user_id END AS INTEGER) AS cluster,
               CASE WHEN value >= 60 THEN 1.0::DOUBLE ELSE value / 60 END AS prob
        FROM scored JOIN ev ON event_id = row_id WHERE p0 <= 0.7 AND p1 <= 0.7),
    counts AS (SELECT cluster, Label, count(*) AS n_all, count(*) FILTER (prob = 1) AS n,
                      max(ord) FILTER (prob = 1) AS reached
               FROM uncertain WHERE cluster <> -1 GROUP BY cluster, Label),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, reached) AS place FROM counts),
    ruled AS (SELECT cluster, sum(n) AS n_core, max(n) AS best, count(*) FILTER (n > 0) AS kinds,
                     max(Label) FILTER (place = 1) AS top FROM ranked GROUP BY cluster)
    SELECT row_id, Label, CASE WHEN p0 > 0.7 THEN 0 ELSE 1 END AS new_label, 'model' AS source
    FROM scored WHERE p0 > 0.7 OR p1 > 0.7
    UNION ALL
    SELECT ord, Label, CASE WHEN n_core > 0 AND (kinds = 1 OR best / n_core >= 0.5) THEN top ELSE Label END,
           CASE WHEN n_core > 0 AND (kinds = 1 OR best / n_core >= 0.5) THEN 'cluster' ELSE 'oracle' END
    FROM uncertain LEFT JOIN ruled USING (cluster)
"""


@query("h5_triage_committee_cluster", H5_ROWS)
def h5(spark, d):
    """The composed labeller, with probabilities and clusters from elsewhere."""
    clusters = clustered(spark, d).select(F.col("ord").alias("row_id"), "cluster", "prob")
    given = scored(spark, d)
    batch = given.select("row_id", F.col("row_id").alias("ord"), F.array("p0").alias("features"), "Label")
    committee = [classifiers.fit(Member("given", "table", {"scores": given.select("row_id", "p0", "p1")}), batch)]
    labeller = loops.by_committee_and_clusters(lambda rows: (rows.join(clusters, "row_id"), 0.0), 0.7, 0.5)
    return labeller(batch, committee)[0].select("row_id", "Label", "new_label", "source")


@query(
    "h8_replace_pool",
    f"SELECT row_id, new_label, source, iteration FROM ({POOL}) WHERE iteration = 2",
)
def h8_replaced(spark, d):
    """Train on batch: the pool is the second batch only."""
    rows = _pool(spark, d)
    return triage.replace_pool(rows.filter("iteration = 1"), rows.filter("iteration = 2"))
