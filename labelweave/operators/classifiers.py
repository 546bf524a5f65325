"""Committee members: fitted on labelled points, scored to (row_id, p0, p1).

Points are (row_id, features, label). A pool with a single class still gives
two probabilities: every row gets that class, and no row a plane score, so
margin triage sends all of them to the oracle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (
    LinearSVC,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelweave.functions.vectors import with_vector
from labelweave.operators.kernels import Fourier
from labelweave.operators.neighbours import knn_classify
from labelweave.operators.trees import Forest, fit_forest

TWO_CLASSES = {"ml_attr": {"type": "nominal", "name": "label", "vals": ["0", "1"]}}
SCORE_SCHEMA = "row_id bigint, p0 double, p1 double"
DEALT_ROWS = 100_000


@dataclass(frozen=True)
class Member:
    """A named model kind with its parameters.

    Kinds: 'forest', 'logistic', 'margin', 'knn', 'network', and 'table' for
    probabilities computed elsewhere (params: ``scores`` DataFrame). The param
    ``fourier`` of 'margin' or 'logistic' (a dict of ``Fourier`` values) puts
    random Fourier features of the Gaussian kernel in front of the plane.
    """

    name: str
    kind: str
    params: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Fitted:
    member: Member
    model: PipelineModel | None = None
    pool: DataFrame | None = None
    only_class: int | None = None
    forest: Forest | None = None

    def pipeline(self) -> PipelineModel | None:
        """The model to keep, if the member has one."""
        return PipelineModel([self.forest.model()]) if self.forest else self.model

    def _mapped(self, points: DataFrame) -> DataFrame:
        return _features(self.member, points.select("row_id", "features"))

    def score(self, points: DataFrame) -> DataFrame:
        """(row_id, p0, p1)."""
        if self.member.kind == "knn":
            params = {"k": 10, "p": 1, "weights": "distance"} | self.member.params
            return knn_classify(points, self.pool, **params)
        if self.member.kind == "table":
            return points.select("row_id").join(self.member.params["scores"], "row_id").select("row_id", "p0", "p1")
        if self.only_class is not None:
            p1 = F.lit(float(self.only_class))
            return points.select("row_id", (1 - p1).alias("p0"), p1.alias("p1"))
        if self.forest:
            return self.forest.score(points)
        scored = self.model.transform(with_vector(self._mapped(points)))
        p = vector_to_array("probability")
        return scored.select("row_id", p[0].alias("p0"), p[1].alias("p1"))

    def margin(self, points: DataFrame) -> DataFrame:
        """(row_id, dist): signed score of the separating plane."""
        if self.only_class is not None:
            return points.select("row_id", F.lit(0.0).alias("dist"))
        scored = self.model.transform(with_vector(self._mapped(points)))
        return scored.select("row_id", vector_to_array("plane")[1].alias("dist"))


def _features(member: Member, points: DataFrame) -> DataFrame:
    held = member.params.get("fourier")
    return Fourier(**held).transform(points) if held else points


def labelled(pool: DataFrame) -> DataFrame:
    return with_vector(pool).withColumn("label", F.col("label").cast("double").alias("label", metadata=TWO_CLASSES))


def plane_penalty(params: dict, n: int) -> float:
    return 1.0 / (params.get("C", 10.0) * max(n, 1))


def ml_stages(kind: str, params: dict, n: int) -> list:
    """Spark ML stages; a penalty C is turned into 1 / (C n). Trees grow to depth 30, the most Spark allows."""
    penalty = plane_penalty(params, n)
    if kind == "forest":
        return [
            RandomForestClassifier(
                numTrees=params.get("n_trees", 600), maxDepth=params.get("max_depth", 30), seed=params.get("seed", 42),
                featuresCol="vector", labelCol="label", cacheNodeIds=True,
            )
        ]
    if kind == "logistic":
        return [
            LogisticRegression(
                regParam=penalty, elasticNetParam=0.0, standardization=False, maxIter=params.get("max_iter", 100),
                featuresCol="vector", labelCol="label",
            )
        ]
    if kind == "margin":
        plane = LinearSVC(
            regParam=penalty, standardization=False, maxIter=params.get("max_iter", 100), featuresCol="vector",
            labelCol="label", rawPredictionCol="plane", predictionCol="side",
        )
        as_feature = VectorAssembler(inputCols=["plane"], outputCol="plane_vector")
        # Without an intercept the likelier class is the one on whose side of the plane a row lies.
        chance = LogisticRegression(featuresCol="plane_vector", labelCol="label", fitIntercept=False)
        return [plane, as_feature, chance]
    if kind == "network":
        return [
            MultilayerPerceptronClassifier(
                layers=params["layers"], seed=params.get("seed", 42), maxIter=params.get("max_iter", 100),
                featuresCol="vector", labelCol="label",
            )
        ]
    raise ValueError(f"unknown member kind {kind}")


def fit(member: Member, pool: DataFrame) -> Fitted:
    """Fit one member on (row_id, features, label)."""
    if member.kind == "knn":
        return Fitted(member, pool=pool.select("row_id", "features", "label"))
    if member.kind == "table":
        return Fitted(member)
    pool = pool.filter("label is not null")
    seen = pool.agg(F.count("label").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).first()
    if not seen["n"]:
        raise ValueError(f"member {member.name} has no labelled rows to learn from")
    if seen["low"] == seen["high"]:
        return Fitted(member, only_class=int(seen["low"]))
    pool = pool.select("row_id", "features", "label")
    if member.kind == "forest":
        params = member.params
        grown = fit_forest(pool, params.get("n_trees", 600), params.get("max_depth", 30), params.get("seed", 42))
        if grown is not None:
            return Fitted(member, forest=grown)
    if seen["n"] >= DEALT_ROWS:
        # A large pool in a few files would be learnt from in as few tasks.
        pool = pool.repartition(pool.sparkSession.sparkContext.defaultParallelism, "row_id")
    return Fitted(member, model=Pipeline(stages=ml_stages(member.kind, member.params, seen["n"])).fit(labelled(_features(member, pool))))


def fit_committee(members: Sequence[Member], pool: DataFrame) -> list[Fitted]:
    return [fit(m, pool) for m in members]


def committee_scores(fitted: Sequence[Fitted], points: DataFrame) -> DataFrame:
    """(row_id, member, p0, p1) of all members."""
    parts = [f.score(points).withColumn("member", F.lit(f.member.name)) for f in fitted]
    return reduce(lambda a, b: a.unionByName(b), parts).select("row_id", "member", "p0", "p1")
