"""Repurchase models: candidates, selection on validation dates, evaluation on test dates, artifacts and scoring."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from datetime import date, timedelta

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import SQLTransformer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import ExperimentPlan, _need
from ..operators import customers, ranking
from . import publication
from .folder import Folder
from .publication import Place

INPUTS = ("recency", "log_orders", "log_purchase", "log_cancellation")
# The grid of candidates.
LOGISTIC_REGULARISATION, LOGISTIC_ROUNDS = (0.01, 0.1), 60
FOREST_DEPTHS, FOREST_TREES, FOREST_SEED = (3, 5), 40, 42
BASELINE = "recency"


@dataclass(frozen=True)
class Candidate:
    id: str
    algorithm: str
    value: float

    def estimator(self) -> Pipeline:
        inputs = "SELECT *, CAST(recency_days AS DOUBLE) AS recency, LOG1P(CAST(orders AS DOUBLE)) AS log_orders, LOG1P(CAST(purchase_amount AS DOUBLE)) AS log_purchase, LOG1P(CAST(-cancellation_amount AS DOUBLE)) AS log_cancellation FROM __THIS__"
        if self.algorithm == "logistic":
            model = LogisticRegression(featuresCol="scaled", maxIter=LOGISTIC_ROUNDS, regParam=self.value, standardization=False)
        else:
            model = RandomForestClassifier(featuresCol="scaled", numTrees=FOREST_TREES, maxDepth=int(self.value), seed=FOREST_SEED)
        return Pipeline(stages=[SQLTransformer(statement=inputs), VectorAssembler(inputCols=list(INPUTS), outputCol="raw", handleInvalid="error"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True), model])


CANDIDATES = [Candidate(f"logistic-{v}", "logistic", v) for v in LOGISTIC_REGULARISATION] + [Candidate(f"forest-{v}", "forest", v) for v in FOREST_DEPTHS]


def predict(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``rows`` with score, the probability of a purchase."""
    return model.transform(rows).select(*rows.columns, vector_to_array("probability")[1].alias("score"))


@dataclass(frozen=True)
class Evaluation:
    candidate: str
    group: str
    pr_auc: float | None
    samples: int
    positives: int
    prevalence: float
    k: int
    precision_at_k: float
    recall_at_k: float | None
    lift_at_k: float | None


def evaluate(candidate: str, group: str, scored: DataFrame, fraction: float) -> Evaluation:
    scored = scored.select("customer_id", "observation", "label", "score").persist()
    try:
        return Evaluation(candidate, group, ranking.pr_auc(scored), **ranking.ranking_metrics(scored, fraction).first().asDict())
    finally:
        scored.unpersist()


def both_classes(rows: DataFrame, group: str) -> None:
    if rows.select("label").distinct().count() != 2:
        raise ValueError(f"the {group} samples have one label only")


def select(evaluations: list[Evaluation]) -> tuple[Evaluation, list[Evaluation]]:
    """The best by PR-AUC, then id; and the best of each algorithm."""
    order = sorted(evaluations, key=lambda e: (-(e.pr_auc if e.pr_auc is not None else -1), e.candidate))
    algorithms = {c.id: c.algorithm for c in CANDIDATES}
    best: dict[str, Evaluation] = {}
    for e in order:
        best.setdefault(algorithms[e.candidate], e)
    return order[0], list(best.values())


def train(facts: DataFrame, plan: ExperimentPlan, coverage: tuple[date, date], root: Place, release: str, feature_version: str) -> str:
    """Train all candidates, choose on the validation dates, evaluate on the test dates, publish; the model's id.

    The published model is loaded again and must give the same scores.
    """
    model_id = publication.identity(release, json.dumps(asdict(plan), default=str, sort_keys=True), feature_version)
    root = Folder.of(facts.sparkSession, root)
    with publication.writer_lock(root / "models.lock") as lease:

        def fill(part: Folder) -> dict:
            spark = facts.sparkSession
            customers.all_samples(facts, plan, *coverage).write.parquet(f"{part}/samples")
            samples = spark.read.parquet(f"{part}/samples")
            groups = {g: customers.observed(samples, list(getattr(plan, g))).persist() for g in ("training", "validation", "test")}
            try:
                for g in ("training", "validation"):
                    both_classes(groups[g], g)
                models = {c.id: c.estimator().fit(groups["training"]) for c in CANDIDATES}
                chosen, finalists = select([evaluate(c, "validation", predict(m, groups["validation"]), plan.contact_fraction) for c, m in models.items()])
                best = models[chosen.candidate]
                best.write().save(f"{part}/model")
                same = ranking.differences(predict(best, groups["test"]), predict(PipelineModel.load(f"{part}/model"), groups["test"]))
                if any(r["row_count"] for r in same.collect()):
                    raise publication.PublicationError("the stored model gives other scores")
                tests = [("test", groups["test"])] + [(f"test {d}", customers.observed(groups["test"], [d])) for d in plan.test]
                results = [evaluate(e.candidate, name, predict(models[e.candidate], rows), plan.contact_fraction) for e in finalists for name, rows in tests]
                results += [evaluate(BASELINE, name, ranking.recency_baseline(rows), plan.contact_fraction) for name, rows in [("validation", groups["validation"]), *tests]]
                scored = predict(best, groups["test"])
                scored.select("observation", "customer_id", "label", "score").orderBy("observation", "customer_id").write.option("header", True).csv(f"{part}/predictions")
                publication.write_json(part / "evaluation.json", {"chosen": asdict(chosen), "results": [asdict(r) for r in results], "examples": [r.asDict() for r in ranking.error_examples(scored).collect()]})
                return {"model": model_id, "candidate": chosen.candidate, "release": release, "feature_version": feature_version, "history_days": plan.history_days, "horizon_days": plan.horizon_days, "last_validation": max(plan.validation).isoformat()}
            finally:
                for rows in groups.values():
                    rows.unpersist()

        publication.publish_folder(root / model_id, fill, lease)
        return model_id


def compatible(manifest: dict, release: str, window_days: int, observation: date, feature_version: str) -> None:
    """A model scores profiles of its release, window and features, from after what chose it."""
    _need(manifest["release"] == release, "the model was trained on another release")
    _need(manifest["history_days"] == window_days, "the model needs another window")
    _need(observation >= date.fromisoformat(manifest["last_validation"]) + timedelta(days=manifest["horizon_days"]), "the observation is before the end of the model's validation")
    _need(manifest["feature_version"] == feature_version, "the model was trained on other features")


def score(spark: SparkSession, root: Place, model_id: str, profiles: DataFrame) -> DataFrame:
    """customer_id and score, after the model's checksums were found to hold."""
    if not (len(model_id) == 64 and all(c in "0123456789abcdef" for c in model_id)):
        raise ValueError("a model's id has 64 hexadecimal digits")
    folder = Folder.of(spark, root) / model_id
    publication.verify(folder)
    return predict(PipelineModel.load(f"{folder}/model"), profiles).select("customer_id", F.col("score"))
