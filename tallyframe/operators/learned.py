"""Learned aggregators with Spark ML: random forest and multi-layer perceptron."""

import itertools
import random
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numbers import ratio, ratio_or_zero
from tallyframe.operators.sampling import hash_bucket, hash_split

# The search space. Depth is limited to what Spark's trees allow.
FOREST_SPACE = {
    "numTrees": [10, 20, 50, 100, 200, 300, 400, 500],
    "maxDepth": [10, 20, 30],
    "minInstancesPerNode": [1, 2, 4],
    "featureSubsetStrategy": ["sqrt", "log2", "all"],
}
HIDDEN_LAYERS = (1, 3)
HIDDEN_UNITS = (5, 15)


def _negative_f1_of(rows: DataFrame, guess: Column) -> DataFrame:
    """Rows, right guesses and F1 of class 0; an F1 nothing defines is 0."""
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("y") == guess).alias("n_right"),
        F.count_if((F.col("y") == 0) & (guess == 0)).alias("tn"),
        F.count_if((F.col("y") == 0) & (guess == 1)).alias("fp"),
        F.count_if((F.col("y") == 1) & (guess == 0)).alias("fn"),
    )
    return counts.select(
        "n",
        ratio(F.col("n_right"), F.col("n")).alias("accuracy"),
        ratio_or_zero(F.col("tn") * 2, F.col("tn") * 2 + F.col("fp") + F.col("fn")).alias(
            "negative_f1"
        ),
    )


class NegativeF1(Evaluator):
    """Spark ML evaluator for the F1 of class 0, also where a fold lacks that class."""

    def _evaluate(self, dataset: DataFrame) -> float:
        return _negative_f1_of(dataset, F.col("prediction")).first()["negative_f1"]


def _with_truth(matrix: DataFrame) -> DataFrame:
    """Rows to learn from: those whose truth is known."""
    return matrix.where(F.col("y").isin(0.0, 1.0))


def _assembler(features: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(features), outputCol="x")


def train_forest(
    matrix: DataFrame,
    features: Sequence[str],
    rounds: int = 1,
    tries: int = 100,
    folds: int = 3,
    parallelism: int = 4,
    space: dict[str, list] = FOREST_SPACE,
    seed: int = 42,
) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """Random search with cross-validation per round; best model by hold-out negative F1.

    Returns the fitted pipeline and ``(round, hold-out F1)`` of every round.
    """
    matrix = _with_truth(matrix)
    forest = RandomForestClassifier(featuresCol="x", labelCol="y", seed=seed)
    combinations = list(itertools.product(*space.values()))
    runs: list[tuple[int, float]] = []
    best: tuple[float, PipelineModel] | None = None
    for r in range(rounds):
        picked = random.Random(seed + r).sample(combinations, min(tries, len(combinations)))
        grid = [
            {forest.getParam(name): value for name, value in zip(space, values, strict=True)}
            for values in picked
        ]
        parts = hash_split(matrix, 20, seed=seed + r)
        train = parts.where("part = 'train'").withColumn(
            "fold", hash_bucket(F.col("id"), folds, seed + 1000 + r).cast("int")
        )
        validator = CrossValidator(
            estimator=Pipeline(stages=[_assembler(features), forest]),
            estimatorParamMaps=grid,
            evaluator=NegativeF1(),
            numFolds=folds,
            foldCol="fold",
            parallelism=parallelism,
        )
        model = validator.fit(train).bestModel
        held_out = NegativeF1().evaluate(model.transform(parts.where("part = 'validation'")))
        runs.append((r, held_out))
        if best is None or held_out > best[0]:
            best = (held_out, model)
    return best[1], runs


def train_perceptron(
    matrix: DataFrame,
    features: Sequence[str],
    rounds: int = 3,
    tries: int = 10,
    max_iter: int = 100,
    seed: int = 42,
) -> tuple[PipelineModel, list[tuple[int, float]]]:
    """Sampled layer sizes, chosen by hold-out negative F1, then refitted on all rows."""
    matrix = _with_truth(matrix)
    network = MultilayerPerceptronClassifier(
        featuresCol="scaled", labelCol="y", maxIter=max_iter, seed=seed
    )
    scaler = StandardScaler(inputCol="x", outputCol="scaled", withMean=True, withStd=True)
    stages = [_assembler(features), scaler, network]
    runs: list[tuple[int, float]] = []
    best: tuple[float, list[int]] | None = None
    for r in range(rounds):
        rng = random.Random(seed + r)
        shapes = [
            [len(features)]
            + [rng.randint(*HIDDEN_UNITS) for _ in range(rng.randint(*HIDDEN_LAYERS))]
            + [2]
            for _ in range(tries)
        ]
        # split by a hash of the id, so that it does not depend on how the rows are partitioned
        parts = hash_split(matrix, 20, seed=seed + r)
        train = parts.where("part = 'train'")
        held_out = parts.where("part = 'validation'")
        grid = [{network.layers: shape} for shape in shapes]
        metrics = [0.0] * len(shapes)
        for place, model in Pipeline(stages=stages).fitMultiple(train, grid):
            metrics[place] = NegativeF1().evaluate(model.transform(held_out))
        top = max(range(len(shapes)), key=metrics.__getitem__)
        runs.append((r, metrics[top]))
        if best is None or metrics[top] > best[0]:
            best = (metrics[top], shapes[top])
    final = network.copy({network.layers: best[1]})
    return Pipeline(stages=[stages[0], scaler, final]).fit(matrix), runs


def score(model: PipelineModel, matrix: DataFrame) -> DataFrame:
    """``(id, score)``: the probability that the original label is right."""
    return model.transform(matrix).select(
        "id", vector_to_array("probability")[1].alias("score")
    )


def model_path(
    base: str, kind: str, model_group: str, prompt_group: str, method: str, run_id: str
) -> str:
    return f"{base}/{kind}/{model_group}/{prompt_group}/{method}/{run_id}"


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def training_report(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Accuracy and negative-class F1 of ``(y, score)`` rows."""
    return _negative_f1_of(scored, (F.col("score") > threshold).cast("double"))
