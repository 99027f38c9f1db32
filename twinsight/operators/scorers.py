"""Scorers: anything that gives every row of a table a probability of the positive class."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsight.functions.frames import quoted
from twinsight.functions.numbers import category_key, coerce_numeric, is_numeric
from twinsight.operators.profile import infer_column_kinds

Scorer = Column | Transformer | Callable[[DataFrame], Column | DataFrame]


def apply_scorer(df: DataFrame, scorer: Scorer, out: str = "prob") -> DataFrame:
    """Add the score as column ``out``.

    Takes a Column expression, a fitted MLlib model (its ``probability`` vector is read), or a
    function of the table that returns a Column or a table that already has column ``out``.
    """
    if isinstance(scorer, Column):
        return df.withColumn(out, scorer.cast("double"))
    if hasattr(scorer, "transform"):
        scored = scorer.transform(df)
        return scored.withColumn(out, vector_to_array("probability")[1])
    result = scorer(df)
    if isinstance(result, Column):
        return df.withColumn(out, result.cast("double"))
    if out not in result.columns:
        raise ValueError(f"the scorer's table has no column {out!r}")
    return result


def logistic_scorer(column: str, centre: float, scale: float, height: float = 1.0) -> Column:
    """Closed form ``height / (1 + exp(-(x - centre) / scale))``."""
    return F.lit(height) / (F.lit(1.0) + F.exp(-(quoted(column) - F.lit(centre)) / F.lit(scale)))


class PythonScorer:
    """A model with a plain Python predict function, applied to Arrow batches.

    ``predict`` takes a pandas DataFrame of the ``features`` columns and returns one probability per row, as
    any array; a two-column array is read as the probabilities of the negative and positive class. It is sent to the tasks
    with whatever it closes over, and must give each row the same value in whatever batch it comes.
    """

    def __init__(self, predict: Callable[[pd.DataFrame], Sequence[float]], features: Sequence[str]):
        self.predict, self.features = predict, list(features)

    def __call__(self, df: DataFrame) -> Column:
        predict, names = self.predict, self.features

        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            for columns in batches:
                frame = pd.concat(columns if isinstance(columns, tuple) else (columns,), axis=1)
                frame.columns = names
                scores = np.asarray(predict(frame), dtype=float)
                if scores.ndim == 2:
                    scores = scores[:, 1]
                if scores.shape != (len(frame),):
                    raise ValueError(f"{len(frame)} rows gave scores of shape {scores.shape}")
                yield pd.Series(scores)

        score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(score, "double")(*[quoted(c) for c in names])


class TreeScorer:
    """Gradient-boosted trees on coerced numbers and one-hot text columns."""

    # Default size of the boosted ensemble.
    TREES = 100
    DEPTH = 3
    STEP = 0.1
    #: Rows of a part in training (about).
    PART_ROWS = 65_536

    def __init__(self, target: str, positive: str, seed: int = 0, trees: int = TREES, depth: int = DEPTH):
        self.target, self.positive, self.seed = target, positive, seed
        self.trees, self.depth = trees, depth
        self.numeric: list[str] = []
        self.categorical: list[str] = []
        self.model: PipelineModel | None = None

    def _prepared(self, df: DataFrame) -> DataFrame:
        # By position: a pipeline cannot take every name that a column may have.
        columns = {f"_num_{i}": coerce_numeric(quoted(c), df.schema[c].dataType) for i, c in enumerate(self.numeric)}
        columns |= {f"_cat_{i}": category_key(quoted(c), df.schema[c].dataType) for i, c in enumerate(self.categorical)}
        return df.withColumns(columns) if columns else df

    def fit(self, df: DataFrame, features: Sequence[str] | None = None) -> TreeScorer:
        names = [c for c in (features or df.columns) if c != self.target]
        self.numeric = [c for c in names if is_numeric(df.schema[c].dataType)]
        # Free text would give the indexer a level per row; the kinds leave it out, as the encoder does.
        kinds = infer_column_kinds(df.select(*[quoted(c) for c in names if c not in self.numeric])) if len(names) > len(self.numeric) else {}
        self.categorical = [c for c, kind in kinds.items() if kind == "categorical"]
        label = category_key(quoted(self.target), df.schema[self.target].dataType) == F.lit(self.positive)
        stages = []
        inputs = [f"_num_{i}" for i in range(len(self.numeric))]
        if self.categorical:
            cats = [f"_cat_{i}" for i in range(len(self.categorical))]
            indexed = [f"{c}_index" for c in cats]
            hot = [f"{c}_hot" for c in cats]
            stages.append(StringIndexer(inputCols=cats, outputCols=indexed, handleInvalid="keep"))
            stages.append(OneHotEncoder(inputCols=indexed, outputCols=hot))
            inputs += hot
        stages.append(VectorAssembler(inputCols=inputs, outputCol="_features"))
        stages.append(
            GBTClassifier(
                featuresCol="_features",
                labelCol="_label",
                maxIter=self.trees,
                maxDepth=self.depth,
                stepSize=self.STEP,
                seed=self.seed,
            )
        )
        training = self._prepared(df).withColumn("_label", label.cast("double"))
        parts = -(-df.count() // self.PART_ROWS)
        if parts > 1:  # the trainer keeps its rows in the parts it is given, and a table may be one block of a file
            training = training.select("_label", *[f"_num_{i}" for i in range(len(self.numeric))], *[f"_cat_{i}" for i in range(len(self.categorical))])
            training = training.repartition(parts)
        self.model = Pipeline(stages=stages).fit(training)
        return self

    def __call__(self, df: DataFrame) -> DataFrame:
        if self.model is None:
            raise RuntimeError("fit the scorer first")
        scored = self.model.transform(self._prepared(df)).withColumn("prob", vector_to_array("probability")[1])
        return scored.select(*[quoted(c) for c in df.columns], "prob")
