"""A learned forecaster over panel rows, its time-forward benchmark with a selection gate, and scoring by a broadcast model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cityweave.operators import panel as op


class Forest:
    """Trees over imputed numbers and indexed categories.

    Numbers take their median where they are null and carry a flag of it; columns that are null throughout are left out.
    Categories unseen in the fit share one index. Rows weigh so that all labels weigh alike."""

    def __init__(self, numbers: list[str], categories: list[str], trees: int = 20, depth: int = 5, seed: int = 42):
        self.numbers, self.categories, self.trees, self.depth, self.seed = numbers, categories, trees, depth, seed
        self.model: PipelineModel | None = None

    def _prepared(self, panel: DataFrame) -> DataFrame:
        flags = {f"_{c}_missing": F.col(c).isNull().cast("double") for c in self.numbers}
        return panel.withColumns(flags | {c: F.col(c).cast("double") for c in self.numbers} | {c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in self.categories})

    def fit(self, panel: DataFrame) -> Forest:
        have = panel.agg(F.count("*"), *(F.count(c).alias(c) for c in self.numbers)).first()
        self.numbers = [c for c in self.numbers if have[c]]
        counts = panel.groupBy("target_state").agg(F.count("*").alias("_n"))
        labels, rows = counts.agg(F.count("*"), F.sum("_n")).first()
        if not rows:
            raise ValueError("no rows to fit on")
        rows_ = self._prepared(panel).join(F.broadcast(counts), "target_state").withColumn("_w", F.lit(rows) / (labels * F.col("_n")))
        filled = [f"_{c}_filled" for c in self.numbers]
        steps = [Imputer(strategy="median", inputCols=self.numbers, outputCols=filled)] if self.numbers else []
        indexed = [f"_{c}_index" for c in self.categories]
        if indexed:
            steps.append(StringIndexer(inputCols=self.categories, outputCols=indexed, handleInvalid="keep"))
        steps += [
            VectorAssembler(inputCols=[*filled, *(f"_{c}_missing" for c in self.numbers), *indexed], outputCol="_x"),
            StringIndexer(inputCol="target_state", outputCol="_y", handleInvalid="keep", stringOrderType="alphabetAsc"),
            RandomForestClassifier(featuresCol="_x", labelCol="_y", weightCol="_w", probabilityCol="_p", numTrees=self.trees, maxDepth=self.depth, maxBins=256, seed=self.seed),
        ]
        self.model = Pipeline(stages=steps).fit(rows_)
        return self

    def predict(self, panel: DataFrame) -> DataFrame:
        """panel with p, a map from label to probability; a row without any known label's weight is unknown for sure."""
        if self.model is None:
            raise RuntimeError("not fitted")
        labels = self.model.stages[-2].labels
        p = F.slice(vector_to_array("_p"), 1, len(labels))
        total = F.aggregate(p, F.lit(0.0), lambda s, v: s + v)
        out = self.model.transform(self._prepared(panel)).withColumn("_t", total)
        known = F.map_from_arrays(F.array(*map(F.lit, labels)), F.transform(p, lambda v: v / F.col("_t")))
        scores = out.withColumn("p", F.when(F.col("_t") > 0, known).otherwise(F.create_map(F.lit("unknown"), F.lit(1.0))))
        return scores.select(*panel.columns, "p")


def benchmark(past: DataFrame, future: DataFrame, labels: list[str], forest: Forest) -> tuple[DataFrame, str]:
    """(model, n, accuracy, macro_f1, brier, log_loss) of persistence, transition matrix and forest fitted on the past and
    scored on the future, and the name of the model that passes the gate."""
    scored = {
        "persistence": op.one_hot(future), "markov": op.predict(future, op.transition_matrix(past, labels)), "forest": forest.fit(past).predict(future),
    }
    rows = None
    for name, s in scored.items():
        m = op.classification_metrics(s, labels).select(F.lit(name).alias("model"), "*")
        rows = m if rows is None else rows.unionAll(m)
    found = {r.model: {"macro_f1": r.macro_f1, "brier": r.brier} for r in rows.collect()}
    return rows, op.gate(found, "forest")


def refitted(past: DataFrame, future: DataFrame, labels: list[str], chosen: str, forest: Forest) -> Forest | DataFrame | None:
    """The chosen model fitted on both intervals: the forest, a transition matrix, or None, as persistence needs no fit."""
    both = past.unionByName(future)
    return forest.fit(both) if chosen == "forest" else op.transition_matrix(both, labels) if chosen == "markov" else None


def scored_by(df: DataFrame, weights: dict[str, float], constant: float, key: str) -> DataFrame:
    """(key, score): logistic score of the columns named in weights, by Arrow batches against one broadcast model. A null
    column counts as zero."""
    model = df.sparkSession.sparkContext.broadcast((list(weights), np.array(list(weights.values())), constant))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, w, c = model.value
        for b in batches:
            x = b[names].fillna(0.0).to_numpy(dtype=float)
            yield pd.DataFrame({key: b[key], "score": 1 / (1 + np.exp(-(x @ w + c)))})

    return df.select(key, *weights).mapInPandas(score, f"{key} {dict(df.dtypes)[key]}, score double")


def cross_validated(pairs: DataFrame, folds: int, fits: dict[str, list[str]]) -> DataFrame:
    """(model, fold, n, mae, bias) of least-squares models over pairs (fold, value, ...): fits names each model's columns,
    to which a constant is added. Each fold is scored by the model of the others; moments are summed once a fold, and
    those of the others are differences, so the pairs are read once to fit and once to score."""
    out = None
    for name, cols in fits.items():
        x = [F.lit(1.0), *(F.col(c) for c in cols)]
        n = len(x)
        cells = [F.sum(x[i] * x[j]).alias(f"m{i}_{j}") for i in range(n) for j in range(n)] + [F.sum(x[i] * F.col("value")).alias(f"v{i}") for i in range(n)]
        sums = {r.fold: r for r in pairs.groupBy("fold").agg(*cells).collect()}  # a row a fold
        models = []
        for fold in range(folds):
            rest = [r for f, r in sums.items() if f != fold]
            m = np.array([[sum(r[f"m{i}_{j}"] for r in rest) for j in range(n)] for i in range(n)])
            models.append((fold, np.linalg.lstsq(m, np.array([sum(r[f"v{i}"] for r in rest) for i in range(n)]), rcond=None)[0].tolist()))
        beta = pairs.sparkSession.createDataFrame(models, "fold int, beta array<double>")
        guess = sum((F.get("beta", F.lit(i)) * x[i] for i in range(n)), F.lit(0.0))
        j = pairs.join(F.broadcast(beta), "fold").withColumn("_e", guess - F.col("value"))
        rows = j.groupBy("fold").agg(F.count("*").alias("n"), F.avg(F.abs("_e")).alias("mae"), F.avg("_e").alias("bias")).select(F.lit(name).alias("model"), "*")
        out = rows if out is None else out.unionAll(rows)
    return out
