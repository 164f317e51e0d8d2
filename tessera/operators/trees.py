"""Tree ensembles by Spark's own learners, declared stand-ins for boosted, extra and positive forests; exact evaluation of stored trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame

from .heads import tree_values


def _assembled(df: DataFrame, features: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="error").transform(df)


def _arrays(model) -> list[dict]:
    """Each tree as arrays in preorder, so that children follow their parents."""
    out = []
    for tree in model.trees:
        t: dict[str, list] = {"left": [], "right": [], "feature": [], "threshold": [], "value": []}

        def walk(node, t=t) -> int:
            at = len(t["left"])
            inner = node.getClass().getSimpleName() == "InternalNode"
            for k, v in (("left", -1), ("right", -1), ("feature", node.split().featureIndex() if inner else 0), ("threshold", node.split().threshold() if inner else 0.0), ("value", node.prediction())):
                t[k].append(v)
            if inner:
                t["left"][at] = walk(node.leftChild())
                t["right"][at] = walk(node.rightChild())
            return at

        walk(tree._call_java("rootNode"))
        out.append(t)
    return out


def fit_boosted(df: DataFrame, features: list[str], target: str, trees: int = 80, depth: int = 3, seed: int = 42) -> dict:
    """A boosted ensemble as plain arrays: value = sum of weight * tree."""
    model = GBTRegressor(featuresCol="_x", labelCol=target, maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed).fit(_assembled(df, features))
    return {"features": features, "weights": list(model.treeWeights), "trees": _arrays(model)}


def fit_forest(df: DataFrame, features: list[str], target: str, trees: int = 128, depth: int = 8, seed: int = 42) -> dict:
    model = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(_assembled(df, features))
    return {"features": features, "weights": [1 / trees] * trees, "trees": _arrays(model)}


def predict_trees(df: DataFrame, ensemble: dict, name: str) -> DataFrame:
    """df with the ensemble's value; features are compared as float32, as the stored thresholds are meant."""
    kept = df.columns
    packed = [{k: np.array(v) for k, v in t.items()} for t in ensemble["trees"]]
    shared = df.sparkSession.sparkContext.broadcast((ensemble["features"], ensemble["weights"], packed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, weights, trees = shared.value
        for batch in batches:
            x = np.column_stack([np.array(batch.column(f).to_numpy(zero_copy_only=False), float) for f in features])
            total = np.zeros(len(x))
            for w, t in zip(weights, trees, strict=True):
                total += w * tree_values(x, t["left"], t["right"], t["feature"], t["threshold"], t["value"])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total)], names=[*kept, name])

    return df.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema), f"{name} double"]))
