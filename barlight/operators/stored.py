"""Fitted models as parameter tables: how they are taken from a fit, and how rows are scored from them in column expressions.

A table holds plain numbers: medians, means and spreads of the features, coefficients or ensemble nodes, and calibration steps. Every engine that can
add, compare and look up scores rows from it alike.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from barlight.config import FAMILIES
from barlight.functions.columns import as_int, bound
from barlight.operators import models
from barlight.operators.stoprisk import sigmoid
from barlight.session import run_folder

c = F.col
DIGITS = 10
STEP_DIGITS = 8
"""Digits of probabilities and step bounds when a step is looked up."""


def plain(x: float) -> float:
    return round(float(x), DIGITS)


def node_table(model) -> list[list[float]]:
    """[tree, node, feature, threshold, left, right, value] of a fitted tree ensemble, as its saved form lists them; feature -1 marks a leaf.

    Nodes are numbered through all trees. A leaf's value is its share of the model: class shares over trees for a forest, weighted predictions for boosting.
    """
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{run_folder(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    saved = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()  # nodes of one model
    weights = model.treeWeights
    forest = hasattr(model, "numClasses") and len(set(weights)) == 1 and "RandomForest" in type(model).__name__
    number = {(r["treeID"], r["id"]): i for i, r in enumerate(saved)}
    out = []
    for r in saved:
        tree = r["treeID"]
        if r["leftChild"] < 0:
            share = r["impurityStats"][1] / sum(r["impurityStats"]) / len(weights) if forest else r["prediction"] * weights[tree]
            out.append([tree, number[tree, r["id"]], -1, 0.0, -1, -1, float(share)])
        else:
            threshold = r["split"]["leftCategoriesOrThreshold"][0]
            out.append([tree, number[tree, r["id"]], r["split"]["featureIndex"], float(threshold), number[tree, r["leftChild"]], number[tree, r["rightChild"]], 0.0])
    return out


def walk(nodes: list[list[float]], x: Column) -> Column:
    """Sum over the trees of the value of the leaf that the array *x* falls into."""
    children = {int(n[1]): (int(n[4]), int(n[5])) for n in nodes if n[2] >= 0}
    below = {i for pair in children.values() for i in pair}
    roots = [int(n[1]) for n in nodes if int(n[1]) not in below]
    depth, level = 0, roots
    while level := [k for i in level for k in children.get(i, ())]:
        depth += 1
    column = lambda i, kind: F.expr(f"array({', '.join(f'{kind}({n[i]})' for n in nodes)})")  # noqa: E731 - one expression, folded to a literal
    feature, threshold, left, right, value = column(2, "int"), column(3, "double"), column(4, "int"), column(5, "int"), column(6, "double")
    at = lambda array, i: F.get(array, i)

    def total_of(x: Column) -> Column:
        def down(node: Column, _: Column) -> Column:
            return F.when(at(feature, node) < 0, node).when(at(x, at(feature, node)) <= at(threshold, node), at(left, node)).otherwise(at(right, node))

        leaf = lambda root: F.aggregate(F.sequence(F.lit(1), F.lit(depth)), root, down) if depth else root
        return F.aggregate(F.expr(f"array({', '.join(map(str, roots))})"), F.lit(0.0), lambda total, root: total + at(value, leaf(root)))

    return bound(x, total_of)


def table_of(fitted: models.Calibrated, kind: str) -> dict:
    """Parameter table of a fitted and calibrated classifier."""
    out = {
        "kind": kind, "features": list(fitted.features), "families": list(FAMILIES) if fitted.families else [],
        "median": [plain(fitted.stats[f]["median"]) for f in fitted.features], "mean": [plain(fitted.stats[f]["mean"]) for f in fitted.features],
        "std": [plain(fitted.stats[f]["std"]) for f in fitted.features],
    }
    if kind in ("logistic", "margin"):
        out |= {"coefficients": [plain(x) for x in fitted.model.coefficients], "intercept": plain(fitted.model.intercept)}
    else:
        out["nodes"] = [[*n[:3], plain(n[3]), *n[4:6], plain(n[6])] for n in node_table(fitted.model)]
    # A bound is its step's largest training probability: lifted by half a digit, so that the probability itself stays within.
    out["steps"] = [[round(upper + 5 * 10.0 ** -(STEP_DIGITS + 1), STEP_DIGITS), plain(value)] for upper, value in fitted.steps]
    return out


def inputs_of(table: dict) -> list[Column]:
    """Standardised features, then family indicators."""
    numbers = zip(table["features"], table["median"], table["mean"], table["std"])
    scaled = [(F.coalesce(c(f).cast("double"), F.lit(median)) - F.lit(mean)) / F.lit(std) for f, median, mean, std in numbers]
    return [*scaled, *(as_int(F.upper(F.trim("pattern_family")) == f).cast("double") for f in table["families"])]


def raw_probability(table: dict) -> Column:
    x = inputs_of(table)
    if table["kind"] in ("logistic", "margin"):
        return sigmoid(sum((v * F.lit(b) for v, b in zip(x, table["coefficients"])), F.lit(table["intercept"])))
    total = walk(table["nodes"], F.array(*x))
    return total if table["kind"] == "random_forest" else 1.0 / (1.0 + F.exp(-2.0 * total))


def probability(table: dict) -> Column:
    """Calibrated probability: the value of the first step whose bound isn't below the raw one."""
    *steps, (_, last) = table["steps"]
    ladder = F.expr(f"array({', '.join(f'named_struct("upper", double({upper}), "value", double({value}))' for upper, value in steps)})")
    value = lambda p: F.coalesce(F.get(F.filter(ladder, lambda s: p <= s["upper"]), F.lit(0))["value"], F.lit(float(last)))
    return bound(F.round(raw_probability(table), STEP_DIGITS), value) if steps else F.lit(float(last))


def gradient(df: DataFrame, table: dict, label: str, weight: str | None = None) -> DataFrame:
    """Gradient of the penalised logistic loss at the table's coefficients: column, gradient, with rows and positives. Zero at the optimum."""
    names = [*table["features"], *table["families"], "intercept"]
    ready, n = models.balance(df, label, weight)
    rest = c("model_weight") * (raw_probability(table) - c(label))
    parts = ready.select(rest.alias("_r"), "model_weight", c(label).alias("_y"), *[x.alias(f"_x{i}") for i, x in enumerate([*inputs_of(table), F.lit(1.0)])])
    sums = parts.agg(F.sum("model_weight").alias("w"), F.count_if(c("_y") == 1).alias("positives"), *[F.sum(c("_r") * c(f"_x{i}")).alias(f"g{i}") for i in range(len(names))])
    penalty = [models.L2 / max(1, n) * b for b in table["coefficients"]] + [0.0]
    cells = F.array(*[F.struct(F.lit(name).alias("column"), (c(f"g{i}") / c("w") + F.lit(penalty[i])).alias("gradient")) for i, name in enumerate(names)])
    return sums.select(F.lit(n).cast("long").alias("train_rows"), "positives", F.explode(cells).alias("_c")).select("train_rows", "positives", "_c.*")

