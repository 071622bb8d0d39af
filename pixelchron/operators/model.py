"""Tree ensembles: training, rules as strings and tables, and classification by column expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = {("rf", "classifier"): RandomForestClassifier, ("rf", "regressor"): RandomForestRegressor, ("dt", "classifier"): DecisionTreeClassifier, ("dt", "regressor"): DecisionTreeRegressor}


def train(df: DataFrame, features: list[str], label: str, kind: str = "rf", task: str = "classifier", **options):
    """Fits a tree or forest of Spark ML on rows without missing values; options are its own."""
    if (kind, task) not in KINDS:
        raise ValueError(f"unknown model {kind} {task}")
    rows = VectorAssembler(inputCols=features, outputCol="features").transform(df.na.drop("any", subset=[*features, label]))
    return KINDS[kind, task](labelCol=label, featuresCol="features", **options).fit(rows)


def tree_rules(tree, features: list[str]) -> list[str]:
    """A tree's rules, one line for each node: depth, condition, and for a leaf its value."""
    lines = []
    for raw in tree.toDebugString.splitlines()[1:]:
        depth, text = (len(raw) - len(raw.lstrip())) // 1, raw.strip()
        if m := re.match(r"(If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", text):
            lines.append(f"{depth} {features[int(m[2])]} {m[3]} {m[4]}")
        elif m := re.match(r"Predict: ([-\d.eE]+)", text):
            lines.append(f"{depth} = {m[1]}")
        else:
            raise ValueError(f"rule that can't be written: {text}")
    return lines


def ensemble_rules(model, features: list[str]) -> list[list[str]]:
    return [tree_rules(t, features) for t in getattr(model, "trees", [model])]


def rules_table(spark: SparkSession, rules: list[list[str]]) -> DataFrame:
    """The rules as line, tree1, tree2 and so on, shorter trees padded with NA. It has the size of the model."""
    longest = max(map(len, rules)) + 1
    rows = [(i, *(r[i] if i < len(r) else "NA" for r in rules)) for i in range(longest)]
    return spark.createDataFrame(rows, ", ".join(["line int", *(f"tree{k + 1} string" for k in range(len(rules)))]))


def rules_from_table(table: DataFrame) -> list[list[str]]:
    rows = table.orderBy("line").collect()
    return [[r[c] for r in rows if r[c] != "NA"] for c in table.columns if c != "line"]


def tree_expression(lines: list[str]) -> Column:
    """A tree as nested WHEN: it needs no model object and stays in generated code. A missing feature takes no branch and gives NULL."""
    at = 0

    def node() -> Column:
        nonlocal at
        _, *rest = lines[at].split(" ")
        at += 1
        if rest[0] == "=":
            return F.lit(float(rest[1]))
        name, op, cut = rest
        yes = F.col(name) <= float(cut) if op == "<=" else F.col(name) > float(cut)
        left = node()
        at += 1  # the line of the other branch
        return F.when(yes, left).when(~yes, node())

    return node()


def classify(df: DataFrame, rules: list[list[str]], out: str = "class", task: str = "classifier") -> DataFrame:
    """Adds the majority vote of the trees (of equals the smallest class) or, for a regressor, their mean."""
    votes = [tree_expression(r) for r in rules]
    if task == "regressor":
        return df.withColumn(out, reduce(lambda a, b: a + b, votes) / len(votes))
    df = df.withColumn("_v", F.array(*votes))
    counted = F.transform(F.array_distinct("_v"), lambda c: F.struct((-F.size(F.filter("_v", lambda x: x == c))).alias("n"), c.alias("c")))
    return df.withColumn(out, F.when(~F.exists("_v", lambda x: x.isNull()), F.array_min(counted)["c"])).drop("_v")


def importances(model, features: list[str]) -> list[tuple[str, float]]:
    """Features by importance, greatest first."""
    return sorted(zip(features, model.featureImportances.toArray().tolist(), strict=True), key=lambda x: (-x[1], x[0]))


def accuracy(predicted: DataFrame, label: str, prediction: str = "prediction") -> dict[str, float]:
    """accuracy, and balanced: the mean over classes of the share found."""
    overall = MulticlassClassificationEvaluator(labelCol=label, predictionCol=prediction, metricName="accuracy").evaluate(predicted)
    recall = predicted.groupBy(label).agg(F.avg((F.col(label) == F.col(prediction)).cast("double")).alias("r")).agg(F.avg("r")).first()[0]
    return {"accuracy": overall, "balanced": recall}


def select_features(df: DataFrame, features: list[str], label: str, keep: int, step: int = 1, **options) -> list[str]:
    """Recursive elimination: the least important features go until keep are left."""
    features = list(features)
    while len(features) > keep:
        ranked = importances(train(df, features, label, **options), features)
        gone = {f for f, _ in ranked[-min(step, len(features) - keep) :]}
        features = [f for f in features if f not in gone]
    return features


def select_features_cv(df: DataFrame, features: list[str], label: str, least: int = 1, step: int = 1, folds: int = 5, **options) -> tuple[list[str], dict[int, float]]:
    """Recursive elimination with cross-validation: the features kept, and the mean balanced accuracy by number of features.

    In each fold features are eliminated on the rest and every number of features is scored on the fold. The number with the best mean, of
    equals the smallest, is then reached by elimination on all rows. A row's fold is a hash of its features and label, so equal rows are in one fold and reruns agree.
    """
    df = df.na.drop("any", subset=[*features, label]).withColumn("_fold", F.pmod(F.xxhash64(*features, label), F.lit(folds)))
    scores: dict[int, list[float]] = {}
    for k in range(folds):
        rest, fold, left = df.filter(F.col("_fold") != k), df.filter(F.col("_fold") == k), list(features)
        while True:
            model = train(rest, left, label, **options)
            predicted = model.transform(VectorAssembler(inputCols=left, outputCol="features").transform(fold))
            if (score := accuracy(predicted.withColumn(label, F.col(label).cast("double")), label)["balanced"]) is not None:
                scores.setdefault(len(left), []).append(score)
            if len(left) <= least:
                break
            left = [f for f, _ in importances(model, left)[: max(least, len(left) - step)]]
    means = {n: sum(s) / len(s) for n, s in scores.items()}
    best = min(means, key=lambda n: (-means[n], n))
    return select_features(df, features, label, best, step, **options), means


def correlation(df: DataFrame, columns: list[str], most_pairs: int = 200) -> DataFrame:
    """a, b, corr for all pairs of columns, each over the rows in which both are given; no row or no spread gives NULL.

    Up to most_pairs each pair is an aggregate of its own. A plan of thousands of aggregates isn't compiled any more, so beyond
    that each task multiplies matrices, and Spark sums moments by pair. They are taken round the columns' means: without
    these a large mean would use up the digits.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    if len(pairs) <= most_pairs:
        row = df.agg(*(F.corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)))
        return row.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs)))))
    rows = df.select(*(F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)))
    means = [m or 0.0 for m in rows.agg(*(F.avg(c) for c in rows.columns)).first()]
    first, second = np.triu_indices(len(columns), 1)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((6, len(means), len(means)))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]) - means
            given = np.column_stack([c.is_valid().to_numpy(zero_copy_only=False) for c in batch.columns]).astype(float)
            x[given == 0] = 0
            sums += given.T @ given, x.T @ given, given.T @ x, (x * x).T @ given, given.T @ (x * x), x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in (first, second, *sums[:, first, second])], ["a", "b", "n", "x", "y", "xx", "yy", "xy"])

    total = rows.mapInArrow(moments, "a bigint, b bigint, n double, x double, y double, xx double, yy double, xy double").groupBy("a", "b").agg(*(F.sum(c).alias(c) for c in ("n", "x", "y", "xx", "yy", "xy")))
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    spread = F.sqrt(F.greatest(F.col("xx") - F.try_divide(x * x, n), F.lit(0.0)) * F.greatest(F.col("yy") - F.try_divide(y * y, n), F.lit(0.0)))
    names = F.array(*map(F.lit, columns))
    return total.select(F.get(names, F.col("a").cast("int")).alias("a"), F.get(names, F.col("b").cast("int")).alias("b"), F.try_divide(F.col("xy") - F.try_divide(x * y, n), spread).alias("corr"))


def drop_correlated(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns less, of each pair correlated beyond limit, the one with the smaller variance."""
    variance = df.agg(*(F.var_samp(c).alias(c) for c in columns)).first().asDict()
    gone: set[str] = set()
    for r in correlation(df, columns).collect():
        if r["corr"] is not None and abs(r["corr"]) > limit and not {r["a"], r["b"]} & gone:
            gone.add(min((r["a"], r["b"]), key=lambda c: variance[c] or 0))
    return [c for c in columns if c not in gone]


def recode(df: DataFrame, column: str, codes: dict, out: str, drop_unknown: bool = True) -> DataFrame:
    """Classes by a literal map; rows of unknown code go unless they are to stay as NULL."""
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    df = df.withColumn(out, F.try_element_at(table, F.col(column)))
    return df.filter(F.col(out).isNotNull()) if drop_unknown else df
