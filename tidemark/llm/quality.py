"""Quality as a sparse ensemble of rules.

Statistics of a text are Spark columns. Shallow trees (a random forest fitted on a bounded sample of labelled rows) give
paths; each path is a conjunction of thresholds, a rule. A logistic regression with an L1 penalty weighs the rules, and most
weights become zero. The rules that stay are compiled back into one Spark column, so scoring is a projection.

Training takes at most about `max_examples` labelled rows, chosen by a hash of the id within each class (the smaller class gives
all it has up to half of the bound); rows weigh by the inverse of their class's share in the regression. Whole texts are scored. A null text is
an empty one, and an empty text has all statistics zero. Repeated rows are scored alike; labels, languages, sources and ids
are not inputs of a score. With fewer than two classes among the labels the score is their smoothed share (0.5 without any).
"""

from __future__ import annotations

import re
from math import log

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .toxicity import labelled_sample

MAX_EXAMPLES = 8_000
TREES = 12
DEPTH = 3
PENALTY = 0.002


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a number that is 0 for an empty one."""
    t = F.coalesce(text, F.lit(""))
    chars = F.length(t)
    words = F.filter(F.split(t, r"[ \t\n\r]+"), lambda w: w != "")
    n = F.size(words)
    lines = F.split(t, "\n")

    def share(count: Column, of: Column) -> Column:
        return F.when(of > 0, count / of).otherwise(0.0)

    def left(pattern: str) -> Column:
        return F.length(F.regexp_replace(t, pattern, ""))

    return {
        "chars": F.log1p(chars.cast("double")),
        "words": F.log1p(n.cast("double")),
        "word_chars": share(chars - n, n),
        "letters": share(left(r"[^\p{L}]+"), chars),
        "capitals": share(left(r"[^\p{Lu}]+"), chars),
        "digits": share(left(r"[^0-9]+"), chars),
        "symbols": share(left(r"[\p{L}\p{N}\s.,;:'\"()?-]+"), chars),
        "exclamations": share(left(r"[^!?]+"), n),
        "stops": share(left(r"[^.]+"), n),
        "distinct": share(F.size(F.array_distinct(words)), n),
        "distinct_lines": share(F.size(F.array_distinct(lines)), F.size(lines)),
        "line_words": share(n, F.size(lines)),
    }


def with_statistics(rows: DataFrame, text: str = "text") -> DataFrame:
    """rows with a column `stats` (struct of numbers)."""
    return rows.withColumn("stats", F.struct(*[F.coalesce(c.cast("double"), F.lit(0.0)).alias(k) for k, c in statistics(F.col(text)).items()]))


def tree_paths(debug: str) -> list[list[tuple[int, str, float]]]:
    """Conjunctions of (feature, <= or >, threshold) for every node below the root, from a tree's printed form."""
    out, path = [], []
    for line in debug.splitlines():
        if m := re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+)\)", line):
            del path[_depth(len(m[1])) :]
            path.append((int(m[3]), m[4], float(m[5])))
            out.append(list(path))
    return out


def _depth(spaces: int) -> int:
    """Depth of a node that is printed after so many spaces (two for the first level, one more for each further)."""
    return max(0, spaces - 2)


class RuleModel:
    """Weighted rules; `score` is the Spark column that they compile to."""

    def __init__(self, names: list[str], rules: list[tuple[list[tuple[int, str, float]], float]], intercept: float):
        self.names, self.rules, self.intercept = names, rules, intercept

    def condition(self, rule: list[tuple[int, str, float]]) -> Column:
        tests = [F.col(f"stats.{self.names[i]}") <= v if op == "<=" else F.col(f"stats.{self.names[i]}") > v for i, op, v in rule]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out

    def score(self) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(self.condition(rule), F.lit(weight)).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", id_col: str = "doc_id", max_examples: int = MAX_EXAMPLES) -> RuleModel:
    sample = with_statistics(labelled_sample(docs, labels, label, text, id_col, max_examples)).select(F.col("label").cast("double").alias("label"), "weight", "id", "stats").persist()
    try:
        # how many labelled rows each class has, those that were not drawn included
        sizes = {int(r["label"]): r["n"] for r in sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()}
        names = sample.select("stats.*").columns
        n, pos = sum(sizes.values()), sizes.get(1, 0)
        if len(sizes) < 2:
            share = (pos + 1) / (n + 2)
            return RuleModel(names, [], _logit(share))
        flat = sample.select("label", F.col("weight").alias("drawn"), "id", "stats.*").coalesce(4)
        vectors = VectorAssembler(inputCols=names, outputCol="features").transform(flat)
        weighted = vectors.withColumn("weight", F.col("drawn") * F.when(F.col("label") == 1, n / (2 * pos)).otherwise(n / (2 * (n - pos)))).persist()
        forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="onethird", subsamplingRate=0.7).fit(weighted)
        rules = sorted({tuple(sorted(set(p))) for tree in forest.trees for p in tree_paths(tree.toDebugString)})
        model = RuleModel(names, [], _logit((pos + 1) / (n + 2)))
        if rules:
            shown = sample.select("label", "weight", F.array(*[model.condition(list(r)).cast("double") for r in rules]).alias("hits")).coalesce(4)
            fitted = LogisticRegression(labelCol="label", weightCol="weight", elasticNetParam=1.0, regParam=PENALTY, maxIter=60, standardization=False).fit(shown.select("label", "weight", array_to_vector("hits").alias("features")))
            model = RuleModel(names, [(list(r), float(w)) for r, w in zip(rules, fitted.coefficients.toArray(), strict=True) if w], float(fitted.intercept))
        weighted.unpersist()
        return model
    finally:
        sample.unpersist()


def _logit(p: float) -> float:
    return log(p / (1 - p))


def score(docs: DataFrame, model: RuleModel, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row's whole text; the statistics and the rules are Spark columns."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    return with_statistics(rows).select("id", model.score().alias("score"))
