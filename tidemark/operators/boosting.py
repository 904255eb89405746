"""Boosted trees for censored durations: the accelerated failure time loss with a logistic error.

The model adds small trees to the logarithm of the expected duration. Rows stay in the cluster with the number of the bin of
each feature; a level of a tree is one aggregation of gradients and curvatures by node, feature and bin, from which the driver
picks the splits. A tree is a column expression over the bins. The margin so far is written to the shared folder every few
trees, so that plans do not grow with the model.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.shared import dropped, shared_path

#: Trees between two writings of the margins.
WRITTEN = 5


def loss_terms(margin: Column, log_time: Column, event: Column, sigma: float) -> tuple[Column, Column, Column]:
    """(loss, gradient, curvature) of the margin: -ln of the density of an observed duration, of the survival of a censored one.

    With z = (ln t - margin) / sigma and s = 1 / (1 + exp(-z)) these are ln(1 + e^z) (censored) and 2 ln(1 + e^z) - z + ln sigma
    (observed, without the terms in t)."""
    z = (log_time - margin) / F.lit(sigma)
    s = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    # ln(1 + e^z) without overflow
    soft = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))
    loss = F.when(event, 2 * soft - z + F.log(F.lit(sigma))).otherwise(soft)
    gradient = F.when(event, (1 - 2 * s) / F.lit(sigma)).otherwise(-s / F.lit(sigma))
    curvature = F.when(event, 2 * s * (1 - s)).otherwise(s * (1 - s)) / F.lit(sigma * sigma)
    return loss, gradient, curvature


@dataclass
class Tree:
    """A split (feature, bin: lower or equal goes left; missing has bin 0) with its two sides, or a leaf."""

    value: float = 0.0
    split: tuple[int, int] | None = None
    sides: tuple = ()

    def column(self) -> Column:
        if self.split is None:
            return F.lit(self.value)
        feature, at = self.split
        return F.when(F.col(f"_b{feature}") <= at, self.sides[0].column()).otherwise(self.sides[1].column())

    def leaf(self, number: int = 1) -> Column:
        """The number of the leaf that a row falls into: 1 for the root, 2 n and 2 n + 1 below n."""
        if self.split is None:
            return F.lit(number)
        feature, at = self.split
        return F.when(F.col(f"_b{feature}") <= at, self.sides[0].leaf(2 * number)).otherwise(self.sides[1].leaf(2 * number + 1))

    def at(self, number: int) -> Tree:
        return self if number == 1 else self.at(number // 2).sides[number % 2]


def _below(cuts: list[float], value: Column) -> Column:
    return F.size(F.filter(F.lit(cuts), lambda c: c < value))


@dataclass
class Boosted:
    features: list[str]
    cuts: list[list[float]]
    start: float
    sigma: float
    trees: list[Tree] = field(default_factory=list)

    def binned(self, df: DataFrame) -> DataFrame:
        """df with the bin of each feature: 0 for a null or NaN, else one more than the cuts below the value."""
        bins = {}
        for i, (name, cuts) in enumerate(zip(self.features, self.cuts, strict=True)):
            value = F.col(name).cast("double")
            place = _below(cuts, value) + 1 if cuts else F.lit(1)
            bins[f"_b{i}"] = F.when(value.isNull() | F.isnan(value), 0).otherwise(place)
        return df.withColumns(bins)

    def margin(self, trees: list[Tree] | None = None) -> Column:
        total = F.lit(0.0)
        for tree in self.trees if trees is None else trees:
            total = total + tree.column()
        return total

    def predict(self, df: DataFrame, name: str = "expected") -> DataFrame:
        """df with the expected (median) duration."""
        return self.binned(df).select(*df.columns, F.exp(self.start + self.margin()).alias(name))


def _split(sums: dict, features: int, shrink: float, least: float) -> tuple[float, tuple[int, int] | None]:
    """(gain, (feature, bin)) of the best split of a node from {(feature, bin): (gradient, curvature)}."""
    best, where = 1e-9, None
    for f in range(features):
        bins = sorted((b, g, h) for (i, b), (g, h) in sums.items() if i == f)
        all_g, all_h = sum(x[1] for x in bins), sum(x[2] for x in bins)
        left_g = left_h = 0.0
        for b, g, h in bins[:-1]:
            left_g, left_h = left_g + g, left_h + h
            right_g, right_h = all_g - left_g, all_h - left_h
            if min(left_h, right_h) < least:
                continue
            gain = left_g**2 / (left_h + shrink) + right_g**2 / (right_h + shrink) - all_g**2 / (all_h + shrink)
            if gain > best:
                best, where = gain, (f, b)
    return best, where


def fit(train: DataFrame, features: list[str], duration: str, event: str, trees: int = 20, depth: int = 3, rate: float = 0.3, sigma: float = 1.0, bins: int = 32, shrink: float = 1.0, least: float = 1.0, weight: str | None = None) -> Boosted:
    """Boosted trees for rows with a duration (half a unit at least) that is observed where `event` holds, else censored.

    Nulls in features go their own way; a row without a duration or event is left out. `weight` names a column of weights."""
    spark = train.sparkSession
    values = {f"_f{i}": F.col(c).cast("double") for i, c in enumerate(features)}
    known = train.where(F.col(duration).isNotNull() & F.col(event).isNotNull()).select(
        *[v.alias(n) for n, v in values.items()], F.log(F.greatest(F.col(duration).cast("double"), F.lit(0.5))).alias("_t"), F.col(event).cast("boolean").alias("_e"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_w")
    )
    folder = shared_path(spark, "boosting")
    try:
        shares = [k / bins for k in range(1, bins)]
        one = known.agg(F.avg("_t").alias("start"), *[F.percentile_approx(F.when(~F.isnan(n), F.col(n)), shares).alias(n) for n in values]).first()
        model = Boosted([f"_f{i}" for i in range(len(features))], [sorted(set(one[n] or [])) for n in values], one["start"] or 0.0, sigma)
        model.binned(known).select(*[f"_b{i}" for i in range(len(features))], "_t", "_e", "_w", F.lit(model.start).alias("_m")).write.parquet(f"{folder}/0")
        rows, written = spark.read.parquet(f"{folder}/0"), 0
        for k in range(trees):
            fresh = model.trees[written:]
            _, gradient, curvature = loss_terms(F.col("_m") + model.margin(fresh), F.col("_t"), F.col("_e"), sigma)
            graded = rows.select("*", (gradient * F.col("_w")).alias("_g"), (curvature * F.col("_w")).alias("_h"))
            tree, open_nodes = Tree(), [1]
            for level in range(depth + 1):
                cells = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(f"_b{i}").alias("b")) for i in range(len(features))]))
                held = graded.select(tree.leaf().alias("_n"), "_g", "_h", cells.alias("x")).where(F.col("_n").isin(open_nodes))
                sums: dict = {}
                for r in held.groupBy("_n", "x.f", "x.b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h")).collect():
                    sums.setdefault(r["_n"], {})[r["f"], r["b"]] = (r["g"], r["h"])
                after = []
                for n in open_nodes:
                    found = sums.get(n, {})
                    g, h = (sum(v[j] for (f, _), v in found.items() if f == 0) for j in (0, 1))
                    node = tree.at(n)
                    node.value = -rate * g / (h + shrink)
                    _, where = _split(found, len(features), shrink, least) if level < depth else (0, None)
                    if where:
                        node.split, node.sides = where, (Tree(), Tree())
                        after += [2 * n, 2 * n + 1]
                open_nodes = after
                if not open_nodes:
                    break
            model.trees.append(tree)
            if (k + 1) % WRITTEN == 0 and k + 1 < trees:
                rows.withColumn("_m", F.col("_m") + model.margin(model.trees[written:])).write.parquet(f"{folder}/{k + 1}")
                rows, written = spark.read.parquet(f"{folder}/{k + 1}"), k + 1
        model.features = list(features)
        return model
    finally:
        dropped(spark, folder)
