"""A random forest as a table of nodes: scaling, fitting, storing, scoring.

``spark.ml`` grows the trees; what is kept of them is one row a node. Scoring
walks those nodes with a fold over an array, a column like any other: no join,
no exchange, no model object. The same rows score in any SQL engine.
"""

from __future__ import annotations

import json
import os
import pkgutil
from dataclasses import dataclass

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentscope.plans import cut_lineage
from rentscope.session import ensure_checkpoint_dir
from rentscope.sources import models

#: A leaf's chance of class 1 is kept in millionths, so that sums over trees are exact.
UNIT = 1_000_000

NODES = "tree int, node int, feature int, threshold double, below int, above int, chance long"
MOMENTS = "position int, feature string, mean double, scale double, importance double"
_WALKED = "array<array<struct<f:int,t:double,b:int,a:int,p:bigint>>>"


def moments(features: DataFrame, columns: tuple[str, ...], used: Column) -> Column:
    """Scalar subquery: a struct of mean_<c> and scale_<c> over the rows ``used``.

    One pass, partially aggregated. The scale is the population deviation, 1
    where that is 0 or there is no row.
    """
    figures = []
    for c in columns:
        value = F.when(used, F.col(c).cast("double"))
        deviation = F.stddev_pop(value)
        figures += [F.coalesce(F.avg(value), F.lit(0.0)).alias(f"mean_{c}"),
                    F.when(deviation > 0, deviation).otherwise(1.0).alias(f"scale_{c}")]
    return features.agg(*figures).select(F.struct("*").alias("m")).scalar()


def scaled(features: DataFrame, columns: tuple[str, ...], used: Column) -> DataFrame:
    """``features`` with scaled_<c> = (c - mean) / population deviation, both of the rows ``used``."""
    m = moments(features, columns, used)
    return features.select("*", *[
        ((F.col(c) - m[f"mean_{c}"]) / m[f"scale_{c}"]).alias(f"scaled_{c}") for c in columns])


@dataclass(frozen=True)
class Forest:
    """Trees of nodes (feature, threshold, below, above, chance); a leaf has feature -1 and only its chance counts.

    A node sends a row ``below`` if its scaled feature is at most the threshold.
    """

    features: tuple[str, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    importance: tuple[float, ...]
    trees: tuple[tuple[tuple, ...], ...]

    @property
    def depth(self) -> int:
        def below(tree, at: int) -> int:
            feature, _, left, right, _ = tree[at]
            return 0 if feature < 0 else 1 + max(below(tree, left), below(tree, right))

        return max((below(t, 0) for t in self.trees), default=0)

    def walked(self) -> Column:
        """The trees as one constant: an array of nodes for each tree."""
        trees = [[dict(zip("ftbap", n)) for n in t] for t in self.trees]
        return F.from_json(F.lit(json.dumps(trees)), _WALKED)

    def chance_units(self) -> Column:
        """The sum over the trees of the chances (in 1 / UNIT) of the leaf that a row reaches."""
        steps = F.sequence(F.lit(1), F.lit(max(1, self.depth)))

        def total(x: Column) -> Column:
            def leaf(tree: Column) -> Column:
                def step(node: Column, _: Column) -> Column:
                    onward = F.when(F.get(x, node["f"]) <= node["t"], node["b"]).otherwise(node["a"])
                    return F.when(node["f"] < 0, node).otherwise(F.get(tree, onward))

                return F.aggregate(steps, F.get(tree, F.lit(0)), step)["p"]

            return F.aggregate(F.transform(self.walked(), leaf), F.lit(0).cast("long"), lambda units, p: units + p)

        x = F.array(*[(F.col(c) - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.scales)])
        return F.transform(F.array(x), total)[0]  # scaled once a row, however often the walk looks at it

    def score(self, features: DataFrame) -> DataFrame:
        """``features`` with churn_predicted (chance over a half) and churn_probability (4 decimals, half to even)."""
        whole = len(self.trees) * UNIT
        rows = features.withColumn("_units", self.chance_units())
        share = F.col("_units").cast("decimal(20,0)") / F.lit(whole).cast("decimal(16,0)")
        return rows.select(
            *features.columns, (2 * F.col("_units") > whole).cast("int").alias("churn_predicted"),
            F.bround(share, 4).cast("double").alias("churn_probability"))

    def rounded(self, digits: int = 6) -> "Forest":
        """The forest with figures of so many decimals, for a shorter text."""
        short = lambda values: tuple(round(v, digits) for v in values)
        trees = tuple(tuple((f, round(t, digits), b, a, p) for f, t, b, a, p in tree) for tree in self.trees)
        return Forest(self.features, short(self.means), short(self.scales), short(self.importance), trees)

    # -- as tables ----------------------------------------------------------

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        """``nodes`` and ``moments``, one row a node and one a feature."""
        rows = [(k, i, None if n[0] < 0 else n[0], *((None,) * 3 if n[0] < 0 else n[1:4]), n[4])
                for k, tree in enumerate(self.trees) for i, n in enumerate(tree)]
        about = list(zip(range(len(self.features)), self.features, self.means, self.scales, self.importance))
        return {"nodes": spark.createDataFrame(rows, NODES), "moments": spark.createDataFrame(about, MOMENTS)}

    @staticmethod
    def of_tables(nodes: DataFrame, about: DataFrame) -> "Forest":
        """The forest of stored tables: as many rows as trees have nodes, whatever was learned from."""
        trees: dict[int, dict[int, tuple]] = {}
        for r in nodes.collect():
            leaf = r["feature"] is None
            trees.setdefault(r["tree"], {})[r["node"]] = (-1, 0.0, -1, -1, r["chance"]) if leaf else (
                r["feature"], r["threshold"], r["below"], r["above"], 0)
        features = sorted(about.collect(), key=lambda r: r["position"])
        column = lambda name: tuple(r[name] for r in features)
        return Forest(column("feature"), column("mean"), column("scale"), column("importance"),
                      tuple(tuple(t[i] for i in range(len(t))) for _, t in sorted(trees.items())))

    def save(self, spark: SparkSession, path: str) -> None:
        """Store the forest as a new version below ``path`` (``sources.models``)."""
        models.write_version(spark, path, self.tables(spark))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Forest":
        stored = models.read_version(spark, path)
        return Forest.of_tables(stored["nodes"], stored["moments"])

    # -- as text ------------------------------------------------------------

    def to_json(self) -> str:
        """One line for the features and one for each tree."""
        lines = [json.dumps([self.features, self.means, self.scales, self.importance])]
        lines += [json.dumps(t, separators=(",", ":")) for t in self.trees]
        return "[" + ",\n".join(lines) + "]\n"

    @staticmethod
    def from_json(text: str) -> "Forest":
        (features, means, scales, importance), *trees = json.loads(text)
        return Forest(tuple(features), tuple(means), tuple(scales), tuple(importance), tuple(tuple(map(tuple, t)) for t in trees))

    @staticmethod
    def stored(name: str) -> "Forest":
        """A forest that comes with the library (``scripts/fit_forests.py`` fits them)."""
        return Forest.from_json(pkgutil.get_data("rentscope", f"models/{name}.json").decode())


def node_rows(spark: SparkSession, model: RandomForestClassificationModel) -> DataFrame:
    """The nodes of a fitted forest as rows of NODES, from Spark ML's stored form."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/forest-{model.uid}-{os.urandom(6).hex()}"
    model.write().save(path)
    n = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    leaf = F.col("leftChild") < 0
    inner = lambda c: F.when(~leaf, c)
    stats = F.col("impurityStats")
    chance = F.round(UNIT * stats[1] / F.aggregate(stats, F.lit(0.0), lambda a, x: a + x)).cast("long")
    return n.select(
        F.col("treeID").alias("tree"), F.col("id").alias("node"), inner(F.col("split.featureIndex")).alias("feature"),
        inner(F.col("split.leftCategoriesOrThreshold")[0]).alias("threshold"),
        inner(F.col("leftChild")).alias("below"), inner(F.col("rightChild")).alias("above"), chance.alias("chance"))


def fit(rows: DataFrame, columns: tuple[str, ...], label: str, used: Column, trees: int, depth: int, seed: int) -> Forest:
    """A forest from the rows ``used``: features scaled by their moments, classes weighted alike.

    ``label`` is 0 or 1; both classes must be among the rows used.
    """
    spark = rows.sparkSession
    m = rows.select(moments(rows, columns, used).alias("m")).select("m.*").first()
    counts = {r[label]: r["n"] for r in rows.filter(used).groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.when(F.col(label) == 1, total / (2.0 * counts[1])).otherwise(total / (2.0 * counts[0]))
    train = rows.filter(used).select(
        *[((F.col(c) - F.lit(m[f"mean_{c}"])) / F.lit(m[f"scale_{c}"])).alias(c) for c in columns],
        F.col(label).cast("double").alias("label"), weight.alias("class_weight"))
    train = VectorAssembler(inputCols=list(columns), outputCol="features").transform(train)
    forest = RandomForestClassifier(weightCol="class_weight", numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=True)
    ensure_checkpoint_dir(spark)
    model = forest.fit(train)
    importance = model.featureImportances.toArray()
    about = [(k, c, float(m[f"mean_{c}"]), float(m[f"scale_{c}"]), float(importance[k])) for k, c in enumerate(columns)]
    return Forest.of_tables(cut_lineage(node_rows(spark, model)), spark.createDataFrame(about, MOMENTS))
