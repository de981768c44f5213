"""The forest as rows: scores against plain Python and spark.ml, stored versions, guards, scaling."""

import random
import tempfile

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from rentscope.operators import churn
from rentscope.operators.forest import UNIT, Forest, node_rows, scaled
from rentscope.plans import cut_lineage
from rentscope.registry import FOREST, FOREST_NO_RECENCY
from rentscope.sources import driver, models
from tests.conftest import SF01

AS_OF = "2001-09-01 00:00:00"


@pytest.fixture(scope="module")
def features(spark):
    return cut_lineage(churn.churn_features(driver.load(spark, SF01), as_of=AS_OF))


def walk(forest, row):
    """Chance units of one row by plain Python."""
    x = [(row[c] - m) / s for c, m, s in zip(forest.features, forest.means, forest.scales)]
    total = 0
    for tree in forest.trees:
        at = 0
        while tree[at][0] >= 0:
            f, t, below, above, _ = tree[at]
            at = below if x[f] <= t else above
        total += tree[at][4]
    return total


@pytest.mark.parametrize("forest", [FOREST, FOREST_NO_RECENCY])
def test_scores_are_those_of_a_plain_walk(features, forest):
    assert len(forest.trees) == churn.NUM_TREES and forest.depth == churn.MAX_DEPTH
    for r in forest.score(features).collect()[:300]:
        units, whole = walk(forest, r), len(forest.trees) * UNIT
        assert r["churn_predicted"] == int(2 * units > whole)
        assert abs(r["churn_probability"] - units / whole) <= 0.5e-4 + 1e-12


def test_scoring_is_one_narrow_step(features):
    """No join, exchange or Python node; the trees are a constant of the plan."""
    plan = FOREST.score(features)._jdf.queryExecution()
    text = plan.executedPlan().toString()
    assert "Scan ExistingRDD" in text and not any(word in text for word in ("Exchange", "Join", "Python", "Arrow"))
    assert "from_json" not in plan.optimizedPlan().toString()


def test_node_rows_score_like_the_fitted_model(spark):
    """Every tree of spark.ml's forest, walked as rows, gives its probability."""
    rng = np.random.default_rng(3)
    data = [(*map(float, x), float(x[0] + x[1] * x[2] > 0.3)) for x in rng.normal(size=(600, 3))]
    df = spark.createDataFrame(data, "a double, b double, c double, label double")
    rows = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    model = RandomForestClassifier(numTrees=12, maxDepth=4, seed=5).fit(rows)
    about = spark.createDataFrame([(k, c, 0.0, 1.0, 0.0) for k, c in enumerate("abc")], "position int, feature string, mean double, scale double, importance double")
    forest = Forest.of_tables(node_rows(spark, model), about)
    assert [len(t) for t in forest.trees] == [t.numNodes for t in model.trees]
    got = sorted((r["a"], r["churn_probability"], r["churn_predicted"]) for r in forest.score(df).collect())
    want = sorted((r["a"], r["p"], r["prediction"]) for r in model.transform(rows).select("a", vector_to_array("probability")[1].alias("p"), "prediction").collect())
    for g, w in zip(got, want):
        assert g[0] == w[0] and abs(g[1] - w[1]) < 1e-4 and (g[2] == w[2] or abs(w[1] - 0.5) < 1e-5)


def test_refitted_forest(features):
    forest = churn.fit_churn_forest(features, num_trees=20)
    (r,) = churn.churn_report(churn.score_churn(features, forest)).collect()
    assert r["total_customers"] == 1500 and r["accuracy"] > 0.9 and r["imp_recency_days"] > 0.8
    assert abs(sum(forest.importance) - 1) < 1e-9


def test_fit_names_the_guard(features):
    with pytest.raises(ValueError, match="one_class"):
        churn.fit_churn_forest(features.withColumn("is_churn", F.lit(1)))
    with pytest.raises(ValueError, match="too_few_customers"):
        churn.fit_churn_forest(features.filter("customer_id < 12"))
    with pytest.raises(ValueError, match="too_few_customers"):
        churn.fit_churn_forest(features.filter("false"))


def test_features_are_read_once(spark):
    """One scan of the lines for features, split and scores together."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df = churn.churn_features(driver.load(spark, SF01), as_of=AS_OF)
        assert df._jdf.queryExecution().executedPlan().toString().count("lineitem.parquet") == 1
        scored = churn.score_churn(df, FOREST).scores
        assert "parquet" not in scored._jdf.queryExecution().executedPlan().toString()  # from the checkpoint
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# -- scaling and guards -----------------------------------------------------


def test_scaling_uses_the_marked_rows_and_population_deviation(spark):
    rows = [(1, 2.0, 5.0, "train"), (2, 4.0, 5.0, "train"), (3, 100.0, 7.0, "test")]
    out = scaled(spark.createDataFrame(rows, "id int, x double, y double, split string"), ("x", "y"), F.col("split") == "train")
    assert [(r["scaled_x"], r["scaled_y"]) for r in out.orderBy("id").collect()] == [(-1.0, 0.0), (1.0, 0.0), (97.0, 2.0)]
    empty = scaled(spark.createDataFrame(rows, "id int, x double, y double, split string").filter("false"), ("x",), F.lit(True))
    assert empty.count() == 0


def test_guards_of_every_scope(spark):
    rnd = random.Random(1)
    rows = [(k, "few" if k < 19 else "all gone" if k < 50 else "mixed", int(k < 50 or rnd.random() < 0.5)) for k in range(100)]
    rows[3] = (3, None, 0)
    df = spark.createDataFrame(rows, "customer_id int, g string, is_churn int")
    got = {(r["scope"], r["value"]): (r["customers"], r["status"]) for r in churn.churn_guards(df, ("g",)).collect()}
    assert got == {("all", None): (100, "ok"), ("g", "few"): (18, "too_few_customers"), ("g", None): (1, "too_few_customers"),
                   ("g", "all gone"): (31, "one_class"), ("g", "mixed"): (50, "ok")}
    assert churn.churn_guards(df.filter("false"), ("g",)).count() == 0
    assert [r["status"] for r in churn.churn_guards(df.limit(0).union(df.limit(3)), ()).collect()] == ["too_few_customers"]


# -- stored versions --------------------------------------------------------


def test_forest_is_the_same_after_a_trip_through_its_tables_and_text(spark, features):
    root = tempfile.mkdtemp(prefix="rentscope-forest-")
    FOREST.save(spark, root)
    again = Forest.load(spark, root)
    assert again == Forest.from_json(FOREST.to_json()) == FOREST
    assert sorted(map(tuple, again.score(features).collect())) == sorted(map(tuple, FOREST.score(features).collect()))


def test_a_failed_write_leaves_the_version_before(spark, features):
    """The second table of a new version fails half-way: readers go on with the old one, also for a newer fit later."""
    root = tempfile.mkdtemp(prefix="rentscope-versions-")
    FOREST.save(spark, root)
    tables = FOREST_NO_RECENCY.tables(spark)
    broken = tables["moments"].withColumn("mean", F.when(F.col("position") < 2, F.col("mean")).otherwise(F.raise_error(F.lit("lost")).cast("double")))
    with pytest.raises(Exception, match="lost"):
        models.write_version(spark, root, {"nodes": tables["nodes"], "moments": broken})
    assert Forest.load(spark, root) == FOREST
    assert models.manifest(spark, root).select("version").distinct().count() == 1
    FOREST_NO_RECENCY.save(spark, root)
    assert Forest.load(spark, root) == FOREST_NO_RECENCY
    first = models.manifest(spark, root).orderBy("number").first()["version"]
    stored = models.read_version(spark, root, first)
    assert Forest.of_tables(stored["nodes"], stored["moments"]) == FOREST


def test_readers_take_only_named_files(spark):
    root = tempfile.mkdtemp(prefix="rentscope-named-")
    version = models.write_version(spark, root, {"t": spark.range(5)})
    spark.range(100).write.mode("append").parquet(f"{root}/versions/{version}/t")  # left by a writer that is gone
    assert models.read_version(spark, root)["t"].count() == 5


def test_nothing_stored(spark):
    root = tempfile.mkdtemp(prefix="rentscope-none-")
    with pytest.raises(LookupError):
        models.read_version(spark, f"{root}/never")
    models.write_version(spark, root, {"empty": spark.range(0)})
    assert models.read_version(spark, root)["empty"].count() == 0
