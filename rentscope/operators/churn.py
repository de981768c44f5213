"""Churn features, a balanced random forest, its report and at-risk list.

Features are one Spark aggregation (per rental, then per customer). The
forest is trained with ``spark.ml`` (distributed tree aggregation). The split
is exact in each class, by a hash of the customer, without a global ordering.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentscope.functions import as_date, days_between, duration_micros, round_ratio, row_micros
from rentscope.model import RentalData
from rentscope.operators import forest as forests
from rentscope.operators.rfm import latest_rental_date
from rentscope.plans import customer_rollup, cut_lineage, paid_rentals

# The model's feature list, churn rule and forest settings.
FEATURES = ("recency_days", "frequency", "monetary", "avg_payment", "avg_duration")
CHURN_AFTER_DAYS = 90
MIN_CUSTOMERS = 20
NUM_TREES = 100
MAX_DEPTH = 6
SEED = 42
TEST_FRACTION = 0.2


def churn_features(data: RentalData, as_of=None) -> DataFrame:
    """customer_id, name, email, recency_days, frequency, monetary,
    avg_payment, avg_duration, is_churn for customers with a paid rental.

    Unreturned rentals count up to ``as_of`` (a 'yyyy-MM-dd HH:mm:ss'
    string, a datetime, or None for the current time). Missing values are 0;
    is_churn = recency_days > 90.
    """
    if as_of is None:
        as_of_col = F.current_timestamp().cast("timestamp_ntz")
    else:
        as_of_col = F.lit(as_of).cast("timestamp_ntz")
    paid = paid_rentals(data).filter(F.col("rental_date").isNotNull()).withColumn(
        "dur_us", duration_micros(F.coalesce(F.col("return_date"), as_of_col), F.col("rental_date"))
    )
    per_customer = customer_rollup(
        paid,
        F.max("rental_date").alias("last_ts"),
        F.sum(F.col("dur_us").cast("decimal(28,0)") * F.col("n_rows")).alias("dur_us_w"),
    )
    feats = per_customer.join(data.customer.select("customer_id", "name", "email"), "customer_id").select(
        "customer_id", "name", "email",
        F.coalesce(days_between(latest_rental_date(data), as_date("last_ts")), F.lit(0)).cast("long").alias("recency_days"),
        F.col("rentals").cast("long").alias("frequency"),
        F.coalesce(F.round("paid", 2).cast("double"), F.lit(0.0)).alias("monetary"),
        F.coalesce(round_ratio("paid", "n_amt", 2).cast("double"), F.lit(0.0)).alias("avg_payment"),
        F.coalesce(round_ratio("dur_us_w", row_micros("n_rows"), 2, "decimal(28,0)").cast("double"),
                   F.lit(0.0)).alias("avg_duration"),
    )
    return feats.withColumn("is_churn", (F.col("recency_days") > CHURN_AFTER_DAYS).cast("int"))


# Fixed values of the split's hash: an odd multiplier and the modulus; buckets of it that are counted.
HASH_FACTOR, HASH_SIZE, HASH_BUCKETS = 2654435761, 1 << 32, 1 << 16


def with_split(features: DataFrame, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """``features`` with split: 'test' for ``test_fraction`` of each class,
    rounded half up, those with the smallest hash of customer_id, else 'train'.

    Customers are counted by class and hash bucket; the counts, a fixed number
    of rows a class, tell in which bucket the last test customer lies, and only
    that bucket's customers are ranked. So nothing is sorted as a whole.
    """
    hashed = F.pmod(F.col("customer_id").cast("decimal(20,0)") * HASH_FACTOR, F.lit(HASH_SIZE)).cast("long")
    rows = features.withColumn("_hash", hashed).withColumn("_bucket", F.floor(F.col("_hash") / (HASH_SIZE // HASH_BUCKETS)).cast("int"))
    counts = rows.groupBy("is_churn", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    classes, ordered = Window.partitionBy("is_churn"), Window.partitionBy("is_churn").orderBy("_bucket")
    wanted = F.floor(F.sum("n").over(classes) * F.lit(test_fraction) + 0.5)
    counts = counts.select("is_churn", "_bucket", "n", wanted.alias("wanted"), F.sum("n").over(ordered).alias("upto"))
    # One row a class: the first bucket that reaches the number wanted, and what is still open there.
    edge = counts.filter((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.greatest("wanted", F.lit(1)))).select(
        "is_churn", F.col("_bucket").alias("_edge"), (F.col("wanted") - F.col("upto") + F.col("n")).alias("_open"))
    rows = rows.join(F.broadcast(edge), "is_churn")
    rank = F.row_number().over(Window.partitionBy("is_churn", "_bucket").orderBy("_hash", "customer_id"))
    ranked = rows.filter(F.col("_bucket") == F.col("_edge")).withColumn("split", F.when(rank <= F.col("_open"), "test").otherwise("train"))
    others = rows.filter(F.col("_bucket") != F.col("_edge")).withColumn("split", F.when(F.col("_bucket") < F.col("_edge"), "test").otherwise("train"))
    return ranked.unionByName(others).select(*features.columns, "split")


def split_weights(features: DataFrame, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """is_churn, split, customers, class_weight (n / (2 * n of the class) over the training rows)."""
    counts = with_split(features, test_fraction).groupBy("is_churn", "split").agg(F.count(F.lit(1)).alias("customers"))
    train = F.when(F.col("split") == "train", F.col("customers"))
    total, own = F.sum(train).over(Window.partitionBy()), F.sum(train).over(Window.partitionBy("is_churn"))
    return counts.select("is_churn", "split", "customers", F.round(F.try_divide(total, 2.0 * own), 6).alias("class_weight"))


def scaled_features(features: DataFrame, feature_cols=FEATURES, test_fraction: float = TEST_FRACTION) -> DataFrame:
    """customer_id, split and scaled_<feature>: each feature less its mean, by its
    population deviation, both over the training rows."""
    rows = with_split(cut_lineage(features), test_fraction)
    out = forests.scaled(rows, tuple(feature_cols), F.col("split") == "train")
    return out.select("customer_id", "split", *[f"scaled_{c}" for c in feature_cols])


def status_of(customers: Column, churned: Column) -> Column:
    """Whether a model can be fitted: 'too_few_customers', 'one_class' or 'ok'."""
    return (F.when(customers < MIN_CUSTOMERS, "too_few_customers")
            .when((churned == 0) | (churned == customers), "one_class").otherwise("ok"))


def churn_guards(features: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """scope, value, customers, churned, status: whether a model could be fitted to
    all customers (scope 'all') and to those of each value of each column of ``by``.
    One pass over ``features``; without customers there is no scope and no row."""
    sets = [[], *[[c] for c in by]]
    counts = features.groupingSets(sets, *by).agg(
        F.grouping_id().alias("_set"), F.count(F.lit(1)).alias("customers"), F.coalesce(F.sum("is_churn"), F.lit(0)).alias("churned"))
    whole = (1 << len(by)) - 1
    scope, value = F.lit("all"), F.lit(None).cast("string")
    for k, c in enumerate(by):
        own = F.col("_set") == F.lit(whole - (1 << (len(by) - 1 - k)))
        scope, value = F.when(own, c).otherwise(scope), F.when(own, F.col(c).cast("string")).otherwise(value)
    return counts.select(scope.alias("scope"), value.alias("value"), "customers", F.col("churned").cast("long").alias("churned"),
                         status_of(F.col("customers"), F.col("churned")).alias("status"))


def fit_churn_forest(features: DataFrame, feature_cols=FEATURES, seed: int = SEED, num_trees: int = NUM_TREES,
                     max_depth: int = MAX_DEPTH, test_fraction: float = TEST_FRACTION) -> "forests.Forest":
    """The forest of the training split as nodes; ValueError names the guard that forbids a fit."""
    rows = cut_lineage(with_split(cut_lineage(features), test_fraction).repartition("customer_id"))
    guard = churn_guards(rows, ()).first()
    status = guard["status"] if guard else "too_few_customers"
    if status != "ok":
        raise ValueError(status)
    return forests.fit(rows, tuple(feature_cols), "is_churn", F.col("split") == "train", num_trees, max_depth, seed)


@dataclass
class ChurnResult:
    scores: DataFrame          # features + split, churn_predicted, churn_probability
    model: PipelineModel | None
    features: tuple[str, ...]
    status: str = "ok"
    importance: tuple[float, ...] | None = None

    def feature_importance(self) -> dict[str, float | None]:
        if self.importance is not None:
            return {f: round(v, 4) for f, v in zip(self.features, self.importance)}
        if self.model is None:
            return dict.fromkeys(self.features)
        forest = self.model.stages[-1]
        return {f: round(float(v), 4) for f, v in zip(self.features, forest.featureImportances.toArray())}


def score_churn(features: DataFrame, forest: "forests.Forest", test_fraction: float = TEST_FRACTION) -> ChurnResult:
    """The scores of a fitted forest for every customer: no fit, no join; facts are read once.

    ``split`` tells how the customers would be dealt for a fit, so the report's
    accuracy is that of the 'test' rows.
    """
    rows = with_split(cut_lineage(features), test_fraction)
    return ChurnResult(forest.score(rows), None, forest.features, importance=forest.importance)


def train_churn(features: DataFrame, feature_cols=FEATURES, seed: int = SEED,
                num_trees: int = NUM_TREES, max_depth: int = MAX_DEPTH,
                test_fraction: float = TEST_FRACTION) -> ChurnResult:
    """Fit scaler + balanced forest on the train split, score every customer.

    With fewer than MIN_CUSTOMERS customers (status 'too_few_customers') or one
    class only ('one_class') nothing is fitted: the scores are the features with
    NULL split, prediction and probability.
    """
    feature_cols = tuple(feature_cols)
    # One row per customer, dealt by key into partitions sized to the data. The
    # features are stored first: the split reads them three times.
    data = cut_lineage(with_split(cut_lineage(features), test_fraction).repartition("customer_id"))
    stats = data.agg(
        F.count(F.lit(1)).alias("n"), F.sum("is_churn").alias("pos"),
        F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("n_train"),
        F.sum(F.when((F.col("split") == "train") & (F.col("is_churn") == 1), 1).otherwise(0)).alias("pos_train"),
    ).first()
    n, pos = stats["n"], stats["pos"] or 0
    status = "too_few_customers" if n < MIN_CUSTOMERS else "one_class" if pos in (0, n) else "ok"
    if status != "ok":
        blank = {"split": "string", "churn_predicted": "int", "churn_probability": "double"}
        scores = data.drop("split").select("*", *[F.lit(None).cast(t).alias(c) for c, t in blank.items()])
        return ChurnResult(scores, None, feature_cols, status)
    n_train, pos_train = stats["n_train"], stats["pos_train"] or 0
    neg_train = n_train - pos_train
    # Balanced class weights: n / (classes * n_class), from the train split.
    w_pos = n_train / (2.0 * pos_train) if pos_train else 1.0
    w_neg = n_train / (2.0 * neg_train) if neg_train else 1.0
    data = data.withColumn(
        "class_weight", F.when(F.col("is_churn") == 1, F.lit(w_pos)).otherwise(F.lit(w_neg))
    ).withColumn("label", F.col("is_churn").cast("double"))
    pipeline = Pipeline(stages=[
        VectorAssembler(inputCols=list(feature_cols), outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        # cacheNodeIds keeps each row's node per tree between passes (same
        # trees, fewer recomputations; checkpointed in the checkpoint folder).
        RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="class_weight",
                               numTrees=num_trees, maxDepth=max_depth, seed=seed, cacheNodeIds=True),
    ])
    model = pipeline.fit(data.filter(F.col("split") == "train"))
    prob = vector_to_array(F.col("probability"))
    scored = model.transform(data).select(
        *features.columns, "split",
        F.col("prediction").cast("int").alias("churn_predicted"),
        F.bround(F.when(F.size(prob) > 1, prob[1]).otherwise(prob[0]), 4).alias("churn_probability"),
    )
    return ChurnResult(scored, model, feature_cols)


def churn_report(result: ChurnResult) -> DataFrame:
    """One row: accuracy (test split), accuracy_pct, status, total_customers,
    predicted_churn, predicted_retain, churn_rate_pct, imp_<feature>...
    Model figures are rounded half to even, as Python rounds them."""
    s = result.scores
    test = F.col("split") == "test"
    agg = s.agg(
        F.sum(F.when(test & (F.col("churn_predicted") == F.col("is_churn")), 1).otherwise(0)).alias("hit"),
        F.sum(F.when(test, 1).otherwise(0)).alias("n_test"),
        F.count(F.lit(1)).cast("long").alias("total_customers"),
        F.sum("churn_predicted").cast("long").alias("predicted_churn"),
    )
    acc = F.try_divide(F.col("hit").cast("double"), F.col("n_test").cast("double"))
    imp = result.feature_importance()
    return agg.select(
        F.bround(acc, 4).alias("accuracy"),
        F.bround(acc * 100, 1).alias("accuracy_pct"),
        F.lit(result.status).alias("status"), "total_customers", "predicted_churn",
        (F.col("total_customers") - F.col("predicted_churn")).alias("predicted_retain"),
        F.bround(F.col("predicted_churn") * 100.0 / F.col("total_customers"), 1).alias("churn_rate_pct"),
        *[F.lit(v).cast("double").alias(f"imp_{k}") for k, v in imp.items()],
    )


def churn_at_risk(result: ChurnResult, n: int = 15) -> DataFrame:
    """The n predicted churners with the highest probability."""
    return (
        result.scores.filter(F.col("churn_predicted") == 1)
        .select("customer_id", "name", "email", "recency_days", "frequency", "monetary", "churn_probability")
        .orderBy(F.col("churn_probability").desc(), F.col("customer_id"))
        .limit(n)
    )


def save_churn_model(result: ChurnResult, path: str) -> None:
    """Store the fitted pipeline (scaler + forest) with Spark ML persistence."""
    result.model.write().overwrite().save(path)


def load_churn_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score_with(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Score customers with a stored model (no refit)."""
    prob = vector_to_array(F.col("probability"))
    return model.transform(features).select(
        *features.columns,
        F.col("prediction").cast("int").alias("churn_predicted"),
        F.bround(F.when(F.size(prob) > 1, prob[1]).otherwise(prob[0]), 4).alias("churn_probability"),
    )
