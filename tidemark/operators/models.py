"""Models, screening, calibration and the market regime, on MLlib and grouped functions.

MLlib has no extremely randomised trees and no histogram boosting: random forests and GBTs stand in
for them, so scores differ from those families', while metrics and gates work on any scores.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, IsotonicRegression, LinearRegression, RandomForestRegressor
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
# Parts of names of columns that look ahead.
FORBIDDEN = ("time_exit", "utility", "profitable_despite_failed_tbs", "early_adverse_recovery")


def reject_leakage(columns: list[str]) -> list[str]:
    """The columns, if none of them looks ahead."""
    bad = [c for c in columns if c.startswith("label_") or any(w in c for w in FORBIDDEN)]
    if bad:
        raise ValueError(f"columns that look ahead cannot be features: {bad}")
    return columns


def classifier(family: str):
    return {
        "logistic": lambda: LogisticRegression(labelCol="y", maxIter=50, regParam=0.01),
        "boosting": lambda: GBTClassifier(labelCol="y", maxIter=20, maxDepth=3, seed=SEED),
        "forest": lambda: RandomForestClassifier(labelCol="y", numTrees=50, maxDepth=6, seed=SEED),
    }[family]()


def regressor(family: str, label: str = "r"):
    return {
        "ridge": lambda: LinearRegression(labelCol=label, elasticNetParam=0.0, regParam=1.0),
        "boosting": lambda: GBTRegressor(labelCol=label, maxIter=20, maxDepth=3, seed=SEED),
        "forest": lambda: RandomForestRegressor(labelCol=label, numTrees=50, maxDepth=6, seed=SEED),
        "tweedie": lambda: GeneralizedLinearRegression(labelCol=label, family="tweedie", variancePower=1.5, linkPower=0.0, maxIter=25, regParam=0.1),
    }[family]()


def pipeline(features: list[str], last) -> Pipeline:
    """Median imputation, scaling, then the estimator."""
    filled = [f"{c}_filled" for c in reject_leakage(features)]
    return Pipeline(stages=[Imputer(strategy="median", inputCols=features, outputCols=filled), VectorAssembler(inputCols=filled, outputCol="assembled"), StandardScaler(inputCol="assembled", outputCol="features", withMean=True), last])


def base_rate(train: DataFrame) -> float:
    return train.agg(F.avg("y")).first()[0]


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], family: str = "logistic") -> DataFrame:
    """test with a column ``probability_up``."""
    if family == "base_rate":
        return test.withColumn("probability_up", F.lit(base_rate(train)))
    model = pipeline(features, classifier(family)).fit(train)
    return model.transform(test).withColumn("probability_up", vector_to_array("probability")[1]).select(*test.columns, "probability_up")


def fit_regression(train: DataFrame, test: DataFrame, features: list[str], family: str = "ridge", label: str = "r") -> DataFrame:
    model = pipeline(features, regressor(family, label)).fit(train)
    return model.transform(test).select(*test.columns, "prediction")


def calibrated(fit: DataFrame, apply: DataFrame, method: str) -> DataFrame:
    """apply with ``calibrated``: identity (clipped), sigmoid (logistic on the logit) or isotonic."""
    clip = F.least(F.greatest(F.col("p"), F.lit(1e-6)), F.lit(1 - 1e-6))
    if method == "identity":
        return apply.withColumn("calibrated", clip)
    if method == "sigmoid":
        logit = F.ln(clip / (1 - clip))
        make = VectorAssembler(inputCols=["logit"], outputCol="features")
        model = LogisticRegression(labelCol="y", maxIter=50).fit(make.transform(fit.withColumn("logit", logit)))
        return model.transform(make.transform(apply.withColumn("logit", logit))).withColumn("calibrated", vector_to_array("probability")[1]).select(*apply.columns, "calibrated")
    model = IsotonicRegression(labelCol="y", featuresCol="p").fit(fit.select("p", "y"))
    return model.transform(apply).withColumnRenamed("prediction", "calibrated").select(*apply.columns, "calibrated")


def calibration_slope(rows: DataFrame, p: str = "p", least: float = 1e-6) -> DataFrame:
    """Intercept and slope of the outcome's log odds in the prediction's, for each scope (a few) and POOLED: 0 and 1
    if predictions are calibrated. Scopes with one outcome alone have none."""
    logit = F.log(F.greatest(F.least(F.col(p), F.lit(1 - least)), F.lit(least)) / (1 - F.greatest(F.least(F.col(p), F.lit(1 - least)), F.lit(least))))
    data = VectorAssembler(inputCols=["logit"], outputCol="features").transform(rows.select("scope", "y", logit.alias("logit"))).persist()
    counts = {r.scope: (r.n, r.both) for r in data.groupBy("scope").agg(F.count("*").alias("n"), (F.count_distinct("y") > 1).alias("both")).collect()}
    out = []
    for scope in [*sorted(counts), "POOLED"]:
        n, both = counts.get(scope, (sum(k for k, _ in counts.values()), any(b for _, b in counts.values())))
        fit = LogisticRegression(labelCol="y", maxIter=100, regParam=0.0).fit(data if scope == "POOLED" else data.filter(F.col("scope") == scope)) if both else None
        out.append((scope, n, float(fit.intercept) if fit else None, float(fit.coefficients[0]) if fit else None))
    data.unpersist()
    return rows.sparkSession.createDataFrame(out, "scope string, n long, intercept double, slope double")


def choose_calibrator(scores: DataFrame) -> DataFrame:
    """Of (method, complexity, mean, se) the simplest whose mean is within one standard error of the best."""
    best = scores.orderBy("mean", "complexity").limit(1).select((F.col("mean") + F.col("se")).alias("bound"))
    return scores.crossJoin(F.broadcast(best)).filter("mean <= bound").orderBy("complexity", "mean").limit(1).drop("bound")


def _above(c: str, edges: list[float]):
    return F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: F.col(c) > e))


def screen(df: DataFrame, features: list[str], target: str = "y", missing: float = 0.40, variance: float = 1e-12, bins: int = 10) -> DataFrame:
    """feature, missing_rate, variance, mutual_information (binned), reason ('' if it passes)."""
    stats = df.select(*[F.avg(F.col(c).isNull().cast("double")).alias(f"m_{c}") for c in features], *[F.var_pop(c).alias(f"v_{c}") for c in features], *[F.percentile_approx(c, [k / bins for k in range(1, bins)], 10_000).alias(f"q_{c}") for c in features]).first()
    long = df.select(F.col(target).cast("int").alias("t"), F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), _above(c, stats[f"q_{c}"] or [0.0]).alias("b")) for c in features])).alias("x")).select("t", "x.feature", "x.b")
    n = df.count()
    cell = long.groupBy("feature", "b", "t").count()
    row, col = long.groupBy("feature", "b").agg(F.count("*").alias("nb")), long.groupBy("feature", "t").agg(F.count("*").alias("nt"))
    mi = cell.join(row, ["feature", "b"]).join(col, ["feature", "t"]).groupBy("feature").agg(F.sum(F.col("count") / n * F.ln(F.col("count") * n / (F.col("nb") * F.col("nt")))).alias("mutual_information"))
    known = df.sparkSession.createDataFrame([(c, float(stats[f"m_{c}"]), float(stats[f"v_{c}"] or 0.0)) for c in features], "feature string, missing_rate double, variance double")
    reason = F.when(F.col("missing_rate") > missing, "missingness").when(F.col("variance") <= variance, "variance").otherwise("")
    return known.join(mi, "feature", "left").withColumn("reason", reason)


def prune_correlated(df: DataFrame, features: list[str], most: float = 0.97) -> list[str]:
    """Features in order, each kept unless it correlates too much with one kept before."""
    filled = df.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in features])
    matrix = Correlation.corr(VectorAssembler(inputCols=features, outputCol="v").transform(filled), "v").first()[0].toArray()
    kept: list[int] = []
    for k in range(len(features)):
        if all(not abs(matrix[k, j]) > most for j in kept):
            kept.append(k)
    return [features[k] for k in kept]


def ablation(model, df: DataFrame, features: list[str], families: dict[str, list[str]]) -> DataFrame:
    """Mean change of the probability when a family's features are replaced by their medians."""
    medians = df.select(*[F.percentile_approx(c, 0.5).alias(c) for c in features]).first()
    score = lambda d: model.transform(d).select("symbol", "Date", vector_to_array("probability")[1].alias("p"))
    base, out = score(df), None
    for name, members in families.items():
        part = score(df.withColumns({c: F.lit(medians[c]) for c in members})).withColumnRenamed("p", "q").join(base, ["symbol", "Date"]).agg(F.avg(F.abs(F.col("p") - F.col("q"))).alias("mean_change")).withColumn("family", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def kmeans_label(x: np.ndarray, k: int = 3, rounds: int = 50) -> int:
    """Cluster of the last row: Lloyd's steps from fixed starts (quantiles along the first principal axis);
    clusters are numbered by their centres, so labels do not depend on chance."""
    x = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    if len(np.unique(x, axis=0)) < k:
        return 0
    mean = x.mean(axis=0)
    axis = np.linalg.svd(x - mean, full_matrices=False)[2][0]
    axis = axis * np.sign(axis[np.argmax(np.abs(axis))])
    order = np.argsort((x - mean) @ axis, kind="stable")
    centre = x[order[[int((j + 0.5) * len(x) / k) for j in range(k)]]]
    for _ in range(rounds):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        new = np.array([x[near == j].mean(axis=0) if (near == j).any() else centre[j] for j in range(k)])
        if np.allclose(new, centre, atol=1e-12):
            break
        centre = new
    rank = np.argsort(np.lexsort(centre.T[::-1]))
    return int(rank[near[-1]])


def expanding_regimes(market: DataFrame, columns: list[str], least: int = 126, block: int = 64) -> DataFrame:
    """(Date, cluster): each date clustered with all dates before it.

    The market table has one row a date; it is sent to every task, and dates are dealt in blocks, so
    the refits of all prefixes run in parallel."""
    spark = market.sparkSession
    table = market.select("Date", *columns).orderBy("Date").toPandas()  # one row a session: bounded by the calendar
    dates, x = table["Date"].tolist(), table[columns].to_numpy(dtype=float)
    sent = spark.sparkContext.broadcast(x)

    def run(batches):
        for pdf in batches:
            labels = [kmeans_label(sent.value[: k + 1]) if k + 1 >= least else None for k in pdf["k"]]
            yield pd.DataFrame({"Date": [dates[k] for k in pdf["k"]], "cluster": pd.array(labels, dtype="Int64")})

    return spark.range(len(dates)).select(F.col("id").cast("int").alias("k")).repartition(max(1, len(dates) // block)).mapInPandas(run, "Date date, cluster long")
