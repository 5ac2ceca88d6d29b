"""Feature screen: missingness, variance, mutual information by nearest neighbours, a cap, and greedy pruning of correlated ones.

The estimator is Ross's for a class and a number: a row's radius is the distance to its third neighbour of its own class,
and what counts is how many rows of any class lie strictly within it. In one dimension neighbours are next to each other
in order, and counts are differences of ranks. So all features go through together: rows become (feature, class, value)
with multiplicities (a value that many rows share is one), values go to buckets between sampled quantiles, and windows run
in buckets. What a bucket's first and last three values need from beyond comes from a small table of every bucket's
edges; ranks are places within a bucket plus what the buckets before hold. Nothing is ordered whole.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.sources.shared import written

NEIGHBOURS = 3
#: Rows of a feature in a bucket, on average; and how finely quantiles are sampled.
BUCKET_ROWS, ACCURACY = 50_000, 10_000


def digamma(x: Column) -> Column:
    """For x of 1 or more: the asymptotic series eight places on, and the recurrence back."""
    y = x + 8.0
    series = F.ln(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - 1 / (132 * y**10)
    for k in range(8):
        series -= 1 / (x + float(k))
    return series


def psi(n: int) -> float:
    """The same of a whole number, on the driver."""
    y = n + 8.0
    return math.log(y) - 1 / (2 * y) - 1 / (12 * y**2) + 1 / (120 * y**4) - 1 / (252 * y**6) + 1 / (240 * y**8) - 1 / (132 * y**10) - sum(1 / (n + k) for k in range(8))


def filled(rows: DataFrame, features: list[str]) -> DataFrame:
    """Features as doubles; missing and infinite values become the feature's median (a value of it), else 0."""
    known = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double"))
    medians = rows.agg(*(F.percentile_approx(known(c), 0.5, ACCURACY).alias(f"m{k}") for k, c in enumerate(features))).first()
    return rows.select(*(c for c in rows.columns if c not in features), *(F.coalesce(known(c), F.lit(medians[f"m{k}"] if medians[f"m{k}"] is not None else 0.0)).alias(c) for k, c in enumerate(features)))


def bucket(cuts: str, value: str) -> Column:
    return F.size(F.filter(cuts, lambda c: c < F.col(value)))


def neighbours(values: DataFrame) -> DataFrame:
    """values: f, c, bucket, v, w, a row a value of a class. Adds before and after: up to three next values on each side with their multiplicities."""
    inside = Window.partitionBy("f", "c", "bucket").orderBy("v")
    pair, n = F.struct("v", "w"), NEIGHBOURS
    one = values.withColumn("before", F.collect_list(pair).over(inside.rowsBetween(-n, -1))).withColumn("after", F.collect_list(pair).over(inside.rowsBetween(1, n)))
    one = one.withColumn("rn", F.row_number().over(inside)).withColumn("cnt", F.count("*").over(Window.partitionBy("f", "c", "bucket")))
    edge = (F.col("rn") <= n) | (F.col("rn") > F.col("cnt") - n)
    across = Window.partitionBy("f", "c").orderBy("v")  # over buckets' edges alone: six rows a bucket
    ends = one.filter(edge).withColumn("b2", F.collect_list(pair).over(across.rowsBetween(-n, -1))).withColumn("a2", F.collect_list(pair).over(across.rowsBetween(1, n)))
    ends = ends.withColumn("before", F.when(F.col("rn") <= n, F.col("b2")).otherwise(F.col("before"))).withColumn("after", F.when(F.col("rn") > F.col("cnt") - n, F.col("a2")).otherwise(F.col("after")))
    return one.filter(~edge).drop("rn", "cnt").unionByName(ends.drop("rn", "cnt", "b2", "a2"))


def mutual_information(rows: DataFrame, features: list[str], target: str, k: int = NEIGHBOURS) -> DataFrame:
    """feature, mutual_information (in nats, at least 0) of each feature with a class. Rows have no missing values (``filled``); those of classes with one row are left out."""
    classes = {r[0]: r[1] for r in rows.filter(F.col(target).isNotNull()).groupBy(F.col(target).cast("int")).count().collect()}  # a row a class
    classes = {c: n for c, n in classes.items() if n > 1}
    n = sum(classes.values())
    spark = rows.sparkSession
    if len(classes) < 2:
        return spark.createDataFrame([(f, None) for f in features], "feature string, mutual_information double")
    rows = rows.filter(F.col(target).cast("int").isin(*classes))
    steps = max(1, n // BUCKET_ROWS)
    probs = [j / steps for j in range(1, steps)]
    long = rows.select(F.col(target).cast("int").alias("c"), F.explode(F.array(*(F.struct(F.lit(j).alias("f"), (F.col(f) + 0.0).alias("v")) for j, f in enumerate(features)))).alias("x")).select("c", "x.f", "x.v")
    values = written(long.groupBy("f", "c", "v").agg(F.count("*").alias("w")), "screen-values")
    # at most 1024 cut points a feature: one list a feature
    cuts = values.groupBy("f").agg((F.percentile_approx("v", probs[:: max(1, len(probs) // 1024)], ACCURACY) if probs else F.array().cast("array<double>")).alias("cuts"))
    cuts = F.broadcast(written(cuts, "screen-cuts"))
    placed = values.join(cuts, "f").withColumn("bucket", bucket("cuts", "v")).drop("cuts")
    near = neighbours(placed)
    kth = F.element_at(F.create_map(*(F.lit(x) for c, m in classes.items() for x in (int(c), min(k, m - 1)))), F.col("c"))
    near = near.withColumn("k", kth).withColumn("around", F.array_sort(F.concat(F.transform("before", lambda e: F.struct((F.col("v") - e["v"]).alias("d"), e["w"].alias("w"))), F.transform("after", lambda e: F.struct((e["v"] - F.col("v")).alias("d"), e["w"].alias("w"))))))
    start = F.struct((F.col("k") - (F.col("w") - 1)).cast("long").alias("need"), F.lit(0.0).alias("d"))
    reach = F.aggregate("around", start, lambda a, e: F.when(a["need"] <= 0, a).otherwise(F.struct((a["need"] - e["w"]).alias("need"), e["d"].alias("d"))))
    near = near.withColumn("d", reach["d"])
    # the neighbour's own value bounds the open interval, where there is one at that distance
    low = F.coalesce(F.array_max(F.transform(F.filter("before", lambda e: F.col("v") - e["v"] == F.col("d")), lambda e: e["v"])), F.col("v") - F.col("d"))
    high = F.coalesce(F.array_min(F.transform(F.filter("after", lambda e: e["v"] - F.col("v") == F.col("d")), lambda e: e["v"])), F.col("v") + F.col("d"))
    tie = F.col("d") == 0
    query = lambda t, upto, sign: F.struct(t.alias("t"), upto.alias("kind"), F.lit(sign).alias("sign"))
    asked = near.select("f", "c", "v", "w", F.explode(F.array(query(F.when(tie, F.col("v")).otherwise(high), F.when(tie, 2).otherwise(0), 1), query(F.when(tie, F.col("v")).otherwise(low), F.when(tie, 0).otherwise(2), -1))).alias("q")).select("f", "c", "v", "w", "q.*")
    data = values.groupBy("f", "v").agg(F.sum("w").alias("held")).select("f", F.lit(None).cast("int").alias("c"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("long").alias("w"), F.col("v").alias("t"), F.lit(1).alias("kind"), F.lit(0).alias("sign"), "held")
    points = asked.withColumn("held", F.lit(0).cast("long")).unionByName(data).join(cuts, "f").withColumn("bucket", bucket("cuts", "t")).drop("cuts")
    points = written(points, "screen-points")
    sums = points.groupBy("f", "bucket").agg(F.sum("held").alias("s"))
    before = sums.withColumn("before", F.sum("s").over(Window.partitionBy("f").orderBy("bucket")) - F.col("s")).drop("s")  # a row a bucket
    place = Window.partitionBy("f", "bucket").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    ranks = points.withColumn("inside", F.sum("held").over(place)).filter("sign <> 0").join(F.broadcast(before), ["f", "bucket"])
    counts = ranks.groupBy("f", "c", "v", "w").agg(F.sum(F.col("sign") * (F.col("before") + F.col("inside"))).alias("m"))
    mean = counts.groupBy("f").agg((F.sum(F.col("w") * digamma(F.col("m").cast("double"))) / n).alias("psi_m"))
    fixed = psi(n) + sum(m * (psi(min(k, m - 1)) - psi(m)) for m in classes.values()) / n
    names = F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1)
    return mean.select(names.alias("feature"), F.greatest(F.lit(0.0), F.lit(fixed) - F.col("psi_m")).alias("mutual_information"))


def screened(rows: DataFrame, features: list[str], target: str, *, missing: float = 0.40, variance: float = 1e-12, most: int = 80, correlation: float = 0.97) -> DataFrame:
    """A record a feature: missingness, variance, mutual_information, rank, status and reason, correlated_with, absolute_correlation.

    Features come in order of their score; each is selected unless it correlates with a selected one, until there are ``most``. Thresholds are the caller's."""
    spark = rows.sparkSession
    known = lambda c: F.when(F.isnan(F.col(c).cast("double")) | (F.abs(F.col(c).cast("double")) == float("inf")), None).otherwise(F.col(c).cast("double"))
    stats = rows.agg(F.count("*").alias("n"), *(F.count(known(c)).alias(f"n{k}") for k, c in enumerate(features)), *(F.var_pop(known(c)).alias(f"v{k}") for k, c in enumerate(features))).first()
    records = {c: {"feature": c, "missingness": 1 - stats[f"n{k}"] / stats["n"] if stats["n"] else 1.0, "variance": stats[f"v{k}"], "status": "rejected", "reason": ""} for k, c in enumerate(features)}
    for r in records.values():
        if r["missingness"] > missing:
            r["reason"] = "missingness"
        elif r["variance"] is None or r["variance"] <= variance:
            r["reason"] = "variance"
    left = [c for c in features if not records[c]["reason"]]
    if left:
        whole = filled(rows.select(F.col(target).alias("target_"), *left), left)
        for r in mutual_information(whole, left, "target_").collect():
            records[r.feature]["mutual_information"] = r.mutual_information
        table = Correlation.corr(VectorAssembler(inputCols=left, outputCol="v_").transform(whole).select("v_"), "v_").first()[0].toArray()  # a matrix of the features
        near = lambda a, b: abs(float(table[a, b])) if table[a, b] == table[a, b] else 0.0
        order = sorted((c for c in left if records[c].get("mutual_information") is not None), key=lambda c: (-records[c]["mutual_information"], c))
        chosen: list[str] = []
        for rank, c in enumerate(order, 1):
            r = records[c]
            r["rank"] = rank
            if len(chosen) >= most:
                r["reason"] = "max_selected_features_reached"
                continue
            if chosen:
                r["absolute_correlation"], r["correlated_with"] = max(((near(left.index(c), left.index(o)), o) for o in chosen), key=lambda x: x[0])
                if r["absolute_correlation"] >= correlation:
                    r["reason"] = "correlated_with_higher_ranked_feature"
                    continue
            r["status"] = "selected"
            chosen.append(c)
        for c in left:
            if records[c].get("mutual_information") is None:
                records[c]["reason"] = "mutual_information_score_unavailable"
    names = ["feature", "missingness", "variance", "mutual_information", "rank", "status", "reason", "correlated_with", "absolute_correlation"]
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in records.values()], "feature string, missingness double, variance double, mutual_information double, rank int, status string, reason string, correlated_with string, absolute_correlation double")
