"""Permutation importance of features and their families, for many models at once.

A permutation of a feature is two orders of the same rows: a row's place in one, and the value of the row that has this place in
another. Both orders go by hashes of the row's key: rows go to buckets by hash, a row's place is what the buckets before
hold and its place in its own; so no window holds all rows. Places of all features meet their rows in one join, and
a task scores its rows once as they are and once for each feature with that feature's permuted value.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import trees
from tidemark.sources.shared import written

BUCKET_ROWS = 50_000


def placed(rows: DataFrame, groups: list[str], by: Column, ties: list[str], buckets: int) -> DataFrame:
    """Rows with ``place``, from 0, in their group by a hash; ties decide equal hashes."""
    rows = rows.withColumn("hash_", by).withColumn("bucket_", F.pmod(F.shiftright("hash_", 20), F.lit(buckets)))
    sums = rows.groupBy(*groups, "bucket_").count()
    before = sums.withColumn("before_", F.sum("count").over(Window.partitionBy(*groups).orderBy("bucket_")) - F.col("count")).drop("count")  # a row a bucket
    inside = Window.partitionBy(*groups, "bucket_").orderBy("hash_", *ties)
    return rows.withColumn("rn_", F.row_number().over(inside)).join(before, [*groups, "bucket_"]).withColumn("place", F.col("before_") + F.col("rn_") - 1).drop("hash_", "bucket_", "before_", "rn_")


def permuted(rows: DataFrame, keys: list[str], p: int, seed: int) -> DataFrame:
    """rows: unit, keys (unique in a unit), y, bins. Adds ``other``: for each feature the bin that its permutation within the unit brings to the row."""
    buckets = max(1, rows.count() // BUCKET_ROWS)
    own = placed(rows, ["unit"], F.xxhash64(F.lit(seed), *keys), keys, buckets)
    each = rows.select("unit", *keys, F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(p)), lambda k: F.substring("bins", k, F.lit(1)))).alias("f", "b"))
    theirs = placed(each, ["unit", "f"], F.xxhash64(F.lit(seed), "f", *keys), keys, buckets).select("unit", "place", "f", "b")
    whole = theirs.groupBy("unit", "place").agg(F.array_sort(F.collect_list(F.struct("f", "b"))).alias("l")).select("unit", "place", F.concat(*(F.col("l")[k]["b"] for k in range(p))).alias("other"))
    return own.join(whole, ["unit", "place"]).drop("place")


def importance(rows: DataFrame, models: dict[int, trees.Model], features: list[str], keys: list[str], seed: int = 11) -> DataFrame:
    """unit, feature, n, baseline, permuted, delta: mean squared error of a probability (Brier score), or mean absolute error
    of a value, as the model is, before and after the feature's permutation."""
    p = len(features)
    both = written(permuted(rows, keys, p, seed), "permuted")

    def run(batches: Iterator[pa.RecordBatch]):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            if not len(batch):
                continue
            unit, y = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            x, other = trees.matrix(batch.column(2), p), trees.matrix(batch.column(3), p)
            for u in np.unique(unit).tolist():
                if u not in models:
                    continue
                mine, model = unit == u, models[u]
                loss = (lambda q: (q - y[mine]) ** 2) if model.loss != "squared_error" else (lambda q: np.abs(q - y[mine]))  # noqa: B023
                held = sums.setdefault(u, np.zeros(p + 2))
                held[-1] += mine.sum()
                held[-2] += loss(model.predicted(x[mine])).sum()
                for f in range(p):
                    changed = x[mine].copy()
                    changed[:, f] = other[mine, f]
                    held[f] += loss(model.predicted(changed)).sum()
        for u, s in sums.items():
            yield pa.RecordBatch.from_pydict({"unit": pa.array([u] * p, pa.int32()), "f": pa.array(range(p), pa.int32()), "n": pa.array([int(s[-1])] * p, pa.int64()), "base": pa.array([s[-2]] * p), "changed": pa.array(s[:p])})

    parts = both.select(F.col("unit").cast("int"), F.col("y").cast("double"), "bins", "other").mapInArrow(run, "unit int, f int, n long, base double, changed double")
    got = parts.groupBy("unit", "f").agg(F.sum("n").alias("n"), (F.sum("base") / F.sum("n")).alias("baseline"), (F.sum("changed") / F.sum("n")).alias("permuted"))
    return got.select("unit", F.element_at(F.array(*map(F.lit, features)), F.col("f") + 1).alias("feature"), "n", "baseline", "permuted", (F.col("permuted") - F.col("baseline")).alias("delta"))


def by_family(found: DataFrame, families: dict[str, str]) -> DataFrame:
    """unit, family, features, sum_delta, positive_sum_delta, top_feature, top_delta; a feature without a family is unknown."""
    of = F.create_map(*(F.lit(x) for pair in families.items() for x in pair)) if families else F.create_map().cast("map<string,string>")
    rows = found.withColumn("family", F.coalesce(F.element_at(of, F.col("feature")), F.lit("unknown")))
    top = F.max(F.struct("delta", F.col("feature")))
    return rows.groupBy("unit", "family").agg(F.count("*").alias("features"), F.sum("delta").alias("sum_delta"), F.sum(F.greatest("delta", F.lit(0.0))).alias("positive_sum_delta"), top.alias("t")).select("unit", "family", "features", "sum_delta", "positive_sum_delta", F.col("t.feature").alias("top_feature"), F.col("t.delta").alias("top_delta"))
