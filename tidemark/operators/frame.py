"""The modeling frame: feature panel, cross-section and labels in one table, and its hygiene.

All families share one partitioning and order, so the panel costs one exchange and one sort however many
families it has; what belongs to a date (breadth, sectors) is joined to it, a small table for each date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.dialect import SPARK
from tidemark.operators import cross_section, features, labels, models
from tidemark.operators.governance import family_of
from tidemark.plans.staged import Family

BARS = ("symbol", "Date", "Open", "High", "Low", "Close", "Volume")
KEYS = ["symbol", "Date"]
#: Values beyond it count as infinite (fixed value).
LARGEST = 1e308


def panel(bars: DataFrame, families: list[Family], extra: tuple[str, ...] = ()) -> DataFrame:
    """Bars with the columns of all families. What is made so far travels in a struct, so families may use
    the same names on the way; of a name that two families keep the first counts."""
    base, names = [*BARS, *extra], []
    out = bars.select(*base, F.lit(None).cast("struct<none_:int>").alias("made_"))
    for family in families:
        fresh = [k for k in family.keep if k not in names and k not in base]
        kept = [f"'{n}', made_.{n}" for n in names] + [f"'{k}', {k}" for k in fresh]
        out = family.apply(out).selectExpr(*base, f"named_struct({', '.join(kept)}) AS made_")
        names += fresh
    return out.select(*base, *(F.col(f"made_.{n}").alias(n) for n in names))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str] = KEYS, how: str = "inner") -> DataFrame:
    """Join by keys that each side has once; a repeated key is an error."""
    for side in (left, right):
        if side.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError(f"a key of {keys} is there more than once")
    return left.join(right, keys, how)


def feature_panel(bars: DataFrame, universe: DataFrame) -> DataFrame:
    """Features of all families, strength ranks, breadth of the date and momentum of the sector."""
    spark, q = bars.sparkSession, {"bars": bars, "universe": universe}
    view = lambda v: spark.sql(v(SPARK, "SELECT * FROM {bars}", "SELECT * FROM {universe}"), **q)
    own = panel(bars, list(features.FAMILIES.values())).drop("Open", "High", "Low")
    own = own.join(view(cross_section.strength_ranks), KEYS, "left").join(view(cross_section.breadth), "Date", "left")
    roles = universe.select("symbol", "role", "sector")
    return own.join(F.broadcast(roles), "symbol", "left").join(view(cross_section.sectors), ["Date", "sector"], "left")  # the universe is one row a symbol


def label_panel(bars: DataFrame, horizons: tuple[int, ...] = labels.HORIZONS) -> DataFrame:
    """Outcomes of all horizons (bars with ``label_atr_14``): returns, excursions, flags, first touches, end dates."""
    made = [x for h in horizons for x in (renamed(labels.LABELS[h], h, "label_end_date"), renamed(labels.TOUCH[h], h))]
    return panel(bars, made, ("label_atr_14",)).drop(*BARS[2:], "label_atr_14")


def renamed(family: Family, h: int, *more: str) -> Family:
    """A family whose columns, and some others that it makes, carry the label prefix and the horizon."""
    mine = {k: k if k.endswith(f"_{h}") else f"{'' if k.startswith('label_') else 'label_'}{k}_{h}" for k in (*family.keep, *more)}
    last = {n: k for k, n in mine.items() if k != n}
    return Family(family.name, lambda d: [*family.stages(d), *([last] if last else [])], tuple(mine.values()))


def modeling_frame(features_: DataFrame, labels_: DataFrame) -> DataFrame:
    """Features with their outcomes, one row for each key of both; no feature looks ahead."""
    models.reject_leakage([c for c in features_.columns if c not in KEYS])
    return one_to_one(features_, labels_)


def numeric_features(frame: DataFrame) -> list[str]:
    """Numeric columns that may be features."""
    return [c for c, t in frame.dtypes if t in ("double", "float", "int", "bigint") and not c.startswith("label_") and not any(w in c for w in models.FORBIDDEN)]


def sanitized(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Infinite and huge values become null; missing ones stay missing."""
    ok = lambda c: F.when(F.isnan(c) | (F.abs(c) > LARGEST), None).otherwise(F.col(c)).alias(c)
    return frame.select(*(ok(c) if c in columns else F.col(c) for c in frame.columns))


def hygiene_audit(frame: DataFrame, columns: list[str]) -> DataFrame:
    """Per column, family and symbol: values, missing ones, and those that ``sanitized`` replaces."""
    long = frame.select("symbol", "Date", F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.lit(family_of(c)).alias("family"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("symbol", "Date", "x.*")
    bad = F.isnan("v") | (F.abs("v") > LARGEST)
    return long.groupBy("feature", "family", "symbol").agg(F.count("*").alias("n"), F.count_if(F.col("v").isNull()).alias("missing"), F.count_if(bad).alias("replaced"), F.min(F.when(bad, F.col("Date"))).alias("first_replaced"))


def audits_merged(*audits: DataFrame) -> DataFrame:
    """Several audits as one: counts add up, the earliest date stays."""
    out = audits[0]
    for more in audits[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out.groupBy("feature", "family", "symbol").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("replaced").alias("replaced"), F.min("first_replaced").alias("first_replaced"))


def rejected_nonfinite(frame: DataFrame, columns: list[str]) -> DataFrame:
    """The frame; an error if a value of these columns is still not finite."""
    counts = frame.agg(*(F.count_if(F.isnan(c) | (F.abs(c) > LARGEST)).alias(c) for c in columns)).first().asDict()
    if left := {c: n for c, n in counts.items() if n}:
        raise ValueError(f"values that are not finite: {left}")
    return frame


def with_time_exits(frame: DataFrame, outcomes: DataFrame) -> DataFrame:
    """The frame with policy outcomes beside it, a column for each policy's returns, targets and utility."""
    utility = labels.time_exit_utility(outcomes).select(*KEYS, "target_multiple", "stop_multiple", "net_return", "utility")
    both = outcomes.select(*KEYS, "target_multiple", "stop_multiple", "target_before_stop", "unresolved").join(utility, [*KEYS, "target_multiple", "stop_multiple"], "left")
    name = lambda c, t, s: f"label_{c}_t{t:g}_s{s:g}".replace(".", "p")
    pick = lambda c, t, s: F.max(F.when((F.col("target_multiple") == t) & (F.col("stop_multiple") == s), F.col(c))).alias(name(c, t, s))
    wide = both.groupBy(*KEYS).agg(*(pick(c, t, s) for t, s in labels.POLICIES for c in ("target_before_stop", "unresolved", "net_return", "utility")))
    return one_to_one(frame, wide, how="left")


def discovered(frame: DataFrame, scopes: dict[str, tuple[str, ...]], horizons: tuple[int, ...], columns: list[str], split: str, families: tuple[str, ...] = ("base_rate", "logistic")) -> DataFrame:
    """The discovery loop: for each scope (name, roles), horizon and direction the families are fitted on rows whose
    outcome was known before ``split`` and measured on later ones: rows, Brier score, base rate's score, skill.

    The loop runs over a few model keys; each turn is Spark jobs over all rows of its scope."""
    out = None
    cut = F.to_date(F.lit(split))
    for scope, roles in scopes.items():
        rows = frame if scope == "POOLED" else frame.filter(F.col("role").isin(*roles))
        for h in horizons:
            for side in ("bull", "bear"):
                known = rows.filter(F.col(f"label_end_date_{h}").isNotNull()).withColumn("y", F.col(f"label_{side}_positive_return_{h}"))
                train, test = known.filter(F.col(f"label_end_date_{h}") < cut), known.filter(F.col("Date") >= cut)
                if train.limit(1).count() == 0 or test.limit(1).count() == 0:
                    continue
                for family in families:
                    scored = models.fit_predict(train, test, columns, family)
                    row = scored.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("probability_up") - F.col("y"), 2)).alias("brier"), (F.avg(F.col("y") * F.col("y")) - F.avg("y") * F.avg("y")).alias("naive"), F.avg("y").alias("rate"))
                    row = row.select(F.lit(scope).alias("scope"), F.lit(h).alias("horizon"), F.lit(side).alias("direction"), F.lit(family).alias("family"), "n", "brier", "naive", "rate", (1 - F.try_divide("brier", "naive")).alias("skill"))
                    out = row if out is None else out.unionByName(row)
    return out
