"""A prospective holdout: only sessions whose data came after the run was created count.

A run fixes its creation time, a baseline session, the enrolled models and a sample policy. Each session after the
baseline is available if every bar of it was received after the creation; a session that was there before, or whose
receipt is unknown, is blocked and says so in the log. Scanner rows of available sessions go through the forward log
(``forward.log``), as events of their own prefix. From that log come each model's sample state, its gates, and the evaluation.

Sessions are one aggregation by date; the states one aggregation by model over positions. Nothing is ordered over all rows.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import forward

# Names and reasons as the log spells them.
PREFIX = "FINAL_HOLDOUT_"
INVALIDATED = "FINAL_HOLDOUT_DATA_INVALIDATED"
INCOMPLETE = "FINAL_HOLDOUT_BACKFILL_BLOCKED: incomplete ingestion provenance"
EARLIER = "FINAL_HOLDOUT_BACKFILL_BLOCKED: session was locally available before run creation"


@dataclass(frozen=True)
class Policy:
    """Least sample sizes (fixed values of the default policy)."""

    matured_outcomes: int = 100
    distinct_signal_dates: int = 60
    observation_sessions: int = 126
    calendar_months: int = 4
    positive_outcomes: int = 20
    negative_outcomes: int = 20
    early_matured_outcomes: int = 30
    early_distinct_signal_dates: int = 20


@dataclass(frozen=True)
class Run:
    run_id: str
    created_at: dt.datetime
    baseline: dt.date
    policy: Policy = field(default_factory=Policy)
    research_only: bool = False


#: The shortfalls, as the remaining requirement names them.
SHORT = {"matured": "matured_outcomes", "signal_dates": "distinct_signal_dates", "observation_sessions": "observation_sessions", "calendar_months": "calendar_months", "positive": "positive_outcomes", "negative": "negative_outcomes"}


def sessions(received: DataFrame, run: Run) -> DataFrame:
    """Date, available, reason of each session after the baseline. received: symbol, Date, available_at of every bar."""
    at = F.col("available_at").cast("timestamp")
    got = received.filter(F.col("Date") > F.lit(run.baseline)).groupBy("Date").agg(F.count("*").alias("n_rows"), F.count(F.when(at.isNull(), 1)).alias("unknown"), F.min(at).alias("first_at"))
    reason = F.when(F.col("unknown") > 0, INCOMPLETE).when(F.col("first_at") <= F.lit(run.created_at).cast("timestamp"), EARLIER).otherwise("ok")
    return got.select("Date", "n_rows", (reason == "ok").alias("available"), reason.alias("reason"))


def log(bars: DataFrame, scans: DataFrame, received: DataFrame, run: Run) -> DataFrame:
    """The run's events: blocked sessions, and the forward log of scanner rows of available sessions, up to the last available one."""
    found = sessions(received, run)
    last = F.broadcast(found.filter("available").agg(F.max("Date").alias("last")))  # one row
    open_ = found.filter("available").select(F.col("Date").alias("as_of"))
    events = forward.log(bars.join(last, F.col("Date") <= F.col("last")).drop("last"), scans.join(open_, "as_of", "left_semi"), prefix=PREFIX)
    blocked = found.filter("NOT available").select(F.lit("RUN").alias("symbol"), F.lit("n/a").alias("direction"), F.lit("run").alias("model_id"), F.lit(None).cast("string").alias("snapshot"), F.col("Date").alias("as_of"), F.concat(F.lit(run.run_id + "|"), F.col("Date").cast("string")).alias("suffix"), "reason", F.lit(INVALIDATED).alias("kind"))
    blocked = forward.keyed(blocked, "")
    return blocked.unionByName(events)


def states(events: DataFrame, received: DataFrame, run: Run) -> DataFrame:
    """Each enrolled model's sample state. The run's own counts (one row) join every model."""
    p = run.policy
    found = sessions(received, run)
    whole = F.broadcast(found.agg(F.count(F.when(F.col("available"), 1)).alias("observation_sessions"), F.count(F.when(~F.col("available"), 1)).alias("blocked_backfills")))
    positions = forward.positions(events.filter("model_id <> 'run'"), PREFIX)
    out = F.col("status") == "EXIT_FILLED"
    models = events.filter("model_id <> 'run'").select("model_id").distinct()
    got = positions.groupBy("model_id").agg(
        F.count(F.when(out, 1)).alias("matured_outcomes"), F.countDistinct(F.when(out, F.col("signal_date"))).alias("distinct_signal_dates"), F.countDistinct(F.when(out, F.date_format("exit_date", "yyyy-MM"))).alias("calendar_months"),
        F.count(F.when(out & (F.col("exit_reason") == "target"), 1)).alias("positive_outcomes"), F.count(F.when(out & (F.col("exit_reason") != "target"), 1)).alias("negative_outcomes"),
        F.count(F.when(F.col("status") == "ENTRY_PENDING", 1)).alias("pending_entries"), F.count(F.when(F.col("status") == "ENTRY_FILLED", 1)).alias("open_positions"), F.avg(F.when(out, F.col("net_return"))).alias("mean_net_return"),
    )
    got = models.join(got, "model_id", "left").fillna(0, ["matured_outcomes", "distinct_signal_dates", "calendar_months", "positive_outcomes", "negative_outcomes", "pending_entries", "open_positions"]).crossJoin(whole)  # one row on that side
    enough = F.col("blocked_backfills") == 0
    for name in SHORT.values():
        enough &= F.col(name) >= getattr(p, name)
    early = (F.col("matured_outcomes") >= p.early_matured_outcomes) & (F.col("distinct_signal_dates") >= p.early_distinct_signal_dates)
    short = [F.when(F.col(c) < getattr(p, c), F.concat(F.lit(f"{n}:"), (getattr(p, c) - F.col(c)).cast("string"))) for n, c in sorted(SHORT.items())]
    rest = F.concat_ws("; ", *short)
    return got.select(
        F.lit(run.run_id).alias("run_id"), "*", F.col("blocked_backfills").alias("invalidated_outcomes"), enough.alias("sample_sufficient"), early.alias("early_diagnostic_available"),
        F.when(enough, "READY_FOR_EVALUATION").when(early, "EARLY_DIAGNOSTIC_AVAILABLE").otherwise("COLLECTING").alias("status"), F.when(rest == "", "ready").otherwise(rest).alias("remaining"),
    )


def gates(found: DataFrame, run: Run) -> DataFrame:
    """A row a model and gate: metric, threshold, actual, PASS or FAIL."""
    p = asdict(run.policy)
    least = {c: p[c] for c in SHORT.values()}
    rows: list[Column] = []

    def gate(gate_id: str, metric: str, comparator: str, threshold: int, actual: Column, ok: Column) -> None:
        rows.append(F.struct(F.lit(gate_id).alias("gate_id"), F.lit(metric).alias("metric"), F.lit(comparator).alias("comparator"), F.lit(threshold).cast("long").alias("threshold"), actual.cast("long").alias("actual"), F.when(ok, "PASS").otherwise("FAIL").alias("status")))

    # The gates' names carry the default policy's numbers, whatever policy the run has.
    names = {"matured_outcomes": "final_holdout_matured_outcomes_min_100", "distinct_signal_dates": "final_holdout_distinct_signal_dates_min_60", "observation_sessions": "final_holdout_observation_sessions_min_126", "calendar_months": "final_holdout_calendar_months_min_4", "positive_outcomes": "final_holdout_positive_class_min_20", "negative_outcomes": "final_holdout_negative_class_min_20"}
    for metric, gate_id in names.items():
        gate(gate_id, metric, ">=", least[metric], F.col(metric), F.col(metric) >= least[metric])
    gate("final_holdout_backfill_absent", "blocked_backfills", "==", 0, F.col("blocked_backfills"), F.col("blocked_backfills") == 0)
    gate("final_holdout_data_integrity_valid", "invalidated_outcomes", "==", 0, F.col("invalidated_outcomes"), F.col("invalidated_outcomes") == 0)
    gate("final_holdout_sample_sufficient", "sample_sufficient", "is true", 1, F.col("sample_sufficient").cast("int"), F.col("sample_sufficient"))
    return found.select("run_id", "model_id", F.explode(F.array(*rows)).alias("g")).select("run_id", "model_id", "g.*")


def evaluated(found: DataFrame, run: Run, diagnostic_only: bool = False) -> DataFrame:
    """Each model's evaluation. A complete one needs every model's sample to suffice; a diagnostic one some early evidence, and
    never lets a model be promoted. Where what it needs is missing, status says so and nothing is evaluated."""
    most = found.agg(F.min("sample_sufficient").alias("all_enough"), F.max(F.col("early_diagnostic_available") | F.col("sample_sufficient")).alias("some_early"))
    rows = found.crossJoin(F.broadcast(most))  # one row on that side
    able = F.col("some_early") if diagnostic_only else F.col("all_enough")
    promotable = F.lit(not diagnostic_only and not run.research_only) & F.col("sample_sufficient")
    status = F.when(~able, "EVALUATION_BLOCKED").when(F.lit(diagnostic_only), F.col("status")).when(F.lit(not run.research_only), "EVALUATED_PASS").otherwise("EVALUATED_FAIL")
    return rows.select("run_id", "model_id", "matured_outcomes", F.when(able, F.col("mean_net_return")).alias("mean_net_return"), F.when(able, promotable).otherwise(False).alias("promotable"), status.alias("status"))
