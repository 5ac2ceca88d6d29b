"""Table writer, slippage, caps and labels."""

import pytest

from tidemark.operators import backtest, discovery
from tidemark.sources import bars as source


class Failing:
    """A file system whose n-th rename says no."""

    def __init__(self, fs, nth):
        self.fs, self.nth, self.calls = fs, nth, 0

    def rename(self, a, b):
        self.calls += 1
        return False if self.calls in self.nth else self.fs.rename(a, b)

    def __getattr__(self, name):
        return getattr(self.fs, name)


@pytest.mark.parametrize("nth", [(1,), (2,), (2, 3)])
def test_a_failing_step_keeps_the_old_table(spark, tmp_path, monkeypatch, nth):
    path = str(tmp_path / "t")
    source.save(spark.range(3), path)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    real = hadoop(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    failing = Failing(real, nth)

    class Path:
        def __init__(self, p):
            self.p = hadoop(p)

        def getFileSystem(self, conf):
            return self

        def toString(self):
            return self.p.toString()

        def exists(self, a):
            return real.exists(a.p)

        def rename(self, a, b):
            return failing.rename(a.p, b.p)

        def delete(self, a, deep):
            return real.delete(a.p, deep)

    class Spark:
        class sparkContext:
            class _jvm:
                class org:
                    class apache:
                        class hadoop:
                            class fs:
                                pass

            _jsc = spark.sparkContext._jsc

    Spark.sparkContext._jvm.org.apache.hadoop.fs.Path = Path
    with pytest.raises(OSError):
        source.replaced(Spark, path, spark.range(7).write.parquet)
    if nth == (2, 3):  # neither the new table nor the old one could be moved: the old one is beside the path
        assert source.mended(spark, path)
    assert spark.read.parquet(path).count() == 3
    source.save(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5 and not source.mended(spark, path)


def test_a_write_that_fails_keeps_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    source.save(spark.range(3), path)

    def broken(at):
        spark.range(9).write.parquet(at)
        raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        source.replaced(spark, path, broken)
    assert spark.read.parquet(path).count() == 3 and len(list(tmp_path.iterdir())) == 1


def test_slippage_is_charged_once(spark, sf):
    bars = source.from_trades(spark, sf)
    candidates = backtest.demo_candidates(spark, bars, source.universe(spark)).limit(50).persist()
    net = lambda bps: {(r.symbol, r.Date, r.direction, r.model_id): (r.gross_return, r.net_return) for r in backtest.planned_trades(bars, candidates, backtest.Portfolio(slippage_bps=bps, cost_bps=5.0)).collect() if r.gross_return is not None}
    none, some = net(0.0), net(2.0)
    assert len(none) > 10 and all(abs(none[k][0] - none[k][1] - 5e-4) < 1e-12 and abs(none[k][1] - some[k][1] - 2e-4) < 1e-12 for k in none)


@pytest.mark.parametrize("promoted, state, eligible, holdout, run, want", [
    ("2024-01-01", "CANDIDATE", False, None, None, "PROMOTED"), (None, "CHAMPION", True, "FINAL_HOLDOUT", None, "PROMOTED"), (None, "CHALLENGER", True, "FINAL_HOLDOUT", "COLLECTING", "FINAL-HOLDOUT QUALIFIED"),
    (None, "CHALLENGER", False, "FINAL_HOLDOUT", "COLLECTING", "SHADOW VALIDATION"), (None, "CHALLENGER", False, None, "INVALIDATED", "DEVELOPMENT CANDIDATE"), (None, "RETIRED", True, None, "CLOSED", "RESEARCH ONLY"), (None, None, True, None, None, "RESEARCH ONLY"),
])
def test_edge_labels(spark, promoted, state, eligible, holdout, run, want):
    row = spark.createDataFrame([(promoted, state, eligible, holdout, run)], "promoted_at string, state string, eligible boolean, holdout_status string, run_status string")
    assert row.selectExpr(f"{discovery.edge_label()} AS e").first().e == want


def test_caps_keep_the_best_and_reject_the_rest(spark, sf):
    from tidemark import queries

    rows = queries.QUERIES["discover_hypothesis_caps"](spark, sf).toPandas()
    kept = rows[rows.decision != "REJECTED_BY_POLICY"]
    assert (kept.groupby(["scope", "direction"]).size() <= discovery.CAP).all() and set(rows[rows.decision == "REJECTED_BY_POLICY"].rejection_reason) <= {"candidate_cap_per_hypothesis"}
    assert (rows[rows.decision == "REJECTED_BY_POLICY"].status == "REJECTED_BY_POLICY").all() and len(rows) > len(kept)
