"""Market-research analytics on Spark: bars, features, labels, splits, scans, backtests, event logs."""
