"""Staged projections: one definition gives the Spark plan and the oracle's SQL."""
