"""Operators on bars, features, labels, predictions and events."""
