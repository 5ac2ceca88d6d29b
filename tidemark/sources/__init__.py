"""Bars, universe and state: where tables come from and go to."""
