"""Whole jobs: training, scoring, explanation; and the registered queries."""
