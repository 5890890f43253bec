"""Operators: merge, gaps, positions, free float, normalisation, reports."""
