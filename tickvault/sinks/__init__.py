"""Sinks: versioned snapshot publish, marks, universe cache."""
