"""Operators for preparing training data: one module per operator.

Nothing outside this package imports it, except the guarded registration in
``__spark_entry__.py``.
"""
