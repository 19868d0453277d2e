"""Operators of a training-data pipeline, one module each.

Nothing outside this subpackage imports it; ``queries`` registers the thin
``opN_<name>`` entries and their SQL.
"""
