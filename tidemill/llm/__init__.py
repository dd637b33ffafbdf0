"""Operators for preparing training data at corpus scale.

Nothing outside this subpackage imports it; ``queries.py`` registers one query
for each operator.
"""
