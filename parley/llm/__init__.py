"""Operators that a large training-corpus pipeline needs, beside the engine's own ones.

Nothing outside this subpackage imports it; :mod:`parley.llm.queries` registers one query per operator.
"""
