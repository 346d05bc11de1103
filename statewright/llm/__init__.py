"""Operators for large training-data pipelines.

Nothing else in the library imports this subpackage; every operator lives in a
module of its own and the registered queries are in :mod:`statewright.llm.queries`.
"""
