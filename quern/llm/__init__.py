"""Operators of a training-data pipeline: ten distributed text and vector operators.

Nothing else in the library imports this subpackage.  ``registry`` holds the
queries that apply each operator to its whole table and the SQL that states
the same result where SQL can.
"""
