"""Spanloom: trace and CI analytics as Spark DataFrame operators.

Every operator takes DataFrames and returns DataFrames.  See ``README.md`` for
the table schemas and the scale rules the operators follow.
"""
