"""Operators for preparing training corpora on Spark.

Nothing outside this subpackage imports it; ``queries`` holds the registered
queries and their SQL.
"""
