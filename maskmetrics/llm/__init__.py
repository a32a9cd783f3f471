"""Operators for building language-model training data on Spark.

Nothing outside this subpackage imports it.  ``queries`` holds the registered
queries, one per operator, and their SQL where SQL can express them.
"""
