"""Retail-basket analytics as plain Spark DataFrame operators.

Two tables carry everything: ``lines`` (one row per transaction and category)
and ``baskets`` (one row per transaction).  Every operator takes DataFrames and
returns a DataFrame; nothing runs until the caller acts on the result, apart
from model training, which is eager in Spark ML.
"""
