"""Operators of a training-data pipeline over document and embedding tables.

One module per operator; ``queries`` holds the registered ``opN_`` queries and
their DuckDB SQL. Nothing outside this package imports it.
"""
