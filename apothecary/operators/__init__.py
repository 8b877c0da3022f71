"""Relational operators: joins, grouping, ranking, stores and search over DataFrames."""
