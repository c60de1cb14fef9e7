"""Operators that a training-data pipeline needs besides transcript analytics.

Nothing else in the library imports this package. Each module holds one operator; ``queries`` has
the registered queries and ``oracles`` their SQL.
"""
