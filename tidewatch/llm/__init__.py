"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each module holds one operator; ``queries``
registers the thin ``opN_<name>`` queries and ``oracles`` their DuckDB SQL.
"""
