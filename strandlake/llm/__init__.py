"""Operators for preparing language-model training data, each with its own general interface.

Nothing outside this subpackage imports it; ``registry`` holds the queries.
"""
