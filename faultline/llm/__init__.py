"""Operators for preparing training data: one module per operator, plus the queries that apply them."""
