"""Composed plans: views over the given tables, end-to-end runs and the registered queries."""
