"""Joins, aggregations, window operators, scoring, detection and ranking."""
