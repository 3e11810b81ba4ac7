"""Joins, aggregations, windows, selection, learning operators."""
