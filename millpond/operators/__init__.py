"""Reusable table operators: validation, data tests, compare, profiling."""
