"""Batch-first lakehouse analytics as Spark DataFrame plans.

Bronze files are landed and validated against declared contracts, Gold facts, dimensions and marts are built from the
accepted rows, and the platform's own records (checks, runs, metrics, logs) are analysed with the same plans.
"""
