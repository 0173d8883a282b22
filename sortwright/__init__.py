"""Ordering, checking and preparing very large line-oriented record files with Spark."""
