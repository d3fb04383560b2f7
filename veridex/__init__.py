"""Retrieval, versioning and evaluation over tables, written as Spark DataFrame functions."""
