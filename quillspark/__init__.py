"""Spark jobs for text-and-record clean-up over tables of many files at once."""
