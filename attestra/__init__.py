"""Grounded question answering over tables of passages, on Spark."""
