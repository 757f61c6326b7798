"""Spark-first segmentation and evaluation of ordered, time-stamped text."""
