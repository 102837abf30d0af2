"""Spanwright: evidence anchors over document snapshots, expressed as Spark DataFrames."""

__version__ = "0.1.0"
