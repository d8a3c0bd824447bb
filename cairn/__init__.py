"""Cairn: segmentation analytics of event and transaction tables on Spark DataFrames."""

__version__ = "0.1.0"
