"""Rankloom: multi-source evidence integration and ranking, expressed as Spark plans."""

__version__ = "0.1.0"
