"""Spatial analytics over three-dimensional points, and corpus preparation (``llm``), as Spark jobs."""

__version__ = "0.1.0"
