"""Outdoor-recreation geospatial analytics as PySpark DataFrame pipelines."""
