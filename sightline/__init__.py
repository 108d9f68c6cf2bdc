"""Sightline: detection-quality analytics as Spark DataFrame plans."""
